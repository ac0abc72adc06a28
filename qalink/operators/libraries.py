"""Libraries: coordinates, versions, and the symbols found in their archives.

``symbols(group_id, artifact_id, version, class_name, member_name, ord)`` has one row per class
(``member_name`` null) and one per method. The read-outs return one row per symbol; nothing is
gathered into one text per archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qalink.functions import text as X
from qalink.operators.joins import lookup_join

VERSION_KEY = ["group_id", "artifact_id", "version"]


def selected_libraries(selected: DataFrame) -> DataFrame:
    """``category, group_id, artifact_id`` from category names and library addresses."""
    found = selected.select(X.category_slug(F.col("category")).alias("category"), X.url_coordinates(F.col("url")).alias("c"))
    return found.select("category", "c.group_id", "c.artifact_id")


def library_version_lookup(libraries: DataFrame, details: DataFrame) -> DataFrame:
    """Attach a version to each library: the smallest one when several are listed.

    Libraries without details are left out; :func:`without_version` names them.
    """
    versions = details.groupBy("group_id", "artifact_id").agg(F.min("version").alias("version"))
    return lookup_join(libraries, versions, ["group_id", "artifact_id"])


def without_version(libraries: DataFrame, details: DataFrame) -> DataFrame:
    """The libraries that no row of ``details`` gives a version."""
    known = details.where("version is not null").select("group_id", "artifact_id").distinct()
    return lookup_join(libraries, known, ["group_id", "artifact_id"], "left_anti")


def library_versions(versions: DataFrame) -> DataFrame:
    """One row per version of the ``|``-separated list."""
    return versions.select(
        "group_id",
        "artifact_id",
        X.coordinates(F.col("group_id"), F.col("artifact_id")).alias("library"),
        F.explode(X.tokens(F.col("versions"), "|")).alias("version"),
    )


def library_names(libraries: DataFrame, info: DataFrame) -> DataFrame:
    """Name of the library whose address ends with ``group/artifact``; the smallest one if several do.

    An address that ends with ``group/artifact`` has ``artifact``'s last segment as its own last
    segment, so addresses and libraries meet by equality on that segment, one row per address, and
    the whole suffix is tested after; a segment shared by very many addresses is dealt out over
    many tasks. A library whose ``group/artifact`` has no ``/`` (a null part) lies within the last
    segment; for those only, the address lists the suffixes of its last segment.
    """
    keys = libraries.select("group_id", "artifact_id").distinct()
    keys = keys.withColumn("suffix", F.concat_ws("/", "group_id", "artifact_id")).where(F.length("suffix") > 0)
    addresses = info.groupBy("url").agg(F.min("name").alias("name")).where(F.length("url") > 0)
    addresses = addresses.withColumn("segment", F.substring_index("url", "/", -1))
    whole = keys.where(F.col("suffix").contains("/")).withColumn("segment", F.substring_index("suffix", "/", -1))
    found = lookup_join(addresses, whole, ["segment"]).where(F.col("url").endswith(F.col("suffix")))
    inner = keys.where(~F.col("suffix").contains("/"))
    if not inner.isEmpty():
        ends = F.transform(F.sequence(F.lit(1), F.greatest(F.length("segment"), F.lit(1))),
                           lambda i: F.col("segment").substr(i, F.length("segment")))
        listed = addresses.where(F.length("segment") > 0).select("url", "name", F.explode(ends).alias("suffix"))
        found = found.select("group_id", "artifact_id", "name").unionByName(
            lookup_join(listed, inner, ["suffix"]).select("group_id", "artifact_id", "name"))
    return found.groupBy("group_id", "artifact_id").agg(F.min("name").alias("name"))


def with_coordinates(df: DataFrame, libraries: DataFrame, version: bool = False) -> DataFrame:
    """Rows of ``df`` joined with their library by coordinates, with ``version`` by the version too."""
    return lookup_join(df, libraries, VERSION_KEY if version else VERSION_KEY[:2])


# Read-outs. A class name such as ``a.b.C$D`` has the simple name ``C$D``.

def _is_class() -> Column:
    return F.col("member_name").isNull()



def _simple_name() -> Column:
    return F.substring_index("class_name", ".", -1)


def _spaced_name() -> Column:
    return F.rtrim(F.translate(_simple_name(), "$", " "))


def _symbol(symbols: DataFrame, value: Column) -> DataFrame:
    return symbols.select(*VERSION_KEY, "ord", value.alias("symbol"))


def class_symbols(symbols: DataFrame) -> DataFrame:
    """Simple class names, nested names apart."""
    return _symbol(symbols.where(_is_class()), _spaced_name())


def method_symbols(symbols: DataFrame) -> DataFrame:
    """All method names, repeats and constructors kept."""
    return _symbol(symbols.where(~_is_class()), F.col("member_name"))


def class_and_method_symbols(symbols: DataFrame) -> DataFrame:
    """:func:`class_symbols` and :func:`method_symbols` in one pass and in order."""
    return _symbol(symbols, F.coalesce("member_name", _spaced_name()))


def qualified_class_symbols(symbols: DataFrame) -> DataFrame:
    """Fully qualified class names with dots between nested names."""
    return _symbol(symbols.where(_is_class()), F.translate("class_name", "$", "."))


def module_symbols(symbols: DataFrame) -> DataFrame:
    """Simple class names, and each proper method name once per class."""
    proper = _is_class() | ~(F.startswith("member_name", F.lit("<")) | F.contains("member_name", F.lit("$")))
    once = (
        symbols.where(~_is_class())
        .where(proper)
        .groupBy(*VERSION_KEY, "class_name", "member_name")
        .agg(F.min("ord").alias("ord"))
    )
    return _symbol(symbols.where(_is_class()), _simple_name()).unionByName(
        _symbol(once, F.col("member_name"))
    )


def import_lines(entries: DataFrame) -> DataFrame:
    """``path, symbol``: an import line per package directory of an archive."""
    package = F.translate(F.regexp_replace("entry", "/$", ""), "/", ".")
    wanted = F.col("is_dir") & ~F.startswith("entry", F.lit("META-INF"))
    return entries.where(wanted).select("path", F.concat(F.lit("import "), package, F.lit(".*;")).alias("symbol"))


def archive_classes(entries: DataFrame) -> DataFrame:
    """``path, class_name`` of the class entries of an archive, module descriptors skipped."""
    name = F.col("entry")
    wanted = ~F.col("is_dir") & F.endswith(name, F.lit(".class")) & (name != "module-info.class")
    return entries.where(wanted).select(
        "path", F.translate(F.regexp_replace(name, r"\.class$", ""), "/", ".").alias("class_name")
    )


def library_symbols(symbols: DataFrame) -> DataFrame:
    """Distinct tokens of more than one sign over all versions of a library."""
    words = X.tokens(F.coalesce("member_name", _spaced_name()))
    found = symbols.select("group_id", "artifact_id", F.explode(words).alias("token"))
    return found.where(F.length("token") > 1).distinct()


def category_vocabulary(libraries: DataFrame, symbols: DataFrame, kind: str = "both") -> DataFrame:
    """``category, token, n`` over the libraries ``(category, group_id, artifact_id, version)``.

    ``kind``: ``classes``, ``methods`` or ``both``. Names are cleaned chunk by chunk.
    """
    read_out = {"classes": class_symbols, "methods": method_symbols, "both": class_and_method_symbols}[kind]
    named = lookup_join(read_out(symbols), libraries, VERSION_KEY, spread_by=["symbol", "ord"])
    cleaned = X.tokens(F.array_join(X.chunk_identifiers(F.col("symbol")), " "))
    words = named.select("category", F.explode(cleaned).alias("token"))
    return words.groupBy("category", "token").agg(F.count(F.lit(1)).alias("n"))
