"""Text expressions: identifiers, tags, coordinates, usage fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from qalink.functions.binding import let

# Words of the Java language that never count as identifiers.
JAVA_WORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double "
    "else enum extends exception false final finally float for goto if implements import "
    "instanceof int interface java long native new null override package private protected "
    "public return short static strictfp string super switch synchronized this throw throws "
    "transient true try void volatile while"
).split()

# Tags too general to form a telling pair.
GENERAL_TAGS = ("java", "android", "c++", "c", "c#", "eclipse", "intellij", "java-8")

# A letter of the basic multilingual plane; letters beyond it count as blanks.
_LETTER = r"[\p{L}&&[\x{0}-\x{FFFF}]]"
_NOT_LETTER = r"[^\p{L}\n]|[\x{10000}-\x{10FFFF}]"


def tokens(text: Column, separator: str = " ") -> Column:
    """Split on a separator sign and drop the empty pieces."""
    # An escaped sign is split without the regex engine, unlike a quoted one.
    pattern = "\\" + separator if separator in "|.$" else separator
    return F.filter(F.split(text, pattern), lambda t: t != "")


def _without(words: Column, stop_words: Sequence[str]) -> Column:
    if not stop_words:
        return words
    return F.filter(words, lambda w: ~w.isin(*stop_words))


def _chunks(text: Column, stop_words: Sequence[str]) -> Column:
    # From the first to the last letter of a blank-free run, at least three characters long.
    runs = F.regexp_extract_all(text, F.lit(_LETTER + r"[^ \n]+" + _LETTER), F.lit(0))
    return _without(runs, stop_words)


def chunk_identifiers(text: Column, stop_words: Sequence[str] = JAVA_WORDS) -> Column:
    """Identifiers per blank-separated chunk.

    Signs inside a chunk turn into blanks, and a chunk is dropped only when the whole of it
    is a stop word, so ``x.int`` keeps its ``int`` while a lone ``int`` goes.
    """
    # Chunks hold no line break, so they are cleaned as the lines of one string.
    lines = F.regexp_replace(F.array_join(_chunks(text, stop_words), "\n"), _NOT_LETTER, " ")
    return tokens(lines, "\n")


def word_identifiers(text: Column, stop_words: Sequence[str] = JAVA_WORDS) -> Column:
    """Letter runs of three or more, stop words removed one by one."""
    words = F.regexp_extract_all(text, F.lit(_LETTER + "{3,}"), F.lit(0))
    return _without(words, stop_words)


def chunk_words(text: Column, stop_words: Sequence[str] = JAVA_WORDS) -> Column:
    """The words of three letters or more inside the chunks of :func:`chunk_identifiers`."""
    kept = F.array_join(_chunks(text, stop_words), " ")
    return F.regexp_extract_all(kept, F.lit(_LETTER + "{3,}"), F.lit(0))


def split_camel_case(token: Column) -> Column:
    """``HTTPClient`` -> ``http client``."""
    # Fixed value: where a word of a name ends.
    humps = "(?<=[A-Z])(?=[A-Z][a-z])|(?<=[^A-Z])(?=[A-Z])|(?<=[A-Za-z])(?=[^A-Za-z])"
    return F.trim(F.lower(F.regexp_replace(token, humps, " ")))


def category_slug(name: Column) -> Column:
    return F.lower(F.translate(name, " /", "__"))


def url_coordinates(url: Column) -> Column:
    """``struct(group_id, artifact_id)``: the last two path segments, null when there are fewer."""

    def last_two(parts: Column) -> Column:
        size = F.size(parts)
        return F.struct(
            F.get(parts, size - 2).alias("group_id"),
            F.when(size >= 2, F.get(parts, size - 1)).alias("artifact_id"),
        )

    return let(F.split(F.regexp_replace(url, "/+$", ""), "/"), last_two)


def parse_tags(tags: Column, excluded: Sequence[str] = ()) -> Column:
    """``<a><b>`` -> ``[a, b]``, repeats kept."""
    opened = F.regexp_replace(F.regexp_replace(tags, "<", ""), ">", " ")
    return _without(tokens(opened), excluded)


def tag_pairs(tags: Column) -> Column:
    """All unordered pairs of a tag list as ``struct(tag_a, tag_b)`` with ``tag_a <= tag_b``.

    A repeated tag pairs with itself once, and each pair is listed once.
    """

    def pairs(ordered: Column) -> Column:
        return F.transform(
            ordered,
            lambda a, i: F.transform(
                F.slice(ordered, i + 2, F.size(ordered)),
                lambda b: F.struct(a.alias("tag_a"), b.alias("tag_b")),
            ),
        )

    return F.array_distinct(F.flatten(let(F.sort_array(tags), pairs)))


def title_commas_to_blanks(title: Column) -> Column:
    return F.translate(title, ",", " ")


def title_without_commas(title: Column) -> Column:
    return F.replace(title, F.lit(","), F.lit(""))


def starts_upper(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}")


def starts_lower(word: Column) -> Column:
    return word.rlike(r"^\p{Ll}")


def coordinates(group_id: Column, artifact_id: Column) -> Column:
    return F.concat_ws(" ", group_id, artifact_id)


def jar_path(group_id: Column, artifact_id: Column, version: Column) -> Column:
    """Repository path of an archive; dots become directories, but not in the file name."""
    directory = F.translate(F.concat_ws("/", group_id, artifact_id), ".", "/")
    file_name = F.concat(artifact_id, F.lit("-"), version, F.lit(".jar"))
    return F.concat_ws("/", directory, version, file_name)


def encode_usage(library: Column, matches: Column) -> Column:
    return F.concat(library, F.lit("->"), matches.cast("string"))


def decode_usages(field: Column) -> Column:
    """``lib->n|lib->n`` -> ``array<struct(library, matches)>``."""
    return F.transform(
        tokens(field, "|"),
        lambda item: F.struct(
            F.substring_index(item, "->", 1).alias("library"),
            F.substring_index(item, "->", -1).try_cast("int").alias("matches"),
        ),
    )


def best_usages(usages: Column, above: int = 1) -> Column:
    """The entries sharing the highest match count, if that count exceeds ``above``."""

    def kept(all_usages: Column) -> Column:
        highest = F.array_max(F.transform(all_usages, lambda u: u["matches"]))
        return let(
            highest,
            lambda best: F.filter(all_usages, lambda u: (u["matches"] == best) & (best > above)),
        )

    return let(usages, kept)
