"""Libraries, versions, symbols, vocabularies, overlap scoring."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from catalog.standins import LIBRARIES, SYMBOLS, library_urls, sql_chunks, sql_split, sql_words, symbols, table
from qalink.functions import text as X
from qalink.operators import libraries as L
from qalink.operators import scoring as S
from qalink.sources import archives
from qalink.sources.scratch import stored


def library_version_lookup(spark, d):
    details = table(spark, d, "part").select(
        F.col("p_brand").alias("group_id"), F.col("p_type").alias("artifact_id"), F.col("p_size").cast("string").alias("version")
    )
    return L.library_version_lookup(L.selected_libraries(library_urls(spark, d)), details)


SQL_VERSIONED = f"""
SELECT category, group_id, artifact_id, version FROM ({LIBRARIES})
JOIN (SELECT p_brand AS group_id, p_type AS artifact_id, min(CAST(p_size AS VARCHAR)) AS version FROM part GROUP BY 1, 2)
USING (group_id, artifact_id)
"""


def library_name_suffix_join(spark, d):
    keys = table(spark, d, "part").select(
        F.expr("substring(p_brand, 2)").alias("group_id"), F.col("p_type").alias("artifact_id")
    )
    return L.library_names(keys, library_urls(spark, d).withColumnRenamed("category", "name"))


SQL_SUFFIX = """
SELECT group_id, artifact_id, min(p_name) AS name
FROM (SELECT DISTINCT substr(p_brand, 2) AS group_id, p_type AS artifact_id FROM part)
JOIN (SELECT DISTINCT p_name, 'http://x/' || p_brand || '/' || p_type AS url FROM part)
  ON ends_with(url, group_id || '/' || artifact_id)
GROUP BY 1, 2
"""


def _archives(spark, d):
    """An archive per part with the five names it holds."""
    folder = F.concat(F.lower("p_type"), F.lit("/"), F.translate("p_name", " ", "/"), F.lit("/"))
    names = F.array(
        folder, F.lit("META-INF/"), F.lit("module-info.class"), F.concat(folder, F.lit("A$B.class")), F.concat(folder, F.lit("notes.txt"))
    )
    return table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), names.alias("names"))


def _entries(spark, d):
    entries = _archives(spark, d).select("path", F.explode("names").alias("entry"))
    return entries.withColumn("is_dir", F.endswith("entry", F.lit("/")))


SQL_ENTRIES = """
SELECT path, n AS entry, ends_with(n, '/') AS is_dir
FROM (SELECT path, unnest([f, 'META-INF/', 'module-info.class', f || 'A$B.class', f || 'notes.txt']) AS n
      FROM (SELECT 'p' || p_partkey AS path, lower(p_type) || '/' || replace(p_name, ' ', '/') || '/' AS f FROM part))
"""


def archive_entries(spark, d):
    @F.pandas_udf("binary")
    def packed(names: pd.Series) -> pd.Series:
        def pack(entries):
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w") as archive:
                for entry in entries:
                    archive.writestr(zipfile.ZipInfo(entry), b"")
            return data.getvalue()

        return names.map(pack)

    return archives.list_entries(_archives(spark, d).select("path", packed("names").alias("content")))


def category_vocabulary(spark, d):
    return L.category_vocabulary(stored(library_version_lookup(spark, d)), symbols(spark, d))


def _spaced(name):
    return f"rtrim(replace(split_part({name}, '.', -1), '$', ' '))"


SQL_VOCABULARY = f"""
SELECT category, token, count(*) AS n
FROM (SELECT category, unnest({sql_split("array_to_string(" + sql_chunks('symbol') + ", ' ')")}) AS token
      FROM (SELECT group_id, artifact_id, version, coalesce(member_name, {_spaced('class_name')}) AS symbol FROM ({SYMBOLS}))
      JOIN ({SQL_VERSIONED}) USING (group_id, artifact_id, version))
GROUP BY 1, 2
"""


def _overlap_input(spark, d):
    answers = table(spark, d, "conversations").select(
        F.col("conv_id").alias("question_id"), F.col("turn").alias("answer_id"), X.word_identifiers(F.col("text")).alias("identifiers")
    )
    words = table(spark, d, "documents").select(
        F.col("lang").alias("category"), F.explode(X.word_identifiers(F.col("text"))).alias("token")
    )
    words = stored(words.distinct())
    return answers, words, words


def closest_category_classical(spark, d):
    chosen = S.closest_category_classical(*_overlap_input(spark, d), min_method=0.4)
    return chosen.withColumn("similarity", F.round("similarity", 6))


def class_similarity(spark, d):
    scores = S.question_scores(*_overlap_input(spark, d)).where("class_answers > 0")
    return scores.select("question_id", "category", F.round("class_similarity", 6).alias("similarity"))


def method_similarity(spark, d):
    scores = S.question_scores(*_overlap_input(spark, d)).where("method_similarity is not null")
    return scores.select("question_id", "category", F.round("method_similarity", 6).alias("similarity"))


SQL_SCORES = rf"""
answers AS (
  SELECT conv_id AS q, turn AS a, w, len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Ll}}'))) AS lower
  FROM (SELECT conv_id, turn, {sql_words('text')} AS w FROM conversations) WHERE len(w) > 2),
totals AS (SELECT q, count(*) AS n, count(*) FILTER (WHERE lower = 0) AS empty FROM answers GROUP BY 1),
vocabulary AS (SELECT DISTINCT lang, unnest({sql_words('text')}) AS token FROM documents),
hits AS (
  SELECT q, a, lang, max(lower) AS lower,
         max(CASE WHEN regexp_matches(token, '^\p{{Lu}}') THEN 1 ELSE 0 END) AS cls,
         count(*) FILTER (WHERE regexp_matches(token, '^\p{{Ll}}')) AS methods
  FROM (SELECT DISTINCT q, a, lower, unnest(w) AS token FROM answers) JOIN vocabulary USING (token) GROUP BY 1, 2, 3),
scores AS (
  SELECT q, lang, n, sum(cls) AS classes, sum(cls) / n AS cs,
         CASE WHEN empty = 0 THEN coalesce(sum(methods / nullif(lower, 0)), 0.0) / n END AS ms
  FROM hits JOIN totals USING (q) GROUP BY 1, 2, n, empty)
"""


def _read_out(read):
    return lambda spark, d: read(symbols(spark, d))


def _sql_read_out(value, condition="true"):
    return f"SELECT group_id, artifact_id, version, ord, {value} AS symbol FROM ({SYMBOLS}) WHERE {condition}"


QUERIES = {
    "library_version_lookup": (library_version_lookup, SQL_VERSIONED),
    "library_name_suffix_join": (library_name_suffix_join, SQL_SUFFIX),
    "archive_entries": (archive_entries, SQL_ENTRIES),
    "archive_classes": (
        lambda s, d: L.archive_classes(_entries(s, d)),
        f"SELECT path, replace(regexp_replace(entry, '[.]class$', ''), '/', '.') AS class_name FROM ({SQL_ENTRIES}) "
        "WHERE entry LIKE '%.class' AND entry <> 'module-info.class'",
    ),
    "symbols_imports": (
        lambda s, d: L.import_lines(_entries(s, d)),
        f"SELECT path, 'import ' || replace(regexp_replace(entry, '/$', ''), '/', '.') || '.*;' AS symbol "
        f"FROM ({SQL_ENTRIES}) WHERE is_dir AND NOT starts_with(entry, 'META-INF')",
    ),
    "symbols_classes": (_read_out(L.class_symbols), _sql_read_out(_spaced("class_name"), "member_name IS NULL")),
    "symbols_methods": (_read_out(L.method_symbols), _sql_read_out("member_name", "member_name IS NOT NULL")),
    "symbols_classes_methods": (
        _read_out(L.class_and_method_symbols), _sql_read_out(f"coalesce(member_name, {_spaced('class_name')})")
    ),
    "symbols_fqn": (
        _read_out(L.qualified_class_symbols), _sql_read_out("replace(class_name, '$', '.')", "member_name IS NULL")
    ),
    "symbols_modules": (
        _read_out(L.module_symbols),
        _sql_read_out("split_part(class_name, '.', -1)", "member_name IS NULL")
        + f""" UNION ALL SELECT group_id, artifact_id, version, min(ord) AS ord, member_name AS symbol FROM ({SYMBOLS})
               WHERE member_name IS NOT NULL AND NOT starts_with(member_name, '<') AND NOT contains(member_name, '$')
               GROUP BY group_id, artifact_id, version, class_name, member_name""",
    ),
    "library_symbols": (
        lambda s, d: L.library_symbols(symbols(s, d)),
        f"""SELECT DISTINCT group_id, artifact_id, token
            FROM (SELECT group_id, artifact_id, unnest({sql_split(f"coalesce(member_name, {_spaced('class_name')})")}) AS token
                  FROM ({SYMBOLS})) WHERE length(token) > 1""",
    ),
    "category_vocabulary": (category_vocabulary, SQL_VOCABULARY),
    "class_similarity": (
        class_similarity,
        f"WITH {SQL_SCORES} SELECT q AS question_id, lang AS category, round(cs, 6) AS similarity FROM scores WHERE classes > 0",
    ),
    "method_similarity": (
        method_similarity,
        f"WITH {SQL_SCORES} SELECT q AS question_id, lang AS category, round(ms, 6) AS similarity FROM scores WHERE ms IS NOT NULL",
    ),
    "closest_category_classical": (
        closest_category_classical,
        f"""WITH {SQL_SCORES},
            candidates AS (SELECT *, max(classes) OVER (PARTITION BY q) AS top FROM scores),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(ms, 9) DESC NULLS LAST, lang) AS r
                       FROM candidates WHERE classes = top AND round(cs, 9) >= 0.5)
            SELECT q AS question_id, lang AS category, round(ms, 6) AS similarity FROM ranked
            WHERE r = 1 AND round(ms, 9) > 0.4""",
    ),
}
