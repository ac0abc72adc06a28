"""Stand-ins for the inputs, derived row by row from the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qalink.functions import text as X
from qalink.sources.tables import read_table


# Tables whose rows are texts: a scan of few files is dealt out before the work on them.
TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, deal_out: bool = False) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", deal_out or name in TEXT_TABLES)


# Posts with tags: one answer per order line, tags from the part.

TAGGED_POSTS = """
  SELECT l_orderkey AS question_id, CAST(l_linenumber AS BIGINT) AS answer_id, p_name AS title,
         '<' || lower(p_type) || '><' || p_brand || '><' || split_part(p_name, ' ', 1) || '><'
             || split_part(p_name, ' ', 2) || '>' AS tags
  FROM lineitem JOIN part ON l_partkey = p_partkey
"""


def tagged_posts(spark, sf_dir):
    words = F.split("p_name", " ")
    signs = [F.lower("p_type"), F.col("p_brand"), F.get(words, F.lit(0)), F.get(words, F.lit(1))]
    tags = F.concat(*[piece for s in signs for piece in (F.lit("<"), s, F.lit(">"))])
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), tags.alias("tags"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").cast("long").alias("answer_id"), "title", "tags"
    )


# Selected questions: orders, their priority as category.

SELECTED = "SELECT o_orderkey AS question_id, o_orderpriority AS category FROM orders"
CATEGORY = "1-URGENT"
EXCLUDED = ("economy", "Brand#7")


def selected(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("category")
    )


# Scored answers: order lines, return flag as category, discount as similarity.


def scored_lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("question_id"),
        F.col("l_returnflag").alias("category"),
        F.col("l_discount").alias("similarity"),
    )


# Library symbols: a class and a few methods per part.

SYMBOLS = """
  SELECT p_brand AS group_id, p_type AS artifact_id, CAST(p_size AS VARCHAR) AS version,
         lower(p_type) || '.' || replace(p_name, ' ', '$') AS class_name,
         m[i] AS member_name, p_partkey * 10 + i - 1 AS ord
  FROM (SELECT *, [NULL, '<init>', 'get_' || w2, 'get_' || w2, 'lambda$' || w1, w1 || 'int'] AS m
        FROM (SELECT *, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part)),
       range(1, 7) t(i)
"""


def symbols(spark, sf_dir):
    words = F.split("p_name", " ")
    w1, w2 = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    getter = F.concat(F.lit("get_"), w2)
    members = F.array(
        F.lit(None).cast("string"), F.lit("<init>"), getter, getter, F.concat(F.lit("lambda$"), w1), F.concat(w1, F.lit("int"))
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("group_id"),
        F.col("p_type").alias("artifact_id"),
        F.col("p_size").cast("string").alias("version"),
        F.concat(F.lower("p_type"), F.lit("."), F.translate("p_name", " ", "$")).alias("class_name"),
        F.posexplode(members).alias("pos", "member_name"),
        "p_partkey",
    ).select(
        "group_id", "artifact_id", "version", "class_name", "member_name", (F.col("p_partkey") * 10 + F.col("pos")).alias("ord")
    )


# Selected libraries with their address.

LIBRARIES = """
  SELECT DISTINCT lower(replace(replace(p_name, ' ', '_'), '/', '_')) AS category,
         p_brand AS group_id, p_type AS artifact_id FROM part
"""


def library_urls(spark, sf_dir):
    url = F.concat(F.lit("http://x/"), F.col("p_brand"), F.lit("/"), F.col("p_type"))
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("category"), url.alias("url")).distinct()


# Vectors and sentences: parts of an order as its words.

VECTORS = "SELECT CAST(vec_id AS VARCHAR) AS word, embedding, label FROM embeddings"
ELEMENTS = f"""
  SELECT word, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM ({VECTORS}), range(1, 65) t(i)
"""


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vector")
    )


def label_words(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("c"), F.col("label")).alias("category"), F.col("vec_id").cast("string").alias("word")
    )


def line_words(spark, sf_dir, *keys):
    return table(spark, sf_dir, "lineitem", deal_out=True).select(*keys, F.col("l_partkey").cast("string").alias("word"))


# Usages as text: three amounts of an order line.

USAGES = """
  SELECT 'line ' || l_orderkey AS title,
         'quantity->' || CAST(l_quantity AS INTEGER) || '|linenumber->' || l_linenumber || '|discount->'
             || CAST(round(l_discount * 100) AS INTEGER) AS libraries
  FROM lineitem
"""


def usages(spark, sf_dir):
    fields = [
        X.encode_usage(F.lit("quantity"), F.col("l_quantity").cast("int")),
        X.encode_usage(F.lit("linenumber"), F.col("l_linenumber")),
        X.encode_usage(F.lit("discount"), F.round(F.col("l_discount") * 100).cast("int")),
    ]
    return table(spark, sf_dir, "lineitem", deal_out=True).select(
        F.concat(F.lit("line "), F.col("l_orderkey")).alias("title"), F.concat_ws("|", *fields).alias("libraries")
    )


# SQL of the HTML and text expressions.

def sql_list(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def sql_visible(html: str) -> str:
    hidden = r"(?is)<!--.*?-->|<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>"
    return f"regexp_replace({html}, '{hidden}', '', 'g')"


def sql_elements(html: str, tag: str) -> str:
    return rf"regexp_extract_all({sql_visible(html)}, '(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>', 1)"


def sql_plain(markup: str) -> str:
    breaking = (
        r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|"
        r"main|nav|ol|p|pre|section|table|td|th|tr|ul)(?:\s[^>]*)?/?>"
    )
    out = f"regexp_replace(regexp_replace({markup}, '{breaking}', ' ', 'g'), '<[^>]*>', '', 'g')"
    for entity, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("amp", "&")):
        out = f"replace({out}, '&{entity};', '{char}')"
    return out


def sql_joined(html: str, tag: str) -> str:
    return sql_plain(f"array_to_string({sql_elements(html, tag)}, ' ')")


def sql_chunks(text: str) -> str:
    stop = sql_list(X.JAVA_WORDS)
    cleaned = (
        f"list_transform(string_split(replace({text}, chr(10), ' '), ' '), "
        r"lambda c: trim(regexp_replace(c, '[^\p{L}]', ' ', 'g')))"
    )
    return f"list_filter({cleaned}, lambda c: length(c) > 2 AND NOT list_contains({stop}, c))"


def sql_words(text: str) -> str:
    stop = sql_list(X.JAVA_WORDS)
    words = rf"string_split(regexp_replace({text}, '[^\p{{L}}]', ' ', 'g'), ' ')"
    return f"list_filter({words}, lambda w: length(w) > 2 AND NOT list_contains({stop}, w))"


def sql_split(text: str, separator: str = " ") -> str:
    return f"list_filter(string_split({text}, '{separator}'), lambda w: w <> '')"
