"""Identifiers, HTML, mentions, small text expressions, title keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.standins import (
    EXCLUDED, TAGGED_POSTS, sql_chunks, sql_elements, sql_joined, sql_list, sql_plain, sql_split, sql_visible,
    sql_words, table, tagged_posts,
)
from qalink.functions import html as H
from qalink.functions import mentions as M
from qalink.functions import text as X
from qalink.operators import libraries as L
from qalink.operators import posts as P
from qalink.operators import titles as T
from qalink.operators import usages as U
from qalink.operators import words as R

NEEDLE = "the"
NAMES = ("spam-farm", "Onesat", "thanedble")
LINK = '<a href="/der"'
LINE_ENDS = r"[\n\r\x{85}\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}_]"


def _joined(words):
    return F.array_join(words, "|").alias("identifiers")


def _documents(expression):
    return lambda spark, d: table(spark, d, "documents").select("doc_id", _joined(expression(F.col("text"))))


def _sql_documents(words):
    return f"SELECT doc_id, array_to_string({words}, '|') AS identifiers FROM documents"


def _sql_pages(*expressions):
    return f"SELECT page_id, {', '.join(expressions)} FROM pages"


def html_blocks(spark, d):
    blocks = H.block_texts(F.col("html"), "li")
    return table(spark, d, "pages").select("page_id", F.posexplode(blocks).alias("pos", "text"))


SQL_BLOCKS = f"""
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, {sql_plain('b[i]')} AS text
FROM (SELECT page_id, {sql_elements('html', 'li')} AS b FROM pages), unnest(range(1, len(b) + 1)) t(i)
"""


def html_blocks_parsed(spark, d):
    pages = table(spark, d, "pages").select("page_id", "html")
    return H.parsed_block_texts(pages, "html", "li").select("page_id", F.posexplode("blocks").alias("pos", "text"))


def _classified(spark, d):
    link = F.contains(H.visible(F.col("html")), F.lit(LINK))
    category = F.regexp_extract("url", r"example\.([a-z]+)", 1).alias("category")
    return table(spark, d, "pages").select(
        "page_id", category, P.post_class(F.col("html"), NEEDLE, "li", link).alias("class")
    )


SQL_CLASSIFIED = f"""
SELECT page_id, regexp_extract(url, 'example\\.([a-z]+)', 1) AS category,
       CASE WHEN contains({sql_joined('html', 'li')}, '{NEEDLE}') THEN 'withImport'
            WHEN contains({sql_visible('html')}, '{LINK}') THEN 'withLinks'
            ELSE 'not(ImportLinks)' END AS class
FROM pages
"""


def _sql_lines(body, pattern):
    return (
        f"CAST(len(list_filter(regexp_split_to_array({body}, '{LINE_ENDS}'), "
        f"lambda x: regexp_matches(x, '{pattern}'))) AS INTEGER)"
    )


def mention_link(spark, d):
    html = F.concat("html", F.lit('\n<p><a href="'), "url", F.lit('">page</a>'))
    return table(spark, d, "pages").select("page_id", M.link_mentions(html, "en", "474").alias("mentions"))


def mention_method(spark, d):
    body = F.replace(F.replace("text", F.lit(", "), F.lit("(")), F.lit(" "), F.lit("."))
    return table(spark, d, "documents").select("doc_id", M.method_mentions(body, "the", "of").alias("mentions"))


def _distinct_part(column):
    return lambda spark, d: table(spark, d, "part").select(column()).distinct()


def split_camel_case(spark, d):
    token = F.concat("p_type", "p_brand", F.lit("x"), F.col("p_size")).alias("token")
    return table(spark, d, "part").select(token).distinct().select(
        "token", X.split_camel_case(F.col("token")).alias("words")
    )


SQL_CAMEL = """
SELECT token, lower(trim(replace(regexp_replace(regexp_replace(regexp_replace(token,
         '([A-Z])([A-Z][a-z])', '\\1' || chr(1) || '\\2', 'g'),
         '([^A-Z\x01])([A-Z])', '\\1' || chr(1) || '\\2', 'g'),
         '([A-Za-z])([^A-Za-z\x01])', '\\1' || chr(1) || '\\2', 'g'), chr(1), ' '))) AS words
FROM (SELECT DISTINCT p_type || p_brand || 'x' || p_size AS token FROM part)
"""


def url_coordinates(spark, d):
    c = X.url_coordinates(F.col("url"))
    return table(spark, d, "pages").select("page_id", c.alias("c")).select("page_id", "c.group_id", "c.artifact_id")


def parse_tags(spark, d):
    lists = tagged_posts(spark, d).select("tags").distinct()
    return lists.select("tags", F.array_join(X.parse_tags(F.col("tags"), EXCLUDED), "|").alias("parsed"))


SQL_PARSED = f"""
SELECT tags, list_filter({sql_split("replace(replace(tags, '<', ''), '>', ' ')")},
       lambda t: NOT list_contains({sql_list(EXCLUDED)}, t)) AS l FROM (SELECT DISTINCT tags FROM ({TAGGED_POSTS}))
"""


def tag_pairs(spark, d):
    pairs = X.tag_pairs(X.parse_tags(F.col("tags"), EXCLUDED))
    return tagged_posts(spark, d).select("tags").distinct().select("tags", F.inline(pairs))


SQL_PAIRS = f"""
SELECT DISTINCT tags, least(l[i], l[j]) AS tag_a, greatest(l[i], l[j]) AS tag_b
FROM ({SQL_PARSED}), unnest(range(1, len(l) + 1)) a(i), unnest(range(1, len(l) + 1)) b(j) WHERE i < j
"""


def library_versions(spark, d):
    size = F.col("p_size")
    versions = F.concat(size, F.lit("|"), size + 1, F.lit("||r"), size)
    parts = table(spark, d, "part").select(
        F.col("p_brand").alias("group_id"), F.col("p_type").alias("artifact_id"), versions.alias("versions")
    )
    return L.library_versions(parts)


def most_frequent_words(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("word"))
    return R.most_frequent_words(words, ["doc_id"], 5)


def drop_stop_words(spark, d):
    """Distinct document words that no benchmark item has."""
    words = table(spark, d, "documents").select("doc_id", X.word_identifiers(F.col("text")).alias("identifiers"))
    items = table(spark, d, "benchmark").select(F.explode(X.word_identifiers(F.col("text"))).alias("word"))
    return R.drop_stop_words(U.post_tokens(words, ["doc_id"]), items)


def answer_records(spark, d):
    posts = table(spark, d, "conversations").select(
        F.col("conv_id").alias("question_id"), F.col("turn").alias("answer_id"), F.col("text").alias("title"), F.col("text").alias("body")
    )
    return P.answer_records(posts, F.array_join(X.word_identifiers(F.col("body")), "|"))


TAG_OF_LANG = {"en": "NN", "fr": "VBD", "de": "JJ", "es": "DT"}


def title_keywords(spark, d):
    tag = F.create_map(*[F.lit(x) for pair in TAG_OF_LANG.items() for x in pair])
    documents = table(spark, d, "documents")
    tagged = documents.select(F.explode(X.tokens(F.col("text"))).alias("token"), tag[F.col("lang")].alias("tag"))
    titles = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("title"))
    return T.title_keywords(titles, T.build_lexicon(tagged), ["conv_id", "turn"])


SQL_KEYWORDS = f"""
WITH tagged AS (
  SELECT lower(unnest({sql_split('text')})) AS token,
         CASE lang WHEN 'en' THEN 'NN' WHEN 'fr' THEN 'VBD' WHEN 'de' THEN 'JJ' ELSE 'DT' END AS tag
  FROM documents),
lexicon AS (
  SELECT token, tag FROM (
    SELECT token, tag, row_number() OVER (PARTITION BY token ORDER BY n DESC, tag) AS r
    FROM (SELECT token, tag, count(*) AS n FROM tagged GROUP BY 1, 2)) WHERE r = 1),
words AS (
  SELECT conv_id, turn, i, w[i] AS token
  FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(replace(text, ',', '')), '\\s+'), lambda t: t <> '') AS w
        FROM conversations), unnest(range(1, len(w) + 1)) t(i)),
kept AS (
  SELECT conv_id, turn, string_agg(words.token, ' ' ORDER BY i) AS keywords
  FROM words LEFT JOIN lexicon ON words.token = lexicon.token
  WHERE regexp_matches(coalesce(tag, 'NN'), 'NN|VB|JJ') GROUP BY 1, 2)
SELECT c.conv_id, c.turn, coalesce(keywords, '') AS keywords
FROM conversations c LEFT JOIN kept k ON c.conv_id = k.conv_id AND c.turn = k.turn
"""


def token_intersection(spark, d):
    def words(name, *keys):
        return table(spark, d, name).select(*keys, X.word_identifiers(F.col("text")).alias("identifiers"))

    turns = U.post_tokens(words("conversations", "conv_id", "turn"), ["conv_id", "turn"])
    items = U.post_tokens(words("benchmark", "item_id"), ["item_id"])
    return U.token_overlap(turns, items, ["conv_id", "turn"], ["item_id"])


SQL_INTERSECTION = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, unnest({sql_words('text')}) AS token FROM conversations),
     b AS (SELECT DISTINCT item_id, unnest({sql_words('text')}) AS token FROM benchmark)
SELECT conv_id, turn, item_id, CAST(count(*) AS INTEGER) AS matches FROM t JOIN b USING (token) GROUP BY 1, 2, 3
"""

QUERIES = {
    "identifiers_chunk": (_documents(X.chunk_identifiers), _sql_documents(sql_chunks("text"))),
    "identifiers_word": (_documents(X.word_identifiers), _sql_documents(sql_words("text"))),
    "identifiers_pre": (
        lambda s, d: table(s, d, "pages").select("page_id", _joined(X.chunk_words(H.joined_text(F.col("html"), "article")))),
        _sql_pages(
            "array_to_string(list_filter(string_split(array_to_string("
            + sql_chunks(sql_joined("html", "article"))
            + ", ' '), ' '), lambda w: length(w) > 2), '|') AS identifiers"
        ),
    ),
    "identifiers_code": (
        lambda s, d: table(s, d, "pages").select("page_id", _joined(X.word_identifiers(H.joined_text(F.col("html"), "li")))),
        _sql_pages(f"array_to_string({sql_words(sql_joined('html', 'li'))}, '|') AS identifiers"),
    ),
    "html_blocks": (html_blocks, SQL_BLOCKS),
    "html_blocks_parsed": (html_blocks_parsed, SQL_BLOCKS),
    "contains_import": (
        lambda s, d: table(s, d, "pages").select("page_id", H.mentions_in_elements(F.col("html"), NEEDLE, "li").alias("found")),
        _sql_pages(f"contains({sql_joined('html', 'li')}, '{NEEDLE}') AS found"),
    ),
    "contains_links": (
        lambda s, d: table(s, d, "pages").select(
            "page_id", H.has_element(F.col("html")).alias("has_link"), H.has_element(F.col("html"), "h2").alias("has_heading")
        ),
        _sql_pages(
            rf"regexp_matches({sql_visible('html')}, '(?i)<a[\s/>]') AS has_link",
            rf"regexp_matches({sql_visible('html')}, '(?i)<h2[\s/>]') AS has_heading",
        ),
    ),
    "text_reference_filter": (
        lambda s, d: P.naming_posts(
            table(s, d, "pages").select("page_id", F.col("url").alias("title"), F.col("html").alias("body")), NAMES
        ).select("page_id", "title"),
        "SELECT page_id, url AS title FROM pages WHERE "
        + " OR ".join(f"contains(lower(url), '{n.lower()}') OR contains(lower(html), '{n.lower()}')" for n in NAMES),
    ),
    "post_class_split": (_classified, SQL_CLASSIFIED),
    "post_class_counts": (
        lambda s, d: P.class_counts(_classified(s, d)),
        f"SELECT class, count(*) AS n FROM ({SQL_CLASSIFIED}) GROUP BY 1 "
        f"UNION ALL SELECT 'total', count(*) FROM pages",
    ),
    "post_class_split_report": (
        lambda s, d: P.class_split_report(_classified(s, d)),
        f"""SELECT class, category, len, CAST(sum(len) OVER (PARTITION BY category ORDER BY
              CASE class WHEN 'withImport' THEN 1 WHEN 'withLinks' THEN 2 ELSE 3 END) AS BIGINT) AS total
            FROM (SELECT class, category, count(*) AS len FROM ({SQL_CLASSIFIED}) GROUP BY 1, 2)""",
    ),
    "mention_fqn": (
        lambda s, d: table(s, d, "documents").select("doc_id", M.type_mentions(F.col("text"), "the").alias("mentions")),
        f"SELECT doc_id, {_sql_lines('text', f'(?i)(^|[^{WORD[1:-1]}])the($|[^{WORD[1:-1]}])')} AS mentions FROM documents",
    ),
    "mention_simple": (
        lambda s, d: table(s, d, "documents").select("doc_id", M.simple_name_mentions(F.col("text"), "The").alias("mentions")),
        "SELECT doc_id, "
        + _sql_lines("text", r"([a-z] |[.!?] |[(<])The([>).,!?$]| [a-z])")
        + r" + CASE WHEN regexp_matches(text, '^The([>).,!?$]| [a-z])') AND NOT regexp_matches(regexp_split_to_array(text, '"
        + LINE_ENDS
        + r"')[1], '([a-z] |[.!?] |[(<])The([>).,!?$]| [a-z])') THEN 1 ELSE 0 END AS mentions FROM documents",
    ),
    "mention_link": (
        mention_link,
        f"""SELECT page_id, {_sql_lines("html || chr(10) || '<p><a href=' || chr(34) || url || chr(34) || '>page</a>'",
            '<a.*href.*en/474[.]html.*>.*</a>')} AS mentions FROM pages""",
    ),
    "mention_method": (
        mention_method,
        "SELECT doc_id, "
        + _sql_lines("replace(replace(text, ', ', '('), ' ', '.')", "the[.]of[(| ]")
        + " AS mentions FROM documents",
    ),
    "split_camel_case": (split_camel_case, SQL_CAMEL),
    "category_slug": (
        _distinct_part(lambda: X.category_slug(F.concat("p_type", F.lit(" / "), "p_name")).alias("slug")),
        "SELECT DISTINCT lower(regexp_replace(p_type || ' / ' || p_name, '[ /]', '_', 'g')) AS slug FROM part",
    ),
    "url_coordinates": (
        url_coordinates,
        "SELECT page_id, p[-2] AS group_id, p[-1] AS artifact_id "
        "FROM (SELECT page_id, string_split(regexp_replace(url, '/+$', ''), '/') AS p FROM pages)",
    ),
    "parse_tags": (parse_tags, f"SELECT tags, array_to_string(l, '|') AS parsed FROM ({SQL_PARSED})"),
    "tag_pairs": (tag_pairs, SQL_PAIRS),
    "library_versions": (
        library_versions,
        "SELECT p_brand AS group_id, p_type AS artifact_id, p_brand || ' ' || p_type AS library, "
        "unnest([p_size::VARCHAR, (p_size + 1)::VARCHAR, 'r' || p_size]) AS version FROM part",
    ),
    "jar_path": (
        _distinct_part(
            lambda: X.jar_path(F.concat(F.lit("com."), F.col("p_brand")), F.concat("p_type", F.lit(".x")), F.col("p_size").cast("string")).alias("path")
        ),
        "SELECT DISTINCT 'com/' || p_brand || '/' || p_type || '/x/' || p_size || '/' || p_type || '.x-' || p_size || '.jar' AS path FROM part",
    ),
    "most_frequent_words": (
        most_frequent_words,
        f"""SELECT doc_id, word, count, CAST(rank AS INTEGER) AS rank FROM (
              SELECT doc_id, word, count, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, word) AS rank
              FROM (SELECT doc_id, word, count(*) AS count
                    FROM (SELECT doc_id, unnest({sql_split('text')}) AS word FROM documents) GROUP BY 1, 2))
            WHERE rank <= 5""",
    ),
    "drop_stop_words": (
        drop_stop_words,
        f"""SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest({sql_words('text')}) AS token FROM documents)
            WHERE token NOT IN (SELECT unnest({sql_words('text')}) FROM benchmark)""",
    ),
    "answer_records": (
        answer_records,
        f"""SELECT conv_id AS question_id, turn AS answer_id, replace(text, ',', ' ') AS title,
              array_to_string({sql_words('text')}, '|') AS identifiers FROM conversations""",
    ),
    "title_keywords": (title_keywords, SQL_KEYWORDS),
    "token_intersection": (token_intersection, SQL_INTERSECTION),
}
