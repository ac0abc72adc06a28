"""The registered queries of this package, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qalink.llm import codebooks, importance, projections
from qalink.llm import cuckoo, kneser_ney, merge_automaton, mixing, near_copies, norm_search, planes, surrogates, toxic_spans, url_rules
from qalink.sources.scratch import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The production key comes from the caller's secret store; reruns of the registered query agree.
SURROGATE_KEY = "registered-query"


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.without_personal_data(docs, SURROGATE_KEY)


def op2_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.duplicates(_table(spark, sf_dir, "documents")).drop("row_key")


OP2_SQL = r"""
  WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
             FROM documents),
       r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS rn,
                    count(*) OVER (PARTITION BY text_sha256) AS group_size,
                    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)
                      AS keep_id
             FROM d)
  SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, rn = 1 AS kept, text_sha256 FROM r
"""


#: The verdicts asked for, and the method's own patterns for all other URLs.
HOST_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
OWN_PATTERNS = [(None, "block", 0, "||spam-farm."), (None, "block", 0, "||ads."), (None, "block", 0, "*/banner/*")]


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_rules.rule_table(spark, url_rules.host_rules(HOST_RULES) + OWN_PATTERNS)
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
  WITH p AS (SELECT page_id, row_number() OVER () AS r,
                    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
             FROM pages),
       q AS (SELECT page_id, r,
                    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                              'abcdefghijklmnopqrstuvwxyz') AS host,
                    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
             FROM p),
       rules(rule, verdict, h, p) AS (VALUES
         ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
         ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'),
         ('net/fr/', 'block', 'net', '/fr/')),
       m AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
             FROM q JOIN rules ON (q.host = h OR ends_with(q.host, '.' || h)) AND starts_with(q.path, p) GROUP BY r)
  SELECT page_id, host, path, rule,
         coalesce(verdict, CASE WHEN regexp_matches(host || path, '^([^/]*\.)?(spam-farm|ads)\.')
                                  OR contains(host || path, '/banner/') THEN 'block' ELSE 'allow' END) AS verdict
  FROM q LEFT JOIN m USING (r)
"""


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("given.doc_id", "size", "source_size", "target", taken)


OP4_SQL = r"""
  WITH d AS (SELECT doc_id, source, CAST(length(regexp_replace(regexp_replace(coalesce(text, ''),
                      '[^ 	-
]+', 'x', 'g'), '[ 	-
]', '', 'g')) AS BIGINT) AS size
             FROM documents),
       s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                    [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
             FROM d GROUP BY source),
       o AS (SELECT *, 2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS everything,
                    row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS r FROM s),
       l AS (SELECT *, (everything - coalesce(sum(most) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                       / sum(weight) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
       f AS (SELECT coalesce(arg_min(level, r) FILTER (WHERE most > level * weight), max(level)) AS level FROM l),
       t AS (SELECT source, source_size, least(most, (SELECT level FROM f) * weight) AS target FROM o),
       u AS (SELECT doc_id, size, source_size, target,
                    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
                    CAST('0x' || substr(sha256('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' ||
                      coalesce('0' || t.source, '1') || '|' || size), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS draw
             FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
  SELECT doc_id, size, source_size, target,
         CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
  FROM u
"""


def op5_toxic_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxic_spans.score(docs, _table(spark, sf_dir, "labels"))
    return scored.withColumn("spans", F.size("spans"))


def op6_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    planes.write_ids(_table(spark, sf_dir, "documents"), folder, tokenizer_path(), end_id=1)
    return planes.read_checksums(spark, folder)


def op7_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(_table(spark, sf_dir, "documents")).drop("key", "class")


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return kneser_ney.judge(docs, _table(spark, sf_dir, "labels")).drop("key")


def op9_merge_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_automaton.encoding_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return norm_search.top_products(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256.0)


OP10_SQL = r"""
  WITH v AS (SELECT row_number() OVER () AS r, vec_id,
                    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
             FROM embeddings
             WHERE embedding IS NOT NULL
               AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
       s AS (SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id,
                    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
             FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id AND len(q.v) = len(c.v)),
       k AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
  SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 5
"""


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, _table(spark, sf_dir, "benchmark").select("text"))


def op12_limb_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return codebooks.encode(vectors).drop("label")


OP12_SQL = r"""
  WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
             FROM embeddings
             WHERE embedding IS NOT NULL
               AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))
                                                   OR abs(CAST(x AS DOUBLE)) >= 131072)) = 0),
       f AS (SELECT len(w) AS dims FROM v ORDER BY vec_id NULLS LAST, w LIMIT 1),
       k AS (SELECT row_number() OVER () AS r, vec_id, label, w, dims // 4 AS width FROM v, f
             WHERE len(w) = dims AND dims % 4 = 0 AND dims > 0),
       p AS (SELECT r, part, list_slice(w, part * width + 1, (part + 1) * width) AS x FROM k, range(4) t(part)),
       u AS (SELECT r, part, unnest(x) AS val, unnest(range(1, len(x) + 1)) AS pos FROM p),
       c0 AS (SELECT part, e - 1 AS entry, x
              FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id NULLS LAST, w) AS e
                    FROM p JOIN k USING (r))
              WHERE e <= 256),
       a1 AS (SELECT r, part, entry, dist FROM (
                SELECT p.r, p.part, c.entry,
                       list_sum(list_transform(list_zip(p.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS dist,
                       row_number() OVER (PARTITION BY p.r, p.part
                         ORDER BY list_sum(list_transform(list_zip(p.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), c.entry) AS rn
                FROM p JOIN c0 c USING (part)) WHERE rn = 1),
       c1 AS (SELECT c.part, c.entry, coalesce(n.x, c.x) AS x FROM c0 c LEFT JOIN (
                SELECT part, entry, list(CAST(floor(s / cnt) AS BIGINT) ORDER BY pos) AS x
                FROM (SELECT a.part, a.entry, u.pos, sum(u.val) AS s, count(*) AS cnt
                      FROM a1 a JOIN u USING (r, part) GROUP BY a.part, a.entry, u.pos) GROUP BY part, entry) n
              USING (part, entry)),
       a2 AS (SELECT r, part, entry, dist FROM (
                SELECT p.r, p.part, c.entry,
                       list_sum(list_transform(list_zip(p.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS dist,
                       row_number() OVER (PARTITION BY p.r, p.part
                         ORDER BY list_sum(list_transform(list_zip(p.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), c.entry) AS rn
                FROM p JOIN c1 c USING (part)) WHERE rn = 1),
       c2 AS (SELECT c.part, c.entry, coalesce(n.x, c.x) AS x FROM c1 c LEFT JOIN (
                SELECT part, entry, list(CAST(floor(s / cnt) AS BIGINT) ORDER BY pos) AS x
                FROM (SELECT a.part, a.entry, u.pos, sum(u.val) AS s, count(*) AS cnt
                      FROM a2 a JOIN u USING (r, part) GROUP BY a.part, a.entry, u.pos) GROUP BY part, entry) n
              USING (part, entry)),
       a3 AS (SELECT r, part, entry, dist FROM (
                SELECT p.r, p.part, c.entry,
                       list_sum(list_transform(list_zip(p.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS dist,
                       row_number() OVER (PARTITION BY p.r, p.part
                         ORDER BY list_sum(list_transform(list_zip(p.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), c.entry) AS rn
                FROM p JOIN c2 c USING (part)) WHERE rn = 1),
       c3 AS (SELECT c.part, c.entry, coalesce(n.x, c.x) AS x FROM c2 c LEFT JOIN (
                SELECT part, entry, list(CAST(floor(s / cnt) AS BIGINT) ORDER BY pos) AS x
                FROM (SELECT a.part, a.entry, u.pos, sum(u.val) AS s, count(*) AS cnt
                      FROM a3 a JOIN u USING (r, part) GROUP BY a.part, a.entry, u.pos) GROUP BY part, entry) n
              USING (part, entry)),
       a4 AS (SELECT r, part, entry, dist FROM (
                SELECT p.r, p.part, c.entry,
                       list_sum(list_transform(list_zip(p.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS dist,
                       row_number() OVER (PARTITION BY p.r, p.part
                         ORDER BY list_sum(list_transform(list_zip(p.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), c.entry) AS rn
                FROM p JOIN c3 c USING (part)) WHERE rn = 1),
       c4 AS (SELECT c.part, c.entry, coalesce(n.x, c.x) AS x FROM c3 c LEFT JOIN (
                SELECT part, entry, list(CAST(floor(s / cnt) AS BIGINT) ORDER BY pos) AS x
                FROM (SELECT a.part, a.entry, u.pos, sum(u.val) AS s, count(*) AS cnt
                      FROM a4 a JOIN u USING (r, part) GROUP BY a.part, a.entry, u.pos) GROUP BY part, entry) n
              USING (part, entry)),
       a5 AS (SELECT r, part, entry, dist FROM (
                SELECT p.r, p.part, c.entry,
                       list_sum(list_transform(list_zip(p.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS dist,
                       row_number() OVER (PARTITION BY p.r, p.part
                         ORDER BY list_sum(list_transform(list_zip(p.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), c.entry) AS rn
                FROM p JOIN c4 c USING (part)) WHERE rn = 1),
       o AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error
             FROM a5 GROUP BY r),
       d AS (SELECT sha256(string_agg(CAST(val AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256
             FROM (SELECT part, entry, unnest(x) AS val, unnest(range(len(x))) AS pos FROM c4))
  SELECT k.vec_id, o.code, o.error, CAST(sum(o.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, d.codebooks_sha256
  FROM o JOIN k USING (r), d
"""


def op13_projection_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return projections.near_vectors(vectors)


QUERIES = {
    "op1_surrogates": (op1_surrogates, None),
    "op2_cuckoo_dedup": (op2_cuckoo_dedup, OP2_SQL),
    "op3_url_rules": (op3_url_rules, OP3_SQL),
    "op4_source_mix": (op4_source_mix, OP4_SQL),
    "op5_toxic_field": (op5_toxic_field, None),
    "op6_plane_files": (op6_plane_files, None),
    "op7_near_copies": (op7_near_copies, None),
    "op8_kneser_ney": (op8_kneser_ney, None),
    "op9_merge_automaton": (op9_merge_automaton, None),
    "op10_norm_buckets": (op10_norm_buckets, OP10_SQL),
    "op11_importance_resample": (op11_importance_resample, None),
    "op12_limb_codes": (op12_limb_codes, OP12_SQL),
    "op13_projection_collisions": (op13_projection_collisions, None),
}
