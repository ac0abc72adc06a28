"""URL rules found by their rarest token, so that a URL meets only rules that can fit it.

A pattern is matched against host and path together. ``||`` at its start means the start of the
host or of one of its labels; ``*`` is any run of signs; everything else is literal, and the match
may go on behind the pattern. The literal tokens of a pattern are its runs of ``[a-z0-9]`` that a
fitting URL must hold as whole tokens. Each rule stands in the index under the one of them that the
given URLs hold least often. A URL fetches the rules of its own tokens; only those are run as regular
expressions. Rules without such a token stand under the empty token, which every URL has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qalink.operators.joins import lookup_join

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def compile_pattern(pattern: str) -> tuple[str, list[str]]:
    """Regular expression and whole literal tokens of a pattern."""
    anchored = pattern.startswith("||")
    body = pattern[2:] if anchored else pattern
    expression = "(?s)" + (r"^(?:[^/]*\.)?" if anchored else "")
    pieces = re.split(r"\*+", body)
    expression += ".*".join(re.escape(p) for p in pieces)
    tokens = set()
    for i, piece in enumerate(pieces):
        for found in re.finditer("[a-z0-9]+", piece.translate(str.maketrans(_UPPER, _LOWER))):
            begins = found.start() > 0 or (i == 0 and anchored)
            if begins and found.end() < len(piece):  # what follows a pattern may lengthen its last token
                tokens.add(found.group())
    return expression, sorted(tokens)


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null and for what has no ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, parts, 1), F.lit(""))
    return lowered(host), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def _tokens(subject: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lowered(subject), F.lit("([a-z0-9]+)"), F.lit(1)))


def rule_index(rules: DataFrame, subjects: DataFrame) -> DataFrame:
    """``rule, verdict, tier, pattern, size, expression, token`` for ``rules(rule, verdict, tier, pattern)``.

    ``subjects(subject)`` are the URLs whose token counts decide which token is the rarest; equal
    counts go to the smaller token. Rules whose pattern or verdict is null or empty never fit.
    """

    def compiled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [compile_pattern(p) for p in frame["pattern"]]
            yield frame.assign(expression=[d[0] for d in done], tokens=[d[1] or [""] for d in done])

    given = rules.where("pattern <> '' and verdict <> ''").select("rule", "verdict", "tier", "pattern")
    ready = given.mapInPandas(
        compiled, "rule string, verdict string, tier int, pattern string, expression string, tokens array<string>"
    )
    each = ready.withColumn("token", F.explode("tokens"))
    wanted = each.select("token").distinct()
    seen = subjects.select(F.explode(_tokens(F.col("subject"))).alias("token"))
    counts = lookup_join(seen, wanted, ["token"], "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(counts, "token", "left").groupBy("rule", "verdict", "tier", "pattern", "expression").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token")
    )
    return rarest.withColumn("size", F.length("pattern"))


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``urls`` with ``host, path, rule, pattern, verdict``, one row per row of ``urls(url)``.

    Of the rules that fit, the highest ``tier`` wins, then the longest pattern, then the greater
    one in code-point order. ``rule`` and ``pattern`` are null and ``verdict`` is ``default`` where none fits. A null
    url, or one without ``://``, has an empty host and path, which only patterns that match the
    empty string fit. Columns of ``urls`` of those names are replaced; repeated rows are judged
    each. The rules are broadcast while they are small, and shuffled by token beyond that.
    """
    names = ("host", "path", "rule", "pattern", "verdict")
    kept = [c for c in urls.columns if c.lower() not in names]
    host, path = host_and_path(F.col("url"))
    rows = urls.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("given"),
        host.alias("host"),
        path.alias("path"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("subject", F.concat("host", "path"))
    index = rule_index(rules, rows.select("subject"))
    asked = rows.withColumn("token", F.explode(F.array_append(_tokens(F.col("subject")), F.lit(""))))
    met = lookup_join(asked, index, ["token"], "left", spread_by=["row"])
    fits = F.expr("expression is not null and subject rlike expression")  # only where the index gave a rule
    entry = F.when(fits, F.struct("tier", "size", "pattern", "rule", "verdict"))
    judged = met.groupBy("row", "given", "host", "path").agg(F.max(entry).alias("best"))
    return judged.select(
        "given.*",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.col("best.pattern").alias("pattern"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def rule_table(spark: SparkSession, rules: Sequence[tuple[str | None, str, int, str]]) -> DataFrame:
    """Rules ``(rule, verdict, tier, pattern)`` as a table."""
    return spark.createDataFrame(list(rules), "rule string, verdict string, tier int, pattern string")


def host_rules(rules: Sequence[tuple[str, str]], tier: int = 1) -> list[tuple[str, str, int, str]]:
    """Rules ``(verdict, 'host/path')`` that fit a host and its subdomains where the path begins so."""
    return [(rule, verdict, tier, f"||{rule}") for verdict, rule in rules]
