"""Filtering of URLs by host and path rules.

A URL is expanded into expressions: each suffix of its host that has as many labels as some rule's host, joined to each
prefix of its path whose length some rule's path has; hosts of any number of labels give equally many. Expressions and rules meet in an equi-join on the first 32 bits of their SHA-256
digest; the full digest confirms the hit, and of several rules the longest (then the one that sorts first) decides.
Every distinct (host, path) is judged once, so that a hot host or a repeated URL costs little; the join back to the
rows is a plain equi-join, which adaptive execution splits. The rules side is broadcast only if Spark finds it small.

Defined cases: a NULL url, or one without "://", has an empty host and path and is judged by the default verdict; no
rule has an empty host; the host keeps user names and ports as written, with A-Z lower-cased; repeated rows and NULL
page_ids are judged like others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
DEFAULT_VERDICT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def rule_table(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    spark = pages.sparkSession
    given = spark.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")
    digest = _digest(F.concat("rule_host", F.lit("\n"), "rule_path"))
    return given.select(
        F.concat("rule_host", "rule_path").alias("rule"),
        "rule_verdict",
        digest.alias("rule_digest"),
        _short(digest).alias("short"),
    )


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    default: str = DEFAULT_VERDICT,
    url: str = "url",
) -> DataFrame:
    """page_id, host, path, rule (NULL if none fits), verdict; one row per row of pages."""
    rows = pages.select("page_id", url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    if not rules:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    lengths = sorted({len(path) for _, path, _ in rules})
    depths = sorted({len(host.split(".")) for host, _, _ in rules})
    # A host of fewer labels is whole there, and no rule of that depth is equal to it.
    suffixes = F.array_distinct(F.array(*(F.substring_index("host", ".", -n) for n in depths)))
    prefixes = F.transform(
        F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    expressions = F.flatten(
        F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\n"), p)))
    )
    # Only URLs whose host has a name can fit a rule.
    asked = rows.select("host", "path").distinct().filter("host <> ''")
    hashed = asked.withColumn("expression", F.explode(expressions)).withColumn("digest", _digest(F.col("expression")))
    hit = hashed.withColumn("short", _short(F.col("digest"))).join(rule_table(pages, rules), "short")
    hit = hit.filter(F.col("digest") == F.col("rule_digest"))
    first = F.min(F.struct((-F.length("rule")).alias("longest"), F.col("rule"), F.col("rule_verdict")))
    judged = hit.groupBy("host", "path").agg(first.alias("best"))
    return rows.join(judged, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )
