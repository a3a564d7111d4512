"""URL rules by hashed expressions.

A rule is (host, path, verdict). It fits its host and all subdomains if the url's path starts with the rule's path; the
longest rule (host and path together) wins, then the longer host, then a block before an allow.

Every distinct (host, path) is expanded into host suffixes and path prefixes, of no other lengths than some rule
has; an expression ``host/path`` is joined with the rules on the first bytes of its SHA-256, then the whole digest and the
expression itself must agree. Distinct pairs come first, so that a hot url is judged once. Rules are broadcast only
up to ``BROADCAST_RULES`` of them; more are joined by a shuffle, which adaptive execution may split.

The numbers of labels and the path lengths of the rules are literals of the plan, one array each.

Defined results: a null url, or one without ``://``, has an empty host and path and gets the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

#: Hex digits of the short hash (four bytes).
PREFIX = 8
#: Rules (at most some hundred bytes each) that may be broadcast: some tens of MB at the most.
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Array of {host, path}: the host's suffixes of so many labels, with the path's prefixes of so many characters."""
    parts = F.split(host, r"\.")
    hosts = F.transform(F.filter(F.lit(labels), lambda n: F.size(parts) >= n), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    paths = F.transform(F.filter(F.lit(lengths), lambda n: F.length(path) >= n), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(h.alias("host"), p.alias("path")))))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict (columns of these names are replaced)."""
    rules = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    shape = rules.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    table = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"), _digest(F.col("host"), F.col("path")).alias("r_digest")).withColumn("short", F.substring("r_digest", 1, PREFIX))
    table = F.broadcast(table) if shape["n"] <= BROADCAST_RULES else table
    seen = pages.withColumns({"host": F.coalesce(url_host(F.col(url)), F.lit("")), "path": F.coalesce(url_path(F.col(url)), F.lit(""))})
    if not shape["n"]:
        return seen.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    pairs = seen.select("host", "path").distinct()
    spread = pairs.withColumn("e", F.explode(expressions(F.col("host"), F.col("path"), sorted(shape["labels"]), sorted(shape["lengths"]))))
    spread = spread.withColumn("digest", _digest(F.col("e.host"), F.col("e.path"))).withColumn("short", F.substring("digest", 1, PREFIX))
    sure = (F.col("digest") == F.col("r_digest")) & (F.col("e.host") == F.col("r_host")) & (F.col("e.path") == F.col("r_path"))
    size = F.struct((F.length("r_host") + F.length("r_path")).alias("all"), F.length("r_host").alias("host"), F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule"))
    found = spread.join(table, "short").where(sure).groupBy("host", "path").agg(F.max(size).alias("best"))
    f_host, f_path = fresh(seen, "host"), fresh(seen, "path")
    found = found.select(F.col("host").alias(f_host), F.col("path").alias(f_path), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    out = seen.drop("rule", "verdict").join(found, (F.col("host") == F.col(f_host)) & (F.col("path") == F.col(f_path)), "left").drop(f_host, f_path)
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
