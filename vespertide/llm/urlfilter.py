"""URL rules by host-suffix and path-prefix expressions.

A rule is a host and a path. It fits a URL of that host or of a subdomain of it whose path starts with the
rule's. Every URL is expanded into the expressions a rule could have: suffixes of its host by the prefixes
of its path that end where some rule's path could end. Expressions meet rules by the first eight hex digits
of their digests, whole digests confirm, and of the rules that fit the longest wins (ties: the one of the
longer host, then block).

The expansion of a URL is bounded by the longest host and path among the rules, which are read first, and
leaves out nothing that a rule could fit. Copies of a URL are expanded once. Rules are broadcast if a count
shows that they are few; beyond that, the join is dealt by the short prefix and frequent expressions in shards.

Cases: a null URL, or one without "://", has an empty host and path, which no rule with a host fits. Repeated
rows are judged each for itself. Rules with a null host, path or
verdict fit nothing. Columns of the table stay as they are; those named like a result are replaced. No rules: every
URL gets the verdict for none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vespertide.llm.common import ascii_lower, discard, materialize, read_table, hot_join

#: Hex digits of a digest that the join is on, and rules up to which they are broadcast (about 100 bytes each).
SHORT_DIGITS = 8
BROADCAST_RULES = 500_000

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty without "://"."""
    there = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(there > 0, F.substr(url, there + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def tail_length(path: Column) -> Column:
    """Characters behind the last slash."""
    return F.length(F.regexp_extract(path, r"[^/]*\z", 0))


def rule_rows(rules: DataFrame) -> DataFrame:
    """(short, digest, rule, verdict, rank): each host and path once, blocked if any of its rows says so. rules: (host, path, verdict)."""
    known = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(ascii_lower(F.col("host")).alias("h"), "path", "verdict")
    once = known.groupBy("h", "path").agg(F.max("verdict").alias("verdict"))
    full = once.withColumn("digest", digest(F.col("h"), F.col("path")))
    return full.select(
        F.substring("digest", 1, SHORT_DIGITS).alias("short"), "digest", F.concat("h", "path").alias("rule"), "verdict",
        F.length("h").alias("host_length"), F.length(F.concat("h", "path")).alias("rule_length"), F.length("path").alias("path_length"), F.size(F.split("h", r"\.")).alias("labels"), tail_length(F.col("path")).alias("tail"),
    )


def host_suffixes(host: Column, labels: int) -> Column:
    """The host and what stands behind each of its dots, of at most so many labels."""
    parts = F.split(host, r"\.")
    n = F.least(F.size(parts), F.lit(labels))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, -i, i), "."))


def path_prefixes(path: Column, longest: int, tails: list[int]) -> Column:
    """Prefixes of the path that end `tails` characters behind a slash or the beginning, with no slash between, up to a length."""
    ends = F.least(F.length(path), F.lit(longest))
    slashes = F.when(ends > 0, F.filter(F.sequence(F.lit(1), ends), lambda i: F.substr(path, i, F.lit(1)) == "/")).otherwise(F.array().cast("array<int>"))
    begins = F.concat(F.array(F.lit(0)), slashes)

    def ended(t: int) -> Column:
        fits = F.filter(begins, lambda s: (s + t <= ends) & ~F.contains(F.substr(path, s + 1, F.lit(t)), F.lit("/")))
        return F.transform(fits, lambda s: F.substr(path, F.lit(1), s + t))

    return F.flatten(F.array(*map(ended, tails)))


def judged(pages: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """pages with host, path, rule (host and path of the one that decides, or null) and verdict. rules: (host, path, verdict "allow" or "block")."""
    known = materialize(rule_rows(rules), "url-rules")
    most = known.agg(F.count("*").alias("n"), F.max("labels").alias("labels"), F.max("path_length").alias("longest"), F.array_sort(F.collect_set("tail")).alias("tails")).first()
    host, path = host_and_path(F.col(url_col))
    rows = pages.withColumns({"host": host, "path": path}).drop("rule", "verdict")
    if not most["n"]:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)})
    # A verdict is one of host and path, so copies are expanded once.
    urls = rows.select("host", "path").where("host <> ''").distinct()
    sides = urls.withColumn("__vt_suffix", F.explode(host_suffixes(F.col("host"), most["labels"])))
    each = sides.withColumn("__vt_prefix", F.explode(path_prefixes(F.col("path"), most["longest"], most["tails"])))
    said = each.select("host", "path", digest(F.col("__vt_suffix"), F.col("__vt_prefix")).alias("asked")).withColumn("short", F.substring("asked", 1, SHORT_DIGITS))
    rank = F.struct("rule_length", "host_length", F.col("verdict").alias("v"))
    if most["n"] <= BROADCAST_RULES:
        met = said.join(F.broadcast(known), "short").where(F.col("asked") == F.col("digest"))
    else:
        packed = known.groupBy("short").agg(F.collect_list(F.struct("digest", "rule", "verdict", "rule_length", "host_length")).alias("rules"))
        met = hot_join(said, packed, "short").select("host", "path", "asked", F.inline("rules")).where(F.col("asked") == F.col("digest"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best"))
    best = materialize(best.select(F.to_json(F.struct("host", "path")).alias("__vt_url"), "best.rule", "best.verdict"), "url-verdicts")
    discard(known)
    out = hot_join(rows.withColumn("__vt_url", F.to_json(F.struct("host", "path"))), best, "__vt_url", "left").drop("__vt_url")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(otherwise)))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judged(read_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

OP12_SQL = f"""
WITH cut AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT n, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
urls AS (SELECT n, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
rules(h, p, v) AS (VALUES {_VALUES}),
best AS (
  SELECT n, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
  FROM urls JOIN rules ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN best USING (n)
"""
