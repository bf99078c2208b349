"""Keyed store: lookups, versions, last write wins, caches that know misses, and time to live."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vespertide.functions import text as T
from vespertide.operators.common import first_seen, latest, literal_rows, small
from vespertide.settings import DEFAULTS


def is_current(version: int = DEFAULTS.feature_version) -> Column:
    return F.col("_v").eqNullSafe(F.lit(version))


def stale(records: DataFrame, version: int = DEFAULTS.feature_version) -> DataFrame:
    return records.where(~is_current(version))


def lookup(records: DataFrame, key, column: str = "id") -> DataFrame:
    return records.where(F.col(column) == F.lit(key))


def lookup_many(records: DataFrame, keys: list, column: str = "id") -> DataFrame:
    """Current records of the keys, in the order they were first asked for; what is missing drops out."""
    asked = literal_rows(records.sparkSession, [(k, i) for i, k in enumerate(keys)], f"{column} long, position int")
    wanted = first_seen(asked, column, "position")
    return records.where(is_current()).join(F.broadcast(wanted), column)


def not_stored(asked: DataFrame, records: DataFrame, column: str = "id", refresh: bool = False) -> DataFrame:
    """Keys to fetch, each once: those that no current record has, or all of them to refresh what is stored."""
    wanted = asked.select(column).distinct()
    return wanted if refresh else wanted.join(records.where(is_current()).select(column), column, "left_anti")


def filled(asked: DataFrame, records: DataFrame, fetch: Callable[[DataFrame], DataFrame], column: str = "id", refresh: bool = False) -> DataFrame:
    """Current records of the asked keys, in the order they were first asked for: stored ones, and what fetch(keys) gives for the others.

    asked: (column, position). What can't be fetched drops out; a fetched record stands before a stored one of its key.
    """
    wanted = first_seen(asked, column, "position")
    new = fetch(not_stored(asked, records, column, refresh))
    stored = records.where(is_current()).join(new.select(column), column, "left_anti")
    return stored.unionByName(new.select(*records.columns)).join(small(wanted), column)


def upsert(log: DataFrame, keys: list[str], values: list[str], *order: str) -> DataFrame:
    return latest(log, keys, values, *order)


def cached_search(requests: DataFrame, searches: DataFrame, version: int = DEFAULTS.search_version) -> DataFrame:
    """(hit, item_id) of each request: a stored miss is a hit without an id, which is not the same as no row."""
    key = [T.title_key(F.col("query")).alias("query_key"), F.coalesce("year", F.lit("")).alias("year_key")]
    # A search that was stored again counts as it was stored last, or by the smallest id where no time is kept.
    when = F.col("searched_at") if "searched_at" in searches.columns else F.lit(0)
    said = searches.where(F.col("_v") == version).select(*key, "item_id", F.struct(when.alias("at"), (-F.col("item_id")).alias("least")).alias("__at"))
    known = said.groupBy("query_key", "year_key").agg(F.max_by(F.struct("item_id"), "__at").alias("r")).select("query_key", "year_key", "r.item_id", F.lit(True).alias("hit"))
    return requests.select("*", *key).join(small(known), ["query_key", "year_key"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def within_ttl(rows: DataFrame, now: Column, ttl_s: int = DEFAULTS.profile_ttl_s, at: str = "fetched_at") -> DataFrame:
    """Rows not older than ttl_s, with their age in seconds."""
    age = F.timestamp_diff("SECOND", F.col(at), now) if hasattr(F, "timestamp_diff") else F.unix_timestamp(now) - F.unix_timestamp(F.col(at))
    return rows.withColumn("age_s", age.cast("long")).where(F.col("age_s") <= ttl_s)


def ordered_union(parts: list[DataFrame], key: str, limit: int) -> DataFrame:
    """First occurrences over several sources, those of an earlier source first, up to a limit."""
    marked = [p.select(key, F.lit(n).alias("source_no"), "position") for n, p in enumerate(parts)]
    every = marked[0]
    for p in marked[1:]:
        every = every.unionByName(p)
    first = every.groupBy(key).agg(F.min(F.struct("source_no", "position")).alias("at"))
    return first.orderBy("at", key).limit(limit)
