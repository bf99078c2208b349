import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vespertide.operators.store import within_ttl
from vespertide.streaming.profiles import STORE, cached_profiles

SCHEMA = "user long, event_id long, ts timestamp, kind string, profile string"
BEGIN = datetime(2024, 1, 1)
TTL = 100


@pytest.fixture
def run(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    # A state that may expire asks for batch after batch, so a run over what is there would not end.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")

    def once(ttl_s=TTL, lag_s=3600):
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        q = cached_profiles(stream, ttl_s, lag_s).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return {r["event_id"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    def feed(*events):
        rows = [(u, n, BEGIN + timedelta(seconds=at), kind, p) for u, n, at, kind, p in events]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    yield feed, once
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_expired_and_renewed_profiles_equal_the_batch_predicate(spark, run, tmp_path):
    feed, once = run
    feed((1, 1, 0, "put", "a"), (1, 2, 50, "ask", None), (2, 3, 0, "ask", None), (3, 4, 0, "put", "c"))
    once()
    feed((1, 5, 101, "ask", None), (3, 6, 100, "ask", None), (3, 7, 101, "ask", None), (1, 8, 102, "put", "b"), (1, 9, 150, "ask", None))
    got = once()
    feed((1, 10, 202, "ask", None), (1, 11, 203, "ask", None), (1, 12, 203, "put", "d"), (1, 13, 204, "ask", None))
    got = once()
    events = spark.read.parquet(f"{tmp_path}/in")
    asked = events.where("kind = 'ask'").alias("a")
    put = events.where("kind = 'put'").select("user", F.col("ts").alias("fetched_at"), F.col("event_id").alias("put_id"), F.col("profile").alias("was"))
    before = asked.join(put, "user").where("(fetched_at, put_id) < (ts, event_id)")
    last = before.groupBy("user", "event_id", "ts").agg(F.max_by(F.struct("fetched_at", "was"), F.struct("fetched_at", "put_id")).alias("l")).select("user", "event_id", "ts", "l.*")
    want = {r["event_id"]: (r["age_s"], r["was"]) for r in within_ttl(last, F.col("ts"), TTL).collect()}
    assert {n: (r["age_s"], r["profile"]) for n, r in got.items() if r["hit"]} == want
    assert len(got) == asked.count() and {n for n, r in got.items() if not r["hit"]} == {3, 5, 7, 11}


def test_users_who_stay_away_are_forgotten(run):
    """The state's own time to live runs by the clock, whatever the times of the events are."""
    feed, once = run
    feed((1, 1, 0, "put", "a"), (2, 2, 0, "put", "b"))
    once(ttl_s=1, lag_s=1)
    time.sleep(2.5)
    feed((1, 3, 0, "ask", None), (2, 4, 0, "put", "c"), (2, 5, 1, "ask", None))
    got = once(ttl_s=1, lag_s=1)
    assert not got[3]["hit"] and (got[5]["hit"], got[5]["profile"]) == (True, "c")
