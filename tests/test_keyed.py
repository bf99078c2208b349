import pytest
from pyspark.sql import functions as F

from vespertide.operators.keyed import Conflict, KeyedTable

SCHEMA = "user long, item long, verdict int, ts long"


@pytest.fixture
def table(spark, tmp_path):
    return lambda: KeyedTable(spark, f"file://{tmp_path}/votes", ["user", "item"], ["verdict"], ["ts"], SCHEMA, buckets=8)


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def state(df):
    got = df.collect()
    assert len({(r["user"], r["item"]) for r in got}) == len(got)
    return {(r["user"], r["item"]): r["verdict"] for r in got}


def test_last_write_wins_over_batches(spark, table):
    t = table()
    assert state(t.read()) == {}
    assert t.upsert(rows(spark, (1, 1, 1, 10), (1, 1, -1, 20), (2, 5, 1, 10), (None, 3, 1, 5))) == 1
    assert t.upsert(rows(spark, (1, 1, 7, 15), (2, 5, 2, 10), (3, 3, 3, 1))) == 2
    # 15 is older than 20; of equal times the later batch counts.
    assert state(table().read()) == {(1, 1): -1, (2, 5): 2, (3, 3): 3, (None, 3): 1}
    assert state(t.read(back=1)) == {(1, 1): -1, (2, 5): 1, (None, 3): 1}


def test_only_touched_buckets_are_rewritten(spark, table):
    t = table()
    t.upsert(spark.range(200).select(F.col("id").alias("user"), F.lit(1).cast("long").alias("item"), F.lit(1).alias("verdict"), F.lit(1).cast("long").alias("ts")))
    before = t.manifest()["buckets"]
    t.upsert(rows(spark, (5, 1, 9, 2)))
    after = t.manifest()["buckets"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert t.read().count() == 200 and state(t.read())[5, 1] == 9
    asked = rows(spark, (5, 1, 0, 0), (999, 1, 0, 0))
    assert state(t.lookup(asked)) == {(5, 1): 9}
    assert len(t.lookup(asked.limit(1)).inputFiles()) == 1


def test_replayed_batches_change_nothing(spark, table):
    t = table()
    t.upsert(rows(spark, (1, 1, 1, 10)), "votes", 0)
    t.upsert(rows(spark, (1, 1, 2, 20)), "votes", 1)
    assert t.upsert(rows(spark, (1, 1, 99, 99)), "votes", 1) == 2
    assert t.upsert(rows(spark, (1, 1, 98, 98)), "votes", 0) == 2
    assert t.upsert(rows(spark, (1, 1, 3, 30)), "others", 0) == 3
    assert state(t.read()) == {(1, 1): 3}


def test_a_reader_sees_old_or_new(spark, table, monkeypatch):
    """A writer that dies before the switch leaves the table as it was; one that comes second is told so."""
    t = table()
    t.upsert(rows(spark, (1, 1, 1, 10)))
    reader = t.read()
    monkeypatch.setattr(t, "_switch", lambda state: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        t.upsert(rows(spark, (1, 1, 2, 20)))
    monkeypatch.undo()
    assert state(table().read()) == {(1, 1): 1}
    seen = t.manifest()
    table().upsert(rows(spark, (1, 1, 3, 30)))
    assert state(reader) == {(1, 1): 1} and state(table().read()) == {(1, 1): 3}
    with pytest.raises(Conflict):
        t._switch(seen | {"version": seen["version"] + 1})


def test_vacuum_keeps_what_recent_states_name(spark, table):
    t = table()
    for n in range(4):
        t.upsert(rows(spark, (1, 1, n, n)))
    assert t.vacuum(keep=2) == 2
    assert state(t.read()) == {(1, 1): 3} and state(t.read(back=1)) == {(1, 1): 2}
    assert len(t._manifests()) == 2
    t.upsert(rows(spark, (2, 2, 5, 5)))
    assert state(t.read()) == {(1, 1): 3, (2, 2): 5}


def test_lost_tasks_are_run_again(spark, table):
    """A partition that fails once: the batch is written whole and once. Local masters run a task once, so the job is run again by its caller."""
    t = table()
    t.upsert(rows(spark, (1, 1, 1, 1)))
    broken = spark.range(8).select(F.col("id").alias("user"), F.lit(1).cast("long").alias("item"), F.when(F.col("id") == 7, F.raise_error(F.lit("gone")).cast("int")).otherwise(5).alias("verdict"), F.lit(9).cast("long").alias("ts"))
    with pytest.raises(Exception):
        t.upsert(broken, "s", 0)
    assert state(table().read()) == {(1, 1): 1}
    whole = broken.withColumn("verdict", F.lit(5))
    t.upsert(whole, "s", 0)
    assert state(t.read()) == {(u, 1): 5 for u in range(8)}


def test_fed_by_a_stream_that_is_started_again(spark, table, tmp_path):
    source, checkpoint = f"{tmp_path}/in", f"{tmp_path}/ck"

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        stream.writeStream.foreachBatch(table().sink("votes")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    rows(spark, (1, 1, 1, 10), (2, 2, 1, 10)).write.mode("append").parquet(source)
    run()
    rows(spark, (1, 1, -1, 20)).write.mode("append").parquet(source)
    run()
    run()
    assert state(table().read()) == {(1, 1): -1, (2, 2): 1}
    assert table().manifest()["batches"] == {"votes": 1}


def test_another_number_of_buckets_is_refused(spark, table, tmp_path):
    table().upsert(rows(spark, (1, 1, 1, 1)))
    with pytest.raises(ValueError):
        KeyedTable(spark, f"file://{tmp_path}/votes", ["user", "item"], ["verdict"], ["ts"], SCHEMA, buckets=4).read()
