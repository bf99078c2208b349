import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vespertide.streaming.spacing import pointers, spaced_requests

BEGIN = datetime(2024, 1, 1)
SCHEMA = "user_id long, event_id long, ts timestamp_ntz"


def brute(rows, gap):
    last, out = {}, {}
    for user, event, ts in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
        out[event] = user not in last or (ts - last[user]).total_seconds() >= gap
        if out[event]:
            last[user] = ts
    return out | {e: False for _, e, ts in rows if ts is None}


def got(spark, rows, gap):
    log = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = spaced_requests(log, gap).collect()
    assert len(out) == len(rows)
    return {r["event_id"]: r["accepted"] for r in out}


@pytest.mark.parametrize("gap", [0.5, 40])
def test_equal_to_the_walk_with_one_user_of_most_rows(spark, many_parts, gap):
    rng = random.Random(gap)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), n, BEGIN + timedelta(seconds=rng.randrange(900), milliseconds=rng.choice([0, 0, 500]))) for n in range(700)]
    rows += [(4, 1000, None), (4, 1001, BEGIN), (None, 1002, None)]
    assert got(spark, rows, gap) == brute(rows, gap)


def test_bursts_and_pauses(spark):
    rows = [(7, n, BEGIN + timedelta(seconds=at)) for n, at in enumerate([0, 0, 0, 2, 3, 3, 5, 6, 100, 101, 102, 103, 500, 503, 506, 509])]
    rows += [(8, 100, BEGIN), (9, 101, BEGIN - timedelta(days=20_000))]
    assert got(spark, rows, 3) == brute(rows, 3)


def test_chains_over_many_parts(spark, many_parts):
    """Every request is accepted, so the chain goes through all parts."""
    rows = [(1, n, BEGIN + timedelta(seconds=3 * n)) for n in range(300)]
    assert all(got(spark, rows, 3).values())
    assert got(spark, rows, 7) == brute(rows, 7)


def test_a_user_of_most_rows_is_spread(spark, many_parts):
    times = spark.range(8_000).select(F.when(F.col("id") % 20 == 0, F.col("id")).otherwise(1).alias("user_id"), F.col("id").alias("t"))
    sizes = [r["count"] for r in pointers(times, 5).where("user_id = 1").groupBy("part").count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 2 * sum(sizes) / 13


def test_no_requests_and_no_gap(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert spaced_requests(none, 3).count() == 0
    with pytest.raises(ValueError):
        spaced_requests(none, 0)


def test_many_users_of_a_part_are_handled_at_once(spark, monkeypatch):
    """A call of a function on pandas for every user made a log of many users slow; a part is one call."""
    from vespertide.streaming import spacing

    rng = np.random.default_rng(8)
    rows = pd.DataFrame({"user_id": np.repeat(np.arange(-200, 200), 5), "part": 3})
    rows["t"] = np.concatenate([np.sort(rng.choice(60, 5, replace=False)) for _ in range(400)])
    gap = 13
    for user, own in rows.groupby("user_id"):
        later = np.searchsorted(own["t"].to_numpy(), own["t"].to_numpy() + gap)
        rows.loc[own.index, "to_part"] = np.where(later < 5, 3, np.where(user % 2, 4, -1))
        rows.loc[own.index, "to_t"] = np.where(later < 5, own["t"].to_numpy()[np.minimum(later, 4)], np.where(user % 2, 1000, 0))
    rows = rows.astype({"to_part": int, "to_t": int}).sample(frac=1, random_state=1)
    left = spacing.transitions(rows)
    assert len(left) == len(rows) and (left["to_part"] == np.where(left["user_id"] % 2, 4, -1)).all()
    entered = rows.groupby("user_id", as_index=False)["t"].min()
    got = {tuple(r) for r in spacing.chains(entered, rows)[["user_id", "t"]].to_numpy()}
    want = set()
    for user, own in rows.groupby("user_id"):
        last = None
        for t in sorted(own["t"]):
            if last is None or t - last >= gap:
                want.add((user, t))
                last = t
    assert got == want
