import random

import pytest
from pyspark.sql import functions as F

from vespertide.operators.common import first_numbered
from vespertide.operators.ranks import dealt, ranked


def brute(rows, ties):
    out = {}
    for case in {c for c, _, _ in rows}:
        of = sorted([(-s, i) for c, i, s in rows if c == case])
        for place, (s, i) in enumerate(of, 1):
            out[case, i] = place if ties else 1 + sum(x < s for x, _ in of)
    return out


@pytest.mark.parametrize("ties", [True, False])
@pytest.mark.parametrize("spread", [1, 40])
def test_ranks_equal_brute_force(spark, many_parts, ties, spread):
    rng = random.Random(spread)
    rows = [(case, i, float(rng.randrange(spread) if rng.random() < 0.1 else 0)) for case in (1, 2) for i in range(600)] + [(3, 0, 1.0)]
    scores = spark.createDataFrame(rows, "case int, id int, s double").repartition(3)
    got = {(r["case"], r["id"]): r["rank"] for r in ranked(scores, ["case"], ties).collect()}
    assert got == brute(rows, ties)


def test_no_rows(spark):
    assert ranked(spark.createDataFrame([], "case int, id int, s double"), ["case"], ties=False).count() == 0


def test_equal_scores_are_cut_into_parts(spark, many_parts):
    """99 of 100 scores are 0: no part has much more than its share."""
    scores = spark.range(20_000).select(F.lit(1).alias("case"), "id", F.when(F.col("id") % 100 == 0, F.rand(3)).otherwise(0.0).alias("s"))
    sizes = [r["count"] for r in dealt(scores, F.col("case"), F.desc("s"), F.col("id")).groupBy("__part").count().collect()]
    assert len(sizes) == 13 and max(sizes) < 1.5 * 20_000 / 13


def test_first_rows_of_a_group_of_most_rows(spark):
    rng = random.Random(11)
    rows = [(1 if rng.random() < 0.9 else rng.randrange(2, 6), i, rng.randrange(50)) for i in range(3_000)]
    df = spark.createDataFrame(rows, "g int, id int, s int")
    got = {(r["g"], r["place"]): r["id"] for r in first_numbered(df, ["g"], 7, F.desc("s"), F.col("id")).collect()}
    want = {(g, n): i for g in range(1, 6) for n, (_, i) in enumerate(sorted((-s, i) for h, i, s in rows if h == g)[:7], 1)}
    assert got == want
