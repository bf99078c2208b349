import math
from statistics import median

import pytest

from vespertide.operators import evaluate

GRID = {0: {"genres": 1, "keywords": 2, "overview": 1}, 1: {"genres": 3, "keywords": 0, "overview": 1}, 2: {"genres": 0, "keywords": 1, "overview": 0}}
LIKED = [(3, 5.0), (8, 4.0), (11, 2.0), (14, 4.5), (99, 4.0)]


def item(i):
    """Items of eight terms and more; some terms stand in two fields, and some in one item alone."""
    overview = [f"word{(i * k) % 13}" for k in range(1, 9)] + [f"alone{i}"]
    return (i, [f"genre{i % 3}"], "", [], [overview[0], f"key{i % 4}", f"key{i % 4}"], [], [f"genre{i % 2}", *overview, *(f"more{i}{k}" for k in range(9))], "", "")


def refitted(rows, weights):
    """Ranks of the folds, each fitted anew."""
    tf = {}
    for i, genres, _, _, keywords, _, overview, _, _ in rows:
        for field, values in (("genres", genres), ("keywords", keywords), ("overview", overview)):
            for v in values:
                if weights[field]:
                    tf[i, v] = tf.get((i, v), 0) + weights[field]
    docs = len({i for i, _ in tf})
    df = {}
    for _, t in tf:
        df[t] = df.get(t, 0) + 1
    vectors = {}
    for (i, t), n in tf.items():
        if df[t] >= 2:
            vectors.setdefault(i, {})[t] = (1 + math.log(n)) * (math.log((1 + docs) / (1 + df[t])) + 1)
    unit = {i: {t: w / math.sqrt(sum(x * x for x in v.values())) for t, w in v.items()} for i, v in vectors.items()}
    dot = lambda a, b: sum(w * b.get(t, 0.0) for t, w in a.items())
    members = {i: max(r - 2.5, 0.1) for i, r in LIKED if i in unit}
    ranks = []
    for hidden in members:
        query = {}
        for m, lw in members.items():
            if m != hidden:
                for t, w in unit[m].items():
                    query[t] = query.get(t, 0.0) + lw * w
        length = math.sqrt(dot(query, query))
        score = {i: round(dot(query, v) / length, 9) for i, v in unit.items() if i == hidden or i not in dict(LIKED)}
        ranks.append(1 + sum((-s, i) < (-score[hidden], hidden) for i, s in score.items()))
    return ranks


@pytest.mark.parametrize("batch", [3, 10_000])
def test_tune_equals_refitting_every_fold(spark, monkeypatch, batch):
    written, kept = [], evaluate.kept
    monkeypatch.setattr(evaluate, "kept", lambda df: written.append(df.dtypes) or kept(df))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = [item(i) for i in range(30)]
        items = spark.createDataFrame(rows, "id long, genres array<string>, director string, cast array<string>, keywords array<string>, writers array<string>, overview_terms array<string>, collection string, decade string")
        items = items.selectExpr("*", "array() AS directors")
        liked = spark.createDataFrame(LIKED, "seed long, rating double")
        grid = spark.createDataFrame([(c, f, w) for c, fields in GRID.items() for f, w in fields.items()], "config int, field string, weight int")
        got = {r["config"]: r for r in evaluate.tune(items, liked, grid).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(GRID)
    for config, weights in GRID.items():
        ranks = refitted(rows, weights)
        assert (got[config]["n"], got[config]["median_rank"]) == (len(ranks), median(ranks))
        assert got[config]["mrr"] == pytest.approx(sum(1 / r for r in ranks) / len(ranks), abs=1e-4)
    # What is written is no wider for more configurations.
    assert written and all("array" not in t for dtypes in written for _, t in dtypes)
