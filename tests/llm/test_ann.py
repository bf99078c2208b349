import numpy as np
from pyspark.sql import functions as F

from vespertide.llm import ann
from vespertide.llm.ann import nearest, op10_ann


def is_query():
    return F.pmod(F.col("id"), F.lit(10)) == 0


def brute(rows, k, step):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for i, v in rows:
        if i % step == 0:
            d = np.sqrt(((x - np.asarray(v, np.float64)) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_recall_against_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(rows, 10, 100)
    got = {}
    for r in op10_ann(spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and all(len(g) == 10 for g in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert recall >= 0.9, recall


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(60)]
    rows += [(i, [1.0] * 8) for i in range(100, 140)]
    odd = [(200, None), (210, [0.0] * 8), (220, [float("nan")] + [1.0] * 7), (230, [None] + [1.0] * 7), (240, [float("inf")] * 8), (None, [1.0] * 8), (250, [1.0]), (260, [])]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows + odd], "vec_id long, embedding array<double>, score double, rank int")
    want = brute(rows, 10, 10)
    got = {}
    for r in nearest(df, "vec_id", "embedding", is_query(), certainty=0.9999).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]])
    few = nearest(df.where("vec_id < 5"), "vec_id", "embedding", is_query())
    assert few.count() == 4
    assert nearest(df.limit(0), "vec_id", "embedding", is_query()).count() == 0


def test_recall_over_many_leaves_and_shards(spark, monkeypatch):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    # A vector that a third of the rows share, so its class, its leaf and its queries are hot.
    rows += [(i, rows[0][1]) for i in range(10_000, 11_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 10, 10)
    for leaf_rows, in_leaf, block in ((128, 8, 20_000), (100, 400, 20_000), (128, 8, 3)):
        monkeypatch.setattr(ann, "LEAF_ROWS", leaf_rows)
        monkeypatch.setattr(ann, "QUERY_BLOCK", block)
        monkeypatch.setattr(ann, "SAMPLE_IN_LEAF", in_leaf)
        got = {}
        for r in nearest(df, "vec_id", "embedding", is_query()).collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got.keys() == want.keys() and all(len(g) == 10 for g in got.values())
        assert all(sorted(got[q]) == sorted(i for i, _ in want[q]) for q in want if q >= 10_000)
        recall = np.mean([len(set(got[q]) & {i for i, _ in want[q]}) / 10 for q in want if 0 < q < 10_000])
        assert recall >= 0.9, (leaf_rows, recall)


def test_search_stops_early_and_breaks_ties_by_row():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16)) * 20
    x = np.concatenate([centres[i % 40] + rng.standard_normal((1, 16)) for i in range(4_000)])
    x[100:120] = x[100]
    project = ann.directions(16, 6)
    close, verified = ann.closest_rows(x, x @ project, x[:200], x[:200] @ project, np.full(200, np.inf), 11, ann.chi_quantile(0.95, 6))
    true = np.argsort(((x[:200, None] - x[None]) ** 2).sum(axis=2), axis=1, kind="stable")[:, :11]
    assert list(close[100]) == list(range(100, 111))
    assert np.mean([len(set(a) & set(b)) / 11 for a, b in zip(close, true)]) >= 0.9
    # Clustered data is pruned: a query sees little beyond its own cluster of 100 rows.
    assert verified.mean() < 0.2 * len(x)
