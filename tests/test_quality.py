import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vespertide.operators import evaluate, profile, recommend, store
from vespertide.operators.blend import combined
from vespertide.operators.encode import Encoder, encoded, hashing, query_encoder
from vespertide.operators.signals import DenseSignal, SparseSignal, encoded_documents, graph_signal, profile_scores
from vespertide.sources.files import listed_prefix


def two_signals(spark, rng):
    """Named as the weights name them; the dense one covers the even items only, and neither covers the last five."""
    dense = [(i, rng.normal(size=4)) for i in range(0, 40, 2)]
    rows = spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist()) for i, v in dense], "id long, vec array<double>")
    sparse = []
    for i in range(35):
        terms = rng.choice(12, size=4, replace=False)
        w = rng.random(4) + 0.1
        sparse += [(i, f"t{t}", float(x)) for t, x in zip(terms, w / np.linalg.norm(w))]
    weights = spark.createDataFrame(sparse, "id long, term string, w double")
    return [SparseSignal("metadata", weights, weights.select("id").distinct()), DenseSignal("semantic", rows)]


def test_folds_of_a_blend_equal_refitting_every_fold(spark):
    rng = np.random.default_rng(7)
    signals = two_signals(spark, rng)
    items = spark.range(45).select("id")
    groups = {0: [(i, float(r)) for i, r in zip([0, 2, 4, 7, 9, 36, 44, 999], [5, 4, 1, 3.5, 2, 4.5, 5, 5])], 1: [(6, 5.0), (8, 4.0), (10, 0.5)], 2: [(1, 5.0), (3, 4.0), (999, 4.0)]}
    liked = spark.createDataFrame([(g, i, r) for g, rows in groups.items() for i, r in rows], "group int, seed long, rating double")
    got = {(r["group"], r["hidden"]): r["rank"] for r in evaluate.profile_fold_ranks(signals, items, liked).collect()}
    want = {}
    for g, rows in groups.items():
        known = [(i, r) for i, r in rows if i < 35 or (i < 40 and i % 2 == 0)]
        if len(known) < 3:
            continue
        for hidden, _ in known:
            others = spark.createDataFrame([x for x in known if x[0] != hidden], "seed long, rating double")
            parts = [(0.4, profile_scores(s, others)) for s in signals]
            scores = {r["id"]: round(r["s"], 9) for r in combined(parts).collect()}
            own, shown = scores.get(hidden, 0.0), {i for i, _ in known} - {hidden}
            want[g, hidden] = 1 + sum(scores.get(i, 0.0) > own for i in range(45) if i not in shown)
    assert got == want and len(want) == 9


def test_no_folds_where_too_few_are_known(spark):
    signals = two_signals(spark, np.random.default_rng(8))
    liked = spark.createDataFrame([(0, 1, 5.0), (0, 44, 4.0), (0, 999, 4.0)], "group int, seed long, rating double")
    assert evaluate.profile_fold_ranks(signals, spark.range(45), liked).count() == 0


DOCS = [(1, "The great journey of time, 2024"), (2, "water and light and WATER"), (3, None), (4, "  "), (5, "é ü !"), (6, "one"), (7, "a b c dd" * 300)]


def test_the_encoding_stage_equals_the_relational_form(spark):
    docs = spark.createDataFrame(DOCS, "id long, document string")
    rows = lambda df: {r["id"]: [round(x, 12) for x in r["vec"]] for r in df.collect()}
    want = rows(encoded_documents(docs, 32))
    assert rows(encoded(docs, hashing(32))) == rows(encoded(docs.repartition(3), hashing(32), batch=2)) == want
    assert set(want) == {1, 2, 6, 7}


def test_an_encoder_is_loaded_once_a_worker_and_gets_batches(spark):
    def load():
        import os

        calls = []

        def encode(texts):
            calls.append(len(texts))
            return np.array([[os.getpid(), len(calls), len(texts)] for _ in texts], dtype=float)

        return encode

    docs = spark.range(1000).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("document")).repartition(4)
    raw = Encoder("counting", load)
    seen = encoded(docs, raw, batch=50).select("vec").collect()
    # A unit vector keeps the ratio of calls to batch size: a model loaded anew would count from 1 in every task.
    assert len(seen) == 1000
    ratios = {(round(r["vec"][1] / r["vec"][0], 9)) for r in seen}
    assert len(ratios) >= 5


def test_free_text_is_encoded_as_documents_are(spark):
    encode = query_encoder(hashing(32))
    docs = spark.createDataFrame([(1, "dark water. light, time")], "id long, document string")
    assert np.allclose(encode("dark water", ["light", "time"]), encoded(docs, hashing(32)).first()["vec"])
    assert encode("  ", []) is None and encode("!", None) is None


def test_graph_factors_equal_a_dense_decomposition(spark):
    rng = random.Random(3)
    pairs = {(a, b) for a in range(30) for b in rng.sample(range(30), 4) if a != b}
    edges = spark.createDataFrame([(a, b, rng.randrange(20)) for a, b in sorted(pairs)], "src long, dst long, rank int")
    items = spark.range(32).select("id")
    signal = graph_signal(items, edges, factors=6)
    whole = graph_signal(items, edges)
    got = {r["id"]: np.array(r["vec"]) for r in signal.rows.collect()}
    m = np.eye(32)
    for r in edges.groupBy("src", "dst").agg(F.sum(1 / F.log2(F.col("rank") + 2)).alias("w")).collect():
        m[r["src"], r["dst"]] = max(m[r["src"], r["dst"]], r["w"])
        m[r["dst"], r["src"]] = max(m[r["dst"], r["src"]], r["w"])
    u, s, _ = np.linalg.svd(m)
    want = u[:, :6] * s[:6]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    ids = sorted(got)
    assert ids == sorted(r["id"] for r in whole.ids.collect()) and len(ids) == 30
    mine = np.array([got[i] for i in ids])
    # Single factors of a close spectrum may turn, so what two rows have in common is compared.
    assert np.abs(mine @ mine.T - want[ids] @ want[ids].T).max() < 0.02


@pytest.mark.parametrize("seed", [1, 2])
def test_prefixes_of_lists_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    pages, want = [], set()
    for name in range(60):
        last = rng.randrange(1, 8)
        there = [p for p in range(1, last + 1) if rng.random() < 0.95]
        own = {p: (rng.choice([200, 200, 200, 200, 500, None]), rng.choice([72, 72, 72, 80, 10, 0])) for p in there}
        pages += [(name, p, *own[p]) for p in there]
        for p in range(1, last + 1):
            if p not in own or own[p][0] != 200:
                break
            want.add((name, p))
            if own[p][1] < 72:
                break
    df = spark.createDataFrame(pages, "list int, page int, status int, films int")
    assert {(r["list"], r["page"]) for r in listed_prefix(df).collect()} == want
    assert listed_prefix(df.limit(0)).count() == 0


def test_missing_records_are_fetched_and_put_in_order(spark):
    records = spark.createDataFrame([(2, 1, "a"), (1, 2, "old"), (2, 3, "c")], "_v int, id long, title string")
    asked = spark.createDataFrame([(3, 0), (2, 1), (9, 2), (3, 3), (8, 4)], "id long, position int")
    fetched = []

    def fetch(keys):
        fetched.append({r["id"] for r in keys.collect()})
        return keys.where("id <> 8").select("id", F.lit("new").alias("title"), F.lit(2).alias("_v"))

    got = store.filled(asked, records, fetch).orderBy("position").collect()
    assert [(r["id"], r["title"]) for r in got] == [(3, "c"), (2, "new"), (9, "new")] and fetched[-1] == {2, 8, 9}
    assert {r["title"] for r in store.filled(asked, records, fetch, refresh=True).collect()} == {"new"} and fetched[-1] == {2, 3, 8, 9}


def test_asking_back(spark):
    asked = spark.createDataFrame([(1, 0, "Zorblax"), (2, 0, "Alien"), (2, 1, "Zorblax"), (3, 0, None), (4, 0, "x"), (4, 1, "y")], "request int, pos int, name string")
    found = spark.createDataFrame([(2, "ALIEN"), (1, "alien")], "request int, name string")
    got = {r["request"]: (r["action"], r["missing"]) for r in recommend.ask_or_proceed(asked, found).collect()}
    assert got == {1: ("ask", ["Zorblax"]), 2: ("proceed", ["Zorblax"]), 3: ("proceed", []), 4: ("ask", ["x", "y"])}


def test_a_profile_of_either_half(spark):
    half = "user long, kind string, item long, title string, year string, rating double"
    votes = spark.createDataFrame([(1, "liked", 5, "A", "1999", 5.0), (1, "disliked", 6, "B", None, 0.5)], half)
    listed = spark.createDataFrame([(1, "liked", 5, "A", "1999", 4.0, 1), (1, "liked", 7, "C", None, 3.5, 2), (2, "liked", None, "D", None, 4.0, 1)], half + ", place long")
    assert profile.built(None, None) is None
    assert {(r["user"], r["item"], r["source"]) for r in profile.built(votes, None).collect()} == {(1, 5, "votes"), (1, 6, "votes")}
    assert {(r["user"], r["item"], r["source"]) for r in profile.built(None, listed).collect()} == {(1, 5, "listed"), (1, 7, "listed"), (2, None, "listed")}
    both = profile.built(votes, listed)
    assert profile.liked_and_disliked(both, 1) == ([(5, 5.0), (7, 3.5)], [6])
    assert profile.liked_and_disliked(both, 2) == ([], [])


def test_searches_stored_twice_count_as_stored_last(spark):
    searches = spark.createDataFrame([("a", None, 5, 2, 1), ("A ", "", None, 2, 2), ("b", "x", 7, 2, 3), ("b", "x", 6, 2, 3)], "query string, year string, item_id long, _v int, searched_at long")
    asked = spark.createDataFrame([("a", None), ("b", "x"), ("c", None)], "query string, year string")
    got = {r["query"]: (r["hit"], r["item_id"]) for r in store.cached_search(asked, searches).collect()}
    assert got == {"a": (True, None), "b": (True, 6), "c": (False, None)}
