import math

from pyspark.sql import functions as F

from vespertide.operators import common
from vespertide.operators.signals import DenseSignal, unit_vector
from vespertide.plans import catalogue


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_products_with_seeds(spark, monkeypatch):
    monkeypatch.setattr("vespertide.operators.signals.PRODUCTS", 4)
    rows = {n: [math.sin(n * k + 1) for k in range(5)] for n in range(11)} | {20: [1.0, 2.0]}
    signal = DenseSignal("x", spark.createDataFrame(list(rows.items()), "id long, vec array<double>").repartition(3))
    found = signal.to_seeds(spark.createDataFrame([(2,), (7,), (20,), (99,)], "seed long"))
    got = {(r["seed"], r["id"]): r["s"] for r in found.collect()}
    want = {}
    for seed in (2, 7, 20):
        for i, v in rows.items():
            # Added one after the other, from the first component on.
            want[seed, i] = None if len(v) != len(rows[seed]) else 0.0
            if want[seed, i] is not None:
                for a, b in zip(v, rows[seed]):
                    want[seed, i] += a * b
    assert got == want
    assert signal.to_seeds(spark.createDataFrame([(99,)], "seed long")).count() == 0
    # Rows are not paired with seeds before they are multiplied.
    assert "Join" not in plan_of(found)


def test_a_norm_is_taken_once_a_row(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)], "v array<double>")
    out = df.select(unit_vector(F.col("v")).alias("u"))
    assert [r["u"] for r in out.collect()] == [[0.6, 0.8], None, None, None]
    assert "/ SQRT(aggregate" not in plan_of(out)


def test_signals_of_saved_items_are_loaded_by_other_sessions(spark, sf_dir, monkeypatch):
    built = []
    monkeypatch.setattr("vespertide.operators.common.save_table", lambda df, path, made_of, save=common.save_table: built.append(path) or save(df, path, made_of))
    first = sorted(map(tuple, catalogue.metadata(spark, sf_dir).weights.collect()))
    # Another session has checked nothing yet, and its plans have other hashes.
    monkeypatch.setattr(common, "_CHECKED", {})
    monkeypatch.setattr(type(spark.range(1)), "semanticHash", lambda df: -1)
    built.clear()
    assert sorted(map(tuple, catalogue.metadata(spark, sf_dir).weights.collect())) == first and not built
