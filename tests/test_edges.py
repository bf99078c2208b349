from collections import Counter
from itertools import permutations

import pytest

from vespertide.operators import recommend
from vespertide.plans import requests
from vespertide.sources import tables

ORDERS = {1: [7, 8, 9], 2: [7, 8, 8], 3: [8, 9], 4: [7], 5: [9, 7, 3, 2], 6: [8, 7, 2], None: [7, 9], 8: [7, None, 3]}


def expected(per_item):
    n = Counter(p for k, items in ORDERS.items() if k is not None for p in permutations({i for i in items if i is not None}, 2))
    found = {}
    for (src, dst), times in n.items():
        found.setdefault(src, []).append((-times, dst))
    return {(src, dst, rank) for src, near in found.items() for rank, (_, dst) in enumerate(sorted(near)[:per_item])}


@pytest.mark.parametrize("busy", [100_000, 3, 1])
def test_neighbours_are_counted_whole_however_busy_items_are(spark, monkeypatch, busy):
    monkeypatch.setattr(tables, "BUSY_ORDERS", busy)
    lines = spark.createDataFrame([(k, i) for k, items in ORDERS.items() for i in items], "l_orderkey long, l_partkey long")
    for per_item in (2, 20):
        assert {tuple(r) for r in tables.ordered_together(lines, per_item).collect()} == expected(per_item)
        assert {tuple(r) for r in tables.ordered_together(lines, per_item, [7, 2, 99]).collect()} == {e for e in expected(per_item) if e[0] in (7, 2)}


def test_pairs_of_an_order_are_not_shuffled(spark, monkeypatch):
    """One shuffle deals lines by order, one items with their lists; counting and ranking need no further one."""
    lines = spark.createDataFrame([(k, i) for k, items in ORDERS.items() for i in items], "l_orderkey long, l_partkey long")
    plan = tables.ordered_together(lines, 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("rows", [1, 2, 3, 5])
def test_items_are_counted_whole_where_batches_cut_their_lists(spark, monkeypatch, rows):
    """Counting takes an item's lists in order, a batch at a time, and sorts no pairs as rows."""
    lines = spark.createDataFrame([(k, i) for k, items in ORDERS.items() for i in items], "l_orderkey long, l_partkey long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        found = tables.ordered_together(lines, 2)
        assert {tuple(r) for r in found.collect()} == expected(2)
        assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_request_that_names_no_item_asks_for_no_edges(spark, sf_dir, monkeypatch):
    def none(*_, **__):
        raise AssertionError("edges were asked for")

    monkeypatch.setattr(tables, "ordered_together", none)
    assert {r["how"] for r in requests.answer_browse(spark, sf_dir).collect()} == {"browsed"}


def test_neighbours_of_a_function_are_those_of_the_table(spark, sf_dir):
    items, whole = tables.items(spark, sf_dir), tables.edges(spark, sf_dir)
    some = tables.edges_of(spark, sf_dir, [9, 30])
    assert sorted(some.collect()) == sorted(whole.where("src IN (9, 30)").collect())
    assert recommend.neighbours(items, some, [9, 30]).collect() == recommend.neighbours(items, whole, [9, 30]).collect()
