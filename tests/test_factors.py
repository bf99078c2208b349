import numpy as np
import pytest

from vespertide.operators import factors
from vespertide.operators.factors import truncated


def cosines(m):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    return unit @ unit.T


def dense_factors(m, k):
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    return u[:, :k] * s[:k]


def run(spark, m, k, **more):
    rows, cols = np.nonzero(m)
    # Ids with gaps: rows and columns are not numbered from 0.
    entries = spark.createDataFrame([(int(r) * 7 + 3, int(c) * 11 + 5, float(m[r, c])) for r, c in zip(rows, cols)], "row long, col long, v double")
    got = {r["id"]: r["vec"] for r in truncated(entries, k, **more).collect()}
    return np.array([got[i * 7 + 3] for i in range(len(m))])


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_cosines_equal_those_of_a_dense_decomposition(spark, monkeypatch, block_rows):
    """Cut at a gap of the spectrum; one row and one column hold far more than the others."""
    monkeypatch.setattr(factors, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(1)
    m = (rng.random((90, 60)) < 0.15) * rng.random((90, 60)) + np.outer(rng.random(90), rng.random(60)) * (rng.random((90, 60)) < 0.5)
    m[4, :] = rng.random(60) + 0.1
    m[:, 9] = rng.random(90) + 0.1
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    m = (u[:, :12] * s[:12]) @ vt[:12] + 0.02 * (u[:, 12:] * s[12:]) @ vt[12:]
    got = run(spark, m, 12)
    assert got.shape == (90, 12)
    assert np.abs(cosines(got) - cosines(dense_factors(m, 12))).max() < 1e-3


def test_planted_rank_is_found_whole(spark):
    rng = np.random.default_rng(2)
    m = rng.random((50, 5)) @ rng.random((5, 40))
    got = run(spark, m, 20)
    assert np.abs(cosines(got) - cosines(m)).max() < 1e-8


def test_all_factors_of_a_narrow_matrix(spark):
    rng = np.random.default_rng(3)
    m = rng.random((30, 6)) + 0.1
    got = run(spark, m, 256)
    assert got.shape == (30, 5)
    assert np.abs(cosines(got) - cosines(dense_factors(m, 5))).max() < 1e-6


def test_nothing_to_factor(spark):
    none = spark.createDataFrame([], "row long, col long, v double")
    assert truncated(none, 4).count() == 0
    assert truncated(spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0)], "row long, col long, v double"), 4).count() == 0


def test_the_driver_gets_one_triangle_of_the_width(spark, monkeypatch):
    monkeypatch.setattr(factors, "MERGED", 2)
    rng = np.random.default_rng(4)
    m = rng.random((500, 7))
    dense = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], factors.DENSE).repartition(9)
    r = factors.triangle(dense)
    assert r.shape == (7, 7) and np.allclose(r.T @ r, m.T @ m)


def scattered(spark, rng, n, each):
    """A table of few entries a row, and the same matrix dense."""
    m = np.zeros((n, n))
    for r in range(n):
        m[r, rng.choice(n, each, replace=False)] = rng.random(each) + 0.1
    rows, cols = np.nonzero(m)
    return spark.createDataFrame([(int(r), int(c), float(m[r, c])) for r, c in zip(rows, cols)], "row long, col long, v double"), m


@pytest.mark.parametrize("into", ["row", "col"])
def test_a_product_with_few_entries_copies_no_vector_to_every_block(spark, monkeypatch, into):
    """90 vectors in 23 blocks across would be 2,070 copies for 270 entries."""
    monkeypatch.setattr(factors, "BLOCK_ROWS", 4)
    monkeypatch.setattr(factors, "block_product", None)
    rng = np.random.default_rng(5)
    entries, m = scattered(spark, rng, 90, 3)
    d = rng.random((90, 4))
    dense = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], factors.DENSE)
    got = {r["id"]: r["vec"] for r in factors.Blocks(entries).times(dense, into, 4).collect()}
    want = (m if into == "row" else m.T) @ d
    assert all(np.allclose(got.get(i, np.zeros(4)), want[i]) for i in range(90))


def test_what_a_product_moves_grows_no_faster_than_entries(spark, monkeypatch):
    """Blocks are only taken where copies and sums of blocks are no more than entries, however many rows and columns there are."""
    monkeypatch.setattr(factors, "BLOCK_ROWS", 4)
    entries, _ = scattered(spark, np.random.default_rng(6), 40, 40)
    full = factors.Blocks(entries)
    assert full.moved(full.cut(4), "row") <= full.cells == 1600
    monkeypatch.setattr(factors, "BLOCK_ENTRIES", 100)
    assert (lambda b: b["row"] * b["col"])(full.cut(4)) >= 16


def test_a_row_that_stands_for_equal_ones_counts_as_often(spark):
    rng = np.random.default_rng(7)
    classes, n = rng.random((6, 9)), np.array([1, 5, 2, 9, 1, 3])
    of = np.repeat(np.arange(6), n)
    cells = [(r, c, float(classes[r, c])) for r in range(6) for c in range(9)]
    sizes = spark.createDataFrame([(i, int(k)) for i, k in enumerate(n)], "row long, n long")
    got = {r["id"]: r["vec"] for r in truncated(spark.createDataFrame(cells, "row long, col long, v double"), 3, sizes=sizes).collect()}
    a, b = np.array([got[i] for i in of]), dense_factors(classes[of], 3)
    assert np.allclose(a @ a.T, b @ b.T)
    # As many factors as the whole matrix has, also where that is as many as there are classes.
    assert len(truncated(spark.createDataFrame(cells, "row long, col long, v double"), 20, sizes=sizes).first()["vec"]) == 6


def in_parts(monkeypatch, rows, block_bytes=1 << 25):
    monkeypatch.setattr(factors, "BLOCK_ENTRIES", 50)
    monkeypatch.setattr(factors, "PART_ROWS", rows)
    monkeypatch.setattr(factors, "BLOCK_BYTES", block_bytes)


@pytest.mark.parametrize("rows, block_bytes", [(7, 1 << 25), (3, 1), (1000, 1 << 25)])
def test_products_in_packed_parts_equal_dense_ones(spark, monkeypatch, rows, block_bytes):
    """A row and a column that have every entry, and others with few; parts that hold one group, or all rows."""
    in_parts(monkeypatch, rows, block_bytes)
    rng = np.random.default_rng(8)
    m = (rng.random((61, 40)) < 0.1) * rng.random((61, 40))
    m[5, :], m[:, 7] = rng.random(40) + 0.1, rng.random(61) + 0.1
    i, j = np.nonzero(m)
    entries = spark.createDataFrame([(int(r) * 7 - 30, int(c) * 11 + 5, float(m[r, c])) for r, c in zip(i, j)], "row long, col long, v double")
    parts = factors.Parts(factors.Blocks(entries), 4)
    for into, over, ids, matrix in (("row", "col", np.arange(61) * 7 - 30, m), ("col", "row", np.arange(40) * 11 + 5, m.T)):
        d = factors.gaussian(np.arange(40) * 11 + 5 if over == "col" else np.arange(61) * 7 - 30, 4, 3)
        got = {r["id"]: r["vec"] for r in parts.named(parts.times(parts.random(over, 3), into, 4), into).collect()}
        assert sorted(got) == ids.tolist() and np.allclose([got[i] for i in ids], matrix @ d)


def test_factors_in_packed_parts_equal_those_of_a_dense_decomposition(spark, monkeypatch):
    """Fewer directions than asked for are left where the rank is small; equal rows may stand for many."""
    in_parts(monkeypatch, 7)
    monkeypatch.setattr(factors, "block_product", None)
    monkeypatch.setattr(factors, "entry_products", None)
    rng = np.random.default_rng(9)
    m = rng.random((50, 5)) @ rng.random((5, 40))
    assert np.abs(cosines(run(spark, m, 20)) - cosines(m)).max() < 1e-8
    u, s, vt = np.linalg.svd(rng.random((90, 60)), full_matrices=False)
    m = (u[:, :12] * s[:12]) @ vt[:12] + 0.02 * (u[:, 12:] * s[12:]) @ vt[12:]
    assert np.abs(cosines(run(spark, m, 12)) - cosines(dense_factors(m, 12))).max() < 1e-3


def test_a_vector_is_sent_once_to_a_group_or_sums_if_they_are_fewer(spark, monkeypatch):
    """Near ids that meet each other: a matrix of 30 squares on its diagonal sends 240 vectors a product, not one for each of 1,920 entries."""
    in_parts(monkeypatch, 8)
    entries = spark.createDataFrame([(8 * b + i, 8 * b + j, 1.0 + i + j) for b in range(30) for i in range(8) for j in range(8)], "row long, col long, v double")
    parts = factors.Parts(factors.Blocks(entries), 4)
    sent = lambda side: sum(len(r["send"] if r["sums"] == 0 else r["into"]) // 4 for r in parts.packs[side].collect())
    assert sent("row") == sent("col") == 240
    hot = spark.createDataFrame([(0, j, 1.0) for j in range(200)] + [(1, j, 1.0) for j in range(200)], "row long, col long, v double")
    parts = factors.Parts(factors.Blocks(hot), 4)
    assert sum(r["sums"] * len(r["into"]) // 4 for r in parts.packs["row"].collect()) <= 2 * 25
