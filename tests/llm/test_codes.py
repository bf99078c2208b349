import hashlib
import math

import numpy as np
import pytest

from tests.llm.cases import write_tables
from vespertide.llm.codes import Search, coded, compressed, op13_codes, trained_books

SCHEMA = "vec_id long, embedding array<float>, label int, error int, id string"


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(1024 * x) for x in r[1]] for r in kept]
    width = len(whole[0]) // parts
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for w in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    nearest = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            at = [nearest(p, c[p])[1] for c in cut]
            groups = [[c[p] for c, i in zip(cut, at) if i == e] for e in range(len(books[p]))]
            new.append([[sum(col) // len(g) for col in zip(*g)] if g else books[p][e] for e, g in enumerate(groups)])
        books = new
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((repr((r[0], "".join(f"{i:02x}" for _, i in f), e, by_label[r[2]], digest)) for r, f, e in zip(kept, found, errors)))


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)


def floats(rng, n, size, steps=None):
    v = rng.normal(size=(n, size)) * 0.1
    return (np.round(v * steps) / steps if steps else v).astype(np.float32).tolist()


@pytest.mark.parametrize("steps", [None, 8, 1])
def test_equals_brute_force(spark, tmp_path, steps):
    """Coarse steps make many ties and equal vectors."""
    rng = np.random.default_rng(5)
    rows = [(int(i), v, int(i) % 5 if i % 7 else None) for i, v in zip(rng.permutation(700), floats(rng, 700, 12, steps))]
    rows += [(9000, None, 1), (9001, [float("nan")] + [0.0] * 11, 1), (9002, [float("inf")] * 12, None), (9003, [None] + [0.5] * 11, 2), (9004, [], 2)]
    rows += [rows[3], rows[3], (None, [0.25] * 12, 3), (None, [0.125] * 12, 3)]
    path = write_tables(tmp_path / "e", embeddings=table(spark, rows).repartition(5))
    assert sorted(repr(tuple(r)) for r in op13_codes(spark, path).collect()) == brute([r for r in rows if r[1] != []])


def test_few_rows_and_none(spark, tmp_path):
    rows = [(i, [i / 10.0] * 4, None) for i in range(3)]
    path = write_tables(tmp_path / "few", embeddings=table(spark, rows))
    assert sorted(repr(tuple(r)) for r in op13_codes(spark, path).collect()) == brute(rows)
    path = write_tables(tmp_path / "none", embeddings=table(spark, [(1, None, 2)]))
    assert op13_codes(spark, path).count() == 0


def test_other_lengths_and_large_components_raise(spark):
    for rows in ([(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)], [(1, [1.0] * 6, 0)], [(1, [1e9] * 4, 0)]):
        with pytest.raises(ValueError):
            compressed(table(spark, rows))


def test_search_equals_brute_force_and_leaves_entries_out():
    rng = np.random.default_rng(6)
    book = rng.integers(-50, 50, (256, 3)).astype(float)
    book[100:140] = book[:40]
    parts = np.vstack([rng.integers(-60, 60, (3000, 3)).astype(float), book])
    index, best = Search(book).nearest(parts)
    d = ((parts[:, None] - book[None]) ** 2).sum(2)
    assert (index == d.argmin(1)).all() and (best == d.min(1)).all()
    seen = []
    search = Search(book)
    settle = search._settle
    search._settle = lambda node, p, rows, i, b: (seen.append(len(rows) * len(node.entries)), settle(node, p, rows, i, b))[1]
    search.nearest(parts)
    assert sum(seen) < 0.3 * len(parts) * len(book)


def test_many_labels_are_joined_in_shards(spark, monkeypatch):
    monkeypatch.setattr("vespertide.llm.codes.BROADCAST_LABELS", 1)
    monkeypatch.setattr("vespertide.llm.common.HOT_ROWS", 10)
    rows = [(i, [i % 9 / 8.0] * 4, i % 3 if i % 2 else None) for i in range(200)]
    out, _ = compressed(table(spark, rows), entries=4, rounds=1)
    got = out.collect()
    for r in got:
        assert r["label_error"] == sum(x["error"] for x in got if x["label"] == r["label"])


def test_books_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(7)
    rows = table(spark, [(i, v, 0) for i, v in enumerate(floats(rng, 400, 8))]).selectExpr("vec_id AS id", "cast(embedding AS array<double>) AS vec")
    one, many = trained_books(rows.coalesce(1), entries=16), trained_books(rows.repartition(7), entries=16)
    assert all((a == b).all() for a, b in zip(one, many))
    assert coded(rows, one).count() == 400
