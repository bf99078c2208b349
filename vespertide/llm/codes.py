"""Compression of vectors to codes: one codebook for each of four parts, searched by a kd-tree.

Components become whole numbers, so distances, ties and means are exact whatever order rows come in. Each
round broadcasts one kd-tree a codebook (its size is entries times components, whatever the number of rows).
A batch of parts first goes down to the leaf it falls in, which gives a bound, and then walks the tree: a node
whose box is farther than the bound is left out, one equally far is visited, so of equally near entries the
one of the lowest index is found. Tasks add up the parts of an entry; Spark adds the tasks' sums, and only
these, one row an entry, reach the driver, which takes the means and sends the next trees.

Cases: rows whose vector is null or has a null, NaN or infinite component are left out; an empty table gives
no rows; fewer rows than entries give a smaller codebook; repeated rows count each for itself; equal or null
ids are put in order by their vectors, null ids last. Vectors must have one length, a multiple of the number
of parts, and components small enough for whole numbers of 53 bits in sums of squares: both raise. Other columns
play no part; labels may be null, and null labels are one label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vespertide.llm.common import discard, hot_join, materialize, read_table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LEAF_ENTRIES = 8
BATCH_ROWS = 4_096
#: Labels whose sums are broadcast at most; beyond, they are joined with frequent labels in shards.
BROADCAST_LABELS = 200_000


@dataclass
class Node:
    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray | None = None
    at: int = 0
    split: float = 0.0
    left: Node | None = None
    right: Node | None = None


def grown(book: np.ndarray, entries: np.ndarray) -> Node:
    """The kd-tree of some entries of a codebook: boxes are tight, splits halve the widest side."""
    points = book[entries]
    low, high = points.min(0), points.max(0)
    at = int((high - low).argmax())
    if len(entries) <= LEAF_ENTRIES or high[at] == low[at]:
        return Node(low, high, entries)
    order = entries[np.argsort(points[:, at], kind="stable")]
    half = len(order) // 2
    split = float(book[order[half - 1], at] + book[order[half], at]) / 2
    return Node(low, high, None, at, split, grown(book, order[:half]), grown(book, order[half:]))


class Search:
    """Nearest entries of a batch of parts: index and squared distance, the lowest index of equally near ones."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.root = grown(book, np.arange(len(book)))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index = np.full(len(parts), len(self.book), dtype=np.int64)
        best = np.full(len(parts), np.inf)
        self._descend(self.root, parts, np.arange(len(parts)), index, best)
        self._walk(self.root, parts, np.arange(len(parts)), index, best)
        return index, best

    def _descend(self, node: Node, parts, rows, index, best) -> None:
        if not len(rows):
            return
        if node.entries is not None:
            self._settle(node, parts, rows, index, best)
            return
        left = parts[rows, node.at] <= node.split
        self._descend(node.left, parts, rows[left], index, best)
        self._descend(node.right, parts, rows[~left], index, best)

    def _walk(self, node: Node, parts, rows, index, best) -> None:
        here = parts[rows]
        apart = np.maximum(np.maximum(node.low - here, here - node.high), 0)
        rows = rows[np.einsum("ij,ij->i", apart, apart) <= best[rows]]
        if not len(rows):
            return
        if node.entries is not None:
            self._settle(node, parts, rows, index, best)
            return
        self._walk(node.left, parts, rows, index, best)
        self._walk(node.right, parts, rows, index, best)

    def _settle(self, node: Node, parts, rows, index, best) -> None:
        here, found, far = parts[rows], index[rows], best[rows]
        for e in node.entries:
            apart = here - self.book[e]
            d = np.einsum("ij,ij->i", apart, apart)
            nearer = (d < far) | ((d == far) & (e < found))
            found[nearer], far[nearer] = e, d[nearer]
        index[rows], best[rows] = found, far


def whole_numbers(vectors: pd.Series) -> np.ndarray:
    """Rows of floor(SCALE * x): whole numbers, held as doubles, which are exact for them here."""
    return np.floor(np.stack(vectors.to_numpy()).astype(np.float64) * SCALE)


def usable(vector: Column) -> Column:
    """Whether all of a vector is there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False)) & (F.size(vector) > 0)


def checked(rows: DataFrame, parts: int) -> int:
    """The length of all vectors, 0 for no rows."""
    largest = F.array_max(F.transform("vec", F.abs))
    least, most, widest = rows.agg(F.min(F.size("vec")), F.max(F.size("vec")), F.max(largest)).first()
    if least is None:
        return 0
    if least != most or least % parts:
        raise ValueError(f"vectors of {least} to {most} components; one length is needed, a multiple of {parts}")
    if most // parts * (2 * (widest * SCALE + 1)) ** 2 >= 2**53:
        raise ValueError(f"a component of {widest} is too large for exact distances")
    return most


def first_books(rows: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """Codebooks of the vectors of the smallest ids: so many rows at most come to the driver."""
    first = rows.select("id", "vec").orderBy(F.asc_nulls_last("id"), "vec").limit(entries).collect()
    whole = whole_numbers(pd.Series([np.array(r["vec"]) for r in first]))
    return [np.ascontiguousarray(x) for x in np.split(whole, parts, axis=1)]


def sums_of(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(part, entry, n, s0, s1, ...): number and componentwise sums of the parts whose nearest entry this is."""
    held = rows.sparkSession.sparkContext.broadcast([Search(b) for b in books])
    width = books[0].shape[1]
    fields = ["part int", "entry int", "n long", *[f"s{i} long" for i in range(width)]]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searches = held.value
        total = np.zeros((len(searches), len(searches[0].book), width + 1), dtype=np.int64)
        for batch in batches:
            for begin in range(0, len(batch), BATCH_ROWS):
                whole = whole_numbers(batch["vec"].iloc[begin : begin + BATCH_ROWS])
                for p, (search, part) in enumerate(zip(searches, np.split(whole, len(searches), axis=1))):
                    index, _ = search.nearest(part)
                    np.add.at(total[p], index, np.hstack([np.ones((len(part), 1)), part]).astype(np.int64))
        part, entry = np.nonzero(total[:, :, 0])
        found = total[part, entry]
        yield pd.DataFrame({"part": part, "entry": entry, "n": found[:, 0], **{f"s{i}": found[:, i + 1] for i in range(width)}})

    each = rows.select("vec").mapInPandas(partial, ", ".join(fields))
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])


def trained_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks after so many rounds; entries that no part is nearest to stay. rows: (id, vec) of usable vectors, at least one."""
    books = first_books(rows, parts, entries)
    for _ in range(rounds):
        for r in sums_of(rows, books).collect():
            part, entry, n, *sums = r
            books[part][entry] = [s // n for s in sums]
    return books


def coded(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """rows with indexes (of the nearest entry, in part order) and error (squared distances summed over parts)."""
    held = rows.sparkSession.sparkContext.broadcast([Search(b) for b in books])

    @F.pandas_udf("indexes array<int>, error long")
    def code(vectors: pd.Series) -> pd.DataFrame:
        out = []
        for begin in range(0, len(vectors), BATCH_ROWS):
            whole = whole_numbers(vectors.iloc[begin : begin + BATCH_ROWS])
            found = [s.nearest(part) for s, part in zip(held.value, np.split(whole, len(held.value), axis=1))]
            out.append(pd.DataFrame({"indexes": list(np.stack([i for i, _ in found], axis=1).astype(np.int32)), "error": sum(d for _, d in found).astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"indexes": [], "error": []})

    return rows.withColumn("c", code("vec")).select("*", "c.*").drop("c")


def books_digest(books: list[np.ndarray]) -> str:
    numbers = ",".join(str(int(x)) for book in books for entry in book for x in entry)
    return hashlib.sha256(numbers.encode()).hexdigest()


def compressed(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, indexes, error, label_error) of every usable vector, and the codebooks. The table is read once a round, so it should be a stored one."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec")).where(usable(F.col("vec")))
    if not checked(rows, parts):
        return rows.select("id", "label", F.array().cast("array<int>").alias("indexes"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), []
    books = trained_books(rows.select("id", "vec"), parts, entries, rounds)
    # Null labels are one label, and no other label is written like it.
    out = materialize(coded(rows, books).drop("vec").withColumn("__vt_label", F.to_json(F.struct("label"))), "vector-codes")
    sums = materialize(out.groupBy("__vt_label").agg(F.sum("error").alias("label_error")), "label-errors")
    few = sums.count() <= BROADCAST_LABELS
    joined = out.join(F.broadcast(sums), "__vt_label") if few else hot_join(out, sums, "__vt_label")
    return joined.select("id", "label", "indexes", "error", "label_error"), books


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, error and the error of its label for every vector of embeddings."""
    rows, books = compressed(read_table(spark, sf_dir, "embeddings"))
    two = F.transform("indexes", lambda i: F.lpad(F.lower(F.hex(i)), 2, "0"))
    return rows.select(F.col("id").alias("vec_id"), F.array_join(two, "").alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _assigned(step: int, books: str) -> str:
    """Nearest entry of every part under the codebooks of a step; whole numbers of doubles are exact here."""
    return f"""a{step} AS MATERIALIZED (
  SELECT x.n, x.part, x.v, arg_min(b.entry, (x.vv - 2 * list_inner_product(x.v, b.v) + b.vv, b.entry)) AS entry,
    min(x.vv - 2 * list_inner_product(x.v, b.v) + b.vv) AS d
  FROM cut x JOIN {books} b USING (part) GROUP BY x.n, x.part, x.v)"""


def _moved(step: int) -> str:
    return f"""b{step + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.v, b.v) AS v, list_inner_product(coalesce(m.v, b.v), coalesce(m.v, b.v)) AS vv
  FROM b{step} b LEFT JOIN (
    SELECT part, entry, list(f ORDER BY i) AS v FROM (
      SELECT part, entry, i, floor(sum(v[i]) / count(*)) AS f FROM a{step}, range(1, (SELECT any_value(len(v)) + 1 FROM cut)) t(i) GROUP BY part, entry, i)
    GROUP BY part, entry) m USING (part, entry))"""


OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (
  SELECT n, p AS part, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v, list_inner_product(v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})], v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})]) AS vv
  FROM kept, range({PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT part, n - 1 AS entry, v, vv FROM cut WHERE n <= {ENTRIES}),
{", ".join(_assigned(s, f"b{s}") + ", " + _moved(s) for s in range(ROUNDS))},
{_assigned(ROUNDS, f"b{ROUNDS}")},
said AS (SELECT n, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY n),
digest AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) AS h FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN said USING (n), digest
"""
