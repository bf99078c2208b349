"""Truncated factors of a sparse matrix by a randomised range finder.

The matrix is a table of entries, a dense one a table (id, vec). Where it is cut into few blocks of rows by columns, a
product gives each block the vectors it needs, copied once for each block across, and a row or column with very many entries is
spread over its blocks. Where those copies and the sums of blocks would be more than the entries, as in a large sparse
matrix, entries meet their vectors by a join instead, so what is shuffled never grows faster than entries. The factors of a
matrix of more entries than one block has go by packed parts: rows and columns are numbered in the order of their ids, entries are packed once for each
direction by part of the one side and group of parts of the other, and a vector is sent once to each group that has an entry with it, or the sums
if these are fewer. That is never more than entries, and little where ids that are near meet each other. Tall-skinny QR takes a triangle from each task, merges triangles sixteen at a time
until one is left, and only that one (as wide as the number of factors, whatever the matrix holds) reaches
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vespertide.operators.common import dropped, kept, literal_rows, small

DENSE = "id long, vec array<double>"
#: Most rows and bytes of a dense block on average, and entries of a block.
BLOCK_ROWS, BLOCK_BYTES, BLOCK_ENTRIES = 131_072, 1 << 25, 1 << 19
#: Entries whose products a task holds at once, and triangles merged at once.
CHUNK_ENTRIES, MERGED = 4_096, 16
#: Most rows and bytes of a packed part, and groups that a side is cut into if it has as many parts.
PART_ROWS, PART_BYTES, GROUPS = 16_384, 1 << 22, 16
#: A dense matrix in packed parts: rows that follow each other by number, one after the other in x.
PACKED = "part int, rows int, x binary"
OVERSAMPLE, ROUNDS = 10, 4
#: Directions weaker than this share of the strongest are noise.
LEAST_SHARE = 1e-10


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def gaussian(ids: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Normal numbers that follow from id and seed alone, so a lost task makes the same ones again."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(2 * width) + np.arange(2 * width, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return np.sqrt(-2 * np.log(u[:, :width])) * np.cos(2 * np.pi * u[:, width:])


def frame(ids, matrix: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "vec": pd.Series(list(matrix), dtype=object)})


def random_directions(ids: DataFrame, width: int, seed: int) -> DataFrame:
    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield frame(b["id"].to_numpy(), gaussian(b["id"].to_numpy(), width, seed))

    return ids.mapInPandas(drawn, DENSE)


def block_product(entries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
    """For each `into`, the sum over its entries of v times the vector of `over`."""
    if entries.empty or vectors.empty:
        return frame([], np.empty((0, 0)))
    ids, matrix = vectors["id"].to_numpy(), np.stack(vectors["vec"].to_numpy())
    by_id = np.argsort(ids)
    into, over, v = (entries[c].to_numpy() for c in ("into", "over", "v"))
    order = np.argsort(into, kind="stable")
    at = by_id[np.searchsorted(ids, over[order], sorter=by_id)]
    keys, starts = np.unique(into[order], return_index=True)
    return frame(keys, run_sums(matrix, at, v[order], starts))


def run_sums(matrix: np.ndarray, at: np.ndarray, v: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of entries, which begin at `starts`, the sum of v times the row of the matrix."""
    out, ends = np.empty((len(starts), matrix.shape[1])), np.append(starts[1:], len(at))
    k = 0
    while k < len(starts):
        to = max(k + 1, int(np.searchsorted(ends, starts[k] + CHUNK_ENTRIES, side="right")))
        a, b = starts[k], ends[to - 1]
        out[k:to] = np.add.reduceat(matrix[at[a:b]] * v[a:b, None], starts[k:to] - a)
        k = to
    return out


def summed(parts: DataFrame) -> DataFrame:
    """(id, vec) of the sums of vectors with one id, a sorted run at a time."""

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for b in batches:
            if b.empty:
                continue
            ids, matrix = b["id"].to_numpy(), np.stack(b["vec"].to_numpy())
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            keys, sums = ids[starts], np.add.reduceat(matrix, starts)
            if last is not None and last == keys[0]:
                sums[0] += held
            elif last is not None:
                yield frame([last], held[None])
            last, held = keys[-1], sums[-1].copy()
            yield frame(keys[:-1], sums[:-1])
        if last is not None:
            yield frame([last], held[None])

    return parts.repartition("id").sortWithinPartitions("id").mapInPandas(merged, DENSE)


def entry_products(met: DataFrame) -> DataFrame:
    """(id, vec): v times vec, summed within a batch for each `into`. met: (into, v, vec)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            order = np.argsort(b["into"].to_numpy(), kind="stable")
            keys, starts = np.unique(b["into"].to_numpy()[order], return_index=True)
            products = np.stack(b["vec"].to_numpy()) * b["v"].to_numpy()[:, None]
            yield frame(keys, np.add.reduceat(products[order], starts))

    return met.mapInPandas(each, DENSE)


class Blocks:
    """A sparse matrix as a written table (row, col, v), multiplied by blocks or by entries."""

    def __init__(self, entries: DataFrame):
        self.entries = kept(entries.select("row", "col", F.col("v").cast("double").alias("v")))
        self.cells, self.rows, self.cols = self.entries.count(), self.ids("row").count(), self.ids("col").count()

    def ids(self, side: str) -> DataFrame:
        return self.entries.select(F.col(side).alias("id")).distinct()

    def cut(self, width: int) -> dict[str, int]:
        """Numbers of blocks, so that neither a dense block nor the entries of a block are too many for a task."""
        size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))
        rows, cols = max(1, -(-self.rows // size)), max(1, -(-self.cols // size))
        # Entries are spread over the longer side first.
        need = -(-self.cells // BLOCK_ENTRIES)
        if self.rows >= self.cols:
            rows = min(self.rows, max(rows, -(-need // cols)))
        else:
            cols = min(self.cols, max(cols, -(-need // rows)))
        return {"row": rows, "col": cols}

    def moved(self, blocks: dict[str, int], into: str) -> int:
        """Vectors that a product by blocks shuffles at most: copies, and sums of blocks where there is more than one across."""
        here, there = (self.rows, self.cols) if into == "row" else (self.cols, self.rows)
        across = blocks["col" if into == "row" else "row"]
        return there * blocks[into] + (here * across if across > 1 else 0)

    def times(self, dense: DataFrame, into: str, width: int) -> DataFrame:
        """The matrix times a dense one over its columns (into "row"), or its transpose times one over its rows (into "col")."""
        over = "col" if into == "row" else "row"
        blocks = self.cut(width)
        a = self.entries.select(F.col(into).alias("into"), F.col(over).alias("over"), "v")
        if self.moved(blocks, into) > self.cells:
            return kept(summed(entry_products(a.join(dense, F.col("over") == F.col("id")).select("into", "v", "vec"))))
        here, there = blocks[into], blocks[over]
        a = a.withColumns({"b": block_of(F.col("into"), here), "c": block_of(F.col("over"), there)})
        copies = dense.withColumn("c", block_of(F.col("id"), there)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(here - 1))))
        parts = a.groupBy("b", "c").cogroup(copies.groupBy("b", "c")).applyInPandas(block_product, DENSE)
        return kept(summed(parts) if there > 1 else parts)


def numbered(ids: DataFrame) -> DataFrame:
    """(id, number), written: numbers from 0 without a gap, in the order of ids."""
    at = F.monotonically_increasing_id()
    parts = kept(ids.repartitionByRange("id").sortWithinPartitions("id").select("id", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("at")))
    sizes = sorted((r["part"], r["count"]) for r in parts.groupBy("part").count().collect())
    before = [(part, sum(n for _, n in sizes[:k])) for k, (part, _) in enumerate(sizes)]
    out = kept(parts.join(F.broadcast(literal_rows(ids.sparkSession, before, "part long, before long")), "part").select("id", (F.col("at") + F.col("before")).alias("number")))
    dropped(parts)
    return out


def blobs(b: pa.RecordBatch, name: str, dtype=np.float64) -> list[np.ndarray]:
    """Arrays that the cells of a binary column hold, without a copy."""
    return [np.frombuffer(x.as_buffer() if len(x.as_buffer()) else b"", dtype) for x in b.column(name)]


class Batch:
    """Rows of arrays as record batches of about the bytes of a packed part."""

    def __init__(self, names: list[str]):
        self.names, self.rows, self.bytes = names, [], 0

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append([x.tobytes() if isinstance(x, np.ndarray) else x for x in row])
        self.bytes += sum(len(x) for x in self.rows[-1] if isinstance(x, bytes))
        if self.bytes >= PART_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, pa.binary() if isinstance(c[0], bytes) else pa.int32()) for c in zip(*self.rows)]
            self.rows, self.bytes = [], 0
            yield pa.RecordBatch.from_arrays(columns, self.names)


class Parts:
    """A sparse matrix in packed blocks, for products with dense ones of a width in packed parts.

    A block holds the entries between a part of one side and a group of parts of the other. A task has one part, or one group, and a batch of blocks at a time.
    """

    #: Of the rows that meet in a task: part, group (-1: the dense part itself) and whether sums are sent, and arrays of a block.
    MET = "part int, q int, sums int, send binary, at binary, v binary, into binary, starts binary, x binary"
    SENT = "q int, at binary, v binary, into binary, starts binary, x binary"

    def __init__(self, matrix: Blocks, width: int):
        self.spark, self.width, self.sizes = matrix.entries.sparkSession, width, {"row": matrix.rows, "col": matrix.cols}
        self.step = max(1, min(PART_ROWS, PART_BYTES // (8 * width)))
        self.numbers = {side: numbered(matrix.ids(side)) for side in ("row", "col")}
        cells = matrix.entries
        for side, name in (("row", "i"), ("col", "j")):
            cells = cells.join(small(self.numbers[side].select(F.col("id").alias(side), F.col("number").alias(name))), side).drop(side)
        cells = kept(cells)
        self.packs = {"row": self.packed(cells, "row", F.col("i"), F.col("j")), "col": self.packed(cells, "col", F.col("j"), F.col("i"))}
        dropped(cells)

    def parts(self, side: str) -> int:
        return -(-self.sizes[side] // self.step)

    def group(self, side: str) -> int:
        """Parts of a group: as many as a dense block may be, fewer if a side has few."""
        return max(1, min(BLOCK_BYTES // (8 * self.width * self.step), -(-self.parts(side) // GROUPS)))

    def packed(self, cells: DataFrame, side: str, into: Column, over: Column) -> DataFrame:
        """The entries in blocks, by what they are summed into. Those of a part that has very many are packed by several tasks."""
        step, rows, size = self.step, self.step * self.group(side), self.sizes[side]

        def pack(cells: pa.Table) -> pa.Table:
            into, over, v = (cells.column(c).to_numpy() for c in ("into", "over", "v"))
            order = np.argsort(into, kind="stable")
            into, v, part = into[order], v[order], int(over[0]) // step
            at, q = (over[order] - part * step).astype(np.int32), into // rows
            made, starts = Batch(["part", "q", "sums", "send", "at", "v", "into", "starts"]), np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            none = np.empty(0, np.int32)
            for a, b in zip(starts, np.append(starts[1:], len(q))):
                keys, runs = np.unique(into[a:b], return_index=True)
                send, places = np.unique(at[a:b], return_inverse=True)
                block = (keys - q[a] * rows).astype(np.int32), runs.astype(np.int32)
                if len(keys) < len(send):
                    made.rows += [[part, int(q[a]), 1, *(x.tobytes() for x in (none, at[a:b], v[a:b], *block))]]
                else:
                    made.rows += [[part, int(q[a]), 0, *(x.tobytes() for x in (send, places.astype(np.int32), v[a:b], *block))]]
            return pa.Table.from_batches(list(made.rest()))

        cells = cells.select(into.alias("into"), over.alias("over"), "v", F.floor(over / step).alias("part"))
        many = cells.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ENTRIES).alias("tasks"))
        # One number says part and task, as rows are sorted far faster by one than by two.
        task = F.shiftleft("part", 20) + F.floor(F.col("into") * F.col("tasks") / size)
        cells = cells.join(small(many), "part").select("into", "over", "v", task.alias("task"))
        return kept(cells.groupBy("task").applyInArrow(pack, self.MET.rsplit(",", 1)[0]))

    def random(self, side: str, seed: int) -> DataFrame:
        """The same numbers for an id as random_directions() gives it."""
        step, width = self.step, self.width

        def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made, held, part = Batch(["part", "rows", "x"]), [], None
            for b in batches:
                of, ids = b.column("part").to_numpy(), b.column("id").to_numpy()
                begin = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
                for at, to in zip(begin, [*begin[1:], len(of)]):
                    if held and of[at] != part:
                        yield from made.add(part, sum(map(len, held)), np.vstack(held))
                        held = []
                    part = int(of[at])
                    held.append(gaussian(ids[at:to], width, seed))
            if held:
                yield from made.add(part, sum(map(len, held)), np.vstack(held))
            yield from made.rest()

        tasks = self.tasks(side)
        rows = self.numbers[side].select("id", "number", F.floor(F.col("number") / step).cast("int").alias("part"))
        return rows.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).sortWithinPartitions("number").mapInArrow(drawn, PACKED)

    def tasks(self, side: str) -> int:
        return min(self.parts(side), int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def times(self, dense: DataFrame, into: str, width: int) -> DataFrame:
        """The same products as those of Blocks, of dense matrices no wider than those the parts were made for."""
        over, step, group = "col" if into == "row" else "row", self.step, self.group(into)
        size, there, names = self.sizes[into], self.sizes[over], [c.split()[0] for c in self.SENT.split(", ")]

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made, held, matrix = Batch(names), None, None
            for b in batches:
                send, at, starts = (blobs(b, c, np.int32) for c in ("send", "at", "starts"))
                v, x, raw = blobs(b, "v"), blobs(b, "x"), {c: b.column(c) for c in ("part", "q", "sums", "at", "v", "into", "starts")}
                for k in range(b.num_rows):
                    part, q, sums = (raw[c][k].as_py() for c in ("part", "q", "sums"))
                    if q < 0:
                        held, matrix = part, x[k].reshape(min(step, there - part * step), -1)
                    elif part != held:
                        raise ValueError(f"part {part} is missing")
                    elif sums:
                        yield from made.add(q, b"", b"", raw["into"][k].as_py(), b"", run_sums(matrix, at[k], v[k], starts[k]))
                    else:
                        yield from made.add(q, *(raw[c][k].as_py() for c in ("at", "v", "into", "starts")), matrix[send[k]])
            yield from made.rest()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                at, to, starts = (blobs(b, c, np.int32) for c in ("at", "into", "starts"))
                for k, (q, v, x) in enumerate(zip(b.column("q").to_pylist(), blobs(b, "v"), blobs(b, "x"))):
                    x = x.reshape(at[k].max() + 1 if len(v) else len(to[k]), -1)
                    if q not in sums:
                        sums[q] = np.zeros((min(size - q * group * step, group * step), x.shape[1]))
                    sums[q][to[k]] += run_sums(x, at[k], v, starts[k]) if len(v) else x
            made = Batch(["part", "rows", "x"])
            for q, total in sums.items():
                for n, a in enumerate(range(0, len(total), step)):
                    yield from made.add(q * group + n, len(total[a : a + step]), total[a : a + step])
            yield from made.rest()

        none = F.lit(b"")
        own = dense.select("part", F.lit(-1).alias("q"), F.lit(0).alias("sums"), *[none.alias(c) for c in ("send", "at", "v", "into", "starts")], "x")
        met = own.unionByName(self.packs[into].withColumn("x", none))
        tasks = self.tasks(over)
        met = met.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).sortWithinPartitions("part", "q")
        sent = met.mapInArrow(send, self.SENT).repartitionById(-(-self.parts(into) // group), F.col("q"))
        return kept(sent.mapInArrow(add, PACKED))

    def named(self, dense: DataFrame, side: str) -> DataFrame:
        """(id, vec) of a dense matrix in packed parts."""
        step = self.step

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part, n, x in zip(b.column("part").to_pylist(), b.column("rows").to_pylist(), blobs(b, "x")):
                    width = len(x) // n
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, width, dtype=np.int32)), pa.array(x))
                    yield pa.RecordBatch.from_arrays([pa.array(part * step + np.arange(n, dtype=np.int64)), vec], ["number", "vec"])

        return dense.mapInArrow(rows, "number long, vec array<double>").join(self.numbers[side], "number").select("id", "vec")

    def tables(self) -> list[DataFrame]:
        return [*self.numbers.values(), *self.packs.values()]


def matrices(b: pd.DataFrame) -> list[np.ndarray]:
    """Rows of a dense matrix, by vectors or by packed parts."""
    if "x" in b:
        return [np.frombuffer(x).reshape(n, -1) for n, x in zip(b["rows"], b["x"])]
    return [np.stack(b["vec"].to_numpy())] if len(b) else []


def triangle(dense: DataFrame) -> np.ndarray:
    """R of the QR of a tall matrix: triangles of tasks, merged in a tree."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        r = None
        for b in batches:
            for m in matrices(b):
                r = np.linalg.qr(m if r is None else np.vstack([r, m]), mode="r")
        if r is not None:
            yield pd.DataFrame({"n": [TaskContext.get().partitionId()], "r": [r.ravel()], "width": [r.shape[1]]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        width = int(group["width"].iloc[0])
        stack = np.vstack([r.reshape(-1, width) for r in group.sort_values("n")["r"]])
        return pd.DataFrame({"n": [int(group["n"].min()) // MERGED], "r": [np.linalg.qr(stack, mode="r").ravel()], "width": [width]})

    shape = "n int, r array<double>, width int"
    parts = kept(dense.mapInPandas(local, shape))
    while parts.count() > 1:
        fewer = kept(parts.groupBy(F.floor(F.col("n") / MERGED)).applyInPandas(merge, shape))
        dropped(parts)
        parts = fewer
    found = parts.first()
    dropped(parts)
    return np.array(found["r"]).reshape(-1, found["width"])


def mapped(dense: DataFrame, right: np.ndarray) -> DataFrame:
    """A tall matrix times a small one."""
    if "x" in dense.columns:

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(x=[(m @ right).tobytes() for m in matrices(b)])

        return dense.mapInPandas(part, PACKED)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not b.empty:
                yield frame(b["id"].to_numpy(), np.stack(b["vec"].to_numpy()) @ right)

    return dense.mapInPandas(each, DENSE)


def orthonormal(dense: DataFrame) -> DataFrame:
    """An orthonormal base of what the columns span; directions that are noise are left out."""
    _, s, vt = np.linalg.svd(triangle(dense), full_matrices=False)
    strong = s > s[0] * LEAST_SHARE
    return mapped(dense, vt[strong].T / s[strong])


def truncated(entries: DataFrame, factors: int, rounds: int = ROUNDS, seed: int = 0, sizes: DataFrame | None = None) -> DataFrame:
    """(id, vec): rows of U times S of the largest factors of a matrix given by (row, col, v), each cell once and no row all zero.

    A matrix of one row or column has no factors. Inner products of rows don't depend on how factors are
    turned, so only these mean something. sizes: (row, n), where a row stands for n equal ones; these are factors of the matrix
    that has them all, as rows that are longer by the root of n have the same products of columns.
    """
    if sizes is not None:
        root = kept(sizes.select("row", F.sqrt("n").alias("root"), "n"))
        entries = entries.join(root, "row").select("row", "col", (F.col("v") * F.col("root")).alias("v"))
    matrix = Blocks(entries)
    of = matrix.rows if sizes is None else int(root.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    k = min(factors, of - 1, matrix.cols - 1)
    if k < 1:
        dropped(matrix.entries)
        return entries.sparkSession.createDataFrame([], DENSE)
    width = min(k + OVERSAMPLE, matrix.rows, matrix.cols)
    whole = width == min(matrix.rows, matrix.cols)
    packed = Parts(matrix, width) if matrix.cells > BLOCK_ENTRIES else None
    factor = packed or matrix
    y = factor.times(packed.random("col", seed) if packed else random_directions(matrix.ids("col"), width, seed), "row", width)
    # A base as wide as the matrix spans it all, and rounds add nothing.
    for _ in range(0 if whole else rounds):
        z = factor.times(orthonormal(y), "col", width)
        dropped(y)
        y = factor.times(z, "row", width)
        dropped(z)
    base = orthonormal(y)
    z = factor.times(base, "col", width)
    u, s, _ = np.linalg.svd(triangle(z).T)
    found = mapped(base, u[:, : min(k, len(s))] * s[:k])
    if packed:
        found = packed.named(found, "row")
    if sizes is not None:
        found = found.join(root, F.col("id") == F.col("row")).select("id", F.transform("vec", lambda x: x / F.col("root")).alias("vec"))
    out = kept(found)
    for table in (y, z, matrix.entries, *([] if sizes is None else [root]), *(packed.tables() if packed else [])):
        dropped(table)
    return out
