"""Approximate nearest neighbours by low-dimensional stable projections in a kd-tree.

Vectors are projected on a few Gaussian directions, under which the squared projected distance of
two vectors at distance d is d^2 times a chi-squared variable. The projections are indexed by a
kd-tree: its top, split at medians of a bounded sample, deals all vectors to leaves (a leaf of more
than LEAF_ROWS rows is dealt on in shards); each task builds the rest of the tree for its rows. A
query takes buckets of neighbours in the order of their projected distance, verifies them on the
original vectors, and stops when the chi-square test says that a vector closer than the k-th found
would, with probability `certainty`, have come already. The same test prunes whole leaves: a query
is first answered in its own leaf, and goes with that bound only to leaves whose box is in reach.

Queries of a task go down together: in every step each one that is not done takes its next buckets,
the projections of a bucket meet those of all queries that ask for it in one matrix product, and only
rows that pass the test are verified. Distances of what is returned are computed anew, from the
differences of the original vectors.

Equal vectors are one class that keeps its smallest k + 1 ids, which is all that any query can
return, so a vector that a third of the rows share is one row of the index and one query.

Cases: vectors that are null, zero, or that hold null or non-finite components take no part; nor do
those of another length than the commonest one, which have no distance to it; a row without vec_id
takes no part; repeated ids count once per vector; with fewer candidates than k all are returned;
an empty table gives an empty result; columns beside id and vector are ignored. Ties go to the
smaller vec_id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vespertide.llm.common import materialize, read_table

NEIGHBOURS = 10
#: Chosen by measurement (README): fewer directions or less certainty verify fewer rows and lose recall.
DIRECTIONS = 12
CERTAINTY = 0.9
SEED = 20_240
#: Rows of the sample that splits the top of the tree, and of that sample for each leaf at least.
SAMPLE_ROWS = 20_000
SAMPLE_IN_LEAF = 8
LEAF_ROWS = 8_192
BUCKET = 64
QUERY_BLOCK = 20_000
QUERIES_AT_ONCE = 1_024
MOST_BUCKETS_AT_ONCE = 16
SALTS = 16
FOUND = "query_class long, class long, score double, ids array<long>"


def chi_quantile(p: float, k: int) -> float:
    """Quantile of chi-squared by bisection on its distribution (series of the incomplete gamma function)."""

    def below(x: float) -> float:
        if x <= 0:
            return 0.0
        a, half = k / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-14:
            n += 1
            term *= half / n
            total += term
        return total * math.exp(-half + a * math.log(half) - math.lgamma(a))

    low, high = 0.0, 10.0 * k + 50
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows that take part, v as doubles, of the most frequent length."""
    v = F.col(vec_col).cast("array<double>")
    fine = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    fine = fine.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0)).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    sizes = fine.groupBy(F.size("v").alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s").limit(1).collect()
    return fine.where(F.size("v") == (sizes[0]["s"] if sizes else 0))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """(class, ids, v): distinct vectors under their smallest id, with their `keep` smallest ids. Hot vectors are salted first."""
    salted = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("id", F.lit("salt")), F.lit(SALTS)))
    first = salted.withColumn("n", F.row_number().over(W.partitionBy("v", "salt").orderBy("id"))).where(F.col("n") <= keep).drop("n")
    best = first.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("n") <= keep)
    return best.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("class"), "ids", "v")


def directions(size: int, count: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, count))


def top_tree(points: np.ndarray, leaves: int) -> list[tuple]:
    """Nodes (axis, cut, left, right) of the top of the kd-tree; a leaf is (-1, number). Node 0 is the root."""
    nodes: list[tuple] = []
    made = 0

    def grow(part: np.ndarray, want: int) -> int:
        nonlocal made
        at = len(nodes)
        nodes.append(())
        spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(1)
        if want < 2 or len(part) < 2 or not spread.max() > 0:
            nodes[at] = (-1, made)
            made += 1
            return at
        axis = int(spread.argmax())
        cut = float(np.median(part[:, axis]))
        low = part[:, axis] < cut
        if not low.any():
            cut = float(part[part[:, axis] > cut, axis].min())
            low = part[:, axis] < cut
        a, b = grow(part[low], want // 2), grow(part[~low], want - want // 2)
        nodes[at] = (axis, cut, a, b)
        return at

    grow(points, max(1, leaves))
    return nodes


def leaf_of(nodes: list[tuple], points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int64)

    def walk(at: int, rows: np.ndarray) -> None:
        if nodes[at][0] < 0:
            out[rows] = nodes[at][1]
            return
        axis, cut, a, b = nodes[at]
        low = points[rows, axis] < cut
        walk(a, rows[low])
        walk(b, rows[~low])

    walk(0, np.arange(len(points)))
    return out


def leaves_within(nodes: list[tuple], point: np.ndarray, reach2: float) -> list[int]:
    """Leaves whose box comes within sqrt(reach2) of the point."""
    out, stack = [], [(0, np.zeros(len(point)))]
    while stack:
        at, off = stack.pop()
        if nodes[at][0] < 0:
            out.append(nodes[at][1])
            continue
        axis, cut, a, b = nodes[at]
        near, far = (a, b) if point[axis] < cut else (b, a)
        stack.append((near, off))
        beyond = off.copy()
        beyond[axis] = max(beyond[axis], abs(point[axis] - cut))
        if (beyond**2).sum() <= reach2:
            stack.append((far, beyond))
    return out


def buckets_of(points: np.ndarray) -> list[np.ndarray]:
    """The leaves of a kd-tree over the points, each of at most BUCKET rows unless the points are equal."""
    done, open_ = [], [np.arange(len(points))]
    while open_:
        rows = open_.pop()
        part = points[rows]
        spread = part.max(axis=0) - part.min(axis=0)
        if len(rows) <= BUCKET or not spread.max() > 0:
            done += [rows[i : i + BUCKET] for i in range(0, len(rows), BUCKET)]
            continue
        order = np.argsort(part[:, int(spread.argmax())], kind="stable")
        half = len(rows) // 2
        open_ += [rows[order[:half]], rows[order[half:]]]
    return done


def closest_rows(x: np.ndarray, points: np.ndarray, q: np.ndarray, asked: np.ndarray, bound: np.ndarray, k: int, stop: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (queries by k, -1 where there are fewer) of the rows verified as closest, and how many rows each query verified.

    Rows of x must be in the order in which ties are to be broken. A key holds the squared distance on
    a grid of 1e-12 of the longest vectors, then the row number, so one comparison settles both.
    """
    groups = buckets_of(points)
    low, high = np.stack([points[g].min(axis=0) for g in groups]), np.stack([points[g].max(axis=0) for g in groups])
    width, empty = max(1, int(len(x) - 1).bit_length()), np.iinfo(np.int64).max
    length2, points2 = (x * x).sum(axis=1), (points * points).sum(axis=1)
    out, verified = np.full((len(q), k), -1, np.int64), np.zeros(len(q), np.int64)
    for first in range(0, len(q), QUERIES_AT_ONCE):
        mine = slice(first, first + QUERIES_AT_ONCE)
        v, at = q[mine], asked[mine]
        v2, at2 = (v * v).sum(axis=1), (at * at).sum(axis=1)
        grid = (v2 + length2.max()) * 1e-12
        reach2 = np.zeros((len(v), len(groups)))
        for axis in range(points.shape[1]):
            reach2 += np.maximum(0, np.maximum(low[None, :, axis] - at[:, axis, None], at[:, axis, None] - high[None, :, axis])) ** 2
        order = np.argsort(reach2, axis=1, kind="stable")
        reach2 = np.take_along_axis(reach2, order, axis=1)
        best, kth2 = np.full((len(v), k), empty), bound[mine] ** 2
        done, step, live = 0, 2, np.arange(len(v))
        while done < len(groups):
            live = live[reach2[live, done] <= stop * kth2[live]]
            if not len(live):
                break
            upto = min(done + step, len(groups))
            keys = np.full((len(live), (upto - done) * BUCKET), empty)
            wanted = order[live, done:upto]
            # A bucket that is out of reach by now is left out, though a nearer one of this step is not.
            wanted = np.where(reach2[live, done:upto] <= stop * kth2[live, None], wanted, -1)
            flat = wanted.ravel()
            by_bucket = np.argsort(flat, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(flat[by_bucket]) != 0, True])
            for a, b in zip(edges[:-1], edges[1:]):
                bucket = flat[by_bucket[a]]
                if bucket < 0:
                    continue
                rows = groups[bucket]
                who, slot = np.divmod(by_bucket[a:b], upto - done)
                near2 = at2[live[who], None] + points2[rows][None] - 2 * (at[live[who]] @ points[rows].T)
                i, j = np.nonzero(near2 <= stop * kth2[live[who], None])
                if not len(i):
                    continue
                w, r = who[i], rows[j]
                d2 = np.maximum(0, v2[live[w]] + length2[r] - 2 * np.einsum("ij,ij->i", v[live[w]], x[r]))
                keys[w, slot[i] * BUCKET + j] = (np.rint(d2 / grid[live[w]]).astype(np.int64) << width) | r
                verified[first : first + len(v)] += np.bincount(live[w], minlength=len(v))
            both = np.concatenate([best[live], keys], axis=1)
            best[live] = np.partition(both, k - 1, axis=1)[:, :k]
            last = best[live].max(axis=1)
            found2 = np.where(last == empty, np.inf, (last >> width).astype(np.float64) * grid[live])
            kth2[live] = np.minimum(kth2[live], found2)
            done, step = upto, min(2 * step, MOST_BUCKETS_AT_ONCE)
        best.sort(axis=1)
        out[mine] = np.where(best == empty, -1, best & ((1 << width) - 1))
    return out, verified


def search_leaf(data: pd.DataFrame, asked: pd.DataFrame, project: np.ndarray, k: int, stop: float) -> pd.DataFrame:
    """For each query of a leaf the k + 1 closest classes there (its own may be one of them) that are not beyond its bound."""
    columns = ["query_class", "class", "score", "ids"]
    nothing = pd.DataFrame({"query_class": [], "class": [], "score": [], "ids": pd.Series([], dtype=object)}).astype({"query_class": "int64", "class": "int64", "score": "float64"})
    if not len(data) or not len(asked):
        return nothing
    data = data.sort_values("class")
    x = np.stack(data["v"].to_numpy()).astype(np.float64)
    q = np.stack(asked["v"].to_numpy()).astype(np.float64)
    names, ids, bound = data["class"].to_numpy(), data["ids"].to_numpy(), asked["bound"].to_numpy(np.float64)
    close, _ = closest_rows(x, x @ project, q, q @ project, bound, k + 1, stop)
    who, place = np.nonzero(close >= 0)
    rows = close[who, place]
    score = np.sqrt(((x[rows] - q[who]) ** 2).sum(axis=1))
    near = score <= bound[who]
    who, rows, score = who[near], rows[near], score[near]
    return pd.DataFrame({"query_class": asked["query_class"].to_numpy()[who], "class": names[rows], "score": score, "ids": list(ids[rows])}, columns=columns) if len(rows) else nothing


def nearest(vectors: DataFrame, id_col: str, vec_col: str, is_query, k: int = NEIGHBOURS, count: int = DIRECTIONS, certainty: float = CERTAINTY) -> DataFrame:
    """(query_id, rank, id, score): for each row that is_query (a condition on column id) holds for, its k nearest other rows."""
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_col, vec_col), "vectors")
    index = materialize(classes(rows, k + 1), "classes")
    n = index.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    size = len(index.first()["v"])
    project = directions(size, count)
    stop = chi_quantile(certainty, count)
    share = min(1.0, SAMPLE_ROWS / n)
    sample = index.where(F.pmod(F.xxhash64("class", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").limit(2 * SAMPLE_ROWS).toPandas()
    points = np.stack(sample["v"].to_numpy()) @ project if len(sample) else np.zeros((0, count))
    nodes = top_tree(points, max(1, min(math.ceil(n / LEAF_ROWS), len(points) // SAMPLE_IN_LEAF)))

    @F.pandas_udf("long")
    def leaf(v: pd.Series) -> pd.Series:
        return pd.Series(leaf_of(nodes, np.stack(v.to_numpy()).astype(np.float64) @ project) if len(v) else np.zeros(0, np.int64))

    @F.pandas_udf("array<long>")
    def in_reach(v: pd.Series, bound: pd.Series) -> pd.Series:
        return pd.Series([leaves_within(nodes, np.asarray(x, np.float64) @ project, stop * b * b if math.isfinite(b) else math.inf) for x, b in zip(v, bound)])

    data = materialize(index.withColumn("leaf", leaf("v")), "leaves")
    # At most SAMPLE_ROWS / SAMPLE_IN_LEAF leaves, whatever the table; larger ones are dealt in shards.
    sizes = {r["leaf"]: math.ceil(r["rows"] / LEAF_ROWS) for r in data.groupBy("leaf").agg(F.count("*").alias("rows")).collect()}
    shards = F.try_element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("leaf"))
    asked_ids = rows.where(is_query).select("id", "v").distinct()
    hit = data.join(asked_ids.select("v").distinct(), "v").select("v", F.col("class").alias("query_class"), "leaf")
    unique = materialize(hit, "query-classes")
    # A vector that many queries share is dealt over salts.
    salt = F.array(*[F.lit(i) for i in range(SALTS)])
    salted = asked_ids.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    asked = materialize(salted.join(unique.select("v", "query_class", F.explode(salt).alias("salt")), ["v", "salt"]).select("id", "query_class", "salt"), "queries")
    one_of = F.pmod(F.xxhash64("class", F.lit("shard")), shards)

    def search(queries: DataFrame) -> DataFrame:
        # A leaf's rows are copied once for each block of queries that it has itself, so mostly not at all, and those of a leaf without queries don't travel.
        waiting = {r["leaf"]: math.ceil(r["rows"] / QUERY_BLOCK) for r in queries.groupBy("leaf").agg(F.count("*").alias("rows")).collect()}
        if not waiting:
            return spark.createDataFrame([], FOUND)
        blocks = F.try_element_at(F.create_map(*[F.lit(x) for pair in waiting.items() for x in pair]), F.col("leaf"))
        copies = F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1))
        dealt = data.where(blocks.isNotNull()).withColumn("shard", one_of).withColumn("block", copies)
        each = F.explode(F.sequence(F.lit(0).cast("long"), shards.cast("long") - 1)).alias("shard")
        block = F.pmod(F.xxhash64("query_class"), blocks).cast("long")
        asked_in = queries.where(shards.isNotNull()).select("leaf", "query_class", "v", "bound", block.alias("block"), each)
        by = ["leaf", "shard", "block"]
        return dealt.groupBy(*by).cogroup(asked_in.groupBy(*by)).applyInPandas(lambda a, b: search_leaf(a, b, project, k, stop), FOUND)

    own = materialize(search(unique.withColumn("bound", F.lit(float("inf")))), "found-at-home")
    # Distance within which the own leaf already has enough ids.
    running = W.partitionBy("query_class").orderBy("score", "class").rowsBetween(W.unboundedPreceding, 0)
    bound = own.withColumn("have", F.sum(F.size("ids")).over(running)).where(F.col("have") > k).groupBy("query_class").agg(F.min("score").alias("bound"))
    bounded = materialize(unique.join(bound, "query_class", "left").fillna(float("inf"), ["bound"]), "bounds")
    away = bounded.withColumn("to", F.explode(in_reach("v", "bound"))).where(F.col("to") != F.col("leaf")).select("query_class", "v", "bound", F.col("to").alias("leaf"))
    away = materialize(away, "queries-away")
    found = own.unionByName(search(away))
    place = W.partitionBy("query_class").orderBy("score", "class")
    best = found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1)
    flat = best.select("query_class", "score", F.explode("ids").alias("id"))
    ranked = flat.withColumn("place", F.row_number().over(W.partitionBy("query_class").orderBy("score", "id"))).where(F.col("place") <= k + 1)
    lists = ranked.groupBy("query_class").agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("near"))
    # One list for all queries of a class; each leaves itself out.
    spread = lists.withColumn("salt", F.explode(salt))
    mine = asked.select(F.col("id").alias("query_id"), "query_class", "salt").join(spread, ["query_class", "salt"])
    near = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return mine.select("query_id", F.posexplode(near).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100, among all vectors."""
    out = nearest(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.pmod(F.col("id"), F.lit(100)) == 0)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
