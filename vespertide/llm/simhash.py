"""SimHash near-duplicates by a binary trie self-join.

Texts become 64-bit fingerprints of their word shingles. Equal fingerprints collapse to one node,
so a group of copies of any size is one row from here on. Nodes within `budget` differing bits
are linked by walking a binary trie against itself: node pairs go down together, differing bits
add up, and a pair is dropped as soon as it exceeds the budget.

One trie over everything would sit in one task. With k blocks of bits, two fingerprints within
the budget agree on at least k - budget of them, so every choice of that many blocks roots one
forest of tries: rows are dealt by the bits they agree on, and the walk covers the rest. k grows
with the number of fingerprints. A root with too many rows is dealt in shards, each pair of
shards in one task: no link is lost and no task holds more than two shards. A task returns a
spanning forest of its links, never all pairs; components come from large-star and small-star
steps over tables in the shared folder.

Cases: a null or empty text has fingerprint zero and is linked like any other; a null doc_id
gets a fingerprint and joins its component but never names one while an id is there; repeated
rows share fingerprint and component; an empty table gives an empty result; texts are hashed
whole, in blocks of bounded memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vespertide.llm.common import discard, hot_join, materialize, read_table, row_key, whole_text

SHINGLE_WORDS = 4
HASH_SEED = 42
BUDGET = 4
ROOT_ROWS = 1024
MEAN_ROOT_ROWS = 512
TASK_ROWS = 16_384
ROWS_TO_DEAL = 1_000_000
FRONTIER = 1 << 20
LEAF_ROWS = 16
HASH_BLOCK = 1 << 15
#: The near-duplicate stage: shingles that are compared, their least similarity, and the search for candidates.
COMPARED_WORDS = 5
SIMILARITY = 0.8
SEARCH_WORDS = 2
SEARCH_BUDGET = 8
#: Texts and shingles that one task compares; larger groups of candidates are compared in pairs of boxes of half as much.
GROUP_TEXTS = 2_048
GROUP_SHINGLES = 2_000_000
#: Most centres a large group sheds stars around before its boxes are compared.
MOST_CENTRES = 256
BROADCAST_KEYS = 200_000
SALTS = 32


def fingerprint(text: str, words_in_shingle: int = SHINGLE_WORDS) -> int:
    """64 bits, unsigned: a bit is 1 if over half of the shingle hashes have it. Lower-cases A-Z, splits at ASCII white space."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(min(words_in_shingle, len(words))))))
    left = max(1, len(words) - words_in_shingle + 1)
    hashes, ones, total = map(xxhash.xxh64_intdigest, shingles, repeat(HASH_SEED)), np.zeros(64, np.int64), left
    while left:
        block = np.fromiter(hashes, np.uint64, min(left, HASH_BLOCK))
        ones += np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        left -= len(block)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def with_fingerprint(df: DataFrame, text_col: str = "text", into: str = "fingerprint_bits", words_in_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """df with a long holding the 64 bits."""

    @F.pandas_udf("long")
    def bits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, words_in_shingle) for t in texts], np.uint64).view(np.int64))

    return df.withColumn(into, bits(whole_text(F.col(text_col))))


def leaf_pairs(bits: np.ndarray, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of pairs of leaves within the budget; of a leaf with itself each pair once."""
    step = max(1, FRONTIER // LEAF_ROWS**2)
    for first in range(0, len(alo), step):
        la, ha, lb, hb = (x[first : first + step] for x in (alo, ahi, blo, bhi))
        nb = hb - lb
        n = (ha - la) * nb
        which = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        a, b = la[which] + at // nb[which], lb[which] + at % nb[which]
        near = (a < b) & (np.bitwise_count(bits[a] ^ bits[b]) <= budget)
        yield a[near], b[near]


def walk_trie(roots: np.ndarray, bits: np.ndarray, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers, each once, of rows with one root and at most `budget` differing bits.

    Rows must be sorted by (root, bits) and distinct. A node at depth d is a run of rows that share
    root and d leading bits; a frontier holds node pairs (starts and ends of two runs) and their
    differing bits so far. Nodes of LEAF_ROWS rows or fewer are leaves: the rows of two of them are
    settled by counting the bits that differ in all. Frontiers longer than FRONTIER are split, so
    memory stays bounded.
    """
    n = len(bits)
    if n < 2:
        return
    edge = np.flatnonzero(np.r_[True, roots[1:] != roots[:-1], True])
    lo, hi = edge[:-1].astype(np.int64), edge[1:].astype(np.int64)
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(0, lo, hi, lo.copy(), hi.copy(), np.zeros(len(lo), np.int8))]
    while stack:
        depth, alo, ahi, blo, bhi, diff = stack.pop()
        if not len(alo):
            continue
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack += [(depth, *(x[:half] for x in (alo, ahi, blo, bhi, diff))), (depth, *(x[half:] for x in (alo, ahi, blo, bhi, diff)))]
            continue
        leaf = (ahi - alo <= LEAF_ROWS) & (bhi - blo <= LEAF_ROWS)
        if leaf.any():
            yield from leaf_pairs(bits, *(x[leaf] for x in (alo, ahi, blo, bhi)), budget)
            alo, ahi, blo, bhi, diff = (x[~leaf] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo) or depth == 64:
            continue
        # ones[i]: rows before i whose bit at this depth is set; within a run zeros come first.
        ones = np.r_[0, np.cumsum((bits >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)]
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        same = alo == blo
        parts = [(alo, amid, blo, bmid, diff, slice(None)), (amid, ahi, bmid, bhi, diff, slice(None)), (alo, amid, bmid, bhi, diff + 1, slice(None)), (amid, ahi, blo, bmid, diff + 1, ~same)]
        kept = []
        for k, (pl, ph, ql, qh, d, which) in enumerate(parts):
            ok = (ph > pl) & (qh > ql) & (d <= budget)
            if k < 2:
                ok &= ~(same & (ph - pl < 2))
            if k == 3:
                ok &= which
            kept.append([x[ok] for x in (pl, ph, ql, qh, d)])
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*kept))))


def spanning_forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each row the smallest row it is joined with through the pairs."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            la, lb = label[a], label[b]
            low = np.minimum(la, lb)
            if (la == lb).all():
                break
            np.minimum.at(label, la, low)
            np.minimum.at(label, lb, low)
            while (label != label[label]).any():
                label = label[label]
    return label


def block_choice(n: int, budget: int = BUDGET) -> tuple[int, int]:
    """(blocks, blocks that must agree) so that a root has few rows on average."""
    for k in range(budget + 1, 2 * budget + 1):
        if n / 2 ** (64 * (k - budget) / k) <= MEAN_ROOT_ROWS:
            return k, k - budget
    return 2 * budget, budget


def links(nodes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints (column bits) within the budget, as a forest per task."""
    n = nodes.count()
    k, agree = block_choice(n, budget)
    at = [64 * i // k for i in range(k + 1)]
    roots = []
    for number, blocks in enumerate(combinations(range(k), agree)):
        key = F.lit(0).cast("long")
        for i in blocks:
            width = at[i + 1] - at[i]
            part = F.shiftrightunsigned("bits", 64 - at[i + 1]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key = F.shiftleft(key, width).bitwiseOR(part)
        # The choice stands above all bits, as choices differ in their widths.
        roots.append(key.bitwiseOR(F.lit(number << 48).cast("long")))
    spread = max(1, math.ceil(n * math.comb(k, agree) / ROWS_TO_DEAL))
    dealt = nodes.select("bits").repartition(spread).select("bits", F.explode(F.array(*roots)).alias("root"))
    sizes = dealt.groupBy("root").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    crowded = materialize(sizes.where(F.col("rows") > ROOT_ROWS), "crowded-roots")
    if crowded.isEmpty():
        dealt = dealt.withColumn("shards", F.lit(0).cast("long"))
    else:
        # Each row of a crowded root goes to every pair of shards that its own shard is in.
        dealt = dealt.join(crowded, "root", "left").withColumn("of", F.ceil(F.col("rows") / ROOT_ROWS).cast("long"))
        own = F.pmod(F.xxhash64("bits", F.lit("shard")), F.col("of"))
        others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("of") - 1), lambda t: t != own)
        pair = F.transform(others, lambda t: F.least(t, own) * F.col("of") + F.greatest(t, own) + 1)
        dealt = dealt.withColumn("shards", F.explode(F.when(F.col("rows").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pair)))
    tasks = max(1, math.ceil(n * math.comb(k, agree) / TASK_ROWS))
    dealt = dealt.select("bits", "root", "shards", F.pmod(F.xxhash64("root", "shards"), F.lit(tasks)).alias("task"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        root = pd.factorize(pd.MultiIndex.from_frame(rows[["root", "shards"]]))[0]
        bits = rows["bits"].to_numpy(np.int64).view(np.uint64)
        order = np.lexsort((bits, root))
        root, bits = root[order], bits[order]
        label = spanning_forest(len(bits), walk_trie(root, bits, budget))
        joined = label != np.arange(len(bits))
        return pd.DataFrame({"a": bits[joined].view(np.int64), "b": bits[label[joined]].view(np.int64)})

    found = dealt.groupBy("task").applyInPandas(walk, "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) with a > b, of any shape, to stars: b is the smallest of a's component. Large-star and small-star in turn."""
    now = materialize(edges, "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or not mark["n"]:
            return now
        seen = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = materialize(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        discard(large)
        discard(now)
        now = small


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row per document: __vt_id, __vt_text_hash, bits, root (its component) and component_id."""
    marked = with_fingerprint(row_key(docs), into="bits").select("doc_id", "__vt_id", "__vt_text_hash", "bits")
    marked = materialize(marked, "fingerprints")
    nodes = materialize(marked.groupBy("bits").agg(F.min("doc_id").alias("first_id")), "nodes")
    stars = components(links(nodes.select("bits"), budget))
    rooted = nodes.join(stars.select(F.col("a").alias("bits"), F.col("b").alias("root")), "bits", "left").select("bits", "first_id", F.coalesce("root", "bits").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    member = rooted.select("bits", "root").join(named, "root")
    return marked.join(member, "bits")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str, words_in_shingle: int = COMPARED_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; of the whole sequence if it is shorter, none if it has no words."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(min(words_in_shingle, len(words))))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(HASH_SEED)), np.uint64))


def similar_groups(bits: np.ndarray, sets: list[np.ndarray], budget: int, similarity: float, label: np.ndarray | None = None, first: int = 0) -> np.ndarray:
    """Smallest row joined with each row by links within the budget whose sets are alike enough. Rows that are joined already are not compared.

    Rows may be joined from the start (label). With `first`, rows from there on are compared with those before it only.
    What a set shares with all others is counted at once, over lists of the rows that hold each of its shingles. Two empty sets are alike.
    """
    label = np.arange(len(sets)) if label is None else label.copy()
    sizes = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(sizes)
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(shingle, kind="stable")]
    lists = np.r_[0, np.cumsum(np.bincount(shingle))]
    for i in range(max(1, first), len(sets)):
        to = first or i
        # Sets of sizes too far apart can't be alike enough.
        fits = (np.minimum(sizes[:to], sizes[i]) >= similarity * np.maximum(sizes[:to], sizes[i])) & (np.bitwise_count(bits[:to] ^ bits[i]) <= budget) & (label[:to] != label[i])
        if not fits.any():
            continue
        mine = shingle[ends[i] - sizes[i] : ends[i]]
        n = lists[mine + 1] - lists[mine]
        at = np.repeat(lists[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(holders[at], minlength=len(sets))[:to]
        total = sizes[:to] + sizes[i] - both
        for j in np.flatnonzero(fits & ((total == 0) | (both >= similarity * total))):
            if label[j] != label[i]:
                low, high = sorted((label[i], label[j]))
                label[label == high] = low
    return label


def distinct_texts(docs: DataFrame) -> DataFrame:
    """One row per document: __vt_id, __vt_text_hash, bits of the search fingerprint and set_hash of the compared shingles."""

    @F.pandas_udf("bits long, set_hash long")
    def marks(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            bits = np.array([fingerprint(t, SEARCH_WORDS) for t in texts], np.uint64).view(np.int64)
            sets = np.array([xxhash.xxh64_intdigest(shingle_set(t).tobytes()) for t in texts], np.uint64).view(np.int64)
            yield pd.DataFrame({"bits": bits, "set_hash": sets})

    return row_key(docs).select("__vt_id", "__vt_text_hash", marks(whole_text(F.col("text"))).alias("m")).select("__vt_id", "__vt_text_hash", "m.*")


def small(df: DataFrame) -> DataFrame:
    """df, broadcast if its count allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def similar_groups_kept(docs: DataFrame, budget: int = SEARCH_BUDGET, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Marks of all documents (__vt_id, __vt_text_hash, bits, set_hash), and the key of the one document of each group of similar texts that stays.

    Candidates come from the trie over fingerprints of SEARCH_WORDS-word shingles: few edits move those less than
    longer ones. What the trie joins is compared by the shingle sets themselves: groups are the connected links of
    similarity or more, at every size. Groups of candidates within GROUP_TEXTS and GROUP_SHINGLES are settled each in one
    task. Larger ones first shed stars, which spares most of the comparisons: the texts closest to the majority of their
    bits are centres, each text is compared with the closest centre, and what is alike falls to it; centres grow sixteenfold
    from round to round, up to MOST_CENTRES. Then all texts that are not joined yet are compared across (links_across), so
    links between texts that fell to different centres count too. Equal texts are one from the start.
    """
    key = ["bits", "set_hash"]
    place = F.struct(F.col("__vt_id").isNull().alias("no_id"), "__vt_id", "__vt_text_hash")
    marked = materialize(distinct_texts(docs), "text-marks")
    nodes = materialize(marked.groupBy(*key).agg(F.min(place).alias("first")), "distinct-texts")
    stars = components(links(nodes.select("bits").distinct(), budget))
    rooted = materialize(nodes.join(stars.select(F.col("a").alias("bits"), F.col("b").alias("root")), "bits", "left").select(*key, "first", F.coalesce("root", "bits").alias("root")), "rooted-texts")
    many = rooted.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    wanted = materialize(rooted.join(small(many), "root"), "candidate-texts")

    @F.pandas_udf("array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(t).view(np.int64) for t in texts])

    keys = wanted.select("root", *key, "first", F.col("first.__vt_id").alias("__vt_id"), F.col("first.__vt_text_hash").alias("__vt_text_hash"))
    a, b = row_key(docs).select("__vt_id", "__vt_text_hash", "text").alias("a"), small(keys).alias("b")
    same = F.col("a.__vt_id").eqNullSafe(F.col("b.__vt_id")) & (F.col("a.__vt_text_hash") == F.col("b.__vt_text_hash"))
    texts = a.join(b, same).select("b.root", "b.bits", "b.set_hash", "b.first", sets(whole_text(F.col("a.text"))).alias("shingles"))
    open_ = materialize(texts.dropDuplicates(key), "candidate-shingles")

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.sort_values(["no_id", "__vt_id", "__vt_text_hash"]).groupby("root"):
            bits, names = part["bits"].to_numpy(np.int64), part["set_hash"].to_numpy(np.int64)
            label = similar_groups(bits.view(np.uint64), [np.asarray(x, np.int64).view(np.uint64) for x in part["shingles"]], budget, similarity)
            out.append(pd.DataFrame({"bits": bits, "set_hash": names, "to_bits": bits[label], "to_set": names[label]}))
        return pd.concat(out)

    settled: list[DataFrame] = []
    centres, whole = 1, None
    while True:
        size = open_.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.size("shingles").cast("long")).alias("s"))
        size = materialize(size.withColumn("large", (F.col("n") > GROUP_TEXTS) | ((F.col("s") > GROUP_SHINGLES) & (F.col("n") > 1))), "group-sizes")
        large = small(size.where("large").select("root"))
        total = size.where("not large").agg(F.sum("s").alias("s")).first()["s"] or 0
        task = F.pmod(F.xxhash64("root"), F.lit(max(1, math.ceil(total / GROUP_SHINGLES)))).alias("task")
        ready = open_.join(large, "root", "left_anti").select(task, "root", *key, "first.*", "shingles")
        settled.append(materialize(ready.groupBy("task").applyInPandas(settle, "bits long, set_hash long, to_bits long, to_set long"), "settled"))
        if size.where("large").isEmpty():
            break
        rest = materialize(open_.join(large, "root", "left_semi"), "large-groups")
        whole = whole or rest
        if centres > MOST_CENTRES:
            settled.append(rest.select(*key, F.col("bits").alias("to_bits"), F.col("set_hash").alias("to_set")))
            break
        left = materialize(fallen(rest, materialize(star_centres(rest.select("root", *key), centres), "centres"), budget, similarity), "fallen")
        settled.append(left.where("to_bits is not null").select(*key, "to_bits", "to_set"))
        discard(open_)
        open_, centres = materialize(rest.join(left.where("to_bits is null").select(*key), key, "left_semi"), "left-texts"), centres * 16
        if rest is not whole:
            discard(rest)
    moved = settled[0]
    for x in settled[1:]:
        moved = moved.unionByName(x)
    to = F.struct(F.coalesce("to_bits", "bits").alias("bits"), F.coalesce("to_set", "set_hash").alias("set_hash")).alias("to")
    ends = nodes.join(moved, key, "left").select("first", to).groupBy("to").agg(F.min("first").alias("first"))
    if whole is not None:
        placed = materialize(whole.select("root", *key, "shingles").join(moved, key).select("root", *key, "shingles", to), "placed-texts")
        further = components(links_across(placed, budget, similarity))
        ends = ends.join(further, F.col("to") == F.col("a"), "left").select(F.coalesce("b", "to").alias("to"), "first")
    kept = ends.groupBy("to").agg(F.min("first").alias("k")).select("k.__vt_id", "k.__vt_text_hash")
    return marked, kept


def links_across(rows: DataFrame, budget: int, similarity: float) -> DataFrame:
    """Edges (a, b) between the stars (column to) of large groups (root, to, bits, set_hash, shingles) that further links join.

    Stars of more than half a task's texts or shingles fill boxes of their own, the others of a group share boxes. Each pair of
    boxes is one task; boxes of one star are not paired, as it is joined already. So a text of a star that holds nearly all
    of its group is copied as often as there are boxes of the rest, and no task holds more than two boxes.
    """
    boxes_of = F.greatest(F.ceil(F.col("n") / max(1, GROUP_TEXTS // 2)), F.ceil(F.col("s") / max(1, GROUP_SHINGLES // 2)), F.lit(1)).cast("int")
    stars = materialize(rows.groupBy("root", "to").agg(F.count("*").alias("n"), F.sum(F.size("shingles").cast("long")).alias("s")).withColumn("own", boxes_of), "stars")
    shared = materialize(stars.where("own = 1").groupBy("root").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).select("root", boxes_of.alias("shared")), "shared-boxes")
    none = F.struct(F.lit(0).cast("long").alias("bits"), F.lit(0).cast("long").alias("set_hash"))
    numbers = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1)).alias("i")
    large = stars.where("own > 1").select("root", F.lit(True).alias("alone"), F.col("to").alias("star"), numbers("own"))
    boxes = materialize(large.unionByName(shared.select("root", F.lit(False).alias("alone"), none.alias("star"), numbers("shared"))), "boxes")
    box = F.struct("alone", "star", "i").alias("box")
    x, y = boxes.select("root", box).alias("x"), boxes.select("root", box).alias("y")
    paired = (F.col("x.root") == F.col("y.root")) & (F.col("x.box") <= F.col("y.box")) & (~F.col("x.box.alone") | (F.col("x.box.star") != F.col("y.box.star")))
    pairs = materialize(x.join(y, paired).select("x.root", F.col("x.box").alias("one"), F.col("y.box").alias("other"), F.monotonically_increasing_id().alias("pair")), "box-pairs")
    alike = F.col("one") == F.col("other")
    asked = pairs.select("root", F.col("one").alias("box"), "pair", F.lit(0).alias("side"), alike.alias("alike"))
    asked = asked.unionByName(pairs.where(~alike).select("root", F.col("other").alias("box"), "pair", F.lit(1).alias("side"), F.lit(False).alias("alike")))
    sized = hot_join(stars.select("root", "to", "own"), shared, "root", "left").select("to", "own", "shared")
    alone = F.col("own") > 1
    number = F.pmod(F.xxhash64("bits", "set_hash"), F.when(alone, F.col("own")).otherwise(F.col("shared"))).cast("int").alias("i")
    own = F.struct(alone.alias("alone"), F.when(alone, F.col("to")).otherwise(none).alias("star"), number).alias("box")
    boxed = hot_join(rows, sized, "to").select("root", own, "bits", "set_hash", "shingles", F.col("to.bits").alias("to_bits"), F.col("to.set_hash").alias("to_set"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("side", kind="stable")
        star = pd.factorize(pd.MultiIndex.from_frame(part[["to_bits", "to_set"]]))[0]
        before = np.unique(star, return_index=True)[1][star]
        first = 0 if part["alike"].iloc[0] else int((part["side"] == 0).sum())
        names = part[["to_bits", "to_set"]].to_numpy(np.int64)
        after = before
        if part["alike"].iloc[0] or 0 < first < len(part):
            sets = [np.asarray(v, np.int64).view(np.uint64) for v in part["shingles"]]
            after = similar_groups(part["bits"].to_numpy(np.int64).view(np.uint64), sets, budget, similarity, before, first)
        moved = np.flatnonzero((after != before) & (before == np.arange(len(part))))
        a, b = names[moved], names[after[moved]]
        return pd.DataFrame({"ab": a[:, 0], "as": a[:, 1], "bb": b[:, 0], "bs": b[:, 1]})

    found = boxed.join(asked, ["root", "box"]).groupBy("pair").applyInPandas(compare, "ab long, `as` long, bb long, bs long")
    a, b = F.struct(F.col("ab").alias("bits"), F.col("`as`").alias("set_hash")), F.struct(F.col("bb").alias("bits"), F.col("bs").alias("set_hash"))
    return found.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()


def salted(rows: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    """Join in which one key of rows may be hot: each row has one salt, each row of the side all of them."""
    names = [c for c in rows.columns if c not in on] + [c for c in side.columns if c not in on]
    dealt = side.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("salt", F.pmod(F.xxhash64("bits", "set_hash"), F.lit(SALTS)).cast("int")).join(dealt, [*on, "salt"]).select(*on, *names)


def star_centres(rows: DataFrame, count: int) -> DataFrame:
    """(root, centres): for each root the fingerprints and sets of at most count texts near the majority, from weights by bit summed in Spark."""
    bit = lambda i: F.shiftrightunsigned("bits", 63 - i).bitwiseAND(F.lit(1))
    sums = rows.groupBy("root").agg(F.count("*").alias("n"), *[F.sum(bit(i)).alias(f"b{i}") for i in range(64)])
    middle = F.lit(0).cast("long")
    for i in range(64):
        middle = middle.bitwiseOR(F.when(F.col(f"b{i}") * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), 63 - i)).otherwise(F.lit(0).cast("long")))
    off = salted(rows, sums.select("root", middle.alias("middle")), ["root"]).withColumn("off", F.bit_count(F.col("bits").bitwiseXOR(F.col("middle"))))
    # Partial top lists by salt first, so that no task orders a whole group.
    spread = W.partitionBy("root", F.pmod(F.xxhash64("bits", "set_hash"), F.lit(SALTS))).orderBy("off", "bits", "set_hash")
    some = off.withColumn("r", F.row_number().over(spread)).where(F.col("r") <= count)
    best = some.withColumn("r", F.row_number().over(W.partitionBy("root").orderBy("off", "bits", "set_hash"))).where(F.col("r") <= count)
    return best.select("root", "bits", "set_hash")


def fallen(rows: DataFrame, centres: DataFrame, budget: int, similarity: float) -> DataFrame:
    """bits, set_hash, and the centre (to_bits, to_set) that each row falls to: the closest one, if within the budget and alike enough; a centre falls to itself."""
    own = centres.select("root", F.col("bits").alias("to_bits"), F.col("set_hash").alias("to_set"))
    sets_ = own.join(rows.select(F.col("bits").alias("to_bits"), F.col("set_hash").alias("to_set"), F.col("shingles").alias("to_shingles")), ["to_bits", "to_set"])
    choice = own.groupBy("root").agg(F.collect_list(F.struct("to_bits", "to_set")).alias("all"))
    far = lambda c: F.bit_count(F.col("bits").bitwiseXOR(c["to_bits"])) + F.when((c["to_bits"] == F.col("bits")) & (c["to_set"] != F.col("set_hash")), F.lit(1)).otherwise(F.lit(0))
    near = F.array_min(F.transform("all", lambda c: F.struct(far(c).alias("far"), c["to_bits"].alias("to_bits"), c["to_set"].alias("to_set"))))
    asked = salted(rows.select("root", "bits", "set_hash", "shingles"), choice, ["root"]).select("root", "bits", "set_hash", "shingles", near.alias("c")).select("root", "bits", "set_hash", "shingles", "c.to_bits", "c.to_set")
    met = salted(asked, sets_, ["root", "to_bits", "to_set"])
    both = F.size(F.array_intersect("shingles", "to_shingles"))
    total = F.size("shingles") + F.size("to_shingles") - both
    alike = (F.bit_count(F.col("bits").bitwiseXOR(F.col("to_bits"))) <= budget) & ((total == 0) | (both >= similarity * total))
    return met.select("bits", "set_hash", F.when(alike, F.col("to_bits")).alias("to_bits"), F.when(alike, F.col("to_set")).alias("to_set"))


def keep_one(docs: DataFrame, budget: int = SEARCH_BUDGET, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group of similar texts: the one of the smallest doc_id (null last); repeated rows of it fall together."""
    marked, kept = similar_groups_kept(docs.select("doc_id", "text"), budget, similarity)
    kept = materialize(kept, "kept")
    keyed = row_key(docs)
    one = keyed.alias("d").join(kept.alias("k"), F.col("d.__vt_id").eqNullSafe(F.col("k.__vt_id")) & (F.col("d.__vt_text_hash") == F.col("k.__vt_text_hash")), "left_semi")
    if marked.count() > marked.select("__vt_id", "__vt_text_hash").distinct().count():
        one = one.dropDuplicates(["__vt_id", "__vt_text_hash"])
    return one.select(*docs.columns)
