"""Similarity signals over the items, sparse and dense, in one relational form.

A sparse signal is a long table (id, term, w) of unit rows, whatever its terms are: tokens, users or
neighbours. A dense one is (id, vec) of unit vectors. Both answer the same two questions as tables with
a row for every covered item: similarities to seed items, and similarities to a query. An item without
a row is not covered, and the signal abstains on it.

Seeds and queries are a request's own few items, so that side is small by contract (a profile has 60
items at most) and broadcast; items are never paired with items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vespertide.functions import text as T
from vespertide.operators.common import content_mark, dropped, kept, literal_rows, saved, small, with_one_row
from vespertide.operators.encode import Encoder, encoded, hashing, query_encoder
from vespertide.operators.factors import truncated
from vespertide.settings import DEFAULTS, Settings


def unit_rows(weights: DataFrame) -> DataFrame:
    """(id, term, w) with rows of length one."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))
    return weights.withColumn("norm", norm).where("norm > 0").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


def unit_vector(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    # The norm is a column of its own here; named inside a lambda it would be taken anew for every component.
    return F.when(norm > 0, F.zip_with(v, F.array_repeat(norm, F.size(v)), lambda x, n: x / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Products of a batch that are held at once.
PRODUCTS = 1_000_000


def products(seeds: list[int], vectors: list[list[float]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (id, vec): (seed, id, s), the product of every row with each of a request's few vectors, null where lengths differ.

    Components are added one after the other, so equal vectors have equal products wherever they stand.
    """
    groups: dict[int, list[int]] = {}
    for n, v in enumerate(vectors):
        groups.setdefault(len(v), []).append(n)
    names = np.array(seeds, np.int64)

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, PRODUCTS // max(1, len(names)))
            for at in range(0, batch.num_rows if len(names) else 0, step):
                part = batch.slice(at, step)
                ids, vec = part.column("id"), part.column("vec")
                sizes = pc.list_value_length(vec).to_numpy(zero_copy_only=False)
                s = np.zeros((len(ids), len(names)))
                there = np.zeros(s.shape, bool)
                for size, which in groups.items():
                    rows = np.flatnonzero(sizes == size)
                    x = vec.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)
                    y = np.array([vectors[n] for n in which], np.float64).reshape(len(which), size)
                    total = np.zeros((len(rows), len(which)))
                    for i in range(size):
                        total += x[:, i, None] * y[None, :, i]
                    s[np.ix_(rows, which)], there[np.ix_(rows, which)] = total, True
                each = ids.take(pa.array(np.repeat(np.arange(len(ids)), len(names))))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(names, len(ids))), each, pa.array(s.ravel(), mask=~there.ravel())], ["seed", "id", "s"])

    return multiplied


# TF-IDF ------------------------------------------------------------------------------------------------


def informed(items: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(id, soup, and what it is made of) of the items that say enough to be compared."""
    return items.withColumn("soup", T.soup(settings.soup_weights)).where(T.soup_token_count(F.col("soup")) >= settings.min_soup_tokens)


def term_counts(items: DataFrame) -> DataFrame:
    """(id, term, tf) of soups."""
    return items.select("id", F.explode(T.tokens(F.col("soup"))).alias("term")).groupBy("id", "term").agg(F.count("*").cast("int").alias("tf"))


def term_weights(counts: DataFrame, min_df: int = DEFAULTS.min_df) -> DataFrame:
    """(term, df, idf) with smoothed idf; terms of fewer than min_df items match nothing and are left out."""
    n = counts.agg(F.count_distinct("id").alias("n"))
    df = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    return with_one_row(df, n).select("term", "df", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(id, term, w): sublinear tf times idf, rows of length one."""
    return unit_rows(counts.join(idf, "term").select("id", "term", ((1 + F.ln("tf")) * F.col("idf")).alias("w")))


def encoded_terms(terms: list[str], idf: DataFrame) -> DataFrame:
    """(term, w) of a query under a fitted idf: unknown terms vanish, then length one. No rows: nothing known."""
    asked = literal_rows(idf.sparkSession, [(t.lower().replace(" ", ""),) for t in terms if t], "raw string")
    tf = asked.select(F.explode(T.tokens(F.col("raw"))).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
    w = idf.join(F.broadcast(tf), "term").select("term", ((1 + F.ln("tf")) * F.col("idf")).alias("w"))
    norm = w.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return with_one_row(w, norm).select("term", (F.col("w") / F.col("norm")).alias("w"))


# Signals -----------------------------------------------------------------------------------------------


@dataclass
class SparseSignal:
    """weights: (id, term, w) of unit rows. ids: covered items. idf: for queries, if terms are words."""

    name: str
    weights: DataFrame
    ids: DataFrame
    idf: DataFrame | None = None

    def covered(self) -> DataFrame:
        return self.ids

    def to_seeds(self, seeds: DataFrame) -> DataFrame:
        """(seed, id, s) of every covered item to each covered seed; seeds: (seed)."""
        own = self.weights.join(F.broadcast(seeds), self.weights["id"] == seeds["seed"]).select("seed", "term", F.col("w").alias("sw"))
        # The seeds' own rows hold all raters or neighbours they have, so their number is counted.
        met = self.weights.join(small(own), "term").groupBy("seed", "id").agg(F.sum(F.col("w") * F.col("sw")).alias("s"))
        grid = self.ids.crossJoin(F.broadcast(own.select("seed").distinct()))
        return grid.join(met, ["seed", "id"], "left").select("seed", "id", F.coalesce("s", F.lit(0.0)).alias("s"))

    def to_query(self, text: str, keywords: list[str]) -> DataFrame | None:
        """(id, s); None where the signal cannot encode text. Words of the text don't count here, keywords do."""
        if self.idf is None or not any(keywords or []):
            return None
        query = encoded_terms(keywords, self.idf)
        met = self.weights.join(F.broadcast(query.withColumnRenamed("w", "qw")), "term").groupBy("id").agg(F.sum(F.col("w") * F.col("qw")).alias("s"))
        return self.ids.join(met, "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("s"))


@dataclass
class DenseSignal:
    """rows: (id, vec) of unit vectors. encode: text to a unit vector, or None."""

    name: str
    rows: DataFrame
    encode: object = None

    def covered(self) -> DataFrame:
        return self.rows.select("id")

    def to_seeds(self, seeds: DataFrame) -> DataFrame:
        own = self.rows.join(F.broadcast(seeds), self.rows["id"] == seeds["seed"]).select("seed", "vec").collect()
        return self.rows.mapInArrow(products([r["seed"] for r in own], [r["vec"] for r in own]), "seed long, id long, s double")

    def to_query(self, text: str, keywords: list[str]) -> DataFrame | None:
        vector = self.encode(text, keywords) if self.encode else None
        if vector is None or not any(vector):
            return None
        return self.rows.select("id", dot(F.col("vec"), F.array(*[F.lit(float(x)) for x in vector])).alias("s"))


def metadata_signal(items: DataFrame, settings: Settings = DEFAULTS) -> SparseSignal:
    counts = kept(term_counts(informed(items, settings)))
    idf = kept(term_weights(counts, settings.min_df))
    return SparseSignal("metadata", kept(tfidf(counts, idf)), kept(counts.select("id").distinct()), idf)


def saved_metadata(items: DataFrame, sources: list[str], settings: Settings = DEFAULTS) -> SparseSignal:
    """metadata_signal with its tables saved, for as long as the sources stay as they are, for these items and settings."""
    spark = items.sparkSession
    made_of = [asdict(settings), content_mark(items)]
    counts = saved(spark, "metadata-counts", sources, lambda: term_counts(informed(items, settings)), made_of)
    idf = saved(spark, "metadata-idf", sources, lambda: term_weights(counts, settings.min_df), made_of)
    weights = saved(spark, "metadata-weights", sources, lambda: tfidf(counts, idf), made_of)
    return SparseSignal("metadata", weights, saved(spark, "metadata-ids", sources, lambda: counts.select("id").distinct(), made_of), idf)


def saved_dense(name: str, items: DataFrame, vectors: DataFrame, sources: list[str], encode=None) -> DenseSignal:
    """dense_signal with its rows saved likewise."""
    made_of = [name, content_mark(items), vectors.semanticHash()]
    rows = saved(items.sparkSession, f"{name}-rows", sources, lambda: dense_rows(items, vectors), made_of)
    return DenseSignal(name, rows, encode)


def frozen_rows(items: DataFrame, idf: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(id, term, w) of items outside the corpus under its fitted weights: unknown terms vanish, nothing is fitted anew."""
    return tfidf(term_counts(items.withColumn("soup", T.soup(settings.soup_weights))), idf)


def augmented(signal: SparseSignal, items: DataFrame, settings: Settings = DEFAULTS) -> SparseSignal:
    """The signal with items from outside, in the frozen space of the corpus; those it has already stay as they are."""
    new = items.join(signal.ids, "id", "left_anti")
    rows = kept(frozen_rows(new, signal.idf, settings))
    return SparseSignal(signal.name, signal.weights.unionByName(rows), signal.ids.unionByName(rows.select("id").distinct()), signal.idf)


def dense_signal(name: str, items: DataFrame, vectors: DataFrame, encode=None) -> DenseSignal:
    """Vectors aligned with the corpus: items without a vector are not covered, vectors without an item vanish."""
    return DenseSignal(name, kept(dense_rows(items, vectors)), encode)


def dense_rows(items: DataFrame, vectors: DataFrame) -> DataFrame:
    unit = vectors.select("id", unit_vector(F.col("vec")).alias("vec")).where("vec IS NOT NULL")
    return unit.join(items.select("id"), "id", "left_semi")


def bucket_of(token: Column, size: int) -> Column:
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 6), 16, 10).cast("int") % size


def encoded_documents(docs: DataFrame, size: int) -> DataFrame:
    """(id, vec): unit vectors of token counts hashed to `size` places, for corpora without a trained encoder. docs: (id, document), each id once."""
    found = F.transform(F.regexp_extract_all(F.lower(F.coalesce("document", F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0)), lambda t: bucket_of(t, size))
    counted = docs.select("id", F.explode(found).alias("b")).groupBy("id", "b").agg(F.count("*").cast("double").alias("n")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return counted.select("id", unit_vector(vec).alias("vec"))


def encoded_signal(name: str, docs: DataFrame, encoder: Encoder | int) -> DenseSignal:
    """A dense signal over documents that encodes free text as it encodes them. encoder: or the number of places of a hashing one. docs: (id, document), each id once."""
    if isinstance(encoder, int):
        encoder = hashing(encoder)
    return DenseSignal(name, kept(encoded(docs, encoder)), query_encoder(encoder))


def linked_ratings(ratings: DataFrame, links: DataFrame, items: DataFrame) -> DataFrame:
    """(user, item, rating) of rated things that are items: rating ids lead to items by links, and both sides of a link count once.

    ratings: (user, rated, rating); links: (rated, id), id null where there is no link; of several links of one rated thing the smallest id counts.
    """
    once = links.where("id IS NOT NULL").groupBy("rated").agg(F.min("id").alias("item"))
    known = once.join(items.select(F.col("id").alias("item")), "item", "left_semi")
    return ratings.join(small(known), "rated").select("user", "item", "rating")


def covered_profile(signal, liked: DataFrame) -> DataFrame:
    """liked without the items the signal has no vector of, and so without their ratings: what is left is rated in full."""
    return liked.join(signal.covered().withColumnRenamed("id", "seed"), "seed", "left_semi")


def collab_matrix(ratings: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(item, user, v) of strong ratings, 1 to 2; a pair given twice adds up."""
    span = max(5.0 - settings.collab_min_rating, 0.5)
    value = 1 + (F.col("rating") - settings.collab_min_rating) / span
    return ratings.where(F.col("rating") >= settings.collab_min_rating).groupBy("item", "user").agg(F.sum(value).alias("v"))


def damped(matrix: DataFrame) -> DataFrame:
    """First prolific users are damped, then items by what is left of their sums."""
    by_user = matrix.groupBy("user").agg((1 / F.sqrt(F.greatest(F.sum("v"), F.lit(1.0)))).alias("uw"))
    once = matrix.join(by_user, "user").select("item", "user", (F.col("v") * F.col("uw")).alias("v"))
    by_item = once.groupBy("item").agg((1 / F.sqrt(F.greatest(F.sum("v"), F.lit(1.0)))).alias("iw"))
    return once.join(by_item, "item").select("item", "user", (F.col("v") * F.col("iw")).alias("v"))


def supported(matrix: DataFrame, least: int = DEFAULTS.collab_min_ratings) -> DataFrame:
    """(item, raters) of items that enough users rated; matrix has a pair once."""
    return matrix.groupBy("item").agg(F.count("*").alias("raters")).where(F.col("raters") >= least)


def collab_signal(items: DataFrame, ratings: DataFrame, settings: Settings = DEFAULTS) -> SparseSignal:
    """Cosines of damped rows: what factors of full rank give."""
    matrix = kept(collab_matrix(ratings.join(items.select(F.col("id").alias("item")), "item", "left_semi"), settings))
    ids = kept(supported(matrix, settings.collab_min_ratings).select(F.col("item").alias("id")))
    rows = damped(matrix).select(F.col("item").alias("id"), F.col("user").alias("term"), F.col("v").alias("w"))
    return SparseSignal("collab", kept(unit_rows(rows.join(ids, "id", "left_semi"))), ids)


def collab_factors(items: DataFrame, ratings: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(id, vec): truncated factors U*S of the damped matrix, rows of length one.

    Row inner products don't depend on how users are numbered or factors rotated, so only cosines mean something.
    """
    matrix = kept(collab_matrix(ratings.join(items.select(F.col("id").alias("item")), "item", "left_semi"), settings))
    rows = damped(matrix).join(supported(matrix, settings.collab_min_ratings), "item", "left_semi")
    found = truncated(rows.select(F.col("item").alias("row"), F.col("user").alias("col"), "v"), settings.collab_factors)
    dropped(matrix)
    return found.select("id", unit_vector(F.col("vec")).alias("vec")).where("vec IS NOT NULL")


def adjacency(items: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, w): discounted by rank, the larger way round counts for both, every item its own neighbour.

    Ranks count places in the whole list, also those of neighbours outside the corpus.
    """
    ids = items.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").where("src <> dst")
    one_way = inside.select("src", "dst", (1 / F.log2(F.col("rank") + 2)).alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    both = one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    loops = ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    return both.groupBy("src", "dst").agg(F.max("w").alias("w")).unionByName(loops)


def graph_coverage(adjacent: DataFrame) -> DataFrame:
    """(id, degree) of items that have a neighbour besides themselves."""
    return adjacent.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")).where("degree > 1")


def graph_signal(items: DataFrame, edges: DataFrame, factors: int = 0) -> SparseSignal | DenseSignal:
    """Cosines of rows of the adjacency, or of so many factors of it; items that are linked to nothing are not covered."""
    adjacent = kept(adjacency(items, edges))
    ids = kept(graph_coverage(adjacent).select("id"))
    if factors:
        found = truncated(adjacent.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("w").alias("v")), factors)
        unit = found.select("id", unit_vector(F.col("vec")).alias("vec")).where("vec IS NOT NULL")
        return DenseSignal("graph", kept(unit.join(ids, "id", "left_semi")))
    rows = adjacent.select(F.col("src").alias("id"), F.col("dst").alias("term"), "w")
    return SparseSignal("graph", kept(unit_rows(rows.join(ids, "id", "left_semi"))), ids)


def graph_of_unknown(neighbours: list[int], items: DataFrame) -> DataFrame:
    """(term, w) of an item outside the corpus: its known neighbours, all alike, of length one."""
    asked = literal_rows(items.sparkSession, [(n,) for n in dict.fromkeys(neighbours)], "term long")
    known = items.select(F.col("id").alias("term")).join(F.broadcast(asked), "term", "left_semi")
    return with_one_row(known, known.agg(F.count("*").alias("n"))).select("term", (1 / F.sqrt("n")).alias("w"))


def profile_scores(signal, liked: DataFrame, settings: Settings = DEFAULTS, rated: bool = True) -> DataFrame:
    """(id, s): half how well an item fits the liked ones as a whole, half how well it fits the few it fits best.

    liked: (seed, rating). A centroid's cosine needs only similarities to the liked items: its product
    with an item is their weighted sum, its length the same sum over the liked ones. If one of them lacks
    a vector in this signal, ratings don't count there.
    """
    k = settings.taste_top_k
    sims = kept(signal.to_seeds(liked.select("seed")))
    if rated:
        # Ratings count only where every liked item has a vector here.
        n = liked.agg(F.count("*").alias("n_liked"))
        here = liked.join(signal.covered().withColumnRenamed("id", "seed"), "seed", "left_semi")
        full = with_one_row(here.agg(F.count("*").alias("n_here")), n).select((F.col("n_here") == F.col("n_liked")).alias("full"))
        weights = with_one_row(liked, full).select("seed", F.when(F.col("full"), F.greatest(F.col("rating") - 2.5, F.lit(0.1))).otherwise(1.0).alias("lw"))
    else:
        weights = liked.select("seed", F.lit(1.0).alias("lw"))
    weighted = sims.join(F.broadcast(weights), "seed")
    by_item = weighted.groupBy("id").agg(F.sum(F.col("lw") * F.col("s")).alias("along"), F.array_sort(F.collect_list("s"), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)).alias("ordered"))
    own = by_item.join(F.broadcast(weights), F.col("id") == F.col("seed")).agg(F.sqrt(F.sum(F.col("lw") * F.col("along"))).alias("length"))
    best = F.slice("ordered", 1, k)
    mean_best = F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best)
    centroid = F.when(F.col("length") > 0, F.col("along") / F.col("length")).otherwise(0.0)
    alpha = settings.centroid_weight
    return with_one_row(by_item, own).select("id", (alpha * centroid + (1 - alpha) * mean_best).alias("s"))


def aligned(items: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """Every item with its vector, or a zero vector that doesn't count as covered."""
    zero = F.array_repeat(F.lit(0.0), size)
    return items.select("id").join(vectors.select("id", "vec"), "id", "left").select("id", F.coalesce("vec", zero).alias("vec"), F.col("vec").isNotNull().alias("covered"))


def coverage(signal, items: DataFrame) -> DataFrame:
    """(signal, items, covered, share)."""
    marked = items.select("id").join(signal.covered().withColumn("c", F.lit(1)), "id", "left")
    return marked.agg(F.count("*").alias("items"), F.count("c").alias("covered")).select(F.lit(signal.name).alias("signal"), "items", "covered", F.try_divide("covered", "items").alias("share"))


def legacy_taste(weights: DataFrame, liked: DataFrame, disliked: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(term, w): weighted mean of liked rows less a share of the mean of disliked ones, nothing below zero."""
    lw = F.greatest(F.col("rating") - 2.5, F.lit(0.1))
    good = weights.join(F.broadcast(liked), weights["id"] == liked["seed"]).groupBy("term").agg(F.sum(F.col("w") * lw).alias("up"))
    total = liked.agg(F.sum(lw).alias("total"))
    bad = weights.join(F.broadcast(disliked), weights["id"] == disliked["seed"]).groupBy("term").agg(F.sum("w").alias("down"))
    count = disliked.agg(F.count("*").alias("n"))
    both = with_one_row(with_one_row(good.join(bad, "term", "left"), total), count)
    down = F.coalesce(F.try_divide(F.col("down"), F.col("n")), F.lit(0.0))
    return both.select("term", F.greatest(F.lit(0.0), F.col("up") / F.col("total") - settings.negative_weight * down).alias("w")).where("w > 0")


def reference_terms(signal: SparseSignal, seeds: DataFrame, keywords: list[str] | None, keyword_weight: float = 0.35) -> DataFrame:
    """(term, w): the mean of the rows of named items and of loose keywords, which count less beside items and whole without any. No rows: nothing known. seeds: (seed)."""
    spark = signal.weights.sparkSession
    rows = signal.weights.join(F.broadcast(seeds), signal.weights["id"] == seeds["seed"], "left_semi").select(F.lit(1.0).alias("share"), "term", "w", F.col("id").alias("part"))
    named = seeds.agg(F.count("*").alias("named"))
    words = encoded_terms(keywords, signal.idf) if any(keywords or []) else literal_rows(spark, [], "term string, w double")
    loose = with_one_row(words, named).select(F.when(F.col("named") > 0, keyword_weight).otherwise(1.0).alias("share"), "term", "w", F.lit(None).cast("long").alias("part"))
    every = kept(rows.unionByName(loose))
    # An item without a term counts among the named ones all the same; keywords that are all unknown don't.
    said = loose.agg(F.coalesce(F.max("share"), F.lit(0.0)).alias("loose"))
    whole = with_one_row(named, said).select((F.col("named") + F.col("loose")).alias("whole"))
    return with_one_row(every, whole).groupBy("term").agg((F.sum(F.col("share") * F.col("w")) / F.first("whole")).alias("w"))


def cosine_to_terms(weights: DataFrame, query: DataFrame) -> DataFrame:
    """(id, s) of items that share a term with the query, any length of it."""
    norm = query.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    met = weights.join(small(query.withColumnRenamed("w", "qw")), "term").groupBy("id").agg(F.sum(F.col("w") * F.col("qw")).alias("d"))
    return with_one_row(met, norm).where("norm > 0").select("id", (F.col("d") / F.col("norm")).alias("s"))
