"""Ranking quality: ranks of expected items, leave-one-out folds, and the measures over ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vespertide.functions import text as T
from vespertide.operators.blend import combined, covered_by_any
from vespertide.operators.common import finished, kept, literal_rows, small, with_one_row
from vespertide.operators.ranks import ranked
from vespertide.operators.signals import augmented, informed
from vespertide.settings import DEFAULTS, Settings


def expected_ranks(scores: DataFrame, expected: DataFrame, ties: bool = True) -> DataFrame:
    """(case, id, rank) of expected items. scores: (case, id, s)."""
    return finished(lambda: ranked(scores, ["case"], ties).join(small(expected), ["case", "id"], "left_semi").select("case", "id", "rank"))


def large_enough(members: DataFrame, least: int, by: list[str]) -> DataFrame:
    """Members of groups with at least so many in each part that `by` tells apart; the first of `by` is the group."""
    sizes = members.groupBy(*by).agg(F.count("*").alias("n")).groupBy(by[0]).agg(F.min("n").alias("n")).where(F.col("n") >= least)
    return members.join(small(sizes.select(by[0])), by[0], "left_semi")


def macro_average(results: DataFrame, *by: str) -> DataFrame:
    """Measures of several profiles, every profile alike. results: (*by, profile, mrr, hit_at_10, hit_at_50)."""
    mean = lambda c: F.bround(F.avg(c), 4).alias(c)
    return results.groupBy(*by).agg(F.count("*").alias("profiles"), mean("mrr"), mean("hit_at_10"), mean("hit_at_50"))


def measures(ranks: DataFrame, *by: str) -> DataFrame:
    """n, median rank, hit rates and mean reciprocal rank, rounded half to even."""
    hit = lambda k: F.bround(F.avg((F.col("rank") <= k).cast("double")), 3).alias(f"hit_at_{k}")
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), F.bround(F.median("rank"), 1).alias("median_rank"), hit(10), hit(50), F.bround(F.avg(1 / F.col("rank")), 4).alias("mrr")).where("n > 0")


def broadcast_if_few(rows: DataFrame, most: int = DEFAULTS.broadcast_rows) -> Callable[[DataFrame], DataFrame]:
    """How tables of no more rows than these are joined: broadcast, if a count shows that these are few."""
    return F.broadcast if rows.limit(most + 1).count() <= most else lambda df: df


def fold_scores(sims: DataFrame, members: DataFrame, settings: Settings = DEFAULTS, alpha: float | None = None) -> DataFrame:
    """(group, hidden, id, s): scores of all folds at once, each hiding one target from its group.

    sims: (group, seed, id, s) of every covered item to every member; members: (group, seed, w, target).
    What a fold's centroid and best matches are follows from sums over the whole group less the hidden
    member, so no fold is computed anew. Shown members are left out of a fold's ranking.
    """
    k, alpha = settings.taste_top_k, settings.centroid_weight if alpha is None else alpha
    sims, members = kept(sims), kept(members)
    near = broadcast_if_few(members)
    m = near(members.select("group", "seed", "w"))
    weighted = sims.join(m, ["group", "seed"])
    descending = lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).when(a["seed"] < b["seed"], -1).otherwise(F.when(a["seed"] > b["seed"], 1).otherwise(0))
    by_item = weighted.groupBy("group", "id").agg(F.sum(F.col("w") * F.col("s")).alias("along"), F.slice(F.array_sort(F.collect_list(F.struct("s", "seed")), descending), 1, k + 1).alias("best"), F.count("*").alias("size"))
    by_item = kept(by_item)
    inner = by_item.join(m, (by_item["group"] == m["group"]) & (by_item["id"] == m["seed"])).select(by_item["group"], F.col("seed").alias("hidden"), "along", "w")
    total = inner.groupBy("group").agg(F.sum(F.col("w") * F.col("along")).alias("total"))
    targets = inner.join(near(total), "group").join(near(members.where("target").select("group", F.col("seed").alias("hidden"))), ["group", "hidden"])
    targets = targets.select("group", "hidden", F.col("along").alias("own_along"), F.col("w").alias("hw"), "total")
    # Items outside the group, and the hidden member itself.
    marked = by_item.join(near(members.select("group", F.col("seed").alias("id"), F.lit(True).alias("shown"))), ["group", "id"], "left")
    folds = marked.join(near(targets), "group").where(F.col("shown").isNull() | (F.col("id") == F.col("hidden")))
    hs = sims.select("group", F.col("seed").alias("hidden"), "id", F.col("s").alias("hs"))
    folds = folds.join(hs, ["group", "hidden", "id"])
    # The hidden member's similarity to itself is that of a unit vector.
    length2 = F.col("total") - 2 * F.col("hw") * F.col("own_along") + F.col("hw") * F.col("hw")
    along = F.col("along") - F.col("hw") * F.col("hs")
    best = F.slice(F.filter("best", lambda x: x["seed"] != F.col("hidden")), 1, k)
    mean_best = F.aggregate(best, F.lit(0.0), lambda a, x: a + x["s"]) / F.size(best)
    centroid = F.when(length2 > 1e-12, along / F.sqrt(length2)).otherwise(0.0)
    return folds.where("size > 1").select("group", "hidden", "id", (alpha * centroid + (1 - alpha) * mean_best).alias("s"))


def fold_ranks(sims: DataFrame, members: DataFrame, settings: Settings = DEFAULTS, alpha: float | None = None, ties: bool = False) -> DataFrame:
    """(group, hidden, rank) of every fold."""
    return finished(lambda: ranks_of_folds(sims, members, settings, alpha, ties))


def ranks_of_folds(sims: DataFrame, members: DataFrame, settings: Settings, alpha: float | None, ties: bool) -> DataFrame:
    scores = kept(fold_scores(sims, members, settings, alpha).withColumn("s", F.round("s", 9)))
    own = scores.where("id = hidden").select("group", "hidden", F.col("s").alias("es"))
    above = F.col("s") > F.col("es")
    if ties:
        above = above | ((F.col("s") == F.col("es")) & (F.col("id") < F.col("hidden")))
    return scores.join(small(own), ["group", "hidden"]).groupBy("group", "hidden").agg((F.count_if(above) + 1).alias("rank"))


def cohort_quality(sims, members: DataFrame, settings: Settings = DEFAULTS, least: int = 5) -> DataFrame:
    """(median_rank, cohorts): every cohort of at least so many members, each hidden in turn; the mean of their medians. sims: a function of the members that count."""
    enough = kept(large_enough(members, least, ["group"]))
    return mean_of_medians(fold_ranks(sims(enough), enough, settings))


def mixed_cohort_quality(sims, members: DataFrame, settings: Settings = DEFAULTS, least: int = 6) -> DataFrame:
    """Measures over pairs of cohorts taken together. members: with side; a pair counts if each of its two sides has at least so many."""
    sides = members.groupBy("group").agg(F.count_distinct("side").alias("n")).where("n = 2").select("group")
    enough = kept(large_enough(members.join(small(sides), "group", "left_semi"), least, ["group", "side"]))
    return measures(fold_ranks(sims(enough), enough.drop("side"), settings))


def mean_of_medians(ranks: DataFrame) -> DataFrame:
    """(median_rank, cohorts): every group counts alike."""
    return ranks.groupBy("group").agg(F.median("rank").alias("m")).agg(F.bround(F.avg("m"), 1).alias("median_rank"), F.count("*").alias("cohorts"))


def grid_tokens(items: DataFrame) -> DataFrame:
    """(id, field, term): soup tokens by the field that weighs them, as often as they come."""
    none = F.array().cast("array<string>")
    one = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", none).otherwise(F.array(c))
    fields = {"genres": F.col("genres"), "director": one("director"), "cast": F.col("cast"), "keywords": F.col("keywords"), "writers": F.col("writers"), "overview": F.col("overview_terms"), "collection": one("collection"), "decade": one("decade")}
    cells = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("vals")) for k, v in fields.items()])
    each = informed(items).select("id", F.explode(cells).alias("f")).select("id", "f.field", F.explode("f.vals").alias("v"))
    return each.select("id", "field", F.explode(T.tokens(T.soup_token(F.col("v")))).alias("term"))


def tune(items: DataFrame, liked: DataFrame, grid: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(config, n, median_rank, hit_at_10, hit_at_50, mrr): leave-one-out of a profile under every configuration, in one job.

    liked: (seed, rating), a profile of settings.max_liked at most; grid: (config, field, weight), every field in every configuration. Tokens travel with their
    counts by field; what they weigh in each configuration is made of these where an item's tokens are together, so tokens are
    shuffled no more often than for one configuration. A weight of 0 leaves a field out.
    """
    return finished(lambda: tuned(items, liked, grid, settings))


def tuned(items: DataFrame, liked: DataFrame, grid: DataFrame, settings: Settings) -> DataFrame:
    rows = [(r["config"], r["field"], r["weight"]) for r in grid.collect()]
    configs, fields = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    weights = np.zeros((len(fields), len(configs)))
    for config, field, weight in rows:
        weights[fields.index(field), configs.index(config)] = weight
    # Configurations that leave the same fields out have the same tokens.
    uses, kind = np.unique(weights > 0, axis=1, return_inverse=True)
    kind = kind.reshape(-1)
    counts = [f"__n{k}" for k in range(len(fields))]
    tokens = kept(grid_tokens(items).groupBy("id", "term").agg(*[F.count_if(F.col("field") == f).cast("int").alias(c) for f, c in zip(fields, counts)]))
    has = [reduce(Column.__or__, [F.col(c) > 0 for c, used in zip(counts, use) if used], F.lit(False)) for use in uses.T]
    dfs = [f"__df{k}" for k in range(len(has))]
    df = tokens.groupBy("term").agg(*[F.count_if(h).alias(d) for h, d in zip(has, dfs)]).where(reduce(Column.__or__, [F.col(d) >= settings.min_df for d in dfs], F.lit(False)))
    docs = np.array([x or 0 for x in tokens.groupBy("id").agg(*[F.max(h.cast("int")).alias(d) for h, d in zip(has, dfs)]).agg(*[F.sum(d) for d in dfs]).first()], np.float64)
    named = [(r["seed"], max(r["rating"] - 2.5, 0.1)) for r in liked.orderBy("seed").collect()]
    places = {seed: n for n, (seed, _) in enumerate(named)}
    raw = tokens.join(small(df), "term")
    mine = raw.where(F.col("id").isin(list(places))).select("id", "term", *counts, *dfs).collect()
    terms = {t: n for n, t in enumerate(sorted({r["term"] for r in mine}))}
    weigh = token_weights(weights, kind, docs, settings.min_df)
    shared = np.zeros((len(terms), len(named), len(configs)))
    if mine:
        for r, w in zip(mine, weigh(np.array([[r[c] for c in counts] for r in mine], np.float64), np.array([[r[d] for d in dfs] for r in mine], np.float64))):
            shared[terms[r["term"]], places[r["id"]]] = w
    lengths = np.sqrt((shared**2).sum(0))
    products = np.einsum("tnc,tmc->nmc", shared, shared)
    own = {i: (lengths[n], products[n]) for i, n in places.items() if lengths[n].any()}
    at = literal_rows(items.sparkSession, list(terms.items()), "term string, __t int")
    together = raw.join(F.broadcast(at), "term", "left").select("id", F.coalesce("__t", F.lit(-1)).alias("__t"), *counts, *dfs).repartition("id").sortWithinPartitions("id")
    above = folds_above(own, named, configs)
    ranks = together.mapInArrow(weighed_items(weigh, shared, counts, dfs, above), "config int, hidden long, above long").groupBy("config", "hidden").agg((F.sum("above") + 1).alias("rank"))
    return measures(ranks, "config")


def token_weights(weights: np.ndarray, kind: np.ndarray, docs: np.ndarray, min_df: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """What tokens weigh by configuration, out of their counts by field and the items that have them by kind of configuration; 0 where they are not in it."""

    def weigh(n: np.ndarray, df: np.ndarray) -> np.ndarray:
        tf = n @ weights
        idf = np.where(df >= min_df, np.log((1 + docs) / (1 + df)) + 1, 0.0)[:, kind]
        return np.where(tf > 0, (1 + np.log(np.where(tf > 0, tf, 1.0))) * idf, 0.0)

    return weigh


def weighed_items(weigh, shared: np.ndarray, counts: list[str], dfs: list[str], above) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of tokens in the order of their items (id, __t, counts, dfs): what above() says of the items, by their lengths and products with the liked ones.

    shared: weights of the liked items by term, item and configuration; __t: the place of a token's term there, -1 if it has none.
    """

    def whole_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The tokens again, no item cut in two."""
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            ids = table.column("id").to_numpy()
            cut = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0
            if cut:
                yield table.slice(0, cut)
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield rest

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for table in whole_items(batches):
            column = lambda c, t: table.column(c).to_numpy().astype(t)  # noqa: E731, B023
            w = weigh(np.stack([column(c, np.float64) for c in counts], axis=1), np.stack([column(d, np.float64) for d in dfs], axis=1))
            ids, starts, at = np.unique(column("id", np.int64), return_index=True, return_inverse=True)
            d = np.zeros((len(ids), *shared.shape[1:]))
            t = column("__t", np.int64)
            met = np.flatnonzero(t >= 0)
            for n in range(shared.shape[1]):
                np.add.at(d[:, n], at[met], w[met] * shared[t[met], n])
            yield ids, np.sqrt(np.add.reduceat(w * w, starts, axis=0)), d

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pandas(above(products(batches)), preserve_index=False)

    return counted


def folds_above(own: dict[int, tuple[np.ndarray, np.ndarray]], named: list[tuple[int, float]], configs: list[int]) -> Callable[[Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], pd.DataFrame]:
    """For batches of items (ids, norm, d): in each configuration and fold the number of items above the hidden one, scored by the centroid of the others.

    named: the few liked items with their weights; norm: lengths by item and configuration; d: products with the liked items, by item, liked item and
    configuration; own: both of the liked items. Items of length 0 in a configuration are not in it; liked ones are shown, or hidden, and not counted. Equal scores go by id.
    """
    ids, w = np.array([i for i, _ in named]), np.array([x for _, x in named])[:, None]
    lengths = np.array([own[i][0] if i in own else np.zeros(len(configs)) for i in ids]).reshape(len(ids), len(configs))
    there = lengths > 0

    def cosines(norm: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Of rows by liked item and configuration; 0 where either is not there."""
        product = norm[:, None, :] * lengths[None]
        return np.divide(d, product, out=np.zeros((len(d), *lengths.shape)), where=product > 0)

    among = np.zeros((len(ids), len(ids), len(configs)))
    for n, i in enumerate(ids):
        if i in own:
            among[n] = cosines(own[i][0][None], own[i][1][None])[0]
    weight = np.where(there, w, 0.0)
    along = (among * weight[None]).sum(1)
    # What the shown items' sum is long, by the one that is hidden.
    square = (along * weight).sum(0)[None] - 2 * weight * along + weight**2
    length = np.sqrt(np.where(square > 1e-12, square, 1.0))
    said = there & (there.sum(0)[None] > 1)

    def scores(s: np.ndarray) -> np.ndarray:
        shown = (s * weight[None]).sum(1)[:, None, :] - s * weight[None]
        return np.round(np.where(square > 1e-12, shown / length, 0.0), 9)

    mine = np.array([scores(among[n : n + 1])[0, n] for n in range(len(ids))]).reshape(len(ids), len(configs))

    def above(batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        total = np.zeros(mine.shape, dtype=np.int64)
        for found, norm, d in batches:
            others = ~np.isin(found, ids)
            norm = norm[others]
            got = scores(cosines(norm, d[others]))
            first = found[others][:, None, None] < ids[None, :, None]
            higher = (got > mine[None]) | ((got == mine[None]) & first)
            total += (higher & (norm > 0)[:, None, :]).sum(0)
        hidden, config = np.nonzero(said)
        return pd.DataFrame({"config": np.array(configs, np.int32)[config], "hidden": ids[hidden].astype(np.int64), "above": total[hidden, config]})

    return above


# Profiles over a blend ---------------------------------------------------------------------------------


def signal_folds(signal, liked: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(group, hidden, id, s): a signal's profile score of every covered item in every fold, each without one liked item.

    liked: (group, seed, rating), profiles of settings.max_liked at most, each item once. What a fold has follows from the
    moments of the whole profile (sums along it, its length) less the hidden item, so no fold is fitted anew.
    Ratings count in a fold whose shown items all have a vector here, also where only the hidden one lacks it.
    """
    k, alpha = settings.taste_top_k, settings.centroid_weight
    own = liked.select("group", "seed", F.greatest(F.col("rating") - 2.5, F.lit(0.1)).alias("lw"))
    sims = signal.to_seeds(liked.select("seed").distinct()).join(small(own), "seed")
    falling = lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).otherwise(0)
    pairs = F.collect_list(F.struct("s", "seed"))
    by_item = sims.groupBy("group", "id").agg(F.sum(F.col("lw") * F.col("s")).alias("rated"), F.sum("s").alias("plain"), F.map_from_entries(F.collect_list(F.struct("seed", "s"))).alias("to"), F.slice(F.array_sort(pairs, falling), 1, k + 1).alias("best"))
    by_item = kept(by_item)
    inner = by_item.select("group", F.col("id").alias("seed"), "rated", "plain")
    each = own.join(inner, ["group", "seed"], "left").withColumn("here", F.col("plain").isNotNull())
    whole = each.groupBy("group").agg(F.count("*").alias("n"), F.count_if("here").alias("m"), F.sum(F.col("lw") * F.col("rated")).alias("all_rated"), F.sum("plain").alias("all_plain"))
    rated = F.col("m") - F.col("here").cast("int") == F.col("n") - 1
    folds = each.join(whole, "group").where(F.col("m") - F.col("here").cast("int") > 0)
    folds = folds.select("group", F.col("seed").alias("hidden"), rated.alias("by_rating"), F.when(~F.col("here"), 0.0).when(rated, F.col("lw")).otherwise(1.0).alias("hw"), F.when(rated, F.col("all_rated")).otherwise(F.col("all_plain")).alias("total"), F.coalesce(F.when(rated, F.col("rated")).otherwise(F.col("plain")), F.lit(0.0)).alias("own"))
    # The hidden item's similarity to itself is that of a unit vector.
    length2 = F.col("total") - 2 * F.col("hw") * F.col("own") + F.col("hw") * F.col("hw")
    folds = folds.select("group", "hidden", "by_rating", "hw", length2.alias("length2"))
    met = by_item.join(small(folds), "group")
    along = F.when(F.col("by_rating"), F.col("rated")).otherwise(F.col("plain")) - F.col("hw") * F.coalesce(F.try_element_at("to", F.col("hidden")), F.lit(0.0))
    best = F.slice(F.filter("best", lambda x: x["seed"] != F.col("hidden")), 1, k)
    mean_best = F.aggregate(best, F.lit(0.0), lambda a, x: a + x["s"]) / F.size(best)
    centroid = F.when(F.col("length2") > 1e-12, along / F.sqrt("length2")).otherwise(0.0)
    return met.select("group", "hidden", "id", (alpha * centroid + (1 - alpha) * mean_best).alias("s"))


def profile_fold_ranks(signals: list, items: DataFrame, liked: DataFrame, settings: Settings = DEFAULTS, least: int = 3) -> DataFrame:
    """(group, hidden, rank): leave-one-out of rated profiles over the blend of signals, all folds in one job.

    Liked items that no signal covers say nothing; profiles of fewer than `least` others are left out, and items outside
    the corpus are shown but not hidden. Every signal is standardised within its fold; items that no signal has a say on
    score 0 and are ranked too. A list of one signal is ranked by that signal's own scores.
    """
    return finished(lambda: ranks_in_blend(signals, items, liked, settings, least))


def ranks_in_blend(signals: list, items: DataFrame, liked: DataFrame, settings: Settings, least: int) -> DataFrame:
    weights = settings.weights("reference")
    known = kept(large_enough(liked.join(covered_by_any(signals).withColumnRenamed("id", "seed"), "seed", "left_semi"), least, ["group"]))
    if len(signals) == 1:
        scores = signal_folds(signals[0], known, settings)
    else:
        scores = combined([(weights[x.name], kept(signal_folds(x, known, settings))) for x in signals if weights[x.name] > 0], by=["group", "hidden"])
    corpus = items.select("id").distinct()
    targets = known.join(corpus.withColumnRenamed("id", "seed"), "seed", "left_semi").select("group", F.col("seed").alias("hidden"))
    if scores is None:
        return targets.limit(0).withColumn("rank", F.lit(0).cast("long"))
    scores = kept(scores.join(corpus, "id", "left_semi").withColumn("s", F.round("s", 9)))
    members = small(targets.select("group", F.col("hidden").alias("id"), F.lit(True).alias("liked")))
    own = scores.where("id = hidden").select("group", "hidden", F.col("s").alias("own"))
    folds = scores.select("group", "hidden").distinct().join(targets, ["group", "hidden"], "left_semi")
    folds = small(folds.join(own, ["group", "hidden"], "left").withColumn("own", F.coalesce("own", F.lit(0.0))))
    others = scores.join(members, ["group", "id"], "left").where("liked IS NULL").join(folds, ["group", "hidden"])
    counted = others.groupBy("group", "hidden").agg(F.count("*").alias("scored"), F.count_if(F.col("s") > F.col("own")).alias("above"))
    shown = targets.groupBy("group").agg(F.count("*").alias("shown"))
    every = with_one_row(folds.join(counted, ["group", "hidden"], "left").join(small(shown), "group"), corpus.agg(F.count("*").alias("corpus")))
    silent = F.when(F.col("own") < 0, F.col("corpus") - F.col("shown") - F.coalesce("scored", F.lit(0))).otherwise(0)
    return every.select("group", "hidden", (F.coalesce("above", F.lit(0)) + silent + 1).alias("rank"))


def frozen_fold_ranks(signal, known: DataFrame, liked: DataFrame, settings: Settings = DEFAULTS, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Ranks (group, hidden, rank) of leave-one-out by the centroid alone, and (corpus): the corpus is joined by liked items from outside, weighed by its frozen weights.

    known: records of the liked items; liked: (seed, rating), of one profile. Fewer than `least` found: no ranks.
    """
    wider = augmented(signal, known, settings)
    found = liked.join(known.select(F.col("id").alias("seed")), "seed", "left_semi").select(F.lit(0).alias("group"), "seed", "rating")
    enough = large_enough(found, least, ["group"]).join(wider.ids.withColumnRenamed("id", "seed"), "seed", "left_semi")
    members = kept(enough.select("group", "seed", F.greatest(F.col("rating") - 2.5, F.lit(0.1)).alias("w"), F.lit(True).alias("target")))
    sims = wider.to_seeds(members.select("seed")).select(F.lit(0).alias("group"), "seed", "id", "s")
    return fold_ranks(sims, members, settings, alpha=1.0, ties=True), wider.ids.agg(F.count("*").alias("corpus"))


def report(parts: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """(signal, part, n, median_rank, hit_at_10, mrr): a row for each signal and part of an evaluation, null where that part has no such measure. parts: (signal, part, one row of measures)."""
    names = {"n": "long", "median_rank": "double", "hit_at_10": "double", "mrr": "double"}
    rows = [df.select(F.lit(signal).alias("signal"), F.lit(part).alias("part"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in names.items()]) for signal, part, df in parts]
    return reduce(DataFrame.unionByName, rows)


def best_config(results: DataFrame) -> DataFrame:
    """The first configuration with the highest reciprocal rank."""
    return results.orderBy(F.desc("mrr"), "config").limit(1)


def usable(vec: Column) -> Column:
    """Whether a query vector says anything."""
    return F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))
