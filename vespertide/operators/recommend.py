"""The ranking query: intent and taste, filters that give way, a floor, reasons, one seat per collection, rerank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vespertide.functions import text as T
from vespertide.operators.blend import query_scores, reference_scores, taste_scores
from vespertide.operators.common import finished, first_numbered, kept, literal_rows, small, standardised, with_one_row
from vespertide.operators.titles import best_matches  # noqa: F401  (part of this module's interface)
from vespertide.settings import DEFAULTS, Settings

NO_STRINGS = "array<string>"


def strings(values: list[str] | None) -> Column:
    return F.array(*map(F.lit, values or [])).cast(NO_STRINGS)


def mixed(intent: DataFrame | None, taste: DataFrame | None, weight: float) -> DataFrame | None:
    """What was asked for and who asks, or whichever of the two there is."""
    if intent is None or taste is None:
        return intent if intent is not None else taste
    both = intent.withColumnRenamed("s", "i").join(taste.withColumnRenamed("s", "t"), "id")
    return both.select("id", (weight * F.col("i") + (1 - weight) * F.col("t")).alias("s"))


def guarded(candidates: DataFrame, passes: Column, rows: int = DEFAULTS.guard_rows) -> DataFrame:
    """candidates with column ok: whether they pass, or all of them where fewer than `rows` do."""
    marked = candidates.withColumn("__pass", F.coalesce(passes, F.lit(False)))
    enough = marked.agg((F.count_if("__pass") >= rows).alias("__enough"))
    return with_one_row(marked, enough).withColumn("ok", ~F.col("__enough") | F.col("__pass")).drop("__pass", "__enough")


def same_mode(reference_has_it: bool, mode_genre: str, never: str) -> Column:
    """Items alike in having mode_genre (documentaries and features don't mix), and without `never`."""
    return (F.array_contains("genres", mode_genre) == F.lit(reference_has_it)) & ~F.array_contains("genres", never)


def any_genre(wanted: list[str]) -> Column:
    return F.exists("genres", lambda g: F.lower(g).isin([w.lower() for w in wanted]))


def unseen(candidates: DataFrame, ids: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """candidates without seen ids, nor seen (title_key, year) pairs, where a null year equals a null year."""
    left = candidates.join(F.broadcast(ids), "id", "left_anti")
    if keys is None:
        return left
    k = small(keys.select(F.col("title_key").alias("__title"), F.col("year").alias("__year")))
    same = (T.title_key(left["title"]) == k["__title"]) & F.nullif(left["year"], F.lit("")).eqNullSafe(k["__year"])
    return left.join(k, same, "left_anti")


def above_floor(scored: DataFrame, min_z: float, retain: float = DEFAULTS.z_retain) -> DataFrame:
    """Rows whose z reaches the floor, which rises with the best; none where the best is below min_z."""
    best = scored.agg(F.max("z").alias("__best"))
    floor = F.greatest(F.lit(min_z), F.col("__best") * retain)
    return with_one_row(scored, best).where((F.col("__best") >= min_z) & (F.col("z") >= floor)).drop("__best")


def sources_pool(sources: DataFrame) -> DataFrame:
    """One row of what the named and liked items have: their genres, keywords, cast and directors."""
    gathered = lambda name: F.array_distinct(F.flatten(F.collect_list(name))).alias(f"pool_{name}")
    return sources.agg(gathered("genres"), gathered("keywords"), gathered("cast"), F.collect_set(F.nullif(F.col("director"), F.lit(""))).alias("pool_director"))


def why_items(pool: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates with why: overlaps with the pool."""
    met = lambda name, n: F.slice(F.filter(name, lambda x: F.array_contains(f"pool_{name}", x)), 1, n).alias(name)
    director = F.when(F.array_contains("pool_director", F.col("director")), F.col("director")).otherwise("").alias("director")
    return with_one_row(candidates, pool).withColumn("why", F.struct(met("genres", 3), met("keywords", 4), met("cast", 2), director)).drop("pool_genres", "pool_keywords", "pool_cast", "pool_director")


def why_request(candidates: DataFrame, keywords: list[str] | None, genres: list[str] | None) -> DataFrame:
    """candidates with why: overlaps with the words of the request, keywords also where one holds the other."""
    terms = strings([k.lower() for k in keywords or [] if k])
    met_genres = F.slice(F.filter("genres", lambda g: F.array_contains(strings([g.lower() for g in genres or []]), F.lower(g))), 1, 3)
    met = F.filter("keywords", lambda k: F.exists(terms, lambda t: F.contains(F.lower(k), t) | F.contains(t, F.lower(k))))
    return candidates.withColumn("why", F.struct(met_genres.alias("genres"), F.slice(met, 1, 4).alias("keywords"), F.array().cast(NO_STRINGS).alias("cast"), F.lit("").alias("director")))


def grounded() -> Column:
    w = F.col("why")
    return (F.size(w["genres"]) > 0) | (F.size(w["keywords"]) > 0) | (F.size(w["cast"]) > 0) | (w["director"] != "")


def seated(scored: DataFrame, top_n: int) -> DataFrame:
    """The best, each collection with one seat until all others that cleared the floor have theirs; column place."""
    named = F.coalesce(F.col("collection"), F.lit("")) != ""
    # Items without a collection stand each for themselves, so they are no group.
    group = F.when(named, F.col("collection")).otherwise(F.concat(F.lit("\x00"), F.col("id").cast("string")))
    # In a collection only its first top_n can ever be seated.
    within = first_numbered(scored.withColumn("__group", group), ["__group"], top_n, F.desc("z"), F.col("id"), into="nth").drop("__group")
    best = within.orderBy(F.col("nth") > 1, F.desc("z"), "id").limit(top_n)
    return best.withColumn("place", F.row_number().over(W.orderBy(F.col("nth") > 1, F.desc("z"), "id"))).drop("nth")


def recommend(items: DataFrame, signals: list, **request) -> DataFrame:
    """(place, id, title, collection, z, why), best first.

    Named items lead and mute text and keywords; without them text and keywords lead; taste comes in
    beside either. Dislikes only exclude. items should be a stored table; request: as for made().
    """
    return finished(lambda: made(items, signals, **request))


def made(items: DataFrame, signals: list, *, liked: list[tuple[int, float]] | None = None, disliked: list[int] | None = None, references: list[int] | None = None, keywords: list[str] | None = None, text: str = "", genres: list[str] | None = None, watched: DataFrame | None = None, mode_genre: str = "Documentary", never: str = "TV Movie", min_z: float | None = None, top_n: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    spark = items.sparkSession
    liked, disliked, references = liked or [], (disliked or [])[:15], references or []
    min_z = settings.min_z if min_z is None else min_z
    top_n = settings.top_n if top_n is None else top_n
    nothing = items.limit(0).select(F.lit(0).alias("place"), "id", "title", "collection", F.lit(0.0).alias("z"), F.lit("").alias("why"))
    if not (liked or references or keywords or text):
        return nothing
    # Texts aren't ranked by, so they don't travel.
    items = items.drop("overview")
    seeds = literal_rows(spark, [(i,) for i in references], "seed long")
    tastes = literal_rows(spark, [(i, float(r)) for i, r in liked[: settings.max_liked]], "seed long, rating double")
    intent, weight = (reference_scores(signals, seeds, settings), settings.reference_weight) if references else (None, settings.query_weight)
    if intent is None:
        # Named items that no signal covers say nothing; text and keywords speak then.
        weight = settings.query_weight
    if intent is None and (text or keywords):
        intent = query_scores(signals, text, keywords or [], settings)
    taste = taste_scores(signals, tastes, settings) if liked else None
    scores = mixed(intent, taste, weight)
    if scores is None:
        return nothing
    candidates = items.join(standardised(kept(scores)).select("id", "z"), "id")
    if references:
        has = items.join(F.broadcast(seeds), F.col("id") == F.col("seed"), "left_semi").agg(F.coalesce(F.bool_or(F.array_contains("genres", mode_genre)), F.lit(False)).alias("has")).first()["has"]
        candidates = guarded(candidates, same_mode(has, mode_genre, never), settings.guard_rows).where("ok").drop("ok")
    elif genres:
        candidates = guarded(candidates, any_genre(genres), settings.guard_rows).where("ok").drop("ok")
    seen = literal_rows(spark, [(i,) for i in {*references, *disliked, *(i for i, _ in liked)}], "id long")
    chosen = above_floor(kept(unseen(candidates, seen, watched)), min_z, settings.z_retain)
    if references or liked:
        named = literal_rows(spark, [(i,) for i in [*references, *[i for i, _ in liked[:8]]]], "source long")
        pool = sources_pool(items.join(F.broadcast(named), F.col("id") == F.col("source"), "left_semi"))
        chosen = why_items(pool, chosen)
    else:
        chosen = why_request(chosen, keywords, genres)
    if references:
        chosen = chosen.where(grounded())
    return seated(chosen, top_n).select("place", "id", "title", "collection", "z", T.why_line(F.col("why")).alias("why"))


PICK = ["place", "id", "title", "collection", "how"]


def answer(items: DataFrame, signals: list, edges: DataFrame | Callable[[list[int]], DataFrame], *, genres: list[str] | None = None, decade: str = "any", watched: DataFrame | None = None, settings: Settings = DEFAULTS, **request) -> DataFrame:
    """(place, id, title, collection, how): the ranked picks, else neighbours of the named items, else what the genres have best rated; how says which.

    A request without genres ends with an empty answer. edges: (src, dst, rank), or what gives those of some items, which is
    asked only where neighbours are needed. request: as for recommend.
    """
    picks = recommend(items, signals, genres=genres, watched=watched, settings=settings, **request).select(*PICK[:-1], F.lit("ranked").alias("how"))
    if not picks.isEmpty():
        return picks
    order = lambda found, by, how: found.withColumn("place", F.row_number().over(W.orderBy(F.desc(by), "id"))).select(*PICK[:-1], F.lit(how).alias("how"))
    if request.get("references"):
        near = kept(order(neighbours(items, edges(request["references"][:2]) if callable(edges) else edges, request["references"], watched=watched), "vote_count", "neighbours"))
        if not near.isEmpty():
            return near
    if genres:
        return order(browse(items, genres, decade), "vote_average", "browsed")
    return picks


def resolved(listed: DataFrame, catalogue: DataFrame, unrated: float = DEFAULTS.unrated) -> DataFrame:
    """(user, pos, id, rating): listed titles found in the catalogue by title and year; those of a year that fails by title alone, if one item has it.

    A title and year that several items share match none. A missing rating counts as `unrated`.
    """
    key = T.title_key(F.col("title")).alias("k")
    full = unambiguous(catalogue.select("id", key, F.nullif("year", F.lit("")).alias("y")), ["k", "y"])
    only = unambiguous(catalogue.select("id", key), ["k"]).withColumnRenamed("id", "alone")
    asked = listed.select("user", "pos", key, F.nullif("year", F.lit("")).alias("y"), F.coalesce("rating", F.lit(unrated)).alias("rating"))
    a, b = asked.alias("a"), full.alias("b")
    met = a.join(b, (F.col("a.k") == F.col("b.k")) & F.col("a.y").eqNullSafe(F.col("b.y")), "left").select("a.*", "b.id").join(only, "k", "left")
    return met.select("user", "pos", F.coalesce("id", "alone").alias("id"), "rating").where("id IS NOT NULL")


def rerank(picks: DataFrame, answer: str | None, n: int = DEFAULTS.final_n) -> DataFrame:
    """(place, ...) of the picks that an answer {"order": [...]} chooses: valid, in range, once each, topped up in their own order.

    picks: column place from 1. Anything that isn't such an answer leaves the order as it was.
    """
    # Only whole numbers count, so each entry is read as text first.
    order = F.from_json(F.lit(answer or ""), "order array<string>")["order"]
    asked = picks.sparkSession.range(1).select(F.posexplode_outer(order).alias("pos", "entry"))
    valid = asked.where(F.col("entry").rlike("^(0|[1-9][0-9]*)$")).select("pos", (F.col("entry").try_cast("int") + 1).alias("place"))
    first = valid.groupBy("place").agg(F.min("pos").alias("pos"))
    count = picks.agg(F.count("*").alias("__n"))
    chosen = with_one_row(picks.join(F.broadcast(first), "place", "left"), count)
    # A short list stays as it is.
    rank = F.when((F.col("__n") > n) & F.col("pos").isNotNull(), F.struct(F.lit(0).alias("a"), F.col("pos").alias("b"))).otherwise(F.struct(F.lit(1).alias("a"), F.col("place").alias("b")))
    best = chosen.withColumn("__rank", rank).orderBy("__rank").limit(n)
    return best.withColumn("place", F.row_number().over(W.orderBy("__rank"))).drop("__rank", "pos", "__n")


def browse(items: DataFrame, genres: list[str], decade: str = "any", least_votes: int = 300, n: int = 3) -> DataFrame:
    """Last resort: items that have all genres, of a decade, with enough votes, best rated first."""
    wanted = strings([g.lower() for g in genres])
    found = items.where((F.size(F.array_except(wanted, F.transform("genres", F.lower))) == 0) & (F.col("vote_count") >= least_votes))
    if decade in T.DECADES:
        found = found.where(F.col("year").try_cast("int").between(*T.DECADES[decade]))
    return found.orderBy(F.desc("vote_average"), "id").limit(n)


def neighbours(items: DataFrame, edges: DataFrame, references: list[int], per_reference: int = 30, pool: int = 40, n: int = 3, watched: DataFrame | None = None) -> DataFrame:
    """Neighbours of the first two named items, most voted first."""
    asked = literal_rows(items.sparkSession, [(r, k) for k, r in enumerate(references[:2])], "src long, which int")
    every = edges.join(F.broadcast(asked), "src").where(F.col("rank") < per_reference)
    first = every.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("which", "rank")).alias("at")).where(~F.col("id").isin(references))
    near = first.orderBy("at", "id").limit(pool)
    found = unseen(items.join(F.broadcast(near.select("id")), "id"), literal_rows(items.sparkSession, [(r,) for r in references], "id long"), watched)
    return found.orderBy(F.desc("vote_count"), "id").limit(n)


def unambiguous(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that one row alone has, with that row's id."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")


def ask_or_proceed(asked: DataFrame, found: DataFrame) -> DataFrame:
    """(request, action, missing): "ask" where a request names items and none of them was found, else "proceed"; missing: the names not found, in order.

    asked: (request, pos, name), name null for a request that names nothing; found: (request, name) of what was resolved. Names compare without case.
    """
    key = lambda c: F.lower(F.col(c))
    have = found.select("request", key("name").alias("__key"), F.lit(True).alias("__found")).distinct()
    marked = asked.withColumn("__key", key("name")).join(have, ["request", "__key"], "left")
    lost = F.col("name").isNotNull() & F.col("__found").isNull()
    sums = marked.groupBy("request").agg(F.count_if(lost).alias("lost"), F.count_if("__found").alias("met"), F.array_sort(F.collect_list(F.when(lost, F.struct("pos", "name")))).alias("names"))
    action = F.when((F.col("lost") > 0) & (F.col("met") == 0), "ask").otherwise("proceed")
    return sums.select("request", action.alias("action"), F.col("names.name").alias("missing"))


def shortlist_lines(picks: DataFrame) -> DataFrame:
    """(place, line): a shortlist as it is put to a reranker: number from 0, title, year, why, and the beginning of the plot. picks: (place, title, year, why_line, overview)."""
    line = F.format_string("[%d] %s (%s)\n     match: %s\n     plot: %s", F.col("place") - 1, F.col("title"), F.substring(F.coalesce("year", F.lit("")), 1, 4), F.col("why_line"), F.substring(F.coalesce("overview", F.lit("")), 1, 200))
    return picks.select("place", line.alias("line"))


def guarded_intent(intents: DataFrame) -> DataFrame:
    """Intents with empty entries removed; "recommend" without anything to go by becomes "unclear"."""
    names = ["genres", "keywords", "reference_titles"]
    clean = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast(NO_STRINGS)), lambda x: x.isNotNull() & (F.trim(x) != "") & (F.upper(F.trim(x)) != "N/A"))
    out = intents.withColumns({c: clean(c) for c in names})
    empty = F.size(F.concat(*[F.col(c) for c in names])) == 0
    return out.withColumn("intent", F.when((F.col("intent") == "recommend") & empty, F.lit("unclear")).otherwise(F.col("intent")))
