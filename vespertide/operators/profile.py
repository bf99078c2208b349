"""Profiles: what a user likes, dislikes and has seen, from rated lists and from votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vespertide.functions import text as T
from vespertide.operators.common import first_numbered, latest, numbered
from vespertide.settings import DEFAULTS, Settings


def split_ratings(films: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(user, kind, place, ...): liked ones best first, topped up with unrated ones where few are liked; disliked ones as listed.

    films: (user, pos, title, year, rating), rating null where none was given.
    """
    most = settings.max_liked
    liked = first_numbered(films.where(F.col("rating") >= settings.like_threshold), ["user"], most, F.desc("rating"), F.col("pos"))
    many = films.groupBy("user").agg(F.count_if(F.col("rating") >= settings.like_threshold).alias("n_liked"))
    unrated = first_numbered(films.where("rating IS NULL"), ["user"], 10, F.col("pos"))
    fill = unrated.join(many, "user").where("n_liked < 5").withColumn("place", (F.col("place") + F.col("n_liked")).cast("int")).drop("n_liked")
    disliked = first_numbered(films.where(F.col("rating") <= settings.dislike_threshold), ["user"], most, F.col("pos"))
    both = liked.unionByName(fill).withColumn("kind", F.lit("liked")).unionByName(disliked.withColumn("kind", F.lit("disliked")))
    return both.where(F.col("place") <= most)


def watched_keys(films: DataFrame) -> DataFrame:
    """Distinct (user, title_key, year) of everything listed, rated or not."""
    return films.select("user", T.title_key(F.col("title")).alias("title_key"), F.nullif("year", F.lit("")).alias("year")).distinct()


def latest_votes(votes: DataFrame) -> DataFrame:
    """(user_id, item, verdict): the last vote of a user on an item stands."""
    return latest(votes, ["user_id", "item"], ["verdict"], "ts", "event_id")


def vote_counts(current: DataFrame) -> DataFrame:
    """Votes up, and everything else as down."""
    return current.groupBy("user_id").agg(F.count_if(F.col("verdict") > 0).alias("up"), F.count_if(~(F.col("verdict") > 0)).alias("down"))


def vote_summary(counts: DataFrame) -> DataFrame:
    none = (F.col("up") == 0) & (F.col("down") == 0)
    return counts.select("user_id", F.when(none, "no ratings yet").otherwise(F.format_string("%d 👍, %d 👎", "up", "down")).alias("summary"))


def vote_fragment(current: DataFrame, records: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(user, kind, item, title, year, rating, total): votes on items with a stored title; total counts all votes."""
    total = current.groupBy("user_id").agg(F.count("*").alias("total"))
    named = records.select(F.col("id").alias("item"), "title", F.nullif("year", F.lit("")).alias("year")).where("title <> ''")
    up = F.col("verdict") > 0
    return (
        current.join(named, "item").join(total, "user_id")
        .select(F.col("user_id").alias("user"), F.when(up, "liked").otherwise("disliked").alias("kind"), "item", "title", "year", F.when(up, settings.up_rating).otherwise(settings.down_rating).alias("rating"), "total")
    )


def merge(fragment: DataFrame, listed: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(user, kind, place, source, item, title, year, rating): votes first, then listed ones that no vote names by id or title, to the cap.

    fragment: (user, kind, item, title, year, rating); listed: the same with place. Either may lack a user.
    """
    side = ["user", "kind", "item", "title", "year", "rating"]
    by_id = fragment.select("user", "kind", "item").where("item IS NOT NULL").distinct()
    by_title = fragment.select("user", "kind", T.title_key(F.col("title")).alias("k"), F.col("year").alias("y")).distinct()
    extra = listed.join(by_id, ["user", "kind", "item"], "left_anti")
    same = (extra["user"] == by_title["user"]) & (extra["kind"] == by_title["kind"]) & (T.title_key(extra["title"]) == by_title["k"]) & extra["year"].eqNullSafe(by_title["y"])
    extra = extra.join(by_title, same, "left_anti").select(*side, F.lit("listed").alias("source"), F.col("place").cast("long").alias("pos"))
    voted = fragment.select(*side, F.lit("votes").alias("source"), F.col("item").alias("pos"))
    both = first_numbered(voted.unionByName(extra), ["user", "kind"], settings.max_liked, F.desc("source"), F.col("pos"))
    return both.select("user", "kind", "place", "source", *side[2:])


def built(fragment: DataFrame | None, listed: DataFrame | None, settings: Settings = DEFAULTS) -> DataFrame | None:
    """A profile of votes, of a list, or of both; None where there is neither. Either half may also lack some users."""
    half = fragment if fragment is not None else listed
    if half is None:
        return None
    none = half.limit(0)
    columns = ["user", "kind", "item", "title", "year", "rating"]
    fragment = fragment if fragment is not None else none.select(*columns)
    listed = listed if listed is not None else none.select(*columns, F.lit(0).cast("long").alias("place"))
    return merge(fragment, listed, settings)


def liked_and_disliked(profile: DataFrame, user) -> tuple[list[tuple[int, float]], list[int]]:
    """What recommend() takes of a stored profile of one user: liked items with ratings, and disliked ones, in order; items that were not found drop out."""
    rows = profile.where(F.col("user").eqNullSafe(F.lit(user)) & F.col("item").isNotNull()).orderBy("kind", "place").collect()
    return [(r["item"], float(r["rating"])) for r in rows if r["kind"] == "liked"], [r["item"] for r in rows if r["kind"] == "disliked"]


def warm_summary(films: DataFrame, found: DataFrame, records: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(user, total, resolved, total_films, total_rated, top_genres): what landed of a list that was just linked.

    films: (user, pos, title, year, rating); found: (user, pos, id) of those that were resolved; records: (id, genres).
    """
    counts = films.groupBy("user").agg(F.count("*").alias("total_films"), F.count("rating").alias("total_rated"))
    liked = split_ratings(films, settings).where("kind = 'liked'").select("user", "pos", "place")
    met = liked.join(found.select("user", "pos", "id"), ["user", "pos"], "left")
    totals = met.groupBy("user").agg(F.count("*").alias("total"), F.count("id").alias("resolved"))
    genres = top_genres(met.where("id IS NOT NULL").join(records.select("id", "genres"), "id").select("user", F.col("place").alias("pos"), "genres"))
    named = genres.groupBy("user").agg(F.array_sort(F.collect_list(F.struct("place", "genre"))).alias("g")).select("user", F.col("g.genre").alias("top_genres"))
    none = F.array().cast("array<string>")
    every = counts.join(totals, "user", "left").join(named, "user", "left")
    return every.select("user", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("resolved", F.lit(0)).alias("resolved"), "total_films", "total_rated", F.coalesce("top_genres", none).alias("top_genres"))


def top_genres(liked: DataFrame, n: int = 3) -> DataFrame:
    """(user, place, genre, n): commonest genres of a profile, ties by first appearance. liked: (user, pos, genres)."""
    each = liked.select("user", "pos", F.posexplode("genres").alias("gpos", "genre"))
    counted = each.groupBy("user", "genre").agg(F.count("*").alias("n"), F.min(F.struct("pos", "gpos")).alias("first"))
    return numbered(counted, ["user"], F.desc("n"), F.col("first")).where(F.col("place") <= n).select("user", "place", "genre", "n")


def listed_names(liked: DataFrame, genres: int = 4, directors: int = 3, of: int = 8) -> DataFrame:
    """One row a user: first genres and directors of the first few liked items, each once, in order."""
    head = first_numbered(liked, ["user"], of, F.col("pos"))
    packed = head.groupBy("user").agg(F.array_sort(F.collect_list(F.struct("pos", "genres", "director"))).alias("r"))
    named = F.filter(F.transform("r", lambda x: x["director"]), lambda d: F.coalesce(d, F.lit("")) != "")
    return packed.select("user", F.slice(F.array_distinct(F.flatten("r.genres")), 1, genres).alias("genres"), F.slice(F.array_distinct(named), 1, directors).alias("directors"))
