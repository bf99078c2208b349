"""More registered queries: profiles made of halves, lists just linked, what to ask back, and files of ratings and grids."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from vespertide.functions import text as T
from vespertide.operators import profile, recommend, signals
from vespertide.operators.common import literal_rows, numbered, shared_folder
from vespertide.plans.catalogue import FRAGMENT_SQL, NAMED, SPLIT_SQL, WHY, WHY_SQL, q6, register, rows_sql, semantic
from vespertide.plans.oracle import dense, profile as profile_sql, statement
from vespertide.plans.quality import RATED
from vespertide.plans.requests import LISTED, listed
from vespertide.settings import DEFAULTS
from vespertide.sources import files, tables

# Profiles ----------------------------------------------------------------------------------------------


def fragment(spark, sf):
    return profile.vote_fragment(profile.latest_votes(tables.votes(spark, sf)), tables.records(spark, sf))


def resolved_list(spark, sf):
    """The lists of events, resolved, as the listed half of a profile."""
    rows = listed(spark, sf)
    found = recommend.resolved(rows, tables.records(spark, sf).select("id", "title", "year")).select("user", "pos", F.col("id").alias("item"))
    split = profile.split_ratings(rows).select("user", "kind", "place", "pos", "title", F.nullif("year", F.lit("")).alias("year"), "rating")
    return split.join(found, ["user", "pos"], "left").select("user", "kind", "place", "item", "title", "year", "rating")


@register("profile_votes_only", statement("SELECT \"user\", kind, row_number() OVER (PARTITION BY \"user\", kind ORDER BY item) AS place, item, CAST(rating AS DOUBLE) AS rating FROM g_frag QUALIFY place <= 60", **FRAGMENT_SQL))
def profile_votes_only(spark, sf):
    """Someone who has linked no list still has a profile of votes."""
    got = profile.built(fragment(spark, sf), None)
    return got.select("user", "kind", F.col("place").cast("long").alias("place"), "item", "rating")


LIST_SQL = {**LISTED, **{k: v.replace("c_films", "l_list") for k, v in SPLIT_SQL.items()}}
LIST_ITEM = "coalesce(f.id, a.alone)"
LIST_JOIN = "LEFT JOIN l_full f ON lower(trim(s.title)) = f.k AND nullif(s.year, '') IS NOT DISTINCT FROM f.y LEFT JOIN l_alone a ON lower(trim(s.title)) = a.k"


@register("profile_list_only", statement(f"SELECT \"user\", kind, row_number() OVER (PARTITION BY \"user\", kind ORDER BY place) AS place, {LIST_ITEM} AS item, CAST(rating AS DOUBLE) AS rating FROM s_all s {LIST_JOIN} WHERE place <= 60", **LIST_SQL))
def profile_list_only(spark, sf):
    """Someone who has never voted has a profile of what was listed."""
    got = profile.built(None, resolved_list(spark, sf))
    return got.select("user", "kind", F.col("place").cast("long").alias("place"), "item", "rating")


@register(
    "warm_summary",
    statement(
        "SELECT c.\"user\" AS \"user\", coalesce(total, 0) AS total, coalesce(resolved, 0) AS resolved, total_films, total_rated, coalesce(top, '') AS top_genres FROM h_count c LEFT JOIN h_met USING (\"user\") LEFT JOIN h_top USING (\"user\")",
        **LIST_SQL,
        h_count="SELECT \"user\", count(*) AS total_films, count(rating) AS total_rated FROM l_list GROUP BY 1",
        h_liked=f"SELECT s.\"user\" AS \"user\", s.place AS place, {LIST_ITEM} AS item FROM s_all s {LIST_JOIN} WHERE kind = 'liked' AND place <= 60",
        h_met="SELECT \"user\", count(*) AS total, count(item) AS resolved FROM h_liked GROUP BY 1",
        h_genre="SELECT \"user\", genres[1] AS g, count(*) AS n, min(place) AS first_at FROM h_liked JOIN c_records ON id = item GROUP BY ALL",
        h_top="SELECT \"user\", array_to_string(list(g ORDER BY n DESC, first_at)[1:3], ',') AS top FROM h_genre GROUP BY 1",
    ),
)
def warm_summary(spark, sf):
    rows, records = listed(spark, sf), tables.records(spark, sf)
    found = recommend.resolved(rows, records.select("id", "title", "year"))
    return profile.warm_summary(rows, found, records).withColumn("top_genres", F.array_join("top_genres", ","))


@register(
    "profile_similarity_covered",
    statement("SELECT id, round(s, 6) AS s FROM x_p", b_rated=f"SELECT * FROM ({rows_sql(RATED, 'seed', 'rating')}) WHERE seed IN (SELECT id FROM c_vec)", **dense("x_sim", "b_rated"), **profile_sql("x_p", "x_sim", "b_rated", "true")),
)
def profile_similarity_covered(spark, sf):
    """A profile without the items that have no vector, so the ratings of the others count."""
    signal = semantic(spark, sf)
    liked = signals.covered_profile(signal, literal_rows(spark, RATED, "seed long, rating double"))
    return signals.profile_scores(signal, liked).select("id", q6("s"))


# Requests ----------------------------------------------------------------------------------------------


@register(
    "ask_or_proceed",
    statement(
        "SELECT request, CASE WHEN count(*) FILTER (WHERE name IS NOT NULL AND NOT known) > 0 AND count(*) FILTER (WHERE known) = 0 THEN 'ask' ELSE 'proceed' END AS action, coalesce(string_agg(CASE WHEN name IS NOT NULL AND NOT known THEN name END, '|' ORDER BY pos), '') AS missing FROM n_known GROUP BY request",
        n_asked="SELECT event_id AS request, 0 AS pos, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'Zorblax ' || event_type ELSE upper(p_name) END AS name FROM events JOIN part ON p_partkey = event_id % 180 + 1 UNION ALL SELECT event_id, 1, 'Unknown ' || user_id FROM events WHERE event_id % 3 = 0",
        n_known="SELECT *, coalesce(lower(name) IN (SELECT lower(p_name) FROM part), false) AS known FROM n_asked",
    ),
)
def ask_or_proceed(spark, sf):
    """Which requests name only items nobody knows: those are asked back, as an answer would be a guess."""
    part, events = tables.table(spark, sf, "part"), tables.table(spark, sf, "events")
    keyed = events.withColumn("p_partkey", F.pmod("event_id", F.lit(180)) + 1).join(part, "p_partkey")
    name = F.when(F.pmod("event_id", F.lit(5)) == 0, F.lit(None).cast("string")).when(F.pmod("event_id", F.lit(7)) == 0, F.concat(F.lit("Zorblax "), "event_type")).otherwise(F.upper("p_name"))
    first = keyed.select(F.col("event_id").alias("request"), F.lit(0).alias("pos"), name.alias("name"))
    second = events.where(F.pmod("event_id", F.lit(3)) == 0).select(F.col("event_id").alias("request"), F.lit(1).alias("pos"), F.concat(F.lit("Unknown "), F.col("user_id").cast("string")).alias("name"))
    asked = first.unionByName(second)
    found = asked.join(part.select(F.lower("p_name").alias("k")).distinct(), F.lower("name") == F.col("k")).select("request", "name")
    return recommend.ask_or_proceed(asked, found).select("request", "action", F.array_join("missing", "|").alias("missing"))


@register(
    "shortlist_lines",
    statement(
        f"SELECT place, '[' || (place - 1) || '] ' || title || ' (' || year || ')' || chr(10) || '     match: ' || why || chr(10) || '     plot: ' || substring(coalesce(overview, ''), 1, 200) AS line FROM (SELECT *, row_number() OVER (ORDER BY vote_count DESC, id) AS place FROM (SELECT *, {WHY} FROM w_line)) WHERE place <= {DEFAULTS.rerank_pool}",
        **WHY_SQL,
    ),
)
def shortlist_lines(spark, sf):
    """A shortlist as a reranker reads it."""
    items = tables.items(spark, sf)
    pool = recommend.sources_pool(items.where(F.col("id").isin(NAMED)))
    best = items.orderBy(F.desc("vote_count"), "id").limit(DEFAULTS.rerank_pool)
    told = recommend.why_items(pool, best).select("id", "title", "year", "vote_count", T.why_line(F.col("why")).alias("why_line"))
    picks = numbered(told.join(tables.records(spark, sf).select("id", "overview"), "id").withColumn("g", F.lit(1)), ["g"], F.desc("vote_count"), F.col("id"))
    return recommend.shortlist_lines(picks).withColumn("place", F.col("place").cast("long"))


RATED_BASE = 5_000_000


@register("linked_ratings", statement(f"SELECT item, count(*) AS n, sum(rating) AS total FROM c_ratings WHERE item % 5 <> 0 AND item IN (SELECT id FROM c_items) AND item IN (SELECT p_partkey FROM part) GROUP BY item"))
def linked_ratings(spark, sf):
    """Ratings by another source's ids, led to items by its links; every fifth has none."""
    ratings = tables.ratings(spark, sf).select("user", (F.col("item") + RATED_BASE).alias("rated"), "rating")
    links = tables.table(spark, sf, "part").select((F.col("p_partkey") + RATED_BASE).alias("rated"), F.when(F.pmod("p_partkey", F.lit(5)) != 0, F.col("p_partkey")).alias("id"))
    return signals.linked_ratings(ratings, links, tables.items(spark, sf)).groupBy("item").agg(F.count("*").alias("n"), F.sum("rating").alias("total"))


# Files -------------------------------------------------------------------------------------------------


@register("csv_ratings", "SELECT user_id AS \"user\", event_id % 977 AS item, count(*) AS n, sum(floor(value) / 2) AS total FROM events GROUP BY ALL")
def csv_ratings(spark, sf):
    """A folder of CSV files as ratings come in, found, and read in the columns that are wanted."""
    root = f"{shared_folder(spark)}/ratings-{uuid4().hex}"
    e = tables.table(spark, sf, "events")
    lines = e.select(F.col("user_id").alias("userId"), F.pmod("event_id", F.lit(977)).alias("movieId"), (F.floor("value") / 2).alias("rating"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("timestamp"))
    lines.write.option("header", True).csv(f"{root}/small/ratings.csv")
    kind, folder = files.find_dataset(spark, root)
    return files.ratings_csv(spark, folder).groupBy(F.col("userId").alias("user"), F.col("movieId").alias("item")).agg(F.count("*").alias("n"), F.sum(F.col("rating").cast("double")).alias("total")).where(F.lit(kind) == "csv")


@register("ratings_parts_union", statement("SELECT item, count(*) AS n, sum(rating) AS total FROM c_ratings GROUP BY item"))
def ratings_parts_union(spark, sf):
    """Ratings that come as a part to train on and a part to test on: the parts that are there, one below the other."""
    root = f"{shared_folder(spark)}/parts-{uuid4().hex}"
    r, test = tables.ratings(spark, sf), F.pmod("user", F.lit(10)) == 0
    r.where(~test).write.parquet(f"{root}/ratings_train.parquet")
    r.where(test).write.parquet(f"{root}/ratings_test.parquet")
    return files.union_existing(spark, root).groupBy("item").agg(F.count("*").alias("n"), F.sum("rating").alias("total"))


@register(
    "html_grid",
    "SELECT p_size AS page_id, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS pos, p_name AS title, CASE WHEN p_partkey % 3 <> 0 THEN CAST(1960 + p_partkey % 60 AS VARCHAR) END AS year, CASE WHEN p_partkey % 2 = 0 THEN 'film-' || p_partkey ELSE '' END AS slug, CASE p_partkey % 4 WHEN 0 THEN (p_partkey % 10 + 1) / 2 WHEN 1 THEN 3.5 END AS rating FROM part",
)
def html_grid(spark, sf):
    """Grids of rated titles, a page for every size, as a site shows them: stars by class, by sign, or not at all."""
    k = F.col("p_partkey")
    year = F.when(F.pmod(k, F.lit(3)) != 0, F.concat(F.lit(" ("), (F.pmod(k, F.lit(60)) + 1960).cast("string"), F.lit(")"))).otherwise("")
    slug = F.when(F.pmod(k, F.lit(2)) == 0, F.concat(F.lit(' data-item-slug="film-'), k.cast("string"), F.lit('"'))).otherwise("")
    stars = F.when(F.pmod(k, F.lit(4)) == 0, F.concat(F.lit('<span class="rating -micro rated-'), (F.pmod(k, F.lit(10)) + 1).cast("string"), F.lit('"> x </span>'))).when(F.pmod(k, F.lit(4)) == 1, '<span class="rating"> ★★★½ </span>').otherwise("")
    li = F.concat(F.lit('<li class="griditem -poster">\n<div class="react-component" data-item-name="'), "p_name", year, F.lit('"'), slug, F.lit("></div>"), stars, F.lit("</li>\n"))
    packed = tables.table(spark, sf, "part").groupBy(F.col("p_size").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", li.alias("li")))).alias("r"))
    pages = packed.select("page_id", F.concat(F.lit("<ul>"), F.array_join("r.li", ""), F.lit("</ul>")).alias("html"))
    return files.grid_rows(pages).withColumn("pos", F.col("pos").cast("long"))
