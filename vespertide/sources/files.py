"""Files that aren't the engine's own tables: ratings in CSV, records in JSON, grids in HTML, saved signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from vespertide.functions import text as T

RATINGS = "userId long, movieId long, rating float, timestamp long"
MOVIES = "movieId long, title string, genres string"
LINKS = "movieId long, imdbId string, tmdbId double"
PERSON = "struct<name: string, job: string>"
DETAILS = f"id long, title string, release_date string, overview string, tagline string, genres array<struct<name: string>>, keywords array<struct<name: string>>, cast array<{PERSON}>, crew array<{PERSON}>, vote_average double, vote_count int, popularity double, runtime int"


def csv_table(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """A typed CSV file, only the wanted columns of it."""
    return spark.read.csv(path, schema=schema, header=True).select(*columns)


def ratings_csv(spark: SparkSession, folder: str) -> DataFrame:
    return csv_table(spark, f"{folder}/ratings.csv", RATINGS, ["userId", "movieId", "rating"])


def titles_csv(spark: SparkSession, folder: str) -> DataFrame:
    return csv_table(spark, f"{folder}/movies.csv", MOVIES, ["movieId", "title"])


def links_csv(spark: SparkSession, folder: str) -> DataFrame:
    return csv_table(spark, f"{folder}/links.csv", LINKS, ["movieId", "tmdbId"]).where("tmdbId IS NOT NULL").select("movieId", F.col("tmdbId").cast("long").alias("id"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is at a path, in whatever store Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def find_dataset(spark: SparkSession, root: str) -> tuple[str, str] | None:
    """("csv", folder) of the first folder below root with ratings, else ("db", file), else None."""
    target = lambda pattern: spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}")
    for kind, pattern in (("csv", "*/ratings.csv"), ("db", "*.db")):
        path = target(pattern)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        names = sorted(str(f.getPath()) for f in found or [])
        if names:
            return kind, names[0].removesuffix("/ratings.csv")
    return None


def union_existing(spark: SparkSession, root: str, names: tuple[str, ...] = ("ratings", "ratings_train", "ratings_test")) -> DataFrame | None:
    """All tables of those that are there, one below the other."""
    out = None
    for name in names:
        if exists(spark, f"{root}/{name}.parquet"):
            part = spark.read.parquet(f"{root}/{name}.parquet")
            out = part if out is None else out.unionByName(part)
    return out


def legacy_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Old JSON records by id: a score that leaked in goes, the key stands for a missing id."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, struct<{schema}>>").alias("m"))
    each = raw.select(F.explode("m").alias("key", "r")).select("key", "r.*")
    return each.withColumn("id", F.coalesce(F.col("id").cast("long"), F.col("key").try_cast("long"))).drop("key", "score")


def import_once(store: DataFrame, legacy: DataFrame) -> DataFrame:
    """Legacy rows, only if the store is empty."""
    return legacy.limit(0) if not store.isEmpty() else legacy


def features(details: Column) -> Column:
    """Item record of a nested JSON text: crew by job, lists cut, gaps filled."""
    d = F.from_json(details, DETAILS)
    names = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<struct<name: string>>")), lambda x: x["name"]), lambda n: n.isNotNull())
    crew = F.coalesce(d["crew"], F.array().cast(f"array<{PERSON}>"))
    jobs = lambda *wanted: F.transform(F.filter(crew, lambda p: p["job"].isin(*wanted)), lambda p: p["name"])
    people = F.transform(F.coalesce(d["cast"], F.array().cast(f"array<{PERSON}>")), lambda p: p["name"])
    text = lambda c: F.coalesce(c, F.lit(""))
    year = F.substring(text(d["release_date"]), 1, 4)
    return F.struct(
        F.lit(2).alias("_v"), d["id"].alias("id"), text(d["title"]).alias("title"), year.alias("year"), T.decade(year).alias("decade"), names(d["genres"]).alias("genres"), F.slice(names(d["keywords"]), 1, 20).alias("keywords"),
        F.slice(people, 1, 8).alias("cast"), text(F.get(jobs("Director"), F.lit(0))).alias("director"), F.slice(jobs("Director"), 1, 2).alias("directors"), F.slice(jobs("Screenplay", "Writer", "Story"), 1, 3).alias("writers"),
        T.overview_terms(d["overview"]).alias("overview_terms"), text(d["overview"]).alias("overview"), text(d["tagline"]).alias("tagline"), F.coalesce(d["runtime"], F.lit(0)).alias("runtime"),
        F.coalesce(d["vote_average"], F.lit(0.0)).alias("vote_average"), F.coalesce(d["vote_count"], F.lit(0)).alias("vote_count"), F.coalesce(d["popularity"], F.lit(0.0)).alias("popularity"),
    )


def grid_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, pos, title, year, slug, rating) of the grid items of HTML pages."""
    items = F.regexp_extract_all(html, F.lit(r"(?s)<li[^>]*class=\"[^\"]*\bgriditem\b[^\"]*\".*?</li>"), F.lit(0))
    each = pages.select("page_id", F.posexplode(items).alias("pos", "li"))
    poster = F.regexp_extract("li", r"(?s)<div[^>]*class=\"[^\"]*\breact-component\b[^>]*>", 0)
    attribute = lambda name: F.nullif(F.regexp_extract(poster, rf"\b{name}=\"([^\"]*)\"", 1), F.lit(""))
    rating = F.regexp_extract("li", r"(?s)<span[^>]*class=\"([^\"]*\brating\b[^\"]*)\"[^>]*>(.*?)</span>", 1)
    stars = F.trim(F.regexp_extract("li", r"(?s)<span[^>]*class=\"[^\"]*\brating\b[^\"]*\"[^>]*>(.*?)</span>", 1))
    name = F.coalesce(attribute("data-item-name"), attribute("data-item-full-display-name"))
    named = each.select("page_id", "pos", name.alias("name"), F.coalesce(attribute("data-item-slug"), F.lit("")).alias("slug"), T.rating_of_markup(rating, stars).alias("rating")).where("name IS NOT NULL")
    return named.withColumn("t", T.split_title_year(F.col("name"))).select("page_id", "pos", "t.title", "t.year", "slug", "rating")


def listed_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, pos, href, label) of links that are list items."""
    whole = F.regexp_extract_all(html, F.lit("<li><a href=\"([^\"]*)\">([^<]*)</a></li>"), F.lit(0))
    each = pages.select("page_id", F.posexplode(whole).alias("pos", "li"))
    part = lambda k: F.regexp_extract("li", "<li><a href=\"([^\"]*)\">([^<]*)</a></li>", k)
    return each.select("page_id", "pos", part(1).alias("href"), part(2).alias("label"))


def more_pages(status: Column, films: Column, full_page: int = 72) -> Column:
    """Whether a scrape goes on behind a page: it was answered, and it was full."""
    return (status == 200) & (films >= full_page)


def listed_prefix(pages: DataFrame, full_page: int = 72) -> DataFrame:
    """Pages of each list that a reader gets who stops at the first one that failed or was not full: all before it, and it too if it was answered.

    pages: (list, page, status, films), pages from 1, each once. A page that is not there counts as failed. Lists are cut by their first
    stop, a minimum, so no task needs the whole of a list.
    """
    stops = pages.groupBy("list").agg(F.min(F.when(~F.coalesce(more_pages(F.col("status"), F.col("films"), full_page), F.lit(False)), F.col("page"))).alias("__stop"))
    before = pages.select("list", (F.col("page") + 1).alias("page"))
    gaps = pages.where("page > 1").select("list", "page").join(before, ["list", "page"], "left_anti").groupBy("list").agg(F.min("page").alias("__gap"))
    cut = pages.join(stops, "list", "left").join(gaps, "list", "left")
    answered = F.coalesce(F.col("status") == 200, F.lit(False))
    kept = F.col("__stop").isNull() | (F.col("page") < F.col("__stop")) | ((F.col("page") == F.col("__stop")) & answered)
    return cut.where(kept & (F.col("__gap").isNull() | (F.col("page") < F.col("__gap")))).drop("__stop", "__gap")


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """A saved table, or None where there is none or it can't be read."""
    if not exists(spark, path):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def same_ids(saved: DataFrame, items: DataFrame) -> bool:
    """Whether a saved graph is for exactly these items; else it is stale."""
    a, b = saved.select("id").distinct(), items.select("id").distinct()
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
