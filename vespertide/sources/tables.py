"""The tables of the engine: items, vectors, ratings, votes and edges, read from parquet.

Items are documents: their language is the genre, their source the collection, their text the synopsis;
the title is the first 30 characters of the text, a mapping, as documents have no titles; year and director
follow from the id. Records have one version; queries about versions ask for some older ones. Ratings come from orders (quantity to
half stars), votes from events, edges from parts that were ordered together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vespertide.functions import text as T
from vespertide.operators.common import kept, saved, small
from vespertide.settings import DEFAULTS

EDGES_PER_ITEM = 20
STALE_EVERY = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, stale_every: int | None = None) -> DataFrame:
    """All stored item records; with stale_every, each so-manieth one is of an older version."""
    version = F.lit(DEFAULTS.feature_version)
    if stale_every:
        version = F.when(F.pmod(F.col("doc_id"), F.lit(stale_every)) == 0, 1).otherwise(version)
    i = F.col("doc_id")
    none = F.array().cast("array<string>")
    base = table(spark, sf_dir, "documents").select(
        version.alias("_v"), i.alias("id"), F.trim(F.substring("text", 1, 30)).alias("title"),
        (F.lit(1950) + F.pmod(i, F.lit(70))).cast("string").alias("year"), F.array("lang").alias("genres"), T.overview_terms(F.col("text")).alias("overview_terms"),
        F.concat(F.lit("Person "), F.pmod(i, F.lit(97)).cast("string")).alias("director"), F.col("source").alias("collection"), F.col("text").alias("overview"),
        (F.pmod(i, F.lit(100)) / 10).alias("vote_average"), F.pmod(i * 37, F.lit(1000)).cast("int").alias("vote_count"), (F.pmod(i * 13, F.lit(200)) / 2).alias("popularity"),
    )
    return base.withColumns({"keywords": F.slice("overview_terms", 1, 4), "cast": none, "directors": none, "writers": none, "tagline": F.lit(""), "decade": T.decade(F.col("year"))})


def full_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with its texts: every record of the current version that has a genre."""
    return records(spark, sf_dir).where((F.col("_v") == DEFAULTS.feature_version) & (F.size("genres") > 0))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without its texts, whose terms are taken once and saved."""
    return saved(spark, "items", [f"{sf_dir}/documents.parquet"], lambda: full_items(spark, sf_dir).drop("overview"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec, label): vectors of the items that have one."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, item, rating), ratings from 0.5 to 5; a pair may come more than once."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"), (F.ceil(F.col("l_quantity") / 5) / 2).alias("rating"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user"))
    return lines.join(orders, "l_orderkey").select("user", "item", "rating")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of votes: a purchase is one up, an error one down."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    return e.select("event_id", F.col("user_id"), F.get_json_object("props", "$.k").cast("long").alias("item"), F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("verdict"), "ts")


def edges(spark: SparkSession, sf_dir: str, per_item: int = EDGES_PER_ITEM) -> DataFrame:
    """(src, dst, rank): what was ordered together, most often first, ranks from 0. Made once and saved."""
    return saved(spark, "edges", [f"{sf_dir}/lineitem.parquet"], lambda: ordered_together(table(spark, sf_dir, "lineitem"), per_item), [per_item])


def edges_of(spark: SparkSession, sf_dir: str, ids: list[int], per_item: int = EDGES_PER_ITEM) -> DataFrame:
    """The rows of edges() of these items alone, from the orders they are in."""
    return ordered_together(table(spark, sf_dir, "lineitem"), per_item, ids)


#: Orders of an item from which its neighbours are counted by many tasks.
BUSY_ORDERS = 100_000


def ordered_together(lines: DataFrame, per_item: int, of: list[int] | None = None) -> DataFrame:
    """Neighbours of every item, or of those in `of` alone.

    Pairs of an order are what is counted, so their number is that of its lines squared; orders have a handful. They are made
    behind the last shuffle: an item travels with the list of its order, and is counted and ranked where it arrives.
    """
    lines = lines.select("l_orderkey", F.col("l_partkey").alias("item")).where("l_orderkey IS NOT NULL AND item IS NOT NULL")
    if of is not None:
        lines = lines.join(small(lines.where(F.col("item").isin(of)).select("l_orderkey").distinct()), "l_orderkey", "left_semi")
    lists = lines.repartition("l_orderkey").groupBy("l_orderkey").agg(F.collect_set("item").alias("list")).where(F.size("list") > 1)
    each = lists.select(F.explode("list").alias("src"), "list")
    if of is not None:
        each = each.where(F.col("src").isin(of))
    busy = kept((lines if of is None else lines.where(F.col("item").isin(of))).groupBy(F.col("item").alias("src")).agg(F.count("*").alias("orders")).where(F.col("orders") >= BUSY_ORDERS).select("src"))
    if busy.isEmpty():
        return most_often(each, per_item)
    few, many = (each.join(F.broadcast(busy), "src", how) for how in ("left_anti", "left_semi"))
    counted = many.select("src", F.explode("list").alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("src").orderBy(F.desc("n"), "dst"))
    ranked = counted.withColumn("place", place).where(F.col("place") <= per_item).select("src", "dst", (F.col("place") - 1).alias("rank"))
    return most_often(few, per_item).unionByName(ranked)


def most_often(each: DataFrame, per_item: int) -> DataFrame:
    """(src, dst, rank) of items whose orders are few enough for a task. each: (src, list), for every order of an item."""
    key = each.schema["src"].dataType.simpleString()

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            # The last item may go on in the next batch.
            src = b.column("src").to_numpy()
            cut = int(np.searchsorted(src, src[-1])) if len(src) else 0
            if len(src) and held and (cut or src[0] != held[-1].column("src")[-1].as_py()):
                yield neighbours([*held, b.slice(0, cut)], per_item, b.schema.field("src").type)
                held = []
            elif cut:
                yield neighbours([b.slice(0, cut)], per_item, b.schema.field("src").type)
            held.append(b.slice(cut))
        if held:
            yield neighbours(held, per_item, held[0].schema.field("src").type)

    return each.repartition("src").sortWithinPartitions("src").mapInArrow(ranked, f"src {key}, dst {key}, rank int")


def neighbours(batches: list[pa.RecordBatch], per_item: int, key: pa.DataType) -> pa.RecordBatch:
    """The neighbours of whole items, most often first, equal ones by id. batches: (src, list), sorted by src."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    src, lists = rows.column("src").to_numpy(), rows.column("list").combine_chunks()
    items, of = np.unique(src, return_inverse=True)
    dst = lists.flatten().to_numpy()
    item = np.repeat(of, lists.value_lengths().to_numpy())
    other = dst != items[item]
    item, dst = item[other], dst[other]
    order = np.lexsort((dst, item))
    item, dst = item[order], dst[order]
    begin = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (dst[1:] != dst[:-1]))) if len(item) else np.empty(0, np.int64)
    item, dst, n = item[begin], dst[begin], np.diff(np.append(begin, len(item)))
    order = np.lexsort((-n, item))
    item, dst = item[order], dst[order]
    rank = np.arange(len(item)) - np.searchsorted(item, item)
    best = rank < per_item
    return pa.RecordBatch.from_arrays([pa.array(items[item[best]], key), pa.array(dst[best], key), pa.array(rank[best].astype(np.int32))], ["src", "dst", "rank"])
