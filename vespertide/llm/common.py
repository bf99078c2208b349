"""Small helpers that every corpus operator shares."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names, or the one that was set on the context."""
    here = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not here:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return here.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{scratch_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._vt_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table that materialize() wrote and that nothing reads any more."""
    path = getattr(df, "_vt_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: Column) -> Column:
    """A null text counts as empty."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds __vt_id and __vt_text_hash. Rows alike in both are one document given twice and get the same result."""
    return df.withColumns({"__vt_id": F.col(id_col).cast("long"), "__vt_text_hash": F.xxhash64(whole_text(F.col(text_col)))})


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["__vt_id"].eqNullSafe(b["__vt_id"]) & (a["__vt_text_hash"] == b["__vt_text_hash"])


#: Rows of one key that a join keeps together; keys of more are dealt in shards.
HOT_ROWS = 4_096
#: Keys that are broadcast at most.
MOST_HOT_KEYS = 100_000


def group_sizes(rows: DataFrame, on: str, least: int) -> tuple[DataFrame, DataFrame | None]:
    """Tables (on, __vt_n) of keys with more than `least` rows: the largest, MOST_HOT_KEYS of them at most, and the others, or None if there are no others."""
    counts = materialize(rows.groupBy(on).agg(F.count("*").alias("__vt_n")).where(F.col("__vt_n") > least), "group-sizes")
    n, total = counts.agg(F.count("*"), F.sum("__vt_n")).first()
    if n <= MOST_HOT_KEYS:
        return counts, None
    # Fewer than MOST_HOT_KEYS keys can have more rows than this.
    bar = total / MOST_HOT_KEYS
    return counts.where(F.col("__vt_n") > bar), counts.where(F.col("__vt_n") <= bar)


def with_size(rows: DataFrame, on: str, least: int) -> DataFrame:
    """rows with __vt_n, the rows of their key if more than `least`, else null. The largest keys are looked up by broadcast, so none puts its rows in one task."""
    largest, others = group_sizes(rows, on, least)
    out = rows.join(F.broadcast(largest), on, "left")
    if others is None:
        return out
    rest = out.where("__vt_n IS NULL").drop("__vt_n").join(others, on, "left")
    return out.where("__vt_n IS NOT NULL").unionByName(rest)


def hot_join(rows: DataFrame, side: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """rows joined with side, which has each key once. The largest keys with more than HOT_ROWS rows are dealt over shards, and their row of the side is copied to each.

    Any key left whole has at most HOT_ROWS rows, or one part in MOST_HOT_KEYS of all.
    """
    largest, _ = group_sizes(rows, on, HOT_ROWS)
    if largest.isEmpty():
        return rows.join(side, on, how)
    hot = F.broadcast(largest.select(on, F.ceil(F.col("__vt_n") / HOT_ROWS).cast("int").alias("__vt_of")))
    names = [c for c in rows.columns if c != on] + ([c for c in side.columns if c != on] if how not in ("left_semi", "left_anti") else [])
    spread = F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")]), F.coalesce("__vt_of", F.lit(1))).cast("int")
    a = rows.join(hot, on, "left").withColumn("__vt_shard", spread).drop("__vt_of")
    b = side.join(hot, on, "left").withColumn("__vt_shard", F.explode(F.sequence(F.lit(0), F.coalesce("__vt_of", F.lit(1)) - 1))).drop("__vt_of")
    return a.join(b, [on, "__vt_shard"], how).select(on, *names)
