"""Helpers that several operators share."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vespertide.settings import DEFAULTS


def small(df: DataFrame, rows: int = DEFAULTS.broadcast_rows) -> DataFrame:
    """df marked for broadcast if a count proves that it has at most `rows` rows; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """df with the columns of a table of one row, an aggregate: the parallel form of a window over everything."""
    return df.crossJoin(F.broadcast(row))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the one that was set on the context."""
    here = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not here:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return here.rstrip("/")


#: Tables kept on the way to a result that is being made, innermost last.
_SCOPES: list[list[DataFrame]] = []


def finished(make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make() gives, written; what make() kept on the way is deleted. For results that are small beside what they were made of."""
    scope: list[DataFrame] = []
    _SCOPES.append(scope)
    try:
        out = make()
        _SCOPES.pop()
        return kept(out)
    finally:
        if _SCOPES and _SCOPES[-1] is scope:
            _SCOPES.pop()
        for table in scope:
            dropped(table)


def kept(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: for tables that a query reads many times.

    Plans stay small, as what was written is a leaf of them, and executors may be lost.
    """
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def folder(spark: SparkSession, path: str) -> tuple:
    """The file system of a path and the path in its terms."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def dropped(df: DataFrame) -> None:
    """Delete what kept() wrote, once nothing reads it any more."""
    fs, target = folder(df.sparkSession, df._kept_at)
    fs.delete(target, True)


def source_mark(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files at a path: a saved table holds as long as this does."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    files = list(found or [])
    inside = [x for f in files if f.isDirectory() for x in target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(f.getPath())]
    said = sorted(f"{x.getPath()}:{x.getLen()}:{x.getModificationTime()}" for x in files + inside)
    return hashlib.sha256("\n".join(said).encode()).hexdigest()


def digest_of(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def files_of(spark: SparkSession, path: str) -> dict[str, int]:
    """Names and lengths of the data files in a folder."""
    fs, at = folder(spark, path)
    return {f.getPath().getName(): f.getLen() for f in fs.listStatus(at) if not f.getPath().getName().startswith(("_", "."))}


def save_table(df: DataFrame, path: str, made_of: dict) -> None:
    """Write a table to path/data, and behind it a manifest of what it was made of, its files and its rows."""
    spark, data = df.sparkSession, f"{path}/data"
    df.write.parquet(data)
    rows = spark.read.schema(df.schema).parquet(data).count()
    body = made_of | {"schema": df.schema.jsonValue(), "files": files_of(spark, data), "rows": rows}
    fs, target = folder(spark, f"{path}/manifest.json")
    out = fs.create(target, False)
    try:
        out.write(bytearray(json.dumps(body | {"digest": digest_of(body)}).encode()))
    finally:
        out.close()


def load_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that save_table() wrote, or None where it is missing, unfinished, or not what its manifest says."""
    fs, at = folder(spark, f"{path}/manifest.json")
    if not fs.exists(at):
        return None
    try:
        stated = json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0])
        body = {k: v for k, v in stated.items() if k != "digest"}
        if stated["digest"] != digest_of(body) or files_of(spark, f"{path}/data") != stated["files"]:
            return None
        table = spark.read.schema(StructType.fromJson(stated["schema"])).parquet(f"{path}/data")
        return table if table.count() == stated["rows"] else None
    except (AttributeError, KeyError, TypeError, ValueError, PySparkException, Py4JJavaError):
        return None


#: Tables that a session has checked already: (application, path) to table.
_CHECKED: dict[tuple[str, str], DataFrame] = {}


def saved(spark: SparkSession, name: str, sources: list[str], build: Callable[[], DataFrame], made_of=()) -> DataFrame:
    """The table that build makes from files, written to the shared folder once and loaded from then on, by any session that
    shares the folder, until a source changes or what is in made_of (settings, and plans of inputs).

    It is written beside its place and renamed to it, so it is there whole or not at all; one that was cut is made anew.
    """
    key = {"name": name, "sources": [source_mark(spark, s) for s in sources], "made_of": digest_of(list(made_of)), "version": DEFAULTS.feature_version}
    # The setting's own folder, as that of the context is another one for every session.
    root = (spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark)).rstrip("/")
    path = f"{root}/saved/{name}-{digest_of(key)[:32]}"
    held = (spark.sparkContext.applicationId, path)
    if held in _CHECKED:
        return _CHECKED[held]
    found = load_table(spark, path)
    if found is None:
        made = f"{path}-{uuid.uuid4().hex}"
        save_table(build(), made, key)
        (fs, place), (_, source) = folder(spark, path), folder(spark, made)
        fs.delete(place, True)
        fs.mkdirs(place.getParent())
        # If another session put its copy there first, this one stays where it was made.
        renamed = fs.rename(source, place)
        found = (load_table(spark, path) if renamed else None) or load_table(spark, made)
    # Names what the table holds in any session; hashes of a plan that reads parquet hold in one JVM alone.
    found._saved_as = path.rsplit("/", 1)[-1]
    _CHECKED[held] = found
    return found


def content_mark(df: DataFrame) -> str | int:
    """What a table is made of, to tell it from others: the name it is saved by, or else its plan's hash in this session."""
    return getattr(df, "_saved_as", None) or df.semanticHash()


def literal_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A request's own values (ids, titles, weights) as a table of one partition."""
    return spark.createDataFrame(rows, schema).coalesce(1)


def first_seen(df: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct keys with the position of their first occurrence."""
    return df.groupBy(key).agg(F.min(position).alias(position))


def latest(log: DataFrame, keys: list[str], values: list[str], *order: str) -> DataFrame:
    """Last write per key. Partial maxima are taken before the shuffle, so a hot key moves one row a task."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("last")
    return log.groupBy(*keys).agg(last).select(*keys, "last.*")


def standardised(scores: DataFrame, value: str = "s", by: list[str] | None = None) -> DataFrame:
    """scores with column z: standard deviations (population) above the mean. Groups of fewer than two rows or without spread vanish."""
    stats = [F.count(value).alias("__n"), F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__std")]
    if by:
        joined = scores.join(small(scores.groupBy(*by).agg(*stats)), by)
    else:
        joined = with_one_row(scores, scores.agg(*stats))
    kept = joined.where((F.col("__n") >= 2) & (F.col("__std") > 0))
    return kept.withColumn("z", (F.col(value) - F.col("__mean")) / F.col("__std")).drop("__n", "__mean", "__std")


def top_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def numbered(df: DataFrame, by: list[str], *order: Column, into: str = "place") -> DataFrame:
    return df.withColumn(into, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


#: Parts of a group whose first rows are taken before those of the whole group.
SHARDS = 32


def first_numbered(df: DataFrame, by: list[str], n: int, *order: Column, into: str = "place") -> DataFrame:
    """The first n rows of each group, numbered. First those of each part of a group, so a group of most rows is ordered by many tasks."""
    part = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t]), F.lit(SHARDS))
    some = numbered(df.withColumn("__part", part), [*by, "__part"], *order, into=into).where(F.col(into) <= n).drop("__part", into)
    return numbered(some, by, *order, into=into).where(F.col(into) <= n)
