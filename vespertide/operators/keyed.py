"""A keyed table with a write path: last write wins, and a reader sees all of a batch or nothing.

Rows are dealt by key over a fixed number of buckets. A batch rewrites the buckets it touches beside the old
ones and then switches to them at once, by renaming a manifest that names the folder of every bucket. Until
then readers see the old folders, which stay until vacuum() takes those away that no recent manifest
names. The manifest also remembers the last batch of every stream, so a batch that comes again, as streams
do after a failure, changes nothing. A task that is lost is run again by Spark, whose files count only once
its job is whole; a writer that is lost leaves a folder that no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vespertide.operators.common import folder, latest

BUCKETS = 64
BUCKET = "__bucket"


class Conflict(Exception):
    """Another writer switched the table first."""


class KeyedTable:
    """A folder of one row a key. order: columns that say which write of a key is the last; equal ones go to the later batch."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], values: list[str], order: list[str], schema: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.keys, self.order = keys, order
        self.columns = list(dict.fromkeys([*keys, *values, *order]))
        self.schema = spark.createDataFrame([], schema).select(*self.columns).schema
        self.buckets = buckets

    # Manifests -----------------------------------------------------------------------------------------

    def _manifests(self) -> list[str]:
        fs, at = folder(self.spark, f"{self.path}/manifests")
        if not fs.exists(at):
            return []
        return sorted(n for f in fs.listStatus(at) if (n := f.getPath().getName()).endswith(".json") and not n.startswith("."))

    def manifest(self, back: int = 0) -> dict:
        """The state readers see, or one of the states before it."""
        names = self._manifests()
        if len(names) <= back:
            return {"version": 0, "buckets": {}, "batches": {}, "of": self.buckets}
        text = self.spark.read.text(f"{self.path}/manifests/{names[-1 - back]}", wholetext=True).first()[0]
        state = json.loads(text)
        if state["of"] != self.buckets:
            raise ValueError(f"the table has {state['of']} buckets, not {self.buckets}")
        return state

    def _switch(self, state: dict) -> None:
        """Make a state current, unless another writer made that version first: a rename does not replace what is there."""
        fs, made = folder(self.spark, f"{self.path}/manifests/.{uuid.uuid4().hex}")
        _, target = folder(self.spark, f"{self.path}/manifests/{state['version']:012d}.json")
        out = fs.create(made, False)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        if fs.exists(target) or not fs.rename(made, target):
            fs.delete(made, False)
            raise Conflict(f"version {state['version']} is there already")

    # Reading -------------------------------------------------------------------------------------------

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _rows(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        folders = sorted({f"{self.path}/{at}" for b, at in state["buckets"].items() if buckets is None or int(b) in buckets})
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self, back: int = 0) -> DataFrame:
        return self._rows(self.manifest(back))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Rows of the wanted keys, from their buckets alone."""
        once = wanted.select(*self.keys).distinct()
        buckets = [r[0] for r in once.select(self.bucket_of()).distinct().collect()]
        return self._rows(self.manifest(), buckets).join(once, self.keys, "left_semi")

    # Writing -------------------------------------------------------------------------------------------

    def upsert(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        """Write rows and give the version they are in. With a stream and a batch number, a batch that was written already is passed over."""
        state = self.manifest()
        if stream is not None and state["batches"].get(stream, -1) >= batch:
            return state["version"]
        values = [c for c in self.columns if c not in self.keys]
        new = latest(rows.select(*self.columns), self.keys, values, *self.order).select(*self.columns).withColumn(BUCKET, self.bucket_of())
        at = f"data/{uuid.uuid4().hex}"
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())
        if touched:
            old = self._rows(state, touched).withColumn(BUCKET, self.bucket_of())
            both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)))
            merged = latest(both, [BUCKET, *self.keys], values, *self.order, "__age").select(BUCKET, *self.columns)
            merged.repartition(F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{self.path}/{at}")
        buckets = state["buckets"] | {str(b): f"{at}/{BUCKET}={b}" for b in touched}
        batches = state["batches"] | ({stream: batch} if stream is not None else {})
        self._switch({"version": state["version"] + 1, "buckets": buckets, "batches": batches, "of": self.buckets})
        return state["version"] + 1

    def sink(self, stream: str):
        """For foreachBatch: every batch once, also where the stream runs it again."""

        def write(rows: DataFrame, batch: int) -> None:
            self.upsert(rows, stream, batch)

        return write

    def vacuum(self, keep: int = 2) -> int:
        """Delete bucket folders and manifests that the last `keep` states don't name; the number of folders deleted. Not while a writer is at work."""
        names = self._manifests()
        used = {at for back in range(min(keep, len(names))) for at in self.manifest(back)["buckets"].values()}
        fs, data = folder(self.spark, f"{self.path}/data")
        gone = 0
        for batch in fs.listStatus(data) if fs.exists(data) else []:
            inside = [f.getPath() for f in fs.listStatus(batch.getPath()) if f.isDirectory()]
            stale = [p for p in inside if f"data/{batch.getPath().getName()}/{p.getName()}" not in used]
            for p in stale:
                fs.delete(p, True)
            if len(stale) == len(inside):
                fs.delete(batch.getPath(), True)
            gone += len(stale)
        for name in names[:-keep]:
            fs.delete(folder(self.spark, f"{self.path}/manifests/{name}")[1], False)
        return gone
