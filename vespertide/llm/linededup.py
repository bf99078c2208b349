"""Repeated passages go, by content-defined chunks of lines.

A passage is a run of lines that holds PASSAGE_WORDS or more, begins and ends with a line that has
words, and stands line for line at an earlier place of the corpus (smaller document, then place; in
one document only without overlap). All its lines go, whichever document each single line is first in.

Chunks are defined by the words of their lines alone: from every line on, and back from every line, as
few lines as hold PASSAGE_WORDS. A passage is covered by the chunks inside it, so the chunks that occur
more than once find every passage, whatever stands around it. A rolling hash over the lines names a
chunk; chunks that lie alike in a document and in that of their first occurrence are joined to runs,
and a run goes only after its bytes equal those of the first one. Shorter repeats, such as single
boilerplate lines, stay. A line of PASSAGE_WORDS or more is a passage by itself; shorter lines around
it go with it, unless all of them stand in a document before that of the first occurrence: then they
are boilerplate beside a passage.

Only hashes are shuffled to find repeats. Texts of first occurrences are fetched where their list
is small enough to broadcast (FETCH_ROWS), by a shuffled join beyond that. Counts and minima are
pre-aggregated, so a chunk that a third of all documents share is one row a task.

Cases: a null text stays null and has no lines; an empty text has one empty line; a document that
consists of repeated passages stays as an empty text; repeated rows (same id and text) are one
document and keep the same text; documents with a null doc_id come first when the first occurrence
is chosen; other columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vespertide.llm.common import discard, hot_join, materialize, read_table, row_key

PASSAGE_WORDS = 50
FETCH_ROWS = 500_000
KEY = ["__vt_id", "__vt_text_hash"]


def word_count(line: Column) -> Column:
    """Words of a line, split at blanks."""
    bare = F.trim(line)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, " +")))


def joined(lines: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(lines, first + 1, last - first + 1), "\n")


def worded_lines(docs: DataFrame) -> DataFrame:
    """One row per line that has words: document, place, words, and hashes of the line alone (h) and with the lines without words before it (gap_h)."""
    lines = row_key(docs).where(F.col("text").isNotNull()).select(*KEY, F.split("text", "\n", -1).alias("__vt_lines"))
    counted = lines.select(*KEY, "__vt_lines", F.transform("__vt_lines", word_count).alias("w"))
    at = counted.select(*KEY, "__vt_lines", "w", F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i) > 0).alias("at"))

    def line(i: Column, k: Column) -> Column:
        gap = F.coalesce(F.get("at", k - 1) + 1, F.lit(0))
        return F.struct(i.alias("pos"), F.get("w", i).alias("words"), F.xxhash64(F.get("__vt_lines", i)).alias("h"), F.xxhash64(joined(F.col("__vt_lines"), gap, i)).alias("gap_h"))

    # Repeated rows of one document bring each line more than once.
    return at.select(*KEY, F.explode(F.transform("at", line)).alias("l")).select(*KEY, "l.*").repartition(*KEY).dropDuplicates([*KEY, "pos"])


def chunks_of(lines: DataFrame, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """One row per chunk: document, first and last line, words, hash, and the hashes of its short lines where it has a long one too (side)."""
    doc = W.partitionBy(*KEY)
    # Three sorts hold their rows in a task at once, and rows of hashes are small when packed, so parts by packed size would be too large.
    lines = lines.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY)
    upto = F.sum("words").over(doc.orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    placed = lines.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
    is_long = F.col("words") >= passage_words

    def chunk(frame) -> Column:
        side = F.when(F.max(is_long).over(frame), F.collect_list(F.when(~is_long, F.col("h"))).over(frame))
        return F.struct(F.min("pos").over(frame).alias("first"), F.max("pos").over(frame).alias("last"), F.sum("words").over(frame).alias("words"), F.first("h").over(frame).alias("h"), F.collect_list("gap_h").over(frame).alias("rest"), side.alias("side"))

    found = placed.select(
        *KEY,
        F.array(
            # As few lines as hold the words, onwards and backwards, and a long line with the next one. Every line has words, so `before` orders as pos does, without another sort.
            chunk(doc.orderBy("before").rangeBetween(0, passage_words - 1)),
            chunk(doc.orderBy("upto").rangeBetween(-(passage_words - 1), 0)),
            F.when(is_long, chunk(doc.orderBy("before").rowsBetween(0, 1))),
        ).alias("c"),
    )
    each = found.select(*KEY, F.explode(F.array_distinct(F.filter("c", lambda c: c["words"] >= passage_words))).alias("c")).select(*KEY, "c.*")
    rolled = F.xxhash64("h", F.slice("rest", 2, F.size("rest")))
    # A chunk may be found from both of its ends.
    return each.select(*KEY, "first", "last", "words", rolled.alias("hash"), F.when(F.size("side") > 0, F.col("side")).alias("side")).dropDuplicates([*KEY, "first", "last"])


def chunks(docs: DataFrame, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    return chunks_of(worded_lines(docs), passage_words)


def boilerplate(later: DataFrame, lines: DataFrame) -> DataFrame:
    """hash of the chunks with a long line whose short lines all stand in documents before the origin."""
    sides = later.where(F.col("side").isNotNull()).select("hash", "origin", "side").dropDuplicates(["hash"])
    sides = sides.select("hash", F.struct("origin.__vt_id", "origin.__vt_text_hash").alias("doc"), F.explode(F.array_distinct("side")).alias("h"))
    seen = lines.join(sides.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.min(F.struct(*KEY)).alias("seen"))
    return sides.join(seen, "h").groupBy("hash").agg(F.max(F.col("doc").eqNullSafe(F.col("seen"))).alias("own")).where(~F.col("own")).select("hash")


def removable(found: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Runs of lines that stand at an earlier place, with where that is; hash names the place."""
    where = F.struct(*KEY, "first", "last")
    repeated = found.groupBy("hash").agg(F.count("*").alias("n"), F.min(where).alias("origin")).where("n > 1").drop("n")
    same_doc = F.col("__vt_id").eqNullSafe(F.col("origin.__vt_id")) & (F.col("__vt_text_hash") == F.col("origin.__vt_text_hash"))
    later = hot_join(found, repeated, "hash").where(~(same_doc & (F.col("first") <= F.col("origin.last"))))
    if lines is not None:
        later = materialize(later, "later-chunks")
        later = later.join(boilerplate(later, lines), "hash", "left_anti")
    later = later.select(*KEY, "first", "last", F.col("origin.__vt_id").alias("o_id"), F.col("origin.__vt_text_hash").alias("o_hash"), (F.col("first") - F.col("origin.first")).alias("shift"))
    side = [*KEY, "o_id", "o_hash", "shift"]
    order = W.partitionBy(*side).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    starts = later.withColumn("starts", F.when(F.col("first") <= reach + 1, F.lit(0)).otherwise(F.lit(1)))
    runs = starts.withColumn("run", F.sum("starts").over(order.rowsBetween(W.unboundedPreceding, 0))).groupBy(*side, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    origin = F.struct(F.col("o_id").alias("__vt_id"), F.col("o_hash").alias("__vt_text_hash"), (F.col("first") - F.col("shift")).alias("first"), (F.col("last") - F.col("shift")).alias("last"))
    return runs.select(*KEY, "first", "last", origin.alias("origin")).withColumn("hash", F.xxhash64("origin"))


def origin_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """hash and text of first occurrences."""
    origins = wanted.select("hash", "origin.*").distinct()
    by_doc = materialize(origins.groupBy(*KEY).agg(F.collect_set(F.struct("hash", "first", "last")).alias("parts")), "origins")
    # A row is an id, a hash and some places of 16 bytes, so this bounds the bytes as well.
    size = by_doc.agg(F.count("*").alias("n"), F.sum(F.size("parts")).alias("parts")).first()
    side = F.broadcast(by_doc) if size["n"] + (size["parts"] or 0) <= FETCH_ROWS else by_doc
    keyed = row_key(docs).where(F.col("text").isNotNull()).select(*KEY, F.split("text", "\n", -1).alias("__vt_lines"))
    a, b = keyed.alias("a"), side.alias("b")
    met = a.join(b, F.col("a.__vt_id").eqNullSafe(F.col("b.__vt_id")) & (F.col("a.__vt_text_hash") == F.col("b.__vt_text_hash"))).select("__vt_lines", "parts")
    texts = F.transform("parts", lambda p: F.struct(p["hash"].alias("hash"), joined(F.col("__vt_lines"), p["first"], p["last"]).alias("origin_text")))
    return met.select("__vt_lines", F.explode(texts).alias("t")).select("t.*").dropDuplicates(["hash"])


def united(runs: Column, p: Column) -> Column:
    """Disjoint runs with one more, whose first line is not before theirs."""
    n = F.size(runs)
    end = F.get(runs, n - 1)
    grown = F.struct(end["first"].alias("first"), F.greatest(end["last"], p["last"]).alias("last"))
    meets = (n > 0) & (p["first"] <= end["last"] + 1)
    return F.when(meets, F.concat(F.slice(runs, 1, F.greatest(n - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(runs, F.array(F.struct(p["first"].alias("first"), p["last"].alias("last")))))


def drop_repeated_passages(docs: DataFrame, passage_words: int = PASSAGE_WORDS, counts: bool = False) -> DataFrame:
    """docs with repeated passages removed from text (and n_chars brought in line); with counts also __vt_n_lines and __vt_n_removed."""
    lines = materialize(worded_lines(docs.select("doc_id", "text")), "lines")
    found = materialize(chunks_of(lines, passage_words), "line-chunks")
    wanted = materialize(removable(found, lines), "repeated-chunks")
    discard(found)
    discard(lines)
    texts = materialize(origin_texts(docs.select("doc_id", "text"), wanted), "origin-texts")
    parts = hot_join(wanted, texts, "hash").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("first", "last", F.col("origin_text").alias("text")))).alias("__vt_parts"))
    keyed = row_key(docs)
    same = F.col("d.__vt_id").eqNullSafe(F.col("p.__vt_id")) & (F.col("d.__vt_text_hash") == F.col("p.__vt_text_hash"))
    both = keyed.alias("d").join(parts.alias("p"), same, "left").select("d.*", "p.__vt_parts").withColumn("__vt_lines", F.split("text", "\n", -1))
    # The comparison of bytes: only runs that equal the first occurrence go.
    lines = F.col("__vt_lines")
    equal = F.filter("__vt_parts", lambda p: joined(lines, p["first"], p["last"]) == p["text"])
    proven = both.withColumn("__vt_go", F.aggregate(equal, F.array().cast("array<struct<first:int,last:int>>"), united))
    go, n = F.col("__vt_go"), F.size("__vt_lines")

    def between(k: Column) -> Column:
        first = F.coalesce(F.get(go, k - 1)["last"] + 1, F.lit(0))
        last = F.coalesce(F.get(go, k)["first"], n)
        return F.slice(lines, first + 1, F.greatest(last - first, F.lit(0)))

    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("__vt_go")), between)), "\n")
    out = proven.withColumn("text", F.when(F.col("__vt_parts").isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__vt_parts").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    if counts:
        removed = F.coalesce(F.aggregate("__vt_go", F.lit(0), lambda a, p: a + p["last"] - p["first"] + 1), F.lit(0))
        out = out.withColumns({"__vt_n_lines": F.coalesce(n, F.lit(0)).cast("long"), "__vt_n_removed": removed.cast("long")})
        return out.select(*docs.columns, "__vt_n_lines", "__vt_n_removed")
    return out.select(*docs.columns)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier document has."""
    out = drop_repeated_passages(read_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return out.select("doc_id", F.col("__vt_n_lines").alias("n_lines"), F.col("__vt_n_removed").alias("n_removed"), "text")
