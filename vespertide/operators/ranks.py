"""Ranks without a window over everything: rows are dealt by range and moved on by what the parts before hold.

The range goes down to the id, so rows of one score are cut into parts like any others, and a score that
fills most of a case is ranked by as many tasks as it takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vespertide.operators.common import kept, small


def dealt(rows: DataFrame, *order: Column) -> DataFrame:
    """rows written in parts of a range each, with column __part that grows along the order."""
    return kept(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))


def before_part(sizes: DataFrame, by: list[str]) -> Column:
    """What the parts before hold; sizes: (*by, __part, __n)."""
    return F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def ranked(scores: DataFrame, by: list[str], ties: bool = True) -> DataFrame:
    """scores with rank within `by`, best s first. With ties, equal scores rank by id; without, they share the best rank."""
    parts = dealt(scores, *[F.col(c) for c in by], F.desc("s"), F.col("id"))
    sizes = parts.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.max("s").alias("__first"), F.min("s").alias("__last"))
    sizes = sizes.withColumn("__before", before_part(sizes, by))
    order = W.partitionBy(*by, "__part").orderBy(F.desc("s"), *(["id"] if ties else []))
    inside = parts.withColumn("__in", (F.row_number() if ties else F.rank()).over(order))
    if ties:
        moved = inside.join(small(sizes.select(*by, "__part", "__before")), [*by, "__part"])
        return moved.withColumn("rank", F.col("__before") + F.col("__in")).drop("__part", "__in", "__before")
    # A part's first score may have begun in a part before it, which then ends with it: its rank is the first place it has there.
    ends = inside.join(small(sizes.select(*by, "__part", "__before", "__last")), [*by, "__part"]).where(F.col("s").eqNullSafe(F.col("__last")))
    began = kept(ends.groupBy(*by, F.col("s").alias("__first")).agg(F.min(F.col("__before") + F.col("__in")).alias("__began")))
    carried = sizes.select(*by, "__part", "__before", "__first").join(began, [*by, "__first"], "left")
    moved = inside.join(small(carried), [*by, "__part"])
    here = F.col("__before") + F.col("__in")
    rank = F.when(F.col("s").eqNullSafe(F.col("__first")), F.least(here, F.coalesce("__began", here))).otherwise(here)
    return moved.withColumn("rank", rank).drop("__part", "__in", "__before", "__first", "__began")
