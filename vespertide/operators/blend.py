"""Blending of signals: every one standardised for the query, then a weighted mean over those that cover the item."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vespertide.operators.common import kept, standardised
from vespertide.operators.signals import profile_scores
from vespertide.settings import DEFAULTS, Settings


def covered_by_any(signals: list) -> DataFrame:
    """Items that any signal covers, also one without weight here."""
    return reduce(DataFrame.unionByName, [s.covered() for s in signals]).distinct()


def combined(parts: list[tuple[float, DataFrame]], by: list[str] | None = None) -> DataFrame | None:
    """(id, s), or (*by, id, s): weights are made whole for each item over the signals that have a say on it."""
    live = [(w, p) for w, p in parts if w > 0 and p is not None]
    if not live:
        return None
    rows = [standardised(p, by=by).select(*(by or []), "id", F.lit(float(w)).alias("w"), "z") for w, p in live]
    return reduce(DataFrame.unionByName, rows).groupBy(*(by or []), "id").agg((F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("s"))


def assembled(signals: list, settings: Settings = DEFAULTS) -> list:
    """The signals that are there and have a weight in some context; a blend needs at least one."""
    live = [x for x in signals if x is not None and max(settings.weights(c)[x.name] for c in ("reference", "query")) > 0]
    if not live:
        raise ValueError("no signal is there")
    return live


def reference_scores(signals: list, seeds: DataFrame, settings: Settings = DEFAULTS) -> DataFrame | None:
    """(id, s): the mean over the named items of the blend for each; 0 where it has no say. None where no signal covers a named item."""
    weights = settings.weights("reference")
    # Scores are read twice, for their mean and spread and for themselves.
    each = kept(combined([(weights[x.name], kept(x.to_seeds(seeds))) for x in signals if weights[x.name] > 0], by=["seed"]))
    if each.isEmpty():
        return None
    grid = covered_by_any(signals).crossJoin(F.broadcast(each.select("seed").distinct()))
    return grid.join(each, ["seed", "id"], "left").groupBy("id").agg(F.avg(F.coalesce("s", F.lit(0.0))).alias("s"))


def query_scores(signals: list, text: str, keywords: list[str], settings: Settings = DEFAULTS) -> DataFrame | None:
    weights = settings.weights("query")
    found = combined([(weights[x.name], x.to_query(text, keywords)) for x in signals if weights[x.name] > 0])
    return None if found is None else filled(signals, found)


def taste_scores(signals: list, liked: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    weights = settings.weights("reference")
    return filled(signals, combined([(weights[x.name], profile_scores(x, liked, settings)) for x in signals if weights[x.name] > 0]))


def filled(signals: list, scores: DataFrame) -> DataFrame:
    return covered_by_any(signals).join(scores, "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("s"))
