"""One request per user in a while, over a whole log.

Every request points to the next one that would be accepted if it were, the first at least a gap later. What is
accepted is the chain of a user's first request. Requests are dealt by range of user and time, so a user with
most of the log is spread over as many parts as that takes. Inside a part pointers are followed to where they
leave it, which makes a part a transition from the request a chain enters by to the one it goes on to; between
parts these transitions are followed by doubling, in as many rounds as the number of parts has binary digits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vespertide.operators.common import finished, kept, small
from vespertide.operators.ranks import dealt

NODE = ["user_id", "part", "t"]


def pointers(times: DataFrame, gap: int) -> DataFrame:
    """(user_id, part, t, to_part, to_t): times with the first time of the user that is at least a gap later, null for none. times: (user_id, t), each once."""
    points = times.select("user_id", "t", F.lit(1).alias("kind"), F.col("t").alias("at"))
    probes = times.select("user_id", "t", F.lit(0).alias("kind"), (F.col("t") + gap).alias("at"))
    # A probe stands before a point of its time, so what follows it is what it looks for.
    parts = dealt(points.unionByName(probes), F.col("user_id"), F.col("at"), F.col("kind"), F.col("t")).withColumnRenamed("__part", "part")
    point = F.when(F.col("kind") == 1, F.struct("part", F.col("t").alias("t")))
    following = F.first(point, ignorenulls=True).over(W.partitionBy("user_id", "part").orderBy("at", "kind", "t").rowsBetween(0, W.unboundedFollowing))
    found = parts.withColumn("to", following)
    heads = parts.groupBy("user_id", "part").agg(F.min(F.when(F.col("kind") == 1, F.col("t"))).alias("head"))
    later = F.first(F.when(F.col("head").isNotNull(), F.struct("part", F.col("head").alias("t"))), ignorenulls=True).over(W.partitionBy("user_id").orderBy("part").rowsBetween(1, W.unboundedFollowing))
    heads = heads.select("user_id", "part", later.alias("next"))
    settled = found.join(small(heads), ["user_id", "part"]).select("user_id", "part", "t", "kind", F.coalesce("to", "next").alias("to"))
    own = settled.where("kind = 1").select(*NODE)
    asked = settled.where("kind = 0").select("user_id", "t", "to.part", F.col("to.t").alias("to_t")).withColumnRenamed("part", "to_part")
    return own.join(asked, ["user_id", "t"]).select(*NODE, "to_part", "to_t")


def steps(rows: pd.DataFrame) -> np.ndarray:
    """Where each request of a part points to, -1 where that is in another part. rows: of any number of users, ordered by user and time."""
    users = np.unique(rows["user_id"].to_numpy(), return_inverse=True)[1]
    times = np.unique(rows["t"].to_numpy())
    key = lambda t: users * (len(times) + 1) + np.searchsorted(times, t)
    keys, to = key(rows["t"].to_numpy()), np.full(len(rows), -1)
    stays = (rows["to_part"] == rows["part"]).to_numpy()
    to[stays] = np.searchsorted(keys, key(rows["to_t"].to_numpy())[stays])
    return to


def transitions(rows: pd.DataFrame) -> pd.DataFrame:
    """Where the chain of each request of a part leaves it, for all its users at once. to_part: -1 for none."""
    rows = rows.sort_values(["user_id", "t"]).reset_index(drop=True)
    to = steps(rows)
    # The last request of a chain in the part points to itself.
    jump = np.where(to < 0, np.arange(len(rows)), to)
    while not np.array_equal(further := jump[jump], jump):
        jump = further
    out = rows[NODE].copy()
    out["to_part"], out["to_t"] = rows["to_part"].to_numpy()[jump], rows["to_t"].to_numpy()[jump]
    return out


def chains(entered: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """The requests of a part that are in the chains it was entered by, one a user."""
    if entered.empty or rows.empty:
        return rows[NODE].head(0)
    rows = rows.sort_values(["user_id", "t"]).reset_index(drop=True)
    to = steps(rows)
    at = rows.reset_index().merge(entered[["user_id", "t"]], on=["user_id", "t"])["index"].to_numpy()
    chosen = []
    while len(at):
        chosen.append(at)
        at = to[at]
        at = at[at >= 0]
    return rows.loc[np.concatenate(chosen), NODE] if chosen else rows[NODE].head(0)


def accepted_times(times: DataFrame, gap: int) -> DataFrame:
    """(user_id, t) of what is accepted. times: (user_id, t), whole numbers, each once and none null."""
    return finished(lambda: followed(times, gap))


def followed(times: DataFrame, gap: int) -> DataFrame:
    points = kept(pointers(times, gap))
    shape = "user_id long, part int, t long, to_part int, to_t long"
    # A part has many users or a piece of one, so whole parts are handed over. Numbers stay whole without nulls.
    filled = points.withColumns({"to_part": F.coalesce("to_part", F.lit(-1)), "to_t": F.coalesce("to_t", F.lit(0))})
    some = F.col("to_part") >= 0
    leaves = filled.groupBy("part").applyInPandas(transitions, shape)
    leaves = kept(leaves.select(*NODE, F.when(some, F.col("to_part")).alias("to_part"), F.when(some, F.col("to_t")).alias("to_t")))
    first = points.groupBy("user_id").agg(F.min(F.struct("t", "part")).alias("f")).select("user_id", "f.part", "f.t")
    # Only where some chain comes in can a chain go on.
    enters = leaves.where("to_t IS NOT NULL").select("user_id", F.col("to_part").alias("part"), F.col("to_t").alias("t")).unionByName(first).distinct()
    step = kept(leaves.join(enters, NODE, "left_semi").where("to_t IS NOT NULL"))
    reached = kept(first)
    rounds = (points.agg(F.count_distinct("part")).first()[0] or 0).bit_length()
    for _ in range(rounds):
        further = reached.join(step, NODE).select("user_id", F.col("to_part").alias("part"), F.col("to_t").alias("t"))
        more = kept(reached.unionByName(further).distinct())
        again = step.select("user_id", F.col("part").alias("to_part"), F.col("t").alias("to_t"), F.col("to_part").alias("p"), F.col("to_t").alias("x"))
        twice = kept(step.join(again, ["user_id", "to_part", "to_t"]).select(*NODE, F.col("p").alias("to_part"), F.col("x").alias("to_t")))
        reached, step = more, twice
    marked = reached.groupBy("part").cogroup(filled.groupBy("part")).applyInPandas(chains, "user_id long, part int, t long")
    return marked.select("user_id", "t")


def spaced_requests(log: DataFrame, gap_s: float) -> DataFrame:
    """(user_id, event_id, ts, accepted): a request is accepted if it comes gap_s or more behind the last accepted one of its user.

    Of requests of one user at one time the first by event_id alone can be. A request without a time is refused.
    Users may be null and are then one user. Event ids of a user's requests at one time must differ.
    """
    if gap_s <= 0:
        raise ValueError("the gap must be positive")
    timed = log.select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    # Times of users without an id are kept apart by a number no id has.
    least = F.min("user_id") - 1
    nobody = timed.agg(F.coalesce(least, F.lit(0)).alias("nobody")).first()["nobody"]
    timed = timed.withColumn("__user", F.coalesce("user_id", F.lit(nobody)))
    first = timed.where("t IS NOT NULL").groupBy(F.col("__user").alias("user_id"), "t").agg(F.min("event_id").alias("event_id"))
    chosen = accepted_times(first.select("user_id", "t"), round(gap_s * 1e6)).join(first, ["user_id", "t"])
    chosen = chosen.select(F.col("user_id").alias("__user"), "t", "event_id", F.lit(True).alias("__yes"))
    return timed.join(chosen, ["__user", "t", "event_id"], "left").select("user_id", "event_id", "ts", F.coalesce("__yes", F.lit(False)).alias("accepted"))
