"""Votes and requests as streams: last write wins, counts, and one request per user in a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vespertide.settings import DEFAULTS
from vespertide.streaming.spacing import spaced_requests

ACCEPTED = "user_id long, event_id long, ts timestamp_ntz, accepted boolean"


def current_votes(stream: DataFrame) -> DataFrame:
    """(user_id, item, verdict) kept up to date: write it in update mode. Also works on a table."""
    last = F.max_by("verdict", F.struct("ts", "event_id"))
    return stream.groupBy("user_id", "item").agg(last.alias("verdict"))


def votes_by_window(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(begin, up, down) of votes; late ones count until the watermark has passed."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counts = timed.groupBy(F.window("at", width)).agg(F.count_if(F.col("verdict") > 0).alias("up"), F.count_if(F.col("verdict") <= 0).alias("down"))
    return counts.select(F.col("window.start").alias("begin"), "up", "down")


def spaced(times: list[float], last: float | None, gap_s: float) -> tuple[list[bool], float | None]:
    """Which of the ordered times are accepted: those gap_s or more behind the last accepted one; a refusal moves nothing."""
    out = []
    for t in times:
        ok = last is None or t - last >= gap_s
        out.append(ok)
        last = t if ok else last
    return out, last


def accept_requests(stream: DataFrame, gap_s: float = DEFAULTS.rate_limit_s) -> DataFrame:
    """Requests of a stream with whether they are accepted; the state of a user is one time."""

    def each(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        ok, last = spaced([t.timestamp() for t in rows["ts"]], last, gap_s)
        if last is not None:
            state.update((last,))
        yield rows[["user_id", "event_id", "ts"]].assign(accepted=ok)

    return stream.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(each, ACCEPTED, "last double", "append", GroupStateTimeout.NoTimeout)


def accept_requests_batch(log: DataFrame, gap_s: float = DEFAULTS.rate_limit_s) -> DataFrame:
    """The same over a table, where a user's requests may be most of it."""
    return spaced_requests(log, gap_s)
