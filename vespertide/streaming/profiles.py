"""A cache of profiles as a stream: a profile that was put is found until its time to live is over.

Whether an asked profile still counts is told by the times of the events alone, as the batch predicate tells it. The
state of a user also has a time to live of its own, so users who never come back are forgotten; it runs by the clock
of the cluster and is longer by what the stream may lag behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vespertide.settings import DEFAULTS

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FOUND = "user long, event_id long, ts timestamp, hit boolean, age_s long, profile string"


class ProfileCache(StatefulProcessor):
    """Events of a user in order of time and id: kind "put" with a profile, or "ask"."""

    def __init__(self, ttl_s: int, lag_s: int):
        self.ttl_s, self.state_ttl_ms = ttl_s, (ttl_s + lag_s) * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("profile", "profile string, fetched_at timestamp", self.state_ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        known = self.held.get() if self.held.exists() else None
        put, out = False, []
        for e in events.itertuples():
            if e.kind == "put":
                known, put = (e.profile, e.ts), True
                continue
            age = None if known is None else int((e.ts.floor("s") - pd.Timestamp(known[1]).floor("s")).total_seconds())
            hit = age is not None and age <= self.ttl_s
            out.append((key[0], e.event_id, e.ts, hit, age if hit else None, known[0] if hit else None))
        if put:
            self.held.update((known[0], pd.Timestamp(known[1]).to_pydatetime()))
        if out:
            frame = pd.DataFrame(out, columns=["user", "event_id", "ts", "hit", "age_s", "profile"])
            yield frame.astype({"age_s": "Int64"})

    def close(self) -> None:
        pass


def cached_profiles(events: DataFrame, ttl_s: int = DEFAULTS.profile_ttl_s, lag_s: int = 3_600) -> DataFrame:
    """(user, event_id, ts, hit, age_s, profile) of what was asked. events: a stream (user, event_id, ts timestamp, kind, profile).

    The session's state store must be the one named STORE, which is the one that knows a time to live.
    """
    return events.groupBy("user").transformWithStateInPandas(ProfileCache(ttl_s, lag_s), FOUND, "Append", "ProcessingTime")
