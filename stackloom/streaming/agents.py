"""Which agents are alive: the last push of each node."""

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stackloom.streaming.state import use_state_variables

EXPIRY_NANOS = 300_000_000_000


def agents(pushes: DataFrame, now_nanos: int | None = None, expiry_nanos: int = EXPIRY_NANOS) -> DataFrame:
    """Latest push per agent, without those older than the expiry.

    ``pushes``: node, address, time_nanos, push_nanos, error. An agent is its
    node together with its address; it is listed by node name, else by that key.
    ``now_nanos`` defaults to the latest push of all.
    """
    latest = F.max(F.struct("time_nanos", "push_nanos", "error"))
    per_agent = pushes.groupBy(F.concat(F.coalesce("node", F.lit("")), "address").alias("key"), "node").agg(latest.alias("l"))
    now = F.lit(now_nanos) if now_nanos is not None else pushes.agg(F.max("time_nanos")).scalar()
    return per_agent.where(F.col("l.time_nanos") >= now - expiry_nanos).select(
        F.coalesce(F.nullif(F.col("node"), F.lit("")), "key").alias("id"), F.col("key"),
        F.col("l.time_nanos").alias("last_push"), F.col("l.push_nanos").alias("push_duration"),
        F.coalesce("l.error", F.lit("")).alias("last_error"))


class LastPush(StatefulProcessor):
    """The latest push of an agent, and a timer for the end of its life. Pushes of a batch are compared as columns."""

    def __init__(self, expiry_millis: int):
        self.expiry = expiry_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "time_nanos bigint, push_nanos bigint, error string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get() if self.last.exists() else None
        found = [] if known is None else [pd.DataFrame([known], columns=["time_nanos", "push_nanos", "error"])]
        found += [pdf[["time_nanos", "push_nanos", "error"]] for pdf in rows]
        pushes = pd.concat(found).astype({"error": object}).fillna({"error": ""})
        t, push, error = pushes.sort_values(["time_nanos", "push_nanos", "error"]).iloc[-1]
        self.last.update((int(t), int(push), error))
        if known is None:
            self.handle.registerTimer(int(t) // 1_000_000 + self.expiry)
        yield self._row(key, int(t), int(push), error, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        t, push, error = self.last.get()
        end = t // 1_000_000 + self.expiry
        if end > expiredTimerInfo.getExpiryTimeInMs():  # it has pushed since this was set
            self.handle.registerTimer(end)
            return
        self.last.clear()
        yield self._row(key, t, push, error, True)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, t: int, push: int, error: str, expired: bool) -> pd.DataFrame:
        return pd.DataFrame({"id": [key[0]], "last_push": [t], "push_duration": [push], "last_error": [error], "expired": [expired]})


def live_agents(pushes: DataFrame, expiry: str = "5 minutes") -> DataFrame:
    """Streaming form: updates per agent, and one ``expired`` row when it falls silent.

    ``pushes``: as for :func:`agents` with ``ts timestamp``. State is one row per
    agent, dropped by event time once the expiry has passed. Of pushes at the same time the longest counts, as in
    :func:`agents`.
    """
    use_state_variables(pushes.sparkSession)
    millis = int(pd.Timedelta(expiry).total_seconds() * 1000)
    keyed = pushes.withWatermark("ts", expiry).withColumn("id", F.concat(F.coalesce("node", F.lit("")), "address"))
    # salting is not needed: an agent pushes at most a few times a minute
    return keyed.groupBy("id").transformWithStateInPandas(
        LastPush(millis), "id string, last_push bigint, push_duration bigint, last_error string, expired boolean", "update", "eventTime")
