"""Continuous step series, rolling merges and live flame charts.

A sample is late once it is older than the watermark, and is then dropped; the
batch queries over the stored table still count it.
"""

from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stackloom.functions.scalar import scaled_value
from stackloom.operators.select import label
from stackloom.plans.flamechart import OpenPath, timed_paths
from stackloom.streaming.state import use_state_variables


def event_time(time_nanos: str = "time_nanos") -> Column:
    return F.timestamp_micros(F.call_function("div", F.col(time_nanos), F.lit(1000).cast("long")))


def step_series(samples: DataFrame, step: str, sum_by: list[str] = (), lateness: str = "10 minutes") -> DataFrame:
    """Totals and counts per (tumbling step, labels)."""
    timed = samples.withColumn("ts", event_time()).withWatermark("ts", lateness)
    labels = [F.nullif(label(n), F.lit("")).alias(n) for n in sum_by]
    rows = timed.select("ts", scaled_value().alias("v"), "duration", "time_nanos", *labels)
    return rows.groupBy(F.window("ts", step), *sum_by).agg(
        F.sum("v").alias("value"), F.count("*").alias("count"), F.min("duration").alias("duration"),
        (F.min("time_nanos") != F.max("time_nanos")).alias("several_times"))


def rolling_merge(samples: DataFrame, window: str, lateness: str = "10 minutes") -> DataFrame:
    """Merged stacks per window. The state key is the stack itself, so state is one row per distinct stack and window."""
    timed = samples.withColumn("ts", event_time()).withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", window), "stacktrace", "period").agg(F.sum(scaled_value()).alias("value"))


CHART_ROWS = "series string, time_nanos bigint, value bigint, names array<string>, keys array<bigint>, starts array<bigint>"
WAITING = "array<struct<time_nanos:bigint,value:bigint,period:bigint,keys:array<bigint>,names:array<string>>>"


class LiveChart(StatefulProcessor):
    """Folds the samples of a series in time order, each once the watermark has passed it.

    State: the open path, and the samples that wait, by the millisecond they end in. A sample sets a timer for that, so
    a batch reads and writes only the milliseconds it has samples for and those whose time has come.
    """

    def __init__(self, idle_millis: int):
        self.idle = idle_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.path = handle.getValueState("path", "last bigint, keys array<bigint>, starts array<bigint>, ends array<bigint>")
        self.waiting = handle.getMapState("waiting", "millis bigint", f"samples {WAITING}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new: dict[int, list] = {}
        for r in rows:
            new.setdefault(-(-r.time_nanos // 1_000_000), []).append((r.time_nanos, r.value, r.period, list(r["keys"]), list(r.names)))
        for millis, samples in new.items():
            known = self.waiting.getValue((millis,)) if self.waiting.containsKey((millis,)) else None
            self.waiting.updateValue((millis,), ((list(known[0]) if known else []) + samples,))
            self.handle.registerTimer(millis)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        known = self.path.get() if self.path.exists() else None
        if self.waiting.containsKey((now,)):
            due = sorted(self.waiting.getValue((now,))[0], key=lambda r: r[0])
            self.waiting.removeKey((now,))
            path = OpenPath(zip(*known[1:]) if known else ())
            for t, value, period, keys, names in due:
                yield Row(series=key[0], time_nanos=t, value=value, names=list(names), keys=list(keys),
                          starts=path.add(list(keys), t, value, period))
            self.path.update((now, *([x[i] for x in path.levels] for i in range(3))))
            if known is None:
                self.handle.registerTimer(now + self.idle)
        elif known and now < known[0] + self.idle:  # there were samples since this was set
            self.handle.registerTimer(known[0] + self.idle)
        elif known:
            self.path.clear()

    def close(self) -> None:
        pass


def live_flamechart(samples: DataFrame, group_by=(), lateness: str = "10 minutes", idle: str = "10 minutes") -> DataFrame:
    """Node starts per sample: rows (series, time_nanos, value, names, keys, starts).

    State per series is one open path, and the samples the watermark has not passed yet: an earlier one may still
    come. Once it has, they are folded in time order, so what arrives late but in time takes its place. The open path
    is forgotten when ``idle`` has gone by without samples. Node totals are a plain aggregation over these rows
    (:func:`stackloom.plans.flamechart.chart_nodes`).
    """
    use_state_variables(samples.sparkSession)
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)
    paths = timed_paths(samples, group_by)
    timed = paths.withColumn("ts", event_time()).withWatermark("ts", lateness)
    # without labels root functions are independent of each other, so they share the load of a hot series
    root = F.when(F.col("series") == "", F.get("keys", F.lit(0))).otherwise(0)
    return timed.withColumn("root", root).groupBy("series", "root").transformWithState(
        LiveChart(millis), CHART_ROWS, "append", "eventTime")
