"""Step-bucketed time series."""

from pyspark.sql import DataFrame, functions as F

from stackloom.functions.scalar import (
    effective_duration, int_div, labels_text, per_second, result_type, result_unit, scaled_value, step_bucket,
)
from stackloom.operators.select import label

SECOND = 1_000_000_000


def query_range(samples: DataFrame, step: int, sum_by: list[str] = (), clamp: bool = False) -> DataFrame:
    """Delta series: one row per (step, label set), with total, count, duration and rate.

    The distinct-times test of a bucket is ``min <> max``, so one partial
    aggregation does all and nothing per sample is shuffled.
    """
    if step <= 0:
        raise ValueError("step must be positive")
    step = max(step, SECOND) if clamp else step
    names = list(sum_by)
    labels = [F.nullif(label(n), F.lit("")).alias(n) for n in names]
    rows = samples.select(step_bucket("time_nanos", step).alias("bucket"), *labels, "time_nanos", "duration",
                          scaled_value().alias("v"), result_type().alias("rt"), result_unit().alias("ru"))
    is_time = (F.col("rt") == "cpu") & (F.col("ru") == "nanoseconds")
    out = rows.groupBy("bucket", *names, is_time.alias("is_time")).agg(
        F.sum("v").alias("value"), F.count("*").alias("count"), F.min("duration").alias("shortest"),
        F.min("time_nanos").alias("first"), F.max("time_nanos").alias("last"),
    )
    out = out.withColumn("duration", effective_duration("first", "last", "shortest", step))
    return out.select("bucket", *names, "value", per_second("value", "duration", F.col("is_time")).alias("value_per_second"),
                      "duration", "count").orderBy(*names, "bucket")


def query_range_gauge(samples: DataFrame, step: int) -> DataFrame:
    """Gauge series: per (label set, step) the earliest total, and how many were collapsed into it."""
    totals = samples.groupBy(labels_text("labels").alias("labels"), "time_nanos").agg(F.sum("value").alias("value"))
    bucket = int_div("time_nanos", step) if step > 0 else F.col("time_nanos")
    # times are unique per label set here, so both aggregates speak of the same row, in buffers of fixed width
    return (
        totals.groupBy("labels", bucket.alias("step"))
        .agg(F.min("time_nanos").alias("time_nanos"), F.min_by("value", "time_nanos").alias("value"), F.count("*").alias("count"))
        .select("labels", "time_nanos", "value", F.col("value").cast("double").alias("value_per_second"), "count")
        .orderBy("labels", "time_nanos")
    )


def series_arrays(series: DataFrame, sum_by: list[str]) -> DataFrame:
    """One row per label set with its buckets in time order; bounded by the number of steps."""
    point = F.struct("bucket", "value", "duration")
    return series.groupBy(*sum_by).agg(F.sort_array(F.collect_list(point)).alias("points"))


def limit_series(series: DataFrame, sum_by: list[str], n: int) -> DataFrame:
    """Only the ``n`` label sets with the largest totals (ties: label order)."""
    keep = (
        series.groupBy(*sum_by).agg(F.sum("value").alias("_total"))
        .orderBy(F.desc("_total"), *sum_by).limit(n).drop("_total")
    )
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"k.{k}")) for k in sum_by]
    return series.alias("s").join(keep.alias("k"), same, "left_semi")
