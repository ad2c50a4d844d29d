"""Merging samples by stack: the first, and by far the most reducing, step of every report."""

from pyspark.sql import Column, DataFrame, functions as F

from stackloom.functions.scalar import scaled_value
from stackloom.operators.select import at_instant, in_range, label


def _label_columns(names: list[str]) -> list[Column]:
    return [F.nullif(label(n), F.lit("")).alias(f"l_{i}") for i, n in enumerate(names)]


def _label_map(names: list[str]) -> Column:
    if not names:
        return F.create_map().cast("map<string,string>")
    pairs = [x for i, n in enumerate(names) for x in (F.lit(n), F.col(f"l_{i}"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def rows(samples: DataFrame, start: int | None = None, end: int | None = None, group_by=()) -> DataFrame:
    """Samples in the shape of :func:`merge`, but not summed up.

    Reports merge on the few frame fields they show, which gives narrower keys
    and fewer of them than whole stacks, so they take these rows directly.
    """
    samples = in_range(samples, start, end)
    names = [g.removeprefix("labels.") for g in group_by if g.startswith("labels.")]
    by_time = ["time_nanos"] if "timestamp" in group_by else []
    labelled = samples.select("stacktrace", "period", *by_time, scaled_value().alias("value"),
                              F.lit(0).cast("long").alias("diff"), *_label_columns(names))
    return labelled.select("stacktrace", "period", *by_time, "value", "diff", _label_map(names).alias("labels"))


def merge_items(profile: DataFrame, items: Column) -> DataFrame:
    """Sum value and diff by an array derived from the stack, before that array is exploded."""
    diff = F.col("diff") if "diff" in profile.columns else F.lit(0).cast("long")
    return profile.select(items.alias("items"), "value", diff.alias("diff")).groupBy("items").agg(
        F.sum("value").alias("value"), F.sum("diff").alias("diff"))


def merge(samples: DataFrame, start: int | None = None, end: int | None = None, group_by=(),
          delta: bool = False) -> DataFrame:
    """Sum values by stack, period and the wanted labels over an inclusive time range.

    ``group_by`` holds ``labels.<name>`` and ``timestamp``; other fields act on
    frames and are ignored here. The group key is the stack array itself:
    Spark hashes its bytes, so the aggregation is exact and needs no witness.
    """
    samples = in_range(samples, start, end)
    names = [g.removeprefix("labels.") for g in group_by if g.startswith("labels.")]
    by_time = ["time_nanos"] if "timestamp" in group_by else []
    rows = samples.select("stacktrace", "period", *by_time, *_label_columns(names), scaled_value().alias("value"))
    keys = ["stacktrace", "period"] + by_time + [f"l_{i}" for i in range(len(names))]
    out = rows.groupBy(*keys).agg(F.sum("value").alias("value"))
    columns = ["stacktrace", "period", *by_time, "value", F.lit(0).cast("long").alias("diff"),
               _label_map(names).alias("labels")]
    if delta and start is not None and end is not None:
        columns.append((F.col("value").cast("double") / F.lit(float(end - start))).alias("value_per_second"))
    return out.select(*columns)


def single(samples: DataFrame, time_nanos: int, delta: bool = False, group_by=()) -> DataFrame:
    """Sum values by stack, period and the wanted labels at one instant; for deltas also the rate over their summed duration.

    The columns are those of :func:`merge`, so either can be a side of a comparison.
    """
    names = [g.removeprefix("labels.") for g in group_by if g.startswith("labels.")]
    by_time = ["time_nanos"] if "timestamp" in group_by else []
    rows = at_instant(samples, time_nanos).select("stacktrace", "period", *by_time, "value", "duration", *_label_columns(names))
    out = rows.groupBy("stacktrace", "period", *by_time, *[f"l_{i}" for i in range(len(names))]).agg(
        F.sum("value").alias("value"), F.sum("duration").alias("duration"))
    rate = F.col("value").cast("double") / F.nullif(F.col("duration"), F.lit(0).cast("long")).cast("double")
    return out.select("stacktrace", "period", *by_time, "value", F.lit(0).cast("long").alias("diff"),
                      _label_map(names).alias("labels"), "duration", *([rate.alias("value_per_second")] if delta else []))


def totals(profile: DataFrame) -> DataFrame:
    return profile.agg(F.sum("value").alias("value"), F.sum("diff").alias("diff"))


def profile_types(samples: DataFrame) -> DataFrame:
    """Distinct profile types; a positive duration marks deltas."""
    return samples.select("name", "sample_type", "sample_unit", "period_type", "period_unit",
                          (F.col("duration") > 0).alias("delta")).distinct()


def has_profile_data(samples: DataFrame) -> DataFrame:
    """One row, true if any sample exists; reads no more than one."""
    return samples.limit(1).agg((F.count("*") > 0).alias("has_data"))
