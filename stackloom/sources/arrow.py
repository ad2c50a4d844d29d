"""Samples that arrive as Arrow tables, in both published layouts."""

from pyspark.sql import DataFrame, functions as F

from stackloom.functions.scalar import int_div
from stackloom.operators.lookup import lookup
from stackloom.schema import LABELS, SAMPLES


def ingest_arrow_v1(samples: DataFrame, locations: DataFrame) -> DataFrame:
    """Samples with ``labels.<name>`` columns and stacks kept apart, matched on ``stacktrace_id``.

    Every id must have a stack; see :func:`missing_stacktraces`. Popular stacks
    are spread over tasks by the salted join.
    """
    prefix = "labels."
    names = [c for c in samples.columns if c.startswith(prefix)]
    pairs = [x for c in names for x in (F.lit(c.removeprefix(prefix)), F.col(f"`{c}`").cast("string"))]
    labels = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map()
    rows = samples.select(
        F.col("producer").alias("name"), "sample_type", "sample_unit", "period_type", "period_unit", "period",
        "duration", int_div("timestamp", 1_000_000).alias("timestamp"), F.col("timestamp").alias("time_nanos"),
        "value", labels.cast(LABELS).alias("labels"), "stacktrace_id")
    stacks = locations.select("stacktrace_id", F.col("locations").alias("stacktrace")).dropDuplicates(["stacktrace_id"])
    return lookup(rows, stacks, ["stacktrace_id"], ["time_nanos", "value"], "inner").to(SAMPLES)


def missing_stacktraces(samples: DataFrame, locations: DataFrame) -> DataFrame:
    """Stack ids without a stack: what a writer has to be asked for again."""
    return samples.select("stacktrace_id").distinct().join(locations, "stacktrace_id", "left_anti").select("stacktrace_id")


def incomplete_stacktraces(locations: DataFrame) -> DataFrame:
    return locations.where(~F.col("is_complete")).agg(F.count("*").alias("incomplete"))


def ingest_arrow_v2(samples: DataFrame) -> DataFrame:
    """Samples with a label struct, inlined stacks and native timestamps (``temporality`` is not used)."""
    names = samples.schema["labels"].dataType.fieldNames()
    pairs = [x for n in names for x in (F.lit(n), F.col("labels").getField(n).cast("string"))]
    labels = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map()
    nanos = F.unix_micros("timestamp") * 1000
    return samples.select(
        F.col("producer").alias("name"), "sample_type", "sample_unit", "period_type", "period_unit", "period",
        "duration", int_div(nanos, 1_000_000).alias("timestamp"), nanos.alias("time_nanos"), "value",
        labels.cast(LABELS).alias("labels"), "stacktrace").to(SAMPLES)
