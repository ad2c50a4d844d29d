"""Comparing two selections, and other set operations."""

from pyspark.sql import Column, DataFrame, functions as F

from stackloom.functions.scalar import scaled_value
from stackloom.schema import LABELS
from stackloom.session import cut_lineage


def _total(profile: DataFrame) -> Column:
    return profile.agg(F.coalesce(F.sum("value"), F.lit(0)).cast("double")).scalar()


def diff(base: DataFrame, compare: DataFrame, absolute: bool = False) -> DataFrame:
    """Rows of ``compare`` with their value as diff, and rows of ``base`` with value 0 and a negative diff.

    Unless ``absolute``, the smaller side's diffs are scaled to the larger
    total, truncated per row. The totals are two scalar subqueries. A side with
    total zero is not scaled.
    """
    columns = [c for c in ("stacktrace", "labels", "period", "time_nanos") if c in compare.columns]

    def side(df, value, diff_, zero_time):
        time = [F.lit(0).cast("long").alias(c) if zero_time and c in ("period", "time_nanos") else F.col(c)
                for c in columns]
        return df.select(*time, value.cast("long").alias("value"), diff_.cast("long").alias("diff"))

    v = F.col("value")
    if absolute:
        base_diff, compare_diff = -v, v
    else:
        b, c = _total(base), _total(compare)
        to_compare = F.when((c > b) & (b > 0), c / b).otherwise(1.0)
        to_base = F.when((b > c) & (c > 0), b / c).otherwise(1.0)
        base_diff = v.cast("double") * (F.lit(-1.0) * to_compare)
        compare_diff = F.when(to_base > 1.0, (v.cast("double") * to_base).cast("long")).otherwise(v)
    base = base.select(*[c for c in base.columns if c in columns], "value")
    return side(compare, v, compare_diff, False).unionByName(side(base, F.lit(0), base_diff, True))


def compare_samples(samples: DataFrame, base: Column, compare: Column, absolute: bool = False) -> DataFrame:
    """:func:`diff` of two selections of one table, merged by stack and period, from one scan.

    ``base`` and ``compare`` are conditions on the samples; a sample may be on both sides. Samples are merged with
    their side in the key, and the totals that scale the sides are those of the merged rows.
    """
    sides = F.array_compact(F.array(F.when(base, F.lit("base")), F.when(compare, F.lit("compare"))))
    tagged = samples.where(base | compare).select("stacktrace", "period", scaled_value().alias("value"), F.explode(sides).alias("side"))
    # rows and totals read it
    merged = cut_lineage(tagged.groupBy("stacktrace", "period", "side").agg(F.sum("value").alias("value")))
    one = lambda name: merged.where(F.col("side") == name).select("stacktrace", "period", "value", F.create_map().cast(LABELS).alias("labels"))
    return diff(one("base"), one("compare"), absolute)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sorted distinct union of two one-column lists."""
    return a.union(b).distinct().orderBy(a.columns[0])


def intersect_labels(rows: DataFrame, node: list[str], name: str, value: str) -> DataFrame:
    """Label value of a node where every merged row carries the same one, else null.

    ``rows`` has one row per (merged row, label name).
    """
    per_value = rows.groupBy(*node, name, value).agg(F.count("*").alias("_n"))
    same = (F.min(value) == F.max(value)) & (F.sum(F.when(F.col(value).isNotNull(), F.col("_n"))) == F.sum("_n"))
    return per_value.groupBy(*node, name).agg(F.when(same, F.min(value)).alias(value))
