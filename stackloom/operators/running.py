"""Running sums and dense numbering that never put one large group into one task."""

from pyspark.sql import DataFrame, Window as W, functions as F

from stackloom.session import cut_lineage

ID_BUCKETS = 512


def running_sum(df: DataFrame, group: str, order: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the same ``group`` that come strictly before.

    Rows are range-partitioned by (group, order), summed within each range, and shifted by the totals of the ranges before
    it, which are as many rows per group as it has ranges. So a group of any size is spread like all other rows.
    """
    # the ranges are read three times, so their borders must not be sampled anew
    ranged = cut_lineage(df.repartitionByRange(group, order).withColumn("_range", F.spark_partition_id()))
    local = W.partitionBy("_range", group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("_range", group).agg(F.sum(value).alias("_total"))
    shifts = totals.select("_range", group, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_shift"))
    return (
        ranged.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0)))
        .join(shifts, ["_range", group])
        .withColumn(out, (F.col("_local") + F.col("_shift")).cast("long"))
        .drop("_range", "_local", "_shift")
    )


def dense_ids(df: DataFrame, key: list[str], out: str, start: int = 1, buckets: int = ID_BUCKETS) -> DataFrame:
    """Number the distinct rows of ``df`` consecutively from ``start``.

    Rows are numbered within hash buckets of ``key`` and shifted by the sizes of
    the buckets before, so the only global step sorts ``buckets`` rows.
    """
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    sizes = bucketed.groupBy("_bucket").agg(F.count("*").alias("_size"))
    # at most ``buckets`` rows reach this window
    shifts = sizes.select(
        "_bucket",
        F.coalesce(F.sum("_size").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_shift"),
    )
    within = W.partitionBy("_bucket").orderBy(*key)
    return (
        bucketed.withColumn("_rank", F.row_number().over(within))
        .join(shifts, "_bucket")
        .withColumn(out, (F.col("_rank") + F.col("_shift") + F.lit(start - 1)).cast("long"))
        .drop("_bucket", "_rank", "_shift")
    )
