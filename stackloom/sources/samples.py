"""Reading and writing the samples table."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stackloom.functions.scalar import col, int_div
from stackloom.schema import SAMPLES, SORT_COLUMNS

DAY_NANOS = 86_400_000_000_000


def day_of(time_nanos) -> Column:
    """Whole days since the epoch; the partition column of the samples table."""
    t = col(time_nanos)
    return int_div(t - F.pmod(t, F.lit(DAY_NANOS)), DAY_NANOS).cast("int")


def read_samples(spark: SparkSession, path: str, start: int | None = None, end: int | None = None,
                 promoted: list[str] = ()) -> DataFrame:
    """Scan a samples table.

    ``start``/``end`` (inclusive, ns) add the partition predicate on ``day`` so
    that only the wanted days are listed, besides the exact time predicate that
    reaches the Parquet row groups. ``promoted`` names the labels that
    :func:`write_samples` stored as plain columns.
    """
    fields = list(SAMPLES.fields)
    fields += [T.StructField(f"label_{k}", T.StringType()) for k in promoted]
    fields += [T.StructField("day", T.IntegerType())]
    df = spark.read.schema(T.StructType(fields)).parquet(path).select(*[f.name for f in fields])
    if start is not None:
        df = df.where((F.col("day") >= start // DAY_NANOS) & (F.col("time_nanos") >= start))
    if end is not None:
        df = df.where((F.col("day") <= end // DAY_NANOS) & (F.col("time_nanos") <= end))
    return df


def write_samples(samples: DataFrame, path: str, mode: str = "append", promote: list[str] = (),
                  partitions: int | None = None, batch: int | None = None) -> None:
    """Write samples partitioned by day and sorted by the storage key.

    Range partitioning on (day, key, time) spreads one hot day or one hot
    producer over many tasks and keeps row groups narrow in every sort column.
    ``promote`` copies hot labels to plain columns with Bloom filters, because
    predicates on map values are not pushed into Parquet. With ``batch`` the days have a folder per
    batch, which writing the same batch again replaces.
    """
    for key in promote:
        samples = samples.withColumn(f"label_{key}", F.try_element_at("labels", F.lit(key)))
    keyed = samples.withColumn("day", day_of("time_nanos"))
    order = ["day"] + SORT_COLUMNS
    ranged = keyed.repartitionByRange(partitions, *order) if partitions else keyed.repartitionByRange(*order)
    rows = ranged.sortWithinPartitions(*order)
    if batch is None:
        writer = rows.write.mode(mode).partitionBy("day")
    else:
        writer = rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("day", "batch")
    for key in promote:
        writer = writer.option(f"parquet.bloom.filter.enabled#label_{key}", "true")
    writer.parquet(path)
