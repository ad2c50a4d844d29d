"""Continuous ingest into the samples table: one query, good rows and rejects, each batch once."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stackloom.schema import SAMPLES
from stackloom.sources.labels import bad_profile_type
from stackloom.sources.otlp import SCHEMA as OTLP_SCHEMA, ingest_otlp, validate_otlp
from stackloom.sources.pprof import decode_files, ingest_pprof, rejected_files, samples_of_files
from stackloom.sources.samples import write_samples

#: Rows of the table of rejects: where they come from, why, and the sample where it is one.
REJECTS = f"source string, reason string, sample {SAMPLES.simpleString()}"

def stream_samples(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of samples as a stream."""
    return spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_files(spark: SparkSession, path: str, labels: dict[str, str], files_per_trigger: int = 1000) -> DataFrame:
    """New pprof files as a stream (path, content, labels); ``labels`` are the series labels, ``__name__`` included."""
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", files_per_trigger).load(path)
    )
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return files.select("path", "content", F.create_map(*pairs).alias("labels"))


def stream_pprof(spark: SparkSession, path: str, labels: dict[str, str], files_per_trigger: int = 1000) -> DataFrame:
    """The samples of new pprof files that break no rule."""
    return ingest_pprof(stream_files(spark, path, labels, files_per_trigger))


def stream_otlp(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of export requests as a stream."""
    return spark.readStream.schema(OTLP_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _rejects(rows: DataFrame, source: str, reason: str) -> DataFrame:
    return rows.select(F.col(source).alias("source"), F.col(reason).alias("reason"), F.lit(None).cast(SAMPLES).alias("sample"))


@dataclass(frozen=True)
class Input:
    """What a batch is made into before both writes read it, and the samples and rejects of that."""

    read: Callable[[DataFrame], DataFrame] = lambda batch: batch
    samples: Callable[[DataFrame], DataFrame] = lambda batch: batch
    rejects: Callable[[DataFrame], DataFrame] | None = None


SAMPLE_ROWS = Input()
#: Files are decoded once; a reject for each rule that one breaks.
PROFILE_FILES = Input(decode_files, samples_of_files, lambda files: _rejects(rejected_files(files), "path", "error"))
EXPORT_REQUESTS = Input(samples=ingest_otlp, rejects=lambda requests: _rejects(validate_otlp(requests), "request_id", "error"))


def ingest(stream: DataFrame, table_path: str, checkpoint: str, rejected_path: str | None = None, kind: Input = SAMPLE_ROWS,
           promote: list[str] = (), once: bool = True) -> StreamingQuery:
    """Append a stream to the samples table; what can't be stored goes to the table of rejects.

    ``kind`` says what the stream has: ``SAMPLE_ROWS``, ``PROFILE_FILES`` (:func:`stream_files`) or ``EXPORT_REQUESTS``
    (:func:`stream_otlp`). Samples whose profile type could not be selected again are rejects, too. The default of
    ``rejected_path`` is the table's path with ``_rejected`` appended. ``promote`` as in
    :func:`stackloom.sources.samples.write_samples`.

    Both tables have a folder per batch (and day), which a repeated batch replaces, so a batch cut off between or within its
    two writes leaves no row twice and loses none. The handle is that of the only query; with ``once`` it ends when all that is there now
    has been read.
    """
    rejected_path = rejected_path or f"{table_path.rstrip('/')}_rejected"

    def store(batch: DataFrame, batch_id: int) -> None:
        read = kind.read(batch).persist()
        try:
            samples = kind.samples(read)
            reason = bad_profile_type()
            write_samples(samples.where(reason.isNull()), table_path, promote=promote, batch=batch_id)
            rejects = samples.withColumn("reason", reason).where("reason IS NOT NULL").select(
                F.lit(None).cast("string").alias("source"), "reason", F.struct(*SAMPLES.names).alias("sample"))
            if kind.rejects:
                rejects = kind.rejects(read).unionByName(rejects)
            rejects.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(rejected_path)
        finally:
            read.unpersist()

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
