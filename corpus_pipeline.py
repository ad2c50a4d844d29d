"""A training-data pipeline: toxic documents go, one of each group of near duplicates stays, documents that hold benchmark
passages go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads again as the next
stage's docs, so a lost executor costs a part of one stage. Null texts count as empty; repeated rows are near
duplicates of each other, so one of them stays; an empty table goes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm import decontaminate, near_dedup, sentencepiece_scan, toxicity
from stackloom.llm.common import free_name, table, work_folder
from stackloom.packaging import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold, by a model of the labelled ones among ``docs``; the columns of ``docs``."""
    ship(spark)
    model = toxicity.train(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    predicted = free_name([*docs.columns, "score"], "predicted")
    return toxicity.score(docs, model, predicted=predicted).filter(F.col(predicted) == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates; the columns of ``docs``."""
    ship(spark)
    return near_dedup.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; the columns of ``docs``."""
    ship(spark)
    matches = free_name(docs.columns, "matches")
    marked = decontaminate.mark(docs, table(spark, sf_dir, "benchmark"), matches=matches)
    return marked.filter(F.size(matches) == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_pieces, round_trip): the pieces of every text, and whether they decode to it again."""
    ship(spark)
    made = sentencepiece_scan.decode(sentencepiece_scan.encode(docs.select("doc_id", "lang", "source", "text")))
    return made.select("doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_pieces"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_duplicates),
          ("benchmark_decontamination", drop_contaminated), ("sentencepiece", encode)]

#: The stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), work_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
