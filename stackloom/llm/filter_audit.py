"""Filter interaction audit: what each filter removes, by its place in every order of the filters.

A document's failures are a set of filters. What an order has removed after some steps depends only on the set of filters
applied so far, so all orders share one lattice: its states are the sets, an edge applies one more filter. Path counts say
how many orders reach a state (forward) and how many ways lead on to the end (backward); an edge lies on their product of
orders. The documents an edge removes, weighted with that product and summed over the edges of a filter, are its Shapley
value times the number of orders; the steps of one order are the edges of its path.

On Spark, documents become (part, failure set, counts): at most 2^k rows a part, whatever the number of documents. Only
ids, digests and flags are shuffled, never texts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm.common import table, work_folder

#: Orders are listed one by one (k! of them); beyond, their number is no longer a report.
MOST_FILTERS = 7
#: Parts whose rows a task makes at a time.
PARTS = 64


class Lattice:
    """The subsets of k filters with their path counts, and the edges of every order."""

    def __init__(self, names: str):
        if len(set(names)) != len(names) or not 1 <= len(names) <= MOST_FILTERS:
            raise ValueError(f"1 to {MOST_FILTERS} different letters, not {names!r}")
        self.names, self.k = names, len(names)
        self.full = (1 << self.k) - 1
        self.edges = [(s, f) for s in range(self.full + 1) for f in range(self.k) if not s >> f & 1]
        self.forward = [1] + [0] * self.full
        for s, f in self.edges:  # ascending: all that leads to s is counted before s leads on
            self.forward[s | 1 << f] += self.forward[s]
        self.backward = [0] * self.full + [1]
        for s, f in reversed(self.edges):
            self.backward[s] += self.backward[s | 1 << f]
        self.orders = ["".join(x) for x in itertools.permutations(names)]
        self.filters = np.array([[names.index(c) for c in x] for x in self.orders])
        bits = 1 << self.filters
        self.after = np.cumsum(bits, axis=1)
        self.before = self.after - bits

    def kept(self, counts: np.ndarray) -> np.ndarray:
        """[part, state]: documents that fail none of the state's filters, from [part, failure set]."""
        out = counts.copy()
        for f in range(self.k):  # sums over subsets
            has = np.flatnonzero(np.arange(self.full + 1) >> f & 1)
            out[:, has] += out[:, has ^ 1 << f]
        return out[:, self.full - np.arange(self.full + 1)]

    def shapley(self, kept: np.ndarray) -> np.ndarray:
        """[part, filter]: documents removed by each filter, summed over all orders."""
        out = np.zeros((len(kept), self.k), np.int64)
        for s, f in self.edges:
            out[:, f] += self.forward[s] * self.backward[s | 1 << f] * (kept[:, s] - kept[:, s | 1 << f])
        return out


def audit(sets: DataFrame, names: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): all orders of each part.

    ``sets`` has part (string), mask (int, bit i: fails the i-th letter of ``names``), n, good, toxic (long), in any number of
    rows; other columns are not used. A null part counts as empty, null counts and masks as 0. A part without documents has
    no rows; counts of 0 are rows like others. No rows, no result.
    """
    names = str(names)
    size = len(Lattice(names).forward)
    measures = ("n", "good", "toxic")
    none = F.lit(0).cast("bigint")
    small = (sets.select(F.coalesce("part", F.lit("")).alias("part"), F.coalesce("mask", F.lit(0)).cast("int").alias("mask"),
                         *[F.coalesce(F.col(m).cast("bigint"), none).alias(m) for m in measures])
             .groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in measures])
             .groupBy("part").agg(F.collect_list(F.struct("mask", *measures)).alias("cells")))  # 2^k at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(names)
        for batch in batches:
            for start in range(0, batch.num_rows, PARTS):
                yield _rows(lattice, size, batch.slice(start, PARTS))

    return small.mapInArrow(run, "part string, filter_order string, step int, kept long, removed long, redundant long, "
                                 "unique_fails long, good_lost long, toxic_lost long, shapley long")


def _rows(lattice: Lattice, size: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    parts, cells = (c.to_pylist() for c in batch.columns)
    counts = np.zeros((3, len(parts), size), np.int64)
    for p, listed in enumerate(cells):
        for x in listed:
            counts[:, p, x["mask"]] += (x["n"], x["good"], x["toxic"])
    kept, good, toxic = (lattice.kept(c) for c in counts)
    before, after, which = (x.ravel() for x in (lattice.before, lattice.after, lattice.filters))
    removed = kept[:, before] - kept[:, after]
    alone = 1 << np.arange(lattice.k)
    failing = kept[:, :1] - kept[:, alone]
    columns = [kept[:, after], removed, failing[:, which] - removed, counts[0][:, alone][:, which],
               good[:, before] - good[:, after], toxic[:, before] - toxic[:, after], lattice.shapley(kept)[:, which]]
    steps = len(lattice.orders) * lattice.k
    return pa.RecordBatch.from_arrays(
        [pa.array(parts, pa.string()).take(pa.array(np.repeat(np.arange(len(parts)), steps))),
         pa.array(lattice.orders).take(pa.array(np.tile(np.repeat(np.arange(len(lattice.orders)), lattice.k), len(parts)))),
         pa.array(np.tile(np.arange(1, lattice.k + 1, dtype=np.int32), len(parts) * len(lattice.orders))),
         *[pa.array(c.ravel()) for c in columns]],
        names=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])


def failure_sets(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], copies: str | None = None,
                 folder: str | None = None) -> DataFrame:
    """(part, mask, n, good, toxic) of ``docs`` (doc_id, text, lang), for ``audit``.

    ``filters``: letter to failure condition over ``text``, which is never null here (null: empty); a condition that is null
    is no failure. ``copies``: letter of one more filter, failed by a document whose text a smaller doc_id has, too; rows
    of the least id fail it never, and neither do those without an id, which are no smaller than any. ``labels``:
    doc_id, quality, toxic; an id that is labelled several times is good (toxic) if any label says so. Rows without a label, and
    those without an id, are neither. Repeated rows count as often as they occur; other columns are not used.

    A table of one narrow row per document is written to ``folder`` and read again, so texts are read once.
    """
    spark = docs.sparkSession
    text = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    letters = [*filters, *([copies] if copies else [])]
    mask = sum((F.when(condition, 1 << i).otherwise(0) for i, condition in enumerate(filters.values())), F.lit(0))
    path = f"{folder or work_folder(spark, 'filter-audit')}/documents"
    # equal rows meet before the shuffle: copies without an id, too, are one row
    (text.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
     .groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")).write.parquet(path))
    rows = spark.read.parquet(path)
    if copies:
        # joined by digest and id, so that the rows of one text are spread
        least = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL").withColumn("least", F.lit(1))
        rows = (rows.join(least, ["digest", "doc_id"], "left")
                .withColumn("mask", F.when(F.col("doc_id").isNotNull() & F.col("least").isNull(),
                                           F.col("mask") + (1 << letters.index(copies))).otherwise(F.col("mask"))))
    flag = {m: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("bigint").alias(m) for m, c in (("good", "quality"), ("toxic", "toxic"))}
    marked = labels.filter("doc_id IS NOT NULL").select("doc_id", "quality", "toxic").groupBy("doc_id").agg(*flag.values())
    rows = rows.select("doc_id", "part", "mask", "n")
    known = rows.filter("doc_id IS NOT NULL").join(marked, "doc_id", "left").select("part", "mask", "n", "good", "toxic")
    none = F.lit(None).cast("bigint")
    other = rows.filter("doc_id IS NULL").select("part", "mask", "n", none.alias("good"), none.alias("toxic"))
    zero = F.lit(0).cast("bigint")
    return (known.union(other).groupBy("part", "mask")
            .agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(m, zero)).alias(m) for m in flag]))


def production_filters() -> dict[str, Column]:
    """Few words, few distinct words, many capitals, signs; the fifth filter (E) is that for copies."""
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), "")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    return {"A": F.size(words) < 200,
            "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            "C": 100 * capitals > 3 * F.length("text"),
            "D": F.col("text").rlike(r"[#$%&*|]")}


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all 120 orders, for each language."""
    sets = failure_sets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), production_filters(), copies="E")
    return audit(sets, "ABCDE")


QUERIES = {"op12_filter_audit": op12_filter_audit}

SQL = {"op12_filter_audit": r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
least AS (SELECT text, min(doc_id) AS lo FROM docs GROUP BY text),
words AS (SELECT d.doc_id, d.part, d.text, d.doc_id > lo AS copy, regexp_extract_all(d.text, '[^\x20\x09-\x0D]+') AS w
          FROM docs d JOIN least USING (text)),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
          FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
sets AS (SELECT part, (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
           + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END)
           + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN copy THEN 16 ELSE 0 END) AS mask,
           coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
         FROM words LEFT JOIN marks USING (doc_id)),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(l, bit)),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
           FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
             AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS before
          FROM orders, range(1, 6) s(step)),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM sets GROUP BY part, mask),
listed AS (SELECT part, filter_order, step, bit,
             sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
             sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
           FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM listed"""}
