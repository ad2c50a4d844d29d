"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Map-only over the documents. The benchmark is read in blocks of bounded size; where there are several, each is a job of its own over
the numbered documents, and what it finds is joined by number.

A window is as many words as an item has, at any word of a document. To reach the threshold it must hold that share of the item's
shingles, so an inverted list of shingles gives the (window, item) pairs there are to compare (a necessary condition, which
loses nothing): a few windows around each place where an item may lie. Pairs are compared by fingerprint: 64 bits in 8
blocks, of which two within RADIUS bits have one within RADIUS // 8 bits of each other. So the blocks let every pair within
the radius pass, and the whole fingerprint is compared of those alone. (At this radius the blocks by themselves would let 71 % of
unrelated pairs pass, which is why they don't open the search.) What is left is verified by the weighted Jaccard
similarity of word shingles, weights being how often a shingle occurs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm.common import free_name, table, text_slices, work_folder
from stackloom.llm.words import LOWER_WORDS, mix, shingle_hashes, split_words

SHINGLE = 5
THRESHOLD = 0.8
#: Sets of similarity 0.8 differ in 9.7 of 64 bits on average; 23 is 4.6 standard deviations more.
RADIUS = 23
BLOCKS = 8
#: Shingles that are summed up at a time, and pairs compared.
STRETCH, PAIRS = 1 << 14, 1 << 16
#: Bytes of benchmark text that tasks hold at a time.
BENCHMARK_BYTES = 8 << 20


def _signs(shingles: np.ndarray) -> np.ndarray:
    """64 bits of each shingle as +1 and -1."""
    bits = np.unpackbits(mix(shingles ^ np.uint64(0x5BF0_3635_1C6B_A0D1)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the ``size`` shingles from each of the sorted ``starts``: 8 bytes each."""
    out, at = np.empty((len(starts), 8), np.uint8), 0
    while at < len(starts):  # sums over a stretch of bounded length at a time
        first = int(starts[at])
        to = int(np.searchsorted(starts, first + STRETCH, "right"))
        total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_signs(shingles[first : int(starts[to - 1]) + size]), axis=0, dtype=np.int32)])
        own = starts[at:to] - first
        out[at:to] = np.packbits(total[own + size] - total[own] > 0, axis=1)
        at = to
    return out


_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


@dataclass
class Group:
    """Items of the same number of words, and their fingerprints."""

    items: np.ndarray  # places in Index.ids
    size: int  # shingles
    prints: np.ndarray

    def close(self, prints: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Of each fingerprint, whether it lies within RADIUS bits of that of the group's item beside it."""
        out = np.zeros(len(prints), bool)
        for at in range(0, len(prints), PAIRS):
            bits = _POPCOUNT[prints[at : at + PAIRS] ^ self.prints[which[at : at + PAIRS]]]
            near = np.flatnonzero((bits <= RADIUS // BLOCKS).any(1))
            out[at + near] = bits[near].sum(1, dtype=np.int64) <= RADIUS
        return out


def windows(hits: np.ndarray, need: int, size: int, last: int) -> np.ndarray:
    """Starts (0 to ``last``) of all windows of ``size`` that hold ``need`` of the sorted ``hits`` or more."""
    first, final = hits[: len(hits) - need + 1], hits[need - 1 :]
    low, high = np.maximum(final - size + 1, 0), np.minimum(first, last)
    low = np.maximum(low, np.append(-1, np.maximum.accumulate(high)[:-1]) + 1)  # each window once
    length = np.maximum(high - low + 1, 0)
    return np.repeat(low, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)


class Index:
    """Items of a benchmark, or of a block of it."""

    def __init__(self, ids: list, texts: list[str]):
        w = split_words(pa.array(texts, pa.string()), LOWER_WORDS)
        hashes = w.hashes()[w.codes]
        self.ids = ids
        self.words = np.diff(w.offsets)
        flat, starts = shingle_hashes(hashes, w.offsets, SHINGLE)
        self.bags = [Counter(flat[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:])]
        self.weight = np.diff(starts)
        owner = np.repeat(np.arange(len(ids)), self.weight)
        # distinct (shingle, item) pairs, sorted by shingle
        pairs = np.unique(np.stack([flat, owner.astype(np.uint64)], 1), axis=0) if len(flat) else np.empty((0, 2), np.uint64)
        self.shingles, self.at = np.unique(pairs[:, 0], return_index=True)
        self.at = np.append(self.at, len(pairs))
        self.owner = pairs[:, 1].astype(np.int64)
        self.short = sorted({int(n) for n in self.words if 0 < n < SHINGLE})
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.shingles >> np.uint64(44)] = True
        self.groups: dict[int, Group] = {}
        for n in np.unique(self.words[self.words > 0]):
            items = np.flatnonzero(self.words == n)
            size = int(self.weight[items[0]])
            prints = np.concatenate([fingerprints(flat[starts[i] : starts[i + 1]], np.zeros(1, np.int64), size) for i in items])
            self.groups[int(n)] = Group(items, size, prints)

    def matches(self, texts: pa.Array, threshold: float) -> list[list[tuple[int, float, int, int]]]:
        """Of each text: (item, similarity, first word, words) of the best window of each item that reaches the threshold."""
        w = split_words(texts, LOWER_WORDS)
        hashes = w.hashes()[w.codes]
        out: list[list[tuple[int, float, int, int]]] = [[] for _ in range(len(w.offsets) - 1)]
        # items shorter than a shingle have one shingle of all their words, as has any window of theirs
        for length in [SHINGLE, *self.short]:
            flat, starts = shingle_hashes(hashes, w.offsets, length)
            if length < SHINGLE:
                size = np.diff(w.offsets)
                flat = np.where(np.repeat(size >= length, np.diff(starts)), flat, np.uint64(0))
            self._search(flat, starts, length, threshold, out)
        return out

    def _search(self, flat: np.ndarray, starts: np.ndarray, length: int, threshold: float, out: list) -> None:
        place = np.flatnonzero(self.filter[flat >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.shingles, flat[place]), max(len(self.shingles) - 1, 0))
        hit = self.shingles[at] == flat[place] if len(self.shingles) else np.zeros(len(place), bool)
        place, at = place[hit], at[hit]
        if not len(place):
            return
        count = self.at[at + 1] - self.at[at]
        item = self.owner[np.repeat(self.at[at], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        place = np.repeat(place, count)
        text = np.searchsorted(starts, place, "right") - 1
        # a window that reaches the threshold holds that share of the item's shingles, so the text has as many hits
        pair, which, hits = np.unique(text * len(self.ids) + item, return_inverse=True, return_counts=True)
        enough = hits >= threshold * self.weight[pair % len(self.ids)] - 1e-9
        enough &= np.minimum(self.words[pair % len(self.ids)], SHINGLE) == length
        by_size: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        order = np.argsort(which, kind="stable")
        ends = np.cumsum(hits)
        for k in np.flatnonzero(enough):
            doc, i = divmod(int(pair[k]), len(self.ids))
            by_size.setdefault((doc, int(self.words[i])), []).append((i, place[order[ends[k] - hits[k] : ends[k]]]))
        for (doc, n), found in by_size.items():
            group, a, z = self.groups[n], int(starts[doc]), int(starts[doc + 1])
            size = min(group.size, z - a)  # a text shorter than the item is one window
            need = max(1, int(np.ceil(threshold * group.size - 1e-9)))
            first = [windows(np.sort(at) - a, need, size, z - a - size) for _, at in found]
            which = np.repeat(np.searchsorted(group.items, [i for i, _ in found]), [len(x) for x in first])
            first = np.concatenate(first)
            own = flat[a:z]
            distinct, at = np.unique(first, return_inverse=True)
            close = group.close(fingerprints(own, distinct, size)[at], which) if len(distinct) else np.zeros(0, bool)
            best: dict[int, tuple[float, int]] = {}
            for i, s in zip(group.items[which[close]].tolist(), first[close].tolist()):
                bag, window = self.bags[i], Counter(own[s : s + size].tolist())
                shared = sum(min(c, window.get(k, 0)) for k, c in bag.items())
                similarity = shared / (group.size + size - shared)
                if similarity >= threshold - 1e-9 and similarity > best.get(i, (0.0, 0))[0]:
                    best[i] = (similarity, s)
            out[doc] += [(i, v, s, min(n, size + length - 1)) for i, (v, s) in sorted(best.items())]


MATCH = "array<struct<item_id:{kind},similarity:double,start_word:int,n_words:int>>"


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of about ``block_bytes`` of text, which bounds what a task holds."""
    items = benchmark.select("item_id", "text").filter(F.length(F.trim(F.col("text"))) > 0)
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    return [items] if n == 1 else [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _search(docs: DataFrame, block: DataFrame, text: str, threshold: float, matches: str, found_only: bool = False):
    """``docs`` with the matches of one block, and the broadcast that its tasks read."""
    names, kind = list(docs.columns), block.schema["item_id"].dataType.simpleString()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    rows = sorted(((r["item_id"], r["text"]) for r in block.collect()), key=lambda r: (r[0] is not None, r[0], r[1]))  # bounded by block_bytes
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, item = None, None
        for b in text_slices(batches, text):
            if index is None:
                index = Index([i for i, _ in shared.value], [t for _, t in shared.value])
                ids = pa.array(index.ids, _ARROW.get(kind))
                item = pa.struct([("item_id", ids.type), ("similarity", pa.float64()), ("start_word", pa.int32()), ("n_words", pa.int32())])
            found = index.matches(b.column(names.index(text)), threshold)
            made = [[{"item_id": index.ids[i], "similarity": v, "start_word": s, "n_words": n} for i, v, s, n in x] for x in found]
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(item))], names=[*names, matches])
            yield out.filter(pa.array([bool(x) for x in found])) if found_only else out

    return docs.mapInArrow(run, f"{fields}, `{matches}` {MATCH.format(kind=kind)}"), shared


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD, matches: str = "matches",
         block_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """Add ``matches``: the benchmark items (item_id, text) that a document holds, as an array of
    (item_id, similarity, start_word, n_words), empty for a clean document, ordered by item.

    Of an item's windows the most similar one counts, then the first. Words are runs of letters, digits and non-ASCII
    characters in lower case. Null and empty texts hold nothing; null and empty items are held by nothing; items of the
    same text are found each. Every row is kept, repeated ones too; ``matches`` gets underscores where the name is taken.

    The driver and a task hold one block of the benchmark at a time, whatever its size.
    """
    spark, matches = docs.sparkSession, free_name(list(docs.columns), matches)
    blocks = _blocks(benchmark, block_bytes)
    if len(blocks) == 1:
        return _search(docs, blocks[0], text, threshold, matches)[0]
    # numbers hold for as long as the table is there
    folder, row = work_folder(spark, "decontaminate"), free_name([*docs.columns, matches], "row")
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(f"{folder}/documents")
    numbered = spark.read.parquet(f"{folder}/documents")
    for k, block in enumerate(blocks):
        found, shared = _search(numbered.select(row, text), block, text, threshold, matches, found_only=True)
        found.select(row, matches).write.parquet(f"{folder}/found-{k}")
        shared.destroy()
    every = spark.read.parquet(*[f"{folder}/found-{k}" for k in range(len(blocks))])
    per_row = every.groupBy(row).agg(F.array_sort(F.flatten(F.collect_list(matches))).alias(matches))
    none = F.array().cast(per_row.schema[matches].dataType)
    joined = numbered.join(per_row, row, "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(matches, none).alias(matches))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): a row for each benchmark item that a document holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = mark(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("matches").alias("m"))
    return found.select("doc_id", "m.item_id", F.round("m.similarity", 9).alias("similarity"), "m.start_word", "m.n_words")


QUERIES = {"op9_decontaminate": op9_decontaminate}
