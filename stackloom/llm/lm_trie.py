"""Language-model scores from a trigram trie in memory-mapped, Elias-Fano coded files.

Counting: words are hashed to 64 bits; the vocabulary is a range-partitioned aggregation, and a word's id is its rank
among the sorted hashes. Every task counts the trigrams of its texts by sorting, and sends each shard one compressed
block of distinct trigrams and counts. A shard is a range of (first word, second word), sized by the counts of first words,
so a frequent first word is split over as many shards as it needs.

Trie: level 1 is the vocabulary. Level 2 holds, for each first word of a shard, the ids of the words after it; level 3,
for each pair, the words after it, not by id but by their rank among the words that follow the pair's second word
(context-relative). Pointers from a level to the next are monotone and Elias-Fano coded; log probabilities and backoff
weights are quantised to 12 bits. Probabilities are interpolated absolute discounting down to add-0.1 unigrams.

Scoring: map-only. Tasks map the files and look up each distinct pair of their texts in sorted order, then the trigrams
below the pairs found. The files are shared; what a task holds does not grow with the model. A store that can't be
mapped is read to the executor's disk once.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm.array_file import map_arrays, write_arrays
from stackloom.llm.common import SLICE_BYTES, free_name, open_read, open_write, table, text_slices, work_folder
from stackloom.llm.elias_fano import EliasFano
from stackloom.llm.packing import bit_width, gather, pack_open
from stackloom.llm.words import LOWER, split_words

#: Training tokens of a shard, about; a task that builds a shard holds some 40 bytes for each.
TOKENS_PER_SHARD = 2_000_000
#: Bits of a quantised logarithm.
BITS = 12
# ids of the start and end of a text in the vocabulary's hash space; words have other hashes
START_HASH, END_HASH = -(2**63), 2**63 - 1
ADDED = 0.1  # to every count of a word


def _word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, their index for each word, first word of each text)"""
    w = split_words(column, LOWER)
    h = np.clip(w.hashes().view(np.int64), START_HASH + 1, END_HASH - 1)
    return h, w.codes.astype(np.int64), w.offsets


@dataclass
class Quantised:
    """Logarithms in BITS bits between the least and the greatest."""

    data: np.ndarray
    low: float
    step: float

    @classmethod
    def build(cls, x: np.ndarray) -> Quantised:
        low, high = (float(x.min()), float(x.max())) if len(x) else (0.0, 0.0)
        step = (high - low) / ((1 << BITS) - 1) or 1.0
        return cls(pack_open(np.rint((x - low) / step).astype(np.int64), BITS), low, step)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {name: self.data, f"{name}_range": np.array([self.low, self.step])}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> Quantised:
        return cls(arrays[name], *arrays[f"{name}_range"].tolist())

    def get(self, at: np.ndarray) -> np.ndarray:
        return self.low + self.step * gather(self.data, BITS, at)


@dataclass
class Plan:
    """What a task needs to find the files; its size is that of a list of files."""

    folder: str = ""
    vocabulary: list[tuple[str, int, int, int]] = field(default_factory=list)  # path, least hash, id of the first word, tokens before
    words: int = 0  # with the start of a text
    tokens: int = 0
    types: int = 0
    bounds: list[int] = field(default_factory=list)  # least pair of each shard but the first
    shards: list[bool] = field(default_factory=list)  # whether each shard has pairs, and so files
    split: dict[int, tuple[int, int]] = field(default_factory=dict)  # first words of several shards: (successors, how often one follows)
    successors_before: list[int] = field(default_factory=list)  # of each shard's first word, in the shards before
    discounts: tuple[float, float] = (0.75, 0.75)


class Trie:
    """Mapped files of a plan; opened when first used."""

    def __init__(self, plan: Plan):
        self.plan = plan
        self.bounds = np.array(plan.bounds, np.int64)
        self.least = np.array([v[1] for v in plan.vocabulary], np.int64)
        self.first_id = np.array([v[2] for v in plan.vocabulary], np.int64)
        self.denominator = plan.tokens + ADDED * (plan.types + 1)

    @functools.cache
    def vocabulary(self, i: int) -> dict[str, np.ndarray]:
        return map_arrays(self.plan.vocabulary[i][0])

    @functools.cache
    def pairs(self, s: int) -> dict | None:
        if not self.plan.shards[s]:
            return None
        a = map_arrays(f"{self.plan.folder}/pairs-{s:06d}")
        return a | {"pointers": EliasFano.of(a, "pointers")}

    @functools.cache
    def level(self, s: int) -> dict:
        a = map_arrays(f"{self.plan.folder}/level-{s:06d}")
        return {"pointers": EliasFano.of(a, "pointers"), "rank": a["rank"], "rank_width": int(a["rank_width"][0])} | {
            n: Quantised.of(a, n) for n in ("pair_log", "pair_backoff", "first_backoff", "triple_log")}

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of words by id."""
        out = np.zeros(len(ids), np.int64)
        file = np.searchsorted(self.first_id, ids, "right") - 1
        for i in np.unique(file):
            rows = file == i
            out[rows] = self.vocabulary(int(i))["count"][ids[rows] - self.first_id[i]]
        return out

    def successors(self, s: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of first words by their place in a shard: the distinct words that follow, and how often one does; in all shards."""
        p = self.pairs(s)
        n, total = p["pointers"].get(first + 1) - p["pointers"].get(first), p["first_count"][first].astype(np.int64)
        for place in {0, len(p["first"]) - 1}:  # only these may go on in other shards
            whole = self.plan.split.get(int(p["first"][place]))
            if whole:
                n[first == place], total[first == place] = whole
        return n, total

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count in the training texts) of distinct hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        if not len(self.least):
            return ids, counts
        order = np.argsort(hashes)
        sorted_ = hashes[order]
        cut = np.searchsorted(sorted_, self.least[1:], "left")
        for i, (a, b) in enumerate(zip([0, *cut.tolist()], [*cut.tolist(), len(hashes)])):
            if a == b:
                continue
            v = self.vocabulary(i)
            at = np.minimum(np.searchsorted(v["hash"], sorted_[a:b]), len(v["hash"]) - 1)
            hit = v["hash"][at] == sorted_[a:b]
            ids[order[a:b][hit]] = at[hit] + self.plan.vocabulary[i][2]
            counts[order[a:b][hit]] = v["count"][at[hit]]
        return ids, counts

    def shards(self, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(shard, from, to) of the runs of sorted pair keys."""
        cut = np.searchsorted(keys, self.bounds, "left")
        for s, (a, b) in enumerate(zip([0, *cut.tolist()], [*cut.tolist(), len(keys)])):
            if a < b:
                yield s, a, b

    @staticmethod
    def _search(values, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Successor search in step: the first place from ``low`` on, before ``high``, whose value is not below the wanted one."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            below = values(middle) < wanted[open_]
            low[open_[below]] = middle[below] + 1
            high[open_[~below]] = middle[~below]
            open_ = open_[low[open_] < high[open_]]
        return low

    def find_pairs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For sorted pair keys: shard, place of the first word in it or -1, place of the pair or -1, and the pair's rank
        among the words that follow its first word (that of the next one if the pair is not there)."""
        n, words = len(keys), self.plan.words
        shard, first, place, rank = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64)
        for s, a, b in self.shards(keys):
            p = self.pairs(s)
            shard[a:b] = s
            if p is None:
                continue
            x, y = keys[a:b] // words, keys[a:b] % words
            own, back = np.unique(x, return_inverse=True)  # sorted already, so this is cheap
            at = np.minimum(np.searchsorted(p["first"], own), len(p["first"]) - 1)
            known = p["first"][at] == own
            low = np.where(known, p["pointers"].get(at), 0)
            high = np.where(known, p["pointers"].get(at + 1), 0)
            first[a:b] = np.where(known, at, -1)[back]
            l, h = low[back], high[back]
            second = p["second"]
            found = self._search(lambda i: second[i], l, h, y)
            hit = (found < h) & (second[np.minimum(found, len(second) - 1)] == y)
            place[a:b] = np.where(hit, found, -1)
            before = np.where(at == 0, self.plan.successors_before[s], 0)[back]
            rank[a:b] = found - l + before
        return shard, first, place, rank

    def score(self, column: pa.Array) -> dict[str, np.ndarray]:
        """Of each text: tokens, known tokens, base score and score."""
        plan, words = self.plan, self.plan.words
        hashes, codes, offsets = _word_hashes(column)
        texts = len(offsets) - 1
        ids, counts = self.ids(np.append(hashes, [START_HASH, END_HASH]))
        # start, words, end of every text
        size = np.diff(offsets) + 2
        ends = np.cumsum(size)
        code = np.full(int(ends[-1]) if texts else 0, len(hashes), np.int64)
        code[ends - 1] = len(hashes) + 1
        inner = np.ones(len(code), bool)
        inner[ends - 1], inner[ends - size] = False, False
        code[inner] = codes
        predicted = np.ones(len(code), bool)
        predicted[ends - size] = False
        token = np.flatnonzero(predicted)
        owner = np.repeat(np.arange(texts), size - 1)
        count = counts[code[token]]
        single = np.log10((counts + ADDED) / self.denominator)
        base = single[code[token]]
        log = base.copy()
        if any(plan.shards) and len(token):
            # distinct pairs, in the order of the trie: codes by the rank of their ids
            order = np.argsort(ids, kind="stable")
            rank_of = np.empty(len(ids), np.int64)
            rank_of[order] = np.arange(len(ids))
            pair, back = np.unique(rank_of[code[token - 1]] * len(ids) + rank_of[code[token]], return_inverse=True)
            left, right = ids[order[pair // len(ids)]], ids[order[pair % len(ids)]]
            known = (left >= 0) & (right >= 0)
            p_log = single[order[pair % len(ids)]].copy()
            shard, place, rank = (np.full(len(pair), -1, np.int64) for _ in range(3))
            backoff, low, high = np.zeros(len(pair)), np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
            # a word that isn't known may still follow a known one: its pair has a key that no pair has
            asked = np.flatnonzero(left >= 0)
            keys = left[asked] * words + np.where(known[asked], right[asked], 0)
            by_key = np.argsort(keys, kind="stable")
            asked, keys = asked[by_key], keys[by_key]
            s, f, at, r = self.find_pairs(keys)
            at[~known[asked]] = -1
            for k, a, b in self.shards(keys):
                i, seen, there = asked[a:b], at[a:b] >= 0, f[a:b] >= 0
                shard[i], place[i], rank[i] = k, at[a:b], r[a:b]
                for x in np.flatnonzero(~there):  # first words of several shards that have no pair in this one
                    word = int(keys[a + x] // words)
                    if word in plan.split:
                        n, total = plan.split[word]
                        p_log[i[x]] += np.log10(plan.discounts[0] * n / total)
                if not plan.shards[k]:
                    continue
                level = self.level(k)
                p_log[i[~seen & there]] += level["first_backoff"].get(f[a:b][~seen & there])
                p_log[i[seen]] = level["pair_log"].get(at[a:b][seen])
                backoff[i[seen]] = level["pair_backoff"].get(at[a:b][seen])
                low[i[seen]], high[i[seen]] = level["pointers"].get(at[a:b][seen]), level["pointers"].get(at[a:b][seen] + 1)
            log = p_log[back]
            # trigrams: tokens whose text has two tokens before them, the pair before being in the trie
            third = np.flatnonzero(token - 2 >= (ends - size)[owner])
            before = back[third - 1]
            third, before = third[place[before] >= 0], before[place[before] >= 0]
            now = back[third]
            weight = backoff[before]
            log[third] += weight
            possible = (place[now] >= 0) & (low[before] < high[before])
            third, before, now, weight = third[possible], before[possible], now[possible], weight[possible]
            order = np.argsort(shard[before], kind="stable")
            third, before, now = third[order], before[order], now[order]
            cut = np.searchsorted(shard[before], np.arange(len(plan.shards) + 1))
            for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
                if a == b:
                    continue
                level, i, j = self.level(k), before[a:b], now[a:b]
                data, width = level["rank"], level["rank_width"]
                found = self._search(lambda x: gather(data, width, x), low[i], high[i], rank[j])
                inside = found < high[i]
                hit = inside.copy()
                hit[inside] = gather(data, width, found[inside]) == rank[j][inside]
                log[third[a:b][hit]] = level["triple_log"].get(found[hit])
        return {"n_tokens": size - 1, "n_known": np.bincount(owner, count > 0, texts).astype(np.int64),
                "base_score": np.bincount(owner, base, texts), "score": np.bincount(owner, log, texts)}


def _vocabulary(texts: DataFrame, folder: str) -> tuple[list[tuple[str, int, int, int]], int, int]:
    """Write level 1; (files, words, tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text", 2 * SLICE_BYTES):
            h, codes, offsets = _word_hashes(b.column("text"))
            n = np.bincount(codes, minlength=len(h))
            yield pa.RecordBatch.from_pydict({"hash": np.append(h, [START_HASH, END_HASH]), "count": np.append(n, [0, len(offsets) - 1])})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]  # a range of the vocabulary
        if got:
            h, n = (np.concatenate(x) for x in zip(*got))
            path = f"{folder}/words-{TaskContext.get().partitionId():06d}"
            write_arrays(path, {"hash": h, "count": n})
            yield pa.RecordBatch.from_pydict({"path": [path], "least": [int(h[0])], "n": [len(h)], "tokens": [int(n.sum())]})

    rows = texts.select("text").mapInArrow(count, "hash long, count long").groupBy("hash").agg(F.sum("count").alias("count"))
    made = rows.repartitionByRange("hash").sortWithinPartitions("hash").mapInArrow(
        write, "path string, least long, n long, tokens long").collect()  # a row for each file
    files, words, tokens = [], 0, 0
    for r in sorted(made, key=lambda r: r["least"]):
        files.append((r["path"], r["least"], words, tokens))
        words, tokens = words + r["n"], tokens + r["tokens"]
    return files, words, tokens


def _bounds(spark: SparkSession, plan: Plan, per_shard: int) -> list[int]:
    """Pair keys that part the shards, by the counts of first words; a word of more than half a shard is split by its second words."""
    words = plan.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first, before in zip(*(c.to_pylist() for c in b.columns)):
                n = map_arrays(path)["count"].astype(np.int64)
                end = before + np.cumsum(n)
                marks = np.arange(before // per_shard + 1, int(end[-1]) // per_shard + 1) * per_shard
                at = np.minimum(np.searchsorted(end, marks, "left"), len(n) - 1)
                share = (marks - (end[at] - n[at])) / np.maximum(n[at], 1)
                second = np.where(n[at] > per_shard // 2, (share * words).astype(np.int64), 0)
                yield pa.RecordBatch.from_pydict({"bound": (at + first) * words + np.minimum(second, words - 1)})

    files = spark.createDataFrame([(p, i, n) for p, _, i, n in plan.vocabulary], "path string, first long, before long")
    rows = files.repartitionByRange(len(plan.vocabulary), "first").mapInArrow(run, "bound long")
    return sorted({r[0] for r in rows.collect()} - {0})  # one for TOKENS_PER_SHARD tokens


def _block(pair: np.ndarray, third: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted trigrams, compressed: differences of pairs, ids and counts, each byte by byte."""
    columns = [np.diff(pair, prepend=0).astype(np.uint64), third.astype(np.uint64), n.astype(np.uint64)]
    planes = np.stack(columns).view(np.uint8).reshape(3, -1, 8).transpose(0, 2, 1)
    used = planes.any(axis=2)  # planes of zeros are left out
    body = np.packbits(used.ravel()).tobytes() + planes[used].tobytes()
    return len(pair).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def _unblock(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = int.from_bytes(data[:8], "little")
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8)
    used = np.unpackbits(body[:3])[:24].astype(bool).reshape(3, 8)
    planes = np.zeros((3, 8, rows), np.uint8)
    planes[used] = body[3:].reshape(-1, rows)
    columns = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint64)[:, :, 0].astype(np.int64)
    return np.cumsum(columns[0]), columns[1], columns[2]


def _count(texts: DataFrame, plan: Plan) -> DataFrame:
    """(shard, block): distinct trigrams of each task's texts, those after the end of a text with the id ``words``."""
    words, bounds = plan.words, np.array(plan.bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(plan)
        for b in text_slices(batches, "text"):
            hashes, codes, offsets = _word_hashes(b.column("text"))
            ids, _ = trie.ids(np.append(hashes, [START_HASH, END_HASH]))
            order = np.argsort(ids)
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            m, size = len(ids), np.diff(offsets) + 2
            ends = np.cumsum(size)
            code = np.full(int(ends[-1]), rank[m - 2], np.int64)
            code[ends - 1] = rank[m - 1]
            inner = np.ones(len(code), bool)
            inner[ends - 1], inner[ends - size] = False, False
            code[inner] = rank[codes]
            after = np.append(code[1:], m)
            after[ends - 1] = m
            at = np.ones(len(code), bool)
            at[ends - size] = False
            at = np.flatnonzero(at)
            if m < 2_000_000:
                key, n = np.unique((code[at - 1] * m + code[at]) * (m + 1) + after[at], return_counts=True)
                x, y, z = key // (m + 1) // m, key // (m + 1) % m, key % (m + 1)
            else:
                key, n = np.unique(np.stack([code[at - 1], code[at], after[at]], 1), axis=0, return_counts=True)
                x, y, z = key.T
            pair = ids[order[x]] * words + ids[order[y]]
            third = np.append(ids[order], words)[z]
            cut = [0, *np.searchsorted(pair, bounds, "left").tolist(), len(pair)]
            made = [(s, _block(pair[a:z_], third[a:z_], n[a:z_])) for s, (a, z_) in enumerate(zip(cut[:-1], cut[1:])) if a < z_]
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s for s, _ in made], pa.int32()), "block": pa.array([x for _, x in made], pa.binary())})

    return texts.select("text").mapInArrow(run, "shard int, block binary")


def _build_pairs(folder: str, words: int, shard: int, blocks: list[bytes]) -> dict:
    """Merge the blocks of a shard; write level 2 with counts, and the trigrams for the next step."""
    pair, third, n = (np.concatenate(x) for x in zip(*map(_unblock, blocks)))
    pairs = np.unique(pair)
    key = np.searchsorted(pairs, pair) * (words + 1) + third
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n = np.add.reduceat(n[order], new)
    owner, third = key[new] // (words + 1), key[new] % (words + 1)
    starts = np.searchsorted(owner, np.arange(len(pairs)))
    total = np.add.reduceat(n, starts)
    inside = third < words
    children = np.add.reduceat(inside.astype(np.int64), starts)
    followed = np.add.reduceat(np.where(inside, n, 0), starts)
    first, begin = np.unique(pairs // words, return_index=True)
    id_kind = np.uint32 if words < 2**32 else np.uint64
    first_count = np.add.reduceat(total, begin)
    large = np.flatnonzero(total >= 255)
    write_arrays(f"{folder}/pairs-{shard:06d}", {
        "first": first, "first_count": first_count, "second": (pairs % words).astype(id_kind), "count": np.minimum(total, 255).astype(np.uint8),
        "large_at": large, "large": total[large]} | EliasFano.build(np.append(begin, len(pairs))).arrays("pointers"))
    triple, m = third[inside], n[inside]
    with open_write(f"{folder}/triples-{shard:06d}") as out:
        out.write(_block(np.cumsum(np.append(0, children)), np.append(0, followed), np.append(0, children)))
        size = out.tell()
        out.write(_block(np.repeat(np.arange(len(pairs)), children), triple, m))
        out.write(size.to_bytes(8, "little"))
    successors = np.diff(np.append(begin, len(pairs)))
    return {"shard": shard, "ones": int((total == 1).sum()), "twos": int((total == 2).sum()), "ones3": int((m == 1).sum()), "twos3": int((m == 2).sum()),
            "first": int(first[0]), "first_n": int(successors[0]), "first_count": int(first_count[0]), "last": int(first[-1]),
            "last_n": int(successors[-1]), "last_count": int(first_count[-1])}


_MANIFEST = ("shard", "ones", "twos", "ones3", "twos3", "first", "first_n", "first_count", "last", "last_n", "last_count")


def _pair_counts(p: dict, at: np.ndarray) -> np.ndarray:
    out = p["count"][at].astype(np.int64)
    large = out == 255
    out[large] = p["large"][np.searchsorted(p["large_at"], at[large])]
    return out


def _finish(trie: Trie, s: int) -> None:
    """Probabilities of a shard's pairs and trigrams, and level 3."""
    plan, words = trie.plan, trie.plan.words
    p = trie.pairs(s)
    with open_read(f"{plan.folder}/triples-{s:06d}") as f:
        raw = f.read()
    size = int.from_bytes(raw[-8:], "little")
    ends, followed, _ = _unblock(raw[:size])
    owner, third, n = _unblock(raw[size:-8])
    followed, children = followed[1:], np.diff(ends)
    d2, d3 = plan.discounts

    def of_pairs(shard: int, first: np.ndarray, place: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Probability of pairs of a shard."""
        q = trie.pairs(shard)
        successors, total = trie.successors(shard, first)
        single = (trie.counts(second) + ADDED) / trie.denominator
        return (np.maximum(_pair_counts(q, place) - d2, 0) + d2 * successors * single) / total

    begin = p["pointers"].get(np.arange(len(p["first"]) + 1))
    successors, total = trie.successors(s, np.arange(len(p["first"])))
    own = np.repeat(np.arange(len(p["first"])), np.diff(begin))
    pair_p = of_pairs(s, own, np.arange(len(p["second"])), p["second"].astype(np.int64))
    # pairs (second, third) of the trigrams: their probabilities and ranks, looked up in order, each once
    keys, back = np.unique(p["second"][owner].astype(np.int64) * words + third, return_inverse=True)
    shard, first, place, rank = trie.find_pairs(keys)
    lower = np.zeros(len(keys))
    for k, a, b in trie.shards(keys):
        lower[a:b] = of_pairs(k, first[a:b], place[a:b], keys[a:b] % words)
    weight = d3 * children / np.maximum(followed, 1)
    triple_p = np.maximum(n - d3, 0) / followed[owner] + weight[owner] * lower[back]
    ranks = rank[back]
    width = bit_width(int(ranks.max()) + 1) if len(ranks) else 1
    arrays = EliasFano.build(ends).arrays("pointers") | {"rank": pack_open(ranks, width), "rank_width": np.array([width])}
    for name, x in (("pair_log", pair_p), ("pair_backoff", np.where(children > 0, weight, 1.0)), ("first_backoff", d2 * successors / total),
                    ("triple_log", triple_p)):
        arrays |= Quantised.build(np.log10(x)).arrays(name)
    write_arrays(f"{plan.folder}/level-{s:06d}", arrays)


@functools.lru_cache(maxsize=2)
def _opened(folder: str, plan_bytes: bytes) -> Trie:
    return Trie(pickle.loads(plan_bytes))


def train(texts: DataFrame, folder: str, per_shard: int = TOKENS_PER_SHARD) -> Plan:
    """Write the trie of ``texts`` (text; other columns are not used) to ``folder`` and return its plan.

    Null and empty texts count as texts of no words. Without rows the plan is empty. Repeated rows count each time.
    """
    spark = texts.sparkSession
    vocabulary, words, tokens = _vocabulary(texts, folder)
    plan = Plan(folder, vocabulary, words, tokens, max(words - 1, 0))
    if not tokens:
        return Plan(folder)
    plan.bounds = _bounds(spark, plan, per_shard)
    shards = len(plan.bounds) + 1

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, now, blocks = [], None, []
        for b in batches:
            for s, block in zip(b.column("shard").to_pylist(), b.column("block").to_pylist()):
                if s != now and blocks:
                    made.append(_build_pairs(folder, words, now, blocks))
                    blocks = []
                now = s
                blocks.append(block)
        if blocks:
            made.append(_build_pairs(folder, words, now, blocks))
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=pa.schema([(c, pa.int64()) for c in _MANIFEST]))

    rows = (_count(texts, plan).repartition(shards, "shard").sortWithinPartitions("shard")
            .mapInArrow(build, ", ".join(f"{c} long" for c in _MANIFEST)).collect())  # a row for each shard
    by_shard = {r["shard"]: r for r in rows}
    plan.shards = [s in by_shard for s in range(shards)]
    plan.successors_before = [0] * shards
    seen: dict[int, list[int]] = {}
    for s in sorted(by_shard):
        r = by_shard[s]
        for end in ("first", "last"):
            if end == "last" and r["last"] == r["first"]:
                continue
            entry = seen.setdefault(r[end], [0, 0, 0])
            if end == "first":
                plan.successors_before[s] = entry[1]
            entry[0] += 1
            entry[1] += r[f"{end}_n"]
            entry[2] += r[f"{end}_count"]
    plan.split = {w: (n, c) for w, (k, n, c) in seen.items() if k > 1}
    plan.discounts = tuple(min(0.95, max(0.1, a / (a + 2 * b))) if a + b else 0.75
                           for a, b in ((sum(r[f"ones{x}"] for r in rows), sum(r[f"twos{x}"] for r in rows)) for x in ("", "3")))
    packed = spark.sparkContext.broadcast(pickle.dumps(plan))  # a list of files

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _opened(folder, packed.value)
        for b in batches:
            for s in b.column(0).to_pylist():
                _finish(trie, s)
            yield b

    full = spark.createDataFrame([(s,) for s in sorted(by_shard)], "shard long").repartitionByRange(len(by_shard), "shard")
    full.mapInArrow(finish, "shard long").agg(F.count("*")).collect()
    return plan


def score(df: DataFrame, plan: Plan, text: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``n_known``, ``base_score`` and ``score`` (underscores where a name is taken).

    Words are runs of other bytes than 9 to 13 and 32, A-Z in lower case, and every text ends in a token of its own; null counts as empty.
    ``score`` is the log10 probability of the text by the trie, ``base_score`` that by single words alone. Every row is kept.
    """
    names = list(df.columns)
    added, taken = {}, list(names)
    for n in ("n_tokens", "n_known", "base_score", "score"):
        added[n] = free_name(taken, n)
        taken.append(added[n])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    kinds = {"n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double"}
    packed = df.sparkSession.sparkContext.broadcast(pickle.dumps(plan))  # a list of files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _opened(plan.folder, packed.value)
        for b in text_slices(batches, text):
            made = trie.score(b.column(names.index(text)))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(made[n]) for n in added)], names=taken)

    return df.mapInArrow(run, fields + ", " + ", ".join(f"`{added[n]}` {kinds[n]}" for n in added))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    plan = train(docs.filter(~held_out), work_folder(spark, "lm"))
    return score(docs, plan).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
                                    F.lit(plan.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


QUERIES = {"op4_lm_score": op4_lm_score}
