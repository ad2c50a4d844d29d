"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary text.

The models spell words: they give the bytes of a word, with a mark at its start and end, by up to ORDER - 1 bytes before,
so that a word never met is judged by the stems it shares with known ones. Each class has interpolated Kneser-Ney estimates
(discounted counts at the highest order, continuation counts below); the lowest order is shared by both classes and smooths what
either has rarely seen. Training counts the spellings of a bounded sample of labelled documents as a Spark aggregation.

Scoring is map-only: each distinct word gets the difference of its two log-likelihoods; the differences are averaged over the
document and over windows of fixed length; a logistic curve, fitted on a part of the sample that the counts leave
out, turns the averages into a score. The model keeps every n-gram of the sample, rare ones above all, as smoothing
them is what it is for; its levels are one file in the shared folder, which the tasks map into memory.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm.array_file import map_arrays, write_arrays
from stackloom.llm.common import cut_lineage, free_name, table, text_slices, work_folder
from stackloom.llm.words import LOWER_WORDS, Words, raw_text, split_words

#: Labelled documents to learn from, about: a share of all of them by the hash of their id.
MAX_DOCS = 16_000
#: Bytes of the longest n-gram, up to 7.
ORDER = 6
DISCOUNT = 0.8
#: Words of the windows.
WINDOWS = (1, 4, 16)
THRESHOLD = 0.7
#: Words whose difference a worker keeps; a full store is emptied, which costs time only.
CACHE_WORDS = 400_000
# marks of a word's start and end: bytes that ``LOWER_WORDS`` leaves in no word
START, END = 1, 2


def spell(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes to predict (each word's, then END), the word of each, and the place within the word (from 0)."""
    at, data = raw_text(words)
    size = np.diff(at) + 1
    stop = np.cumsum(size)
    out = np.full(int(stop[-1]) if len(size) else 0, END, np.uint64)
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(out)) - np.repeat(stop - size, size)
    out[place < (size - 1)[word]] = np.frombuffer(data, np.uint8)
    return out, word, place


def ngrams(symbols: np.ndarray, place: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``order`` bytes that end at each place as an integer, and where there are that many, START counted.

    The context of an n-gram is the integer shifted right by 8, its suffix the integer without its first byte.
    """
    key = symbols.copy()
    padded = np.concatenate([np.zeros(8, np.uint64), symbols])
    for back in range(1, order):
        earlier = np.where(place >= back, padded[8 - back : len(padded) - back], np.where(place == back - 1, np.uint64(START), np.uint64(0)))
        key |= earlier << np.uint64(8 * back)
    return key, place + 1 >= order - 1


@dataclass
class Level:
    keys: np.ndarray  # n-grams, sorted
    held: tuple[np.ndarray, np.ndarray]  # of each class, by key: discounted part
    contexts: np.ndarray  # sorted
    backoff: tuple[np.ndarray, np.ndarray]  # of each class, by context: weight of the next lower order


@functools.lru_cache(maxsize=4)
def _mapped(file: str) -> list[Level]:
    arrays = map_arrays(file)
    pair = lambda name: (arrays[f"{name}0"], arrays[f"{name}1"])
    return [Level(arrays[f"keys{i}"], pair(f"held{i}_"), arrays[f"contexts{i}"], pair(f"backoff{i}_")) for i in range(ORDER - 1)]


def _write(file: str, levels: list[Level]) -> None:
    arrays = {}
    for i, x in enumerate(levels):
        arrays |= {f"keys{i}": x.keys, f"contexts{i}": x.contexts, **{f"held{i}_{c}": x.held[c] for c in (0, 1)},
                   **{f"backoff{i}_{c}": x.backoff[c] for c in (0, 1)}}
    write_arrays(file, arrays)


@dataclass
class Model:
    """Index 0 of the classes is ordinary, 1 toxic."""

    shared: np.ndarray  # 256: probability of a byte, the same for both classes
    file: str | None  # of the levels, from order 2 on; a model without has none
    weights: np.ndarray  # logistic: constant, document average, largest average of each window

    def __post_init__(self) -> None:
        self._clear()

    @property
    def levels(self) -> list[Level]:
        return _mapped(self.file) if self.file else []

    def _clear(self) -> None:
        self._known, self._values = pa.array([], pa.string()), np.empty(0)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._clear()

    def of_words(self, words: pa.Array) -> np.ndarray:
        """Log-likelihood of each word in toxic less that in ordinary text."""
        symbols, word, place = spell(words)
        p = np.stack([self.shared[symbols]] * 2)
        for order, level in enumerate(self.levels, 2):
            if not len(level.keys):
                break
            key, whole = ngrams(symbols, place, order)
            at = np.minimum(np.searchsorted(level.keys, key), len(level.keys) - 1)
            context = key >> np.uint64(8)
            where = np.minimum(np.searchsorted(level.contexts, context), len(level.contexts) - 1)
            seen, known = whole & (level.keys[at] == key), whole & (level.contexts[where] == context)
            for c in (0, 1):
                p[c] = np.where(known, level.backoff[c][where], 1.0) * p[c] + np.where(seen, level.held[c][at], 0.0)
        return np.bincount(word, np.log(p[1]) - np.log(p[0]), len(words))

    def differences(self, w: Words) -> np.ndarray:
        """Of each word of the texts; distinct words are judged once."""
        found = pc.index_in(w.dictionary, self._known)
        if found.null_count:
            if len(self._known) + found.null_count > CACHE_WORDS:
                self._clear()
                found = pa.nulls(len(w.dictionary), pa.int32())
            missing = pc.is_null(found)
            new = w.dictionary.filter(missing)
            at = found.fill_null(0).to_numpy(zero_copy_only=False).copy()
            at[missing.to_numpy(zero_copy_only=False)] = len(self._known) + np.arange(len(new))
            self._known = pa.concat_arrays([self._known, new])
            self._values = np.concatenate([self._values, self.of_words(new)])
        else:
            at = found.to_numpy(zero_copy_only=False)
        return self._values[at[w.codes]]

    def averages(self, texts: pa.Array) -> np.ndarray:
        """Average over the document, and the largest over a window of each length; 0 for a text without words."""
        w = split_words(texts, LOWER_WORDS)
        total = np.concatenate([[0.0], np.cumsum(self.differences(w))])
        a, z = w.offsets[:-1], w.offsets[1:]
        out = np.zeros((len(a), 1 + len(WINDOWS)))
        full = z > a
        out[full, 0] = (total[z] - total[a])[full] / (z - a)[full]
        if full.any():
            start, ends = np.repeat(a, z - a), np.arange(1, len(total))
            for i, window in enumerate(WINDOWS, 1):
                # of the ``window`` words up to each one, within its text; a shorter run counts as if filled up by zeros
                sums = (total[ends] - total[np.maximum(start, ends - window)]) / window
                out[full, i] = np.maximum.reduceat(sums, a[full])
        return out

    def scores(self, averages: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + averages @ self.weights[1:], -60, 60)))


def sample_of(labelled: DataFrame, max_docs: int) -> DataFrame:
    """About ``max_docs`` rows by the hash of doc_id: all of them where there are no more."""
    n = labelled.count()
    if n <= max_docs:
        return labelled
    limit = -(2**63) + int(2**64 * max_docs / n)
    return labelled.filter(F.xxhash64("doc_id", F.lit("toxicity sample")) < limit)


def train(labelled: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Learn from ``labelled`` (doc_id, text, toxic), of which rows with a null label don't count.

    With no rows, or rows of one class only, the model knows nothing and scores everything as 0.5, 0.05 or 0.95. A
    doc_id that occurs several times is several documents, all in the sample or none. Texts count whole, however long.
    """
    sample = cut_lineage(sample_of(labelled.filter(F.col("toxic").isNotNull()), max_docs)
                         .select(F.coalesce("text", F.lit("")).alias("text"), (F.col("toxic") > 0).cast("int").alias("toxic"),
                                 (F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4)) == 0).alias("fit")))
    have = {(r["fit"], r["toxic"]): r["n"] for r in sample.groupBy("fit", "toxic").agg(F.count("*").alias("n")).collect()}
    classes = {c for _, c in have}
    if len(classes) < 2:
        share = 0.5 if not classes else (0.95 if 1 in classes else 0.05)
        return Model(np.full(256, 1 / 256), None, np.array([math.log(share / (1 - share))] + [0.0] * (1 + len(WINDOWS))))
    apart = len(have) == 4  # else the sample is too small to be parted
    shared, levels = _estimate(_count(sample.filter("NOT fit") if apart else sample))
    file = f"{work_folder(labelled.sparkSession, 'toxicity')}/levels"
    _write(file, levels)
    model = Model(shared, file, np.zeros(2 + len(WINDOWS)))
    model.weights = _fit(sample.filter("fit") if apart else sample, model)
    return model


def _count(sample: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each order: all n-grams and their counts in both classes. They are those of the sample's distinct words."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            w = split_words(b.column("text"), LOWER_WORDS)
            toxic = b.column("toxic").to_numpy(zero_copy_only=False)[w.rows]
            n = np.stack([np.bincount(w.codes[toxic == c], minlength=len(w.dictionary)) for c in (0, 1)])
            symbols, word, place = spell(w.dictionary)
            for order in range(1, ORDER + 1):
                key, whole = ngrams(symbols, place, order)
                distinct, at = np.unique(key[whole], return_inverse=True)
                made = [np.bincount(at, n[c][word[whole]], len(distinct)).astype(np.int64) for c in (0, 1)]
                yield pa.RecordBatch.from_pydict({"ngram_order": np.full(len(distinct), order, np.int32), "ngram": distinct.view(np.int64),
                                                  "c0": made[0], "c1": made[1]})

    rows = sample.select("text", "toxic").mapInArrow(words, "ngram_order int, ngram long, c0 long, c1 long")
    counts = cut_lineage(rows.groupBy("ngram_order", "ngram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))
    out = {}
    for order in range(1, ORDER + 1):
        found = counts.filter(F.col("ngram_order") == order).select("ngram", "c0", "c1").toArrow()
        keys = found.column("ngram").to_numpy().view(np.uint64)
        by = np.argsort(keys)
        out[order] = keys[by], np.stack([found.column(c).to_numpy()[by] for c in ("c0", "c1")]).astype(float)
    return out


def _estimate(counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[Level]]:
    """Interpolated Kneser-Ney: the shared lowest order and the levels above it."""
    counts = dict(counts)
    for order in range(1, ORDER):  # below the highest order, what counts is how many bytes stand before; nothing does before START
        keys, raw = counts[order]
        longer, n = counts[order + 1]
        suffix = longer & np.uint64((1 << 8 * order) - 1)
        at = np.minimum(np.searchsorted(keys, suffix), max(len(keys) - 1, 0))
        hit = keys[at] == suffix if len(keys) else np.zeros(len(suffix), bool)
        before = np.stack([np.bincount(at[hit & (n[c] > 0)], minlength=len(keys)) for c in (0, 1)])
        first = (keys >> np.uint64(8 * (order - 1))) == START
        counts[order] = keys, np.where(first & (order > 1), raw, np.maximum(before, raw > 0)).astype(float)
    keys, n = counts[1]
    shared = np.full(256, 0.5)
    shared[keys.astype(np.int64)] += n.sum(0)
    levels = []
    for order in range(2, ORDER + 1):
        keys, n = counts[order]
        contexts, at = np.unique(keys >> np.uint64(8), return_inverse=True)
        total = np.stack([np.bincount(at, n[c], len(contexts)) for c in (0, 1)])
        held = np.maximum(n - DISCOUNT, 0) / np.maximum(total[:, at], 1)
        left = np.stack([1 - np.bincount(at, held[c], len(contexts)) for c in (0, 1)])
        levels.append(Level(keys, held, contexts, np.where(total > 0, np.maximum(left, 1e-6), 1.0)))
    return shared / shared.sum(), levels


def _fit(sample: DataFrame, model: Model) -> np.ndarray:
    """Weights of the logistic curve from the sample's averages; a few numbers a document reach the driver."""
    names = ["mean", *(f"peak{w}" for w in WINDOWS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            a = model.averages(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *(pa.array(c) for c in a.T)], names=["toxic", *names])

    rows = sample.select("text", "toxic").mapInArrow(run, "toxic int, " + ", ".join(f"{n} double" for n in names)).toArrow()
    y = rows.column("toxic").to_numpy().astype(float)
    x = np.stack([np.ones(len(y)), *(rows.column(n).to_numpy() for n in names)], 1)
    scale = np.concatenate([[1.0], x[:, 1:].std(0) + 1e-9])
    x /= scale
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)  # both classes count the same
    w, ridge = np.zeros(x.shape[1]), np.array([1e-6] + [0.5] * (x.shape[1] - 1))
    for _ in range(60):  # Newton's method; the ridge keeps weights small where the classes part cleanly
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (p - y)) + ridge * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, score: str = "score",
          predicted: str = "predicted") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on); names that are taken get underscores.

    Null counts as empty; a text without words scores as the logistic curve's constant. Every row is kept.
    """
    names = list(df.columns)
    score = free_name(names, score)
    predicted = free_name([*names, score], predicted)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few numbers, and the levels' file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in text_slices(batches, text):
            s = m.scores(m.averages(b.column(names.index(text))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=[*names, score, predicted])

    return df.mapInArrow(run, f"{fields}, `{score}` double, `{predicted}` int")


def fold(doc_id):
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the labelled documents outside the held-out fold.

    Rows without an id have no label; an id that is labelled several times is toxic if any label says so, and each row of a repeated
    id is a document. Texts are taken whole.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
    known = known.filter(fold(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = sample_of(known, MAX_DOCS)  # here already, so that few texts are moved
    return docs.select("doc_id", "text").join(known, "doc_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(training_rows(docs, labels))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")


QUERIES = {"op6_toxicity": op6_toxicity}
