"""Quality rules by weak supervision: rules vote or abstain, and a model of their accuracies decides.

Each rule looks at one trait of a text and votes good or bad, or abstains where the trait says nothing. How far a rule can be
trusted isn't set by hand: expectation-maximisation fits, over all documents, the shares of good ones and of each kind of bad
ones, and how often each rule is right about them. The posterior probability of good then replaces the demand that all
rules pass.

On Spark, a task measures whole texts; what is shuffled is one count per distinct combination of votes (3^rules at most,
whatever the number of documents), and the model is fitted to these counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from stackloom.llm.common import free_name, table, text_slices, work_folder
from stackloom.llm.words import Words, mix, raw_text, split_words

WINDOW = 5

#: (rule, bad from, bad to, good from, good to, least words): traits in [bad from, bad to) vote bad, else those in
#: [good from, good to) vote good, others abstain, and so do texts with fewer words.
RULES = [
    ("signs a word", 0.1, np.inf, 0.0, 0.01, 10),
    ("characters a word", 7.5, np.inf, 3.5, 6.5, 10),
    ("repeated windows", 0.2, np.inf, 0.0, 0.1, 10),
    ("repeated lines", 0.3, np.inf, 0.0, 0.1, 10),
    ("capitals among letters", 0.4, np.inf, 0.0, 0.15, 10),
    ("words without a letter", 0.25, np.inf, 0.0, 0.1, 10),
    ("distinct words, logarithms", 0.0, 0.65, 0.8, np.inf, 30),
    ("words that end a sentence", 0.5, np.inf, 0.02, 0.25, 30),
]
ABSTAIN, BAD, GOOD = range(3)

#: Chances that a rule votes good, before any document is seen: on good documents, on those of its own kind of bad ones, and
#: on those of other kinds; each counts as ``PRIOR_WEIGHT`` votes. Shares of good documents and of all bad ones likewise.
PRIOR_ON_GOOD, PRIOR_ON_OWN, PRIOR_ON_OTHER = 0.99, 0.1, 0.8
PRIOR_WEIGHT = 10.0
PRIOR_GOOD = 0.9
ROUNDS = 500
#: Posterior probability of good from which a document is kept.
KEEP = 0.5

MEASURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "votes": "int"}
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def _per_text(hits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``hits`` within the bounds of each text."""
    total = np.concatenate([[0], np.cumsum(hits, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def repeated(words: Words) -> np.ndarray:
    """Of each word, whether a window of five words around it occurs twice or more in its text."""
    n = np.diff(words.offsets)
    count = np.maximum(n - WINDOW + 1, 0)
    out = np.zeros(len(words.codes), bool)
    if not count.sum():
        return out
    starts = np.repeat(words.offsets[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    text = np.repeat(np.arange(len(n), dtype=np.uint64), count)
    codes = words.codes.astype(np.uint64)
    key = mix(text + np.uint64(1))
    for i in range(WINDOW):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + codes[starts + i])
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    a, b = starts[order[:-1][same]], starts[order[1:][same]]
    equal = text[order[:-1][same]] == text[order[1:][same]]
    for i in range(WINDOW):
        equal &= words.codes[a + i] == words.codes[b + i]
    if equal.all():
        twice = np.unique(np.concatenate([a, b]))
    else:  # two windows have one hash: compare all windows word by word
        rows = np.stack([text.astype(np.int64), *(words.codes[starts + i] for i in range(WINDOW))], axis=1)
        _, which, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        twice = starts[times[which.ravel()] > 1]
    for i in range(WINDOW):
        out[twice + i] = True
    return out


def _lines(data: bytes) -> tuple[int, int]:
    """Lines that hold a word, and those among them that equal one before."""
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    return len(lines), len(lines) - len(set(lines))


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """``MEASURES`` of each text (null: no words)."""
    at, data = raw_text(column)
    raw = np.frombuffer(data, np.uint8)
    words = split_words(column)
    rows, n = words.rows, np.diff(words.offsets)
    first = (raw & 0xC0) != 0x80  # bytes that begin a code point
    word_chars = _per_text(first & ~_BLANK[raw], at)
    symbols = _per_text(_SYMBOL[raw], at)
    lines = np.array([_lines(data[i:j]) for i, j in zip(at[:-1], at[1:])], np.int64).reshape(-1, 2)
    again = _per_text(repeated(words), words.offsets)
    upper = _per_text((raw >= 65) & (raw <= 90), at)
    letters = upper + _per_text((raw >= 97) & (raw <= 122), at)
    bare = ~pc.match_substring_regex(words.dictionary, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
    ends = pc.match_substring_regex(words.dictionary, r"[.!?]$").to_numpy(zero_copy_only=False).astype(bool)
    pairs = np.unique(rows.astype(np.int64) * max(len(words.dictionary), 1) + words.codes)
    distinct = np.bincount(pairs // max(len(words.dictionary), 1), minlength=len(n))
    with np.errstate(divide="ignore", invalid="ignore"):
        traits = [symbols / n, word_chars / n, again / n, np.where(lines[:, 0] < 3, np.nan, lines[:, 1] / lines[:, 0]),
                  upper / letters, _per_text(bare[words.codes], words.offsets) / n, np.log(distinct) / np.log(n),
                  _per_text(ends[words.codes], words.offsets) / n]
    return {"n_words": n, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": lines[:, 1], "n_repeat_words": again,
            "votes": votes(traits, n)}


def votes(traits: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """The votes of all rules as one number, a digit of base 3 for each."""
    out = np.zeros(len(n), np.int32)
    for i, (x, (_, bad, to_bad, good, to_good, least)) in enumerate(zip(traits, RULES)):
        vote = np.where((x >= bad) & (x < to_bad), BAD, np.where((x >= good) & (x < to_good), GOOD, ABSTAIN))
        out += (np.where((n >= least) & ~np.isnan(x), vote, ABSTAIN) * 3**i).astype(np.int32)
    return out


def fit(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of good for each pattern, chances [class, rule] of a good vote, shares of classes) by expectation-maximisation.

    Class 0 are good documents, class k those that are bad in the way rule k looks for: texts full of signs fail other rules than
    texts that repeat themselves. A rule is better than chance on good documents and on its own kind, which keeps the
    classes apart; all else is estimated. An abstention says nothing. Starts from the prior; nothing seen, the prior stays.
    """
    k = len(RULES)
    digits = patterns[:, None] // 3 ** np.arange(k) % 3
    for_good, for_bad = (digits == GOOD).astype(float), (digits == BAD).astype(float)
    own = np.vstack([np.zeros((1, k), bool), np.eye(k, dtype=bool)])
    prior = np.where(own, PRIOR_ON_OWN, PRIOR_ON_OTHER)
    prior[0] = PRIOR_ON_GOOD
    least, most = np.where(np.arange(k + 1)[:, None] == 0, 0.5, 0.0), np.where(own, 0.5, 1.0)
    prior_shares = np.array([PRIOR_GOOD, *[(1 - PRIOR_GOOD) / k] * k])
    chances, shares = prior, prior_shares
    post = np.zeros((len(patterns), k + 1))
    for _ in range(ROUNDS):
        last = post
        log = for_good @ np.log(chances).T + for_bad @ np.log1p(-chances).T + np.log(shares)
        post = np.exp(log - log.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        weight = (post * counts[:, None]).T
        good, bad = weight @ for_good + PRIOR_WEIGHT * prior, weight @ for_bad + PRIOR_WEIGHT * (1 - prior)
        chances = np.clip(good / (good + bad), least, most)
        shares = (weight.sum(axis=1) + PRIOR_WEIGHT * prior_shares) / (counts.sum() + PRIOR_WEIGHT)
        if np.abs(post - last).max(initial=0.0) < 1e-9:
            break
    return post[:, 0], chances, shares


def assess(docs: DataFrame, quality: str = "quality", columns: list[str] | None = None) -> DataFrame:
    """The given columns of ``docs`` (all but the text unless named), ``MEASURES`` and the posterior probability of good.

    ``docs`` has text; a null or empty text has no words, so all rules abstain and its probability is that of any
    document of which nothing is known. Repeated rows count as often as they occur; ties can't arise. No rows, no result. Long
    texts are measured whole. New columns get a free name (underscores appended) where ``docs`` has theirs.

    Measures are written to ``spark.checkpoint.dir`` without the texts, so texts are read once.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c != "text"] if columns is None else columns
    names, taken = {}, [*columns, "text"]
    for m in [*MEASURES, quality]:
        names[m] = free_name(taken, m)
        taken.append(names[m])
    # plain names on the way into Python, whatever characters those of docs have
    chosen = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            found = measure(batch.column(len(columns)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(found[m].astype(np.int32 if k == "int" else np.int64)) for m, k in MEASURES.items())],
                names=[*columns, *(names[m] for m in MEASURES)])

    schema = docs.select(*[F.col(f"`{c}`") for c in columns]).schema
    for m, k in MEASURES.items():
        schema = schema.add(names[m], IntegerType() if k == "int" else LongType())
    path = f"{work_folder(spark, 'quality-rules')}/measures"
    chosen.mapInArrow(run, schema).write.parquet(path)
    measured = spark.read.schema(schema).parquet(path)
    votes_of = measured.groupBy(names["votes"]).count().collect()  # 3^8 rows at most
    patterns, counts = (np.array([r[i] for r in votes_of], np.int64) for i in (0, 1))
    order = np.argsort(patterns)
    patterns, counts = patterns[order], counts[order]
    post, _, _ = fit(patterns, counts.astype(float))
    posteriors = dict(zip(patterns.tolist(), post.tolist()))
    model = spark.createDataFrame([(int(p), q) for p, q in posteriors.items()], f"`{names['votes']}` int, `{names[quality]}` double")
    return measured.join(F.broadcast(model), names["votes"]).select(*[F.col(f"`{f.name}`") for f in schema], names[quality])


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, the base rule and the verdict of all documents."""
    found = assess(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.select("doc_id", *[m for m in MEASURES if m != "votes"], failed.alias("base_failed"),
                        (~failed & (F.col("quality") >= KEEP)).alias("kept"), "quality")


QUERIES = {"op11_quality_rules": op11_quality_rules}
