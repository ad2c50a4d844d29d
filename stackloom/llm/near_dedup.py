"""Near-duplicate documents by DartMinHash signatures, banded joining and exact verification.

Darts: the weight of a shingle in a document is how often it occurs. Each unit of weight is a region in which darts land as
a Poisson process along the rank axis, drawn by hashing, so every document that covers a unit sees the same darts there. A
document takes the darts up to the rank at which enough of them are expected, deals them to coordinates by
hash, and keeps the earliest of each coordinate; two documents agree in a coordinate with the probability of their weighted
Jaccard similarity. Work per document is its words plus a fixed number of darts.

Join: signatures are cut into BANDS bands of ROWS coordinates. Distinct texts (by a 128-bit hash) that share a band are
candidates. First each bucket's members are verified against its hub, the member that meets most texts; members already
linked are one class from then on. What remains are buckets with several classes. Those of up to BLOCK members are one group
of a task each: all pairs of members of different classes are compared exactly, and only links that join classes leave the task.

The members of larger ones meet further hubs, HUB_ROUNDS of them, and are then joined by their rarest shingles (prefix filter):
in an order of units that all texts share, two texts with similarity t have a unit in common among the first
n - ceil(2t / (1 + t) n) + 1 of the smaller and the first n - ceil(t n) + 1 of the larger one. Common units come last, so texts that
share boilerplate but are less similar than t don't meet, however many there are. The pairs that do are rows, and
verified exactly. So every candidate pair is decided exactly or lies within a class already, and a task's rows are bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm.common import cut_lineage, free_name, table, text_slices
from stackloom.llm.components import components
from stackloom.llm.words import LOWER_WORDS, mix, shingle_hashes, split_words

SHINGLE = 5
THRESHOLD = 0.8
#: A pair of similarity 0.8 shares no band with probability 7e-6.
BANDS, ROWS = 30, 5
#: Most members of a bucket that one task compares, and further hubs of the larger ones.
BLOCK, HUB_ROUNDS = 256, 2
#: Bits of the table of unit frequencies. It only sets the order of units, so that its collisions cost time but no pairs.
CELL_BITS = 18

_STEP = np.uint64(0x9E3779B97F4A7C15)


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Units of weight of all texts (a shingle's k-th occurrence is a unit of its own), and the first of each text."""
    w = split_words(texts, LOWER_WORDS)
    flat, starts = shingle_hashes(w.hashes()[w.codes], w.offsets, SHINGLE)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    # occurrences: order by (text, shingle) and number equal neighbours
    order = np.lexsort((flat, owner))
    f, o = flat[order], owner[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (o[1:] != o[:-1])
    run = np.flatnonzero(new)
    occurrence = np.arange(len(f)) - np.repeat(run, np.diff(np.append(run, len(f))))
    return mix(f + occurrence.astype(np.uint64) * _STEP), starts


def dart_signatures(unit: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The rank of the earliest dart of each of ``k`` coordinates, as 64 bits that tell darts apart; rows without units are inf."""
    n = len(starts) - 1
    size = np.diff(starts)
    out = np.full(n * k, np.inf)
    todo, darts = np.flatnonzero(size > 0), k * (math.log(k) + 3)
    while len(todo):  # coordinates that are still empty: the text again, with twice the darts
        count = size[todo]
        own = unit[np.repeat(starts[todo], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        row = np.repeat(todo, count)
        limit = (darts / size)[row]
        rank, i = np.zeros(len(own)), 0
        while len(own):
            drawn = mix(own + np.uint64((2 * i + 1) * int(_STEP) % 2**64))
            rank = rank - np.log(((drawn >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53)
            landed = rank < limit
            own, row, rank, limit = own[landed], row[landed], rank[landed], limit[landed]
            place = mix(drawn[landed] ^ _STEP) % np.uint64(k)
            np.minimum.at(out, row * k + place.astype(np.int64), rank)
            i += 1
        todo = todo[np.isinf(out.reshape(n, k)[todo]).any(1)]
        darts *= 2
    return out.reshape(n, k)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band."""
    bits = np.ascontiguousarray(signatures).view(np.uint64).reshape(len(signatures), BANDS, ROWS)
    out = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(signatures), 0)
    for j in range(ROWS):
        out = mix(out * _STEP + bits[:, :, j])
    return out.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_slices(batches, "text"):
        unit, starts = units(b.column("text"))
        keys = band_keys(dart_signatures(unit, starts, BANDS * ROWS))
        full = np.diff(starts) > 0
        offsets = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].ravel()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k1"), b.column("k2"), lists], names=["doc_id", "k1", "k2", "bands"])


def _similarities(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingles of each pair of texts."""
    made = []
    for texts in (a, b):
        unit, starts = units(texts)
        row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        made.append((mix(unit + mix(row.astype(np.uint64)) * _STEP), row, np.diff(starts)))
    (ua, ra, na), (ub, _, nb) = made
    _, at, _ = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    shared = np.bincount(ra[at], minlength=len(na))
    return shared / np.maximum(na + nb - shared, 1)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text_a", 1 << 20):
            close = _similarities(b.column("text_a"), b.column("text_b")) >= threshold - 1e-9
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(close))

    return run


def _compare_blocks(threshold: float):
    """Links between members of different classes of a bucket (rows of one bucket come together)."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        rows = sorted(rows, key=lambda r: r[0])  # by rid, so the result doesn't depend on the order of arrival
        unit, starts = units(pa.array([r[2] for r in rows], pa.string()))
        n = np.diff(starts)
        _, code = np.unique(unit, return_inverse=True)
        rid, label = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        held = np.zeros(int(code.max()) + 1 if len(code) else 1, np.int64)
        full = np.flatnonzero(n > 0)
        out = []
        # classes met so far are merged here, too, so that one link between two of them is enough
        for x in range(len(rows)):
            other = (label != label[x]) & (n > 0)
            other[: x + 1] = False
            # similarity is at most the ratio of sizes
            other &= np.minimum(n, n[x]) >= threshold * np.maximum(n, n[x]) - 1e-9
            if not other.any() or not n[x]:
                continue
            own = code[starts[x] : starts[x + 1]]
            held[own] = 1
            shared = np.zeros(len(rows), np.int64)
            shared[full] = np.add.reduceat(held[code], starts[:-1][full])
            held[own] = 0
            for y in np.flatnonzero(other & (shared >= threshold * (n + n[x] - shared) - 1e-9)):
                if label[y] != label[x]:
                    out.append((int(rid[x]), int(rid[y])))
                    label[label == label[y]] = label[x]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for b in batches:
            made = []
            for key, *r in zip(*(b.column(c).to_pylist() for c in ("band_key", "rid", "label", "text"))):
                if key != group and rows:
                    made += links(rows)
                    rows = []
                group = key
                rows.append(r)
            yield _link_batch(made)
        if rows:
            yield _link_batch(links(rows))

    return run


def _cells(unit: np.ndarray) -> np.ndarray:
    return (unit >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << CELL_BITS, np.int64)
    for b in text_slices(batches, "text"):
        counts += np.bincount(_cells(units(b.column("text"))[0]), minlength=len(counts))
    cell = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(counts[cell])], names=["cell", "n"])


def _prefixes(levels: np.ndarray, threshold: float):
    """The first units of each text, rare ones first; ``indexed``: those that a text needs where it is the smaller one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            unit, starts = units(b.column("text"))
            n = np.diff(starts)
            owner = np.repeat(np.arange(len(n)), n)
            unit = unit[np.lexsort((unit, levels[_cells(unit)], owner))]
            place, size = np.arange(len(unit)) - np.repeat(starts[:-1], n), n[owner]
            at = np.flatnonzero(place <= size - np.ceil(threshold * size - 1e-6))
            indexed = (place <= size - np.ceil(2 * threshold / (1 + threshold) * size - 1e-6))[at]
            rows = pa.array(owner[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(unit[at].view(np.int64)), b.column("rid").take(rows), b.column("label").take(rows), pa.array(size[at].astype(np.int32)),
                 pa.array(place[at].astype(np.int32)), pa.array(indexed)], names=["unit", "rid", "label", "n", "place", "indexed"])

    return run


def prefix_pairs(owners: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): pairs of ``owners`` (rid, label, text) of different labels, among them all of similarity ``threshold`` or more."""
    counted = owners.mapInArrow(_count_units, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # fixed size
    levels = np.zeros(1 << CELL_BITS, np.uint8)
    levels[counted.column("cell").to_numpy()] = np.round(4 * np.log2(1 + counted.column("n").to_numpy()))
    firsts = cut_lineage(owners.mapInArrow(_prefixes(levels, threshold), "unit long, rid long, label long, n int, place int, indexed boolean"))
    x, y = (firsts.select("unit", *[F.col(c).alias(f"{c}_{side}") for c in ("rid", "label", "n", "place", "indexed")]) for side in "xy")
    # what two texts have in common from a shared unit on is at most the rest of either
    rest = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
    smaller = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("rid_x") < F.col("rid_y")))
    return (x.filter("indexed_x").join(y, "unit")
            .filter(smaller & (F.col("label_x") != F.col("label_y")) & (F.col("n_x") >= threshold * F.col("n_y") - 1e-6)
                    & (rest >= threshold / (1 + threshold) * (F.col("n_x") + F.col("n_y")) - 1e-6))
            .select(F.col("rid_x").alias("a"), F.col("rid_y").alias("b")).distinct())


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    paired = (pairs.join(texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a")), "a")
              .join(texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b"))
    return paired.mapInArrow(_verify(threshold), "a long, b long")


def _of_labels(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links of texts as links of their classes. ``labels``: (node, label); others are classes of their own."""
    left = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    right = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    return (links.join(left, "a", "left").join(right, "b", "left")
            .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))


def _mixed(labelled: DataFrame) -> DataFrame:
    """The rows of buckets with several classes."""
    mixed = labelled.groupBy("band_key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("band_key")
    return labelled.join(mixed, "band_key")


def _link_large(large: DataFrame, texts: DataFrame, threshold: float) -> list[DataFrame]:
    """Links between classes of large buckets: ``large`` has (rid, band_key, label)."""
    out: list[DataFrame] = []
    for i in range(HUB_ROUNDS + 1):
        large = cut_lineage(_mixed(large))
        if large.isEmpty():
            return out
        if i == HUB_ROUNDS:
            owners = cut_lineage(large.select("rid", "label").distinct().join(texts, "rid").select("rid", "label", "text"))
            return [*out, _verified(prefix_pairs(owners, threshold), texts, threshold)]
        hubs = large.groupBy("band_key").agg(F.min(F.struct(F.xxhash64("rid", F.lit(i)), "rid", "label")).alias("h"))
        stars = (large.join(hubs, "band_key").filter("label <> h.label")
                 .select(F.least("rid", "h.rid").alias("a"), F.greatest("rid", "h.rid").alias("b")).distinct())
        links = cut_lineage(_verified(stars, texts, threshold))
        out.append(links)
        step = components(_of_labels(links, large.select(F.col("rid").alias("node"), "label").distinct()))
        large = (large.join(step.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
                 .select("rid", "band_key", F.coalesce("next", "label").alias("label")))
    return out


def _link_batch(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64())})


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"),
                       F.xxhash64(F.lit(1), text).alias("k2"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, k1, k2, class_id) for every row of ``docs`` (doc_id, text; other columns are not used).

    Documents whose word shingles have a weighted Jaccard similarity of ``threshold`` or more are linked, and so are equal
    texts; a class is a connected component, named by its least doc_id (null where all are null). k1 and k2 hash the text.
    Texts of under five words have one shingle of all their words; texts without words (null: empty) are linked to
    equal texts only. Repeated rows are in one class and each get a row.
    """
    docs = _keyed(docs)
    signed = docs.mapInArrow(_sign, "doc_id long, k1 long, k2 long, bands array<long>")
    reps = cut_lineage(signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
                       .withColumn("rid", F.monotonically_increasing_id()))
    dealt = reps.select("rid", F.explode("bands").alias("band_key"))
    sizes = dealt.groupBy("band_key").agg(F.count("*").alias("m")).filter("m > 1")
    members = cut_lineage(dealt.join(sizes, "band_key"))
    popular = members.groupBy("rid").agg(F.sum("m").alias("pop"))
    hubs = (members.join(popular, "rid").groupBy("band_key")
            .agg(F.max(F.struct("pop", (-F.col("rid")).alias("r"))).alias("h")).select("band_key", (-F.col("h.r")).alias("hub")))
    stars = (members.join(hubs, "band_key").filter("rid <> hub")
             .select(F.col("rid").alias("a"), F.col("hub").alias("b")).distinct())
    wanted = members.select("rid").distinct().join(reps.select("rid", "k1", "k2", F.col("doc_id").alias("d")), "rid")
    same = (docs["k1"] == wanted["k1"]) & (docs["k2"] == wanted["k2"]) & docs["doc_id"].eqNullSafe(wanted["d"])
    texts = cut_lineage(docs.join(wanted, same).select("rid", "text").dropDuplicates(["rid"]))
    links = _verified(stars, texts, threshold)
    first = components(links)
    labelled = (members.join(first.withColumnRenamed("node", "rid"), "rid", "left")
                .select("rid", "band_key", "m", F.coalesce("label", "rid").alias("label")))
    mixed = cut_lineage(_mixed(labelled))
    small = (mixed.filter(F.col("m") <= BLOCK).select("band_key", "rid", "label").join(texts, "rid")
             .repartition("band_key").sortWithinPartitions("band_key"))
    more = small.mapInArrow(_compare_blocks(threshold), "a long, b long")
    for links in _link_large(mixed.filter(F.col("m") > BLOCK).select("rid", "band_key", "label"), texts, threshold):
        more = more.union(links)
    joined = _of_labels(more, first)
    second = components(joined).select(F.col("node").alias("label"), F.col("label").alias("last"))
    named = (reps.select("rid", "k1", "k2", "doc_id").join(first.withColumnRenamed("node", "rid"), "rid", "left")
             .withColumn("label", F.coalesce("label", "rid")).join(second, "label", "left")
             .select("k1", "k2", "doc_id", F.coalesce("last", "label").alias("label")))
    least = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    of_text = named.select("k1", "k2", "label").join(least, "label").select("k1", "k2", "class_id", "label")
    return docs.select("doc_id", "k1", "k2").join(of_text, ["k1", "k2"])


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the least doc_id stays (ids before nulls).

    Among several texts with that id the one with the least hash stays; of repeated rows any one. All columns are kept, whatever
    their names.
    """
    own: list[str] = []
    for name in ("a", "b", "k1", "k2", "doc", "rows"):
        own.append(free_name([*docs.columns, *own], name))
    a, b, k1, k2, doc, n = own
    named = cut_lineage(classes(docs, threshold))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    best = named.groupBy("label").agg(F.min(order).alias("x")).select("label", "x.doc_id", "x.k1", "x.k2")
    rows = named.groupBy("k1", "k2", "doc_id").agg(F.count("*").alias("rows"))
    chosen = best.join(rows, (best["k1"] == rows["k1"]) & (best["k2"] == rows["k2"]) & best["doc_id"].eqNullSafe(rows["doc_id"])).select(
        best["k1"].alias(k1), best["k2"].alias(k2), best["doc_id"].alias(doc), F.col("rows").alias(n))
    text = F.coalesce("text", F.lit(""))
    kept = (docs.withColumn(a, F.xxhash64(text)).withColumn(b, F.xxhash64(F.lit(1), text))
            .join(chosen, (F.col(a) == F.col(k1)) & (F.col(b) == F.col(k2)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(doc))))
    once, again = kept.filter(F.col(n) == 1), kept.filter(F.col(n) > 1).dropDuplicates([a, b, doc])
    return once.union(again).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_id): a row for each document."""
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


QUERIES = {"op8_near_dedup": op8_near_dedup}
