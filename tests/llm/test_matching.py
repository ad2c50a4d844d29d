"""Near duplicates, benchmark passages and the pipeline: against brute force."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline
from stackloom.llm import decontaminate, near_dedup
from stackloom.llm.components import components
from tests.llm.conftest import SF
from tests.llm.helpers import WORDS, documents, plain_words, prose, shingles


def weighted_jaccard(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


def plain_classes(rows: list[tuple]) -> list:
    """Class id of each row: connected components over all pairs."""
    bags = [Counter(shingles(plain_words(t))) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or weighted_jaccard(bags[i], bags[j]) >= 0.8 - 1e-9:
                parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [least.get(find(i)) for i in range(len(rows))]


def edited(words: list[str], share: float, draw: random.Random) -> str:
    return " ".join(draw.choice(["nova", "quasar", "pulsar"]) + str(draw.randrange(10**6)) if draw.random() < share else w for w in words)


def family(seed: int, copies: int, n: int, most: float) -> list[str]:
    draw = random.Random(seed)
    base = [f"{w}{draw.randrange(5000)}" for w in prose(seed, n).split()]
    return [" ".join(base)] + [edited(base, draw.random() * most, draw) for _ in range(copies)]


def test_classes_against_all_pairs(spark):
    texts = family(1, 70, 200, 0.12) + family(2, 20, 60, 0.05) + [prose(100 + i, 50) for i in range(30)] + ["", None, "  ", "one two", "One, two!", "one two", "a b c d e", "A b c d e."]
    texts += [family(3, 1, 15_000, 0.01)[1], family(3, 1, 15_000, 0.01)[0], "la " * 400, "la " * 390, texts[0], texts[0]]
    rows = [(i * 7 % 997, t) for i, t in enumerate(texts)] + [(None, "no id at all here"), (None, texts[1]), (5000, texts[1]), (5000, texts[1])]
    df = documents(spark, [(*r, "c") for r in rows], "class_id string")
    got = Counter((r["doc_id"], r["class_id"]) for r in near_dedup.classes(df).select("doc_id", "class_id").collect())
    assert got == Counter((doc, c) for (doc, _), c in zip(rows, plain_classes(rows)))
    kept = near_dedup.dedup(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = plain_classes(rows)
    assert sorted(i for i in ids if i is not None) == sorted({c for c in want if c is not None}) and ids.count(None) == 1


def test_classes_of_nothing(spark):
    none = documents(spark, []).limit(0)
    assert near_dedup.classes(none).collect() == [] and near_dedup.dedup(none).collect() == []


def test_bucket_blocks(spark, monkeypatch):
    """Buckets cut into many blocks give the same classes."""
    texts = family(9, 60, 80, 0.12)
    rows = list(enumerate(texts))
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(documents(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == plain_classes(rows)


def test_large_buckets_of_many_classes(spark, monkeypatch):
    """Texts of one boilerplate, none alike enough: no task gets more than a block of a bucket, and nothing is left out."""
    base, compare, block = prose(7, 400).split(), near_dedup._compare_blocks, 8
    draw = random.Random(7)
    texts = [" ".join(base[:340] + [f"v{draw.randrange(10**9)}" for _ in range(48)]) for _ in range(150)]
    # copies with a word changed at the end, and a chain of texts that are like their neighbours only
    texts += [t.rsplit(" ", 3)[0] + " x y z" for t in texts[:20]]
    chain = texts[40].split()
    for i in range(12):
        chain[-4 * (i + 1):len(chain) - 4 * i] = [f"c{i}{j}" for j in range(4)]
        texts.append(" ".join(chain))
    rows = list(enumerate(texts))
    monkeypatch.setattr(near_dedup, "BLOCK", block)

    def limited(threshold):
        run = compare(threshold)

        def counted(batches):
            groups = Counter()

            def passed():
                for b in batches:
                    groups.update(zip(*(b.column(c).to_pylist() for c in ("band_key", "i", "j") if c in b.schema.names)))
                    assert max(groups.values(), default=0) <= block
                    yield b

            yield from run(passed())

        return counted

    monkeypatch.setattr(near_dedup, "_compare_blocks", limited)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(documents(spark, rows)).collect()}
    want = plain_classes(rows)
    assert [got[i] for i, _ in rows] == want and len(set(want)) == 150
    owners = spark.createDataFrame([(i, i, t) for i, t in rows], "rid long, label long, text string")
    pairs = {(r["a"], r["b"]) for r in near_dedup.prefix_pairs(owners).collect()}
    bags = [Counter(shingles(plain_words(t))) for t in texts]
    alike = {(i, j) for i in range(len(texts)) for j in range(i) if weighted_jaccard(bags[i], bags[j]) >= 0.8}
    assert alike <= pairs | {(b, a) for a, b in pairs} and len(pairs) < 300 < len(texts) ** 2 / 100


def test_darts_agree_as_often_as_texts_are_similar():
    draw = random.Random(8)
    base = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    for share in (0.01, 0.04, 0.1):
        a, b = " ".join(base), edited(base, share, draw)
        unit, starts = near_dedup.units(pa.array([a, b]))
        s = near_dedup.dart_signatures(unit, starts, 3000)
        want = weighted_jaccard(Counter(shingles(plain_words(a))), Counter(shingles(plain_words(b))))
        assert abs((s[0] == s[1]).mean() - want) < 0.04
        assert np.isfinite(s).all()
    # weights count: "la" 400 times and 200 times share half of their units
    unit, starts = near_dedup.units(pa.array(["la " * 404, "la " * 204, ""]))
    s = near_dedup.dart_signatures(unit, starts, 2000)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.05 and np.isinf(s[2]).all()


def test_components(spark):
    draw = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + draw.randrange(30), 100 + draw.randrange(30)) for _ in range(25)] + [(200, 201 + i) for i in range(50)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == linked
    assert len({(find(x), got[x]) for x in linked}) == len({find(x) for x in linked}) == len({got[x] for x in linked})
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def plain_matches(items: list[tuple], text: str | None) -> list[tuple]:
    words, out = plain_words(text), []
    for i, (item, body) in enumerate(items):
        own = plain_words(body)
        if not own:
            continue
        size, best = min(5, len(own)), (0.0, 0)
        bag = Counter(shingles(own))
        if len(words) < size:
            continue
        n = min(len(own), len(words))
        for s in range(len(words) - n + 1):
            v = weighted_jaccard(bag, Counter(shingles(words[s : s + n], size)))
            if v >= 0.8 - 1e-9 and v > best[0] + 1e-12:
                best = (v, s)
        if best[0]:
            out.append((item, round(best[0], 9), best[1], n))
    return out


def test_matches_against_all_windows(spark):
    draw = random.Random(6)
    unusual = lambda n, seed: family(seed, 0, n, 0)[0]
    items = [(i, unusual(n, 50 + i)) for i, n in enumerate([16, 20, 20, 38, 59, 59, 7, 5, 3, 1])] + [(20, None), (21, ""), (22, unusual(20, 51)), (None, unusual(25, 70))]
    texts = []
    for _, body in items:
        if body:
            words = body.split()
            near = list(words)
            near[-1] = "changed"
            texts += [prose(1, 40) + " " + body + " " + prose(2, 30), body.upper().replace(" ", ", "), " ".join(near) + " tail", " ".join(words[: len(words) // 2]),
                      " ".join(words[:3] + ["inserted"] + words[3:]), prose(3, 10) + " " + edited(words, 0.03, draw) + " end " + body]
    texts += ["", None, prose(4, 15_000), items[3][1] + " " + prose(5, 9000) + " " + items[4][1]]
    rows = [(i % 50, t) for i, t in enumerate(texts)]
    df = documents(spark, [(*r, "m") for r in rows], "matches string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    known = [x for x in items if x[1]]
    want = sorted(str((i, sorted(plain_matches(known, t), key=str))) for i, t in rows)
    for size in (8 << 20, 300):  # in one block, and in several
        marked = decontaminate.mark(df, benchmark, block_bytes=size)
        assert marked.columns == ["doc_id", "text", "matches", "matches_"]
        got = sorted(str((r["doc_id"], sorted(((m["item_id"], round(m["similarity"], 9), m["start_word"], m["n_words"]) for m in r["matches_"]), key=str)))
                     for r in marked.collect())
        assert got == want
    assert all(r["matches_"] == [] for r in decontaminate.mark(df, benchmark.limit(0)).collect())
    assert decontaminate.mark(df.limit(0), benchmark).collect() == []


def test_radius_is_guaranteed():
    """Tables of blocks find what a scan of all fingerprints finds."""
    draw = np.random.default_rng(1)
    index = decontaminate.Index(list(range(80)), [" ".join(random.Random(i).choices(WORDS, k=30)) for i in range(80)])
    group = index.groups[30]
    flips = np.packbits(draw.random((400, 64)) < draw.random((400, 1)) * 0.6, axis=1)
    prints = group.prints[draw.integers(0, 80, 400)] ^ flips
    distance = np.unpackbits(prints[:, None] ^ group.prints[None], axis=2).sum(2)
    every = np.repeat(prints, 80, axis=0), np.tile(np.arange(80), 400)
    assert group.close(*every).tolist() == (distance <= decontaminate.RADIUS).ravel().tolist()
    assert 100 < group.close(*every).sum() < 400 * 80 / 2


def test_windows_of_hits():
    draw = random.Random(3)
    for _ in range(300):
        n = draw.randint(1, 60)
        hits = np.array(sorted(draw.sample(range(n), draw.randint(1, n))))
        size, need = draw.randint(1, n), draw.randint(1, len(hits))
        want = [s for s in range(n - size + 1) if sum(s <= h < s + size for h in hits) >= need]
        assert decontaminate.windows(hits, need, size, n - size).tolist() == want


def test_document_that_holds_a_benchmark():
    """A leaked benchmark file is linear work: windows are compared with the items that lie there."""
    items = [" ".join(f"w{x}" for x in random.Random(i).choices(range(5000), k=30)) for i in range(2000)]
    index = decontaminate.Index(list(range(2000)), items)
    start = time.perf_counter()
    found = index.matches(pa.array(["\n".join(items), items[7]]), decontaminate.THRESHOLD)
    assert time.perf_counter() - start < 20
    assert [(i, s) for i, _, s, _ in found[0]] == [(i, 30 * i) for i in range(2000)] and [i for i, *_ in found[1]] == [7]


def test_decontamination_query(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {}
    for r in decontaminate.op9_decontaminate(spark, SF).collect():
        got.setdefault(r["doc_id"], []).append((r["item_id"], r["similarity"], r["start_word"], r["n_words"]))
    bags = [(set(shingles(plain_words(t))), i, t) for i, t in items]
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        have = set(shingles(plain_words(r["text"])))
        likely = [(i, t) for bag, i, t in bags if len(bag & have) >= 0.8 * len(bag) - 1e-9]  # others can't reach the threshold
        assert sorted(got.get(r["doc_id"], [])) == sorted(plain_matches(likely, r["text"]))


def test_near_dedup_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.op8_near_dedup(spark, SF).collect()}
    assert [got[i] for i, _ in rows] == plain_classes(rows)


def test_pipeline(spark):
    """Each stage against a plain version over what the stage before has kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns
    clean = [tuple(r) for r in clean.select("doc_id", "text").collect()]
    assert 0.8 * docs.count() < len(clean) <= docs.count()
    once = [(i, t) for (i, t), c in zip(clean, plain_classes(clean)) if i == c]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = sorted(i for i, t in once if not any(
        len(set(shingles(plain_words(b))) & set(shingles(plain_words(t)))) >= 0.8 * len(set(shingles(plain_words(b)))) and plain_matches([(0, b)], t)
        for _, b in items))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == kept
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in got)


def test_pipeline_of_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None, "s"), (1, None, None, None, None, "s"), (2, "", "en", "a", 0, "s"), (None, "text without id", "en", "a", 5, None),
            (3, prose(1, 12_000), "en", "a", 5, "x"), (3, prose(1, 12_000), "en", "a", 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, frame in (("documents", df), ("labels", none), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["n_pieces"] > 0) for r in got) == [(0, True), (1, False), (3, True)]
    df.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    none.write.parquet(f"{tmp_path}/empty/labels.parquet")
    spark.createDataFrame([(1, "x y")], "item_id long, text string").write.parquet(f"{tmp_path}/empty/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []


def test_dedup_keeps_columns_of_any_name(spark):
    """Names that the operator would use itself come back with their own values."""
    names = ["a", "b", "k1", "k2", "doc", "rows", "__a", "__doc", "label", "class_id"]
    rows = [(1, prose(1, 40)), (2, prose(1, 40)), (3, prose(2, 40)), (3, prose(2, 40)), (None, None)]
    df = documents(spark, [(*r, *(f"{n}{i}" for n in names)) for i, r in enumerate(rows)], ", ".join(f"{n} string" for n in names))
    got = sorted((r["doc_id"] or 0, *(r[n] for n in names)) for r in near_dedup.dedup(df).collect())
    assert [r[0] for r in got] == [0, 1, 3]
    assert got[1] == (1, *(f"{n}0" for n in names)) and got[0] == (0, *(f"{n}4" for n in names))
    assert got[2] in [(3, *(f"{n}{i}" for n in names)) for i in (2, 3)]
