"""Quality rules, the filter audit and conversation repair against plain versions."""

import collections
import hashlib
import heapq
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stackloom.llm import conversation_repair, filter_audit, quality_rules
from tests.llm.helpers import documents, prose

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")

# --- quality rules


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def odd_texts():
    line = prose(1, 12)
    return [None, "", " \t\n", "a", "a\x0bb c   d", "a b c d e a b c d e", "a b c d e f a b c d", "x " * 40, "# * $ % & | < >",
            "\n".join([line, line, "", " ", line, "other"]), "öäü ß 汉字 \U0001f600 " * 8, "A\r\nA\r\nA", prose(2, 9), prose(3, 3000),
            "IT!! IS!! LOUD!! " * 20, " | ".join(prose(4, 60).split()), "w%%% " * 30, prose(5, 300) + "\n" + prose(5, 300)]


def test_measures_of_odd_texts():
    texts = odd_texts()
    for column in (pa.array(texts, pa.string()), pa.array(texts, pa.large_string()).slice(3)):
        got = quality_rules.measure(column)
        want = [plain_measures(t) for t in column.to_pylist()]
        for i, m in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")):
            assert got[m].tolist() == [w[i] for w in want], m
    assert all(len(x) == 0 for x in quality_rules.measure(pa.array([], pa.string())).values())


def test_windows_of_one_hash_are_compared(monkeypatch):
    """With a hash that tells nothing apart, results stay."""
    monkeypatch.setattr(quality_rules, "mix", lambda x: x * np.uint64(0))
    assert quality_rules.measure(pa.array(odd_texts()))["n_repeat_words"].tolist() == [plain_measures(t)[4] for t in odd_texts()]


def plain_fit(votes):
    """Expectation-maximisation over documents, one at a time; votes are lists of 0, 1 (bad), 2 (good)."""
    k, q = len(quality_rules.RULES), quality_rules
    prior = [[q.PRIOR_ON_GOOD] * k] + [[q.PRIOR_ON_OWN if r == c else q.PRIOR_ON_OTHER for r in range(k)] for c in range(k)]
    share0 = [q.PRIOR_GOOD] + [(1 - q.PRIOR_GOOD) / k] * k
    chance, share, last = prior, share0, None
    for _ in range(q.ROUNDS):
        post = []
        for v in votes:
            p = [share[c] * math.prod(chance[c][r] if x == 2 else 1 - chance[c][r] if x == 1 else 1.0 for r, x in enumerate(v)) for c in range(k + 1)]
            post.append([x / sum(p) for x in p])
        if last and max(abs(a - b) for x, y in zip(post, last) for a, b in zip(x, y)) < 1e-9:
            break
        last = post
        new = []
        for c in range(k + 1):
            row = []
            for r in range(k):
                good = sum(p[c] for p, v in zip(post, votes) if v[r] == 2) + q.PRIOR_WEIGHT * prior[c][r]
                cast = sum(p[c] for p, v in zip(post, votes) if v[r]) + q.PRIOR_WEIGHT
                x = good / cast
                row.append(max(x, 0.5) if c == 0 else min(x, 0.5) if r == c - 1 else x)
            new.append(row)
        chance = new
        share = [(sum(p[c] for p in post) + q.PRIOR_WEIGHT * share0[c]) / (len(votes) + q.PRIOR_WEIGHT) for c in range(k + 1)]
    return [p[0] for p in post]


def test_model_against_plain_version():
    draw = random.Random(5)
    kinds = [[2] * 8, [1, 1, 2, 2, 2, 2, 0, 2], [2, 2, 1, 2, 2, 2, 1, 0], [0] * 8, [2, 2, 2, 0, 2, 2, 0, 0]]
    votes = [[x if draw.random() > 0.05 else draw.randrange(3) for x in draw.choices(kinds, [20, 2, 2, 1, 3])[0]] for _ in range(150)]
    codes = np.array([sum(x * 3**i for i, x in enumerate(v)) for v in votes])
    patterns, where, counts = np.unique(codes, return_inverse=True, return_counts=True)
    post, chances, shares = quality_rules.fit(patterns, counts.astype(float))
    assert np.allclose(post[where], plain_fit(votes), atol=1e-7)
    assert abs(shares.sum() - 1) < 0.01 and (chances[0] >= 0.5).all()
    assert quality_rules.fit(patterns[:0], counts[:0].astype(float))[2][0] == quality_rules.PRIOR_GOOD


def test_quality_query(spark):
    """Measures against the plain ones over all rows; bad documents go, good ones stay."""
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = quality_rules.op11_quality_rules(spark, SF)
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = got.collect()
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    for r in got:
        want = plain_measures(rows[r["doc_id"]])
        assert tuple(r)[1:6] == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= quality_rules.KEEP)


def test_quality_of_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.op11_quality_rules(spark, sf).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    bad, good = ([kept[i] for i, q in labels if q == v] for v in (0, 1))
    assert sum(bad) <= 0.05 * len(bad) and sum(good) >= 0.95 * len(good)


def test_quality_of_odd_tables(spark):
    rows = [(i // 2, t, i) for i, t in enumerate(odd_texts() * 2)] + [(None, "a b", 1)]
    docs = documents(spark, rows, "votes int").withColumn("quality", F.lit("x")).withColumn("a.b", F.lit(1))
    out = quality_rules.assess(docs)
    assert out.columns == ["doc_id", "votes", "quality", "a.b", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "votes_", "quality_"]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["votes"], r["n_words"]) for r in out.collect())
    assert got == sorted((i is None, i or 0, v, plain_measures(t)[0]) for i, t, v in rows)
    assert all(0 <= r["quality_"] <= 1 and r["quality"] == "x" for r in out.collect())
    assert quality_rules.assess(docs.limit(0)).collect() == []


# --- filter audit


def plain_audit(rows, names):
    """Every order applied to every document. ``rows``: (part, failed letters, good, toxic)."""
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = collections.Counter()
        for order in map("".join, itertools.permutations(names)):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine),
                                          sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for order, step in [k[1:] for k in out if k[0] == part]:
            out[part, order, step].append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_against_every_order(spark):
    draw = random.Random(3)
    for names in ("X", "AB", "DCBA"):
        rows = [(draw.choice(["en", "", None]), {f for f in names if draw.random() < 0.4}, draw.randrange(2), draw.randrange(2)) for _ in range(60)]
        sets = spark.createDataFrame([(p, sum(1 << names.index(f) for f in fs), 1, g, x, "extra") for p, fs, g, x in rows],
                                     "part string, mask int, n long, good long, toxic long, step string")
        got = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.audit(sets, names).collect()}
        assert got == plain_audit([(p or "", *r) for p, *r in rows], names)
        assert filter_audit.audit(sets.limit(0), names).collect() == []
    lattice = filter_audit.Lattice("ABCDE")
    assert all(lattice.forward[s] * lattice.backward[s] == math.factorial(bin(s).count("1")) * math.factorial(5 - bin(s).count("1")) for s in range(32))
    for bad in ("", "AA", "ABCDEFGH"):
        with pytest.raises(ValueError):
            filter_audit.Lattice(bad)


def plain_failures(rows, labels):
    """(part, failed letters, good, toxic) of (doc_id, text, lang) rows under the production filters."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        marks = [(q, x) for j, q, x in labels if j is not None and j == i]
        out.append((lang or "", {f for f, v in fails.items() if v}, int(any(q == 1 for q, _ in marks)), int(any(x == 1 for _, x in marks))))
    return out


def test_audit_of_odd_rows(spark):
    same = prose(1, 220)
    rows = [(5, same, "en"), (2, same, "de"), (2, same, "en"), (None, same, "en"), (None, same, None), (7, None, None), (3, "", "en"), (None, None, None),
            (9, "LOUD WORDS %", "en"), (10, "la " * 300, "fr"), (11, prose(2, 5000), "fr"), (11, prose(3, 250), "fr"), (1, "  x", "")]
    labels = [(2, 1, 0), (2, 0, 1), (5, 0, 0), (9, None, 1), (None, 1, 1), (99, 1, 1), (10, 1, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, n int, mask string")
    marks = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, text string")
    sets = filter_audit.failure_sets(docs, marks, filter_audit.production_filters(), copies="E")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.audit(sets, "ABCDE").collect()}
    assert got == plain_audit(plain_failures(rows, labels), "ABCDE")
    assert filter_audit.failure_sets(docs.limit(0), marks, filter_audit.production_filters(), copies="E").collect() == []


def test_audit_query(spark):
    got = filter_audit.op12_filter_audit(spark, SF)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(filter_audit.SQL["op12_filter_audit"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == plain_audit(plain_failures(rows, labels), "ABCDE")


# --- conversation repair


def plain_edits(rows):
    """Least (cost, letters) by search over (rows done, roles so far as the grammar sees them); rows: (initial, fault)."""
    heap, best = [(0, "", 0, "")], set()
    while heap:
        cost, letters, i, made = heapq.heappop(heap)
        if (i, made, letters) in best:
            continue
        best.add((i, made, letters))
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", made):
            return letters, cost
        steps = [("I", 2, i, made + x) for x in "ua"]
        if i < len(rows):
            initial, fault = rows[i]
            more = fault == "truncated"
            steps.append(("D", 3, i + 1, made))
            if fault not in ("blank", "duplicate"):
                steps += [("R", 2 + more, i + 1, made + x) for x in "ua"] + [("K", more, i + 1, made + (initial or "?"))]
        for letter, more, j, now in steps:
            if re.fullmatch(r"s?(ua)*u?", now) and cost + more <= 3 * len(rows):
                heapq.heappush(heap, (cost + more, letters + letter, j, now))


def plain_repair(turns):
    """Rows of the result for (conv_id, turn, role, text) after damage, ties by role and digest."""
    groups = collections.defaultdict(list)
    for conv, turn, role, text in turns:
        groups[conv].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    out = {}
    for conv, rows in groups.items():
        rows.sort()
        faults, seen = [], set()
        for _, _, role, _, text in rows:
            end = text.rstrip("\t\n\x0b\x0c\r ")
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
            seen.add((role, text))
        letters, cost = plain_edits([(r[2][:1], f) for r, f in zip(rows, faults)])
        made, i = [], 0
        for x in letters:
            expected = "assistant" if made and made[-1][0][:1] == "u" else "user"
            if x in "IR":
                made.append((expected, "" if x == "I" else rows[i][4]))
            elif x == "K":
                made.append((rows[i][2], rows[i][4]))
            i += x != "I"
        turns_of = [r[1] for r in rows if r[0]]
        gaps = max(turns_of) - min(turns_of) + 1 - len(set(turns_of)) if turns_of else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


def plain_damage(turns):
    for conv, turn, role, text in turns:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw:
            text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
            yield from [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)


def test_edits_against_search():
    draw = random.Random(2)
    for n in [0, 1, 1, 1, 2, 2, 3, 3, 4, 5, 6, 7] * 25:
        rows = [(draw.choice("suaux"), draw.choice([None, None, None, "truncated", "blank"])) for _ in range(n)]
        kinds = bytes(conversation_repair.kind_of(r, {None: 0, "truncated": 1, "blank": 2}[f]) for r, f in rows)
        assert conversation_repair.cheapest_edits(kinds) == plain_edits(rows)[0]


def test_few_places_are_exact(monkeypatch):
    """Weights with room for two letters choose the same edits as those with room for all of them."""
    draw = random.Random(4)
    cases = [bytes(draw.choices([0, 3, 6, 9, 4, 5, 7], k=n)) for n in range(40)]
    want = [conversation_repair.cheapest_edits(c) for c in cases]
    monkeypatch.setattr(conversation_repair, "PLACES", 2)
    monkeypatch.setattr(conversation_repair, "_LOW", 6)
    monkeypatch.setattr(conversation_repair, "_NEVER", 1 << 70)
    assert [conversation_repair.cheapest_edits(c) for c in cases] == want
    assert set("".join(want)) == set("DIKR")


def test_repair_of_odd_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "No."), (3, 5, "system", "x"), (3, None, "user", "a!"), (3, 9, None, None),
            (3, 9, "", "t"), (3, 9, "", "t"), (4, 0, "user", " \n\t"), (None, 0, "user", "q?"), (None, 0, "user", "q?"), (None, 1, "assistant", "r."),
            (5, 0, "user", "Ö  "), (5, 1, "assistant", "long. " * 30_000), (6, None, "tool", "a."), (6, None, "ünder", "b."), (7, 1, "user", "a\x00.")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, digest string")
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    got = {r["conv_id"]: tuple(r)[1:] for r in conversation_repair.digests(conversation_repair.repair(turns)).collect()}
    assert got == plain_repair(plain)
    edits = conversation_repair.repair(turns).collect()
    assert all((r["edit"] == "I") == (r["old_role"] is None) and (r["role"] is None) == (r["edit"] == "D") for r in edits)
    assert conversation_repair.repair(turns.limit(0)).collect() == []
    named = turns.withColumn("conv_id", F.col("conv_id").cast("string"))
    assert {r["conv_id"] for r in conversation_repair.digests(conversation_repair.repair(named)).collect()} == {"1", "2", "3", "4", "5", "6", "7", None}


def test_very_long_conversation():
    kinds = bytes([conversation_repair.kind_of(r, 0) for r in ("user", "assistant", "user")] * 4000)
    edits = conversation_repair.cheapest_edits(kinds)
    assert len(edits) - edits.count("I") == 12_000 and sum(conversation_repair.COSTS[x] for x in edits) == 8000


def test_repair_query(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    gone = next(i for i in range(10**6, 2 * 10**6) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "dropped."), (None, None, None, None), (None, 3, "user", "x.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = conversation_repair.op13_conversation_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = {c: (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()) for c, *_ in rows} | plain_repair(plain_damage(rows))
    got = got.collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want) and want[gone][6] == ""
    spark.read.parquet(f"{tmp_path}/conversations.parquet").limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert conversation_repair.op13_conversation_repair(spark, f"{tmp_path}/none").collect() == []
