"""FLAC streams and packed token files: exact round trips, formats, odd rows."""

import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stackloom.llm import flac, packing, token_files
from stackloom.llm.common import work_folder
from stackloom.llm.elias_fano import EliasFano
from tests.llm.conftest import SF
from tests.llm.helpers import documents, prose

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def samples(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, np.uint8).astype(np.int64) - 128


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=5), st.sampled_from([0, 1, 4, 8]))
def test_flac_round_trip(texts, order):
    payloads = [flac.pad(t) for t in texts]
    for payload, x in zip(payloads, flac.decode_streams(flac.encode_payloads(payloads, order))):
        assert np.array_equal(x, samples(payload))


def test_flac_of_each_kind():
    noise = np.random.default_rng(5).integers(0, 256, 576 * 3).astype(np.uint8).tobytes()
    wave = (128 + 100 * np.sin(np.arange(576 * 4) / 9)).astype(np.uint8).tobytes()
    spikes = bytearray(b"\x80" * 576 * 2)
    spikes[100], spikes[700] = 0, 255
    payloads = [noise, wave, bytes(576), bytes(spikes), flac.pad(prose(1, 9000).encode() * 20)]
    for order in (0, 8):
        streams = flac.encode_payloads(payloads, order)
        assert len(streams[2]) < 120 and len(streams[1]) < len(wave)
        for payload, x in zip(payloads, flac.decode_streams(streams)):
            assert np.array_equal(x, samples(payload))


def test_flac_without_seek_table_and_with_damage():
    payload = flac.pad(prose(2, 3000).encode())
    stream = flac.encode_payloads([payload])[0]
    head = flac.Header(stream)
    assert head.complete() and [s for s, _, _ in head.points] == list(range(0, len(payload), 576))
    bare = b"fLaC\x80" + stream[5:42] + stream[head.start :]
    assert np.array_equal(flac.decode_streams([bare])[0], samples(payload))
    for at in (head.start + 2, head.start + 300, len(stream) - 1):
        broken = bytearray(stream)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode_streams([bytes(broken)])
    with pytest.raises(ValueError):
        flac.decode_streams([stream[:-40]])


def _bits(*fields) -> bytes:
    text = "".join(format(v & ((1 << n) - 1), f"0{n}b") for v, n in fields)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def _crc(data: bytes, poly: int, bits: int) -> int:
    crc = 0
    for byte in data:
        crc ^= byte << (bits - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly if crc >> (bits - 1) else crc << 1) & ((1 << bits) - 1)
    return crc


def _by_hand(subframe: list, values: list[int], bits: int = 16) -> bytes:
    """A stream of one frame, its size given in 8 bits, written field by field."""
    head = _bits((0xFFF8, 16), (6, 4), (0, 4), (0, 4), ({8: 1, 16: 4}[bits], 3), (0, 1), (0, 8), (len(values) - 1, 8))
    frame = head + bytes([_crc(head, 7, 8)]) + _bits(*subframe)
    frame += _crc(frame, 0x8005, 16).to_bytes(2, "big")
    raw = np.array(values, f"<i{bits // 8}").tobytes()
    info = struct.pack(">HH", 16, 16) + bytes(6) + ((8000 << 44) | ((bits - 1) << 36) | len(values)).to_bytes(8, "big") + hashlib.md5(raw).digest()
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame


def test_flac_streams_of_others():
    """16 bits, rice partitions, the wide rice parameter, raw residuals, a linear predictor with a shift."""
    values = [100, 103, 105, 110, 111, 120, 131, 140, 139, 130, 120, 121, 122, 100, 90, 95]

    def rice(v, k):
        u = v * 2 if v >= 0 else -v * 2 - 1
        return [(0, u >> k), (1, 1), (u, k)] if u >> k and k else [(0, u >> k), (1, 1)] if u >> k else [(1, 1), (u, k)] if k else [(1, 1)]

    diff = np.diff(values).tolist()
    two = [(0, 1), (9, 6), (0, 1), (values[0], 16), (0, 2), (1, 4), (2, 4)]
    for v in diff[:7]:
        two += rice(v, 2)
    two += [(3, 4)]
    for v in diff[7:]:
        two += rice(v, 3)
    raw = [(0, 1), (9, 6), (0, 1), (values[0], 16), (1, 2), (0, 4), (31, 5), (7, 5)] + [(v, 7) for v in diff]
    res = [values[i] - ((3 * values[i - 1] - 1 * values[i - 2]) >> 1) for i in range(2, 16)]
    linear = [(0, 1), (33, 6), (0, 1), (values[0], 16), (values[1], 16), (3, 4), (1, 5), (3, 4), (-1, 4), (0, 2), (0, 4), (4, 4)]
    for v in res:
        linear += rice(v, 4)
    for fields in (two, raw, linear, [(0, 1), (1, 6), (0, 1)] + [(v, 16) for v in values]):
        fields = [(v, n) for v, n in fields if n]
        assert flac.decode_streams([_by_hand(fields, values)])[0].tolist() == values


def test_flac_columns(spark):
    rows = [(1, "a"), (1, "a"), (2, None), (3, ""), (None, prose(3, 20_000)), (4, "é" * 900)]
    df = documents(spark, [(*r, "x", 7) for r in rows], "media string, pcm_blocks int").selectExpr("*", "cast(text AS binary) AS payload")
    stored = flac.encode(df, "payload")
    assert stored.columns[-1] == "media_"
    back = flac.decode(stored, "media_")
    assert back.columns[-1] == "pcm_blocks_"
    got = back.collect()
    assert len(got) == len(rows)
    for r in got:
        payload = b"".join(x["pcm"] for x in r["pcm_blocks_"])
        assert np.array_equal(np.frombuffer(payload, np.int8), samples(flac.pad((r["text"] or "").encode())))
        assert [x["sample_offset"] for x in r["pcm_blocks_"]] == list(range(0, len(payload), flac.PCM_BLOCK))
    assert len({r["media_"] for r in got}) == 4
    assert flac.decode(flac.encode(df.limit(0), "payload"), "media_").collect() == []
    assert flac.decode(spark.sql("SELECT cast(null AS binary) AS media")).first()["pcm_blocks"] is None


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.data())
def test_packing(width, data):
    values = np.array(data.draw(st.lists(st.integers(0, 2**width - 1), max_size=200)), np.uint64)
    packed = packing.pack(values, width)
    assert len(packed) == (len(values) * width + 7) // 8
    first = data.draw(st.integers(0, len(values)))
    assert packing.unpack(packed, width, len(values) - first, first).tolist() == values[first:].tolist()
    at = np.arange(len(values))[::-1]
    assert packing.gather(packing.pack_open(values, width), width, at).tolist() == values[at].tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=400), st.integers(1, 200))
def test_elias_fano(steps, scale):
    values = np.cumsum(np.array(steps) // 7) * scale
    ef = EliasFano.build(values)
    assert ef.get(np.arange(len(values))).tolist() == values.tolist()
    assert EliasFano.of(ef.arrays("x"), "x").get(np.array([len(values) - 1])).tolist() == [values[-1]]


ODD = ["", "  ", "a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|>x", "don't WE'LL 12 ½ é\xa0é x y\x1cz\x85q", "İSTANBUL ΣΑΣ Σ", "á ́b ́",
       "\n\t\r\x0b\x0cx", "日本語 テキスト", "'S 'LL x's", "a\0b 🙂🙂 ﬁ", "X" * 3000]


def test_ids_are_the_library_s():
    tokenizer, own = Tokenizer.from_file(TOKENIZER), token_files.WordTokenizer(TOKENIZER)
    texts = ODD + [prose(i, 50) for i in range(20)]
    for _ in range(2):  # the second time from what is kept
        ids, starts = own.encode(pa.array(texts))
        for i, text in enumerate(texts):
            assert ids[starts[i] : starts[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_token_files(spark, tmp_path):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = [(i * 3 % 101, t) for i, t in enumerate(ODD + [prose(i, 400) for i in range(60)])]
    rows += [(None, "no id"), (5, None), (5, "same id"), (5, "same id")]
    df = documents(spark, [(*r, "p") for r in rows], "start string")
    manifest = token_files.write_tokens(df, f"{tmp_path}/files", TOKENIZER, end_id=2)
    got = token_files.read_documents(manifest).orderBy("start").collect()
    assert len(got) == len(rows)
    ids = [r["doc_id"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    at = 0
    for r in got:
        assert r["start"] == at
        at += len(r["ids"])
    want = sorted((i if i is not None else -1, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids"]) for r in got) == want
    # any range of ids, from the blocks that hold it
    path = manifest.orderBy("file_no").first()["path"]
    with open(path, "rb") as f:
        reader = token_files.Reader(pa.PythonFile(f, "r"))
        whole = reader.ids(0, reader.n)
        for a, b in ((0, 1), (5, 90), (reader.n - 3, reader.n), (7, 7)):
            assert reader.ids(a, b).tolist() == whole[a:b].tolist()
    assert reader.width == 16
    empty = token_files.write_tokens(df.limit(0), f"{tmp_path}/none", TOKENIZER)
    assert token_files.read_documents(empty).collect() == []


def test_writer_blocks(tmp_path):
    path = tmp_path / "x.bin"
    with open(path, "wb") as out:
        w = token_files.Writer(out, 5, block_ids=16)
        for i in range(10):
            ids = np.arange(i * 3, dtype=np.uint32) % 32
            w.add([i], ids, np.array([len(ids)]))
        w.finish()
    with open(path, "rb") as f:
        r = token_files.Reader(pa.PythonFile(f, "r"))
        docs = [(r.doc_ids[a + k], ids[s[k] : s[k + 1]].tolist()) for a, b, ids, s in r.documents(limit=20) for k in range(b - a)]
    assert docs == [(i, (np.arange(i * 3) % 32).tolist()) for i in range(10)]
    assert np.diff(r.offsets).tolist() == [10] * (135 // 16) + [(135 % 16 * 5 + 7) // 8]


def test_token_query(spark):
    from tests.llm.conftest import SF

    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = {r["doc_id"]: r for r in token_files.op2_token_files(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    start = 0
    for r in rows:
        ids = tokenizer.encode(r["text"], add_special_tokens=False).ids + [2]
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(rows)


def test_media_query(spark):
    from tests.llm.conftest import SF

    got = {r["doc_id"]: r for r in flac.op10_flac_media(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        payload, g = flac.pad(r["text"].encode()), got[r["doc_id"]]
        assert (g["n_bytes"], g["payload_bytes"]) == (len(r["text"].encode()), len(payload))
        assert g["payload_sha256"] == hashlib.sha256(payload).hexdigest() and g["tail_crc32"] == zlib.crc32(payload[-32:])


def test_media_of_the_table_use_linear_predictors(spark, monkeypatch):
    """Streams of whole texts hold linear sub-frames, among others, and decode to the texts."""
    kinds = []
    own = flac._subframes
    monkeypatch.setattr(flac, "_subframes", lambda bits, pos, kind, n, width: kinds.append((kind, len(pos))) or own(bits, pos, kind, n, width))
    payloads = [flac.pad((r["text"] or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    made = flac.encode_payloads(payloads, flac.LPC_ORDER)
    assert all((flac_back == samples(p)).all() for flac_back, p in zip(flac.decode_streams(made), payloads))
    assert sum(n for k, n in kinds if k >= 32) > 100


def test_work_folder(spark):
    assert work_folder(spark, "x") != work_folder(spark, "x")
