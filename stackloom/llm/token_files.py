"""Token ids in bit-packed files, and the files read back.

Documents are range-partitioned by id and sorted, so file k holds ids below those of file k + 1; a task tokenises its
documents and writes one file, block by block. The manifest (one row a file) is a written table, so the files are made
once. Reading takes a row of the manifest per task, streams its blocks, and needs nothing else but the sum of ids of the
files before it.

A file: blocks of BLOCK_IDS ids (the last one shorter), each id in the least bits of the vocabulary, blocks filled to whole bytes;
then a footer: offsets of the blocks (int64, one more than blocks), first id of each document (int64, one more than
documents), document ids (int64), validity of document ids (one byte each); then six int64 (bits, ids a block, blocks, ids,
documents, start of the footer) and 8 bytes of magic. All little-endian but the packed ids. The ids of any document, or any range of
ids, are read from the blocks they touch.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackloom.llm.common import SLICE_BYTES, open_read, open_write, table, text_slices, work_folder
from stackloom.llm.int_map import IntMap
from stackloom.llm.packing import bit_width, pack, unpack
from stackloom.llm.words import LOWER, cut_text, raw_text

MAGIC = b"IDPACK1\n"
BLOCK_IDS = 1 << 16
#: Words whose ids a worker keeps; a full cache is emptied, which costs time only.
CACHE_WORDS = 300_000


def _parted() -> np.ndarray:
    """Neighbouring ASCII bytes between which the pre-tokeniser always cuts: next to white space and digits, and between
    letters and others. Apostrophes stay with what follows them, as they may start a contraction."""
    space, digit, letter = (np.array([f(chr(b)) for b in range(128)]) for f in (
        lambda c: c in " \t\n\r\x0b\x0c", str.isdigit, str.isalpha))
    kind = np.select([space, digit, letter], [0, 1, 2], 3)
    out = np.zeros((256, 256), bool)
    out[:128, :128] = (kind[:, None] != kind[None]) | digit[:, None]
    out[ord("'"), :] = False
    out[:128][space] = True  # white space is cut from anything else
    out[:, :128][:, space] = True
    out[np.ix_(np.flatnonzero(space), np.flatnonzero(space))] = False
    return out


class WordTokenizer:
    """Ids of texts by a tokenizer that ignores ASCII case and white space and cuts texts as ``_parted`` says.

    Each distinct piece is tokenised once, many pieces at a time: they are joined by a special token whose id then shows
    where a piece ends. The ids of pieces met so far are kept, by 63 bits of the piece's hash.
    """

    def __init__(self, path: str, separator: str = "<|startoftext|>"):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.separator, self.mark = separator, self.tokenizer.token_to_id(separator)
        self.parted = _parted()
        self.by_space = self.parted & np.array([[chr(a).isspace() or chr(b).isspace() for b in range(256)] for a in range(256)])
        self._clear()

    def _clear(self) -> None:
        self.known, self.flat, self.ends = IntMap(np.empty(0, np.int64), np.empty(0, np.int64)), np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _tokenize(self, words: list[str], step: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)"""
        plain = [w if self.separator not in w else "" for w in words]
        parts = []
        for a in range(0, len(plain), 64 * step):  # few at a time, as what the library returns is large
            joined = [self.separator.join(plain[x : x + step]) for x in range(a, min(a + 64 * step, len(plain)), step)]
            parts += [np.array([*x.ids, self.mark], np.uint32) for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(parts)
        cut = np.flatnonzero(ids == self.mark)
        flat, size = np.delete(ids, cut), np.diff(cut, prepend=-1) - 1
        if len(cut) != len(words):
            raise ValueError("the separator doesn't part the words")
        for i in reversed([i for i, w in enumerate(words) if self.separator in w]):
            own = np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, np.uint32)
            flat, size[i] = np.insert(flat, int(size[:i].sum()), own), len(own)
        return flat, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the number of ids)"""
        at, data = raw_text(texts)
        lower = data.translate(LOWER)
        if any(x.encode() in lower for x in self.special):
            w = cut_text(at, data, self.by_space)  # special tokens are found in text as it is, before it becomes lower case
        else:
            w = cut_text(at, lower, self.parted)
        keys = (w.hashes() >> np.uint64(1)).view(np.int64)
        place = self.known.get(keys)
        new = np.flatnonzero(place < 0)
        if len(new):
            if self.known.n + len(new) > CACHE_WORDS:
                self._clear()
                new = np.arange(len(keys))
            flat, size = self._tokenize(w.dictionary.take(pa.array(new)).to_pylist())
            place[new] = len(self.ends) - 1 + np.arange(len(new))
            self.known.add(keys[new], place[new])
            self.flat = np.concatenate([self.flat, flat])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
        code = place[w.codes]
        first, count = self.ends[code], self.ends[code + 1] - self.ends[code]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(first - ends[:-1], count)]
        return ids, ends[w.offsets]


@functools.lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Writer:
    """Streams ids to a file; holds one block, and 17 bytes a document."""

    def __init__(self, out, width: int, block_ids: int = BLOCK_IDS):
        self.out, self.width, self.block_ids = out, width, block_ids
        self.rest, self.offsets, self.n, self.at = np.empty(0, np.uint32), [0], 0, 0
        self.starts, self.ids, self.valid = [0], [], []

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.out.write(data)
        self.at += len(data)
        self.offsets.append(self.at)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> None:
        """Documents with their ids one after the other; ``ends``: after the last id of each."""
        if len(ids) and int(ids.max()) >> self.width:
            raise ValueError("an id is beyond the vocabulary")
        self.starts += (ends + self.n).tolist()
        self.ids += [0 if x is None else x for x in doc_ids]
        self.valid += [x is not None for x in doc_ids]
        self.n += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // self.block_ids * self.block_ids
        for a in range(0, whole, self.block_ids):
            self._block(self.rest[a : a + self.block_ids])
        self.rest = self.rest[whole:]

    def finish(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        start = self.at
        for values, kind in ((self.offsets, "<i8"), (self.starts, "<i8"), (self.ids, "<i8"), (self.valid, "u1")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(struct.pack("<6q", self.width, self.block_ids, len(self.offsets) - 1, self.n, len(self.ids), start) + MAGIC)


class Reader:
    """Random access to a file of packed ids; ``file`` is seekable."""

    def __init__(self, file):
        self.file = file
        file.seek(file.size() - 56)
        tail = file.read(56)
        if tail[48:] != MAGIC:
            raise ValueError("no file of packed ids")
        self.width, self.block_ids, blocks, self.n, docs, at = struct.unpack("<6q", tail[:48])
        file.seek(at)
        body = file.read(8 * (blocks + 1) + 8 * (docs + 1) + 9 * docs)
        self.offsets = np.frombuffer(body, "<i8", blocks + 1)
        self.starts = np.frombuffer(body, "<i8", docs + 1, 8 * (blocks + 1))
        ids = np.frombuffer(body, "<i8", docs, 8 * (blocks + docs + 2))
        valid = np.frombuffer(body, "u1", docs, 8 * (blocks + 2 * docs + 2))
        self.doc_ids = [i if v else None for i, v in zip(ids.tolist(), valid.tolist())]

    def ids(self, first: int, stop: int) -> np.ndarray:
        """Ids ``first`` to ``stop``, from the blocks that hold them."""
        if stop <= first:
            return np.empty(0, np.uint32)
        a, b = first // self.block_ids, (stop - 1) // self.block_ids
        self.file.seek(int(self.offsets[a]))
        data = self.file.read(int(self.offsets[b + 1] - self.offsets[a]))
        out, at = [], 0
        for k in range(a, b + 1):
            size, n = int(self.offsets[k + 1] - self.offsets[k]), min(self.block_ids, self.n - k * self.block_ids)
            low, high = max(0, first - k * self.block_ids), min(n, stop - k * self.block_ids)
            out.append(unpack(data[at : at + size], self.width, high - low, low))
            at += size
        return np.concatenate(out)

    def documents(self, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of documents of about ``limit`` ids: (first document, one after the last, their ids, starts within those)."""
        a, n = 0, len(self.doc_ids)
        while a < n:
            b = max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + limit, "right")) - 1)
            yield a, b, self.ids(int(self.starts[a]), int(self.starts[b])), self.starts[a : b + 1] - self.starts[a]
            a = b


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, vocabulary: int | None = None,
                 tokenize: Callable[[str], WordTokenizer] = word_tokenizer) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text; other columns are not used) and return the manifest of the files.

    Manifest: (file_no, path, n_docs, n_ids, first_id): ``first_id`` is the number of ids in all files before. Documents go in
    the order of doc_id, nulls first, ties by the hash of the text; repeated rows are written each. Null text is
    empty; ``end_id`` is appended to every document. Without rows there are no files. ``vocabulary`` widens the ids' bits.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("doc_id is an integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenize(tokenizer)
        width = bit_width(max(tok.vocabulary, (end_id or 0) + 1, vocabulary or 0))
        slices = text_slices(batches, "text", SLICE_BYTES // 2)
        first = next(slices, None)
        if first is None:
            return
        number = TaskContext.get().partitionId()
        path = f"{folder}/ids-{number:06d}.bin"
        with open_write(path) as out:
            w, b = Writer(out, width), first
            while b is not None:
                ids, starts = tok.encode(b.column("text"))
                ends = starts[1:]
                if end_id is not None:
                    ids = np.insert(ids, ends, end_id)
                    ends = ends + np.arange(1, len(ends) + 1)
                w.add(b.column("doc_id").to_pylist(), ids, ends)
                b = next(slices, None)
            w.finish()
        yield pa.RecordBatch.from_pydict({"file_no": [number], "path": [path], "n_docs": [len(w.ids)], "n_ids": [w.n]})

    placed = (docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("tie"))
              .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text"))
    made = placed.mapInArrow(run, "file_no long, path string, n_docs long, n_ids long")
    made.write.parquet(f"{folder}/manifest")
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return spark.read.parquet(f"{folder}/manifest").withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document in the files; ``start`` counts the ids of all documents before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column("path").to_pylist(), b.column("first_id").to_pylist()):
                with open_read(path) as file:
                    r = Reader(file)
                    for a, z, ids, starts in r.documents():
                        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32)))
                        yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids[a:z], pa.int64()), pa.array(r.starts[a:z] + first), lists],
                                                         names=["doc_id", "start", "ids"])

    return _spread(manifest).mapInArrow(run, "doc_id long, start long, ids array<int>")


def _spread(manifest: DataFrame) -> DataFrame:
    """A file for each task at most."""
    return manifest.select("path", "first_id").repartitionByRange(max(1, manifest.count()), "first_id", "path")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = write_tokens(docs, work_folder(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            at, flat = np.asarray(lists.offsets), lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            crc = [zlib.crc32(flat[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pc.list_value_length(lists).cast(pa.int64()),
                                              pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_documents(manifest).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


QUERIES = {"op2_token_files": op2_token_files}
