"""Words of Arrow text columns as dictionary codes, for tasks that count or look up words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_ASCII = bytes(range(256))
#: A-Z to a-z, nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in _ASCII)
#: A-Z to a-z, ASCII control characters and punctuation to spaces; bytes from 128 stay.
LOWER_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in _ASCII)


#: One random number for each byte value at each of the first 64 places of a word.
_PLACES = 64
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, (_PLACES, 256), np.uint64).ravel()


@dataclass
class Words:
    offsets: np.ndarray  # of each text's first word, and the number of words
    codes: np.ndarray  # index into ``dictionary`` for each word
    dictionary: pa.Array  # the distinct words

    @property
    def words(self) -> list[bytes]:
        return self.dictionary.cast(pa.binary()).to_pylist()

    def hashes(self) -> np.ndarray:
        """64 bits for each distinct word, the same wherever the word occurs."""
        at, data = raw_text(self.dictionary)
        if len(at) == 1:
            return np.zeros(0, np.uint64)
        size = np.diff(at)
        place = np.arange(at[-1]) - np.repeat(at[:-1], size)
        drawn = _TABLE[(place & (_PLACES - 1)) * 256 + np.frombuffer(data, np.uint8)]
        out = mix(np.add.reduceat(drawn, at[:-1]) + size.astype(np.uint64))
        for i in np.flatnonzero(size > _PLACES):  # places repeat from there
            out[i] = xxhash.xxh64_intdigest(data[at[i] : at[i + 1]])
        return out

    @property
    def rows(self) -> np.ndarray:
        """Of each word, the number of its text."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def plain_text(column: pa.Array) -> pa.Array:
    """As ``string`` without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def raw_text(column: pa.Array) -> tuple[np.ndarray, bytes]:
    """Byte offsets (from 0) and the UTF-8 bytes of all texts."""
    column = plain_text(column)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(len(column) + 1, np.int64), b""
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at - at[0], b"" if data is None else data.slice(at[0], at[-1] - at[0]).to_pybytes()


def split_words(column: pa.Array, table: bytes | None = None) -> Words:
    """Split at bytes 9 to 13 and 32 after mapping each byte by ``table``; there are no empty words."""
    at, data = raw_text(column)
    if table is not None:
        data = data.translate(table)
    texts = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data))
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), np.asarray(lists.offsets, np.int64)
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return Words(offsets, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary)


def cut_text(at: np.ndarray, data: bytes, parted: np.ndarray) -> Words:
    """Split texts wherever ``parted`` (256 x 256 bytes, True between ASCII bytes only) says so; nothing is left out."""
    if not data:
        return Words(np.zeros(len(at), np.int64), np.empty(0, np.int32), pa.array([], pa.string()))
    raw = np.frombuffer(data, np.uint8)
    first = np.ones(len(raw), bool)
    first[1:] = parted[raw[:-1], raw[1:]]
    first[at[:-1][at[:-1] < at[1:]]] = True
    starts = np.flatnonzero(first).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, np.int32(len(raw))).tobytes()), pa.py_buffer(data))
    coded = pieces.dictionary_encode()
    return Words(np.searchsorted(starts, at), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary)


def shingle_hashes(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words within a text, and the first shingle of each text.

    A text of 1 to ``size`` - 1 words has one shingle of all its words, an empty text none.
    """
    n = np.diff(offsets)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    starts = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(offsets[:-1], count) + np.arange(starts[-1]) - np.repeat(starts[:-1], count)
    length = np.repeat(np.minimum(n, size), count)
    out = length.astype(np.uint64)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    for i in range(size):
        # a shorter run has the same hash whatever the size asked for
        out = np.where(i < length, mix(out * np.uint64(0x9E3779B97F4A7C15) + padded[first + i]), out)
    return out, starts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
