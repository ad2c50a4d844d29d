"""FLAC streams as a media column: encode bytes as 8-bit samples, decode any mono stream to PCM blocks.

Work is per row, so Spark only has to spread rows over tasks; nothing is shuffled. Inside a task numpy handles all
frames of a few MB of payload together: Rice codes of all frames are followed in step, one residual of every frame at
a time, and so are linear predictors and the CRC-16 of the frames. A seek table with a point for every frame gives the
decoder all frame starts at once; a stream without one is followed frame by frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stackloom.llm.common import free_name, table, text_slices

BLOCK = 576
#: Samples of a PCM block: 64 frames.
PCM_BLOCK = 64 * BLOCK
#: Payload bytes handled together.
CHUNK = 1 << 20
# Fixed values of the format: sync code, block size code of 576, code of 8 bits a sample, polynomials.
SYNC, SIZE_576, BITS_8, POLY8, POLY16 = 0xFFF8, 2, 1, 0x07, 0x8005
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}
#: Order of the linear predictors that the query's streams may use.
LPC_ORDER = 8


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, (out << 1) ^ poly, out << 1) & ((1 << bits) - 1)
    return out.astype(np.uint32)


_CRC8, _CRC16 = _crc_table(POLY8, 8), _crc_table(POLY16, 16)


def _crc(data: np.ndarray, start: np.ndarray, stop: np.ndarray, bits: int) -> np.ndarray:
    """CRC of ``data[start:stop]`` for many ranges in step."""
    table, mask = (_CRC8, 0xFF) if bits == 8 else (_CRC16, 0xFFFF)
    order = np.argsort(start - stop, kind="stable")  # longest first, so that those still running are a prefix
    at, length = start[order], (stop - start)[order]
    crc = np.zeros(len(order), np.uint32)
    running = len(order)
    for i in range(int(length[0]) if len(order) else 0):
        while running and length[running - 1] <= i:
            running -= 1
        now = crc[:running]
        crc[:running] = ((now << 8) & mask) ^ table[(now >> (bits - 8)) ^ data[at[:running] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number_bytes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's variable-length coding: (bytes of 7 columns, lengths)."""
    limits = np.array([1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26, 1 << 31])
    length = 1 + np.searchsorted(limits, n, "right")
    out = np.zeros((len(n), 7), np.uint8)
    for k in range(1, 8):
        rows = np.flatnonzero(length == k)
        if len(rows):
            v = n[rows]
            if k == 1:
                out[rows, 0] = v
            else:
                lead = (0xFF << (8 - k)) & 0xFF
                out[rows, 0] = lead | (v >> (6 * (k - 1)))
                for j in range(1, k):
                    out[rows, j] = 0x80 | ((v >> (6 * (k - 1 - j))) & 0x3F)
    return out, length


def _lpc(samples: np.ndarray, order: int, precision: int = 12, shift: int = 9) -> np.ndarray:
    """Quantised predictor coefficients of each frame, from its autocorrelation."""
    x = samples.astype(np.float64)
    r = np.stack([(x[:, : BLOCK - k] * x[:, k:]).sum(1) for k in range(order + 1)], 1)
    lag = np.abs(np.arange(order)[:, None] - np.arange(order)[None])
    a = r[:, lag] + np.eye(order) * (r[:, :1, None] * 1e-9 + 1e-9)
    c = np.linalg.solve(a, r[:, 1:, None])[:, :, 0]
    return np.clip(np.rint(c * (1 << shift)), -(1 << (precision - 1)), (1 << (precision - 1)) - 1).astype(np.int64)


def encode_frames(samples: np.ndarray, numbers: np.ndarray, lpc_order: int = 0) -> list[bytes]:
    """Frames of 576 samples of 8 bits, each coded by the cheapest of constant, verbatim, fixed and linear prediction."""
    f = len(samples)
    precision, shift = 12, 9
    x = samples.astype(np.int32)
    kinds = [("fixed", o) for o in range(3)] + ([("lpc", lpc_order)] if lpc_order else [])
    coefficients = _lpc(x, lpc_order, precision, shift) if lpc_order else None
    best = np.full(f, 8 * BLOCK, np.int64)
    kind, param = np.full(f, -1), np.zeros(f, np.int64)
    zig = np.zeros((f, BLOCK), np.int32)
    for i, (name, order) in enumerate(kinds):
        if name == "fixed":
            res = np.diff(x, n=order, axis=1)
        else:
            pred = sum(coefficients[:, j : j + 1] * x[:, order - 1 - j : BLOCK - 1 - j] for j in range(order)) >> shift
            res = (x[:, order:] - pred).astype(np.int32)
        u = (res << 1) ^ (res >> 31)
        mean = np.maximum(u.mean(1), 1)
        middle = np.clip(np.floor(np.log2(mean)).astype(np.int64), 1, 13)
        for d in (-1, 0, 1):
            k = middle + d
            head = 8 * order + 10 + (9 + precision * order if name == "lpc" else 0)
            cost = (u >> k[:, None]).sum(1) + (BLOCK - order) * (k + 1) + head
            better = cost < best
            best[better], kind[better], param[better] = cost[better], i, k[better]
            zig[better, order:] = u[better]
    constant = (x == x[:, :1]).all(1)
    kind[constant], best[constant] = -2, 8
    number, n_len = _number_bytes(numbers)
    head_len = 4 + n_len + 1  # with the CRC-8
    body = (best + 8 + 7) // 8  # sub-frame header of 8 bits
    starts = np.concatenate([[0], np.cumsum(head_len + body + 2)])
    out = np.zeros(starts[-1], np.uint8)
    at = starts[:-1]
    for j, v in enumerate((SYNC >> 8, SYNC & 0xFF, SIZE_576 << 4, BITS_8 << 1)):
        out[at + j] = v
    for j in range(7):
        rows = n_len > j
        out[at[rows] + 4 + j] = number[rows, j]
    out[at + head_len - 1] = _crc(out, at, at + head_len - 1, 8)
    first = at + head_len
    rows = np.flatnonzero(kind == -2)
    out[first[rows] + 1] = x[rows, 0].astype(np.int8).view(np.uint8)
    rows = np.flatnonzero(kind == -1)
    out[first[rows]] = 1 << 1
    out[(first[rows, None] + 1 + np.arange(BLOCK)).ravel()] = x[rows].astype(np.int8).view(np.uint8).ravel()
    coded = np.flatnonzero(kind >= 0)
    if len(coded):
        # one bit a byte for the coded frames only, packed at the end
        size = 8 * body[coded]
        bit0 = np.concatenate([[0], np.cumsum(size)])
        bits = np.zeros(bit0[-1], np.uint8)

        def put(where: np.ndarray, value: np.ndarray, width: int) -> None:
            for j in range(width):
                bits[where + j] = (value >> (width - 1 - j)) & 1

        for i, (name, order) in enumerate(kinds):
            mine = np.flatnonzero(kind[coded] == i)
            if not len(mine):
                continue
            frames, pos = coded[mine], bit0[:-1][mine]
            ones = np.ones(len(mine), np.int64)
            put(pos, ones * ((8 + order if name == "fixed" else 32 + order - 1) << 1), 8)
            pos = pos + 8
            for j in range(order):
                put(pos, x[frames, j] & 0xFF, 8)
                pos = pos + 8
            if name == "lpc":
                put(pos, ones * (precision - 1), 4)
                put(pos + 4, ones * shift, 5)
                pos = pos + 9
                for j in range(order):
                    put(pos, coefficients[frames, j] & ((1 << precision) - 1), precision)
                    pos = pos + precision
            put(pos, ones * 0, 6)
            put(pos + 6, param[frames], 4)
            pos = pos + 10
            u, k = zig[frames, order:], param[frames]
            ends = pos[:, None] + np.cumsum((u >> k[:, None]) + 1 + k[:, None], axis=1)
            for value in np.unique(k):
                rows = k == value
                e, low = ends[rows].ravel(), u[rows].ravel()
                bits[e - 1 - value] = 1
                for j in range(value):
                    bits[e - 1 - j] = (low >> j) & 1
        packed = np.packbits(bits)
        byte0 = bit0 // 8
        target = np.repeat(first[coded] - byte0[:-1], body[coded]) + np.arange(byte0[-1])
        out[target] = packed
    end = starts[1:] - 2
    crc = _crc(out, at, end, 16)
    out[end], out[end + 1] = crc >> 8, crc & 0xFF
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def _stream(frames: list[bytes], payload_md5: bytes, samples: int, rate: int = 8000) -> bytes:
    """Marker, STREAMINFO, a seek table with each frame, frames."""
    sizes = [len(x) for x in frames]
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += ((rate << 44) | (0 << 41) | (7 << 36) | samples).to_bytes(8, "big") + payload_md5
    # a metadata block holds under 2^24 bytes; longer streams have several tables' worth of points in as many blocks
    points = np.zeros(len(frames), [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
    points["sample"], points["n"] = np.arange(len(frames), dtype=np.uint64) * BLOCK, BLOCK
    points["offset"] = np.concatenate([[0], np.cumsum(sizes[:-1])]).astype(np.uint64)
    raw, most = points.tobytes(), 18 * 900_000
    tables = [raw[i : i + most] for i in range(0, len(raw), most)]
    out = [b"fLaC", b"\0" + len(info).to_bytes(3, "big"), info]
    for i, t in enumerate(tables):
        out += [bytes([3 | (0x80 if i == len(tables) - 1 else 0)]) + len(t).to_bytes(3, "big"), t]
    return b"".join(out + frames)


def encode_payloads(payloads: list[bytes], lpc_order: int = 0) -> list[bytes]:
    """A FLAC stream for each payload, whose length is a positive multiple of 576; byte b is the sample b - 128."""
    frames: list[list[bytes]] = [[] for _ in payloads]
    part, size = [], 0

    def flush() -> None:
        nonlocal part, size
        if part:
            data = np.frombuffer(b"".join(p for _, _, p in part), np.uint8).reshape(-1, BLOCK).astype(np.int16) - 128
            counts = [len(p) // BLOCK for _, _, p in part]
            numbers = np.concatenate([np.arange(a, a + n) for (_, a, _), n in zip(part, counts)])
            made = iter(encode_frames(data, numbers, lpc_order))
            for (i, _, _), n in zip(part, counts):
                frames[i] += [next(made) for _ in range(n)]
        part, size = [], 0

    step = CHUNK // BLOCK * BLOCK
    for i, payload in enumerate(payloads):
        if not payload or len(payload) % BLOCK:
            raise ValueError("a payload is a positive multiple of 576 bytes")
        for a in range(0, len(payload), step):
            piece = payload[a : a + step]
            part.append((i, a // BLOCK, piece))
            size += len(piece)
            if size >= CHUNK:
                flush()
    flush()
    flip = bytes(b ^ 0x80 for b in range(256))
    return [_stream(f, hashlib.md5(p.translate(flip)).digest(), len(p)) for f, p in zip(frames, payloads)]


class Header:
    """Metadata of a stream."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("no FLAC stream")
        at, last, self.points, self.samples = 4, False, [], None
        while not last:
            if at + 4 > len(data):
                raise ValueError("FLAC metadata is cut off")
            last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            body, at = data[at + 4 : at + 4 + size], at + 4 + size
            if kind == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.block, self.rate = struct.unpack(">H", body[2:4])[0], packed >> 44
                self.channels, self.bits = (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1
                self.samples, self.md5 = packed & ((1 << 36) - 1), body[18:34]
            elif kind == 3:
                made = np.frombuffer(body[: size // 18 * 18], [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
                self.points += [(int(s), int(o), int(n)) for s, o, n in made.tolist() if s != 2**64 - 1]
        if self.samples is None:
            raise ValueError("FLAC stream without STREAMINFO")
        if self.channels != 1:
            raise ValueError("only mono streams are read")
        self.start = at

    def complete(self) -> bool:
        """Whether the seek table lists every frame."""
        end = 0
        for sample, _, n in self.points:
            if sample != end:
                return False
            end = sample + n
        return bool(self.points) and end == self.samples


class _Bits:
    """The bits of a buffer: values at any place, and the number of zeros before the next 1."""

    def __init__(self, data: np.ndarray):
        self.n = 8 * len(data)
        padded = np.concatenate([data, np.zeros(4096, np.uint8)])
        self.last = len(padded) - 8
        # the 64 bits from each byte on
        self.words = np.ndarray(self.last, ">u8", padded, strides=(1,)).astype(np.uint64)

    def _from(self, at: np.ndarray) -> np.ndarray:
        return self.words[np.minimum(at >> 3, self.last - 1)] << (at & 7).astype(np.uint64)

    def value(self, at: np.ndarray, width) -> np.ndarray:
        """Unsigned, up to 32 bits wide."""
        width = np.asarray(width, np.uint64)
        # two shifts, as a width of 0 would shift by 64
        return (self._from(at) >> np.uint64(1) >> (np.uint64(63) - width)).astype(np.int64)

    def signed(self, at: np.ndarray, width) -> np.ndarray:
        v = self.value(at, width)
        return v - ((v >> (width - 1) & 1) << width)

    def zeros(self, at: np.ndarray) -> np.ndarray:
        """Zeros from each place to the next 1."""
        v = self.words[at >> 3] << (at & 7).astype(np.uint64)
        v &= ~(v >> np.uint64(1))  # so that rounding keeps the exponent
        out = 1086 - (v.astype(np.float64).view(np.int64) >> 52)
        if len(out) and out.max() > 56:
            for i in np.flatnonzero(out > 56):
                n = 56 - int(at[i] & 7)  # whole bytes, then on from there
                while int(at[i]) + n < self.n and not self.words[(int(at[i]) + n) >> 3]:
                    n += 64
                here = int(at[i]) + n
                out[i] = n + (64 - int(self.words[min(here >> 3, self.last - 1)]).bit_length())
        return out


def decode_frames(data: np.ndarray, starts: np.ndarray, stream_bits: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples of the frames that start at ``starts``, and where each ends. Verifies both checksums of each frame."""
    bits = _Bits(data)
    starts = starts.astype(np.int64)
    if ((bits.value(starts * 8, 16) & 0xFFFE) != SYNC).any():
        raise ValueError("no frame where one should start")
    size_code, rate_code = data[starts + 2] >> 4, data[starts + 2] & 15
    channel, bits_code = data[starts + 3] >> 4, data[starts + 3] >> 1 & 7
    if channel.any():
        raise ValueError("only mono frames are read")
    lead = data[starts + 4]
    n_len = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    at = starts + 4 + n_len
    extra = np.select([size_code == 6, size_code == 7], [1, 2], 0)
    rate_extra = np.select([rate_code == 12, rate_code == 13, rate_code == 14], [1, 2, 2], 0)
    block = np.select([size_code == 1, (size_code >= 2) & (size_code <= 5), size_code == 6, size_code == 7],
                      [192, 576 << np.maximum(size_code.astype(np.int64) - 2, 0), data[np.minimum(at, len(data) - 1)].astype(np.int64) + 1,
                       bits.value(at * 8, 16) + 1], 256 << np.maximum(size_code.astype(np.int64) - 8, 0))
    width = stream_bits.astype(np.int64).copy()
    for code, value in SAMPLE_BITS.items():
        width[bits_code == code] = value
    at = at + extra + rate_extra
    if (data[at] != _crc(data, starts, at, 8)).any():
        raise ValueError("a frame header's checksum differs")
    pos = (at + 1) * 8
    head = bits.value(pos, 8)
    if (head & 0x81).any():
        raise ValueError("sub-frames with wasted bits are not read")
    kind, pos = head >> 1, pos + 8
    out: list[np.ndarray] = [np.empty(0)] * len(starts)
    ends = np.zeros(len(starts), np.int64)
    for n in np.unique(block):
        for k in np.unique(kind[block == n]):
            rows = np.flatnonzero((kind == k) & (block == n))
            made, ends[rows] = _subframes(bits, pos[rows], int(k), int(n), width[rows])
            for i, x in zip(rows.tolist(), made):
                out[i] = x
    ends = (ends + 7) // 8
    if (ends + 2 > len(data)).any() or (((data[ends].astype(np.int64) << 8) | data[ends + 1]) != _crc(data, starts, ends, 16)).any():
        raise ValueError("a frame's checksum differs")
    return out, ends + 2


def _subframes(bits: _Bits, pos: np.ndarray, kind: int, n: int, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of sub-frames of one kind and size, and the bit after each."""
    f = len(pos)
    if kind == 0:
        return np.repeat(bits.signed(pos, width)[:, None], n, 1), pos + width
    if kind == 1:
        return bits.signed(pos[:, None] + np.arange(n) * width[:, None], width[:, None]), pos + n * width
    if 8 <= kind <= 12:
        order, linear = kind - 8, False
    elif kind >= 32:
        order, linear = kind - 31, True
    else:
        raise ValueError("reserved kind of sub-frame")
    x = np.zeros((f, n), np.int64)
    for j in range(order):
        x[:, j] = bits.signed(pos, width)
        pos = pos + width
    if linear:
        precision = bits.value(pos, 4) + 1
        shift, pos = bits.signed(pos + 4, 5), pos + 9
        c = np.zeros((f, order), np.int64)
        for j in range(order):
            c[:, j] = bits.signed(pos, precision)
            pos = pos + precision
    res, pos = _rice(bits, pos, n, order)
    if linear:
        for i in range(order, n):
            x[:, i] = res[:, i - order] + ((c * x[:, i - order : i][:, ::-1]).sum(1) >> shift)
    else:
        # the differences of the warm-up samples start the sums that undo the differences
        lead, diffs = [], x[:, :order]
        for _ in range(order):
            lead.append(diffs[:, -1:])
            diffs = np.diff(diffs, axis=1)
        for d in reversed(lead):
            res = d + np.cumsum(res, axis=1)
        x[:, order:] = res
    return x, pos


def _rice(bits: _Bits, pos: np.ndarray, n: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of all frames, followed in step."""
    method, split = bits.value(pos, 2), bits.value(pos + 2, 4)
    if (method > 1).any():
        raise ValueError("reserved residual coding")
    pos, wide = pos + 6, np.where(method == 1, 5, 4)
    f, lanes = len(pos), np.arange(len(pos))
    start, zeros = np.zeros((n - order, f), np.int64), np.zeros((n - order, f), np.int64)
    ks = np.zeros((n - order, f), np.int64)
    k, raw = np.zeros(f, np.int64), np.full(f, -1)  # raw: bits of residuals stored as they are, else -1
    plain: dict[int, np.ndarray] = {}
    cut = n >> split  # samples of a partition
    any_split, any_raw = bool(split.any()), False
    for i in range(order, n):
        j = i - order
        new = lanes if not j else lanes[i % cut == 0] if any_split else lanes[:0]
        if len(new):
            k[new] = bits.value(pos[new], wide[new])
            pos[new] += wide[new]
            none = k[new] == (1 << wide[new]) - 1
            raw[new] = -1
            esc = new[none]
            raw[esc] = bits.value(pos[esc], 5)
            pos[esc] += 5
            any_raw = bool((raw >= 0).any())
        start[j], ks[j] = pos, k
        if any_raw:
            plain[j] = raw.copy()
            zeros[j] = np.where(raw < 0, bits.zeros(pos), 0)
            pos = np.where(raw < 0, pos + zeros[j] + 1 + k, pos + raw)
        else:
            zeros[j] = bits.zeros(pos)
            pos = pos + zeros[j] + k + 1
        if (pos > bits.n).any():
            raise ValueError("a frame is cut off")
    u = (zeros << ks) | bits.value(start + zeros + 1, ks)
    out = (u >> 1) ^ -(u & 1)
    for j, w in plain.items():
        rows = w >= 0
        out[j, rows] = np.where(w[rows] > 0, bits.signed(start[j, rows], np.maximum(w[rows], 1)), 0)
    return out.T, pos


def decode_streams(streams: list[bytes]) -> list[np.ndarray]:
    """Samples of each stream as signed integers, checked against the frames' checksums and the stream's MD5."""
    out: list[list[np.ndarray]] = [[] for _ in streams]
    heads = [Header(s) for s in streams]
    part, size = [], 0

    def flush() -> None:
        nonlocal part, size
        if part:
            base = np.cumsum([0] + [len(p[1]) for p in part])
            data = np.frombuffer(b"".join(p[1] for p in part), np.uint8)
            starts = np.concatenate([np.array(p[2], np.int64) + b for p, b in zip(part, base)])
            width = np.concatenate([np.full(len(p[2]), heads[p[0]].bits) for p in part])
            made = iter(decode_frames(data, starts, width)[0])
            for i, _, offsets in part:
                out[i] += [next(made) for _ in offsets]
        part, size = [], 0

    for i, (s, h) in enumerate(zip(streams, heads)):
        if h.complete():
            offsets = [h.start + o for _, o, _ in h.points] + [len(s)]
            a = 0
            while a < len(offsets) - 1:  # runs of frames of about a chunk
                b = a + 1
                while b < len(offsets) - 1 and offsets[b + 1] - offsets[a] <= CHUNK:
                    b += 1
                part.append((i, s[offsets[a] : offsets[b]], [o - offsets[a] for o in offsets[a:b]]))
                size += offsets[b] - offsets[a]
                if size >= CHUNK:
                    flush()
                a = b
        else:
            at, got = h.start, 0
            most = 64 + 2 * h.block * ((h.bits + 7) // 8 + 1)
            while at < len(s) and (not h.samples or got < h.samples):
                window = np.frombuffer(s[at : at + most], np.uint8)
                made, ends = decode_frames(window, np.zeros(1, np.int64), np.array([h.bits]))
                out[i].append(made[0])
                got, at = got + len(made[0]), at + int(ends[0])
    flush()
    result = []
    for frames, h in zip(out, heads):
        x = np.concatenate(frames) if frames else np.empty(0, np.int64)
        size = (h.bits + 7) // 8
        raw = x.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :size].tobytes()
        if len(x) != h.samples or (h.md5 != bytes(16) and hashlib.md5(raw).digest() != h.md5):
            raise ValueError("the decoded samples differ from the stream's digest")
        result.append(x)
    return result


def _out_schema(df: DataFrame, extra: list[tuple[str, str]]) -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join(fields + [f"`{n}` {t}" for n, t in extra])


def encode(df: DataFrame, payload: str, media: str = "media", lpc_order: int = 0) -> DataFrame:
    """Add ``media``: the binary column ``payload`` as a FLAC stream of 8-bit samples, padded by bytes 255 to whole frames.

    Null counts as empty and an empty payload gets one frame of padding. Equal payloads give equal streams. ``media`` gets
    underscores where the name is taken.
    """
    media = free_name(df.columns, media)
    at = df.columns.index(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, payload, CHUNK):
            padded = [pad(x or b"") for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(encode_payloads(padded, lpc_order), pa.binary())],
                                             names=[*b.schema.names, media])

    return df.mapInArrow(run, _out_schema(df, [(media, "binary")]))


def pad(data: bytes) -> bytes:
    short = -len(data) % BLOCK
    return data + b"\xff" * (short if data else BLOCK)


def decode(df: DataFrame, media: str = "media", blocks: str = "pcm_blocks") -> DataFrame:
    """Add ``blocks``: the samples of the mono FLAC stream ``media`` as an array of (sample_offset, pcm) in order.

    PCM is little-endian and signed, in 8-bit samples where the stream has up to 8 bits, else 16, 24 or 32. Each block but
    the last has 36,864 samples, so the block of any sample is known from its number. Null media: null. A stream whose
    checksums or digest differ fails the task.
    """
    blocks = free_name(df.columns, blocks)
    names = list(df.columns)
    kind = pa.list_(pa.struct([("sample_offset", pa.int64()), ("pcm", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, media, CHUNK):
            streams = b.column(names.index(media)).to_pylist()
            known = [i for i, s in enumerate(streams) if s is not None]
            out: list = [None] * len(streams)
            for i, x in zip(known, decode_streams([streams[i] for i in known])):
                size = (Header(streams[i]).bits + 7) // 8
                raw = x.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :size].tobytes()
                step = PCM_BLOCK * size
                out[i] = [{"sample_offset": a // size, "pcm": raw[a : a + step]} for a in range(0, len(raw), step)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], names=[*b.schema.names, blocks])

    return df.mapInArrow(run, _out_schema(df, [(blocks, "array<struct<sample_offset:bigint,pcm:binary>>")]))


def features(x: np.ndarray) -> str:
    """Mean square, peak and sign changes of samples, from integers."""
    if not len(x):
        return "ms=0;peak=0;zc=0"
    return f"ms={int((x * x).sum()) // len(x)};peak={int(np.abs(x).max())};zc={int((np.diff(x < 0) != 0).sum())}"


def op10_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text through a FLAC stream and back; digests are made from what was decoded."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "encode(coalesce(text, ''), 'UTF-8') AS payload")
    sized = docs.selectExpr("doc_id", "payload", "cast(octet_length(payload) AS bigint) AS n_bytes")
    stored = encode(sized, "payload", lpc_order=LPC_ORDER).select("doc_id", "n_bytes", "media")
    back = decode(stored)
    flip = bytes(b ^ 0x80 for b in range(256))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for media, blocks in zip(b.column("media").to_pylist(), b.column("pcm_blocks").to_pylist()):
                payload = b"".join(x["pcm"] for x in blocks).translate(flip)
                x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media),
                             hashlib.sha256(media).hexdigest(), features(x)))
            made = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *made], names=[
                    "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return back.mapInArrow(digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
                                   "media_bytes long, media_sha256 string, feature string")


QUERIES = {"op10_flac_media": op10_flac_media}
