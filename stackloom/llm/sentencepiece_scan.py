"""SentencePiece encoding as a max-plus scan, and decoding.

A text is a lattice of vocabulary pieces; the encoding is its best path, where a path's weight is the sum of its pieces'
scores and neighbouring pieces must be compatible. For a unigram model all neighbours are. For a BPE model a and b are
compatible if merging the characters of ab by score gives a, b again; a sequence whose neighbours are all
compatible is the BPE encoding of its text, so exactly one path has a weight above minus infinity, and the same scan serves both.

Pieces hold U+2581 (a space) at their start only, or nothing else, and no piece holds a character outside the
vocabulary (those become bytes). So paths never cross from a word to the space after it, or a newline, nor between any
two ASCII characters that stand next to each other in no piece: texts fall into segments, distinct segments are encoded once, and ids are gathered by array operations.

Giant texts are cut into chunks that become rows of their own, between segments where a chunk has one, else
anywhere. The state at a cut is the piece that starts before it and ends at or after it. Each chunk gives a matrix:
the best weight from every state at its left cut to every state at its right cut (1 x 1 between segments). Max-plus products of these
matrices, from left to right and back, give the states of the whole text's best path at all cuts; then every chunk traces
its part on its own. What comes together for a text are its small matrices and its ids, never its characters.
"""

from __future__ import annotations

import functools
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm.common import SLICE_BYTES, _give_back, free_name, table, text_slices
from stackloom.llm.int_map import IntMap
from stackloom.llm.words import raw_text

SPACE = "▁"
#: Characters of a chunk, and those from which on a text is cut into chunks.
CHUNK_CHARS = 1 << 14
GIANT_CHARS = 1 << 16
#: Segments a worker keeps the ids of, and compatible pairs; a full store is emptied, which costs time only.
CACHE_SEGMENTS, CACHE_PAIRS = 300_000, 400_000
UNKNOWN, START = -2, -1
NONE = -np.inf
MODEL = "piece_bpe_32k.model"


class Vocabulary:
    """Pieces, scores and rules of a model file."""

    def __init__(self, path: str, proto: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2

        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        model = sentencepiece_model_pb2.ModelProto.FromString(proto)
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("models that normalise text are not supported")
        self.bpe = model.trainer_spec.model_type == 2
        if not self.bpe and model.trainer_spec.model_type != 1:
            raise ValueError("only unigram and BPE models are supported")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.scores = [p.score for p in model.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        if len(self.bytes) != 256:
            raise ValueError("models without byte fallback are not supported")
        self.normal = [p.piece for p in model.pieces]
        normal = list(self.ids)
        if any(SPACE in p.lstrip(SPACE) for p in normal) or any("\n" in p for p in normal):
            raise ValueError("pieces that go on after a space or newline are not supported")
        self.longest = max(map(len, normal))
        self.tails = {p[i:] for p in normal for i in range(len(p))}
        self.unknown_score = min(self.scores[i] for i in self.ids.values()) - 10
        self.pairs: dict[tuple[int, int], bool] = {}
        if self.bpe:
            # order in which pieces are merged, and the two parts that each is merged from, where scores tell pieces apart
            of_score = Counter(self.scores[i] for i in self.ids.values())
            self.rank = {p: -self.scores[i] for p, i in self.ids.items()}
            self.made_of = {p: () if len(p) == 1 else self._parts(p) for p, i in self.ids.items() if len(p) == 1 or of_score[self.scores[i]] == 1}
            while odd := [p for p, parts in self.made_of.items() if any(x not in self.made_of or len(x) > 1 and self.rank[x] >= self.rank[p] for x in parts)
                          or len(p) > 1 and len(parts) != 2]:
                for p in odd:
                    del self.made_of[p]
            self._reverse_trie(normal)
            self._pair_fits = IntMap(np.empty(0, np.int64), np.empty(0, np.int64))
        # neighbours that occur in no piece part a text, too
        self.parted = np.ones((256, 256), bool)
        self.parted[128:], self.parted[:, 128:] = False, False
        for p in normal:
            raw = p.replace(SPACE, " ").encode()
            self.parted[list(raw[:-1]), list(raw[1:])] = False
        self.parted[:, [10, 32]], self.parted[10] = True, True
        self.parted[32, :] = False  # spaces stay with what follows
        self._known, self._flat, self._ends = pa.array([], pa.binary()), np.empty(0, np.int32), np.zeros(1, np.int64)

    def _parts(self, piece: str) -> tuple[str, ...]:
        """The two parts that are merged last into ``piece``; nothing if its characters don't merge into it."""
        parts = list(piece)
        while len(parts) > 2:
            found = [(-self.scores[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                return ()
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return tuple(parts)

    def merged(self, text: str) -> list[str]:
        """Characters merged by the score of what they make, the leftmost of equal ones first."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.scores[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging the characters of pieces a, b leaves them apart.

        The last piece of what a is made of and the first of what b is made of stand next to each other until one of them
        is merged into a larger part. From the end backwards, the later of the two steps that made both is undone; had
        the two merged before the step undone last, a and b would not be there. Of equal steps the left one comes first.
        """
        x, y, until = self.normal[a], self.normal[b], None
        while True:
            joint = self.rank.get(x + y)
            if joint is not None and (until is None or joint < until):
                return False
            rx, ry = self.rank[x] if len(x) > 1 else -1, self.rank[y] if len(y) > 1 else -1
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                x, until = self.made_of[x][1], rx
            else:
                y, until = self.made_of[y][0], ry + 0.5

    def _judge(self, a: int, b: int) -> bool:
        if b == UNKNOWN:
            return True
        if a < 0:
            return self.merged(self.normal[b]) == [self.normal[b]]
        if self.normal[a] in self.made_of and self.normal[b] in self.made_of:
            return self._apart(a, b)
        # pieces of equal scores: by doing it
        return self.merged(self.normal[a] + self.normal[b]) == [self.normal[a], self.normal[b]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a (START: nothing stands before)."""
        if not self.bpe:
            return True
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS // 8:
                self.pairs.clear()
            known = self.pairs[a, b] = self._judge(a, b)
        return known

    def ending(self, text: str, end: int, least: int = 0) -> Iterator[tuple[int, int, float]]:
        """(start, piece, score) of the lattice's pieces that end at ``end`` and start at ``least`` or after."""
        single = False
        for start in range(end - 1, max(least, end - self.longest) - 1, -1):
            part = text[start:end]
            if part not in self.tails:
                break
            i = self.ids.get(part)
            if i is not None:
                single |= start == end - 1
                yield start, i, self.scores[i]
        if not single and end - 1 >= least:
            yield end - 1, UNKNOWN, self.unknown_score

    def path(self, text: str, first: int = 0, state: int = START, last: int | None = None, final: int | None = None) -> list[int]:
        """Best path from ``first``, after the piece ``state``, to ``last`` with ``final`` as its last piece (None: any)."""
        last = len(text) if last is None else last
        # a unigram path depends on the place only; for BPE one piece may end at a place
        best: list[dict[int, tuple[float, int, int, int]]] = [{} for _ in range(last - first + 1)]
        best[0] = {state: (0.0, -1, 0, 0)}
        for end in range(first + 1, last + 1):
            here = best[end - first]
            for start, piece, score in self.ending(text, end, first):
                for before, node in best[start - first].items():
                    if self.compatible(before, piece):
                        key, weight = piece if self.bpe else 0, node[0] + score
                        if key not in here or weight > here[key][0]:
                            here[key] = (weight, start, before, piece)
        ends = best[last - first]
        key = (final if self.bpe else 0) if final is not None else next(iter(ends))
        if first == last:
            return []
        out, end = [], last
        while end > first:
            _, start, before, piece = best[end - first][key]
            out.append((piece, start, end))
            end, key = start, before if self.bpe else (0 if start > first else next(iter(best[0])))
        ids: list[int] = []
        for piece, start, end in reversed(out):
            ids += [self.bytes[x] for x in text[start:end].encode("utf-8", "replace")] if piece == UNKNOWN else [piece]
        return ids

    def _bpe_path(self, text: str) -> list[int]:
        """As ``path`` for a whole text: one piece may end at a place, so the first one found is it."""
        ids, tails, pairs, longest = self.ids, self.tails, self.pairs, self.longest
        pieces, begins = [START], [0]
        for end in range(1, len(text) + 1):
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                part = text[start:end]
                if part not in tails:
                    break
                piece = ids.get(part)
                if piece is not None:
                    fits = pairs.get((pieces[start], piece))
                    if fits if fits is not None else self.compatible(pieces[start], piece):
                        pieces.append(piece)
                        begins.append(start)
                        break
            if len(pieces) == end:
                pieces.append(UNKNOWN)
                begins.append(end - 1)
        out, end = [], len(text)
        while end:
            start = begins[end]
            if pieces[end] == UNKNOWN:
                out += [self.bytes[x] for x in reversed(text[start:end].encode("utf-8", "replace"))]
            else:
                out.append(pieces[end])
            end = start
        return out[::-1]

    def _reverse_trie(self, normal: list[str]) -> None:
        """The trie of the pieces read backwards: children by node and character, and pieces of nodes."""
        chars = {c: i for i, c in enumerate(sorted(set("".join(normal))), 1)}
        self.known_chars = set(chars)
        self.char_index = np.zeros(0x110000, np.int32)
        for c, i in chars.items():
            self.char_index[ord(c)] = i
        self.width = len(chars) + 1
        children: dict[int, int] = {}
        piece_of = [-1]
        for p, i in self.ids.items():
            node = 0
            for c in reversed(p):
                key = node * self.width + chars[c]
                after = children.get(key)
                if after is None:
                    after = children[key] = len(piece_of)
                    piece_of.append(-1)
                node = after
            piece_of[node] = i
        self.trie = IntMap(np.fromiter(children, np.int64, len(children)), np.fromiter(children.values(), np.int64, len(children)))
        self.trie_piece = np.array(piece_of, np.int64)

    def _fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """``compatible`` for many pairs."""
        n = len(self.normal)
        keys = (before + 2) * n + piece
        found = self._pair_fits.get(keys)
        missing = found < 0
        if missing.any():
            new, where = np.unique(keys[missing], return_inverse=True)
            fits = np.array([self._judge(k // n - 2, k % n) for k in new.tolist()], np.int64)
            if self._pair_fits.n + len(new) > CACHE_PAIRS:
                self._pair_fits.clear()
            self._pair_fits.add(new, fits)
            found[missing] = fits[where]
        return found > 0

    def _bpe_many(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of many segments: the lattice's arcs by array operations, then all segments in step."""
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        char = self.char_index[np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        offset = np.concatenate([[0], np.cumsum(size)])
        owner = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(char)) - offset[owner]
        ends, starts, pieces = [], [], []
        at, node, back = np.arange(len(char)), np.zeros(len(char), np.int64), 0
        while len(at):
            node = self.trie.get(node * self.width + char[at - back])
            at, node = at[node >= 0], node[node >= 0]
            piece = self.trie_piece[node]
            full = piece >= 0
            ends.append(at[full])
            starts.append(at[full] - back)
            pieces.append(piece[full])
            more = place[at] > back
            at, node, back = at[more], node[more], back + 1
        end, start, piece = np.concatenate(ends), np.concatenate(starts), np.concatenate(pieces)
        order = np.argsort(place[end], kind="stable")
        end, start, piece = end[order], start[order], piece[order]
        step = np.searchsorted(place[end], np.arange(int(size.max()) + 1))
        # state k of a segment: the piece that ends at its k-th character; segments have one state more than characters
        shift = owner + 1
        last, begin = np.full(len(char) + len(size), START, np.int64), np.zeros(len(char) + len(size), np.int64)
        for k in range(int(size.max())):
            e, b, i = end[step[k] : step[k + 1]], start[step[k] : step[k + 1]], piece[step[k] : step[k + 1]]
            source = b + shift[b] - 1
            fits = self._fits(last[source], i)
            target = (e + shift[e])[fits]
            last[target], begin[target] = i[fits], source[fits]
        state = offset[1:] + np.arange(len(size))
        first = offset[:-1] + np.arange(len(size))
        rows, made, row = [], [], np.arange(len(size))
        while len(row):
            open_ = state > first[row]
            row, state = row[open_], state[open_]
            rows.append(row)
            made.append(last[state])
            state = begin[state]
        row, piece = np.concatenate(rows[::-1]), np.concatenate(made[::-1])
        order = np.argsort(row, kind="stable")
        return piece[order].astype(np.int32), np.bincount(row, minlength=len(size))

    def states(self, around: str, cut: int) -> list[tuple[int, int]]:
        """States at a cut: (end after the cut, piece) of lattice pieces that start before it and end there or after."""
        out = []
        for end in range(cut, min(len(around), cut + self.longest - 1) + 1):
            out += [(end - cut, piece if self.bpe else 0) for start, piece, _ in self.ending(around, end) if start < cut]
        return sorted(set(out))

    def transfer(self, left: str, body: str, right: str, open_left: bool, open_right: bool) -> np.ndarray:
        """Best weights from the states at the left cut of ``body`` to those at its right cut."""
        text, a, b = left + body + right, len(left), len(left) + len(body)
        ins = self.states(text, a) if open_left else [(0, START)]
        outs = self.states(text, b) if open_right else [(0, None)]
        nodes: list[dict[int, np.ndarray]] = [{} for _ in range(len(text) - a + 1)]
        for i, (end, piece) in enumerate(ins):
            vector = np.full(len(ins), NONE)
            vector[i] = 0.0
            nodes[end][piece] = vector
        for end in range(a + 1, len(text) + 1):
            for start, piece, score in self.ending(text, end, a):
                if start >= b:
                    continue
                vectors = [v for before, v in nodes[start - a].items() if self.compatible(before, piece)]
                if vectors:
                    key = piece if self.bpe else 0
                    made = np.maximum.reduce(vectors) + score
                    here = nodes[end - a].get(key)
                    nodes[end - a][key] = made if here is None else np.maximum(here, made)
        matrix = np.full((len(ins), len(outs)), NONE)
        for j, (end, piece) in enumerate(outs):
            here = nodes[b + end - a]
            vectors = list(here.values()) if piece is None else [here[piece]] if piece in here else []
            if vectors:
                matrix[:, j] = np.maximum.reduce(vectors)
        return matrix

    def segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments, number of ids of each)"""
        segments = [x.replace(" ", SPACE) for x in segments]
        if not self.bpe:
            made = [self.path(x) for x in segments]
            return np.array([i for x in made for i in x], np.int32), np.array([len(x) for x in made], np.int64)
        # characters outside the vocabulary, and very long segments, go one by one
        alone = {k for k, x in enumerate(segments) if len(x) > 64 or not all(map(self.known_chars.__contains__, x))}
        flat, count = np.empty(0, np.int32), np.zeros(len(segments), np.int64)
        many = [k for k in range(len(segments)) if k not in alone]
        parts = []
        for a in range(0, len(many), 1 << 14):  # the lattices of many segments are large
            ids, count[many[a : a + (1 << 14)]] = self._bpe_many([segments[k] for k in many[a : a + (1 << 14)]])
            parts.append(ids)
        if parts:
            flat = np.concatenate(parts)
        if alone:
            ends = np.cumsum(count)
            made = {k: self._bpe_path(segments[k]) for k in sorted(alone)}
            flat = np.insert(flat, np.repeat(ends[list(made)], [len(x) for x in made.values()]), [i for x in made.values() for i in x])
            for k, x in made.items():
                count[k] = len(x)
        return flat, count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the number of ids)"""
        at, data = raw_text(texts)
        return self.encode_raw(at, data, np.ones(len(at) - 1, bool))

    def encode_raw(self, at: np.ndarray, data: bytes, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, for UTF-8 text; ``prefix``: whether a text gets the space that the model puts before texts."""
        texts = [data[a:b].replace(SPACE.encode(), b" ") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        joined = b"".join(b" " + t if p and t else t for t, p in zip(texts, prefix.tolist()))
        size = np.array([len(t) + (1 if p and t else 0) for t, p in zip(texts, prefix.tolist())], np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        raw = np.frombuffer(joined, np.uint8)
        if not len(raw):
            return np.empty(0, np.int32), np.zeros(len(at), np.int64)
        first = np.ones(len(raw), bool)  # where segments start: texts, and places that no piece crosses
        first[1:] = self.parted[raw[:-1], raw[1:]]
        first[ends[:-1][size > 0]] = True
        starts = np.flatnonzero(first).astype(np.int32)
        cut = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, np.int32(len(raw))).tobytes()), pa.py_buffer(joined)])
        coded = cut.dictionary_encode()
        found = pc.index_in(coded.dictionary, self._known)
        if found.null_count:
            if len(self._known) + found.null_count > CACHE_SEGMENTS:
                self._known, self._flat, self._ends = pa.array([], pa.binary()), np.empty(0, np.int32), np.zeros(1, np.int64)
                found = pa.nulls(len(coded.dictionary), pa.int32())
            missing = pc.is_null(found)
            new = coded.dictionary.filter(missing)
            flat, n = self.segments([x.decode("utf-8", "replace") for x in new.to_pylist()])
            where = found.fill_null(0).to_numpy(zero_copy_only=False).copy()
            where[missing.to_numpy(zero_copy_only=False)] = len(self._known) + np.arange(len(new))
            self._known = pa.concat_arrays([self._known, new])
            self._flat = np.concatenate([self._flat, flat])
            self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum(n)])
        else:
            where = found.to_numpy(zero_copy_only=False)
        code = where[coded.indices.to_numpy(zero_copy_only=False)]
        begin, count = self._ends[code], self._ends[code + 1] - self._ends[code]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self._flat[np.arange(total[-1]) + np.repeat(begin - total[:-1], count)]
        return ids, total[np.searchsorted(starts, ends)]


class Decoder:
    """The bytes each id stands for; all that decoding needs of a model."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            pieces = sentencepiece_model_pb2.ModelProto.FromString(f.read()).pieces
        of_id = [p.piece.replace(SPACE, " ").encode() if p.type == 1 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" for p in pieces]
        self.raw = np.frombuffer(b"".join(of_id), np.uint8)
        self.raw_ends = np.concatenate([[0], np.cumsum([len(x) for x in of_id])])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes put together, spaces back, without the space before the text."""
        count = self.raw_ends[ids + 1] - self.raw_ends[ids]
        total = np.cumsum(count)
        at = np.arange(total[-1] if len(total) else 0) + np.repeat(self.raw_ends[ids] - (total - count), count)
        text = self.raw[at].tobytes().decode("utf-8", "replace")
        return text.removeprefix(" ")


@functools.lru_cache(maxsize=4)
def decoder(path: str) -> Decoder:
    return Decoder(path)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _released(step):
    """A step that leaves no vocabulary behind: a worker takes up any step next, so in the end each of them would hold one."""

    @functools.wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            vocabulary.cache_clear()
            _give_back()

    return run


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None]).max(1)


def resolve(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """For the matrices of a text's chunks: of each chunk, the states of the best path at its left and right cut."""
    reached = [np.zeros((1, 1))]
    for m in matrices:
        reached.append(product(reached[-1], m))
    state, out = int(reached[-1][0].argmax()), []
    for m, before in zip(reversed(matrices), reversed(reached[:-1])):
        left = int((before[0] + m[:, state]).argmax())
        out.append((left, state))
        state = left
    return out[::-1]


def cut_text(text: str, chunk: int, longest: int) -> list[tuple[int, int, bool, bool]]:
    """(start, stop, open on the left, open on the right) of chunks; ``text`` has U+2581 for spaces."""
    out, a, open_left = [], 0, False
    while a < len(text):
        b = a + chunk
        if b + 2 * longest >= len(text):
            out.append((a, len(text), open_left, False))
            break
        at = max(text.rfind(SPACE, a + 1, b), text.rfind("\n", a + 1, b))
        # a run of spaces stays with the word behind it
        while at > a and text[at] == SPACE and text[at - 1] == SPACE:
            at -= 1
        closed = at >= a + 2 * longest
        if closed:
            b = at
        out.append((a, b, open_left, not closed))
        a, open_left = b, not closed
    return out


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _encode_small(df: DataFrame, text: str, ids: str, model: str) -> DataFrame:
    at = df.columns.index(text)
    names = list(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what is made of a text takes many times its bytes
        for b in text_slices(batches, text, SLICE_BYTES // 8):
            v = vocabulary(model)
            flat, starts = v.encode(b.column(at))
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*names, ids])

    return df.mapInArrow(_released(run), f"{_fields(df)}, `{ids}` array<int>")


def _encode_giant(texts: DataFrame, model: str, chunk_chars: int) -> DataFrame:
    """(key, ids) of distinct giant texts (key, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = vocabulary(model)
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                whole = SPACE + text.replace(" ", SPACE)
                for i, (a, z, open_left, open_right) in enumerate(cut_text(whole, chunk_chars, v.longest)):
                    yield pa.RecordBatch.from_pydict({
                        "key": [key], "chunk": pa.array([i], pa.int32()), "open_left": [open_left], "open_right": [open_right],
                        "before": [whole[max(0, a - v.longest) : a] if open_left else ""], "body": [whole[a:z]],
                        "after": [whole[z : z + v.longest] if open_right else ""]})

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = vocabulary(model)
            made = []
            for left, body, right, x, y in zip(*(b.column(c).to_pylist() for c in ("before", "body", "after", "open_left", "open_right"))):
                m = v.transfer(left, body, right, x, y) if x or y else np.zeros((1, 1))
                made.append(zlib.compress(pickle.dumps(m)))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("chunk"), pa.array(made, pa.binary())], names=["key", "chunk", "matrix"])

    def scan(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        states = resolve([pickle.loads(zlib.decompress(m)) for m in rows.column("matrix").to_pylist()])
        return pa.table({"key": rows.column("key"), "chunk": rows.column("chunk"), "left": pa.array([x for x, _ in states], pa.int32()),
                         "right": pa.array([y for _, y in states], pa.int32())})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = vocabulary(model)
            made = []
            for before, body, after, x, y, left, right in zip(*(b.column(c).to_pylist() for c in (
                    "before", "body", "after", "open_left", "open_right", "left", "right"))):
                if not x and not y:
                    raw = body.replace(SPACE, " ").encode("utf-8", "replace")
                    made.append(v.encode_raw(np.array([0, len(raw)]), raw, np.zeros(1, bool))[0])
                    continue
                text, a, z = before + body + after, len(before), len(before) + len(body)
                first, state = v.states(text, a)[left] if x else (0, START)
                last, final = v.states(text, z)[right] if y else (0, None)
                # a piece belongs to the chunk it starts in; the one before the cut is not traced again
                made.append(np.array(v.path(text, a + first, state, z + last, final), np.int32))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("chunk"), pa.array(made, pa.list_(pa.int32()))], names=["key", "chunk", "ids"])

    chunk_schema = "key binary, chunk int, open_left boolean, open_right boolean, before string, body string, after string"
    chunks = texts.mapInArrow(_released(cut), chunk_schema).repartition("key", "chunk")
    weights = chunks.mapInArrow(_released(matrices), "key binary, chunk int, matrix binary")
    states = weights.groupBy("key").applyInArrow(scan, "key binary, chunk int, left int, right int")
    traced = chunks.join(states, ["key", "chunk"]).mapInArrow(_released(trace), "key binary, chunk int, ids array<int>")
    return (traced.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
            .select("key", F.flatten(F.col("parts.ids")).alias("giant_ids")))


def encode(df: DataFrame, text: str = "text", ids: str = "ids", model: str | None = None, giant_chars: int = GIANT_CHARS,
           chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Add ``ids``, the piece ids of ``text`` under the model file ``model``, as the SentencePiece library gives them.

    Null and empty texts have no ids. Every row is kept, repeated ones too; ``ids`` gets underscores where the name is taken.
    Texts over ``giant_chars`` characters go through the chunked scan, once for each distinct text.
    """
    model = model or public_tokenizers.path(MODEL)
    ids = free_name(df.columns, ids)
    giant = F.coalesce(F.char_length(text), F.lit(0)) > giant_chars
    small = _encode_small(df.filter(~giant), text, ids, model)
    key = F.unhex(F.sha2(F.col(text).cast("binary"), 256))
    taken = free_name(df.columns, "__key")
    large = df.filter(giant).withColumn(taken, key)
    # the whole texts meet by their key only here, and only giant ones
    distinct = large.select(F.col(taken).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    made = _encode_giant(distinct, model, chunk_chars)
    large = large.join(made, large[taken] == made["key"]).select(*[large[c] for c in df.columns], F.col("giant_ids").alias(ids))
    return small.union(large)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", model: str | None = None) -> DataFrame:
    """Add ``text``, what the ids stand for. Null ids: null; no ids: empty. Ids beyond the vocabulary fail the task."""
    model = model or public_tokenizers.path(MODEL)
    names = list(df.columns)
    text = free_name(names, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = decoder(model)
        for b in batches:
            lists = b.column(names.index(ids))
            at, flat, there = np.asarray(lists.offsets), lists.values.to_numpy(zero_copy_only=False), lists.is_valid().to_pylist()
            made = [v.decode(flat[x:y]) if t else None for x, y, t in zip(at[:-1].tolist(), at[1:].tolist(), there)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*names, text])

    return df.mapInArrow(run, f"{_fields(df)}, `{text}` string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, round_trip, decoded_chars): ids of every text, and whether they decode to it again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # what is left to the last step are the ids: texts are compared before
    back = decode(encode(docs)).select("doc_id", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
                                       F.char_length("decoded").cast("long").alias("decoded_chars"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            at, flat = np.asarray(lists.offsets), lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            crc = [zlib.crc32(flat[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pc.list_value_length(lists).cast(pa.int64()), pa.array(crc, pa.int64()),
                                              b.column("round_trip"), b.column("decoded_chars")],
                                             names=["doc_id", "n_pieces", "ids_crc32", "round_trip", "decoded_chars"])

    return back.mapInArrow(digest, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean, decoded_chars long")


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
