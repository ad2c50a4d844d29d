"""Protocol-buffer wire format for the public pprof message, driven by a field table."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Field numbers of the pprof profile message. Kinds: i = 64-bit
# integer, s = string; * = repeated.
MESSAGES = {
    "profile": {1: ("sample_types", "value_type*"), 2: ("samples", "sample*"), 3: ("mappings", "mapping*"),
                4: ("locations", "location*"), 5: ("functions", "function*"), 6: ("strings", "s*"),
                9: ("time_nanos", "i"), 10: ("duration_nanos", "i"), 11: ("period_type", "value_type"),
                12: ("period", "i"), 13: ("comments", "i*")},
    "value_type": {1: ("type", "i"), 2: ("unit", "i")},
    "sample": {1: ("location_ids", "i*"), 2: ("values", "i*"), 3: ("labels", "label*")},
    "label": {1: ("key", "i"), 2: ("str", "i"), 3: ("num", "i"), 4: ("num_unit", "i")},
    "mapping": {1: ("id", "i"), 2: ("memory_start", "i"), 3: ("memory_limit", "i"), 4: ("file_offset", "i"),
                5: ("filename", "i"), 6: ("build_id", "i"), 7: ("has_functions", "i")},
    "location": {1: ("id", "i"), 2: ("mapping_id", "i"), 3: ("address", "i"), 4: ("lines", "line*"),
                 5: ("is_folded", "i")},
    "line": {1: ("function_id", "i"), 2: ("line", "i"), 3: ("column", "i")},
    "function": {1: ("id", "i"), 2: ("name", "i"), 3: ("system_name", "i"), 4: ("filename", "i"),
                 5: ("start_line", "i")},
}


def arrow_type(kind: str) -> pa.DataType:
    if kind.endswith("*"):
        return pa.list_(arrow_type(kind[:-1]))
    if kind in ("i", "s"):
        return pa.int64() if kind == "i" else pa.string()
    return pa.struct([(name, arrow_type(k)) for name, k in MESSAGES[kind].values()])


def spark_type(kind: str) -> str:
    if kind.endswith("*"):
        return f"array<{spark_type(kind[:-1])}>"
    if kind in ("i", "s"):
        return "bigint" if kind == "i" else "string"
    return "struct<" + ",".join(f"{n}:{spark_type(k)}" for n, k in MESSAGES[kind].values()) + ">"


def _varint(buf, at):
    shift = value = 0
    while True:
        b = buf[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            value &= 2**64 - 1
            return (value - 2**64 if value >= 2**63 else value), at
        shift += 7


def decode(buf: memoryview, kind: str) -> dict:
    """One message as a dict; unknown fields are skipped, absent numbers are 0."""
    fields = MESSAGES[kind]
    out = {n: [] if k.endswith("*") else (0 if k == "i" else None) for n, k in fields.values()}
    at = 0
    while at < len(buf):
        tag, at = _varint(buf, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = _varint(buf, at)
        elif wire == 2:
            size, at = _varint(buf, at)
            value, at = buf[at:at + size], at + size
            if len(value) != size:
                raise ValueError("truncated message")
        elif wire in (1, 5):
            at += 8 if wire == 1 else 4
            continue
        else:
            raise ValueError(f"wire type {wire}")
        if number not in fields:
            continue
        name, k = fields[number]
        base = k.rstrip("*")
        if wire == 2 and base == "i":  # packed
            p, items = 0, []
            while p < len(value):
                v, p = _varint(value, p)
                items.append(v)
        elif base == "i":
            items = [value]
        elif base == "s":
            items = [bytes(value).decode("utf-8", "replace")]
        else:
            items = [decode(value, base)]
        if k.endswith("*"):
            out[name].extend(items)
        else:
            out[name] = items[-1]
    return out


def _uvarint(n: int) -> bytes:
    n &= 2**64 - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def encode(row, kind: str) -> bytes:
    """A dict (or any mapping) as one message; zeros and empty lists are left out."""
    out = bytearray()
    for number, (name, k) in MESSAGES[kind].items():
        value = row.get(name)
        if value is None:
            continue
        base = k.rstrip("*")
        if base == "i" and k.endswith("*"):
            body = b"".join(_uvarint(int(v)) for v in value)
            if body:
                out += _uvarint(number << 3 | 2) + _uvarint(len(body)) + body
        elif base == "i":
            if int(value):
                out += _uvarint(number << 3) + _uvarint(int(value))
        else:
            for v in value if k.endswith("*") else [value]:
                body = v.encode() if base == "s" else encode(v, base)
                out += _uvarint(number << 3 | 2) + _uvarint(len(body)) + body
    return bytes(out)


# --- many messages at once ----------------------------------------------------


def _spans(size: np.ndarray) -> np.ndarray:
    """First place of each of several runs that follow each other, and the end."""
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all runs, one run after the other."""
    at = _spans(size)
    return np.arange(at[-1]) + np.repeat(start - at[:-1], size)


def _join(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, length by row): of each row, its bytes of the first part, of the second, and so on."""
    size = np.sum([n for _, n in parts], axis=0)
    at, out = _spans(size)[:-1].copy(), np.empty(int(size.sum()), np.uint8)
    for data, n in parts:
        out[_places(at, n)] = data
        at += n
    return out, size


def _sums(size: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(_spans(size)[ends])


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, length of each) of 64-bit integers."""
    left = np.ascontiguousarray(values, np.int64).view(np.uint64)
    made, n = np.empty((len(left), 10), np.uint8), np.ones(len(left), np.int64)
    for k in range(10):
        made[:, k] = left & 127
        left = left >> 7
        if not (more := left > 0).any():
            break
        made[more, k] |= 128
        n += more
    return made[np.arange(10) < n[:, None]], n


def _led(tag: int, data: np.ndarray, n: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bodies led by tag and length; nothing where there is none."""
    lead, size = _varints(n)
    keep = np.repeat(there, size)
    return _join([(np.full(int(there.sum()), tag, np.uint8), there.astype(np.int64)), (lead[keep], size * there), (data, n)])


def _list(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """Items of a list column and where those of its rows start and end; null lists are empty."""
    if column.null_count:
        column = pc.if_else(column.is_valid(), column, pa.scalar([], column.type))
    ends = column.offsets.to_numpy()
    return column.values.slice(ends[0], ends[-1] - ends[0]), ends - ends[0]


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column, "").cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8), np.diff(ends)


def encode_column(column: pa.StructArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, length by row) of the messages :func:`encode` makes of the rows; null rows are empty."""
    rows, parts, flat = len(column), [], column.flatten()
    for number, (name, k) in MESSAGES[kind].items():
        at = column.type.get_field_index(name)
        if at < 0:
            continue
        field, base, many = flat[at], k.rstrip("*"), k.endswith("*")
        tag = number << 3 | (0 if k == "i" else 2)  # field numbers are below 16
        if k == "i":
            values = pc.fill_null(field.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
            there = values != 0
            data, n = _varints(values[there])
            size = np.zeros(rows, np.int64)
            size[there] = n
            lead = there.astype(np.int64)
            parts.append(_join([(np.full(int(lead.sum()), tag, np.uint8), lead), (data, size)]))
            continue
        items, ends = _list(field) if many else (field, np.arange(rows + 1))
        if base == "i":
            data, n = _varints(pc.fill_null(items.cast(pa.int64()), 0).to_numpy(zero_copy_only=False))
            n = _sums(n, ends)
            parts.append(_led(tag, data, n, n > 0))
            continue
        data, n = _strings(items) if base == "s" else encode_column(items, base)
        data, n = _led(tag, data, n, items.is_valid().to_numpy(zero_copy_only=False))
        parts.append((data, _sums(n, ends)))
    return _join(parts) if parts else (np.empty(0, np.uint8), np.zeros(rows, np.int64))


class Odd(ValueError):
    """A message that is read field by field, by :func:`decode`, as it breaks a rule or uses a form that writers don't."""


def _read_varints(buf: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, place behind each) of the varints at ``at``."""
    value, place, open_ = np.zeros(len(at), np.uint64), at.copy(), np.arange(len(at))
    for k in range(10):
        if (place[open_] >= stop[open_]).any():
            raise Odd("varint beyond its message")
        b = buf[place[open_]].astype(np.uint64)
        value[open_] |= (b & np.uint64(127)) << np.uint64(7 * k)
        place[open_] += 1
        open_ = open_[b >= 128]
        if not len(open_):
            return value.view(np.int64), place
    raise Odd("varint of more than ten bytes")


def _top_fields(raw: bytes, at: int, stop: int) -> list[tuple[int, int, int]]:
    """(tag, start, end) of the fields of one large message; of a number, its bytes."""
    out = []
    while at < stop:
        tag = raw[at]
        at += 1
        if tag & 7 == 2 and tag < 128:
            size, shift = raw[at], 7
            at += 1
            if size >= 128:
                size &= 127
                while True:
                    b = raw[at]
                    at += 1
                    size |= (b & 127) << shift
                    if b < 128:
                        break
                    shift += 7
            out.append((tag, at, at + size))
            at += size
        elif tag & 7 == 0 and tag < 128:
            start = at
            while raw[at] >= 128:
                at += 1
            at += 1
            out.append((tag, start, at))
        else:
            raise Odd("field of another form")
    if at != stop:
        raise Odd("field beyond its message")
    return out


def _fields(raw: bytes, buf: np.ndarray, start: np.ndarray, stop: np.ndarray, few: bool) -> dict[int, tuple[np.ndarray, ...]]:
    """Fields of many messages by tag: (message, start, end), in the order in which each message holds them."""
    found: list[tuple[np.ndarray, ...]] = []
    if few:
        for m, (a, z) in enumerate(zip(start.tolist(), stop.tolist())):
            fields = np.array(_top_fields(raw, a, z), np.int64).reshape(-1, 3)
            found.append((np.full(len(fields), m), fields[:, 0], fields[:, 1], fields[:, 2]))
    else:  # the next field of all messages at once
        open_, at = np.arange(len(start)), start
        while True:
            there = at < stop[open_]
            open_, at = open_[there], at[there]
            if not len(open_):
                break
            tag = buf[at].astype(np.int64)
            number, packed = tag & 7 == 0, tag & 7 == 2
            if (tag >= 128).any() or not (number | packed).all():
                raise Odd("field of another form")
            value, behind = _read_varints(buf, at + 1, stop[open_])
            if (packed & ((value < 0) | (value > stop[open_] - behind))).any():
                raise Odd("field beyond its message")
            begin = np.where(number, at + 1, behind)
            at = behind + np.where(packed, value, 0)
            found.append((open_, tag, begin, at))
    if not found:
        return {}
    message, tag, begin, end = (np.concatenate(x) for x in zip(*found))
    out = {}
    for t in np.unique(tag).tolist():
        mine = np.flatnonzero(tag == t)
        mine = mine[np.argsort(message[mine], kind="stable")]
        out[t] = message[mine], begin[mine], end[mine]
    return out


def _decode(raw: bytes, buf: np.ndarray, start: np.ndarray, stop: np.ndarray, kind: str, few: bool) -> pa.StructArray:
    rows, columns, names = len(start), [], []
    fields, none = _fields(raw, buf, start, stop, few), (np.empty(0, np.int64),) * 3
    for number, (name, k) in MESSAGES[kind].items():
        base, many = k.rstrip("*"), k.endswith("*")
        message, begin, end = fields.get(number << 3 | (0 if k == "i" else 2), none)
        other = fields.get(number << 3 | (2 if k == "i" else 0))
        if other is not None and k != "i*":
            raise Odd("field of another form")
        if other is not None:  # repeated numbers come packed or one by one
            message, begin, end = (np.concatenate(x) for x in zip((message, begin, end), other))
            order = np.argsort(begin, kind="stable")
            message, begin, end = message[order], begin[order], end[order]
        if not many:  # the last one counts
            last = np.append(message[1:] != message[:-1], True) if len(message) else np.empty(0, bool)
            message, begin, end = message[last], begin[last], end[last]
        if k == "i":
            values = np.zeros(rows, np.int64)
            values[message] = _read_varints(buf, begin, end)[0]
            columns.append(pa.array(values))
        elif base == "i":
            # packed: a byte below 128 ends a number
            inside = _places(begin, end - begin)
            lasts = buf[inside] < 128
            ends = np.flatnonzero(lasts) + 1
            if len(begin) and not (buf[end[end > begin] - 1] < 128).all():
                raise Odd("varint beyond its message")
            of = np.repeat(message, end - begin)[ends - 1] if len(ends) else np.empty(0, np.int64)
            first = inside[np.concatenate([[0], ends[:-1]])] if len(ends) else np.empty(0, np.int64)
            values = _read_varints(buf, first, inside[ends - 1] + 1 if len(ends) else first)[0]
            columns.append(_listed(pa.array(values), of, rows))
        else:
            if base == "s":
                at = _spans(end - begin)
                data = buf[_places(begin, end - begin)]
                items = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(data)])
                try:
                    items = items.cast(pa.string())
                except pa.ArrowInvalid:
                    raise Odd("text that is not UTF-8") from None
            else:
                items = _decode(raw, buf, begin, end, base, False)
            if many:
                items = _listed(items, message, rows)
            else:
                place = np.full(rows, -1)
                place[message] = np.arange(len(message))
                items = items.take(pa.array(place, mask=place < 0))
            columns.append(items)
        names.append(name)
    return pa.StructArray.from_arrays(columns, names)


def _listed(items: pa.Array, owner: np.ndarray, rows: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(_spans(np.bincount(owner, minlength=rows)), pa.int32()), items)


def decode_column(contents: list[bytes], kind: str) -> pa.StructArray:
    """The messages as :func:`decode` reads them, in one array; :class:`Odd` if one of them is to be read by that."""
    raw = b"".join(contents)
    at = _spans(np.array([len(c) for c in contents], np.int64))
    try:
        return _decode(raw, np.frombuffer(raw, np.uint8), at[:-1], at[1:], kind, True).cast(arrow_type(kind))
    except IndexError:
        raise Odd("field beyond its message") from None
