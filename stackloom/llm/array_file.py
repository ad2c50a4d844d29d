"""Named arrays in a file that is memory-mapped when read."""

from __future__ import annotations

import json

import numpy as np

from stackloom.llm.common import map_file, open_write


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    head, at = {}, 0
    for name, x in arrays.items():
        head[name] = [x.dtype.str, len(x), at]
        at += -(-x.nbytes // 64) * 64
    raw = json.dumps(head).encode()
    raw += b" " * (-(len(raw) + 8) % 64)
    with open_write(uri) as out:
        out.write(len(raw).to_bytes(8, "little") + raw)
        for x in arrays.values():
            out.write(np.ascontiguousarray(x).tobytes())
            out.write(bytes(-x.nbytes % 64))


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    data = map_file(uri)
    size = int.from_bytes(data[:8], "little")
    head = json.loads(bytes(data[8 : 8 + size]))
    return {name: np.frombuffer(data, kind, n, 8 + size + at) for name, (kind, n, at) in head.items()}
