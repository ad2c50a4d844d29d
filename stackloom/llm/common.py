"""Helpers shared by the operators of this package: tables, shared folders, files in them."""

from __future__ import annotations

import ctypes
import functools
import mmap
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from stackloom.session import cut_lineage

__all__ = ["cut_lineage", "table", "work_folder", "open_write", "open_read", "local_copy", "text_slices", "free_name"]

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only

#: Bytes of text that a task handles at a time; a single longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder every executor can reach, as a URI, below ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="stackloom-work-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class open_write:
    """Write a file of a shared folder; it appears under its name only when complete.

    A second attempt of the same task writes the same bytes to a name of its own and replaces the first.
    """

    def __init__(self, uri: str):
        self.fs, self.path = _filesystem(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"

    def __enter__(self):
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)


def open_read(uri: str) -> pa.NativeFile:
    fs, path = _filesystem(uri)
    return fs.open_input_file(path)


@functools.lru_cache(maxsize=4096)
def local_copy(uri: str) -> str:
    """A path that can be memory-mapped: the file itself, or a copy where the store is not a mounted file system."""
    from pyarrow import fs as pafs

    fs, path = _filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return path
    target = os.path.join(tempfile.mkdtemp(prefix="stackloom-cache-"), os.path.basename(path))
    with fs.open_input_stream(path) as source, open(target, "wb") as out:
        while chunk := source.read(1 << 22):
            out.write(chunk)
    return target


def map_file(uri: str) -> memoryview:
    with open(local_copy(uri), "rb") as f:
        return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``column``; no row is left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
            _give_back()


def _give_back() -> None:
    """Return freed memory to the system, so that a worker's size is that of one slice and not of the largest ones so far."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores appended until no column of ``taken`` has it."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name
