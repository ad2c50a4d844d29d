"""Id-encoded profiles held as tables: unpivoting values, resolving ids, checking references.

Tables share ``profile_id``. Ids are 1-based, 0 means none, string 0 is empty:
``samples(location_ids, …)``, ``locations(id, mapping_id, address, lines)`` with
``lines array<struct<function_id,line,column>>``, ``functions(id, name,
system_name, filename, start_line)``, ``mappings(id, memory_start,
memory_limit, file_offset, filename, build_id)``, ``strings(idx, text)``.
"""

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stackloom.functions.scalar import record
from stackloom.operators.lookup import exploded, heavy_keys, lookup

P = "profile_id"

#: Location ids of a bucket of stacks, which bounds the frames that a task holds, and of the stacks that it returns at once.
BUCKET, TOGETHER = 1 << 21, 1 << 16

#: Tasks that the buckets are dealt to, unless there are more shuffle partitions; a task may have several.
MOST_TASKS = 4096

#: Types whose values can be hashed.
PLAIN = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def unpivot_sample_types(samples: DataFrame) -> DataFrame:
    """One row per sample and sample type; zero values are dropped before the rows leave the generator."""
    typed = F.arrays_zip(F.col("values").alias("value"), F.col("sample_types").alias("t"))
    rest = [c for c in samples.columns if c not in ("values", "sample_types")]
    return samples.select(*rest, F.inline(F.filter(typed, lambda x: x["value"] != 0))).select(
        *rest, F.col("t.type").alias("sample_type"), F.col("t.unit").alias("sample_unit"), "value")


def _texts(tables: list[tuple[DataFrame, list[str]]], strings: DataFrame) -> list[DataFrame]:
    """Replace string indexes by their text; a null or unknown index is empty, and so is 0, without a lookup.

    The strings are by far the largest table: they are shuffled once for all columns of all tables.
    """
    refs = [df.select(P, "id", F.lit(i).alias("table"), F.explode(F.array_distinct(F.array(*columns))).alias("idx")).where("idx <> 0")
            for i, (df, columns) in enumerate(tables)]
    found = lookup(reduce(DataFrame.unionByName, refs), exploded(strings.select(P, "idx", "text")), [P, "idx"], ["id"], "inner")
    out = []
    for i, (df, columns) in enumerate(tables):
        texts = found.where(F.col("table") == i).groupBy(P, "id").agg(F.collect_list(F.struct("idx", "text")).alias("texts"))
        text = lambda c: F.array_min(F.filter("texts", lambda x: x["idx"] == F.col(c)))["text"]
        rest = [c for c in df.columns if c not in columns]
        out.append(df.join(exploded(texts), [P, "id"], "left").select(
            *rest, *[F.coalesce(text(c), F.lit("")).alias(c) for c in columns]))
    return out


def resolve_locations(locations: DataFrame, functions: DataFrame, mappings: DataFrame, strings: DataFrame) -> DataFrame:
    """Dictionary rows (profile_id, id, location struct)."""
    fns, maps = _texts([
        (functions.select(P, "id", "start_line", "name", "system_name", "filename"), ["name", "system_name", "filename"]),
        (mappings.select(P, "id", "memory_start", "memory_limit", "file_offset", "filename", "build_id"), ["filename", "build_id"])],
        strings)
    lines = locations.select(P, F.col("id").alias("location"), F.posexplode("lines").alias("pos", "l")).select(
        P, "location", "pos", F.col("l.function_id").alias("id"), F.col("l.line").alias("line"), F.col("l.column").alias("column"))
    line = F.struct(
        "line", "column", F.col("name").alias("function_name"), F.col("system_name").alias("function_system_name"),
        F.col("filename").alias("function_filename"), F.col("start_line").alias("function_start_line"))
    per_location = (
        lines.join(exploded(fns), [P, "id"], "left")
        .groupBy(P, "location")
        .agg(F.transform(F.sort_array(F.collect_list(record(pos=F.col("pos"), line=line))), lambda x: x["line"]).alias("lines"))
        .withColumnRenamed("location", "id")
    )
    keyed = locations.select(P, "id", "mapping_id", "address")
    m = maps.select(P, F.col("id").alias("mapping_id"), "memory_start", "memory_limit", "file_offset",
                    F.col("filename").alias("file"), "build_id")
    location = F.struct(
        "address", F.col("memory_start").alias("mapping_start"), F.col("memory_limit").alias("mapping_limit"),
        F.col("file_offset").alias("mapping_offset"), F.col("file").alias("mapping_file"),
        F.col("build_id").alias("mapping_build_id"),
        F.coalesce("lines", F.array()).alias("lines"))
    return (
        lookup(keyed, exploded(m), [P, "mapping_id"], ["id"]).join(exploded(per_location), [P, "id"], "left")
        .select(P, "id", location.alias("location"))
    )


def _order(x):
    """A key that sorts values as Spark does: null first, structs and arrays by their parts."""
    if x is None:
        return (0,)
    return (1, tuple(map(_order, x.values() if isinstance(x, dict) else x)) if isinstance(x, (dict, list)) else x)


class _Frames:
    """The frames of a bucket, found by profile and location id."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches)
        self.profiles = table[P].unique()
        ids = table["id"].combine_chunks()
        self.ids = np.unique(ids.drop_null().to_numpy(zero_copy_only=False))
        keys = self._keys(table[P], ids)
        order = np.argsort(keys, kind="stable")
        self.keys, self.frames = keys[order], pa.concat_arrays(table["frame"].chunks).take(pa.array(order))
        starts = np.flatnonzero(np.append(True, self.keys[1:] != self.keys[:-1])[:len(keys)])
        self.unique = len(starts) == len(keys)
        if not self.unique:  # a location id that is there several times: frames in their order, however they came
            places, sizes = np.arange(len(keys)), np.diff(np.append(starts, len(keys)))
            for first, size in zip(starts[sizes > 1], sizes[sizes > 1]):
                places[first:first + size] = sorted(range(first, first + size), key=lambda i: _order(self.frames[i].as_py()))
            self.frames = self.frames.take(pa.array(places))

    def _keys(self, profiles, ids: pa.Array) -> np.ndarray:
        """A number for each pair of a profile and an id of this bucket, -1 for others; a null id has the least of its profile."""
        profile = pc.fill_null(pc.index_in(profiles, value_set=self.profiles), -1).to_numpy().astype(np.int64)
        null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        place = np.searchsorted(self.ids, ids)
        known = null | (np.append(self.ids, 0)[place] == ids) & (place < len(self.ids))
        return np.where(known & (profile >= 0), profile * (len(self.ids) + 1) + np.where(null, 0, place + 1), -1)

    def stacks(self, profiles: pa.Array, lists: pa.ListArray) -> Iterator[tuple[int, int, pa.ListArray]]:
        """(first, end, stacks) for runs of rows."""
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
        first = 0
        while first < len(lists):
            end = max(first + 1, int(np.searchsorted(ends, ends[first] + TOGETHER, "right")) - 1)
            sizes = np.diff(ends[first:end + 1])
            keys = self._keys(profiles.slice(first, end - first).take(pa.array(np.repeat(np.arange(end - first), sizes))),
                              lists.slice(first, end - first).flatten())
            at, bounds = np.searchsorted(self.keys, keys), ends[first:end + 1] - ends[first]
            if (np.append(self.keys, -2)[at] != keys).any():
                raise RuntimeError("samples name a location that they did not name when they were read for the locations")
            if not self.unique:
                n = np.searchsorted(self.keys, keys, "right") - at
                before = np.concatenate([[0], np.cumsum(n)])
                at = np.repeat(at - before[:-1], n) + np.arange(before[-1])
                bounds = before[bounds]
            yield first, end, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), self.frames.take(pa.array(at)))
            first = end


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Samples with their stacks; the frames of a bucket come before its samples, and no others are held."""
    coming, held = [], None
    for batch in batches:
        kind = batch.column("kind").to_numpy() % 2
        cuts = np.flatnonzero(np.diff(kind)) + 1
        for first, end in zip([0, *cuts], [*cuts, len(kind)]):
            rows = batch.slice(first, end - first)
            if not rows.num_rows:
                continue
            if kind[first] == 0:
                held = None
                coming.append(rows.select([P, "id", "frame"]))
                continue
            if coming or held is None:
                held, coming = _Frames(coming or [rows.slice(0, 0).select([P, "id", "frame"])]), []
            for i, j, stacks in held.stacks(rows.column("sample").field(P), rows.column("ids")):
                yield pa.RecordBatch.from_arrays([rows.column("sample").slice(i, j - i), stacks], ["sample", "stacktrace"])


def resolve_stacks(samples: DataFrame, locations: DataFrame, functions: DataFrame, mappings: DataFrame,
                   strings: DataFrame, frame: Callable[[Column], Column] = lambda location: location) -> DataFrame:
    """Samples with ``stacktrace`` instead of ``location_ids``, order kept.

    ``frame`` is what a stack shows of a location (null if the location is unknown); it is made once per location.
    Samples are dealt into buckets by profile and leaf, and a leaf with many of them by its stacks, too. A bucket gets each
    location that its stacks name once, and puts them together by itself: neither frames nor ids are shuffled per use.
    ``samples`` are read several times, one of them at once.
    """
    resolved = resolve_locations(locations, functions, mappings, strings)
    kind = resolved.schema["location"].dataType
    quoted = lambda c: f"`{c.replace('`', '``')}`"
    own = [F.col(quoted(c)) for c in samples.columns if c not in (P, "location_ids")]
    # stacks of a heavy leaf are dealt by what their samples hold, too, as one of them may be most of it
    dealt_by = ["ids", *[F.col(f"sample.{quoted(f.name)}") for f in samples.schema if f.name != "location_ids" and isinstance(f.dataType, PLAIN)]]
    rows = samples.select(P, F.struct(P, *own).alias("sample"),
                          F.when(F.col(P).isNotNull(), F.col("location_ids").cast("array<bigint>")).alias("ids"))
    rows = rows.withColumn("leaf", F.get("ids", F.lit(0)))
    # counted first: few shuffle partitions would hold many buckets each, and sort them on disk
    wanted = -(-(rows.agg(F.sum(F.greatest(F.size("ids"), F.lit(0)).cast("long"))).first()[0] or 0) // BUCKET)
    tasks = max(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(wanted, MOST_TASKS))
    buckets = tasks * max(-(-wanted // tasks), 1)
    heavy = heavy_keys(rows, [[P, "leaf"]], tasks)
    parts = F.coalesce(F.try_element_at(heavy.getField("m0"), F.xxhash64(P, "leaf")), F.lit(1))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(P, "leaf", F.pmod(F.xxhash64(*dealt_by), parts)), F.lit(buckets).cast("long")))

    named = rows.select("bucket", P, F.explode("ids").alias("id")).distinct()
    known = resolved.select(P, "id", F.struct(frame(F.col("location")).alias("frame")).alias("known"))
    frames = named.join(exploded(known), [P, "id"], "left").select(
        "bucket", P, "id", F.when(F.col("known").isNull(), frame(F.lit(None).cast(kind))).otherwise(F.col("known.frame")).alias("frame"))
    empty = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = frames.select((F.col("bucket") * 2).alias("kind"), P, "id", "frame", empty(rows, "ids"), empty(rows, "sample")).unionByName(
        rows.select((F.col("bucket") * 2 + 1).alias("kind"), empty(rows, P), empty(frames, "id"), empty(frames, "frame"), "ids", "sample"))
    dealt = both.repartitionById(tasks, F.pmod(F.expr("kind div 2"), F.lit(tasks)).cast("int"))
    # by bucket, frames first, and leaf: texts that are much alike follow each other. One number, so rows aren't compared
    bits = 62 - (2 * buckets).bit_length()
    dealt = dealt.sortWithinPartitions(F.shiftleft("kind", bits).bitwiseOR(
        F.coalesce(F.get("ids", F.lit(0)), F.lit(0)).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))))
    out = T.StructType([T.StructField("sample", both.schema["sample"].dataType),
                        T.StructField("stacktrace", T.ArrayType(both.schema["frame"].dataType))])
    return dealt.mapInArrow(_fill, out).select("sample.*", "stacktrace")


def _issue(df: DataFrame, error: str, ref: Column) -> DataFrame:
    return df.select(P, F.lit(error).alias("error"), ref.cast("long").alias("ref"))


def _missing(refs: DataFrame, table: DataFrame) -> DataFrame:
    """References (profile_id, error, ref) other than 0 without a row in ``table(profile_id, id)``."""
    distinct = refs.where("ref <> 0").select(P, "error", F.col("ref").cast("long").alias("ref")).distinct()
    known = exploded(table.select(P, F.col("id").alias("ref")))
    return distinct.join(known, [P, "ref"], "left_anti").select(P, "error", "ref")


def validate_profiles(samples: DataFrame, locations: DataFrame, functions: DataFrame, mappings: DataFrame,
                      strings: DataFrame, sample_type_counts: DataFrame | None = None,
                      labels: DataFrame | None = None) -> DataFrame:
    """Violations as rows (profile_id, error, ref); distinct references are checked, not every use.

    ``sample_type_counts(profile_id, n)`` enables the value-count check on
    ``samples.values``; ``labels(profile_id, key, str)`` the label checks.
    """
    texts = strings.select(P, F.col("idx").alias("id"))
    refs = lambda df, c, error: _issue(df, error, F.col(c))
    lists = samples.select(P, F.explode("location_ids").alias("ref"))
    line_refs = locations.select(P, F.explode("lines").alias("l"))
    found = [
        _issue(strings.where("idx = 0 AND text <> ''"), "first string is not empty", F.col("idx")),
        _issue(lists.where("ref = 0").distinct(), "location id is zero", F.col("ref")),
        _missing(refs(lists, "ref", "sample location out of range"), locations),
        _missing(refs(locations, "mapping_id", "location mapping out of range"), mappings),
        _missing(refs(line_refs, "l.function_id", "line function out of range"), functions),
    ]
    text_refs = [refs(table, c, f"{name} {c} out of range")
                 for name, table, columns in (("mapping", mappings, ["filename", "build_id"]),
                                              ("function", functions, ["name", "system_name", "filename"])) for c in columns]
    for name, table in (("mapping", mappings), ("function", functions), ("location", locations)):
        # 1..n without gaps or repeats: every id within its profile's count, no id twice
        sizes = table.groupBy(P).agg(F.count("*").alias("n"))
        found.append(_issue(lookup(table.select(P, "id"), sizes, [P], ["id"], "inner").where("id < 1 OR id > n"),
                            f"{name} id not sequential", F.col("id")))
        found.append(_issue(table.groupBy(P, "id").count().where("count > 1"), f"{name} id repeated", F.col("id")))
    if sample_type_counts is not None:
        sized = lookup(samples.select(P, F.size("values").alias("ref")).distinct(), sample_type_counts, [P], ["ref"])
        found.append(_issue(sized.where("n IS NULL OR ref <> n"), "values do not match sample types", F.col("ref")))
    if labels is not None:
        found.append(_issue(labels.where("key = 0").distinct(), "label without key", F.col("key")))
        text_refs += [refs(labels, c, f"label {c} out of range") for c in ("key", "str")]
    # the strings are by far the largest table: they are shuffled once for all references
    found.append(_missing(reduce(DataFrame.unionByName, text_refs), texts))
    return reduce(DataFrame.unionByName, found)
