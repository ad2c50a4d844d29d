"""pprof files in and out.

Bytes become nested rows in one small Arrow step per file; everything else
(checking, id resolution, unpivoting, labels) is column expressions on those
rows, without a shuffle: a file carries its own dictionary.
"""

import gzip

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stackloom.functions.keys import mapping_name, rounded_size
from stackloom.functions.scalar import int_div, record
from stackloom.operators.lookup import lookup, lookups
from stackloom.operators.running import dense_ids, running_sum
from stackloom.sources import wire
from stackloom.sources.labels import label_set, label_sets, merge_sample_labels
from stackloom.schema import SAMPLES
from stackloom.session import cut_lineage

GZIP_MAGIC = b"\x1f\x8b"
#: Bytes of files that are decoded together.
RUN_BYTES = 4 << 20


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _unzipped(contents: pa.Array):
    """(first row, bytes, errors) of runs of files; a run holds about ``RUN_BYTES``, or one larger file."""
    start, plain, errors, size = 0, [], [], 0
    for i in range(len(contents)):
        content, error = contents[i].as_py(), None
        try:
            if content[:2] == GZIP_MAGIC:
                content = gzip.decompress(content)
        except Exception as e:  # a broken file is reported, not fatal
            content, error = b"", f"{type(e).__name__}: {e}"
        plain.append(content)
        errors.append(error)
        size += len(content)
        if size >= RUN_BYTES:
            yield start, plain, errors
            start, plain, errors, size = i + 1, [], [], 0
    if plain:
        yield start, plain, errors


def _profiles(contents: list[bytes]) -> tuple[pa.StructArray, list[str | None]]:
    """The profiles of files, null with an error for those that are none; together, or where one is odd, file by file."""
    kind = wire.arrow_type("profile")
    try:
        return wire.decode_column(contents, "profile"), [None] * len(contents)
    except wire.Odd:
        if len(contents) > 1:
            each = [_profiles([c]) for c in contents]
            return pa.concat_arrays([p for p, _ in each]), [e for _, es in each for e in es]
    try:
        return pa.array([wire.decode(memoryview(contents[0]), "profile")], kind), [None]
    except Exception as e:
        return pa.nulls(1, kind), [f"{type(e).__name__}: {e}"]


def decode_files(files: DataFrame) -> DataFrame:
    """Add the struct column ``p`` (null with ``decode_error`` if the bytes are no profile)."""

    def step(batches):
        for batch in batches:
            at = batch.schema.get_field_index("content")
            for start, plain, errors in _unzipped(batch.column(at)):
                made = [_profiles(plain)] if not any(errors) else []
                for content, error in zip(plain, errors) if not made else []:
                    made.append(_profiles([content]) if error is None else (pa.nulls(1, wire.arrow_type("profile")), [error]))
                rows = batch.slice(start, len(plain))
                yield pa.RecordBatch.from_arrays(
                    [*(c for i, c in enumerate(rows.columns) if i != at), pa.concat_arrays([p for p, _ in made]),
                     pa.array([e for _, es in made for e in es], pa.string())],
                    names=[*(c for c in rows.schema.names if c != "content"), "p", "decode_error"])

    kept = [f for f in files.schema.fields if f.name != "content"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return files.mapInArrow(step, f"{ddl}, p {wire.spark_type('profile')}, decode_error string")


def _text(strings: Column, idx: Column) -> Column:
    return F.coalesce(F.get(strings, idx), F.lit(""))


def _field(name: str):
    return lambda x: x[name]


def profile_errors(p: str = "p") -> Column:
    """All violations of one decoded profile, as an array of messages."""
    c = F.col
    strings, n_strings = c(f"{p}.strings"), F.size(f"{p}.strings")
    outside = lambda idx: (idx < 0) | ((idx != 0) & (idx >= n_strings))
    n = {t: F.size(f"{p}.{t}") for t in ("mappings", "functions", "locations", "sample_types", "samples")}
    checks = [((n_strings > 0) & (F.get(strings, F.lit(0)) != ""), "first string is not empty")]
    for t, text in (("mappings", ["filename", "build_id"]), ("functions", ["name", "system_name", "filename"]),
                    ("locations", [])):
        ids = F.transform(f"{p}.{t}", lambda x: x["id"])
        checks.append((ids != F.when(n[t] > 0, F.transform(F.sequence(F.lit(1), F.greatest(n[t], F.lit(1))),
                                                         lambda i: i.cast("long"))).otherwise(ids), f"{t} ids not sequential"))
        checks += [(F.exists(F.transform(f"{p}.{t}", _field(f)), outside), f"{t} {f} out of range") for f in text]
    ref = lambda x, t: (x < 0) | (x > n[t])
    checks += [
        (F.exists(f"{p}.locations", lambda x: ref(x["mapping_id"], "mappings")), "location mapping out of range"),
        (F.exists(f"{p}.locations", lambda x: F.exists(x["lines"], lambda y: ref(y["function_id"], "functions"))),
         "line function out of range"),
        ((n["sample_types"] == 0) & (n["samples"] > 0), "missing sample types"),
        (F.exists(f"{p}.sample_types", lambda x: outside(x["type"]) | outside(x["unit"])), "sample type out of range"),
        (F.coalesce(outside(c(f"{p}.period_type.type")) | outside(c(f"{p}.period_type.unit")), F.lit(False)),
         "period type out of range"),
        (F.exists(f"{p}.samples", lambda s: F.size(s["values"]) != n["sample_types"]), "values do not match sample types"),
        (F.exists(f"{p}.samples", lambda s: F.exists(s["location_ids"], lambda i: (i < 1) | (i > n["locations"]))),
         "sample location out of range"),
        (F.exists(f"{p}.samples", lambda s: F.exists(s["labels"], lambda x: (x["key"] == 0) | outside(x["key"]))),
         "label without valid key"),
        (F.exists(f"{p}.samples", lambda s: F.exists(s["labels"], lambda x: outside(x["str"]))), "label str out of range"),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(message)) for bad, message in checks]))


def validate_files(decoded: DataFrame) -> DataFrame:
    """One row per violation of each decoded file."""
    errors = F.when(F.col("decode_error").isNotNull(), F.array("decode_error")).otherwise(profile_errors())
    return decoded.select("path", F.explode(errors).alias("error"))


def _resolved_locations(p: str) -> Column:
    """The location table of a profile with mappings, functions and strings filled in."""
    strings, mappings, functions = (F.col(f"{p}.{t}") for t in ("strings", "mappings", "functions"))

    def line(x):
        f = F.get(functions, x["function_id"] - 1)
        return record(
            line=x["line"], column=x["column"],
            function_name=F.when(x["function_id"] != 0, _text(strings, f["name"])),
            function_system_name=F.when(x["function_id"] != 0, _text(strings, f["system_name"])),
            function_filename=F.when(x["function_id"] != 0, _text(strings, f["filename"])),
            function_start_line=F.when(x["function_id"] != 0, f["start_line"]))

    def location(x):
        m = F.get(mappings, x["mapping_id"] - 1)
        has = x["mapping_id"] != 0
        return record(
            address=x["address"], mapping_start=F.when(has, m["memory_start"]),
            mapping_limit=F.when(has, m["memory_limit"]), mapping_offset=F.when(has, m["file_offset"]),
            mapping_file=F.when(has, _text(strings, m["filename"])),
            mapping_build_id=F.when(has, _text(strings, m["build_id"])), lines=F.transform(x["lines"], line))

    return F.transform(f"{p}.locations", location)


def _has_name() -> Column:
    return F.coalesce(F.try_element_at("labels", F.lit("__name__")), F.lit("")) != ""


def rejected_files(decoded: DataFrame) -> DataFrame:
    """Why files give no samples: rows (path, error), one per violation, missing series names among them."""
    errors = F.when(F.col("decode_error").isNotNull(), F.array("decode_error")).otherwise(profile_errors())
    unnamed = F.when(~_has_name(), F.array(F.lit("missing name"))).otherwise(F.array().cast("array<string>"))
    return decoded.select("path", F.explode(F.concat(errors, unnamed)).alias("error"))


def samples_of_files(decoded: DataFrame, include_sample_labels: bool = True) -> DataFrame:
    """Samples of the decoded files that break no rule.

    A file carries its own dictionary, so its samples are finished inside its row: neither the dictionary nor the strings are
    copied to them. A sample leaves the row once, with its stack and labels, and is then repeated for its values.
    """
    named = decoded.where("p IS NOT NULL").where(_has_name()).where(F.size(profile_errors()) == 0)
    per_file = named.select(
        F.element_at("labels", "__name__").alias("name"), F.map_filter("labels", lambda k, _: k != "__name__").alias("series"),
        _text(F.col("p.strings"), F.col("p.period_type.type")).alias("period_type"),
        _text(F.col("p.strings"), F.col("p.period_type.unit")).alias("period_unit"), "p.period", F.col("p.duration_nanos").alias("duration"),
        int_div("p.time_nanos", 1_000_000).alias("timestamp"), "p.time_nanos", "p", _resolved_locations("p").alias("dictionary"),
        F.transform("p.sample_types", lambda x: record(sample_type=_text(F.col("p.strings"), x["type"]),
                                                       sample_unit=_text(F.col("p.strings"), x["unit"]))).alias("kinds"))
    strings, kinds, dictionary, series = F.col("p.strings"), F.col("kinds"), F.col("dictionary"), F.col("series")

    def labels(own: Column) -> Column:
        pairs = F.transform(own, lambda x: record(name=_text(strings, x["key"]), value=_text(strings, x["str"])))
        return merge_sample_labels(series, pairs)

    if include_sample_labels:
        per_file = per_file.withColumn("sets", label_sets(F.transform("p.samples", lambda s: s["labels"]), labels))
    label = lambda s: label_set(F.col("sets"), s["labels"], labels) if include_sample_labels else series
    kind = lambda i, c: F.get(kinds, i)[c]
    whole = F.transform("p.samples", lambda s: record(
        typed=F.filter(F.transform(s["values"], lambda v, i: record(value=v, sample_type=kind(i, "sample_type"), sample_unit=kind(i, "sample_unit"))),
                       lambda x: x["value"] != 0),
        labels=label(s), stacktrace=F.transform(s["location_ids"], lambda i: F.get(dictionary, i - 1))))
    own = ("name", "period_type", "period_unit", "period", "duration", "timestamp", "time_nanos")
    # in the order of the schema; to() would make each stack anew
    return per_file.select(*own, F.inline(whole)).select(*own, "labels", "stacktrace", F.inline("typed")).select(*SAMPLES.names)


def ingest_pprof(files: DataFrame, include_sample_labels: bool = True) -> DataFrame:
    """Samples of pprof files.

    ``files``: path, content, labels (map, with ``__name__``). Files that break a
    rule are left out; list them with :func:`rejected_files`. With
    ``include_sample_labels=False`` only the series labels are kept.
    """
    return samples_of_files(decode_files(files), include_sample_labels)


# --- export -----------------------------------------------------------------


def _export_locations(loc: Column) -> Column:
    """Key of a location: mapping and address within it, else its lines."""
    has = loc["mapping_start"].isNotNull()
    mapping = F.when(has, record(
        name=mapping_name(loc["mapping_build_id"], loc["mapping_file"]),
        size=rounded_size(loc["mapping_start"], loc["mapping_limit"]), offset=loc["mapping_offset"]))
    placed = has & (loc["address"] != 0)
    lines = F.transform(F.coalesce(loc["lines"], F.array()), lambda x: record(
        name=F.coalesce(x["function_name"], F.lit("")),
        system_name=F.coalesce(x["function_system_name"], F.lit("")),
        filename=F.coalesce(x["function_filename"], F.lit("")),
        start_line=F.coalesce(x["function_start_line"], F.lit(0).cast("long")), line=x["line"],
        column=F.coalesce(x["column"], F.lit(0).cast("long")), known=x["function_name"].isNotNull()))
    return record(
        mapping=mapping, offset=F.when(placed, loc["address"] - loc["mapping_start"]),
        lines_key=F.when(~placed, F.transform(lines, lambda x: x.dropFields("column")))), record(
            address=loc["address"], start=loc["mapping_start"], limit=loc["mapping_limit"],
            file=F.coalesce(loc["mapping_file"], F.lit("")),
            build_id=F.coalesce(loc["mapping_build_id"], F.lit("")), lines=lines)


class Export:
    """Dictionary tables of a profile in pprof form.

    ``strings(id, text)``, ``functions``, ``mappings``, ``locations``, ``samples``.
    Ids are dense and assigned without a global sort. Samples without a location
    are left out; equal samples are merged.
    """

    def __init__(self, profile: DataFrame, is_diff: bool = False):
        labels = F.col("labels") if "labels" in profile.columns else F.create_map().cast(LABELS)
        # read by every section below
        rows = cut_lineage(profile.where(F.size("stacktrace") > 0).select(
            (F.col("diff") if is_diff else F.col("value")).alias("value"), "stacktrace",
            F.sort_array(F.map_entries(labels)).alias("labels")))
        keys = F.transform("stacktrace", lambda loc: _export_locations(loc)[0])
        merged = rows.groupBy(keys.alias("keys"), "labels").agg(F.sum("value").alias("value"))
        both = F.transform("stacktrace", lambda loc: record(**dict(zip(("key", "info"), _export_locations(loc)))))
        seen = rows.select(F.explode(F.array_distinct(both)).alias("l")).select("l.key", "l.info").distinct()
        # one witness per key: the least of its variants
        seen = cut_lineage(seen)
        locations = dense_ids(seen.groupBy("key").agg(F.min("info").alias("info")), ["key"], "id")
        found = cut_lineage(locations.select("id", "key", "info"))
        maps = dense_ids(
            found.where("key.mapping IS NOT NULL").groupBy("key.mapping").agg(F.min(record(
                start=F.col("info.start"), limit=F.col("info.limit"), file=F.col("info.file"),
                build_id=F.col("info.build_id"))).alias("m")),
            ["mapping"], "id")
        fn = ["name", "system_name", "filename", "start_line"]
        lines = found.select(F.col("id").alias("location"), F.posexplode("info.lines").alias("pos", "l"))
        named = seen.select(F.explode("info.lines").alias("l")).where("l.known")
        functions = cut_lineage(dense_ids(named.select(*[F.col(f"l.{c}").alias(c) for c in fn]).distinct(), fn, "id"))
        texts = [functions.select(F.explode(F.array("name", "system_name", "filename")).alias("text")),
                 maps.select(F.explode(F.array("m.file", "m.build_id")).alias("text")),
                 merged.select(F.explode("labels").alias("e")).select(F.explode(F.array("e.key", "e.value")).alias("text"))]
        self._texts = texts
        self.mappings, self.functions, self._lines, self._found, self._merged = maps, functions, lines, found, merged

    def strings(self, *more: str) -> DataFrame:
        """Texts with their index; index 0 is the empty text."""
        spark = self.functions.sparkSession
        fixed = spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in more or ("",)])).alias("text"))
        all_ = fixed
        for t in self._texts:
            all_ = all_.unionByName(t)
        ids = dense_ids(all_.where("text <> ''").distinct(), ["text"], "id")
        return ids.unionByName(spark.range(1).select(F.lit("").alias("text"), F.lit(0).cast("long").alias("id")))

    def locations(self) -> DataFrame:
        """id, mapping_id, address, lines(function_id, line, column)."""
        fn = ["name", "system_name", "filename", "start_line"]
        lines = self._lines.select("location", "pos", *[F.col(f"l.{c}").alias(c) for c in fn], "l.line", "l.column", "l.known")
        with_fn = lookup(lines, self.functions.withColumnRenamed("id", "function_id"), fn, ["location", "pos"])
        line = record(function_id=F.when(F.col("known"), F.col("function_id")).otherwise(0).cast("long"), line=F.col("line"),
                      column=F.col("column"))
        per = with_fn.groupBy(F.col("location").alias("id")).agg(F.transform(
            F.sort_array(F.collect_list(record(pos=F.col("pos"), line=line))), lambda x: x["line"]).alias("lines"))
        m = self.mappings.select(F.col("mapping").alias("key_mapping"), F.col("id").alias("mapping_id"))
        placed = self._found.select("id", F.col("info.address").alias("address"), F.col("key.mapping").alias("key_mapping"))
        return (
            lookup(placed, m, ["key_mapping"], ["id"]).join(per, "id", "left")
            .select("id", F.coalesce("mapping_id", F.lit(0).cast("long")).alias("mapping_id"), "address",
                    F.coalesce("lines", F.array()).alias("lines")))

    def samples(self) -> DataFrame:
        """sample key, location_ids, value, labels."""
        merged = self._merged.withColumn("sample", record(
            a=F.xxhash64("keys", "labels"), b=F.xxhash64(F.lit(7), "keys", "labels")))
        ids = merged.select("sample", F.posexplode("keys").alias("pos", "key"))
        per = lookup(ids, self._found.select("key", "id"), ["key"], ["sample", "pos"]).groupBy("sample").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("location_ids"))
        return merged.select("sample", "value", "labels").join(per, "sample").drop("sample")


def to_pprof(profile: DataFrame, meta: dict, is_diff: bool = False) -> DataFrame:
    """The profile as gzip chunks ``(section, part, bytes)``.

    A protocol-buffer message is the concatenation of its fields and a gzip
    file of its members, so the chunks are encoded in parallel; joined in order
    of (section, part) they are one valid ``.pb.gz``. ``meta``: sample_type,
    sample_unit, period_type, period_unit, period, time_nanos, duration.
    """
    export = Export(profile, is_diff)
    kinds = [meta.get(k, "") for k in ("sample_type", "sample_unit", "period_type", "period_unit")]
    strings = cut_lineage(export.strings(*kinds))
    text = lambda c, out: strings.select(F.col("text").alias(c), F.col("id").alias(out))

    functions = lookups(export.functions, [(text(c, f"{c}_id"), [c]) for c in ("name", "system_name", "filename")], ["id"])
    functions = functions.select("id", F.col("name_id").alias("name"), F.col("system_name_id").alias("system_name"),
                                 F.col("filename_id").alias("filename"), "start_line")
    mappings = export.mappings.select("id", F.col("m.start").alias("memory_start"), F.col("m.limit").alias("memory_limit"),
                                      F.col("mapping.offset").alias("file_offset"), F.col("m.file").alias("file"),
                                      F.col("m.build_id").alias("build"))
    mappings = lookups(mappings, [(text("file", "filename"), ["file"]), (text("build", "build_id"), ["build"])], ["id"])
    mappings = mappings.select("id", "memory_start", "memory_limit", "file_offset", "filename", "build_id",
                               F.lit(1).cast("long").alias("has_functions"))
    # read for the labels and for the result
    samples = cut_lineage(export.samples().withColumn("sample", record(
        a=F.xxhash64("location_ids", "labels"), b=F.xxhash64(F.lit(7), "location_ids", "labels"))))
    pairs = samples.select("sample", F.posexplode("labels").alias("pos", "e")).select("sample", "pos", "e.key", "e.value")
    pairs = lookups(pairs, [(text("key", "k"), ["key"]), (text("value", "v"), ["value"])], ["sample"])
    labels = pairs.groupBy("sample").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "k", "v"))),
        lambda x: record(key=x["k"], str=x["v"])).alias("labels"))
    samples = samples.drop("labels").join(labels, "sample", "left").select(
        "location_ids", F.array("value").alias("values"), F.coalesce("labels", F.array()).alias("labels"))

    header = {t: strings.where(F.col("text") == t).agg(F.max("id")).scalar() for t in set(kinds)}
    pair = lambda a, b: record(type=header[a], unit=header[b])
    number = lambda k: F.lit(int(meta.get(k, 0))).cast("long")
    head = strings.sparkSession.range(1).select(
        F.array(pair(kinds[0], kinds[1])).alias("sample_types"), pair(kinds[2], kinds[3]).alias("period_type"),
        number("time_nanos").alias("time_nanos"), number("duration").alias("duration_nanos"), number("period").alias("period"))
    sections = [
        _chunks(head, 0, None), _chunks(mappings, 1, "mappings"), _chunks(functions, 2, "functions"),
        _chunks(export.locations(), 3, "locations"), _chunks(samples, 4, "samples"),
        # strings are identified by position, so their chunks follow the ids
        _chunks(strings.repartitionByRange("id").sortWithinPartitions("id").select("text"), 5, "strings"),
    ]
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out


def exported_tables(chunks: DataFrame) -> dict[str, DataFrame]:
    """The dictionary tables (see :mod:`stackloom.sources.dictionary`) and samples of :func:`to_pprof`'s chunks, each decoded by itself.

    Strings are known by their place among all strings, so those of a chunk are counted from the chunks before it.
    """
    decoded = decode_files(chunks.select("section", "part", F.col("bytes").alias("content"))).where("p IS NOT NULL")
    # each table is taken from it
    decoded = cut_lineage(decoded.select("section", "part", *[f"p.{t}" for t in ("strings", "functions", "mappings", "locations", "samples")]))
    of = lambda name: decoded.select(F.lit(0).cast("long").alias("profile_id"), F.inline(name))
    texts = decoded.where(F.size("strings") > 0).select(F.lit(0).alias("all"), "part", "strings", F.size("strings").cast("long").alias("n"))
    placed = running_sum(texts, "all", "part", "n", "before")
    strings = placed.select(F.lit(0).cast("long").alias("profile_id"), "before", F.posexplode("strings").alias("pos", "text")).select(
        "profile_id", (F.col("before") + F.col("pos")).alias("idx"), "text")
    samples = of("samples").select("profile_id", "location_ids", F.element_at("values", 1).alias("value"), "labels")
    return {"strings": strings, "functions": of("functions"), "mappings": of("mappings"), "locations": of("locations"), "samples": samples}


def _chunks(df: DataFrame, section: int, field: str | None) -> DataFrame:
    """Encode rows as repeated ``field`` entries of the profile message, one gzip member per batch."""

    def step(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for n, batch in enumerate(batches):
            rows = batch.to_pylist()
            if field is None:
                body = b"".join(wire.encode(r, "profile") for r in rows)
            elif field == "strings":
                body = wire.encode({"strings": [r["text"] for r in rows]}, "profile")
            else:
                body = wire.encode({field: rows}, "profile")
            # a member with a fixed time stamp, so equal input gives equal bytes
            yield pa.RecordBatch.from_pydict({"part": pa.array([part + n], pa.int64()),
                                              "bytes": pa.array([gzip.compress(body, mtime=0)], pa.binary())})

    return df.mapInArrow(step, "part bigint, bytes binary").select(F.lit(section).alias("section"), "part", "bytes")
