"""Profiles in their exchange formats, made from the driver tables, read, checked, and written again."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from stackloom.catalog.base import EVENT, LINE_FRAMES
from stackloom.functions import keys
from stackloom.functions.scalar import labels_text, record
from stackloom.operators.aggregate import merge, rows
from stackloom.plans.flamegraph_table import flamegraph_table, listed
from stackloom.session import shared_folder
from stackloom.sources import dictionary as dic, otlp, pprof, wire
from stackloom.sources.arrow import ingest_arrow_v2
from stackloom.sources.executable import parse_executable_info
from stackloom.sources.labels import check_profile_types
from stackloom.sources.samples import read_samples, write_samples
from stackloom.sources.tables import epoch_micros, event_samples, line_samples, spread, table

T0 = 1_700_000_000 * 10**9


def _stack_text(files=True):
    line = lambda x: F.concat_ws(":", F.coalesce(x["function_name"], F.lit("-")), *([x["function_filename"]] if files else []), x["line"].cast("string"))
    return F.array_join(F.transform("stacktrace", lambda x: F.concat_ws(
        "|", x["address"].cast("string"), F.coalesce(x["mapping_file"], F.lit("-")), F.coalesce(x["mapping_build_id"], F.lit("-")),
        F.array_join(F.transform(x["lines"], line), "<"))), ";")


# --- one profile per supplier: the parts it delivers are functions and locations, its line items samples


def _deliveries(s, d):
    """supplier, parts (distinct, by key), lines; a line names its part by its place among them."""
    joined = spread(table(s, d, "lineitem")).join(table(s, d, "part"), F.expr("l_partkey = p_partkey")).withColumn(
        "place", F.dense_rank().over(Window.partitionBy("l_suppkey").orderBy("l_partkey")).cast("long"))
    part = record(key=F.col("p_partkey"), name=F.col("p_name"), file=F.concat("p_type", F.lit(".go")), size=F.col("p_size").cast("long"))
    line = record(place=F.col("place"), quantity=F.col("l_quantity").cast("long"), number=F.col("l_linenumber").cast("long"),
                  flag=F.col("l_returnflag"))
    return joined.groupBy(F.col("l_suppkey").alias("supplier")).agg(
        F.array_sort(F.collect_set(part)).alias("parts"), F.collect_list(line).alias("lines")).withColumn("n", F.size("parts").cast("long"))


FIXED = ["", "cpu", "nanoseconds", "samples", "count", "flag", "zo-ne", "/bin/app", "b1", "A", "N", "R"]


def _pprof_files(s, d, broken=0):
    """path, content, labels; ``broken``: every so many suppliers lack the second value of their samples."""
    first = len(FIXED)
    fixed = "array(" + ", ".join(f"'{x}'" for x in FIXED) + ")"
    values = "array(l.quantity, (l.number - 1) * 100)"
    if broken:
        values = f"if(supplier % {broken} = 0, array(l.quantity), {values})"
    profile = _deliveries(s, d).selectExpr(
        "concat('supplier-', supplier) AS path", "supplier",
        "array(named_struct('type', 3L, 'unit', 4L), named_struct('type', 1L, 'unit', 2L)) AS sample_types",
        f"""transform(lines, l -> named_struct('location_ids', array(l.place, 1L), 'values', {values}, 'labels', array(
          named_struct('key', 5L, 'str', CASE l.flag WHEN 'A' THEN 9L WHEN 'N' THEN 10L ELSE 11L END),
          named_struct('key', 6L, 'str', 9L)))) AS samples""",
        "array(named_struct('id', 1L, 'memory_start', 4096L, 'memory_limit', 1073741824L, 'file_offset', 0L, 'filename', 7L, 'build_id', 8L)) AS mappings",
        """transform(parts, (p, i) -> named_struct('id', i + 1L, 'mapping_id', if(p.key % 3 = 0, 0L, 1L), 'address', p.key + 4096,
          'lines', slice(array(named_struct('function_id', i + 1L, 'line', p.size), named_struct('function_id', 1L, 'line', 9L)),
            1, cast(1 + p.key % 2 AS int)))) AS locations""",
        f"""transform(parts, (p, i) -> named_struct('id', i + 1L, 'name', {first}L + i, 'system_name', 0L, 'filename', {first}L + n + i,
          'start_line', p.size)) AS functions""",
        f"concat({fixed}, transform(parts, x -> x.name), transform(parts, x -> x.file)) AS strings",
        f"{T0}L + supplier * 1000000000L AS time_nanos", "10000000000L AS duration_nanos",
        "named_struct('type', 1L, 'unit', 2L) AS period_type", "100L AS period")

    def encode(batches):
        for batch in batches:
            some = max(1, batch.num_rows * pprof.RUN_BYTES // max(1, batch.nbytes))
            for start in range(0, batch.num_rows, some):
                rows = batch.slice(start, some)
                content, size = wire.encode_column(rows.to_struct_array(), "profile")
                ends = pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([rows.column("path"), pa.Array.from_buffers(pa.binary(), len(size), [None, ends, pa.py_buffer(content)])],
                                                 names=["path", "content"])

    encoded = profile.mapInArrow(encode, "path string, content binary")
    return encoded.withColumn("labels", F.create_map(F.lit("__name__"), F.lit("parts"), F.lit("path"), F.col("path"), F.lit("flag"), F.lit("own")))


def _ingested(samples):
    return samples.groupBy("name", "sample_type", "sample_unit", "period_type", "period", "duration", "timestamp", "time_nanos", "value",
                           labels_text("labels").alias("labels"), _stack_text().alias("stack")).agg(F.count("*").alias("n"))


def _requests(s, d, broken=0):
    """Export requests: a supplier's dictionary and one profile, under a scope that a third of them leaves nameless."""
    build = otlp.BUILD_ID_ATTRIBUTE
    no_list = "cast(array() AS array<bigint>)"
    times = f"if(l.number % 2 = 0, array({T0}L + l.number, {T0}L + 100), {no_list})"
    values = f"if(l.number % 2 = 0, {no_list}, array(l.quantity, 0L, l.number))"
    stack = f"if(supplier % {broken} = 0, 1000000L, l.place)" if broken else "l.place"
    rows = _deliveries(s, d).selectExpr(
        "concat('supplier-', supplier) AS request_id",
        f"""named_struct('string_table', concat(array('', 'cpu', 'ns', '/bin/app', '{build}', 'flag', 'main'), transform(parts, x -> x.name),
            transform(parts, x -> x.file)),
          'attribute_table', array(named_struct('key_strindex', 0L, 'unit_strindex', 0L, 'value', cast(null AS string)),
            named_struct('key_strindex', 4L, 'unit_strindex', 0L, 'value', 'b1'), named_struct('key_strindex', 5L, 'unit_strindex', 0L, 'value', ' A '),
            named_struct('key_strindex', 5L, 'unit_strindex', 0L, 'value', 'N'), named_struct('key_strindex', 5L, 'unit_strindex', 0L, 'value', '  ')),
          'mapping_table', array(named_struct('memory_start', 0L, 'memory_limit', 0L, 'file_offset', 0L, 'filename_strindex', 0L, 'attribute_indices', {no_list}),
            named_struct('memory_start', 4096L, 'memory_limit', 1073741824L, 'file_offset', 0L, 'filename_strindex', 3L, 'attribute_indices', array(1L))),
          'function_table', concat(array(named_struct('name_strindex', 0L, 'system_name_strindex', 0L, 'filename_strindex', 0L, 'start_line', 0L)),
            transform(parts, (p, i) -> named_struct('name_strindex', 7L + i, 'system_name_strindex', 0L, 'filename_strindex', 7L + n + i, 'start_line', p.size))),
          'location_table', concat(array(named_struct('mapping_index', 0L, 'address', 0L,
              'lines', cast(array() AS array<struct<function_index:bigint,line:bigint,column:bigint>>), 'attribute_indices', {no_list})),
            transform(parts, (p, i) -> named_struct('mapping_index', if(p.key % 3 = 0, 0L, 1L), 'address', p.key + 4096,
              'lines', slice(array(named_struct('function_index', i + 1L, 'line', p.size, 'column', 0L),
                named_struct('function_index', 1L, 'line', 9L, 'column', 0L)), 1, cast(1 + p.key % 2 AS int)), 'attribute_indices', {no_list}))),
          'stack_table', concat(array(named_struct('location_indices', {no_list})),
            transform(parts, (p, i) -> named_struct('location_indices', array(i + 1L, 1L)))),
          'link_table', array(named_struct('trace_id', cast(null AS binary), 'span_id', cast(null AS binary)))) AS dictionary""",
        f"""array(named_struct('attributes', array(named_struct('key', 'host.name', 'value', concat('h', supplier % 3))),
          'scope_profiles', array(named_struct('scope_name', if(supplier % 3 = 0, '', 'my-scope'),
            'attributes', array(named_struct('key', 'flag', 'value', if(supplier % 2 = 0, 'scope', ''))),
            'profiles', array(named_struct('sample_type', named_struct('type_strindex', 1L, 'unit_strindex', 2L),
              'period_type', named_struct('type_strindex', 1L, 'unit_strindex', 2L), 'period', 10L, 'time_nanos', {T0}L,
              'duration_nanos', 1000000L, 'profile_id', cast(null AS binary), 'attribute_indices', {no_list},
              'samples', transform(lines, l -> named_struct('stack_index', {stack}, 'values', {values}, 'timestamps', {times},
                'link_index', 0L, 'attribute_indices', array(CASE l.flag WHEN 'A' THEN 2L WHEN 'N' THEN 3L ELSE 4L END))))))))) AS resource_profiles""")
    # requests come as files; without, each check would make them anew
    path = f"{shared_folder(s, 'requests')}/otlp"
    # a reader holds up to 4,096 rows of a row group at once, whatever their size, so groups are small
    rows.select(*otlp.request_schema().names).write.option("parquet.block.size", 8 << 20).parquet(path)
    return s.read.schema(otlp.request_schema()).parquet(path)


def _arrow_v2(s, d):
    c = F.col
    part = table(s, d, "part").select("p_partkey", "p_name", "p_size")
    line = "named_struct('line', cast(p_size AS bigint), 'column', 0L, 'function_name', p_name, 'function_system_name', p_name, 'function_filename', 'a.go', 'function_start_line', 1L)"
    samples = spread(table(s, d, "lineitem")).join(part, F.expr("l_partkey = p_partkey")).selectExpr(
        "'agent' AS producer", "'samples' AS sample_type", "'count' AS sample_unit", "'cpu' AS period_type", "'nanoseconds' AS period_unit",
        "100L AS period", "0L AS duration", f"timestamp_micros({'unix_date(cast(l_shipdate AS date)) * 86400000000L'} + l_orderkey) AS timestamp",
        "cast(l_quantity AS bigint) AS value", "'delta' AS temporality",
        "named_struct('flag', l_returnflag, 'number', if(l_linenumber > 3, null, l_linenumber)) AS labels",
        f"array(named_struct('address', p_partkey, 'mapping_start', 0L, 'mapping_limit', 100L, 'mapping_offset', 0L, 'mapping_file', 'app', "
        f"'mapping_build_id', 'b', 'lines', array({line}))) AS stacktrace")
    return _ingested(ingest_arrow_v2(samples.drop("temporality")))


# --- ids, comments, types, the stored table


def _content_ids(s, d):
    part = table(s, d, "part")
    line = "named_struct('line', cast(p_size AS bigint), 'column', 0L, 'function_name', p_name, 'function_system_name', p_brand, 'function_filename', p_type, 'function_start_line', p_size + 1L)"
    loc = (f"named_struct('address', if(p_size % 5 = 0, 0L, p_partkey), 'mapping_start', if(p_size % 7 = 0, null, 4096L), 'mapping_limit', 4096L + p_size * 1000L, "
           f"'mapping_offset', 0L, 'mapping_file', p_name, 'mapping_build_id', if(p_size % 3 = 0, '', p_brand), 'lines', array({line}))")
    placed = part.selectExpr("p_partkey AS part", f"{loc} AS loc", f"if(p_size = 1, array(), array({loc}, {loc})) AS stack")
    c = F.col
    first = F.get("loc.lines", F.lit(0))
    return placed.select(
        "part", keys.function_id(first["function_name"], first["function_system_name"], first["function_filename"], first["function_start_line"]).alias("function_id"),
        keys.mapping_id(c("loc.mapping_build_id"), c("loc.mapping_file"), c("loc.mapping_start"), c("loc.mapping_limit"), c("loc.mapping_offset")).alias("mapping_id"),
        keys.location_id(c("loc")).alias("location_id"), keys.stack_id(c("stack")).alias("stack_id"))


def _executables(s, d):
    comment = """CASE p_size % 4 WHEN 0 THEN concat('executableInfo=0x', lower(hex(p_size)), ';', hex(p_partkey), ';0x', hex(p_partkey * 4096))
      WHEN 1 THEN concat('executableInfo=', hex(p_size)) WHEN 2 THEN concat('executableInfo=zz;', p_size) ELSE p_name END"""
    return parse_executable_info(table(s, d, "part").selectExpr("p_partkey", f"{comment} AS comment")).drop("comment")


def _bad_types(s, d):
    named = event_samples(s, d).withColumn("name", F.expr(
        "CASE cast(labels['user'] AS int) % 4 WHEN 0 THEN concat(labels['kind'], ' x') WHEN 1 THEN '' WHEN 2 THEN labels['kind'] ELSE concat('9', labels['kind']) END"))
    return check_profile_types(named).groupBy("profile_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def _stored(s, d):
    """Events written to a samples table, and a selection read back by a stored label and a time range."""
    path = f"{shared_folder(s, 'stored')}/samples"
    write_samples(event_samples(s, d), path, promote=["kind"])
    start, end = 1_704_500_000 * 10**9, 1_706_000_000 * 10**9
    back = read_samples(s, path, start, end, promoted=["kind"])
    return back.select("time_nanos", "timestamp", "value", labels_text("labels").alias("labels"), F.col("label_kind").alias("kind"), "day")


# --- export, read back


def _exported(s, d):
    """Samples of the exported profile, decoded chunk by chunk and resolved against its own tables."""
    meta = dict(sample_type="samples", sample_unit="count", period_type="cpu", period_unit="nanoseconds", period=100, time_nanos=T0, duration=0)
    tables = pprof.exported_tables(pprof.to_pprof(merge(line_samples(s, d)), meta))
    resolved = dic.resolve_stacks(tables["samples"], tables["locations"], tables["functions"], tables["mappings"], tables["strings"])
    line = lambda x: F.concat_ws(":", x["function_name"], x["function_system_name"], x["function_filename"], x["function_start_line"].cast("string"),
                                 x["line"].cast("string"))
    place = lambda x: F.concat_ws("|", x["address"].cast("string"), F.coalesce(x["mapping_file"], F.lit("-")), F.array_join(F.transform(x["lines"], line), "<"))
    return resolved.groupBy(F.array_join(F.transform("stacktrace", place), ";").alias("stack")).agg(F.sum("value").alias("value"))


QUERIES = {
    "ingest_pprof": lambda s, d: _ingested(pprof.ingest_pprof(_pprof_files(s, d, broken=7))),
    "rejected_pprof": lambda s, d: pprof.rejected_files(pprof.decode_files(_pprof_files(s, d, broken=7))),
    "ingest_otlp": lambda s, d: _ingested(otlp.ingest_otlp(_requests(s, d, broken=7))),
    "validate_otlp": lambda s, d: otlp.validate_otlp(_requests(s, d, broken=7)),
    "ingest_arrow_v2": _arrow_v2,
    "content_ids": _content_ids,
    "executable_info": _executables,
    "bad_profile_types": _bad_types,
    "stored_samples": _stored,
    "pprof_round_trip": _exported,
    "flamegraph_table": lambda s, d: listed(flamegraph_table(rows(line_samples(s, d)))),
}

# parts of a supplier by rank; part 1 is the second location of every stack
DELIVERED = """x AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey),
  p AS (SELECT DISTINCT l_suppkey, p_partkey, p_name, p_type || '.go' AS f, p_size FROM x),
  one AS (SELECT l_suppkey, min(p_partkey) AS k FROM p GROUP BY 1),
  lone AS (SELECT p.* FROM p JOIN one ON p.l_suppkey = one.l_suppkey AND p_partkey = k),
  loc AS (SELECT p.l_suppkey, p.p_partkey, (p.p_partkey + 4096) || '|' || CASE WHEN p.p_partkey % 3 = 0 THEN '-|-' ELSE '/bin/app|b1' END || '|'
      || p.p_name || ':' || p.f || ':' || p.p_size || CASE WHEN p.p_partkey % 2 = 1 THEN '<' || lone.p_name || ':' || lone.f || ':9' ELSE '' END AS txt
    FROM p JOIN lone USING (l_suppkey)),
  s AS (SELECT x.l_suppkey AS supplier, CAST(l_quantity AS BIGINT) AS quantity, CAST(l_linenumber AS BIGINT) AS number, l_returnflag AS flag, a.txt || ';' || b.txt AS stack
    FROM x JOIN loc a ON a.l_suppkey = x.l_suppkey AND a.p_partkey = x.p_partkey
      JOIN one ON one.l_suppkey = x.l_suppkey JOIN loc b ON b.l_suppkey = x.l_suppkey AND b.p_partkey = one.k)"""


def _hash(*parts):
    return "sha256(" + " || ".join(f"length({p}) || ':' || {p}" for p in parts) + ")"


def _text(x):
    return f"coalesce(CAST({x} AS VARCHAR), '')"


FUNCTION_ID = _hash(_text("p_size + 1"), "p_name", "p_brand", "p_type")
MAPPED = "CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_brand END"
MAPPING_ID = f"CASE WHEN p_size % 7 = 0 THEN {_hash(MAPPED, _text('NULL'), _text('0'))} ELSE {_hash(MAPPED, _text('(p_size * 1000 + 4095) // 4096 * 4096'), _text('0'))} END"

SQL = {
    "ingest_pprof": f"""WITH {DELIVERED}, typed AS (SELECT *, unnest(['samples', 'cpu']) AS sample_type, unnest(['count', 'nanoseconds']) AS sample_unit,
          unnest([quantity, (number - 1) * 100]) AS value FROM s WHERE supplier % 7 <> 0)
      SELECT 'parts' AS name, sample_type, sample_unit, 'cpu' AS period_type, CAST(100 AS BIGINT) AS period, 10000000000 AS duration,
        1700000000000 + supplier * 1000 AS "timestamp", {T0} + supplier * 1000000000 AS time_nanos, value,
        'exported_flag=' || flag || ',flag=own,path=supplier-' || supplier || ',zo_ne=A' AS labels, stack, count(*) AS n
      FROM typed WHERE value <> 0 GROUP BY ALL""",
    "rejected_pprof": """SELECT DISTINCT 'supplier-' || l_suppkey AS path, 'values do not match sample types' AS error FROM lineitem JOIN part ON l_partkey = p_partkey
      WHERE l_suppkey % 7 = 0""",
    "ingest_otlp": f"""WITH {DELIVERED}, timed AS (
        SELECT *, unnest([{T0} + number, {T0} + 100]) AS time_nanos, 1 AS value FROM s WHERE number % 2 = 0
        UNION ALL SELECT *, {T0}, unnest([quantity, number]) FROM s WHERE number % 2 = 1)
      SELECT CASE WHEN supplier % 3 = 0 THEN 'unknown' ELSE 'my_scope' END AS name, 'cpu' AS sample_type, 'ns' AS sample_unit, 'cpu' AS period_type,
        CAST(10 AS BIGINT) AS period, CAST(1000000 AS BIGINT) AS duration, time_nanos // 1000000 AS "timestamp", time_nanos, CAST(value AS BIGINT) AS value,
        CASE WHEN supplier % 2 = 0 THEN 'flag=scope,' WHEN flag = 'R' THEN '' ELSE 'flag=' || flag || ',' END || 'host_name=h' || (supplier % 3) AS labels,
        stack, count(*) AS n FROM timed WHERE supplier % 7 <> 0 AND value <> 0 GROUP BY ALL""",
    "validate_otlp": """SELECT DISTINCT 'supplier-' || l_suppkey AS request_id, 'sample stack out of bounds' AS error FROM lineitem JOIN part ON l_partkey = p_partkey
      WHERE l_suppkey % 7 = 0""",
    "ingest_arrow_v2": """WITH x AS (SELECT *, epoch_us(CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP)) + l_orderkey AS us FROM lineitem JOIN part ON l_partkey = p_partkey)
      SELECT 'agent' AS name, 'samples' AS sample_type, 'count' AS sample_unit, 'cpu' AS period_type, CAST(100 AS BIGINT) AS period, CAST(0 AS BIGINT) AS duration,
        us // 1000 AS "timestamp", us * 1000 AS time_nanos, CAST(l_quantity AS BIGINT) AS value,
        'flag=' || l_returnflag || CASE WHEN l_linenumber > 3 THEN '' ELSE ',number=' || l_linenumber END AS labels,
        p_partkey || '|app|b|' || p_name || ':a.go:' || p_size AS stack, count(*) AS n FROM x GROUP BY ALL""",
    "content_ids": f"""WITH i AS (SELECT *, {FUNCTION_ID} AS f, {MAPPING_ID} AS m FROM part),
      l AS (SELECT *, {_hash("CASE WHEN p_size % 7 = 0 THEN '' ELSE m END", _text("CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_partkey END"),
                             "CASE WHEN p_size % 5 = 0 OR p_partkey = 0 THEN f || chr(31) || p_size ELSE '' END")} AS l FROM i)
      SELECT p_partkey AS part, f AS function_id, m AS mapping_id, l AS location_id,
        CASE WHEN p_size = 1 THEN 'empty-stacktrace' ELSE sha256(l || l) END AS stack_id FROM l""",
    "executable_info": """SELECT p_partkey, CAST(p_size AS BIGINT) AS elf_type, CASE WHEN p_size % 4 = 0 THEN p_partkey END AS load_offset,
        CASE WHEN p_size % 4 = 0 THEN p_partkey * 4096 END AS load_vaddr FROM part WHERE p_size % 4 IN (0, 1)""",
    "bad_profile_types": f"""WITH {EVENT}, t AS (SELECT value, CASE CAST("user" AS BIGINT) % 4 WHEN 0 THEN kind || ' x' WHEN 1 THEN '' WHEN 2 THEN kind
          ELSE '9' || kind END || ':wall:nanoseconds:wall:nanoseconds' AS profile_type FROM event_samples)
      SELECT profile_type, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM t
      WHERE NOT regexp_full_match(profile_type, '[a-zA-Z_:][a-zA-Z0-9_:]*') GROUP BY 1""",
    "stored_samples": f"""WITH {EVENT} SELECT time_nanos, "timestamp", value, 'kind=' || kind || ',shard=' || shard || ',user=' || "user" AS labels, kind,
        CAST(time_nanos // 86400000000000 AS INTEGER) AS day FROM event_samples
      WHERE time_nanos BETWEEN 1704500000000000000 AND 1706000000000000000""",
    # locations of one address of one mapping are one: the least of their variants
    "pprof_round_trip": f"""WITH {LINE_FRAMES}, locs AS (
        SELECT sid, loc, address, build_id, CASE WHEN mapping_start IS NULL THEN '-' ELSE mapping_file END AS file, mapping_start IS NULL AS unmapped,
          list(struct_pack(name := fn, system_name := coalesce(sysname, ''), filename := filename, start_line := start_line, line := line) ORDER BY pos)
            FILTER (WHERE symbolized) AS lines
        FROM line_frames GROUP BY ALL),
      least AS (SELECT build_id, address, min(coalesce(lines, [])) AS lines FROM locs WHERE NOT unmapped GROUP BY ALL),
      shown AS (SELECT sid, loc, l.address || '|' || file || '|' || array_to_string(list_transform(CASE WHEN unmapped THEN l.lines ELSE m.lines END,
          lambda x: concat_ws(':', x.name, x.system_name, x.filename, x.start_line, x.line)), '<') AS t
        FROM locs l LEFT JOIN least m ON m.build_id = l.build_id AND m.address = l.address),
      stacks AS (SELECT sid, string_agg(t, ';' ORDER BY loc) AS stack FROM shown GROUP BY 1)
      SELECT stack, CAST(sum(value * period) AS BIGINT) AS value FROM stacks JOIN line_samples USING (sid) GROUP BY 1""",
    "flamegraph_table": f"""WITH {LINE_FRAMES}, keyed AS (SELECT *, CASE WHEN symbolized THEN fn ELSE '0x' || lower(to_hex(address)) END AS k, n_frames - idx AS depth,
          value * period AS v FROM line_frames),
      paths AS (SELECT *, string_agg(k, '/') OVER w AS path, lag(k) OVER (PARTITION BY sid ORDER BY depth) AS parent FROM keyed
        WINDOW w AS (PARTITION BY sid ORDER BY depth ROWS UNBOUNDED PRECEDING))
      SELECT CAST(depth AS INTEGER) AS depth, k AS frame, parent, min(address) AS address, CAST(arg_min(pos, address) AS INTEGER) AS line_index,
        CASE WHEN any_value(mapping_start) IS NOT NULL THEN any_value(mapping_file) END AS mapping_file,
        CASE WHEN any_value(mapping_start) IS NOT NULL THEN any_value(build_id) END AS mapping_build_id,
        CASE WHEN any_value(symbolized) THEN coalesce(any_value(sysname), '') END AS system_name, arg_min(filename, address) AS filename,
        CAST(arg_min(start_line, address) AS BIGINT) AS start_line, CAST(sum(v) AS BIGINT) AS cumulative,
        CAST(sum(CASE WHEN idx = 0 THEN v ELSE 0 END) AS BIGINT) AS flat, CAST(0 AS BIGINT) AS diff
      FROM paths GROUP BY path, depth, k, parent""",
}
