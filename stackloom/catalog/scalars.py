"""Scalar functions, applied to whole tables."""

from pyspark.sql import functions as F

from stackloom.functions.scalar import record
from stackloom.catalog.base import EVENT, LINE, LINE_FRAMES
from stackloom.functions import keys, scalar
from stackloom.operators.frames import frames

from stackloom.operators.symbolize import program_header, symbol_address
from stackloom.sources.tables import event_samples, line_samples, spread, table

STEP = 30 * 86400 * 10**9



def _per_bucket(s, d):
    rows = line_samples(s, d).where("duration <> 0")
    return rows.groupBy(scalar.step_bucket("time_nanos", STEP).alias("bucket")).agg(
        F.sum(scalar.scaled_value()).alias("total"), F.min("duration").alias("shortest"),
        F.min("time_nanos").alias("first"), F.max("time_nanos").alias("last"))


def _frame_rows(s, d, *fields):
    return line_samples(s, d).select("value", F.inline(frames("stacktrace", fields)))


def _row_names(s, d):
    rows = _frame_rows(s, d, "name", "address", "mapping_file")
    several = _frame_rows(s, d, "mapping_file").agg(F.min("mapping_file") != F.max("mapping_file")).scalar()
    name = scalar.row_name("name", "address", "mapping_file", several)
    return rows.groupBy(name.alias("row")).agg(F.sum("value").alias("total"))


def _mappings(s, d):
    """Synthetic load ranges of each part's binary, as they would differ between hosts."""
    c = F.col
    return table(s, d, "part").select(
        (F.lit(65536) + c("p_partkey") * 8192).alias("lo"),
        (F.lit(65536) + c("p_partkey") * 8192 + 4097 + (c("p_partkey") % 5000)).alias("hi"),
        (c("p_size") % 3 * 4096).cast("long").alias("off"), c("p_brand").alias("file"),
        F.when(c("p_size") % 2 == 0, c("p_type")).otherwise("").alias("build_id"))


def _mapping_ids(s, d):
    rows = _mappings(s, d)
    ids = rows.select(keys.mapping_id("build_id", "file", "lo", "hi", "off").alias("id"), "build_id", "file",
                      keys.rounded_size("lo", "hi").alias("size"), "off")
    name = keys.mapping_name("build_id", "file")
    return ids.groupBy("id", name.alias("name"), "size", "off").agg(F.count("*").alias("n")).drop("id")


def _headers(s, d):
    """Per binary (one of five types of file) three load segments."""
    h = lambda off, vaddr, size: record(
        off=F.lit(off).cast("long"), vaddr=F.lit(vaddr).cast("long"), memsz=F.lit(size).cast("long"))
    kinds = F.array(F.lit("EXEC"), F.lit("DYN"), F.lit("REL"), F.lit("DYN"), F.lit("CORE"))
    return table(s, d, "region").select(
        F.concat(F.lit("b"), F.col("r_regionkey").cast("string")).alias("build_id"),
        F.get(kinds, F.col("r_regionkey")).alias("elf_type"), F.lit(1).alias("text_header"),
        F.array(h(0, 0, 4096), h(4096, 1052672, 65536), h(69632, 2097152, 4096)).alias("headers"))


def _elf_base(s, d):
    c = F.col
    rows = spread(table(s, d, "lineitem")).select(
        F.concat(F.lit("b"), (c("l_suppkey") % 5).cast("string")).alias("build_id"),
        F.lit(4194304).cast("long").alias("mapping_start"),
        F.when(c("l_linenumber") == 7, F.lit(0)).otherwise(4194304 + 4096 * c("l_linenumber")).cast("long").alias("mapping_limit"),
        F.when(c("l_partkey") % 2 == 0, 4096).otherwise(0).cast("long").alias("mapping_offset"),
        (F.lit(4194304) + c("l_partkey") % 9000).cast("long").alias("address"))
    out = symbol_address(program_header(rows, _headers(s, d)))
    return out.groupBy("build_id", "mapping_limit", "mapping_offset", "address", "symbol_address", "base_error").agg(
        F.count("*").alias("n"))


QUERIES = {
    "step_bucket": lambda s, d: event_samples(s, d).select("time_nanos", "value",
                                                           scalar.step_bucket("time_nanos", STEP // 7).alias("bucket")),
    "value_times_period": lambda s, d: line_samples(s, d).unionByName(event_samples(s, d)).select(
        "time_nanos", scalar.scaled_value().alias("value"), scalar.result_type().alias("type"),
        scalar.result_unit().alias("unit")),
    "effective_duration": lambda s, d: _per_bucket(s, d).select(
        "bucket", scalar.effective_duration("first", "last", "shortest", STEP).alias("duration")),
    "per_second": lambda s, d: _per_bucket(s, d).select(
        "bucket", scalar.per_second("total", scalar.effective_duration("first", "last", "shortest", STEP), F.lit(True)).alias("cpu"),
        scalar.per_second("total", scalar.effective_duration("first", "last", "shortest", STEP), F.lit(False)).alias("other")),
    "basename": lambda s, d: _frame_rows(s, d, "mapping_file", "filename").groupBy(
        scalar.basename("mapping_file").alias("base"), scalar.basename("filename").alias("file")).agg(F.sum("value").alias("total")),
    "filename_match": lambda s, d: _frame_rows(s, d, "filename").where(scalar.filename_matches("filename", "nation.go")
                                                           | scalar.filename_matches("filename", "src/economy.go")
                                                           | scalar.filename_matches("filename", "egion.go")).groupBy(
        "filename").agg(F.sum("value").alias("total")),
    "mapping_id_rounding": _mapping_ids,
    "normalize_address": lambda s, d: line_samples(s, d).select("value", F.inline("stacktrace")).groupBy(
        keys.normalized_address("address", "mapping_start").alias("address"), "mapping_file").agg(F.sum("value").alias("total")),
    "elf_base": _elf_base,
    "labelset_order": lambda s, d: scalar.ordered_label_sets(event_samples(s, d)).select(
        "label_set", "text_key", F.array_join(F.transform("number_key", lambda x: x.cast("long").cast("string")), ",").alias("number_key")),
    "row_name": _row_names,
}

BUCKETS = f"""WITH {LINE}, b AS (SELECT time_nanos // {STEP} * {STEP} AS bucket, CAST(sum(value * period) AS BIGINT) AS total,
    CASE WHEN min(time_nanos) <> max(time_nanos) THEN {STEP} ELSE min(duration) END AS duration
  FROM line_samples WHERE duration <> 0 GROUP BY 1)"""

SQL = {
    "step_bucket": f"WITH {EVENT} SELECT time_nanos, value, time_nanos // {STEP // 7} * {STEP // 7} AS bucket FROM event_samples",
    "value_times_period": f"""WITH {LINE}, {EVENT}
      SELECT time_nanos, value * period AS value, period_type AS type, period_unit AS unit FROM line_samples
      UNION ALL SELECT time_nanos, value, sample_type, sample_unit FROM event_samples""",
    "effective_duration": BUCKETS + " SELECT bucket, CAST(duration AS BIGINT) AS duration FROM b",
    "per_second": BUCKETS + """ SELECT bucket, CAST(total AS DOUBLE) / CAST(duration AS DOUBLE) AS cpu,
      CAST(total AS DOUBLE) / (CAST(duration AS DOUBLE) / 1e9) AS other FROM b""",
    "basename": f"""WITH {LINE_FRAMES} SELECT regexp_replace(mapping_file, '^.*/', '') AS base,
      regexp_replace(filename, '^.*/', '') AS file, CAST(sum(value) AS BIGINT) AS total FROM line_frames GROUP BY 1, 2""",
    "filename_match": f"""WITH {LINE_FRAMES} SELECT filename, CAST(sum(value) AS BIGINT) AS total FROM line_frames
      WHERE filename IN ('/go/src/nation.go', 'src/economy.go') GROUP BY 1""",
    "mapping_id_rounding": """SELECT CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END AS name,
      (4097 + p_partkey % 5000 + 4095) // 4096 * 4096 AS size, CAST(p_size % 3 * 4096 AS BIGINT) AS off, count(*) AS n
      FROM part GROUP BY 1, 2, 3""",
    "normalize_address": f"""WITH {LINE_FRAMES} SELECT address - coalesce(mapping_start, 0) AS address, mapping_file,
      CAST(sum(value) AS BIGINT) AS total FROM line_frames WHERE pos = 0 GROUP BY 1, 2""",
    "elf_base": """WITH r AS (SELECT 'b' || (l_suppkey % 5) AS build_id, l_suppkey % 5 AS kind, CAST(4194304 AS BIGINT) AS mapping_start,
        CAST(CASE WHEN l_linenumber = 7 THEN 0 ELSE 4194304 + 4096 * l_linenumber END AS BIGINT) AS mapping_limit,
        CAST(CASE WHEN l_partkey % 2 = 0 THEN 4096 ELSE 0 END AS BIGINT) AS mapping_offset,
        4194304 + l_partkey % 9000 AS address FROM lineitem),
      h(o, v, m) AS (VALUES (0, 0, 4096), (4096, 1052672, 65536), (69632, 2097152, 4096)),
      k AS (SELECT DISTINCT build_id, kind, mapping_start, mapping_limit, mapping_offset, address FROM r),
      m AS (SELECT k.*, h.*, address - mapping_start + mapping_offset AS pos_ FROM k, h
        WHERE mapping_limit > mapping_start AND mapping_offset < o + m AND o < mapping_offset + mapping_limit - mapping_start
          AND mapping_offset >= CASE WHEN o > v % 4096 THEN o - v % 4096 ELSE 0 END
          AND NOT (mapping_offset > o AND o + m < mapping_offset + 4096
                   AND mapping_offset + mapping_limit - mapping_start >= o + m + 4096)),
      c AS (SELECT build_id, mapping_limit, mapping_offset, address, count(*) AS n,
          count(CASE WHEN pos_ >= o AND pos_ < o + m THEN 1 END) AS hits,
          max(CASE WHEN pos_ >= o AND pos_ < o + m THEN o END) AS ho, max(CASE WHEN pos_ >= o AND pos_ < o + m THEN v END) AS hv,
          max(o) AS oo, max(v) AS ov FROM m GROUP BY 1, 2, 3, 4),
      f AS (SELECT k.*, coalesce(c.n, 0) AS n,
          CASE WHEN mapping_limit = 0 THEN NULL WHEN coalesce(c.n, 0) = 0 THEN 'no program header matches mapping'
            WHEN c.n > 1 AND hits = 0 THEN 'no program header matches file offset'
            WHEN c.n > 1 AND hits > 1 THEN 'several program headers match file offset' END AS err,
          CASE WHEN mapping_limit = 0 THEN 4096 WHEN c.n = 1 THEN oo ELSE ho END AS ho,
          CASE WHEN mapping_limit = 0 THEN 1052672 WHEN c.n = 1 THEN ov ELSE hv END AS hv
        FROM k LEFT JOIN c USING (build_id, mapping_limit, mapping_offset, address)),
      b AS (SELECT *, CASE WHEN err IS NOT NULL THEN NULL WHEN kind IN (0, 1, 3) THEN mapping_start - mapping_offset + ho - hv
          WHEN kind = 2 AND mapping_offset = 0 THEN mapping_start END AS base FROM f)
      SELECT r.build_id, r.mapping_limit, r.mapping_offset, r.address, CAST(r.address - base AS BIGINT) AS symbol_address,
        coalesce(err, CASE WHEN base IS NULL THEN 'unsupported file type or offset' END) AS base_error, count(*) AS n
      FROM r JOIN b USING (build_id, mapping_limit, mapping_offset, address) GROUP BY 1, 2, 3, 4, 5, 6""",
    "labelset_order": f"""WITH {EVENT} SELECT DISTINCT
      '{{kind: ' || kind || ', shard: ' || shard || ', user: ' || "user" || '}}' AS label_set,
      'kind=' || kind AS text_key, shard || ',' || "user" AS number_key FROM event_samples""",
    "row_name": f"""WITH {LINE_FRAMES} SELECT CASE WHEN fn IS NOT NULL THEN
        CASE WHEN mapping_file IS NOT NULL THEN '[' || regexp_replace(mapping_file, '^.*/', '') || ']' ELSE '' END || ' ' || fn
        ELSE '0x' || lower(to_hex(address)) END AS row, CAST(sum(value) AS BIGINT) AS total
      FROM line_frames GROUP BY 1""",
}
