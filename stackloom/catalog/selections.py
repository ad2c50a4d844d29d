"""Scans, matchers, ranges and listings."""

from pyspark.sql import functions as F

from stackloom.catalog.base import EVENT, LINE, LINE_FRAMES
from stackloom.functions.scalar import labels_text
from stackloom.operators import aggregate, metadata, select
from stackloom.operators.diff import union_distinct
from stackloom.operators.select import ProfileType, label
from stackloom.sources.labels import keep_sample_types, with_labels
from stackloom.sources.tables import event_samples, line_samples

CPU = ("process_cpu", "samples", "count", "cpu", "nanoseconds")
# two instants inside the data, ns
T1, T2 = 883612800 * 10**9, 946684800 * 10**9


def _rows(df):
    return df.select("time_nanos", "duration", "value", label("segment").alias("segment"), label("zone").alias("zone"))


ROWS = "SELECT time_nanos, duration, value, segment, zone FROM line_samples"


def _matching(*matchers):
    return lambda spark, sf: _rows(select.matching(line_samples(spark, sf), list(matchers)))


def _where(condition):
    return f"WITH {LINE} {ROWS} WHERE {condition}"


def _listing(df, column):
    return df.select(F.col(column).alias("value"))


def _kept(spark, sf):
    both = line_samples(spark, sf).unionByName(event_samples(spark, sf))
    kept = keep_sample_types(both, [("wall", "nanoseconds"), ("alloc", "bytes")])
    return kept.select("name", "sample_type", "time_nanos", "value")


def _relabelled(spark, sf):
    df = with_labels(line_samples(spark, sf), {"zone": "override", "cluster": "c1"})
    return df.groupBy(labels_text("labels").alias("labels")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


QUERIES = {
    "scan_samples": lambda s, d: line_samples(s, d).select(
        "name", "sample_type", "sample_unit", "period_type", "period_unit", "period", "duration", "timestamp",
        "time_nanos", "value", labels_text("labels").alias("labels"), F.size("stacktrace").alias("depth")),
    "select_type": lambda s, d: _rows(select.select_type(line_samples(s, d), ProfileType(*CPU, delta=True))),
    "select_non_delta": lambda s, d: _rows(select.select_type(line_samples(s, d), ProfileType(*CPU))),
    "label_eq": _matching(("segment", "=", "MACHINERY")),
    "label_absent": _matching(("zone", "=", "")),
    "label_ne": _matching(("segment", "!=", "MACHINERY")),
    "label_present": _matching(("zone", "!=", "")),
    "label_regex": _matching(("segment", "=~", "^(MACH|FURN)")),
    "label_not_regex": _matching(("segment", "!~", "^(MACH|FURN)")),
    "select_multi": _matching(("segment", "!=", "MACHINERY"), ("zone", "=", "z1"), ("priority", "=~", "URGENT|LOW")),
    "range_inclusive": lambda s, d: _rows(select.in_range(line_samples(s, d), T1, T2)),
    "range_exclusive": lambda s, d: _rows(select.in_open_range(line_samples(s, d), T1, T2)),
    "select_instant": lambda s, d: _rows(select.at_instant(line_samples(s, d), T1)),
    "keep_types": _kept,
    "with_labels": _relabelled,
    "profile_types": lambda s, d: aggregate.profile_types(line_samples(s, d).unionByName(event_samples(s, d))),
    "has_data": lambda s, d: aggregate.has_profile_data(line_samples(s, d)),
    "label_names": lambda s, d: _listing(metadata.label_names(
        line_samples(s, d), ProfileType(*CPU, delta=True), [("segment", "!=", "MACHINERY")], T1, T2), "label"),
    "label_values": lambda s, d: metadata.label_values(line_samples(s, d), "zone"),
    "mapping_files": lambda s, d: _listing(metadata.mapping_files(line_samples(s, d), T1, T2), "mapping_file"),
    "metadata_labels": lambda s, d: _listing(metadata.metadata_labels(event_samples(s, d), T1, 2**62), "label"),
    "union_distinct": lambda s, d: union_distinct(
        metadata.label_values(line_samples(s, d), "segment"), metadata.label_values(event_samples(s, d), "kind")),
}

PAIRS = """array_to_string(list_filter(
  [CASE WHEN {cluster} IS NOT NULL THEN 'cluster=' || {cluster} END, CASE WHEN priority <> '' THEN 'priority=' || priority END,
   CASE WHEN returnflag <> '' THEN 'returnflag=' || returnflag END,
   CASE WHEN segment <> '' THEN 'segment=' || segment END, CASE WHEN {zone} <> '' THEN 'zone=' || {zone} END],
  lambda x: x IS NOT NULL), ',')"""

SQL = {
    "scan_samples": f"""WITH {LINE} SELECT name, sample_type, sample_unit, period_type, period_unit, period, duration,
      "timestamp", time_nanos, value, {PAIRS.format(cluster='CAST(NULL AS VARCHAR)', zone='zone')} AS labels,
      CAST(CASE WHEN empty_stack THEN 0 WHEN r_regionkey = 4 THEN 5 ELSE 4 END AS INTEGER) AS depth FROM line_samples""",
    "select_type": _where("duration <> 0"),
    "select_non_delta": _where("duration = 0"),
    "label_eq": _where("segment = 'MACHINERY'"),
    "label_absent": _where("zone IS NULL OR zone = ''"),
    "label_ne": _where("segment IS NULL OR segment <> 'MACHINERY'"),
    "label_present": _where("zone <> ''"),
    "label_regex": _where("regexp_matches(segment, '^(MACH|FURN)')"),
    "label_not_regex": _where("NOT regexp_matches(segment, '^(MACH|FURN)')"),
    "select_multi": _where("(segment IS NULL OR segment <> 'MACHINERY') AND zone = 'z1' "
                           "AND (priority LIKE '%URGENT%' OR priority LIKE '%LOW%')"),
    "range_inclusive": _where(f"time_nanos BETWEEN {T1} AND {T2}"),
    "range_exclusive": _where(f"time_nanos > {T1} AND time_nanos < {T2}"),
    "select_instant": _where(f'"timestamp" = {T1 // 10**6}'),
    "keep_types": f"WITH {EVENT} SELECT name, sample_type, time_nanos, value FROM event_samples",
    "with_labels": f"""WITH {LINE} SELECT {PAIRS.format(cluster="'c1'", zone="'override'")} AS labels, count(*) AS n,
      CAST(sum(value) AS BIGINT) AS total FROM line_samples GROUP BY 1""",
    "profile_types": f"""WITH {LINE}, {EVENT}
      SELECT DISTINCT name, sample_type, sample_unit, period_type, period_unit, duration > 0 AS delta FROM line_samples
      UNION SELECT DISTINCT name, sample_type, sample_unit, period_type, period_unit, duration > 0 FROM event_samples""",
    "has_data": f"WITH {LINE} SELECT count(*) > 0 AS has_data FROM line_samples",
    "label_names": f"""WITH {LINE}, kept AS (SELECT * FROM line_samples WHERE duration <> 0
        AND (segment IS NULL OR segment <> 'MACHINERY') AND time_nanos > {T1} AND time_nanos < {T2})
      SELECT 'priority' AS value FROM kept WHERE priority IS NOT NULL UNION SELECT 'returnflag' FROM kept
      UNION SELECT 'segment' FROM kept WHERE segment IS NOT NULL UNION SELECT 'zone' FROM kept""",
    "label_values": f"WITH {LINE} SELECT DISTINCT zone AS value FROM line_samples WHERE zone <> ''",
    "mapping_files": f"""WITH {LINE_FRAMES} SELECT DISTINCT mapping_file AS value FROM line_frames
      WHERE mapping_file IS NOT NULL AND time_nanos BETWEEN {T1} AND {T2}""",
    "metadata_labels": f"""WITH {EVENT} SELECT 'user' AS value FROM event_samples WHERE time_nanos >= {T1}
      UNION SELECT 'kind' FROM event_samples WHERE time_nanos >= {T1}
      UNION SELECT 'shard' FROM event_samples WHERE time_nanos >= {T1}""",
    "union_distinct": f"""WITH {LINE}, {EVENT} SELECT segment AS value FROM line_samples WHERE segment <> ''
      UNION SELECT kind FROM event_samples""",
}
