"""Merges, series, comparisons."""

from pyspark.sql import functions as F

from stackloom.catalog.base import EVENT, LINE, LINE_FRAMES
from stackloom.catalog.filtering import TEXT, TEXT_FIELDS, _text
from stackloom.catalog.selections import CPU, T1, T2
from stackloom.functions.scalar import int_div, labels_text
from stackloom.operators import aggregate, diff, select, series
from stackloom.operators.frames import frames
from stackloom.operators.select import ProfileType, label
from stackloom.plans import query
from stackloom.sources.tables import event_samples, line_samples
from stackloom.streaming.agents import agents

STEP = 30 * 86400 * 10**9
HOUR = 3600 * 10**9


def _stack_text():
    return F.array_join(F.transform(frames("stacktrace", TEXT_FIELDS), _text), ";")


def _merge(s, d):
    deltas = select.select_type(line_samples(s, d), ProfileType(*CPU, delta=True))
    out = aggregate.merge(deltas, T1, T2, delta=True)
    # several stacks differ only in lines or binaries and read the same
    return out.groupBy(_stack_text().alias("stack"), "period").agg(
        F.count("*").alias("stacks"), F.sum("value").alias("value"), F.max("value_per_second").alias("top_rate"))


def _merge_by_label(s, d):
    out = aggregate.merge(line_samples(s, d), T1, T2, group_by=("labels.segment", "labels.zone"))
    return out.groupBy(_stack_text().alias("stack"), labels_text("labels").alias("labels")).agg(F.sum("value").alias("value"))


def _instant(s, d):
    day = line_samples(s, d).where("duration <> 0")
    out = aggregate.single(day, T1, delta=True)
    return out.groupBy(_stack_text().alias("stack")).agg(
        F.sum("value").alias("value"), F.sum("duration").alias("duration"), F.max("value_per_second").alias("top_rate"))


def _deltas(s, d):
    return line_samples(s, d).where("duration <> 0")


def _sides(s, d):
    rows = select.select_type(line_samples(s, d), ProfileType(*CPU, delta=True))
    return aggregate.merge(rows, 0, T1 - 1), aggregate.merge(rows, T1, T2)


def _diff(absolute):
    def run(s, d):
        deltas = select.select_type(line_samples(s, d), ProfileType(*CPU, delta=True))
        rows = diff.compare_samples(deltas, select.range_predicate(0, T1 - 1), select.range_predicate(T1, T2), absolute)
        return rows.groupBy(_stack_text().alias("stack")).agg(F.sum("value").alias("value"), F.sum("diff").alias("diff"))
    return run


def _range_limit(s, d):
    rows = series.query_range(_deltas(s, d), STEP, ["segment"])
    return series.limit_series(rows, ["segment"], 2).select("bucket", "segment", "value")


def _series_arrays(s, d):
    rows = series.query_range(_deltas(s, d), STEP, ["segment"])
    point = lambda p: F.concat_ws(":", *[p[c].cast("string") for c in ("bucket", "value", "duration")])
    return series.series_arrays(rows, ["segment"]).select(
        "segment", F.array_join(F.transform("points", point), ",").alias("points"))


def _intersection(s, d):
    rows = line_samples(s, d).select("labels", F.explode(F.transform(frames("stacktrace", TEXT_FIELDS), _text)).alias("frame"))
    rows = rows.select("labels", "frame", F.explode(F.array(F.lit("segment"), F.lit("zone"), F.lit("returnflag"))).alias("label"))
    rows = rows.select("frame", "label", F.try_element_at("labels", F.col("label")).alias("value"))
    return diff.intersect_labels(rows, ["frame"], "label", "value")


def _agents(s, d):
    c = F.col
    pushes = event_samples(s, d).select(
        F.when(label("shard") != "0", F.concat(F.lit("node"), label("shard"))).alias("node"),
        F.concat(F.lit("10.0.0."), (label("user").cast("long") % 50).cast("string")).alias("address"),
        "time_nanos", (c("value") * 1000).alias("push_nanos"), F.when(label("kind") == "error", "failed").alias("error"))
    return agents(pushes, expiry_nanos=24 * HOUR)


def punctuated_events(s, d):
    """Events of which half carry as one label what the others carry as two."""
    kind, shard = label("kind"), label("shard")
    one = F.create_map(F.lit("kind"), F.concat(kind, F.lit(",shard="), shard))
    two = F.create_map(F.lit("kind"), kind, F.lit("shard"), shard)
    half = int_div(label("user").cast("long"), 4) % 2 == 0
    return event_samples(s, d).withColumn("labels", F.when(half, one).otherwise(two))


def _query(report_of, *columns, group_by=()):
    """The profile of a selection or a comparison, through the query composer."""
    def run(s, d):
        rows = query.run(line_samples(s, d), query.Query(report_of, "profile", group_by)).rows
        keys = [labels_text("labels").alias("labels")] if group_by else []
        return rows.groupBy(_stack_text().alias("stack"), *keys).agg(*[F.sum(c).alias(c) for c in columns])
    return run


DELTA_CPU = ProfileType(*CPU, delta=True)

QUERIES = {
    "range_gauge_punctuated": lambda s, d: series.query_range_gauge(punctuated_events(s, d), 6 * HOUR),
    "query_single_by_label": _query(query.Selection(DELTA_CPU, at=T1), "value", group_by=("labels.segment",)),
    "query_diff_single_merge": _query(query.Diff(query.Selection(DELTA_CPU, at=T1), query.Selection(DELTA_CPU, T1, T2), True),
                                      "value", "diff"),
    "query_from": _query(query.Selection(DELTA_CPU, start=T1), "value"),
    "query_until": _query(query.Selection(DELTA_CPU, end=T1), "value"),
    "merge": _merge,
    "merge_by_label": _merge_by_label,
    "single": _instant,
    "range_delta": lambda s, d: series.query_range(_deltas(s, d), STEP).drop("value_per_second"),
    "range_delta_sumby": lambda s, d: series.query_range(_deltas(s, d), STEP, ["segment", "zone"]).drop("value_per_second"),
    "range_rate": lambda s, d: series.query_range(_deltas(s, d), STEP, ["zone"]).select("bucket", "zone", "value_per_second"),
    "range_gauge": lambda s, d: series.query_range_gauge(event_samples(s, d), 6 * HOUR),
    "range_limit": _range_limit,
    "series_arrays": _series_arrays,
    "totals": lambda s, d: aggregate.totals(diff.diff(*_sides(s, d))),
    "diff_absolute": _diff(True),
    "diff_relative": _diff(False),
    "label_intersection": _intersection,
    "agents_last_push": _agents,
}

# merged by the full stack, which reads the same for lines of different numbers
FULL = f"""{LINE_FRAMES}, texts AS (
  SELECT sid, string_agg({TEXT}, ';' ORDER BY idx) AS stack,
    string_agg(concat_ws('|', {TEXT}, address, coalesce(mapping_file, '-'), coalesce(line, -1)), ';' ORDER BY idx) AS full_stack
  FROM line_frames GROUP BY sid),
stacked AS (SELECT s.*, coalesce(stack, '') AS stack, coalesce(full_stack, '') AS full_stack
  FROM line_samples s LEFT JOIN texts USING (sid))"""

SPAN = float(T2 - T1)
SIDES = f"""{FULL}, base AS (SELECT stack, full_stack, sum(value * period) AS value FROM stacked
    WHERE duration <> 0 AND time_nanos BETWEEN 0 AND {T1 - 1} GROUP BY 1, 2),
  compare AS (SELECT stack, full_stack, sum(value * period) AS value FROM stacked
    WHERE duration <> 0 AND time_nanos BETWEEN {T1} AND {T2} GROUP BY 1, 2),
  t AS (SELECT CAST((SELECT sum(value) FROM base) AS DOUBLE) AS b, CAST((SELECT sum(value) FROM compare) AS DOUBLE) AS c)"""
RELATIVE = f"""WITH {SIDES}, both_sides AS (
  SELECT stack, value, CASE WHEN b > c AND c > 0 THEN trunc(CAST(value AS DOUBLE) * (b / c)) ELSE value END AS diff FROM compare, t
  UNION ALL SELECT stack, 0, trunc(CAST(value AS DOUBLE) * (-1.0 * CASE WHEN c > b AND b > 0 THEN c / b ELSE 1.0 END)) FROM base, t)"""
RANGE = """SELECT time_nanos // {step} * {step} AS bucket {keys}, CAST(sum(value * period) AS BIGINT) AS value, count(*) AS count,
  CAST(CASE WHEN min(time_nanos) <> max(time_nanos) THEN {step} ELSE min(duration) END AS BIGINT) AS duration
  FROM line_samples WHERE duration <> 0 GROUP BY ALL"""


def _range(keys=""):
    return RANGE.format(step=STEP, keys=keys)


#: Label sets of ``punctuated_events`` as text.
PUNCTUATED = r"""'kind=' || kind || CASE WHEN (CAST("user" AS BIGINT) // 4) % 2 = 0 THEN '\,shard\=' ELSE ',shard=' END || shard"""
GAUGE = f"""SELECT labels, min(time_nanos) AS time_nanos, arg_min(value, time_nanos) AS value,
  CAST(arg_min(value, time_nanos) AS DOUBLE) AS value_per_second, count(*) AS count FROM t GROUP BY labels, time_nanos // {6 * HOUR}"""


def _merged(where):
    return f"""WITH {FULL} SELECT stack, CAST(sum(value * period) AS BIGINT) AS value FROM stacked
      WHERE duration <> 0 AND {where} GROUP BY 1"""


SQL = {
    "range_gauge_punctuated": f"""WITH {EVENT}, t AS (SELECT {PUNCTUATED} AS labels, time_nanos, CAST(sum(value) AS BIGINT) AS value
        FROM event_samples GROUP BY 1, 2) {GAUGE}""",
    "query_single_by_label": f"""WITH {FULL} SELECT stack, CASE WHEN segment <> '' THEN 'segment=' || segment ELSE '' END AS labels,
        CAST(sum(value) AS BIGINT) AS value FROM stacked WHERE duration <> 0 AND "timestamp" = {T1 // 10**6} GROUP BY 1, 2""",
    "query_diff_single_merge": f"""WITH {FULL} SELECT stack, CAST(sum(v) AS BIGINT) AS value, CAST(sum(d) AS BIGINT) AS diff FROM (
        SELECT stack, value * period AS v, value * period AS d FROM stacked WHERE duration <> 0 AND time_nanos BETWEEN {T1} AND {T2}
        UNION ALL SELECT stack, 0, -value FROM stacked WHERE duration <> 0 AND "timestamp" = {T1 // 10**6}) GROUP BY 1""",
    "query_from": _merged(f"time_nanos >= {T1}"),
    "query_until": _merged(f"time_nanos <= {T1}"),
    "merge": f"""WITH {FULL}, m AS (SELECT stack, full_stack, period, CAST(sum(value * period) AS BIGINT) AS value FROM stacked
        WHERE duration <> 0 AND time_nanos BETWEEN {T1} AND {T2} GROUP BY 1, 2, 3)
      SELECT stack, period, count(*) AS stacks, CAST(sum(value) AS BIGINT) AS value,
        max(CAST(value AS DOUBLE) / CAST({SPAN} AS DOUBLE)) AS top_rate FROM m GROUP BY 1, 2""",
    "merge_by_label": f"""WITH {FULL} SELECT stack, concat_ws(',', CASE WHEN segment <> '' THEN 'segment=' || segment END,
        CASE WHEN zone <> '' THEN 'zone=' || zone END) AS labels, CAST(sum(value * period) AS BIGINT) AS value
      FROM stacked WHERE time_nanos BETWEEN {T1} AND {T2} GROUP BY 1, 2""",
    "single": f"""WITH {FULL}, m AS (SELECT stack, full_stack, sum(value) AS v, sum(duration) AS dur FROM stacked
        WHERE duration <> 0 AND "timestamp" = {T1 // 10**6} GROUP BY 1, 2)
      SELECT stack, CAST(sum(v) AS BIGINT) AS value, CAST(sum(dur) AS BIGINT) AS duration,
        max(CAST(v AS DOUBLE) / CAST(dur AS DOUBLE)) AS top_rate FROM m GROUP BY 1""",
    "range_delta": f"WITH {LINE} {_range()}",
    "range_delta_sumby": f"WITH {LINE} {_range(", segment, nullif(zone, '') AS zone")}",
    "range_rate": f"""WITH {LINE}, r AS ({_range(", nullif(zone, '') AS zone")})
      SELECT bucket, zone, CAST(value AS DOUBLE) / CAST(duration AS DOUBLE) AS value_per_second FROM r""",
    "range_gauge": f"""WITH {EVENT}, t AS (SELECT 'kind=' || kind || ',shard=' || shard || ',user=' || "user" AS labels, time_nanos,
          CAST(sum(value) AS BIGINT) AS value FROM event_samples GROUP BY 1, 2)
      SELECT labels, min(time_nanos) AS time_nanos, arg_min(value, time_nanos) AS value,
        CAST(arg_min(value, time_nanos) AS DOUBLE) AS value_per_second, count(*) AS count
      FROM t GROUP BY labels, time_nanos // {6 * HOUR}""",
    "range_limit": f"""WITH {LINE}, r AS ({_range(', segment')}), k AS (
        SELECT segment FROM r GROUP BY 1 ORDER BY sum(value) DESC, segment LIMIT 2)
      SELECT bucket, segment, value FROM r WHERE EXISTS (SELECT 1 FROM k WHERE k.segment IS NOT DISTINCT FROM r.segment)""",
    "series_arrays": f"""WITH {LINE}, r AS ({_range(', segment')}) SELECT segment,
        string_agg(bucket || ':' || value || ':' || duration, ',' ORDER BY bucket) AS points FROM r GROUP BY 1""",
    "totals": RELATIVE + " SELECT CAST(sum(value) AS BIGINT) AS value, CAST(sum(diff) AS BIGINT) AS diff FROM both_sides",
    "diff_absolute": f"""WITH {SIDES} SELECT stack, CAST(sum(value) AS BIGINT) AS value, CAST(sum(diff) AS BIGINT) AS diff
      FROM (SELECT stack, value, value AS diff FROM compare UNION ALL SELECT stack, 0, -value FROM base) GROUP BY 1""",
    "diff_relative": RELATIVE + """ SELECT stack, CAST(sum(value) AS BIGINT) AS value, CAST(sum(diff) AS BIGINT) AS diff
      FROM both_sides GROUP BY 1""",
    "label_intersection": f"""WITH {LINE_FRAMES}, r AS (
        SELECT {TEXT} AS frame, unnest(['segment', 'zone', 'returnflag']) AS label, unnest([segment, zone, returnflag]) AS v FROM line_frames)
      SELECT frame, label, CASE WHEN count(DISTINCT v) = 1 AND count(v) = count(*) THEN min(v) END AS value FROM r GROUP BY 1, 2""",
    "agents_last_push": f"""WITH {EVENT}, p AS (SELECT CASE WHEN shard <> '0' THEN 'node' || shard END AS node,
          '10.0.0.' || (CAST("user" AS BIGINT) % 50) AS address, time_nanos, value * 1000 AS push,
          CASE WHEN kind = 'error' THEN 'failed' END AS error FROM event_samples),
        k AS (SELECT *, coalesce(node, '') || address AS key, row_number() OVER (
          PARTITION BY coalesce(node, '') || address, node ORDER BY time_nanos DESC, push DESC, error DESC NULLS LAST) AS rn FROM p)
      SELECT coalesce(node, key) AS id, key, time_nanos AS last_push, push AS push_duration, coalesce(error, '') AS last_error
      FROM k WHERE rn = 1 AND time_nanos >= (SELECT max(time_nanos) FROM p) - {24 * HOUR}""",
}
