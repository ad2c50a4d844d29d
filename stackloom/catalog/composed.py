"""Whole reports through the composer, presets, and streams over a written table."""

from pyspark.sql import functions as F

from stackloom.catalog import reports, trees
from stackloom.catalog.aggregates import HOUR
from stackloom.catalog.base import EVENT, LINE, LINE_FRAMES
from stackloom.catalog.selections import CPU, T1, T2
from stackloom.functions.scalar import default_sum_by
from stackloom.operators import metadata, series
from stackloom.operators.filters import Condition, Criteria, StackFilter, apply_filters
from stackloom.operators.presets import FIXED_PRESETS, preset
from stackloom.operators.select import ProfileType
from stackloom.plans.flamegraph import frame_text
from stackloom.plans.query import Diff, Query, Selection, run
from stackloom.session import shared_folder
from stackloom.sources.samples import write_samples
from stackloom.sources.tables import event_samples, line_samples, spread, table
from stackloom.streaming.ingest import stream_samples
from stackloom.streaming.series import rolling_merge, step_series

DELTAS = Selection(ProfileType(*CPU, delta=True))


def _run(report, **more):
    return lambda s, d: run(line_samples(s, d), Query(DELTAS, report, **more))


def _listed(tree):
    return tree.select("depth", frame_text().alias("frame"), F.coalesce("parent", F.lit("")).alias("parent"),
                                          "trimmed", "cumulative", "flat")


def _metadata(s, d):
    """Of a comparison, the report is about its second side."""
    sides = Diff(DELTAS, Selection(ProfileType(*CPU), T1, T2))
    return run(line_samples(s, d), Query(sides, "metadata")).rows.select("kind", "value")


def _chart(s, d):
    wall = ProfileType("events", "wall", "nanoseconds", "wall", "nanoseconds")
    samples = event_samples(s, d).withColumn("value", F.col("value") * 10**10)
    return run(samples, Query(Selection(wall), "flamechart", group_by=("labels.shard",))).rows


def _diff(s, d):
    """Callers of a function in two ranges, compared, without the stacks of one country."""
    sides = Diff(Selection(DELTAS.profile_type, 0, T1 - 1), Selection(DELTAS.profile_type, T1, T2), absolute=True)
    no_nation = StackFilter(Criteria(function_name=Condition("not_contains", "nation_1")))
    report = run(line_samples(s, d), Query(sides, "table", filters=(no_nation,)))
    return report.rows.where("name IS NOT NULL").select("name", "cumulative", "cumulative_diff", "flat", "flat_diff")


def _sum_by(s, d):
    """The series a user gets who names no labels: those of the namespace, where samples have one."""
    renamed = line_samples(s, d).where("duration <> 0").withColumn(
        "labels", F.transform_keys("labels", lambda k, _: F.when(k == "zone", "namespace").otherwise(k)))
    names = [r["label"] for r in metadata.label_names(renamed).collect()]  # as many as there are label names
    return series.query_range(renamed, 30 * 24 * HOUR, default_sum_by(True, names) or []).select("bucket", "namespace", "value", "count")


# --- presets: parts as functions and binaries that the presets are about


NAMES = ["runtime.usleep", "runtime.futex", "futex_wait", "V8::Run", "main", "<module>", "<interpreter trampoline>", "tokio::spawn",
         "<tokio::task>", "x tokio::runtime y", "future::poll", "<future as x>", "y futures_core z", "core::future::future::Future", "poll_next", "try_poll",
         "{closure#0}", "{async_block#1}", "invoke", "run", "{async_fn#2}", "std::panic::x", "<core::panic::y", "std::sys::backtrace", "catch_unwind<x", "call_once<x",
         "do_call<x", "parking_lot_core::thread_parker::imp::ThreadParker::futex_wait", "tokio::runtime::time::Driver::park_internal", "Runner"]
BINARIES = ["app", "node", "libc.so.6", "libcuda.so.1", "libcudart.so", "libcublasLt.so", "python3.11", "libcupti.so.12", "libagentgpucupti.so", "libcudnn_graph.so.9",
            "libcudnn.so", "libcudnn_engines_precompiled.so"]


def _preset_samples(s, d):
    pick = lambda items, i: f"array({', '.join(repr(x) for x in items)})[cast({i} AS int)]"
    line = "named_struct('line', 1L, 'column', 0L, 'function_name', {0}, 'function_system_name', {0}, 'function_filename', 'f', 'function_start_line', 1L)"
    place = ("named_struct('address', {0}, 'mapping_start', 0L, 'mapping_limit', 10L, 'mapping_offset', 0L, 'mapping_file', concat('/usr/lib/', {1}), "
             "'mapping_build_id', 'b', 'lines', array({2}))")
    leaf = place.format("1L", "bin", line.format("fn"))
    root = place.format("2L", "'app'", line.format("'main'"))
    rows = spread(table(s, d, "lineitem")).selectExpr(
        f"{pick(NAMES, f'l_partkey % {len(NAMES)}')} AS fn", f"{pick(BINARIES, f'l_suppkey % {len(BINARIES)}')} AS bin", "cast(l_quantity AS bigint) AS value")
    return rows.selectExpr("value", f"array({leaf}, {root}) AS stacktrace", "fn", "bin")


def _presets(s, d):
    """What each preset leaves: its name, the stacks, their number and value."""
    samples = _preset_samples(s, d).groupBy("stacktrace").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    out = None
    for key in FIXED_PRESETS:
        kept = apply_filters(samples, preset(key, agent="agent"))
        text = F.array_join(F.transform("stacktrace", lambda x: F.concat(x["lines"][0]["function_name"], F.lit("@"), F.substring_index(x["mapping_file"], "/", -1))), ";")
        rows = kept.groupBy(text.alias("stack")).agg(F.sum("n").alias("n"), F.sum("value").alias("value")).withColumn("preset", F.lit(key))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- streams, over all that is there now


def _streamed(s, d, made):
    """The table a stream of the written events ends with."""
    folder = shared_folder(s, "stream")
    write_samples(event_samples(s, d), f"{folder}/samples")

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    made(stream_samples(s, f"{folder}/samples")).writeStream.outputMode("complete").foreachBatch(keep).option(
        "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{folder}/out")


def _stream_series(s, d):
    out = _streamed(s, d, lambda stream: step_series(stream, "6 hours", ["kind", "shard"]))
    start = F.unix_micros(F.col("window.start").cast("timestamp")) * 1000
    return out.select(start.alias("start"), "kind", "shard", "value", "count", "duration", "several_times")


def _stream_merge(s, d):
    out = _streamed(s, d, lambda stream: rolling_merge(stream, "1 day"))
    text = F.array_join(F.transform("stacktrace", lambda x: x["lines"][0]["function_name"]), ";")
    return out.select((F.unix_micros(F.col("window.start").cast("timestamp")) * 1000).alias("start"), text.alias("stack"), "period", "value")


QUERIES = {
    "run_flamegraph": lambda s, d: _listed(_run("flamegraph", trim_percent=1.5)(s, d).rows),
    "run_top": lambda s, d: _run("top")(s, d).rows,
    "run_table": lambda s, d: _run("table")(s, d).rows,
    "run_callgraph": lambda s, d: _run("callgraph")(s, d).edges,
    "run_source": lambda s, d: _run("source", source_file="economy.go", source_build_id="b1")(s, d).rows,
    "run_metadata": _metadata,
    "run_flamechart": _chart,
    "run_diff_table": _diff,
    "run_sandwich_totals": lambda s, d: _run("profile", sandwich_by="MIDDLE EAST")(s, d).totals,
    "default_sum_by": _sum_by,
    "range_clamped": lambda s, d: series.query_range(event_samples(s, d), 1000, ["kind"], clamp=True).drop("value_per_second"),
    "presets": _presets,
    "stream_series": _stream_series,
    "stream_merge": _stream_merge,
}

LAST = "JOIN region ON n_regionkey = r_regionkey)"
RULES = [(key, *row) for key, rows in FIXED_PRESETS.items() for row in rows]


def _deltas(sql):
    """A comparison query over the delta samples alone."""
    assert LAST in sql
    return sql.replace(LAST, LAST[:-1] + " WHERE l_linestatus = 'F')")


def _quoted(x):
    return "'" + x.replace("'", "''") + "'"


SQL = {
    "run_flamegraph": _deltas(trees.SQL["flamegraph_trim"]),
    "run_top": _deltas(reports.SQL["top"]),
    "run_table": _deltas(reports.SQL["table"]),
    "run_callgraph": _deltas(reports.SQL["callgraph_prune"]).replace("CAST(0.05 AS FLOAT)", "CAST(0.005 AS FLOAT)"),
    "run_source": _deltas(reports.SQL["source_lines"]),
    "run_metadata": f"""WITH {LINE_FRAMES}, x AS (SELECT * FROM line_samples WHERE duration = 0 AND time_nanos BETWEEN {T1} AND {T2})
      SELECT DISTINCT 'mapping_file' AS kind, mapping_file AS value FROM line_frames
        WHERE duration = 0 AND time_nanos BETWEEN {T1} AND {T2} AND mapping_start IS NOT NULL AND mapping_file IS NOT NULL
      UNION ALL SELECT 'label', l FROM (SELECT 'priority' AS l UNION ALL SELECT 'returnflag' UNION ALL SELECT 'zone'
        UNION ALL SELECT 'segment' FROM (SELECT 1 FROM x WHERE segment IS NOT NULL LIMIT 1)) WHERE (SELECT count(*) FROM x) > 0""",
    "run_flamechart": trees.SQL["flamechart"],
    "run_diff_table": f"""WITH {LINE_FRAMES}, kept AS (SELECT * FROM line_frames WHERE duration <> 0 AND time_nanos BETWEEN 0 AND {T2}
          AND sid NOT IN (SELECT sid FROM line_frames WHERE lower(fn) LIKE '%nation\\_1%' ESCAPE '\\')),
        x AS (SELECT fn AS name, CASE WHEN time_nanos < {T1} THEN 0 ELSE value * period END AS v,
          CASE WHEN time_nanos < {T1} THEN -value * period ELSE value * period END AS d, loc = 0 AND pos = 0 AS leaf FROM kept WHERE fn IS NOT NULL)
      SELECT name, CAST(sum(v) AS BIGINT) AS cumulative, CAST(sum(d) AS BIGINT) AS cumulative_diff,
        CAST(sum(CASE WHEN leaf THEN v ELSE 0 END) AS BIGINT) AS flat, CAST(sum(CASE WHEN leaf THEN d ELSE 0 END) AS BIGINT) AS flat_diff
      FROM x GROUP BY name""",
    "run_sandwich_totals": f"""WITH {LINE} SELECT CAST(sum(value * period) AS BIGINT) AS total, CAST(0 AS BIGINT) AS filtered FROM line_samples
      WHERE duration <> 0 AND r_regionkey = 4 AND NOT empty_stack""",
    "default_sum_by": f"""WITH {LINE} SELECT time_nanos // {30 * 24 * HOUR} * {30 * 24 * HOUR} AS bucket, nullif(zone, '') AS namespace,
        CAST(sum(value * period) AS BIGINT) AS value, count(*) AS count FROM line_samples WHERE duration <> 0 GROUP BY ALL""",
    "range_clamped": f"""WITH {EVENT} SELECT time_nanos // 1000000000 * 1000000000 AS bucket, kind, CAST(sum(value) AS BIGINT) AS value,
        CAST(CASE WHEN min(time_nanos) <> max(time_nanos) THEN 1000000000 ELSE min(duration) END AS BIGINT) AS duration, count(*) AS count
      FROM event_samples GROUP BY ALL""",
    # every rule of a preset on every frame; a stack passes if all its frames do
    "presets": f"""WITH rules(preset, kind, field, op, v) AS (VALUES {', '.join('(' + ', '.join(_quoted(x.replace('{agent}', 'agent').lower() if i == 4 else x) for i, x in enumerate(r)) + ')' for r in RULES)}),
      base AS (SELECT [{', '.join(map(_quoted, NAMES))}][CAST(l_partkey % {len(NAMES)} + 1 AS INTEGER)] AS fn,
          [{', '.join(map(_quoted, BINARIES))}][CAST(l_suppkey % {len(BINARIES)} + 1 AS INTEGER)] AS bin, CAST(l_quantity AS BIGINT) AS value FROM lineitem),
      grouped AS (SELECT fn, bin, count(*) AS n, CAST(sum(value) AS BIGINT) AS value FROM base GROUP BY ALL),
      frames AS (SELECT fn, bin, n, value, 0 AS pos, fn AS f, bin AS b FROM grouped UNION ALL SELECT fn, bin, n, value, 1, 'main', 'app' FROM grouped),
      judged AS (SELECT r.preset, fn, bin, pos, f, b, n, value, bool_and(kind = 'frame' OR ok) AS stack_ok, bool_and(kind = 'stack' OR ok) AS frame_ok
        FROM (SELECT *, CASE op WHEN 'not_equal' THEN t <> v WHEN 'not_contains' THEN NOT contains(t, v) ELSE NOT starts_with(t, v) END AS ok
          FROM (SELECT *, lower(CASE field WHEN 'binary' THEN b ELSE f END) AS t FROM frames, rules)) r GROUP BY ALL),
      stacks AS (SELECT preset, fn, bin, n, value, coalesce(string_agg(f || '@' || b, ';' ORDER BY pos) FILTER (WHERE frame_ok), '') AS stack
        FROM judged GROUP BY ALL HAVING bool_and(stack_ok))
      SELECT preset, stack, CAST(sum(n) AS BIGINT) AS n, CAST(sum(value) AS BIGINT) AS value FROM stacks GROUP BY ALL""",
    "stream_series": f"""WITH {EVENT} SELECT time_nanos // {6 * HOUR} * {6 * HOUR} AS start, kind, shard, CAST(sum(value) AS BIGINT) AS value, count(*) AS count,
        CAST(min(duration) AS BIGINT) AS duration, min(time_nanos) <> max(time_nanos) AS several_times FROM event_samples GROUP BY ALL""",
    "stream_merge": f"""WITH {EVENT} SELECT time_nanos // {24 * HOUR} * {24 * HOUR} AS start, leaf || ';' || kind AS stack, period,
        CAST(sum(value) AS BIGINT) AS value FROM event_samples GROUP BY ALL""",
}
