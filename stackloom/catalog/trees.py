"""Flame graph queries."""

from pyspark.sql import functions as F

from stackloom.catalog.aggregates import PUNCTUATED, punctuated_events
from stackloom.catalog.base import EVENT, LINE_FRAMES, tree
from stackloom.operators.aggregate import merge, rows
from stackloom.operators.frames import invert
from stackloom.plans import flamechart as fc, flamegraph as fg
from stackloom.sources.tables import event_samples, line_samples


def _profile(s, d, *group_by):
    return rows(line_samples(s, d), group_by=group_by)


def _listed(nodes, *more):
    return nodes.select("depth", fg.frame_text().alias("frame"), "parent", *more, "cumulative", "flat")


def _grouped(field, *more):
    def run(s, d):
        return _listed(fg.flamegraph(_profile(s, d), (field,)).where("depth > 0"), *more)
    return run


def flamegraph(s, d):
    return _listed(fg.flamegraph(_profile(s, d)).where("depth > 0"))


def _inverted(s, d):
    profile = _profile(s, d).withColumn("stacktrace", invert("stacktrace"))
    return _listed(fg.flamegraph(profile).where("depth > 0"))


def _by_label(s, d):
    group = ("labels.segment", "labels.zone")
    return _listed(fg.flamegraph(_profile(s, d, *group), group).where("depth > 0"), "labels_only")


def _by_label_punctuated(s, d):
    group = ("labels.kind", "labels.shard")
    return _listed(fg.flamegraph(rows(punctuated_events(s, d), group_by=group), group).where("depth > 0"), "labels_only")


def _meta(s, d):
    nodes = fg.flamegraph(_profile(s, d), meta=True).where("depth > 0")
    return _listed(nodes, "mapping_file", "mapping_build_id", "address", "line", "start_line", "system_name",
                   "filename", "inlined")


def _trim(percent, legacy=False):
    def run(s, d):
        profile = _profile(s, d)
        nodes = fg.trim(fg.flamegraph(profile), profile, percent, legacy=legacy)
        return _listed(nodes.withColumn("parent", F.coalesce("parent", F.lit(""))), "trimmed")
    return run


def _offsets(s, d):
    profile = _profile(s, d)
    return _listed(fg.layout(fg.flamegraph(profile)).where("depth > 0"), "value_offset")


def _names(s, d):
    """Rows of the nested form: siblings merged by name alone."""
    profile = rows(event_samples(s, d))
    return fg.flamegraph(profile).select("depth", "name", "parent", "cumulative")


def _flamechart(s, d):
    group = ("labels.shard",)
    return fc.flamechart(merge(event_samples(s, d).withColumn("value", F.col("value") * 10**10),
                               group_by=group + ("timestamp",)), group)


QUERIES = {
    "flamegraph": flamegraph,
    "flamegraph_inverted": _inverted,
    "flamegraph_by_label": _by_label,
    "flamegraph_by_label_punctuated": _by_label_punctuated,
    "flamegraph_by_mapping": _grouped("mapping_file", "key_mapping_file"),
    "flamegraph_by_address": _grouped("location_address", "key_address"),
    "flamegraph_by_file": _grouped("function_file_name", "key_filename"),
    "flamegraph_meta": _meta,
    "flamegraph_trim": _trim(1.5),
    "flamegraph_trim_legacy": _trim(1.5, legacy=True),
    "flamegraph_offsets": _offsets,
    "flamegraph_names": _names,
    "flamechart": _flamechart,
    "height": lambda s, d: fg.height(_profile(s, d)).withColumn("kind", F.lit("lines")).unionByName(
        fg.height(_profile(s, d), legacy=True).withColumn("kind", F.lit("locations"))),
}

NODES = """
SELECT CAST(depth0 AS INTEGER) AS depth, {name} AS frame, {parent} AS parent {more},
  CAST(sum(v) AS BIGINT) AS cumulative, CAST(sum(CASE WHEN {leaf} THEN v ELSE 0 END) AS BIGINT) AS flat
FROM paths GROUP BY path, parent, depth0, k, {name}, {parent} {group}"""
NAME = "CASE WHEN symbolized THEN fn ELSE '0x' || lower(to_hex(address)) END"


def _nodes(more="", group="", name="name0", parent="parent0", leaf="idx = 0"):
    return NODES.format(more=more, group=group, name=name, parent=parent, leaf=leaf)


def _tree(key=NAME, **kw):
    """The shared tree CTEs with display names of a node and its parent."""
    return "WITH " + tree(key=key, value="value * period", **kw).replace(
        "lag(k) OVER (PARTITION BY sid ORDER BY depth0) AS parent_key",
        f"{NAME} AS name0, lag({NAME}) OVER (PARTITION BY sid ORDER BY depth0) AS parent0")


def _key(part):
    return f"CASE WHEN symbolized THEN fn || '@' || coalesce(CAST({part} AS VARCHAR), '-') ELSE '0x' || lower(to_hex(address)) END"


LABELS = "concat_ws(',', CASE WHEN segment <> '' THEN 'segment=' || segment END, CASE WHEN zone <> '' THEN 'zone=' || zone END)"
# labelled stacks get one more frame at the root end
BY_LABEL = f"""{LINE_FRAMES}, line_frames_l AS (
  SELECT sid, value, period, idx, n_frames + (CASE WHEN lab <> '' THEN 1 ELSE 0 END) AS n_frames, false AS labels_only, shown AS nm
  FROM (SELECT *, {NAME} AS shown, {LABELS} AS lab FROM line_frames)
  UNION ALL
  SELECT s.sid, s.value, s.period, coalesce(n, 0), coalesce(n, 0) + 1, true, {LABELS} FROM line_samples s
    LEFT JOIN (SELECT sid, count(*) AS n FROM line_frames GROUP BY 1) USING (sid) WHERE {LABELS} <> '')"""


def _agree(c):
    return f"CASE WHEN count(DISTINCT {c}) = 1 AND count({c}) = count(*) THEN min({c}) END"


METAS = ", ".join(f"{_agree(c)} AS {n}" for c, n in (
    ("mapping_file", "mapping_file"), ("build_id", "mapping_build_id"), ("address", "address"), ("line", "line"),
    ("start_line", "start_line"), ("sysname", "system_name"), ("filename", "filename"), ("inlined", "inlined")))

KEPT = """, nodes AS (SELECT CAST(depth0 AS INTEGER) AS depth, path, parent AS ppath, name0 AS frame, parent0 AS parent,
    CAST(sum(v) AS BIGINT) AS cumulative, CAST(sum(CASE WHEN idx = 0 THEN v ELSE 0 END) AS BIGINT) AS flat
  FROM paths GROUP BY path, parent, depth0, name0, parent0),
whole AS (SELECT CAST(sum(value * period) AS BIGINT) AS t FROM line_samples),
judged AS (SELECT n.*, coalesce(p.cumulative, t) AS pc FROM nodes n LEFT JOIN nodes p ON n.ppath = p.path, whole),
failing AS (SELECT * FROM judged WHERE {fails}),
kept AS (SELECT n.* FROM nodes n WHERE NOT EXISTS (
  SELECT 1 FROM failing f WHERE f.path = n.path OR starts_with(n.path, f.path || '/'))),
lost AS (SELECT ppath, CAST(sum(cumulative) AS BIGINT) AS trimmed FROM failing GROUP BY 1)
SELECT depth, frame, coalesce(parent, '') AS parent, coalesce(trimmed, 0) AS trimmed, cumulative, flat
  FROM kept LEFT JOIN lost ON lost.ppath = kept.path
UNION ALL SELECT 0, NULL, '', coalesce((SELECT trimmed FROM lost WHERE ppath = ''), 0), {root}, 0"""

SQL = {
    "flamegraph": _tree() + _nodes(),
    "flamegraph_inverted": ("WITH " + LINE_FRAMES + f""", flipped AS (SELECT * REPLACE (idx AS n_frames, n_frames - 1 - idx AS idx)
          FROM line_frames)""" + _tree(frames="", source="flipped").removeprefix("WITH ").replace(
        "n_frames - idx AS depth0", "n_frames + 1 AS depth0") + _nodes()),
    "flamegraph_by_label": "WITH " + tree(key="nm", frames=BY_LABEL, source="line_frames_l", value="value * period")
    + _nodes(more=", labels_only", group=", labels_only", name="k", parent="parent_key", leaf="idx = 0 AND NOT labels_only"),
    "flamegraph_by_label_punctuated": f"""WITH {EVENT}, t AS (SELECT {PUNCTUATED} AS lab, kind, leaf, value FROM event_samples)
      SELECT 1 AS depth, lab AS frame, CAST(NULL AS VARCHAR) AS parent, true AS labels_only, CAST(sum(value) AS BIGINT) AS cumulative,
        CAST(0 AS BIGINT) AS flat FROM t GROUP BY lab
      UNION ALL SELECT 2, kind, lab, false, CAST(sum(value) AS BIGINT), 0 FROM t GROUP BY lab, kind
      UNION ALL SELECT 3, leaf, kind, false, CAST(sum(value) AS BIGINT), CAST(sum(value) AS BIGINT) FROM t GROUP BY lab, kind, leaf""",
    "flamegraph_by_mapping": _tree(_key("mapping_file")) + _nodes(
        more=", CASE WHEN symbolized THEN mapping_file END AS key_mapping_file",
        group=", CASE WHEN symbolized THEN mapping_file END"),
    "flamegraph_by_address": _tree(_key("address")) + _nodes(more=", address AS key_address", group=", address"),
    "flamegraph_by_file": _tree(_key("filename")) + _nodes(more=", filename AS key_filename", group=", filename"),
    "flamegraph_meta": _tree() + _nodes(more=", " + METAS),
    "flamegraph_trim": _tree() + KEPT.format(
        fails="cumulative <= CAST(trunc(CAST(pc AS FLOAT) * (CAST(1.5 AS FLOAT) / CAST(100 AS FLOAT))) AS BIGINT)",
        root="(SELECT CAST(sum(cumulative) AS BIGINT) FROM kept WHERE depth = 1)"),
    "flamegraph_trim_legacy": _tree() + KEPT.format(
        fails="CAST(cumulative AS FLOAT) < CAST(pc AS FLOAT) * (CAST(1.5 AS FLOAT) / CAST(100 AS FLOAT))",
        root="(SELECT CAST(sum(cumulative) AS BIGINT) FROM nodes WHERE depth = 1)"),
    "flamegraph_offsets": _tree() + """, nodes AS (SELECT CAST(depth0 AS INTEGER) AS depth, path, parent AS ppath, name0 AS frame,
          parent0 AS parent, symbolized, address, CAST(sum(v) AS BIGINT) AS cumulative,
          CAST(sum(CASE WHEN idx = 0 THEN v ELSE 0 END) AS BIGINT) AS flat
        FROM paths GROUP BY path, parent, depth0, name0, parent0, symbolized, CASE WHEN symbolized THEN NULL ELSE address END, ALL_ADDRESS),
      placed AS (SELECT *, coalesce(sum(cumulative) OVER (PARTITION BY ppath
          ORDER BY CASE WHEN symbolized THEN frame ELSE '' END, CASE WHEN symbolized THEN 0 ELSE address END
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS step FROM nodes)
      SELECT n.depth, n.frame, n.parent, n.cumulative, n.flat, CAST(sum(a.step) AS BIGINT) AS value_offset
      FROM placed n JOIN placed a ON n.path = a.path OR starts_with(n.path, a.path || '/')
      GROUP BY n.path, n.depth, n.frame, n.parent, n.cumulative, n.flat""".replace(
        "symbolized, address, CAST(sum(v)", "symbolized, CASE WHEN symbolized THEN 0 ELSE address END AS address, CAST(sum(v)").replace(
        ", CASE WHEN symbolized THEN NULL ELSE address END, ALL_ADDRESS", ", CASE WHEN symbolized THEN 0 ELSE address END"),
    "flamegraph_names": f"""WITH {EVENT} SELECT 0 AS depth, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS parent,
        CAST(sum(value) AS BIGINT) AS cumulative FROM event_samples
      UNION ALL SELECT 1, kind, NULL, CAST(sum(value) AS BIGINT) FROM event_samples GROUP BY kind
      UNION ALL SELECT 2, leaf, kind, CAST(sum(value) AS BIGINT) FROM event_samples GROUP BY kind, leaf""",
    # one sample of each series per step; a node ends where the values it took up end
    "flamechart": f"""WITH RECURSIVE {EVENT}, merged AS (SELECT 'shard=' || shard AS series, time_nanos AS t, kind, leaf, any_value(period) // 10 AS jitter,
        CAST(sum(value * 10000000000) AS BIGINT) AS v FROM event_samples GROUP BY shard, time_nanos, kind, leaf),
      numbered AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) AS n FROM merged),
      open(series, n, v, kind, leaf, start1, end1, start2, end2) AS (
        SELECT series, n, v, kind, leaf, t, t + v, t, t + v FROM numbered WHERE n = 1
        UNION ALL SELECT x.series, x.n, x.v, x.kind, x.leaf, CASE WHEN one THEN start1 ELSE x.t END, CASE WHEN one THEN end1 ELSE x.t END + x.v,
          CASE WHEN two THEN start2 ELSE x.t END, CASE WHEN two THEN end2 ELSE x.t END + x.v
        FROM (SELECT s.*, o.start1, o.end1, o.start2, o.end2, o.kind = s.kind AND s.t - s.jitter <= o.end1 AS one,
            o.kind = s.kind AND s.t - s.jitter <= o.end1 AND o.leaf = s.leaf AND s.t - s.jitter <= o.end2 AS two
          FROM open o JOIN numbered s ON s.series = o.series AND s.n = o.n + 1) x)
      SELECT series, 1 AS depth, kind AS frame, CAST(NULL AS VARCHAR) AS parent, start1 AS start, CAST(NULL AS BIGINT) AS parent_start,
        CAST(sum(v) AS BIGINT) AS cumulative, CAST(0 AS BIGINT) AS flat FROM open GROUP BY series, kind, start1
      UNION ALL SELECT series, 2, leaf, kind, start2, start1, CAST(sum(v) AS BIGINT), CAST(sum(v) AS BIGINT)
        FROM open GROUP BY series, kind, leaf, start1, start2""",
    "height": f"""WITH {LINE_FRAMES} SELECT 'lines' AS kind, max(n_frames) + 1 AS height FROM line_frames
      UNION ALL SELECT 'locations', max(loc) + 2 FROM line_frames""",
}
