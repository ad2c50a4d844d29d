"""Top lists, tables, call graphs, source lines, export dictionaries."""

from pyspark.sql import functions as F

from stackloom.catalog.base import LINE_FRAMES
from stackloom.operators.aggregate import merge, rows
from stackloom.plans import callgraph, listing
from stackloom.sources.pprof import Export
from stackloom.sources.tables import line_samples


def _profile(s, d):
    return rows(line_samples(s, d))


def _prune(s, d):
    profile = _profile(s, d)
    total = profile.agg(F.sum("value")).scalar()
    _, edges = callgraph.prune(callgraph.nodes(profile), callgraph.edges(profile), total, 0.05)
    return edges


def _pair_text(c):
    return F.coalesce(F.col(f"{c}.name"), F.concat_ws("/", f"{c}.build_id", F.lower(F.hex(f"{c}.address"))))


def _neighbours(side):
    other = "callee" if side == "caller" else "caller"

    def run(s, d):
        pairs = listing.table_neighbours(_profile(s, d))
        return pairs.select(_pair_text(other).alias("function"), _pair_text(side).alias(side))
    return run


def _dictionary(s, d):
    """Sizes of the export tables and the exported value."""
    export = Export(merge(line_samples(s, d)))
    count = lambda df, name: df.agg(F.lit(name).alias("section"), F.count("*").alias("n"), F.max("id").alias("last_id"))
    samples = export.samples().agg(F.lit("samples").alias("section"), F.count("*").alias("n"), F.sum("value").alias("last_id"))
    return count(export.strings(), "strings").unionByName(count(export.functions, "functions")).unionByName(
        count(export.mappings, "mappings")).unionByName(count(export.locations(), "locations")).unionByName(samples)


QUERIES = {
    "top": lambda s, d: listing.top(_profile(s, d)),
    "top_k": lambda s, d: listing.top(_profile(s, d), limit=25),
    "table": lambda s, d: listing.table(_profile(s, d)),
    "callers": _neighbours("caller"),
    "callees": _neighbours("callee"),
    "callgraph_nodes": lambda s, d: callgraph.nodes(_profile(s, d)),
    "callgraph_edges": lambda s, d: callgraph.edges(_profile(s, d)),
    "callgraph_prune": _prune,
    "source_lines": lambda s, d: listing.source_report(_profile(s, d), "economy.go", "b1"),
    "pprof_dictionary": _dictionary,
}

# lines[0] of each location only
TOP = f"""{LINE_FRAMES}, locs AS (SELECT *, CAST(value * period AS BIGINT) AS v FROM line_frames WHERE pos = 0),
  grouped AS (SELECT fn AS name, min(address) AS address,
      CASE WHEN count(DISTINCT mapping_file) = 1 AND count(mapping_file) = count(*) THEN min(mapping_file) END AS mapping_file,
      CASE WHEN count(DISTINCT build_id) = 1 AND count(build_id) = count(*) THEN min(build_id) END AS mapping_build_id,
      CAST(sum(v) AS BIGINT) AS cumulative, CAST(sum(CASE WHEN loc = 0 THEN v ELSE 0 END) AS BIGINT) AS flat,
      CAST(0 AS BIGINT) AS diff
    FROM locs GROUP BY fn, CASE WHEN fn IS NULL THEN address END, CASE WHEN fn IS NULL THEN mapping_file END,
      CASE WHEN fn IS NULL THEN build_id END)"""
KEYED = f"""{LINE_FRAMES}, k AS (SELECT *, CASE WHEN symbolized THEN fn ELSE coalesce(build_id, '') || '/{{x}}' || lower(to_hex(address)) END AS key,
    value * period AS v FROM line_frames),
  p AS (SELECT sid, v, key AS callee, lead(key) OVER (PARTITION BY sid ORDER BY idx) AS caller FROM k)"""
GRAPH = KEYED.replace("{x}", "0x")
PAIRS = KEYED.replace("{x}", "")

SQL = {
    "top": f"WITH {TOP} SELECT * FROM grouped",
    "top_k": f"WITH {TOP} SELECT * FROM grouped ORDER BY flat DESC, address, name NULLS FIRST LIMIT 25",
    "table": f"""WITH {LINE_FRAMES}, x AS (SELECT *, value * period AS v FROM line_frames)
      SELECT fn AS name, CASE WHEN NOT symbolized THEN coalesce(build_id, '') END AS build_id,
        CASE WHEN NOT symbolized THEN address END AS address, CAST(sum(v) AS BIGINT) AS cumulative,
        CAST(0 AS BIGINT) AS cumulative_diff, CAST(sum(CASE WHEN loc = 0 AND pos = 0 THEN v ELSE 0 END) AS BIGINT) AS flat,
        CAST(0 AS BIGINT) AS flat_diff, min(mapping_file) AS mapping_file, min(sysname) AS system_name,
        min(filename) AS filename, min(line) AS line, CAST(min(start_line) AS BIGINT) AS start_line
      FROM x GROUP BY 1, 2, 3""",
    "callers": f"WITH {PAIRS} SELECT DISTINCT callee AS function, caller FROM p WHERE caller IS NOT NULL",
    "callees": f"WITH {PAIRS} SELECT DISTINCT caller AS function, callee FROM p WHERE caller IS NOT NULL",
    "callgraph_nodes": f"""WITH {GRAPH} SELECT key AS node, CAST(sum(v) AS BIGINT) AS cumulative,
        CAST(sum(CASE WHEN loc = 0 THEN v ELSE 0 END) AS BIGINT) AS flat FROM k GROUP BY 1""",
    "callgraph_edges": f"""WITH {GRAPH} SELECT caller AS source, callee AS target, CAST(sum(v) AS BIGINT) AS cumulative
      FROM p WHERE caller IS NOT NULL GROUP BY 1, 2""",
    # nations hang below one region each; all are below 5 % and get bridged
    "callgraph_prune": f"""WITH RECURSIVE {GRAPH}, n AS (SELECT key AS node, sum(v) AS c FROM k GROUP BY 1),
      e AS (SELECT caller AS source, callee AS target, CAST(sum(v) AS BIGINT) AS w FROM p WHERE caller IS NOT NULL GROUP BY 1, 2),
      tot AS (SELECT CAST(sum(value * period) AS DOUBLE) AS t FROM line_samples),
      r AS (SELECT node, min(source) AS parent, CAST(sum(w) AS BIGINT) AS w FROM n JOIN e ON target = node, tot
        WHERE c < t * CAST(CAST(0.05 AS FLOAT) AS DOUBLE) AND node IN (SELECT source FROM e) GROUP BY node HAVING count(*) = 1),
      up(node, anchor, w, hops) AS (SELECT node, parent, w, 1 FROM r
        UNION ALL SELECT up.node, r.parent, up.w + r.w, hops + 1 FROM up JOIN r ON up.anchor = r.node WHERE hops < 100),
      gone AS (SELECT node, anchor, w FROM up WHERE anchor NOT IN (SELECT node FROM r))
      SELECT source, target, w AS cumulative, false AS is_collapsed FROM e
        WHERE source NOT IN (SELECT node FROM gone) AND target NOT IN (SELECT node FROM gone)
      UNION ALL SELECT anchor, target, gone.w, true FROM gone JOIN e ON e.source = gone.node
        WHERE target NOT IN (SELECT node FROM gone)""",
    "source_lines": f"""WITH {LINE_FRAMES} SELECT filename, line AS line_number, CAST(sum(value * period) AS BIGINT) AS cumulative,
        CAST(sum(CASE WHEN loc = 0 AND pos = 0 THEN value * period ELSE 0 END) AS BIGINT) AS flat
      FROM line_frames WHERE filename = 'src/economy.go' AND build_id = 'b1' AND mapping_start IS NOT NULL GROUP BY 1, 2""",
    "pprof_dictionary": f"""WITH {LINE_FRAMES}, fns AS (SELECT DISTINCT fn, coalesce(sysname, '') AS sysname, coalesce(filename, '') AS filename, start_line
          FROM line_frames WHERE symbolized),
        maps AS (SELECT DISTINCT build_id, mapping_file FROM line_frames WHERE mapping_start IS NOT NULL),
        locs AS (SELECT sid, loc, address, build_id, CASE WHEN mapping_start IS NULL THEN string_agg(fn || '#' || line, ',') END AS lines
          FROM line_frames GROUP BY sid, loc, address, build_id, mapping_start),
        texts AS (SELECT fn AS t FROM fns UNION SELECT sysname FROM fns UNION SELECT filename FROM fns
          UNION SELECT build_id FROM maps UNION SELECT mapping_file FROM maps),
        stacks AS (SELECT sid, string_agg(concat_ws('@', address, coalesce(build_id, '-')), ';' ORDER BY loc) AS st FROM locs GROUP BY 1),
        merged AS (SELECT st, sum(value * period) AS v FROM stacks JOIN line_samples USING (sid) GROUP BY 1),
        sizes AS (SELECT 'strings' AS section, count(*) + 1 AS n, count(*) AS last_id FROM texts WHERE t <> ''
          UNION ALL SELECT 'functions', count(*), count(*) FROM fns UNION ALL SELECT 'mappings', count(*), count(*) FROM maps
          UNION ALL SELECT 'locations', count(*), count(*) FROM (SELECT DISTINCT build_id, CASE WHEN lines IS NULL THEN address END, lines FROM locs)
          UNION ALL SELECT 'samples', count(*), CAST(sum(v) AS BIGINT) FROM merged)
      SELECT section, CAST(n AS BIGINT) AS n, CAST(last_id AS BIGINT) AS last_id FROM sizes""",
}
