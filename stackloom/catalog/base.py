"""Shared parts of the comparison SQL: the driver tables as samples and as frames.

Written independently of the DataFrame code, in plain ANSI-style SQL.
"""

LINE = """
line_samples AS (
  SELECT row_number() OVER () AS sid, 'process_cpu' AS name, 'samples' AS sample_type, 'count' AS sample_unit,
    'cpu' AS period_type, 'nanoseconds' AS period_unit, CAST(100 AS BIGINT) AS period,
    CAST(CASE WHEN l_linestatus = 'F' THEN 10000000000 ELSE 0 END AS BIGINT) AS duration,
    epoch_us(l_shipdate) * 1000 AS time_nanos, (epoch_us(l_shipdate) * 1000) // 1000000 AS "timestamp",
    CAST(l_quantity AS BIGINT) AS value,
    o_orderpriority AS priority, l_returnflag AS returnflag,
    CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment,
    CASE WHEN n_nationkey % 3 = 2 THEN '' ELSE 'z' || (n_nationkey % 3) END AS zone,
    CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(p_size AS BIGINT) AS p_size, p_brand, p_type,
    CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name,
    l_quantity = 50 AS empty_stack
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey)
"""

# one row per frame; loc and pos count from the leaf, both from 0
LINE_FRAMES = LINE + """,
line_frames AS (
  SELECT *, row_number() OVER (PARTITION BY sid ORDER BY loc, pos) - 1 AS idx,
    count(*) OVER (PARTITION BY sid) AS n_frames
  FROM (
    SELECT s.*, 0 AS loc, 0 AS pos, 4096 + p_size * 16 AS address, CAST(0 AS BIGINT) AS mapping_start,
      '/usr/lib/' || lower(r_name) || '.so' AS mapping_file, 'b' || r_regionkey AS build_id,
      p_size % 4 <> 0 AS symbolized,
      CASE WHEN p_size % 4 <> 0 THEN p_brand END AS fn, CASE WHEN p_size % 4 <> 0 THEN '_' || p_brand END AS sysname,
      CASE WHEN p_size % 4 <> 0 THEN 'src/' || lower(p_type) || '.go' END AS filename,
      CASE WHEN p_size % 4 <> 0 THEN p_size END AS line,
      CASE WHEN p_size % 4 <> 0 THEN p_size - p_size % 10 END AS start_line, false AS inlined
    FROM line_samples s WHERE NOT empty_stack
    UNION ALL
    SELECT s.*, 1, 0, 200000 + length(p_type) * 64, 0, '/usr/lib/' || lower(r_name) || '.so', 'b' || r_regionkey,
      true, p_type, NULL, 'src/' || lower(p_type) || '.go', l_linenumber, 1, true
    FROM line_samples s WHERE NOT empty_stack
    UNION ALL
    SELECT s.*, 1, 1, 200000 + length(p_type) * 64, 0, '/usr/lib/' || lower(r_name) || '.so', 'b' || r_regionkey,
      true, 'type_dispatch', '_dispatch', 'src/dispatch.go', 100 + l_linenumber, 100, false
    FROM line_samples s WHERE NOT empty_stack
    UNION ALL
    SELECT s.*, 2, 0, 500000 + n_nationkey, 400000, '/usr/bin/app', 'app',
      true, n_name, n_name, '/go/src/nation.go', n_nationkey, 5, false
    FROM line_samples s WHERE NOT empty_stack
    UNION ALL
    SELECT s.*, 3 + k, 0, 700000 + r_regionkey, CASE WHEN r_regionkey <> 0 THEN 700000 END,
      CASE WHEN r_regionkey <> 0 THEN '/usr/lib/libc.so.6' END, CASE WHEN r_regionkey <> 0 THEN 'libc' END,
      true, r_name, r_name, '/go/src/region.go', r_regionkey, 7, false
    FROM line_samples s, (SELECT 0 AS k UNION ALL SELECT 1) WHERE NOT empty_stack AND (k = 0 OR r_regionkey = 4)))
"""

EVENT = """
event_samples AS (
  SELECT event_id, 'events' AS name, 'wall' AS sample_type, 'nanoseconds' AS sample_unit, 'wall' AS period_type,
    'nanoseconds' AS period_unit, CAST(60000000000 AS BIGINT) AS period, CAST(0 AS BIGINT) AS duration,
    epoch_us(ts) * 1000 AS time_nanos, (epoch_us(ts) * 1000) // 1000000 AS "timestamp",
    CAST(floor(value) AS BIGINT) AS value, CAST(user_id AS VARCHAR) AS "user", event_type AS kind,
    CAST(user_id % 4 AS VARCHAR) AS shard,
    'k' || (CAST(json_extract_string(props, '$.k') AS BIGINT) // 10) AS leaf
  FROM events)
"""


# root-first path of each sample as a list of node keys; ``{leaf_key}`` etc. allow regrouping
def tree(key: str = "CASE WHEN symbolized THEN fn ELSE '0x' || lower(to_hex(address)) END",
         where: str = "true", frames: str = LINE_FRAMES, source: str = "line_frames",
         value: str = "value", prefix: str = "''") -> str:
    """CTEs ending in ``nodes(path, parent, depth, leaf, …)``, one row per (sample, frame)."""
    return f"""{frames},
keyed AS (
  SELECT *, {key} AS k, {value} AS v, n_frames - idx AS depth0, {prefix} AS head
  FROM {source} WHERE {where}),
paths AS (
  SELECT *, head || string_agg(k, '/') OVER (PARTITION BY sid ORDER BY depth0 ROWS UNBOUNDED PRECEDING) AS path,
    head || coalesce(string_agg(k, '/') OVER (PARTITION BY sid ORDER BY depth0
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS parent,
    lag(k) OVER (PARTITION BY sid ORDER BY depth0) AS parent_key
  FROM keyed)"""
