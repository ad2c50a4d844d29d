"""Ingest steps on tables shaped like profile dictionaries, and symbol lookups."""

from pyspark.sql import functions as F

from stackloom.catalog.base import LINE_FRAMES
from stackloom.catalog.filtering import _by_stack
from stackloom.operators import symbolize as sym
from stackloom.operators.aggregate import merge
from stackloom.session import cut_lineage
from stackloom.sources import dictionary as dic
from stackloom.sources.arrow import ingest_arrow_v1
from stackloom.sources.labels import exported_labels, label_errors
from stackloom.sources.otlp import explode_timestamps
from stackloom.functions.scalar import labels_text, record
from stackloom.sources.tables import epoch_micros, line_samples, spread, table

P = "profile_id"


def _profile(c="l_suppkey"):
    return (F.col(c) % 3).cast("long").alias(P)


def _strings(s, d):
    """Part names, brands and types as string tables of three profiles; text 0 is empty."""
    part = table(s, d, "part")
    own = part.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias(P), "p_partkey", "p_name", "p_brand", "p_type")
    texts = own.select(P, F.inline(F.array(
        record(idx=F.col("p_partkey") * 4 + 1, text=F.col("p_name")),
        record(idx=F.col("p_partkey") * 4 + 2, text=F.col("p_brand")),
        record(idx=F.col("p_partkey") * 4 + 3, text=F.concat("p_type", F.lit(".go"))))))
    return texts.unionByName(s.range(3).select(F.col("id").alias(P), F.lit(0).cast("long").alias("idx"), F.lit("").alias("text")))


def _functions(s, d):
    c = F.col
    return table(s, d, "part").select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias(P), (c("p_partkey") + 1).alias("id"),
        (c("p_partkey") * 4 + 1).alias("name"), F.lit(0).cast("long").alias("system_name"),
        (c("p_partkey") * 4 + 3).alias("filename"), c("p_size").cast("long").alias("start_line"))


def _mappings(s, d):
    n = F.col("n_nationkey").cast("long")
    return table(s, d, "nation").select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias(P), (n + 1).alias("id"), (n * 1_000_000).alias("memory_start"),
        ((n + 1) * 1_000_000).alias("memory_limit"), F.lit(0).cast("long").alias("file_offset"),
        (n * 4 + 2).alias("filename"), (n * 4 + 1).alias("build_id"))


def _locations(s, d):
    line = "named_struct('function_id', {}, 'line', cast({} AS bigint), 'column', 0L)".format
    own, outer = line("p_partkey + 1", "p_size"), line("p_partkey % 7 + 1", "9")
    return table(s, d, "part").selectExpr(
        f"explode(array(0L, 1L, 2L)) AS {P}", "p_partkey + 1 AS id", "p_partkey % 26 AS mapping_id",
        "p_partkey + 4096 AS address",
        f"slice(array({own}, {outer}), 1, cast(p_partkey % 3 AS int)) AS lines")


def _samples(s, d):
    c = F.col
    return spread(table(s, d, "lineitem")).select(
        _profile(), F.array(c("l_partkey") + 1, c("l_suppkey") + 1, F.lit(2).cast("long")).alias("location_ids"),
        c("l_quantity").cast("long").alias("value"))


def _resolve(s, d):
    line = lambda x: F.concat_ws(":", x["function_name"], x["function_filename"], x["function_start_line"].cast("string"),
                                 x["line"].cast("string"))
    loc = lambda x: F.concat_ws("|", x["address"].cast("string"), F.coalesce(x["mapping_file"], F.lit("-")),
                                F.coalesce(x["mapping_build_id"], F.lit("-")), F.array_join(F.transform(x["lines"], line), "<"))
    rows = dic.resolve_stacks(_samples(s, d), _locations(s, d), _functions(s, d), _mappings(s, d), _strings(s, d), loc)
    return rows.groupBy(P, F.array_join("stacktrace", ";").alias("stack")).agg(
        F.count("*").alias("n"), F.sum("value").alias("total"))


def _unpivot(s, d):
    c = F.col
    kinds = F.array(*[record(type=F.lit(t), unit=F.lit(u)) for t, u in (
        ("samples", "count"), ("cpu", "nanoseconds"), ("alloc", "bytes"))])
    rows = spread(table(s, d, "lineitem")).select(
        "l_orderkey", F.array(c("l_quantity").cast("long"), ((c("l_linenumber") - 1) * 100).cast("long"),
                              F.floor(c("l_discount") * 100 + 0.5).cast("long")).alias("values"), kinds.alias("sample_types"))
    return dic.unpivot_sample_types(rows)


def _validate(s, d):
    """Broken references: a third of the locations and mappings left out, strings cut off."""
    locations = _locations(s, d).where("id % 3 <> 0")
    mappings = _mappings(s, d).where("id % 5 <> 0")
    strings = _strings(s, d).where("idx % 11 <> 3")
    functions = _functions(s, d).where("id <> 4")
    samples = _samples(s, d)
    errors = dic.validate_profiles(samples, locations, functions, mappings, strings)
    return errors.groupBy(P, "error").agg(F.count("*").alias("n"), F.sum("ref").alias("refs"))


def _label_dups(s, d):
    c = F.col
    pair = lambda n, v: record(name=n, value=v)
    labels = F.array(
        pair(F.when(c("o_orderkey") % 5 == 0, "other").otherwise(F.lit("__name__")), F.when(c("o_orderkey") % 7 == 0, "").otherwise(F.lit("cpu"))),
        pair(F.lit("status"), c("o_orderstatus")),
        pair(F.when(c("o_orderstatus") == "F", "status").otherwise(F.lit("prio-rity")), c("o_orderpriority")))
    return label_errors(table(s, d, "orders").select(c("o_orderkey").alias("series_id"), labels.alias("labels")))


def _exported(s, d):
    c = F.col
    pair = lambda n, v: record(name=n, value=v)
    series = F.create_map(F.lit("status"), c("o_orderstatus"), F.lit("exported_zone"), F.lit("x"))
    own = F.array(pair(F.lit("status"), c("o_orderpriority")), pair(F.lit("zo-ne"), F.lit("a")),
                  pair(F.lit("zo.ne"), F.lit("b")), pair(F.lit("exported_status"), F.lit("e")),
                  pair(F.lit("empty"), F.lit("")), pair(F.lit("1st"), c("o_orderstatus")))
    return table(s, d, "orders").select(c("o_orderkey").alias("id"), labels_text(exported_labels(series, own)).alias("labels"))


def _timestamps(s, d):
    c = F.col
    base = epoch_micros("l_shipdate") * 1000
    q = c("l_quantity").cast("long")
    times = F.when(c("l_linenumber") % 2 == 1, F.array(base, base + q)).otherwise(F.array().cast("array<bigint>"))
    values = F.when(c("l_linenumber") % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(q, q % 2))
    # rows with neither times nor values give no sample
    return spread(table(s, d, "lineitem")).select("l_orderkey", "l_linenumber", F.inline(explode_timestamps(times, values, base)))


def _stacktrace_ids(s, d):
    c = F.col
    part = table(s, d, "part")
    locations = part.select(
        c("p_partkey").cast("string").alias("stacktrace_id"), F.lit(True).alias("is_complete"),
        F.transform(F.array(c("p_partkey") + 4096, c("p_size").cast("long")), lambda a: record(
            address=a, mapping_start=F.lit(None).cast("long"), mapping_limit=F.lit(None).cast("long"),
            mapping_offset=F.lit(None).cast("long"), mapping_file=F.lit(None).cast("string"),
            mapping_build_id=F.lit(None).cast("string"),
            lines=F.array().cast("array<struct<line:bigint,column:bigint,function_name:string,function_system_name:string,"
                           "function_filename:string,function_start_line:bigint>>"))).alias("locations"))
    samples = spread(table(s, d, "lineitem")).select(
        F.lit("agent").alias("producer"), F.lit("samples").alias("sample_type"), F.lit("count").alias("sample_unit"),
        F.lit("cpu").alias("period_type"), F.lit("nanoseconds").alias("period_unit"), F.lit(100).cast("long").alias("period"),
        F.lit(0).cast("long").alias("duration"), (epoch_micros("l_shipdate") * 1000 + 999_999).alias("timestamp"),
        c("l_quantity").cast("long").alias("value"), c("l_returnflag").alias("labels.flag"),
        F.when(c("l_linenumber") > 3, c("l_linestatus")).alias("labels.status"), c("l_partkey").cast("string").alias("stacktrace_id"))
    out = ingest_arrow_v1(samples, locations)
    return out.select("name", "timestamp", "time_nanos", "value", labels_text("labels").alias("labels"),
                      F.array_join(F.transform("stacktrace", lambda x: x["address"].cast("string")), ";").alias("stack"))


def _symbols(s, d):
    """Two symbols per part at the same address, in five binaries, with gaps and sizeless ones."""
    c = F.col
    size = F.when(c("p_partkey") % 7 == 0, 0).when(c("p_partkey") % 3 == 0, 30).otherwise(200).cast("long")
    both = F.array(
        record(name=F.concat(F.lit("__"), c("p_name")), bind=F.lit("GLOBAL"), size=size),
        record(
            name=c("p_name"), bind=F.when(c("p_partkey") % 2 == 0, "WEAK").otherwise("GLOBAL"), size=size))
    return table(s, d, "part").select(
        F.concat(F.lit("b"), (c("p_partkey") % 5).cast("string")).alias("build_id"), (c("p_partkey") * 40 + 4096).alias("value"),
        F.when(c("p_size") == 13, "OBJECT").otherwise("FUNC").alias("type"), F.lit(True).alias("defined"), F.inline(both))


def _addresses(s, d):
    c = F.col
    return spread(table(s, d, "lineitem")).select(
        F.concat(F.lit("b"), (c("l_suppkey") % 5).cast("string")).alias("build_id"),
        (c("l_partkey") * 40 + 4096 + c("l_linenumber") * 20 - 60).alias("address"))


def _symbolized(s, d):
    """Stacks with their unsymbolised leaves filled in from the symbol tables."""
    profile = cut_lineage(merge(line_samples(s, d)))
    hits = sym.symbol_lines(sym.asof_symbols(sym.needs_symbols(profile), _leaf_symbols(s, d)))
    return _by_stack(sym.symbolize(profile, hits))


def _leaf_symbols(s, d):
    c = F.col
    return table(s, d, "part").select(
        F.concat(F.lit("b"), (c("p_size") % 4).cast("string")).alias("build_id"), (c("p_size") * 16 + 4090).cast("long").alias("value"),
        F.lit(20).cast("long").alias("size"), c("p_name").alias("name"), F.lit("GLOBAL").alias("bind"),
        F.lit("FUNC").alias("type"), F.lit(True).alias("defined"))


def _priority(s, d):
    c = F.col
    kinds = F.array(F.lit("symtab"), F.lit("pclntab"), F.lit("dwarf"), F.lit("unknown"))
    tables = table(s, d, "part").select(
        c("p_brand").alias("build_id"), F.get(kinds, F.when(c("p_size") == 1, 2).when(c("p_size") < 4, 1).when(
            c("p_size") == 50, 3).otherwise(0)).alias("source"), c("p_partkey").alias("address"), c("p_name").alias("name"))
    return sym.preferred_source(tables).select("build_id", "source", "address", "name")


QUERIES = {
    "unpivot_values": _unpivot,
    "resolve_stacks": _resolve,
    "validate_refs": _validate,
    "label_dups": _label_dups,
    "exported_labels": _exported,
    "explode_timestamps": _timestamps,
    "join_stacktrace_ids": _stacktrace_ids,
    "asof_symbolize": lambda s, d: sym.asof_symbols(_addresses(s, d), _symbols(s, d)),
    "needs_symbols": lambda s, d: sym.needs_symbols(line_samples(s, d)),
    "symbolize_stacks": _symbolized,
    "symbol_priority": _priority,
}

IDS = "(SELECT unnest([0, 1, 2]) AS pid)"
SQL = {
    "unpivot_values": """WITH v AS (SELECT l_orderkey, unnest([CAST(l_quantity AS BIGINT), (l_linenumber - 1) * 100,
          CAST(floor(l_discount * 100 + 0.5) AS BIGINT)]) AS value, unnest(['samples', 'cpu', 'alloc']) AS sample_type,
          unnest(['count', 'nanoseconds', 'bytes']) AS sample_unit FROM lineitem)
      SELECT l_orderkey, sample_type, sample_unit, value FROM v WHERE value <> 0""",
    "resolve_stacks": """WITH f AS (SELECT p_partkey + 1 AS id, p_name || ':' || p_type || '.go:' || p_size AS txt FROM part),
      l AS (SELECT p_partkey + 1 AS id, (p_partkey + 4096) || '|' || coalesce(m.p_brand, '-') || '|' || coalesce(m.p_name, '-') || '|' ||
          CASE p.p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN f.txt || ':' || p.p_size
            ELSE f.txt || ':' || p.p_size || '<' || g.txt || ':9' END AS txt
        FROM (SELECT * FROM part) p JOIN f ON f.id = p.p_partkey + 1 JOIN f g ON g.id = p.p_partkey % 7 + 1
          LEFT JOIN (SELECT n_nationkey + 1 AS mid, p_brand, p_name FROM nation JOIN part ON p_partkey = n_nationkey) m
            ON m.mid = p.p_partkey % 26)
      SELECT l_suppkey % 3 AS profile_id, a.txt || ';' || b.txt || ';' || c.txt AS stack, count(*) AS n,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total
      FROM lineitem JOIN l a ON a.id = l_partkey + 1 JOIN l b ON b.id = l_suppkey + 1 JOIN l c ON c.id = 2 GROUP BY 1, 2""".replace(
        "p_partkey + 1 AS id, (p_partkey + 4096)", "p.p_partkey + 1 AS id, (p.p_partkey + 4096)"),
    "validate_refs": f"""WITH i AS {IDS}, strs AS (SELECT pid, idx FROM i, (SELECT unnest([p_partkey * 4 + 1, p_partkey * 4 + 2, p_partkey * 4 + 3]) AS idx FROM part
            UNION ALL SELECT 0) WHERE idx % 11 <> 3),
      loc AS (SELECT pid, p_partkey + 1 AS id, p_partkey % 26 AS mid, p_partkey AS k FROM part, i WHERE (p_partkey + 1) % 3 <> 0),
      fn AS (SELECT pid, p_partkey + 1 AS id, p_partkey * 4 + 1 AS name, p_partkey * 4 + 3 AS filename FROM part, i WHERE p_partkey + 1 <> 4),
      mp AS (SELECT pid, n_nationkey + 1 AS id, n_nationkey * 4 + 2 AS filename, n_nationkey * 4 + 1 AS build_id FROM nation, i WHERE (n_nationkey + 1) % 5 <> 0),
      refs AS (SELECT DISTINCT l_suppkey % 3 AS pid, unnest([l_partkey + 1, l_suppkey + 1, 2]) AS ref FROM lineitem),
      lines AS (SELECT pid, k + 1 AS ref FROM loc WHERE k % 3 <> 0 UNION SELECT pid, k % 7 + 1 FROM loc WHERE k % 3 = 2),
      e AS (SELECT pid, 'sample location out of range' AS error, ref FROM refs WHERE (pid, ref) NOT IN (SELECT pid, id FROM loc)
        UNION ALL SELECT DISTINCT pid, 'location mapping out of range', mid FROM loc WHERE mid <> 0 AND (pid, mid) NOT IN (SELECT pid, id FROM mp)
        UNION ALL SELECT pid, 'line function out of range', ref FROM lines WHERE (pid, ref) NOT IN (SELECT pid, id FROM fn)
        UNION ALL SELECT pid, 'function name out of range', name FROM fn WHERE (pid, name) NOT IN (SELECT pid, idx FROM strs)
        UNION ALL SELECT pid, 'function filename out of range', filename FROM fn WHERE (pid, filename) NOT IN (SELECT pid, idx FROM strs)
        UNION ALL SELECT pid, 'mapping filename out of range', filename FROM mp WHERE (pid, filename) NOT IN (SELECT pid, idx FROM strs)
        UNION ALL SELECT pid, 'mapping build_id out of range', build_id FROM mp WHERE (pid, build_id) NOT IN (SELECT pid, idx FROM strs)
        UNION ALL SELECT pid, 'mapping id not sequential', id FROM mp WHERE id > (SELECT count(*) FROM mp m WHERE m.pid = mp.pid)
        UNION ALL SELECT pid, 'function id not sequential', id FROM fn WHERE id > (SELECT count(*) FROM fn f WHERE f.pid = fn.pid)
        UNION ALL SELECT pid, 'location id not sequential', id FROM loc WHERE id > (SELECT count(*) FROM loc l WHERE l.pid = loc.pid))
      SELECT CAST(pid AS BIGINT) AS profile_id, error, count(*) AS n, CAST(sum(ref) AS BIGINT) AS refs FROM e GROUP BY 1, 2""",
    "label_dups": """SELECT o_orderkey AS series_id, 'invalid label name' AS error, 'prio-rity' AS label FROM orders WHERE o_orderstatus <> 'F'
      UNION ALL SELECT o_orderkey, 'duplicate label name', 'status' FROM orders WHERE o_orderstatus = 'F'
      UNION ALL SELECT o_orderkey, 'missing name', '__name__' FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0""",
    "exported_labels": """SELECT o_orderkey AS id, '1st=' || o_orderstatus || ',exported_exported_status=' || o_orderpriority ||
        ',exported_status=e,zo_ne=a' AS labels FROM orders""",
    "explode_timestamps": """WITH r AS (SELECT *, epoch_us(l_shipdate) * 1000 AS base, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
      x AS (SELECT *, unnest([0, 1]) AS i FROM r)
      SELECT l_orderkey, l_linenumber, base + CASE WHEN l_linenumber % 2 = 1 AND i = 1 THEN q ELSE 0 END AS time_nanos,
        CASE WHEN l_linenumber % 3 = 0 THEN 1 WHEN i = 0 THEN q ELSE q % 2 END AS value
      FROM x WHERE (l_linenumber % 2 = 1) OR (l_linenumber % 3 <> 0 AND CASE WHEN i = 0 THEN q ELSE q % 2 END <> 0)""",
    "join_stacktrace_ids": """SELECT 'agent' AS name, epoch_us(l_shipdate) // 1000 AS "timestamp", epoch_us(l_shipdate) * 1000 + 999999 AS time_nanos,
        CAST(l_quantity AS BIGINT) AS value, 'flag=' || l_returnflag || CASE WHEN l_linenumber > 3 THEN ',status=' || l_linestatus ELSE '' END AS labels,
        (p_partkey + 4096) || ';' || p_size AS stack FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "asof_symbolize": """WITH f AS (SELECT 'b' || (p_partkey % 5) AS build_id, p_partkey * 40 + 4096 AS value, p_partkey,
          CASE WHEN p_partkey % 2 = 0 THEN '__' || p_name ELSE p_name END AS name,
          CASE WHEN p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 3 = 0 THEN 30 ELSE 200 END AS size FROM part WHERE p_size <> 13),
      a AS (SELECT DISTINCT 'b' || (l_suppkey % 5) AS build_id, l_partkey * 40 + 4096 + l_linenumber * 20 - 60 AS address FROM lineitem)
      SELECT a.build_id, a.address, CASE WHEN address < value + size THEN name END AS symbol,
        CASE WHEN address < value + size THEN value END AS symbol_start
      FROM a ASOF LEFT JOIN f ON a.build_id = f.build_id AND a.address >= f.value""",
    "needs_symbols": f"""WITH {LINE_FRAMES} SELECT DISTINCT build_id, mapping_file, CAST(mapping_start AS BIGINT) AS mapping_start,
        1000000 + r_regionkey * 100 AS mapping_limit, CAST(0 AS BIGINT) AS mapping_offset, address FROM line_frames WHERE NOT symbolized""",
    "symbolize_stacks": f"""WITH {LINE_FRAMES}, cand AS (SELECT 'b' || (p_size % 4) AS build_id, p_size * 16 + 4090 AS value, max(
            struct_pack(len := strlen(p_name), name := p_name)).name AS sym FROM part GROUP BY 1, 2),
      un AS (SELECT DISTINCT build_id, address FROM line_frames WHERE NOT symbolized),
      hits AS (SELECT un.build_id, address, CASE WHEN address < value + 20 THEN sym END AS sym
        FROM un ASOF LEFT JOIN cand ON un.build_id = cand.build_id AND un.address >= cand.value),
      fr AS (SELECT f.sid, idx, CASE WHEN symbolized THEN fn ELSE coalesce(sym, '0x' || lower(to_hex(f.address))) END AS k
        FROM line_frames f LEFT JOIN hits h ON h.build_id = f.build_id AND h.address = f.address AND NOT symbolized),
      {{texts}}
      SELECT stack, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM m GROUP BY 1""".replace("{texts}", """st AS (
        SELECT sid, string_agg(k, ';' ORDER BY idx) AS stack FROM fr GROUP BY 1),
      full_ AS (SELECT sid, string_agg(concat_ws('|', coalesce(fn, '-'), address, coalesce(mapping_file, '-'), coalesce(line, -1)), ';' ORDER BY idx) AS fs
        FROM line_frames GROUP BY 1),
      m AS (SELECT coalesce(st.stack, '') AS stack, fs, sum(value * period) AS v FROM line_samples LEFT JOIN st USING (sid) LEFT JOIN full_ USING (sid) GROUP BY 1, 2)"""),
    "symbol_priority": """WITH t AS (SELECT p_brand AS build_id, CASE WHEN p_size = 1 THEN 'dwarf' WHEN p_size < 4 THEN 'pclntab'
          WHEN p_size = 50 THEN 'unknown' ELSE 'symtab' END AS source,
          CASE WHEN p_size = 1 THEN 1 WHEN p_size < 4 THEN 2 WHEN p_size = 50 THEN NULL ELSE 3 END AS r, p_partkey AS address, p_name AS name FROM part)
      SELECT build_id, source, address, name FROM t WHERE r = (SELECT min(r) FROM t u WHERE u.build_id = t.build_id)""",
}
