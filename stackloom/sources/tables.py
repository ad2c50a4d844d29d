"""Views of the driver's relational tables as samples, symbols and dictionaries.

Every registered query runs on these, so its work grows with the tables.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


# Schemas of the tables in use; without them every read costs a job over the footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan that has too few splits to keep every core busy.

    A large table already has more splits than cores and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def epoch_micros(ts: str) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, whatever the session zone."""
    return F.expr(
        f"unix_date(cast({ts} as date)) * 86400000000L + hour({ts}) * 3600000000L"
        f" + minute({ts}) * 60000000L + cast(extract(SECOND from {ts}) * 1000000 as bigint)"
    )


def _line(line: str, name: str, system_name: str, filename: str, start_line: str) -> str:
    return (f"named_struct('line', cast({line} as bigint), 'column', 0L, 'function_name', {name}, "
            f"'function_system_name', {system_name}, 'function_filename', {filename}, "
            f"'function_start_line', cast({start_line} as bigint))")


LINE_ARRAY = (
    "array<struct<line:bigint,column:bigint,function_name:string,"
    "function_system_name:string,function_filename:string,function_start_line:bigint>>"
)


def _location(address: str, start: str, limit: str, offset: str, file: str, build_id: str, lines: str) -> str:
    return (f"named_struct('address', cast({address} as bigint), 'mapping_start', cast({start} as bigint), "
            f"'mapping_limit', cast({limit} as bigint), 'mapping_offset', cast({offset} as bigint), "
            f"'mapping_file', {file}, 'mapping_build_id', {build_id}, 'lines', cast({lines} as {LINE_ARRAY}))")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation: zone, library, and the frames that all stacks of it end with.

    They are made once, not per sample. With them, the method that makes a sample's stack had 8,672 bytes of code, and the
    JVM compiles none above 8,000.
    """
    if_mapped = lambda x: f"CASE WHEN r_regionkey <> 0 THEN {x} END"
    nation = _location("500000 + n_nationkey", "400000", "600000", "4096", "'/usr/bin/app'", "'app'",
                       f"array({_line('n_nationkey', 'n_name', 'n_name', repr('/go/src/nation.go'), '5')})")
    region = _location("700000 + r_regionkey", if_mapped("700000"), if_mapped("800000"), if_mapped("0"),
                       if_mapped("'/usr/lib/libc.so.6'"), if_mapped("'libc'"),
                       f"array({_line('r_regionkey', 'r_name', 'r_name', repr('/go/src/region.go'), '7')})")
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey")).selectExpr(
        "n_nationkey", "CASE WHEN n_nationkey % 3 = 2 THEN '' ELSE concat('z', cast(n_nationkey % 3 AS string)) END AS zone",
        "concat('/usr/lib/', lower(r_name), '.so') AS lib", "concat('b', cast(r_regionkey as string)) AS build",
        "1000000 + r_regionkey * 100 AS lib_end",
        f"CASE WHEN r_regionkey = 4 THEN array({nation}, {region}, {region}) ELSE array({nation}, {region}) END AS outer_frames")


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as CPU samples: brand < type (inlined into a dispatcher) < nation < region.

    Exercises the awkward cases: unsymbolised leaves, absent and empty labels,
    a frame without mapping, recursion, empty stacks.
    """
    places = _places(spark, sf_dir)
    joined = (
        spread(table(spark, sf_dir, "lineitem"))
        .join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
        .join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
        .join(places, F.expr("c_nationkey = n_nationkey"))
    )
    type_file = "concat('src/', lower(p_type), '.go')"
    leaf_line = _line("p_size", "p_brand", "concat('_', p_brand)", type_file, "p_size - p_size % 10")
    leaf = _location("4096 + p_size * 16", "0", "lib_end", "0", "lib", "build",
                     f"CASE WHEN p_size % 4 = 0 THEN array() ELSE array({leaf_line}) END")
    kind = _location("200000 + length(p_type) * 64", "0", "lib_end", "0", "lib", "build", "array(" + ", ".join([
        _line("l_linenumber", "p_type", "cast(null as string)", type_file, "1"),
        _line("100 + l_linenumber", "'type_dispatch'", "'_dispatch'", "'src/dispatch.go'", "100")]) + ")")
    return joined.withColumn("time_nanos", epoch_micros("l_shipdate") * 1000).selectExpr(
        "'process_cpu' AS name", "'samples' AS sample_type", "'count' AS sample_unit", "'cpu' AS period_type",
        "'nanoseconds' AS period_unit", "100L AS period",
        "CASE WHEN l_linestatus = 'F' THEN 10000000000L ELSE 0L END AS duration",
        "time_nanos DIV 1000000L AS timestamp", "time_nanos", "cast(l_quantity AS bigint) AS value",
        """map_filter(map('priority', o_orderpriority, 'returnflag', l_returnflag,
             'segment', CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END, 'zone', zone),
             (k, v) -> v IS NOT NULL) AS labels""",
        f"CASE WHEN l_quantity = 50 THEN array() ELSE concat(array({leaf}, {kind}), outer_frames) END AS stacktrace")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as wall-clock samples with a dense, irregular time axis and no binaries."""
    plain = lambda name: _location("0", "null", "null", "null", "cast(null as string)", "cast(null as string)",
                                   f"array({_line('1', name, name, repr('events.py'), '1')})")
    group = "concat('k', cast(cast(get_json_object(props, '$.k') AS bigint) DIV 10 AS string))"
    return spread(table(spark, sf_dir, "events")).withColumn("time_nanos", epoch_micros("ts") * 1000).selectExpr(
        "'events' AS name", "'wall' AS sample_type", "'nanoseconds' AS sample_unit", "'wall' AS period_type",
        "'nanoseconds' AS period_unit", "60000000000L AS period", "0L AS duration",
        "time_nanos DIV 1000000L AS timestamp", "time_nanos", "cast(floor(value) AS bigint) AS value",
        "map('user', cast(user_id AS string), 'kind', event_type, 'shard', cast(user_id % 4 AS string)) AS labels",
        f"array({plain(group)}, {plain('event_type')}) AS stacktrace")
