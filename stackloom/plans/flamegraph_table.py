"""Flame graph in table form: nodes that point into tables of strings, functions, mappings and locations.

The tree is that of :mod:`stackloom.plans.flamegraph` (siblings merge by function name, those without a function by
address). A node names one location of those merged into it, the one at the least address, and the line of that
location. Only locations that a node names are in the tables. All ids are dense and assigned without a global sort.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from stackloom.functions.scalar import unsigned_key
from stackloom.operators.lookup import lookup, lookups
from stackloom.operators.running import dense_ids
from stackloom.plans.flamegraph import NO_ID, ROOT, with_ids
from stackloom.schema import LOCATION
from stackloom.session import cut_lineage

FUNCTION = ["name", "system_name", "filename", "start_line"]
MAPPING = ["start", "limit", "offset", "file", "build_id"]
_TEXTS = {"functions": ["name", "system_name", "filename"], "mappings": ["file", "build_id"]}


@dataclass(frozen=True)
class TableForm:
    """``strings(id, text)``, id 0 being empty; ``functions(id, name, system_name, filename, start_line)`` and ``mappings(id,
    start, limit, offset, file, build_id)`` with string ids; ``locations(id, address, mapping, lines(function, line))``;
    ``nodes(id, parent, depth, location, line_index, mapping, cumulative, flat, diff)``.

    Ids count from 1, 0 means none. The root is the node 0, at depth 0. The mapping of a node is that of its location
    if all that was merged agrees on one, else 0.
    """

    strings: DataFrame
    functions: DataFrame
    mappings: DataFrame
    locations: DataFrame
    nodes: DataFrame


# nulls leave a hash unchanged, so it is told which fields are null
PLACE = ("xxhash64(loc, loc.mapping_start IS NULL, loc.mapping_limit IS NULL, loc.mapping_offset IS NULL, loc.mapping_file IS NULL, "
         "loc.mapping_build_id IS NULL, transform(loc.lines, x -> array(x.line IS NULL, x.column IS NULL, x.function_name IS NULL, "
         "x.function_system_name IS NULL, x.function_filename IS NULL, x.function_start_line IS NULL)))")


def _paths(profile: DataFrame) -> DataFrame:
    """Rows (value, diff, path): frames root first, each with its location's hash and the line it stands for."""
    diff = F.col("diff") if "diff" in profile.columns else F.lit(0).cast("long").alias("diff")
    place = (f"'address', loc.address, 'place', {PLACE}, 'mapping', xxhash64(loc.mapping_start IS NULL, loc.mapping_start, "
             "loc.mapping_limit, loc.mapping_offset, loc.mapping_file IS NULL, loc.mapping_file, loc.mapping_build_id)")
    frame = ("named_struct('symbolized', true, 'name', coalesce(x.function_name, ''), 'key_address', cast(null AS bigint), "
             f"{place}, 'line_index', i)")
    bare = f"named_struct('symbolized', false, 'name', cast(null AS string), 'key_address', loc.address, {place}, 'line_index', 0)"
    lines = f"if(size(loc.lines) > 0, reverse(transform(loc.lines, (x, i) -> {frame})), array({bare}))"
    return profile.select("value", diff, "stacktrace").selectExpr(
        "value", "diff", f"flatten(transform(reverse(stacktrace), loc -> {lines})) AS path")


def _nodes(profile: DataFrame) -> DataFrame:
    merged = _paths(profile).groupBy("path").agg(F.sum("value").alias("value"), F.sum("diff").alias("diff"))
    exploded = with_ids(merged).selectExpr("value", "diff", f"""inline(concat(
      array(named_struct('node_id', {ROOT}, 'parent_id', {NO_ID}, 'depth', 0, 'leaf', false, 'empty', size(path) = 0,
        'address', 0L, 'place', 0L, 'mapping', 0L, 'line_index', 0)),
      transform(path, (f, i) -> named_struct('node_id', ids[i + 1], 'parent_id', ids[i], 'depth', i + 1, 'leaf', i + 1 = size(path),
        'empty', false, 'address', f.address, 'place', f.place, 'mapping', f.mapping, 'line_index', f.line_index))))""")
    by = ["node_id", "parent_id", "depth"]
    # by node and place first, in buffers of fixed width; the least place is then sought among few rows
    places = exploded.groupBy(*by, "address", "place", "mapping", "line_index").agg(
        F.sum(F.when(F.col("empty"), 0).otherwise(F.col("value"))).alias("cumulative"),
        F.sum(F.when(F.col("leaf"), F.col("value")).otherwise(0)).alias("flat"),
        F.sum(F.when(F.col("empty"), 0).otherwise(F.col("diff"))).alias("diff"))
    least = F.min(F.struct(unsigned_key("address").alias("at"), "place", "line_index"))
    return places.groupBy(*by).agg(
        least.alias("least"), (F.min("mapping") == F.max("mapping")).alias("agreed"),
        *[F.sum(c).alias(c) for c in ("cumulative", "flat", "diff")])


def flamegraph_table(profile: DataFrame) -> TableForm:
    """The table form of a profile's flame graph; stacks without frames hang nowhere and count for no node."""
    nodes = cut_lineage(_nodes(profile))
    named = nodes.where("depth > 0").select(F.col("least.place").alias("place")).distinct()
    content = profile.select(F.explode(F.array_distinct("stacktrace")).alias("loc")).select(
        F.expr(PLACE).alias("place"), F.col("loc").cast(LOCATION).alias("loc")).dropDuplicates(["place"])
    found = cut_lineage(dense_ids(content.join(named, "place", "left_semi"), ["place"], "id"))

    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    lines = found.select(F.col("id").alias("location"), F.posexplode("loc.lines").alias("pos", "x")).select(
        "location", "pos", text("x.function_name").alias("name"), text("x.function_system_name").alias("system_name"),
        text("x.function_filename").alias("filename"), F.coalesce("x.function_start_line", F.lit(0).cast("long")).alias("start_line"),
        F.coalesce("x.line", F.lit(0).cast("long")).alias("line"))
    functions = cut_lineage(dense_ids(lines.select(*FUNCTION).distinct(), FUNCTION, "id"))
    mapped = found.where("loc.mapping_start IS NOT NULL").select(
        "id", *[F.col(f"loc.mapping_{c}").alias(c) for c in MAPPING[:3]], text("loc.mapping_file").alias("file"),
        text("loc.mapping_build_id").alias("build_id"))
    mappings = cut_lineage(dense_ids(mapped.select(*MAPPING).distinct(), MAPPING, "id"))

    tables = {"functions": functions, "mappings": mappings}
    texts = reduce(DataFrame.union, [t.select(F.explode(F.array(*_TEXTS[n])).alias("text")) for n, t in tables.items()])
    strings = cut_lineage(dense_ids(texts.where("text <> ''").distinct(), ["text"], "id"))
    strings = strings.unionByName(strings.sparkSession.range(1).select(F.lit("").alias("text"), F.lit(0).cast("long").alias("id")))

    def coded(table: DataFrame, columns: list[str]) -> DataFrame:
        found = [(strings.select(F.col("text").alias(c), F.col("id").alias(f"{c}_id")), [c]) for c in columns]
        rest = [c for c in table.columns if c not in columns]
        return lookups(table, found, ["id"]).select(*rest, *[F.col(f"{c}_id").alias(c) for c in columns])

    with_function = lookup(lines, functions.withColumnRenamed("id", "function"), FUNCTION, ["location", "pos"])
    per_location = with_function.groupBy(F.col("location").alias("id")).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "function", "line"))),
        lambda x: F.struct(x["function"].alias("function"), x["line"].alias("line"))).alias("lines"))
    with_mapping = lookup(mapped, mappings.withColumnRenamed("id", "mapping"), MAPPING, ["id"]).select("id", "mapping")
    none = F.lit(0).cast("long")
    locations = cut_lineage(
        found.select("id", "place", F.col("loc.address").alias("address")).join(with_mapping, "id", "left").join(per_location, "id", "left")
        .select("id", "place", "address", F.coalesce("mapping", none).alias("mapping"),
                F.coalesce("lines", F.array().cast("array<struct<function:bigint,line:bigint>>")).alias("lines")))

    numbered = cut_lineage(dense_ids(nodes.where("depth > 0"), ["node_id"], "id"))
    top = nodes.where("depth = 0").withColumn("id", none)
    ids = numbered.select("node_id", "id").unionByName(top.select("node_id", "id"))
    placed = lookups(numbered.select("*", F.col("least.place").alias("place"), F.col("least.line_index").alias("line_index")),
                     [(ids.select(F.col("node_id").alias("parent_id"), F.col("id").alias("parent")), ["parent_id"]),
                      (locations.select("place", F.col("id").alias("location"), "mapping"), ["place"])], ["id"])
    columns = ["id", "parent", "depth", "location", "line_index", "mapping", "cumulative", "flat", "diff"]
    placed = placed.withColumn("mapping", F.when(F.col("agreed"), F.col("mapping")).otherwise(none))
    root = top.select("*", F.lit(None).cast("long").alias("parent"), none.alias("location"), F.lit(0).alias("line_index"), none.alias("mapping"))
    return TableForm(strings.select("id", "text"), coded(functions, _TEXTS["functions"]).select("id", *FUNCTION),
                     coded(mappings, _TEXTS["mappings"]).select("id", *MAPPING), locations.drop("place"),
                     cut_lineage(placed.select(*columns).unionByName(root.select(*columns))))


def listed(form: TableForm) -> DataFrame:
    """Nodes with what they point at, ids replaced by text: the table form read back."""
    text = lambda c: form.strings.select(F.col("id").alias(c), F.col("text").alias(f"{c}_text"))

    def named(table, columns):
        rest = [c for c in table.columns if c not in columns]
        return lookups(table, [(text(c), [c]) for c in columns], ["id"]).select(*rest, *[F.col(f"{c}_text").alias(c) for c in columns])

    functions, mappings = named(form.functions, _TEXTS["functions"]), named(form.mappings, _TEXTS["mappings"])
    places = form.locations.select(F.col("id").alias("location"), "address", "lines")
    nodes = cut_lineage(lookup(form.nodes.where("depth > 0"), places, ["location"], ["id"]).withColumn(
        "function", F.get("lines", F.col("line_index"))["function"]).drop("lines"))
    nodes = lookups(nodes, [(functions.withColumnRenamed("id", "function"), ["function"]),
                            (mappings.select(F.col("id").alias("mapping"), "file", "build_id"), ["mapping"])], ["id"])
    nodes = nodes.withColumn("frame", F.when(F.col("function").isNotNull(), F.col("name")).otherwise(
        F.concat(F.lit("0x"), F.lower(F.hex("address")))))
    nodes = cut_lineage(nodes.select("id", "parent", "depth", "frame", "address", "line_index", "file", "build_id", "system_name", "filename",
                                     "start_line", "cumulative", "flat", "diff"))
    parents = nodes.select(F.col("id").alias("parent"), F.col("frame").alias("parent_frame"))
    return lookup(nodes, parents, ["parent"], ["id"]).select(
        "depth", "frame", F.col("parent_frame").alias("parent"), "address", "line_index", F.col("file").alias("mapping_file"),
        F.col("build_id").alias("mapping_build_id"), "system_name", "filename", "start_line", "cumulative", "flat", "diff")
