"""Flame graph: the prefix tree of all stacks, rolled up bottom-up by one aggregation.

Each stack carries the running hash of every prefix of its root-first frames.
A prefix hash *is* the tree node, so the tree is an explode and a groupBy:
partial aggregation collapses the hot nodes near the root before the shuffle.
Ids are two independently chained 64-bit hashes, so distinct paths stay apart
at any realistic tree size.
"""

from pyspark.sql import Column, DataFrame, functions as F

from stackloom.functions.scalar import labels_text
from stackloom.operators.frames import frames
from stackloom.operators.ancestors import sum_over_ancestors
from stackloom.operators.running import running_sum
from stackloom.session import cut_lineage

FRAME_GROUPS = ("function_name", "mapping_file", "location_address", "function_file_name", "timestamp")
KEY_COLUMNS = ["labels_only", "labels", "symbolized", "name", "key_address", "key_mapping_file", "key_filename"]
META_COLUMNS = ["mapping_file", "mapping_build_id", "address", "line", "start_line", "system_name",
                "filename", "inlined"]


def check_group_by(group_by) -> list[str]:
    """Label names among the group-by fields; anything unknown is an error."""
    for field in group_by:
        if not field.startswith("labels.") and field not in FRAME_GROUPS:
            raise ValueError(f"invalid group by field: {field}")
    return list(dict.fromkeys(f.removeprefix("labels.") for f in group_by if f.startswith("labels.")))


ROOT = "named_struct('hi', 0L, 'lo', 1L)"
NO_ID = "named_struct('hi', cast(null AS bigint), 'lo', cast(null AS bigint))"
TYPES = {k: "bigint" for k in ("key_address", "address", "line", "start_line")} | {"inlined": "boolean"}


def root_id() -> Column:
    return F.expr(ROOT)


def _typed_null(name: str) -> str:
    return f"cast(null AS {TYPES.get(name, 'string')})"


def _active_keys(group_by) -> list[str]:
    """Key columns that can be set at all under a grouping."""
    keys = ["symbolized", "name", "key_address"]
    if any(g.startswith("labels.") for g in group_by):
        keys += ["labels_only", "labels"]
    return keys + [k for k, g in (("key_mapping_file", "mapping_file"), ("key_filename", "function_file_name")) if g in group_by]


def _keyed(group_by, metas) -> str:
    """The frame ``f`` with the columns that decide its identity among its siblings."""
    values = {"symbolized": "f.symbolized", "name": "f.name", "labels_only": "false", "labels": _typed_null("labels"),
              "key_address": "f.address" if "location_address" in group_by else "if(f.symbolized, null, f.address)",
              "key_mapping_file": "if(f.symbolized, f.mapping_file, null)", "key_filename": "if(f.symbolized, f.filename, null)"}
    fields = [f"'{k}', {values[k]}" for k in _active_keys(group_by)] + [f"'{m}', f.{m}" for m in metas]
    return f"named_struct({', '.join(fields)})"


def _empty_frame(group_by, metas, **values) -> str:
    """Fields of a node without a frame: the root, or a label node."""
    values = {"labels_only": "false", "symbolized": "false"} | values
    return ", ".join(f"'{k}', {values.get(k, _typed_null(k))}" for k in _active_keys(group_by) + metas)


def frame_text_sql(f: str = "", labels: bool = True) -> str:
    """How a node is listed: its function, its labels, or its address."""
    of_labels = f"WHEN {f}labels_only THEN {f}labels" if labels else ""
    return f"CASE WHEN {f}symbolized THEN {f}name {of_labels} ELSE concat('0x', lower(hex({f}key_address))) END"


def frame_text() -> Column:
    return F.expr(frame_text_sql())


def label_nodes(rows: DataFrame, label_names: list[str], group_by=(), metas=()) -> DataFrame:
    """Replace ``values`` (those of the labels, in the order of their names) by a label node at the root of ``path``.

    It comes after rows are merged, so labels are written as text once per merged row.
    """
    text = labels_text(F.map_from_arrays(F.lit(label_names), F.transform("values", lambda v: F.coalesce(v, F.lit("")))))
    label_frame = f"named_struct({_empty_frame(group_by, list(metas), labels_only='true', labels='text')})"
    return rows.withColumn("text", text).selectExpr(
        *[c for c in rows.columns if c not in ("values", "path")], f"concat(if(text = '', array(), array({label_frame})), path) AS path")


def root_paths(profile: DataFrame, group_by=(), carry=(), metas=()) -> DataFrame:
    """One row per profile row with ``path``: its frames root first, reduced to what identifies and describes nodes.

    With labels among the group-by fields, their ``values`` come along; :func:`label_nodes` makes nodes of them.
    """
    metas = list(metas)
    label_names = check_group_by(group_by)
    needed = {"symbolized", "name", "address", *metas}
    needed |= {c for g, c in (("mapping_file", "mapping_file"), ("function_file_name", "filename")) if g in group_by}
    diff = F.col("diff") if "diff" in profile.columns else F.lit(0).cast("long").alias("diff")
    values = F.array(*[F.nullif(F.try_element_at("labels", F.lit(n)), F.lit("")) for n in label_names]).alias("values")
    own = ["values"] if label_names else []
    rows = profile.select("value", diff, *carry, frames("stacktrace", sorted(needed)).alias("frames"), *([values] if label_names else []))
    return rows.selectExpr("value", "diff", *carry, *own, f"transform(reverse(frames), f -> {_keyed(group_by, metas)}) AS path")


def with_ids(paths: DataFrame, group_by=()) -> DataFrame:
    """Add the node ids of all prefixes of ``path``.

    ``ids`` starts with the root's id, so ``ids[i]`` is the parent of ``path[i]``.
    """
    # null parts leave a hash unchanged, so each nullable part is led by its presence
    key = "f.symbolized, " + ", ".join(f"f.{k} IS NULL, f.{k}" for k in _active_keys(group_by)
                                       if k not in ("symbolized", "labels_only"))
    child = (f"named_struct('hi', xxhash64(element_at(acc, -1).hi, {key}), "
             f"'lo', xxhash64({key}, element_at(acc, -1).lo, 7))")
    return paths.selectExpr("*", f"aggregate(path, array({ROOT}), (acc, f) -> array_append(acc, {child})) AS ids")


def flamegraph(profile: DataFrame, group_by=(), meta: bool = False) -> DataFrame:
    """Nodes of the prefix tree, root included (depth 0, sum of its children).

    ``meta=True`` adds binary, address, line, … of each node: the common value
    of all merged rows, null where they disagree. Rows are first aggregated by
    node *and* metadata, which is a small multiple of the node count, so the
    min/max reconciliation runs on already collapsed data.
    """
    metas = META_COLUMNS if meta else []
    keys = _active_keys(group_by)
    # merged by what the tree shows: narrower and far fewer keys than whole stacks
    names = check_group_by(group_by)
    merged = root_paths(profile, group_by, metas=metas).groupBy("path", *(["values"] if names else [])).agg(
        F.sum("value").alias("value"), F.sum("diff").alias("diff"))
    paths = with_ids(label_nodes(merged, names, group_by, metas) if names else merged, group_by)
    parent = frame_text_sql("get(path, i - 1).", labels="labels" in keys)
    exploded = paths.selectExpr("value", "diff", f"""inline(concat(
      array(named_struct('node_id', {ROOT}, 'parent_id', {NO_ID}, 'depth', 0, 'leaf', size(path) = 0,
        'parent', cast(null AS string), {_empty_frame(group_by, metas)})),
      transform(path, (f, i) -> named_struct('node_id', ids[i + 1], 'parent_id', ids[i], 'depth', i + 1,
        'leaf', i + 1 = size(path), 'parent', if(i > 0, {parent}, null){"".join(f", '{k}', f.{k}" for k in keys + metas)}))))""")
    # stacks without frames hang nowhere, so they add nothing to the root
    counts = (F.col("depth") > 0) | ~F.col("leaf")
    at_leaf = (F.col("depth") > 0) & F.col("leaf")
    flat = F.when(at_leaf & ~F.col("labels_only") if "labels_only" in keys else at_leaf, F.col("value")).otherwise(0)
    by = ["node_id", "parent_id", "depth", "parent"] + keys
    nodes = exploded.groupBy(*by, *metas).agg(
        F.sum(F.when(counts, F.col("value")).otherwise(0)).alias("cumulative"),
        F.sum(flat).alias("flat"),
        F.sum(F.when(counts, F.col("diff")).otherwise(0)).alias("diff"),
        F.count("*").alias("rows"),
    )
    if meta:
        agree = lambda m: F.when(
            (F.min(m) == F.max(m)) & (F.sum(F.when(F.col(m).isNotNull(), F.col("rows"))) == F.sum("rows")), F.min(m)
        ).alias(m)
        nodes = nodes.groupBy(*by).agg(
            F.sum("cumulative").alias("cumulative"), F.sum("flat").alias("flat"), F.sum("diff").alias("diff"),
            *[agree(m) for m in META_COLUMNS],
        )
    inactive = {"labels_only": "false"}
    return nodes.selectExpr(
        "node_id", "parent_id", "depth", "parent",
        *[k if k in keys else f"{inactive.get(k, _typed_null(k))} AS {k}" for k in KEY_COLUMNS],
        *metas, "cumulative", "flat", "diff")


def total(profile: DataFrame) -> DataFrame:
    """Totals of a profile; stacks without frames count."""
    diff = F.col("diff") if "diff" in profile.columns else F.lit(0).cast("long")
    return profile.agg(F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("value"),
                       F.coalesce(F.sum(diff), F.lit(0)).cast("long").alias("diff"))


def height(profile: DataFrame, legacy: bool = False) -> DataFrame:
    """Depth of the untrimmed tree plus the root; the legacy form counts locations, not lines."""
    size = F.size("stacktrace") if legacy else F.size(frames("stacktrace", ("symbolized",)))
    return profile.agg((F.coalesce(F.max(size), F.lit(0)) + 1).cast("long").alias("height"))


def trim(tree: DataFrame, profile: DataFrame, percent: float, legacy: bool = False) -> DataFrame:
    """Drop small nodes together with everything below them.

    A child is kept if it exceeds the parent's cumulative value times the
    threshold (float32 arithmetic, truncated) and its parent is kept; the legacy
    rule keeps a child that reaches the product. Whether all ancestors pass is
    found by doubling hops over the tree, so the samples are not read again.

    The result has the root re-totalled over what is kept (unless legacy). Its
    ``trimmed`` column counts, per node, the value cut directly below it.
    """
    # the tree is read several times below and is small next to the samples
    tree = cut_lineage(tree)
    fraction = F.lit(percent).cast("float") / F.lit(100).cast("float")
    whole = total(profile).select("value").scalar()
    parents = tree.select(F.col("node_id").alias("parent_id"),
                          F.when(F.col("depth") == 0, whole).otherwise(F.col("cumulative")).alias("parent_cum"))
    judged = tree.where("depth > 0").join(parents, "parent_id")
    if legacy:
        fails = F.col("cumulative") < F.col("parent_cum").cast("float") * fraction
    else:
        fails = F.col("cumulative") <= (F.col("parent_cum").cast("float") * fraction).cast("long")
    bad = judged.where(fails).select("node_id", "parent_id", "cumulative")

    passing = judged.where(~fails).select("node_id", "parent_id", "depth", F.lit(0).cast("long").alias("weight"))
    kept = sum_over_ancestors(passing).select("node_id")
    nodes = tree.where("depth > 0").join(kept, "node_id", "left_semi")
    lost = bad.groupBy("parent_id").agg(F.sum("cumulative").alias("trimmed")).withColumnRenamed("parent_id", "node_id")
    top = tree.where("depth = 0")
    if not legacy:
        kept_total = nodes.where("depth = 1").agg(F.coalesce(F.sum("cumulative"), F.lit(0)).cast("long")).scalar()
        top = top.withColumn("cumulative", kept_total)
    return (
        nodes.unionByName(top)
        .join(lost, "node_id", "left")
        .withColumn("trimmed", F.coalesce("trimmed", F.lit(0)).cast("long"))
    )


def trimmed_total(trimmed_tree: DataFrame) -> DataFrame:
    """Value cut off by :func:`trim`, counted once at the head of each cut subtree."""
    return trimmed_tree.agg(F.coalesce(F.sum("trimmed"), F.lit(0)).cast("long").alias("trimmed"))


def layout(tree: DataFrame) -> DataFrame:
    """Add ``value_offset``: where a node starts on the value axis.

    Siblings are placed by name (then labels, binary, file, address) from the
    parent's own start. The offset of a node is the sum, over itself and its
    ancestors, of the values of earlier siblings.
    """
    tree = cut_lineage(tree)
    order = [F.coalesce(F.col(k), F.lit("")) for k in ("name", "labels", "key_mapping_file", "key_filename")]
    keyed = tree.where("depth > 0").withColumn(
        "sibling_order", F.struct(*order, F.coalesce("key_address", F.lit(0).cast("long")), F.col("node_id")))
    placed = running_sum(keyed, "parent_id", "sibling_order", "cumulative", "weight")
    offsets = sum_over_ancestors(placed.select("node_id", "parent_id", "depth", "weight"))
    return tree.join(offsets.withColumnRenamed("total", "value_offset"), "node_id", "left").withColumn(
        "value_offset", F.coalesce("value_offset", F.lit(0)).cast("long"))
