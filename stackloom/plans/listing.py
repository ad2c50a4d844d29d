"""Top list, function table, neighbours and source lines: per-frame rollups.

A function that recurs in one stack adds that stack's value once per occurrence.
"""

from pyspark.sql import Column, DataFrame, functions as F

from stackloom.functions.scalar import filename_matches, record, unsigned_key
from stackloom.operators.aggregate import merge_items
from stackloom.operators.frames import frames, has_lines


def _common(c: str) -> Column:
    return F.when(F.min(c).eqNullSafe(F.max(c)) & (F.sum(F.when(F.col(c).isNull(), F.col("_rows"))).isNull()), F.min(c))


def top(profile: DataFrame, limit: int | None = None) -> DataFrame:
    """Per function (innermost line only) or unsymbolised address: cumulative, flat, diff.

    Ordered by flat value, largest first, then address. A function found in
    several binaries has no binary. ``limit`` makes it a take-ordered.
    """
    location = F.transform("stacktrace", lambda loc, i: record(
        name=F.when(has_lines(loc), F.coalesce(loc["lines"][0]["function_name"], F.lit(""))),
        mapping_file=loc["mapping_file"], mapping_build_id=loc["mapping_build_id"], address=loc["address"],
        leaf=i == 0))
    rows = merge_items(profile, location).select("value", "diff", F.inline("items"))
    # an unsymbolised row is identified by binary and address, a function by name alone
    by_location = rows.groupBy("name", "mapping_file", "mapping_build_id", "address").agg(
        F.sum("value").alias("cumulative"), F.sum(F.when(F.col("leaf"), F.col("value")).otherwise(0)).alias("flat"),
        F.sum("diff").alias("diff"), F.count("*").alias("_rows"))
    unnamed = F.col("name").isNull()
    only_unnamed = lambda c: F.when(unnamed, F.col(c)).alias(f"_{c}")
    out = by_location.groupBy("name", only_unnamed("mapping_build_id"), only_unnamed("mapping_file"),
                              only_unnamed("address")).agg(
        F.sum("cumulative").alias("cumulative"), F.sum("flat").alias("flat"), F.sum("diff").alias("diff"),
        _common("mapping_file").alias("mapping_file"), _common("mapping_build_id").alias("mapping_build_id"),
        F.min(record(k=unsigned_key("address"), address=F.col("address"))).alias("lowest"))
    out = out.select("name", F.col("lowest.address").alias("address"), "mapping_file", "mapping_build_id",
                     "cumulative", "flat", "diff")
    ordered = out.orderBy(F.desc("flat"), unsigned_key("address"), "name")
    return ordered if limit is None else ordered.limit(limit)


def _table_parts(f: Column) -> dict[str, Column]:
    return {"name": f["name"],
            "build_id": F.when(~f["symbolized"], F.coalesce(f["mapping_build_id"], F.lit(""))),
            "address": F.when(~f["symbolized"], f["address"])}


def _table_key(f: Column) -> Column:
    """Identity of a table row: function name, or binary and address."""
    return record(**_table_parts(f))


def _listed(*more: str) -> Column:
    fields = ("symbolized", "name", "mapping_build_id", "address", *more)
    return F.filter(frames("stacktrace", fields), lambda f: ~f["symbolized"] | f["name"].isNotNull())


def table(profile: DataFrame) -> DataFrame:
    """Per frame, inlined ones included: cumulative and flat values and diffs.

    Rows are functions by name, or unsymbolised addresses by (build id,
    address). Descriptive columns hold the least value among merged frames.
    """
    metas = ["mapping_file", "system_name", "filename", "line", "start_line"]
    item = F.transform(_listed("location", "position", *metas), lambda f: record(
        **_table_parts(f), leaf=(f["location"] == 0) & (f["position"] == 0), **{m: f[m] for m in metas}))
    rows = merge_items(profile, item).select("value", "diff", F.inline("items"))
    leaf = lambda c: F.sum(F.when(F.col("leaf"), F.col(c)).otherwise(0))
    first = rows.groupBy("name", "build_id", "address", *metas).agg(
        F.sum("value").alias("cumulative"), F.sum("diff").alias("cumulative_diff"),
        leaf("value").alias("flat"), leaf("diff").alias("flat_diff"))
    return first.groupBy("name", "build_id", "address").agg(
        *[F.sum(c).alias(c) for c in ("cumulative", "cumulative_diff", "flat", "flat_diff")],
        *[F.min(m).alias(m) for m in metas])


def _adjacent(keys: Column) -> Column:
    """(leaf side, root side) of each pair of neighbours in a leaf-first array."""
    n = F.size(keys)
    return F.transform(F.arrays_zip(F.slice(keys, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("callee"),
                                    F.slice(keys, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("caller")),
                       lambda z: record(callee=z["callee"], caller=z["caller"]))


def table_neighbours(profile: DataFrame) -> DataFrame:
    """Distinct (callee, caller) pairs of adjacent table rows.

    Pairs stay rows: a hot function may have any number of neighbours.
    """
    keys = profile.select(F.transform(_listed(), _table_key).alias("keys")).distinct()
    pairs = keys.select(F.inline(F.array_distinct(_adjacent(F.col("keys")))))
    return pairs.groupBy("callee", "caller").agg(F.count("*").alias("stacks")).select("callee", "caller")


def neighbour_counts(pairs: DataFrame, side: str) -> DataFrame:
    """Number of distinct callers of each callee, or of callees of each caller."""
    other = "callee" if side == "caller" else "caller"
    return pairs.groupBy(F.col(other).alias("function")).agg(F.count("*").alias(f"{side}s"))


def source_report(profile: DataFrame, filename: str, build_id: str = "") -> DataFrame:
    """Cumulative and flat value per line of the files matching ``filename``.

    Needs a mapping, and the build id if one is given.
    """
    used = ("filename", "line", "name", "mapping_build_id", "has_mapping", "location", "position")
    item = F.transform(frames("stacktrace", used), lambda f: record(
        filename=f["filename"], line_number=f["line"], name=f["name"], build_id=f["mapping_build_id"],
        has_mapping=f["has_mapping"], leaf=(f["location"] == 0) & (f["position"] == 0)))
    wanted = F.filter(item, lambda f: f["has_mapping"] & f["name"].isNotNull()
                      & F.coalesce(filename_matches(f["filename"], filename), F.lit(False))
                      & (F.lit(build_id == "") | F.coalesce(f["build_id"] == build_id, F.lit(False))))
    rows = merge_items(profile, wanted).select("value", F.inline("items"))
    return rows.groupBy("filename", "line_number").agg(
        F.sum("value").alias("cumulative"),
        F.sum(F.when(F.col("leaf"), F.col("value")).otherwise(0)).alias("flat"),
    ).orderBy("filename", "line_number")
