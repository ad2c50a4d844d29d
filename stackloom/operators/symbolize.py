"""Resolving addresses to functions by joins with symbol, line and program-header tables.

``symbols``: build_id, value, size, name, bind, type, defined.
``lines``: build_id, source, address, lines. ``headers``: build_id, elf_type,
text_header (index or -1), and an array of (off, vaddr, memsz) per binary.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stackloom.functions.scalar import PAGE, record, unsigned_key
from stackloom.operators.frames import has_lines
from stackloom.operators.lookup import lookup
from stackloom.session import cut_lineage

BUCKET_BITS = 16  # addresses are looked up within 64 KiB windows
SOURCES = ["dwarf", "pclntab", "symtab"]


def best_symbols(symbols: DataFrame) -> DataFrame:
    """One function symbol per (build id, value).

    Preference, strongest first: a size, not weak, global, fewer leading
    underscores, longer name, no system-call alias, last by name.
    """
    name = F.col("name")
    underscores = F.length(F.regexp_extract(name, "^(_*)", 1))
    rank = record(
        sized=F.col("size") != 0, strong=F.col("bind") != "WEAK", is_global=F.col("bind") == "GLOBAL",
        plain=-underscores, long=F.octet_length(name),
        genuine=~(F.startswith(name, F.lit("SyS")) | F.startswith(name, F.lit("compat_SyS"))), name=name,
        size=F.col("size"))
    functions = symbols.where("type = 'FUNC' AND name <> '' AND defined")
    return functions.groupBy("build_id", "value").agg(F.max(rank).alias("best")).select(
        "build_id", "value", F.col("best.size").alias("size"), F.col("best.name").alias("name"))


def asof_symbols(addresses: DataFrame, symbols: DataFrame) -> DataFrame:
    """Nearest symbol at or below each address, if the address lies inside it.

    Both sides are sorted together within 64 KiB windows of each binary, so a
    group has a fixed upper size even for one huge binary. Where no symbol
    starts earlier in the window, the last symbol of the nearest earlier window
    is carried over; that step sees one row per non-empty window.
    """
    sym = F.struct("value", "size", "name")
    left = best_symbols(symbols).select("build_id", F.col("value").alias("address"), F.lit(0).alias("kind"),
                                        sym.alias("sym"))
    right = addresses.select("build_id", "address").distinct().select(
        "build_id", "address", F.lit(1).alias("kind"), F.lit(None).cast(left.schema["sym"].dataType).alias("sym"))
    rows = left.unionByName(right).withColumn("key", unsigned_key("address"))
    rows = rows.withColumn("window", F.shiftright("key", BUCKET_BITS))
    within = W.partitionBy("build_id", "window").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumn("found", F.last("sym", ignorenulls=True).over(within)).where("kind = 1")

    last = F.max(F.when(F.col("kind") == 0, F.struct("key", "sym")))
    per_window = rows.groupBy("build_id", "window").agg(last.alias("last"))
    earlier = W.partitionBy("build_id").orderBy("window").rowsBetween(W.unboundedPreceding, -1)
    carried = per_window.select("build_id", "window",
                                F.last("last", ignorenulls=True).over(earlier).alias("before"))
    hit = found.join(carried, ["build_id", "window"], "left").withColumn(
        "s", F.coalesce("found", F.col("before.sym")))
    covers = unsigned_key(F.col("address") - F.col("s.value")) < unsigned_key("s.size")
    return hit.select("build_id", "address",
                      F.when(covers, F.col("s.name")).alias("symbol"),
                      F.when(covers, F.col("s.value")).alias("symbol_start"))


def needs_symbols(samples: DataFrame) -> DataFrame:
    """Distinct locations to resolve: an address, a build id, no lines."""
    wanted = F.filter("stacktrace", _unresolved)
    slim = F.array_distinct(F.transform(wanted, _location_key))
    return samples.select(F.inline(slim)).distinct()


def _unresolved(loc: Column) -> Column:
    return (loc["address"] != 0) & F.coalesce(loc["mapping_build_id"] != "", F.lit(False)) & ~has_lines(loc)


def _location_key(loc: Column) -> Column:
    return record(
        build_id=loc["mapping_build_id"], mapping_file=loc["mapping_file"], mapping_start=loc["mapping_start"],
        mapping_limit=loc["mapping_limit"], mapping_offset=loc["mapping_offset"], address=loc["address"])


def symbolize(profile: DataFrame, resolved: DataFrame) -> DataFrame:
    """Fill in the lines of unresolved locations.

    ``resolved``: build_id, address, lines. Only stacks with open locations take
    part in the join; their answers come back as one small map per distinct
    stack. Locations without an answer keep their address.
    """
    key = lambda b, a: F.concat(b, F.lit("/"), F.lower(F.hex(a)))
    stack_key = record(a=F.xxhash64("stacktrace"), b=F.xxhash64(F.lit(7), "stacktrace"))
    # read twice: for the open locations and for the result
    profile = cut_lineage(profile)
    keyed = profile.withColumn("_stack", F.when(F.exists("stacktrace", _unresolved), stack_key))
    open_ = keyed.where(F.col("_stack").isNotNull()).select(
        "_stack", F.explode(F.array_distinct(F.transform(
            F.filter("stacktrace", _unresolved),
            lambda loc: record(build_id=loc["mapping_build_id"], address=loc["address"])))).alias("l"),
    ).select("_stack", "l.build_id", "l.address").distinct()
    answers = lookup(open_, resolved.select("build_id", "address", "lines"), ["build_id", "address"], ["_stack"], "inner")
    per_stack = answers.groupBy("_stack").agg(F.map_from_entries(F.collect_list(
        F.struct(key(F.col("build_id"), F.col("address")), "lines"))).alias("_lines"))
    # stacks without open locations pass by; a stack that many labels or times share is split by its weight
    spread_by = [c for c in ("time_nanos", "period", "value") if c in keyed.columns]
    joined = lookup(keyed.where(F.col("_stack").isNotNull()), per_stack, ["_stack"], spread_by)
    fill = lambda loc: F.when(
        _unresolved(loc) & F.col("_lines").isNotNull(),
        loc.withField("lines", F.coalesce(
            F.try_element_at(F.col("_lines"), key(loc["mapping_build_id"], loc["address"])), loc["lines"])),
    ).otherwise(loc)
    filled = joined.withColumn("stacktrace", F.transform("stacktrace", fill)).select(*profile.columns)
    return filled.unionByName(keyed.where(F.col("_stack").isNull()).select(*profile.columns))


def symbol_lines(asof: DataFrame) -> DataFrame:
    """Symbol hits in the form :func:`symbolize` takes: one line per address."""
    number, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    line = record(
        line=number, column=number, function_name=F.col("symbol"), function_system_name=F.col("symbol"),
        function_filename=none, function_start_line=number)
    return asof.where("symbol is not null").select("build_id", "address", F.array(line).alias("lines"))


def preferred_source(tables: DataFrame) -> DataFrame:
    """Rows of the best symbol source each binary has: line table, then pclntab, then symbol table."""
    rank = F.array_position(F.lit(SOURCES), F.col("source")).cast("int")
    ranked = tables.withColumn("_rank", rank).where("_rank > 0")
    best = ranked.groupBy("build_id").agg(F.min("_rank").alias("_best"))
    return lookup(ranked, best, ["build_id"], ["address"], "inner").where("_rank = _best").drop("_rank", "_best")


def _uge(a, b) -> Column:
    return unsigned_key(a) >= unsigned_key(b)


def _ult(a, b) -> Column:
    return unsigned_key(a) < unsigned_key(b)


def headers_for_mapping(headers, offset, size) -> Column:
    """Program headers that a mapping of a file range can come from."""
    limit = offset + size

    def matches(h):
        seg_limit = h["off"] + h["memsz"]
        in_page = F.pmod(h["vaddr"], F.lit(PAGE))
        aligned = F.when(_ult(in_page, h["off"]), h["off"] - in_page).otherwise(F.lit(0).cast("long"))
        other_segment = _ult(h["off"], offset) & _ult(seg_limit, offset + PAGE) & _uge(limit, seg_limit + PAGE)
        return _ult(offset, seg_limit) & _ult(h["off"], limit) & _uge(offset, aligned) & ~other_segment

    return F.filter(headers, matches)


def program_header(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Attach the program header of each (build_id, mapping_*, address).

    A binary has a handful of headers, so they travel as one array per build id
    and the range test runs inside the row. ``header_error`` tells why none or no
    unique header was found; both null means that the binary has none.
    """
    start, limit, offset = F.col("mapping_start"), F.col("mapping_limit"), F.col("mapping_offset")
    joined = lookup(rows, headers, ["build_id"], ["address"])
    text = F.when(F.col("text_header") >= 0, F.get("headers", F.col("text_header")))
    no_range = _uge(start, limit) | (limit < 0)
    joined = joined.withColumn("_mapped", headers_for_mapping(F.col("headers"), offset, limit - start))
    at = F.col("address") - start + offset
    covering = F.filter("_mapped", lambda h: _uge(at, h["off"]) & _ult(at, h["off"] + h["memsz"]))
    joined = joined.withColumn("_covering", covering)
    n, m = F.size("_mapped"), F.size("_covering")
    has_any = F.coalesce(F.size("headers"), F.lit(0)) > 0
    header = (F.when(no_range, text).when(~has_any, None).when(n == 1, F.get("_mapped", F.lit(0)))
              .when((n > 1) & (m == 1), F.get("_covering", F.lit(0))))
    error = F.when(~no_range & has_any, F.when(n == 0, "no program header matches mapping")
                   .when((n > 1) & (m == 0), "no program header matches file offset")
                   .when((n > 1) & (m > 1), "several program headers match file offset"))
    return joined.withColumn("header", header).withColumn("header_error", error).drop("_mapped", "_covering", "headers")


def symbol_address(rows: DataFrame) -> DataFrame:
    """Add ``symbol_address``: the runtime address moved into the binary's own address space.

    Null (with ``base_error``) if the base cannot be told.
    """
    start, limit, offset, h = (F.col(c) for c in ("mapping_start", "mapping_limit", "mapping_offset", "header"))
    zero = F.lit(0).cast("long")
    everything = (start == 0) & (offset == 0) & ((limit == -1) | (limit == 0))
    by_segment = start - offset + h["off"] - h["vaddr"]
    relocatable = F.when(offset == 0, start)
    base = (F.when(F.col("header_error").isNotNull(), None).when(h.isNull(), zero).when(everything, zero)
            .when(F.col("elf_type").isin("EXEC", "DYN"), by_segment).when(F.col("elf_type") == "REL", relocatable))
    error = F.coalesce(F.col("header_error"), F.when(base.isNull(), "unsupported file type or offset"))
    return rows.withColumn("symbol_address", F.col("address") - base).withColumn("base_error", error)
