"""Content ids of functions, mappings, locations and stacks, and address normalisation."""

from pyspark.sql import Column, functions as F

from stackloom.functions.scalar import PAGE, col


def rounded_size(start, limit) -> Column:
    """Mapping size rounded up to whole pages, so small differences between loads do not matter."""
    size = col(limit) - col(start) + F.lit(PAGE - 1)
    return size - F.pmod(size, F.lit(PAGE))


def _digest(*parts) -> Column:
    # each part is led by its length, so adjacent parts cannot run into each other
    text = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat(*[x for t in text for x in (F.length(t).cast("string"), F.lit(":"), t)]), 256)


def function_id(name, system_name, filename, start_line) -> Column:
    return _digest(col(start_line), col(name), col(system_name), col(filename))


def mapping_name(build_id, file) -> Column:
    """Build id, else file, else empty: a mapping with neither is a fake one."""
    return F.coalesce(F.nullif(col(build_id), F.lit("")), F.nullif(col(file), F.lit("")), F.lit(""))


def mapping_id(build_id, file, start, limit, offset) -> Column:
    return _digest(mapping_name(build_id, file), rounded_size(start, limit), col(offset))


def location_id(loc: Column) -> Column:
    """Mapping and address; without an address the lines identify the location."""
    line = lambda x: F.concat_ws("\x1f", function_id(
        x["function_name"], x["function_system_name"], x["function_filename"], x["function_start_line"]),
        x["line"].cast("string"))
    lines = F.when(loc["address"] == 0, F.array_join(
        F.transform(F.coalesce(loc["lines"], F.array()), line), "\x1e")).otherwise("")
    mapping = F.when(loc["mapping_start"].isNotNull(), mapping_id(
        loc["mapping_build_id"], loc["mapping_file"], loc["mapping_start"], loc["mapping_limit"], loc["mapping_offset"]))
    return _digest(mapping, loc["address"], lines)


def stack_id(stack) -> Column:
    """Hash over the ids of all locations in order."""
    s = col(stack)
    return F.when(F.size(s) == 0, F.lit("empty-stacktrace")).otherwise(
        F.sha2(F.array_join(F.transform(s, location_id), ""), 256))


def normalized_address(address, mapping_start) -> Column:
    """Address within its mapping, independent of where the binary was loaded."""
    return F.when(col(mapping_start).isNotNull() & (col(address) != 0), col(address) - col(mapping_start)).otherwise(col(address))
