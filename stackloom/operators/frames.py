"""Stacks as arrays of frames; a frame is one line of one location."""

from pyspark.sql import Column, functions as F

from stackloom.functions.scalar import col


def has_lines(location: Column) -> Column:
    return F.coalesce(F.size(location["lines"]), F.lit(0)) > 0


# field: (of a line x at position k, of a location loc without lines)
FIELDS = {
    "symbolized": ("true", "false"),
    "name": ("x.function_name", "cast(null AS string)"),
    "system_name": ("x.function_system_name", "cast(null AS string)"),
    "filename": ("x.function_filename", "cast(null AS string)"),
    "line": ("x.line", "cast(null AS bigint)"),
    "start_line": ("x.function_start_line", "cast(null AS bigint)"),
    "address": ("loc.address", "loc.address"),
    "mapping_file": ("loc.mapping_file", "loc.mapping_file"),
    "mapping_build_id": ("loc.mapping_build_id", "loc.mapping_build_id"),
    "has_mapping": ("loc.mapping_start IS NOT NULL", "loc.mapping_start IS NOT NULL"),
    "inlined": ("k < size(loc.lines) - 1", "false"),
    "location": ("li", "li"),
    "position": ("k", "0"),
}


def frames(stack: str = "stacktrace", fields=tuple(FIELDS)) -> Column:
    """Frames of a stack, leaf first; an unsymbolised location is one frame without a name.

    Array functions are evaluated row by row, so name only the ``fields`` in use.
    """
    of_line, of_address = (", ".join(f"'{f}', {FIELDS[f][i]}" for f in fields) for i in (0, 1))
    return F.expr(f"""flatten(transform({stack}, (loc, li) -> CASE WHEN coalesce(size(loc.lines), 0) > 0
      THEN transform(loc.lines, (x, k) -> named_struct({of_line})) ELSE array(named_struct({of_address})) END))""")


def lines(stack) -> Column:
    """All lines of a stack; unsymbolised locations contribute none."""
    return F.flatten(F.transform(col(stack), lambda loc: F.coalesce(loc["lines"], F.array())))


def invert(stack) -> Column:
    """Root first instead of leaf first, inlined lines included."""
    return F.transform(
        F.reverse(col(stack)), lambda loc: loc.withField("lines", F.reverse(loc["lines"]))
    )
