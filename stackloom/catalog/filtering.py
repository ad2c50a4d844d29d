"""Stack and frame filters, sandwich cuts, inversion."""

from pyspark.sql import functions as F

from stackloom.functions.scalar import record
from stackloom.catalog.base import LINE_FRAMES
from stackloom.operators import filters as flt
from stackloom.operators.filters import Condition, Criteria
from stackloom.operators.frames import frames, invert
from stackloom.operators.presets import preset
from stackloom.sources.tables import line_samples


TEXT_FIELDS = ("symbolized", "name", "address")


def _text(f):
    return F.when(f["symbolized"], f["name"]).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(f["address"]))))


def _by_stack(df):
    text = F.array_join(F.transform(frames("stacktrace", TEXT_FIELDS), _text), ";")
    return df.groupBy(text.alias("stack")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def _stack(**criteria):
    made = Criteria(**{k: Condition(*v) for k, v in criteria.items()})
    return lambda s, d: _by_stack(flt.stack_filter(line_samples(s, d), made))


def _frame(*criteria):
    made = [Criteria(**{k: Condition(*v) for k, v in c.items()}) for c in criteria]
    return lambda s, d: _by_stack(flt.frame_filter(line_samples(s, d), *made))


def _conditions(s, d):
    """Every text condition on every function name occurrence, against a mixed-case constant."""
    names = line_samples(s, d).select("value", F.inline(F.transform(
        F.filter(frames("stacktrace", TEXT_FIELDS), lambda f: f["name"].isNotNull()), lambda f: record(name=f["name"]))))
    tests = {"equal": "ecoNOMY", "not_equal": "ecoNOMY", "contains": "AND#1", "not_contains": "AND#1",
             "starts_with": "nation_1", "not_starts_with": "nation_1"}
    return names.groupBy("name").agg(F.sum("value").alias("total")).select(
        "name", "total", *[Condition(op, v).test(F.col("name")).alias(op) for op, v in tests.items()])


def _numbers(s, d):
    rows = line_samples(s, d).select("value", F.inline(F.transform("stacktrace", lambda x: record(
        address=x["address"]))))
    return rows.groupBy("address").agg(F.sum("value").alias("total")).select(
        "address", "total", Condition("equal", 500003).test(F.col("address")).alias("equal"),
        Condition("not_equal", 500003).test(F.col("address")).alias("not_equal"))


QUERIES = {
    "cond_strings": _conditions,
    "cond_numbers": _numbers,
    "stack_fn_contains": _stack(function_name=("contains", "ION_1")),
    "stack_fn_not_contains": _stack(function_name=("not_contains", "ION_1")),
    "stack_sysname": _stack(system_name=("starts_with", "_BRAND#1")),
    "stack_filename": _stack(filename=("not_equal", "src/economy.go")),
    "stack_binary": _stack(binary=("not_contains", "LIBC")),
    "stack_address": _stack(address=("not_equal", 500003)),
    "stack_line": _stack(line_number=("not_equal", 3)),
    "stack_unsymbolized": lambda s, d: _by_stack(flt.stack_filter(
        flt.frame_filter(line_samples(s, d), Criteria(address=Condition("equal", 4096 + 16 * 8))),
        Criteria(function_name=Condition("not_contains", "brand")))),
    "stack_empty_passes": lambda s, d: _by_stack(flt.stack_filter(
        line_samples(s, d).where(F.size("stacktrace") == 0), Criteria(function_name=Condition("equal", "no such function")))),
    "frame_fn": _frame({"function_name": ("not_contains", "dispatch")}),
    "frame_binary": _frame({"binary": ("contains", "libc.so")}),
    "frame_address": _frame({"address": ("not_equal", 500003)}),
    "frame_line": _frame({"line_number": ("equal", 101)}),
    "frame_nulls": _frame({"system_name": ("not_equal", "AFRICA")}, {"binary": ("not_contains", "zzz")}),
    "frame_all_filtered": _frame({"function_name": ("equal", "no such function")}, {"address": ("equal", -1)}),
    "filtered_total": lambda s, d: flt.filtered_total(line_samples(s, d), [
        flt.FunctionNameFilter("ION_1", exclude=True), flt.BinaryFilter(("libc", "app"))]),
    "preset_hide_libc": lambda s, d: _by_stack(flt.apply_filters(line_samples(s, d), preset("hide_libc"))),
    "sandwich_callees": lambda s, d: _by_stack(flt.sandwich(line_samples(s, d), "MIDDLE EAST")),
    "sandwich_callers": lambda s, d: _by_stack(flt.sandwich(line_samples(s, d), "STANDARD", inverted=True)),
    "invert_stacks": lambda s, d: _by_stack(line_samples(s, d).withColumn("stacktrace", invert("stacktrace"))),
}

TEXT = "CASE WHEN symbolized THEN fn ELSE '0x' || lower(to_hex(address)) END"


def _stacks(where="true", frames="true", order="idx", base="line_samples"):
    """Samples that satisfy ``where``, with the frames that satisfy ``frames``."""
    return f"""WITH {LINE_FRAMES}, texts AS (
      SELECT sid, string_agg({TEXT}, ';' ORDER BY {order}) AS stack FROM line_frames WHERE {frames} GROUP BY sid)
    SELECT coalesce(t.stack, '') AS stack, count(*) AS n, CAST(sum(value) AS BIGINT) AS total
    FROM {base} s LEFT JOIN texts t USING (sid) WHERE {where} GROUP BY 1"""


def _some(condition):
    return f"(empty_stack OR sid IN (SELECT sid FROM line_frames WHERE {condition}))"


def _every(condition):
    return f"(empty_stack OR sid NOT IN (SELECT sid FROM line_frames WHERE NOT ({condition})))"


BASE = "regexp_replace(mapping_file, '^.*/', '')"

SQL = {
    "cond_strings": f"""WITH {LINE_FRAMES}, x AS (
        SELECT fn AS name, CAST(sum(value) AS BIGINT) AS total FROM line_frames WHERE fn IS NOT NULL GROUP BY 1)
      SELECT name, total, lower(name) = 'economy' AS equal, lower(name) <> 'economy' AS not_equal,
        lower(name) LIKE '%and#1%' AS contains, lower(name) NOT LIKE '%and#1%' AS not_contains,
        starts_with(lower(name), 'nation_1') AS starts_with, NOT starts_with(lower(name), 'nation_1') AS not_starts_with
      FROM x""",
    "cond_numbers": f"""WITH {LINE_FRAMES} SELECT address, CAST(sum(value) AS BIGINT) AS total,
        address = 500003 AS equal, address <> 500003 AS not_equal
      FROM line_frames WHERE pos = 0 GROUP BY address""",
    "stack_fn_contains": _stacks(_some("lower(fn) LIKE '%ion\\_1%' ESCAPE '\\'")),
    "stack_fn_not_contains": _stacks(_every("fn IS NULL OR lower(fn) NOT LIKE '%ion\\_1%' ESCAPE '\\'")),
    "stack_sysname": _stacks(_some("starts_with(lower(sysname), '_brand#1')")),
    "stack_filename": _stacks(_every("filename IS NULL OR lower(filename) <> 'src/economy.go'")),
    "stack_binary": _stacks(_some(f"mapping_start IS NOT NULL AND lower({BASE}) NOT LIKE '%libc%'")),
    "stack_address": _stacks(_some("address <> 500003")),
    "stack_line": _stacks(_every("line IS NULL OR line <> 3")),
    "stack_unsymbolized": _stacks("""sid NOT IN (SELECT sid FROM line_frames
        WHERE address = 4224 AND symbolized AND lower(fn) LIKE '%brand%')""", "address = 4224"),
    "stack_empty_passes": _stacks("empty_stack"),
    "frame_fn": _stacks(frames="NOT symbolized OR lower(fn) NOT LIKE '%dispatch%'"),
    "frame_binary": _stacks(frames=f"mapping_start IS NULL OR lower({BASE}) LIKE '%libc.so%'"),
    "frame_address": _stacks(frames="address <> 500003"),
    "frame_line": _stacks(frames="NOT symbolized OR line = 101"),
    "frame_nulls": _stacks(frames="NOT symbolized OR coalesce(lower(sysname) <> 'africa', false)"),
    "frame_all_filtered": _stacks(frames="false"),
    "filtered_total": f"""WITH {LINE_FRAMES} SELECT CAST(sum(value) AS BIGINT) AS total,
        CAST(sum(CASE WHEN {_every("fn IS NULL OR lower(fn) NOT LIKE '%ion~_1%' ESCAPE '~'")} THEN 0 ELSE value END) AS BIGINT)
        AS filtered FROM line_samples""",
    "preset_hide_libc": _stacks(frames=f"mapping_start IS NULL OR lower({BASE}) NOT LIKE '%libc.so%'"),
    "sandwich_callees": _stacks("r_regionkey = 4 AND NOT empty_stack", frames="loc <= 3"),
    # the inlined function is the first named line of its location, so the cut keeps the whole location
    "sandwich_callers": _stacks("p_type = 'STANDARD' AND NOT empty_stack", frames="loc >= 1", order="loc DESC, pos DESC"),
    "invert_stacks": _stacks(order="loc DESC, pos DESC"),
}
