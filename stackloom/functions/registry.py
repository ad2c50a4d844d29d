"""The scalar functions as SQL functions, defined by native expressions only."""

from pyspark.sql import SparkSession

from stackloom.schema import LOCATION, STACK

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digest(*parts: str) -> str:
    """As :func:`stackloom.functions.keys.function_id` and the others: each part led by its length."""
    texts = [f"coalesce(CAST({p} AS STRING), '')" for p in parts]
    return "sha2(concat(" + ", ".join(f"CAST(length({t}) AS STRING), ':', {t}" for t in texts) + "), 256)"


def _mapping(build_id: str, file: str, lo: str, hi: str, offset: str) -> str:
    name = f"coalesce(nullif({build_id}, ''), nullif({file}, ''), '')"
    return _digest(name, f"({hi} - {lo} + 4095) - pmod({hi} - {lo} + 4095, 4096)", offset)


def _location(loc: str) -> str:
    function = _digest("x.function_start_line", "x.function_name", "x.function_system_name", "x.function_filename")
    lines = f"array_join(transform(coalesce({loc}.lines, array()), x -> concat_ws(chr(31), {function}, CAST(x.line AS STRING))), chr(30))"
    mapping = _mapping(*(f"{loc}.mapping_{c}" for c in ("build_id", "file", "start", "limit", "offset")))
    return _digest(f"if({loc}.mapping_start IS NULL, NULL, {mapping})", f"{loc}.address", f"if({loc}.address = 0, {lines}, '')")


FUNCTIONS = {
    "function_id(name STRING, system_name STRING, filename STRING, start_line BIGINT) RETURNS STRING":
        _digest("start_line", "name", "system_name", "filename"),
    "mapping_id(build_id STRING, file STRING, lo BIGINT, hi BIGINT, file_offset BIGINT) RETURNS STRING":
        _mapping("build_id", "file", "lo", "hi", "file_offset"),
    f"location_id(loc {LOCATION.simpleString()}) RETURNS STRING": _location("loc"),
    f"stack_id(stack {STACK.simpleString()}) RETURNS STRING":
        f"if(size(stack) = 0, 'empty-stacktrace', sha2(array_join(transform(stack, loc -> {_location('loc')}), ''), 256))",
    "step_bucket(t BIGINT, step BIGINT) RETURNS BIGINT": "(t DIV step) * step",
    "value_per_second(total BIGINT, duration BIGINT, is_cpu_time BOOLEAN) RETURNS DOUBLE":
        "CASE WHEN is_cpu_time THEN CAST(total AS DOUBLE) / nullif(duration, 0L) "
        "ELSE CAST(total AS DOUBLE) / (CAST(nullif(duration, 0L) AS DOUBLE) / 1e9D) END",
    "path_basename(path STRING) RETURNS STRING": "substring_index(path, '/', -1)",
    "filename_matches(file STRING, query STRING) RETURNS BOOLEAN":
        "file = query OR (query <> '' AND endswith(file, concat('/', query)))",
    "ascii_fold(s STRING) RETURNS STRING": f"translate(s, '{UPPER}', '{LOWER}')",
    "rounded_mapping_size(lo BIGINT, hi BIGINT) RETURNS BIGINT":
        "(hi - lo + 4095) - pmod(hi - lo + 4095, 4096)",
    "unsigned_key(address BIGINT) RETURNS BIGINT": "address ^ (-9223372036854775807L - 1L)",
}
CONDITIONS = {
    "equal": "ascii_fold(s) = ascii_fold(w)",
    "contains": "contains(ascii_fold(s), ascii_fold(w))",
    "starts_with": "startswith(ascii_fold(s), ascii_fold(w))",
}


def register(spark: SparkSession) -> None:
    """Create the functions as temporary functions of the session."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    for op, test in CONDITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION text_{op}(s STRING, w STRING) RETURNS BOOLEAN RETURN {test}")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION text_not_{op}(s STRING, w STRING) RETURNS BOOLEAN RETURN NOT ({test})")
