"""Column types shared by every job.

A stack is stored leaf first. A location is one address in one binary; its
lines are the (possibly inlined) functions at that address, innermost first.
Addresses are unsigned 64-bit values kept in a signed long: equality is exact,
ordering goes through :func:`stackloom.functions.scalar.unsigned_key`.
"""

from pyspark.sql import types as T

LINE = T.StructType(
    [
        T.StructField("line", T.LongType()),
        T.StructField("column", T.LongType()),
        T.StructField("function_name", T.StringType()),
        T.StructField("function_system_name", T.StringType()),
        T.StructField("function_filename", T.StringType()),
        T.StructField("function_start_line", T.LongType()),
    ]
)

LOCATION = T.StructType(
    [
        T.StructField("address", T.LongType()),
        T.StructField("mapping_start", T.LongType()),
        T.StructField("mapping_limit", T.LongType()),
        T.StructField("mapping_offset", T.LongType()),
        T.StructField("mapping_file", T.StringType()),
        T.StructField("mapping_build_id", T.StringType()),
        T.StructField("lines", T.ArrayType(LINE)),
    ]
)

STACK = T.ArrayType(LOCATION)
LABELS = T.MapType(T.StringType(), T.StringType())

SAMPLES = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("sample_type", T.StringType()),
        T.StructField("sample_unit", T.StringType()),
        T.StructField("period_type", T.StringType()),
        T.StructField("period_unit", T.StringType()),
        T.StructField("period", T.LongType()),
        T.StructField("duration", T.LongType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("time_nanos", T.LongType()),
        T.StructField("value", T.LongType()),
        T.StructField("labels", LABELS),
        T.StructField("stacktrace", STACK),
    ]
)

TYPE_COLUMNS = ["name", "sample_type", "sample_unit", "period_type", "period_unit"]
SORT_COLUMNS = TYPE_COLUMNS + ["timestamp", "time_nanos"]
