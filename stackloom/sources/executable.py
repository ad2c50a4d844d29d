"""Executable information that scrapers leave in profile comments."""

from pyspark.sql import DataFrame, functions as F

PREFIX = "executableInfo="


def parse_executable_info(comments: DataFrame, column: str = "comment") -> DataFrame:
    """``executableInfo=type;offset;vaddr`` (hex) as columns; load segment only if all three parts are there.

    Comments of another kind, or with parts that are no hex numbers, drop out.
    """
    parts = F.split(F.substring(F.col(column), len(PREFIX) + 1, 1 << 30), ";")
    hex_part = lambda i: F.regexp_extract(F.get(parts, F.lit(i)), "^(?:0x)?([0-9a-fA-F]{1,16})$", 1)
    number = lambda i: F.conv(hex_part(i), 16, -10).cast("long")
    three = F.size(parts) == 3
    rows = comments.where(F.startswith(F.col(column), F.lit(PREFIX)))
    valid = (hex_part(0) != "") & (~three | ((hex_part(1) != "") & (hex_part(2) != "")))
    return rows.where(valid).select(
        "*", number(0).alias("elf_type"), F.when(three, number(1)).alias("load_offset"),
        F.when(three, number(2)).alias("load_vaddr"))
