"""Scalar expressions. All are native column expressions, so they stay inside codegen."""

from pyspark.sql import Column, DataFrame, functions as F

NANOS = 1_000_000_000
PAGE = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def record(**fields) -> Column:
    """A struct with the given field names."""
    return F.named_struct(*[x for name, c in fields.items() for x in (F.lit(name), c)])


def int_div(a, b) -> Column:
    """64-bit integer division, truncating toward zero (``/`` would go through double)."""
    b = F.lit(b) if isinstance(b, int) else col(b)
    return F.call_function("div", col(a).cast("long"), b.cast("long"))


def step_bucket(time_nanos, step: int) -> Column:
    """Start of the step a time falls in."""
    return int_div(time_nanos, step) * F.lit(step).cast("long")


def is_samples_count() -> Column:
    return (F.col("sample_type") == "samples") & (F.col("sample_unit") == "count")


def scaled_value() -> Column:
    """Sample counts become time: value times period for ``samples/count``."""
    return F.when(is_samples_count(), F.col("value") * F.col("period")).otherwise(F.col("value"))


def result_type() -> Column:
    return F.when(is_samples_count(), F.col("period_type")).otherwise(F.col("sample_type"))


def result_unit() -> Column:
    return F.when(is_samples_count(), F.col("period_unit")).otherwise(F.col("sample_unit"))


def effective_duration(min_time, max_time, min_duration, step: int) -> Column:
    """Least duration of a bucket, or the step if the bucket holds several times."""
    return F.when(col(min_time) != col(max_time), F.lit(step)).otherwise(col(min_duration)).cast("long")


def per_second(total, duration, is_time) -> Column:
    """CPU-nanosecond totals divide by nanoseconds, everything else by seconds."""
    d = F.nullif(col(duration), F.lit(0).cast("long")).cast("double")
    t = col(total).cast("double")
    return F.when(is_time, t / d).otherwise(t / (d / F.lit(float(NANOS))))


def basename(path) -> Column:
    return F.substring_index(col(path), "/", -1)


def filename_matches(filename, query) -> Column:
    """Equal, or a suffix that starts at a path boundary."""
    q = F.lit(query) if isinstance(query, str) else query
    f = col(filename)
    return (f == q) | ((q != "") & F.endswith(f, F.concat(F.lit("/"), q)))


def ascii_fold(c) -> Column:
    """Lower-case A to Z only; other letters stay as they are."""
    return F.translate(col(c), UPPER, LOWER)


def unsigned_key(address) -> Column:
    """Signed long that orders like the unsigned value."""
    return col(address).bitwiseXOR(F.lit(-(2**63)).cast("long"))


def hex_address(address) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(col(address))))


def row_name(name, address, mapping_file, several_mappings) -> Column:
    """Display name: the function (tagged by its binary if several occur), else the address."""
    tag = F.when(several_mappings & col(mapping_file).isNotNull(),
                 F.concat(F.lit("["), basename(mapping_file), F.lit("]"))).otherwise(F.lit(""))
    named = (col(name).isNotNull()) & (col(name) != "")
    return F.when(named, F.concat(tag, F.lit(" "), col(name))).otherwise(
        hex_address(F.coalesce(col(address), F.lit(0).cast("long")))
    )


def labels_text(labels) -> Column:
    """Non-empty labels as ``k=v`` pairs in key order; a stable, groupable label-set key.

    A comma, equals sign or backslash within a name or value gets a backslash, so different sets have different texts.
    """
    entries = F.sort_array(F.map_entries(F.map_filter(col(labels), lambda _, v: v != "")))

    def plain(c: Column) -> Column:
        for mark in ("\\", ",", "="):
            c = F.replace(c, F.lit(mark), F.lit("\\" + mark))
        return c

    return F.array_join(F.transform(entries, lambda e: F.concat(plain(e["key"]), F.lit("="), plain(e["value"]))), ",")


def ordered_label_sets(label_sets: DataFrame, labels: str = "labels") -> DataFrame:
    """Distinct label sets with their display text and sort keys.

    Keys whose values are numbers in every set go last and compare as numbers;
    the others compare as text. Whether a key is numeric is a property of the
    whole listing, so it is aggregated per key first (one row per label name).
    """
    sets = label_sets.select(F.sort_array(F.map_entries(F.col(labels))).alias("entries")).distinct()
    # one row per (label set, label); ``total`` travels as a scalar subquery
    total = sets.agg(F.count("*")).scalar()
    by_key = (
        sets.select(F.explode("entries").alias("e"))
        .groupBy(F.col("e.key").alias("key"))
        .agg(F.count("*").alias("present"),
             F.count(F.expr("try_cast(e.value as double)")).alias("numbers"))
    )
    numeric_keys = (
        by_key.where((F.col("present") == total) & (F.col("numbers") == total))
        .agg(F.array_sort(F.collect_list("key"))).scalar()
    )
    is_numeric = lambda e: F.array_contains(F.col("numeric"), e["key"])
    text = lambda es: F.transform(es, lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    split = sets.withColumn("numeric", numeric_keys).select(
        F.filter("entries", lambda e: ~is_numeric(e)).alias("texts"),
        F.filter("entries", is_numeric).alias("numbers"),
    )
    return split.select(
        F.concat(F.lit("{"), F.array_join(F.concat(text(F.col("texts")), text(F.col("numbers"))), ", "),
                 F.lit("}")).alias("label_set"),
        F.array_join(F.transform("texts", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("text_key"),
        F.transform("numbers", lambda e: e["value"].cast("double")).alias("number_key"),
    ).orderBy("text_key", "number_key", "label_set")


def default_sum_by(delta: bool, label_names: list[str]) -> list[str] | None:
    """The label a time series groups by when the user named none."""
    if not delta:
        return []
    for name in ("comm", "namespace", "container"):
        if name in label_names:
            return [name]
    return None
