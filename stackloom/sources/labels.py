"""Label rules at ingest."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from stackloom.functions.scalar import record
from stackloom.schema import LABELS

VALID_NAME = "^[a-zA-Z_][a-zA-Z0-9_]*$"
EXPORTED = "exported_"
#: Different label lists of a profile up to which they are looked up.
MOST_SETS = 64


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def label_sets(lists: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of each different list among ``lists``, for :func:`label_set`; of none if there are more than ``MOST_SETS``.

    Samples of a profile share a few lists of labels, and rules for labels cost more than the rest of a sample.
    """
    few = lambda hashes: let(F.array_distinct(hashes), lambda x: F.when(F.size(x) <= MOST_SETS, x).otherwise(F.array().cast("array<bigint>")))
    made = lambda x: record(list=x, made=make(x))
    return let(lists, lambda all_: let(F.transform(all_, lambda x: F.xxhash64(x)), lambda hashes: let(few(hashes), lambda keys: record(
        keys=keys, sets=F.transform(keys, lambda h: let(F.get(all_, (F.array_position(hashes, h) - 1).cast("int")), made))))))


def label_set(sets: Column, list_: Column, make: Callable[[Column], Column]) -> Column:
    """``make(list_)``, taken from :func:`label_sets` if it holds that very list."""
    found = F.get(sets["sets"], (F.array_position(sets["keys"], F.xxhash64(list_)) - 1).cast("int"))
    return let(found, lambda x: F.when(F.coalesce(x["list"] == list_, F.lit(False)), x["made"]).otherwise(make(list_)))


def sanitized(name: Column) -> Column:
    """Characters that label names cannot hold become underscores."""
    return F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")


def label_errors(series: DataFrame, key: str = "series_id") -> DataFrame:
    """Violations in series labels: invalid or repeated names, missing ``__name__``.

    ``series`` has ``labels array<struct<name,value>>``. ``__name__`` itself may
    not be absent or empty.
    """
    names = F.transform(F.filter("labels", lambda x: x["name"] != "__name__"), lambda x: x["name"])
    repeated = F.filter(F.array_distinct(names), lambda n: F.size(F.filter(names, lambda m: m == n)) > 1)
    invalid = F.filter(names, lambda n: ~F.rlike(n, F.lit(VALID_NAME)))
    named = F.exists("labels", lambda x: (x["name"] == "__name__") & (x["value"] != ""))
    issue = lambda kind: lambda n: record(error=F.lit(kind), label=n)
    missing = F.when(~named, F.array(record(error=F.lit("missing name"), label=F.lit("__name__"))))
    errors = F.concat(F.transform(invalid, issue("invalid label name")),
                      F.transform(repeated, issue("duplicate label name")), F.coalesce(missing, F.array()))
    return series.select(key, F.inline(errors))


def exported_labels(series_labels: Column, sample_labels: Column) -> Column:
    """Sample labels as a map, renamed where a series label has the name.

    ``sample_labels`` is an array of (name, value) in file order: names are
    sanitised, the first value of a name wins, a name that a series label has
    gets the prefix ``exported_``, and twice if that is taken as well.
    """
    entry = lambda k, v: record(key=k, value=v)
    text = F.transform(F.filter(sample_labels, lambda x: F.coalesce(x["value"] != "", F.lit(False))),
                       lambda x: entry(sanitized(x["name"]), x["value"]))
    first = F.aggregate(text, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, x: F.when(
        F.exists(acc, lambda y: y["key"] == x["key"]), acc).otherwise(F.array_append(acc, x)))
    ordered = F.sort_array(first)

    def rename(acc, x):
        once = F.when(F.map_contains_key(series_labels, x["key"]), F.concat(F.lit(EXPORTED), x["key"])).otherwise(x["key"])
        taken = F.exists(acc, lambda y: y["key"] == once)
        name = F.when(taken, F.concat(F.lit(EXPORTED), once)).otherwise(once)
        # a third clash overwrites
        return F.array_append(F.filter(acc, lambda y: y["key"] != name), entry(name, x["value"]))

    renamed = F.aggregate(ordered, F.array().cast("array<struct<key:string,value:string>>"), rename)
    return F.map_from_entries(renamed)


def numeric_labels(sample_labels: Column) -> Column:
    """Numeric labels as a map: sanitised names, first non-zero value wins."""
    numbers = F.transform(F.filter(sample_labels, lambda x: F.coalesce(x["num"] != 0, F.lit(False))),
                          lambda x: record(key=sanitized(x["name"]), value=x["num"]))
    empty = F.array().cast("array<struct<key:string,value:bigint>>")
    return F.map_from_entries(F.aggregate(numbers, empty, lambda acc, x: F.when(
        F.exists(acc, lambda y: y["key"] == x["key"]), acc).otherwise(F.array_append(acc, x))))


def merge_sample_labels(series_labels: Column, sample_labels: Column) -> Column:
    """Series labels together with the renamed sample labels."""
    own = exported_labels(series_labels, sample_labels)
    return F.map_concat(series_labels, F.map_filter(own, lambda k, _: ~F.map_contains_key(series_labels, k)))


def last_wins(*maps: Column) -> Column:
    """Union of label maps; of equal names the later map's value counts."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_zip_with(out, m, lambda _, a, b: F.coalesce(b, a))
    return out


def with_labels(samples: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Attach external labels; they override existing ones of the same name."""
    extra = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]) if labels else F.create_map().cast(LABELS)
    return samples.withColumn("labels", last_wins(F.col("labels"), extra))


def keep_sample_types(samples: DataFrame, keep: list[tuple[str, str]]) -> DataFrame:
    """Only the listed (type, unit) pairs; no list, no restriction."""
    if not keep:
        return samples
    wanted = [record(sample_type=F.lit(t), sample_unit=F.lit(u)) for t, u in keep]
    return samples.where(F.struct("sample_type", "sample_unit").isin(*wanted))


def bad_profile_type() -> Column:
    """Why a sample's profile type could not be selected again (its text is no metric identifier), or null."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("name", "sample_type", "sample_unit", "period_type", "period_unit")]
    text = F.concat(F.concat_ws(":", *parts), F.when(F.col("duration") != 0, ":delta").otherwise(""))
    return F.when(~F.rlike(text, F.lit("^[a-zA-Z_:][a-zA-Z0-9_:]*$")), F.concat(F.lit("invalid profile type "), text))


def check_profile_types(samples: DataFrame) -> DataFrame:
    """Rows whose profile type could not be selected again, with that type's text."""
    reason = bad_profile_type()
    return samples.withColumn("profile_type", F.substring(reason, len("invalid profile type ") + 1, 1 << 30)).where(
        "profile_type IS NOT NULL")
