"""Selection: profile type, label matchers, time ranges. Plain predicates, ANDed by Catalyst."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stackloom.functions.scalar import int_div


@dataclass(frozen=True)
class ProfileType:
    """What was measured: producer, sample and period type, and whether values are deltas."""

    name: str
    sample_type: str
    sample_unit: str
    period_type: str
    period_unit: str
    delta: bool = False

    def predicate(self) -> Column:
        same = [F.col(k) == getattr(self, k)
                for k in ("name", "sample_type", "sample_unit", "period_type", "period_unit")]
        spans = F.col("duration") != 0 if self.delta else F.col("duration") == 0
        return reduce(lambda a, b: a & b, same + [spans])


def label(key: str, labels: str = "labels") -> Column:
    """Value of a label; null if absent. An empty value counts as absent to every matcher."""
    return F.try_element_at(F.col(labels), F.lit(key))


def label_eq(key: str, value: str, of: Column | None = None) -> Column:
    v = label(key) if of is None else of
    return (v.isNull() | (v == "")) if value == "" else F.coalesce(v == value, F.lit(False))


def label_ne(key: str, value: str, of: Column | None = None) -> Column:
    v = label(key) if of is None else of
    return (v.isNotNull() & (v != "")) if value == "" else ~v.eqNullSafe(F.lit(value))


def _pattern(regex: str, anchored: bool) -> str:
    return f"^(?:{regex})$" if anchored else regex


def label_re(key: str, regex: str, anchored: bool = False, of: Column | None = None) -> Column:
    v = label(key) if of is None else of
    return F.coalesce(F.rlike(v, F.lit(_pattern(regex, anchored))), F.lit(False))


def label_nre(key: str, regex: str, anchored: bool = False, of: Column | None = None) -> Column:
    """Does not match; an absent label satisfies neither this nor :func:`label_re`."""
    v = label(key) if of is None else of
    return F.coalesce(~F.rlike(v, F.lit(_pattern(regex, anchored))), F.lit(False))


MATCHERS = {"=": label_eq, "!=": label_ne, "=~": label_re, "!~": label_nre}


def matches(samples: DataFrame, matchers: list[tuple[str, str, str]]) -> Column:
    """All matchers as one condition.

    A label that the table stores as a column of its own (``label_<name>``, see
    :func:`stackloom.sources.samples.write_samples`) is matched there, so that the condition reaches the files: their row
    groups have statistics and Bloom filters of such columns, and none of map entries.
    """
    out = F.lit(True)
    for key, op, value in matchers:
        promoted = f"label_{key}"
        if promoted in samples.columns:
            of = F.col(f"`{promoted}`")
            # plain equality, which readers of files understand: an absent label is null and fails it as well
            out &= of == value if op == "=" and value else MATCHERS[op](key, value, of=of)
        else:
            out &= MATCHERS[op](key, value)
    return out


def matching(samples: DataFrame, matchers: list[tuple[str, str, str]]) -> DataFrame:
    """Keep samples that satisfy every ``(label, operator, value)``."""
    return samples.where(matches(samples, matchers)) if matchers else samples


def range_predicate(start: int | None = None, end: int | None = None) -> Column:
    """Inclusive range on ``time_nanos``; each bound that is given applies."""
    t, out = F.col("time_nanos"), F.lit(True)
    if start is not None:
        out &= t >= start
    return out & (t <= end) if end is not None else out


def select_type(samples: DataFrame, profile_type: ProfileType) -> DataFrame:
    return samples.where(profile_type.predicate())


def in_range(samples: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Inclusive range on ``time_nanos``; each bound that is given applies."""
    if start is not None:
        samples = samples.where(F.col("time_nanos") >= start)
    if end is not None:
        samples = samples.where(F.col("time_nanos") <= end)
    return samples


def in_open_range(samples: DataFrame, start: int, end: int) -> DataFrame:
    """Exclusive range on ``time_nanos``; no restriction if either bound is the epoch."""
    if start == 0 or end == 0:
        return samples
    return samples.where((F.col("time_nanos") > start) & (F.col("time_nanos") < end))


def at_instant(samples: DataFrame, time_nanos: int) -> DataFrame:
    """Samples of one instant, at millisecond resolution."""
    return samples.where(F.col("timestamp") == int_div(F.lit(time_nanos), 1_000_000))
