"""Filters over whole stacks and over single frames, as higher-order array expressions."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stackloom.functions.scalar import ascii_fold, basename
from stackloom.operators.frames import has_lines, invert, lines

STRING_OPS = ("equal", "not_equal", "contains", "not_contains", "starts_with", "not_starts_with")
NUMBER_OPS = ("equal", "not_equal")


@dataclass(frozen=True)
class Condition:
    """One comparison with a constant. Text compares without ASCII case."""

    op: str
    value: str | int

    def __post_init__(self):
        allowed = NUMBER_OPS if isinstance(self.value, int) else STRING_OPS
        if self.op not in allowed:
            raise ValueError(f"unknown condition {self.op!r} for {type(self.value).__name__}")
        if isinstance(self.value, int) and not -(2**63) <= self.value < 2**64:
            raise ValueError(f"{self.value} has more than 64 bits")

    @property
    def negative(self) -> bool:
        return self.op.startswith("not_")

    def test(self, c: Column) -> Column:
        """The comparison; null for a null input."""
        if isinstance(self.value, int):
            # unsigned 64-bit numbers are stored as the signed ones of the same bits
            positive = c == F.lit(self.value - 2**64 if self.value >= 2**63 else self.value)
        else:
            folded, wanted = ascii_fold(c), ascii_fold(F.lit(self.value))
            positive = {"equal": lambda: folded == wanted,
                        "contains": lambda: F.contains(folded, wanted),
                        "starts_with": lambda: F.startswith(folded, wanted)}[self.op.removeprefix("not_")]()
        return ~positive if self.negative else positive


@dataclass(frozen=True)
class Criteria:
    """Conditions on a frame; unset ones hold, set ones must all hold."""

    function_name: Condition | None = None
    system_name: Condition | None = None
    filename: Condition | None = None
    binary: Condition | None = None
    address: Condition | None = None
    line_number: Condition | None = None


@dataclass(frozen=True)
class StackFilter:
    criteria: Criteria


@dataclass(frozen=True)
class FrameFilter:
    criteria: Criteria


LINE_FIELDS = {"function_name": "function_name", "system_name": "function_system_name",
               "filename": "function_filename", "line_number": "line"}


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def stack_matches(criteria: Criteria, stack: str = "stacktrace") -> Column:
    """Whether a stack passes.

    Line conditions: any frame for a positive one, every frame for a negative
    one; frames lacking the field have no say. Binary and address: any location,
    even for a negative condition. Stacks without frames always pass.
    """
    parts = []
    for field, column in LINE_FIELDS.items():
        cond = getattr(criteria, field)
        if cond is None:
            continue
        if cond.negative:
            parts.append(F.forall(lines(stack), lambda x: F.coalesce(cond.test(x[column]), F.lit(True))))
        else:
            parts.append(F.exists(lines(stack), lambda x: F.coalesce(cond.test(x[column]), F.lit(False))))
    if criteria.binary is not None:
        parts.append(F.exists(stack, lambda loc: loc["mapping_start"].isNotNull() & criteria.binary.test(
            basename(F.coalesce(loc["mapping_file"], F.lit(""))))))
    if criteria.address is not None:
        parts.append(F.exists(stack, lambda loc: F.coalesce(criteria.address.test(loc["address"]), F.lit(False))))
    return (F.size(stack) == 0) | _all(parts)


def _location_ok(loc: Column, criteria: list[Criteria]) -> Column:
    parts = []
    for c in criteria:
        if c.binary is not None:
            # no mapping, no binary to object to
            parts.append(loc["mapping_start"].isNull() | c.binary.test(
                basename(F.coalesce(loc["mapping_file"], F.lit("")))))
        if c.address is not None:
            parts.append(F.coalesce(c.address.test(loc["address"]), F.lit(False)))
    return _all(parts)


def _line_ok(line: Column, criteria: list[Criteria]) -> Column:
    return _all([
        F.coalesce(getattr(c, field).test(line[column]), F.lit(False))
        for c in criteria for field, column in LINE_FIELDS.items() if getattr(c, field) is not None
    ])


def frame_filtered(criteria: list[Criteria], stack: str = "stacktrace") -> Column:
    """The stack with only the frames that satisfy every criteria object.

    A location stays while one of its lines does; an unsymbolised location is
    judged by binary and address alone. The stack may become empty.
    """
    keep_lines = lambda loc: loc.withField("lines", F.filter(loc["lines"], lambda x: _line_ok(x, criteria)))
    kept = F.filter(stack, lambda loc: _location_ok(loc, criteria) & (
        ~has_lines(loc) | F.exists(loc["lines"], lambda x: _line_ok(x, criteria))))
    return F.transform(kept, lambda loc: F.when(has_lines(loc), keep_lines(loc)).otherwise(loc))


def stack_filter(df: DataFrame, *criteria: Criteria) -> DataFrame:
    """Keep rows whose stack passes all criteria objects."""
    return df.where(_all([stack_matches(c) for c in criteria]))


def frame_filter(df: DataFrame, *criteria: Criteria) -> DataFrame:
    """Reduce every stack to the matching frames. No row is dropped."""
    return df.withColumn("stacktrace", frame_filtered(list(criteria))) if criteria else df


def apply_filters(df: DataFrame, filters) -> DataFrame:
    filters = upgrade_filters(filters)
    stacks = [f.criteria for f in filters if isinstance(f, StackFilter)]
    frames = [f.criteria for f in filters if isinstance(f, FrameFilter)]
    return frame_filter(stack_filter(df, *stacks), *frames)


def filtered_total(df: DataFrame, filters, value: str = "value") -> DataFrame:
    """Total, and the value that stack filters remove from it, in one pass."""
    stacks = [f.criteria for f in upgrade_filters(filters) if isinstance(f, StackFilter)]
    passes = _all([stack_matches(c) for c in stacks])
    return df.agg(
        F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("total"),
        F.coalesce(F.sum(F.when(passes, 0).otherwise(F.col(value))), F.lit(0)).cast("long").alias("filtered"),
    )


@dataclass(frozen=True)
class FunctionNameFilter:
    """Older stack filter: a function to look for, or to exclude."""

    function: str
    exclude: bool = False


@dataclass(frozen=True)
class BinaryFilter:
    """Older frame filter: the binaries to include."""

    include: tuple[str, ...]


def upgrade_filters(filters) -> list:
    """Express the older filter forms as criteria; several binaries become filters that all must hold."""
    out = []
    for f in filters:
        if isinstance(f, FunctionNameFilter):
            op = "not_contains" if f.exclude else "contains"
            out.append(StackFilter(Criteria(function_name=Condition(op, f.function))))
        elif isinstance(f, BinaryFilter):
            out += [FrameFilter(Criteria(binary=Condition("contains", b))) for b in f.include]
        else:
            out.append(f)
    return out


def sandwich(df: DataFrame, function: str, inverted: bool = False) -> DataFrame:
    """Cut stacks at ``function`` (exact name) and drop stacks without it.

    Normal: leaf up to the innermost occurrence, which becomes the root.
    Inverted: outermost occurrence up to the root, reversed, so that the callers
    hang below the function. A location counts by its first named line.
    """
    first_name = lambda loc: F.element_at(
        F.concat(F.filter(F.transform(loc["lines"], lambda x: x["function_name"]), lambda n: n.isNotNull()),
                 F.array(F.lit(None).cast("string"))), 1)
    names = F.transform("stacktrace", lambda loc: F.when(has_lines(loc), first_name(loc)))
    if not inverted:
        at = F.coalesce(F.array_position(names, function), F.lit(0)).cast("int")
        return (df.withColumn("_at", at).where("_at > 0")
                .withColumn("stacktrace", F.slice("stacktrace", F.lit(1), F.col("_at"))).drop("_at"))
    back = F.coalesce(F.array_position(F.reverse(names), function), F.lit(0)).cast("int")
    cut = F.slice("stacktrace", F.size("stacktrace") - F.col("_at") + 1, F.col("_at"))
    return df.withColumn("_at", back).where("_at > 0").withColumn("stacktrace", invert(cut)).drop("_at")


def sandwich_filter(function: str) -> StackFilter:
    """Filter applied after the cut: the stack mentions the function, without ASCII case."""
    return StackFilter(Criteria(function_name=Condition("contains", function)))
