"""Composing a whole report: select, merge, filter, compare, summarise.

Flame charts, call graphs and trimmed trees write checkpoints while they are composed; everything else is lazy.
"""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from stackloom.operators import aggregate, diff as difference, filters as flt, frames, metadata, select
from stackloom.operators.symbolize import symbolize
from stackloom.plans import callgraph, flamechart, flamegraph, listing

REPORTS = ("flamegraph", "flamechart", "table", "top", "callgraph", "source", "metadata", "profile")


@dataclass(frozen=True)
class Selection:
    """One side of a query: a profile type and matchers, merged over a range or taken at one instant."""

    profile_type: select.ProfileType
    start: int | None = None
    end: int | None = None
    at: int | None = None
    matchers: tuple = ()


@dataclass(frozen=True)
class Diff:
    base: Selection
    compare: Selection
    absolute: bool = False


@dataclass(frozen=True)
class Query:
    source: Selection | Diff
    report: str = "flamegraph"
    group_by: tuple[str, ...] = ()
    filters: tuple = ()
    sandwich_by: str = ""
    invert: bool = False
    trim_percent: float = 0.0
    source_file: str = ""
    source_build_id: str = ""
    resolved_symbols: DataFrame | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Report:
    """``rows`` (and ``edges`` of a call graph), with the total and what stack filters took away."""

    rows: DataFrame
    totals: DataFrame
    edges: DataFrame | None = None


def _side(samples: DataFrame, s: Selection, group_by, q: Query, sandwich: str, merged: bool) -> DataFrame:
    chosen = select.matching(select.select_type(samples, s.profile_type), s.matchers)
    if s.at is not None:
        if sandwich:
            raise ValueError("a single profile cannot be cut at a function")
        profile = aggregate.single(chosen, s.at, s.profile_type.delta, group_by)
    elif merged or q.resolved_symbols is not None:
        profile = aggregate.merge(chosen, s.start, s.end, group_by, s.profile_type.delta)
    else:
        profile = aggregate.rows(chosen, s.start, s.end, group_by)
    if q.resolved_symbols is not None:
        profile = symbolize(profile, q.resolved_symbols)
    if sandwich:
        return flt.sandwich(profile, sandwich, q.invert)
    return profile.withColumn("stacktrace", frames.invert("stacktrace")) if q.invert else profile


def _condition(samples: DataFrame, s: Selection):
    return s.profile_type.predicate() & select.matches(samples, s.matchers) & select.range_predicate(s.start, s.end)


def profile_of(samples: DataFrame, q: Query) -> DataFrame:
    """The selected (merged, compared) profile before filters."""
    group_by = q.group_by + (("timestamp",) if q.report == "flamechart" else ())
    flamegraph.check_group_by(group_by)
    if isinstance(q.source, Diff):
        d = q.source
        if d.base.at is None and d.compare.at is None and q.resolved_symbols is None:
            merged = difference.compare_samples(samples, *(_condition(samples, s) for s in (d.base, d.compare)), d.absolute)
            return merged.withColumn("stacktrace", frames.invert("stacktrace")) if q.invert else merged
        base, compare = (_side(samples, s, (), q, "", True) for s in (d.base, d.compare))
        return difference.diff(base, compare, d.absolute)
    # most reports merge by themselves, on the frame fields they show
    merged = q.report in ("flamechart", "profile")
    return _side(samples, q.source, group_by, q, q.sandwich_by, merged)


def run(samples: DataFrame, q: Query) -> Report:
    """Compose the report. Totals count what is left after the filters; ``filtered`` what they removed."""
    if q.report not in REPORTS:
        raise ValueError(f"unknown report: {q.report}")
    if q.report == "metadata":
        s = q.source.compare if isinstance(q.source, Diff) else q.source
        chosen = select.matching(select.select_type(samples, s.profile_type), s.matchers)
        chosen = select.at_instant(chosen, s.at) if s.at is not None else select.in_range(chosen, s.start, s.end)
        files = metadata.mapping_files(chosen).withColumnRenamed("mapping_file", "value")
        names = metadata.label_names(chosen).withColumnRenamed("label", "value")
        rows = files.withColumn("kind", F.lit("mapping_file")).unionByName(names.withColumn("kind", F.lit("label")))
        return Report(rows, chosen.agg(F.sum("value").alias("total")))
    profile = profile_of(samples, q)
    all_filters = tuple(q.filters) + ((flt.sandwich_filter(q.sandwich_by),) if q.sandwich_by else ())
    before_after = flt.filtered_total(profile, all_filters)
    kept = flt.apply_filters(profile, all_filters)
    totals = before_after.select((F.col("total") - F.col("filtered")).alias("total"), "filtered")
    if q.report == "profile":
        return Report(kept, totals)
    if q.report == "top":
        return Report(listing.top(kept), totals)
    if q.report == "table":
        return Report(listing.table(kept), totals, edges=listing.table_neighbours(kept))
    if q.report == "source":
        return Report(listing.source_report(kept, q.source_file, q.source_build_id), totals)
    if q.report == "callgraph":
        total = aggregate.totals(kept).select("value").scalar()
        nodes, edges = callgraph.prune(callgraph.nodes(kept), callgraph.edges(kept), total)
        return Report(nodes, totals, edges=edges)
    if q.report == "flamechart":
        return Report(flamechart.flamechart(kept, q.group_by), totals)
    tree = flamegraph.flamegraph(kept, q.group_by, meta=True)
    return Report(flamegraph.trim(tree, kept, q.trim_percent), totals)
