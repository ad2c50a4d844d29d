"""Analytics over weighted, labelled call-stack samples, expressed as Spark DataFrames."""

from stackloom.plans.query import Diff, Query, Selection, run
from stackloom.sources.samples import read_samples, write_samples

__all__ = ["Diff", "Query", "Selection", "run", "read_samples", "write_samples"]
