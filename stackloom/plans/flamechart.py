"""Flame chart: the flame graph along time.

Consecutive samples share a node while the path is the same, the node is the
last one touched under its parent, and the sample starts no later than the
node's end plus a tenth of the period. A node's end moves with every value it
takes up, so the samples of one node depend on each other; everything else
doesn't:

* a piece is a series (without labels, a root function of it, as these are
  independent of each other);
* a piece that is too long for one task is cut into runs of rows. A run is
  summarised, for its uppermost open level, as the function from the end of the
  node that comes in to the node that goes out. These functions compose, so runs
  are summarised in parallel, chained by their summaries alone, and then know
  what came in. The nodes found are pieces themselves, and are cut at the next
  level if they are still too long (a function that runs without a gap);
* the fold streams over sorted partitions, holding one open path, and returns
  only the start of each node on the path;
* nodes are then an explode and a groupBy, and get their names last.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stackloom.functions.scalar import labels_text, record
from stackloom.session import cut_lineage
from stackloom.plans.flamegraph import check_group_by, frame_text_sql, root_paths, with_ids

#: Samples of a piece that one task folds by itself, and of a run of a longer one.
PIECE_ROWS, RUN_ROWS = 200_000, 50_000


class OpenPath:
    """The nodes the next sample may join: per level key, start and end."""

    def __init__(self, levels=()):
        self.levels = [list(x) for x in levels]

    def add(self, keys, t: int, value: int, period: int) -> list[int]:
        """Take up a sample; returns the start of its node on each level."""
        jitter = period // 10
        for depth, key in enumerate(keys):
            if depth < len(self.levels):
                level = self.levels[depth]
                if level[0] == key and level[1] >= t:
                    raise ValueError(f"several samples of one series at the same time: {t}")
                if level[0] == key and t - level[2] - jitter <= 0:
                    level[2] += value
                    continue
            del self.levels[depth:]
            self.levels += [[k, t, t + value] for k in keys[depth:]]
            break
        return [level[1] for level in self.levels[:len(keys)]]


class Run:
    """What a run of samples makes of the open node that comes in, on one level.

    Up to a bound on the incoming end the run leaves a node of its own behind (``ends`` and ``starts`` per interval between
    ``bounds``); beyond the last bound the incoming node goes on, longer by ``taken``. A node of another key comes in as
    an end of minus infinity. Once the key changes within the run, nothing that came in matters.
    """

    NEVER = -(1 << 62)

    def __init__(self):
        self.bounds, self.ends, self.starts = (np.empty(0, np.int64) for _ in range(3))
        self.first = self.last = None
        self.threshold, self.taken = self.NEVER, 0

    def add(self, key: int, t: int, value: int, period: int) -> None:
        limit = t - period // 10
        if self.first is None:
            self.first = key
        elif key != self.last:
            self.bounds, self.ends, self.starts = np.array([self.NEVER]), np.array([t + value]), np.array([t])
            self.threshold, self.last = None, key
            return
        self.last = key
        if len(self.ends):
            joins = self.ends >= limit
            self.ends, self.starts = np.where(joins, self.ends + value, t + value), np.where(joins, self.starts, t)
        if self.threshold is not None:
            if limit - self.taken > self.threshold:
                self.bounds, self.ends, self.starts = (np.append(a, x) for a, x in (
                    (self.bounds, self.threshold), (self.ends, t + value), (self.starts, t)))
                self.threshold = limit - self.taken
            self.taken += value
        if len(self.ends) > 256:
            self.compact()

    def compact(self) -> None:
        """Intervals side by side that end alike are one."""
        keep = np.append(True, (np.diff(self.ends) != 0) | (np.diff(self.starts) != 0))
        self.bounds, self.ends, self.starts = self.bounds[keep], self.ends[keep], self.starts[keep]

    def summary(self) -> dict:
        self.compact()
        return dict(first=self.first, last=self.last, bounds=self.bounds.tolist(), ends=self.ends.tolist(),
                    starts=self.starts.tolist(), threshold=self.threshold, taken=self.taken)


def after_run(summary: dict, key, end: int, start: int) -> tuple:
    """(key, end, start) of the open node after a run, from that before it."""
    if key != summary["first"]:
        end = Run.NEVER
    if summary["threshold"] is not None and end >= summary["threshold"]:
        return summary["last"], end + summary["taken"], start
    at = int(np.searchsorted(summary["bounds"], end, "right")) - 1
    return summary["last"], summary["ends"][at], summary["starts"][at]


def timed_paths(profile: DataFrame, group_by=()) -> DataFrame:
    """Rows (series, time_nanos, value, period, keys, names), keys being the node hashes from the root frame down."""
    labels = check_group_by(group_by)
    frame_groups = [g for g in group_by if not g.startswith("labels.") and g != "timestamp"]
    series = labels_text(F.map_filter("labels", lambda k, _: k.isin(labels))) if labels else F.lit("")
    # the empty ones go by the stored column: a filter on computed keys would compute them twice
    marked = profile.where(F.size("stacktrace") > 0).withColumn("_series", series).withColumn("diff", F.lit(0).cast("long"))
    return with_ids(root_paths(marked, frame_groups, carry=["_series", "time_nanos", "period"]), frame_groups).select(
        F.col("_series").alias("series"), "time_nanos", "value", "period",
        F.slice(F.transform("ids", lambda i: i["hi"]), F.lit(2), F.size("path")).alias("keys"),
        F.expr(f"transform(path, f -> {frame_text_sql('f.', labels=False)}) AS names"))


ROWS = "piece string, series string, time_nanos bigint, value bigint, period bigint, keys array<bigint>, starts array<bigint>"
SUMMARY = ("first bigint, last bigint, bounds array<bigint>, ends array<bigint>, starts array<bigint>, threshold bigint, taken bigint")


def _arrow(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _fold(batches):
    """Add the starts of the levels that aren't known yet; rows come sorted by piece and time."""
    current, path = None, OpenPath()
    for batch in batches:
        starts = []
        for piece, t, v, p, keys, known in zip(*(batch.column(c).to_pylist() for c in (
                "piece", "time_nanos", "value", "period", "keys", "starts"))):
            if piece != current:
                current, path = piece, OpenPath()
            starts.append(known + path.add(keys[len(known):], t, v, p))
        yield pa.RecordBatch.from_arrays(
            [batch.column("series"), batch.column("time_nanos"), batch.column("value"), batch.column("keys"),
             pa.array(starts, pa.list_(pa.int64()))], names=["series", "time_nanos", "value", "keys", "starts"])


def _summaries(batches):
    """One row per (piece, run); rows come sorted by piece and time, a task's rows are one run of each of its pieces."""
    names = ["piece", "run"] + [x.split()[0] for x in SUMMARY.split(", ")]
    numbers = pa.list_(pa.int64())
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), numbers, numbers, numbers, pa.int64(), pa.int64()]
    current, run, made = None, None, []
    for batch in batches:
        for piece, number, t, v, p, keys, known in zip(*(batch.column(c).to_pylist() for c in (
                "piece", "run", "time_nanos", "value", "period", "keys", "starts"))):
            if piece != current:
                made += [(*current_run, *run.summary().values())] if run else []
                current, current_run, run = piece, (piece, number), Run()
            run.add(keys[len(known)], t, v, p)
    made += [(*current_run, *run.summary().values())] if run else []
    if made:
        yield _arrow(made, names, types)


def _chain(batches):
    """What comes into each run; summaries come sorted by piece and run. One open node is held."""
    current, node = None, (None, 0, 0)
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["piece"] != current:
                current, node = row["piece"], (None, Run.NEVER, 0)
            out.append((row["piece"], row["run"], *node))
            node = after_run(row, *node)
        if out:
            yield _arrow(out, ["piece", "run", "in_key", "in_end", "in_start"], [pa.string(), pa.int32()] + [pa.int64()] * 3)


def _next_level(batches):
    """Add the start of the next level, from what comes into the run."""
    current, node = None, (None, 0, 0)
    for batch in batches:
        starts = []
        for piece, t, v, p, keys, known, *came in zip(*(batch.column(c).to_pylist() for c in (
                "piece", "time_nanos", "value", "period", "keys", "starts", "in_key", "in_end", "in_start"))):
            if piece != current:
                current, node = piece, came
            key, end, start = node
            mine = keys[len(known)]
            if key == mine and start >= t:
                raise ValueError(f"several samples of one series at the same time: {t}")
            node = (key, end + v, start) if key == mine and end >= t - p // 10 else (mine, t + v, t)
            starts.append(known + [node[2]])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("piece", "series", "time_nanos", "value", "period", "keys")),
             pa.array(starts, pa.list_(pa.int64()))], names=[x.split()[0] for x in ROWS.split(", ")])


def split_long_pieces(rows: DataFrame, piece_rows: int = PIECE_ROWS, run_rows: int = RUN_ROWS) -> DataFrame:
    """Pieces of at most ``piece_rows`` samples, with the starts of the levels at which longer ones were cut.

    A piece is cut at its uppermost unknown level, in runs of about ``run_rows`` rows. Its nodes there are the new pieces;
    samples whose path ends there are finished. Each round sees the rows of long pieces only, so it ends at the
    first level at which none is left, or with the longest path.
    """
    finished = []
    while True:
        # as many as there are rows by piece_rows at most, so they may be sent to all tasks
        long = rows.groupBy("piece").count().where(F.col("count") > piece_rows).select("piece", "count")
        n = long.agg(F.sum("count")).first()[0]
        if not n:
            return reduce(DataFrame.unionByName, finished + [rows])
        long = F.broadcast(cut_lineage(long.select("piece")))
        finished.append(rows.join(long, "piece", "left_anti"))
        runs = -(-n // run_rows)
        ranged = cut_lineage(rows.join(long, "piece", "left_semi").repartitionByRange(runs, "piece", "time_nanos")
                             .sortWithinPartitions("piece", "time_nanos").withColumn("run", F.spark_partition_id()))
        summaries = ranged.mapInArrow(_summaries, f"piece string, run int, {SUMMARY}")
        came = summaries.repartition("piece").sortWithinPartitions("piece", "run").mapInArrow(
            _chain, "piece string, run int, in_key bigint, in_end bigint, in_start bigint")
        # a row for each run and piece in it; a broadcast keeps the order of the rows
        known = ranged.join(F.broadcast(cut_lineage(came)), ["piece", "run"]).mapInArrow(_next_level, ROWS)
        known = cut_lineage(known.withColumn("piece", F.concat_ws(
            "\x1f", "series", F.get("keys", F.size("starts") - 1).cast("string"), F.element_at("starts", -1).cast("string"))))
        whole = F.size("keys") == F.size("starts")
        finished.append(known.where(whole))
        rows = known.where(~whole)


def flamechart(profile: DataFrame, group_by=(), piece_rows: int = PIECE_ROWS, run_rows: int = RUN_ROWS) -> DataFrame:
    """Nodes (series, depth, frame, parent, start, parent_start, cumulative, flat).

    ``profile`` comes from a merge grouped by timestamp and the same labels.
    """
    # read for the sizes of pieces, the fold and the names
    paths = cut_lineage(timed_paths(profile, group_by))
    # under a label node only the last child is eligible, whatever its function; else the newest node of the same function is
    root = F.when(F.col("series") == "", F.get("keys", F.lit(0)).cast("string"))
    pieces = split_long_pieces(paths.select(
        F.concat_ws("\x1f", "series", root).alias("piece"), "series", "time_nanos", "value", "period", "keys",
        F.array().cast("array<bigint>").alias("starts")), piece_rows, run_rows)
    ordered = pieces.repartition("piece").sortWithinPartitions("piece", "time_nanos")
    folded = ordered.mapInArrow(
        _fold, "series string, time_nanos bigint, value bigint, keys array<bigint>, starts array<bigint>")
    nodes = chart_nodes(folded)
    # paths repeat, so their names are taken from the distinct ones
    named = F.transform("keys", lambda k, i: record(
        node=k, frame=F.get("names", i), parent=F.when(i > 0, F.get("names", i - 1))))
    names = paths.groupBy("keys").agg(F.first("names").alias("names")).select(F.inline(named)).dropDuplicates(["node"])
    return nodes.join(names, "node").select("series", "depth", "frame", "parent", "start", "parent_start", "cumulative", "flat")


def chart_nodes(folded: DataFrame) -> DataFrame:
    """Totals per node (series, node, depth, start, parent_start); ``folded`` has series, value, keys and starts."""
    node = F.transform("keys", lambda k, i: record(
        node=k, depth=(i + 1).cast("int"), start=F.get("starts", i),
        parent_start=F.when(i > 0, F.get("starts", i - 1)), leaf=i == F.size("keys") - 1))
    rows = folded.select("series", "value", F.inline(node))
    return rows.groupBy("series", "node", "depth", "start", "parent_start").agg(
        F.sum("value").alias("cumulative"),
        F.sum(F.when(F.col("leaf"), F.col("value")).otherwise(0)).alias("flat"))
