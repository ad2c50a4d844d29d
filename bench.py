"""Wall time of headline queries. Prints one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``), ``BENCH_CPUS`` (default 8)
and ``BENCH_QUERIES`` (space-separated names, or ``all``) select what is run.

Every query runs once, then all of them again up to ``BENCH_RUNS`` (default 3) times in turn while no more than
``BENCH_SECONDS`` (default 400) have gone by; the time of a query is the median of its runs.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stackloom.catalog import all_queries  # noqa: E402
from stackloom.session import local_session  # noqa: E402

HEADLINE = """merge flamegraph flamegraph_by_label flamegraph_meta flamegraph_trim top table callers callgraph_nodes
  callgraph_edges source_lines range_delta_sumby range_gauge diff_relative stack_fn_contains frame_fn sandwich_callees
  label_names mapping_files asof_symbolize symbolize_stacks resolve_stacks join_stacktrace_ids flamechart""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = os.environ.get("BENCH_QUERIES", "").split()
    spark = local_session(cpus, shuffle_partitions=cpus, memory="16g")
    queries = all_queries()
    names = list(queries) if wanted == ["all"] else (wanted or HEADLINE)
    # start the JVM, the Python workers and the code cache before the clock
    queries["merge"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    taken = {name: [] for name in names}
    begun = time.perf_counter()
    for turn in range(int(os.environ.get("BENCH_RUNS", "3"))):
        for name in names:
            if turn and time.perf_counter() - begun > float(os.environ.get("BENCH_SECONDS", "400")):
                break
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken[name].append(time.perf_counter() - start)
            print(f"{name} {taken[name][-1]:.3f}", file=sys.stderr, flush=True)
    times = {name: round(statistics.median(x), 3) for name, x in taken.items()}
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
