"""Reports on small profiles with known results."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Window, functions as F

from helpers import collect, folded, line, loc, samples
from stackloom.operators import aggregate, diff
from stackloom.operators.running import dense_ids, running_sum
from stackloom.plans import callgraph, flamechart as fc, flamegraph as fg, listing
from stackloom.plans.flamegraph_table import flamegraph_table as table_form, listed
from stackloom.schema import SAMPLES


def five(spark):
    l = {i: loc(0xa0 + i, line(str(i))) for i in range(1, 6)}
    l[6] = loc(0xa6, line("2", system_name="2b"), file="b", build_id="bID")
    stack = lambda *ids: [l[i] for i in ids]
    return samples(spark, [
        (stack(2, 1), 2, {"goroutine": "app", "cpu": "0"}), (stack(5, 3, 2, 1), 1, {"goroutine": "app", "cpu": "1"}),
        (stack(4, 3, 2, 1), 3), (stack(5, 3, 2, 1), 4, {"goroutine": "container"}), (stack(6, 1), 1)])


def test_flamegraph_by_function(spark):
    p = aggregate.merge(five(spark))
    rows = collect(fg.flamegraph(p, meta=True), "depth", "name", "cumulative", "flat", "mapping_file", "system_name")
    assert rows == sorted([
        (0, None, 11, 0, None, None), (1, "1", 11, 0, "a", "1"), (2, "2", 11, 3, None, None), (3, "3", 8, 0, "a", "3"),
        (4, "5", 5, 5, "a", "5"), (4, "4", 3, 3, "a", "4")], key=repr)
    assert fg.height(p).first()[0] == 5
    assert fg.total(p).first()["value"] == 11


def test_flamegraph_by_label(spark):
    group = ("labels.goroutine",)
    p = aggregate.merge(five(spark), group_by=group)
    rows = collect(fg.flamegraph(p, group).where("depth <= 1"), "labels", "labels_only", "name", "cumulative", "flat")
    assert rows == sorted([(None, False, None, 11, 0), ("goroutine=app", True, None, 3, 0),
                           ("goroutine=container", True, None, 4, 0), (None, False, "1", 4, 0)], key=repr)


def test_table_form(spark):
    """Nodes read back through the tables are those of the flame graph; only what nodes name is in the tables."""
    p = aggregate.merge(five(spark))
    form = table_form(p)
    rows = collect(listed(form), "depth", "frame", "parent", "address", "line_index", "mapping_file", "system_name", "cumulative", "flat")
    assert rows == sorted([
        (1, "1", None, 0xa1, 0, "a", "1", 11, 0), (2, "2", "1", 0xa2, 0, None, "2", 11, 3), (3, "3", "2", 0xa3, 0, "a", "3", 8, 0),
        (4, "5", "3", 0xa5, 0, "a", "5", 5, 5), (4, "4", "3", 0xa4, 0, "a", "4", 3, 3)], key=repr)
    assert [r["cumulative"] for r in form.nodes.where("depth = 0").collect()] == [11]
    for part, n in (("functions", 5), ("locations", 5), ("mappings", 1), ("nodes", 6)):
        ids = sorted(r["id"] for r in getattr(form, part).collect() if r["id"])
        assert ids == list(range(1, (n if part != "nodes" else n - 1) + 1)), part
    texts = {r["id"]: r["text"] for r in form.strings.collect()}
    assert texts[0] == "" and sorted(texts.values()) == sorted(["", "1", "2", "3", "4", "5", "f.go", "a", "aID"])
    inlined = samples(spark, [([loc(0xa3, line("c", 300)), loc(0xa2, line("i", 89), line("o", 200)), loc(5)], 1), ([], 7)])
    rows = collect(listed(table_form(inlined)), "depth", "frame", "line_index", "cumulative")
    assert rows == [(1, "0x5", 0, 1), (2, "o", 1, 1), (3, "i", 0, 1), (4, "c", 0, 1)]
    assert listed(table_form(inlined.limit(0))).collect() == []


def test_unknown_group_field():
    with pytest.raises(ValueError):
        fg.check_group_by(["colour"])


def test_inlined_lines(spark):
    p = samples(spark, [([loc(0xa3, line("c", 300)), loc(0xa2, line("i", 89), line("o", 200)), loc(0xa1, line("a", 1))], 1)])
    rows = collect(fg.flamegraph(p, meta=True), "depth", "name", "inlined", "line")
    assert rows == sorted([(0, None, None, None), (1, "a", False, 1), (2, "o", False, 200), (3, "i", True, 89),
                           (4, "c", False, 300)], key=repr)
    assert fg.height(p).first()[0] == 5 and fg.height(p, legacy=True).first()[0] == 4


def test_trim(spark):
    p = samples(spark, [(["2", "1"], 10), (["5", "3", "2", "1"], 1), (["4", "3", "2", "1"], 3)])
    out = fg.trim(fg.flamegraph(p), p, 50.0)
    assert collect(out, "depth", "name", "cumulative", "flat") == sorted(
        [(0, None, 14, 0), (1, "1", 14, 0), (2, "2", 14, 10)], key=repr)
    assert fg.trimmed_total(out).first()[0] == 4
    p = samples(spark, [(["3", "2", "1"], 60), (["4", "2", "1"], 10), (["2", "1"], 20), (["1"], 10)])
    out = fg.trim(fg.flamegraph(p), p, 50.0)
    assert out.where("depth = 0").first()["cumulative"] == 100


def test_trim_drops_what_hangs_below(spark):
    # "big" would pass by itself, but its parent is cut
    p = samples(spark, [(["x", "main"], 90), (["big", "small", "main"], 10)])
    out = fg.trim(fg.flamegraph(p), p, 20.0)
    assert collect(out, "depth", "name") == [(0, None), (1, "main"), (2, "x")]


def test_trim_zero_drops_empty_nodes(spark):
    base, compare = samples(spark, [(["gone", "main"], 5)]), samples(spark, [(["kept", "main"], 5)])
    p = diff.diff(base, compare, absolute=True)
    assert {r["name"] for r in fg.trim(fg.flamegraph(p), p, 0.0).collect()} == {None, "main", "kept"}


def test_legacy_trim_keeps_equal(spark):
    p = samples(spark, [(["a", "r"], 50), (["b", "r"], 50)])
    tree = fg.flamegraph(p)
    assert fg.trim(tree, p, 50.0).count() == 2
    assert fg.trim(tree, p, 50.0, legacy=True).count() == 4


def test_layout(spark):
    p = samples(spark, [(["c", "a"], 3), (["d", "a"], 4), (["b"], 5)])
    rows = collect(fg.layout(fg.flamegraph(p)), "depth", "name", "value_offset")
    assert rows == sorted([(0, None, 0), (1, "a", 0), (1, "b", 7), (2, "c", 0), (2, "d", 3)], key=repr)


def test_running_sum_equals_the_window(spark):
    df = spark.range(2000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.hash("id").alias("o"),
                                  (F.col("id") % 17).alias("v"), "id")
    before = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("s", F.coalesce(F.sum("v").over(before), F.lit(0)))
    assert collect(running_sum(df, "g", "o", "v", "s"), "id", "s") == collect(want, "id", "s")


def test_dense_ids(spark):
    out = dense_ids(spark.range(1000).select(F.col("id").cast("string").alias("t")), ["t"], "n", buckets=16)
    assert sorted(r["n"] for r in out.collect()) == list(range(1, 1001))


def model(rows):
    """The same reports in plain Python."""
    tree, cum, flat, edges = Counter(), Counter(), Counter(), Counter()
    for stack, value, *_ in rows:
        path = tuple(reversed(stack))
        for d in range(1, len(path) + 1):
            tree[path[:d]] += value
        for i, name in enumerate(stack):
            cum[name] += value
            flat[name] += value if i == 0 else 0
            if i:
                edges[(name, stack[i - 1])] += value
    return tree, cum, flat, edges


def test_random_stacks_against_model(spark):
    rng = random.Random(3)
    rows = [([rng.choice("abcd") for _ in range(rng.randint(0, 6))], rng.randint(1, 9)) for _ in range(300)]
    p = aggregate.merge(samples(spark, rows))
    tree, cum, flat, edges = model(rows)
    nodes = fg.flamegraph(p).where("depth > 0")
    assert Counter(nodes.select("depth", "name", "cumulative").collect()) == Counter(
        [(len(k), k[-1], v) for k, v in tree.items()])
    table = {r["name"]: (r["cumulative"], r["flat"]) for r in listing.table(p).collect()}
    assert table == {n: (cum[n], flat[n]) for n in cum}
    top = {r["name"]: (r["cumulative"], r["flat"]) for r in listing.top(p).collect()}
    assert top == table
    assert {(r["source"], r["target"]): r["cumulative"] for r in callgraph.edges(p).collect()} == dict(edges)
    assert {r["node"]: r["cumulative"] for r in callgraph.nodes(p).collect()} == dict(cum)
    # invariants
    nonempty = sum(v for s, v in rows if s)
    assert nodes.where("depth = 1").agg(F.sum("cumulative")).first()[0] == nonempty
    assert nodes.agg(F.sum("flat")).first()[0] == nonempty == listing.top(p).agg(F.sum("flat")).first()[0]


def test_top_unsymbolised(spark):
    p = samples(spark, [([loc(1), loc(2)], 1), ([loc(1), loc(3)], 1), ([loc(1), loc(4)], 1)])
    rows = [(r["address"], r["cumulative"], r["flat"]) for r in listing.top(p).collect()]
    assert rows == [(1, 3, 3), (2, 1, 0), (3, 1, 0), (4, 1, 0)]


def test_table_unsymbolised(spark):
    l = [loc(i) for i in range(4)]
    p = samples(spark, [([l[1], l[0]], 1), ([l[2], l[0]], 2), ([l[3], l[0]], 3), ([l[0]], 4)])
    assert collect(listing.table(p), "address", "cumulative", "flat") == [(0, 10, 4), (1, 1, 1), (2, 2, 2), (3, 3, 3)]


def test_neighbours(spark):
    p = samples(spark, [(["c", "b", "a"], 1), (["c", "a"], 1), (["b", "a"], 5)])
    rows = collect(listing.table_neighbours(p).selectExpr("callee.name AS f", "caller.name AS by"), "f", "by")
    assert rows == [("b", "a"), ("c", "a"), ("c", "b")]


def test_callgraph_prune(spark):
    nodes = spark.createDataFrame([(n, c, 0) for n, c in dict(A=100, B=200, C=1, D=1, E=100, F=100, G=300, H=100, I=1, J=100).items()],
                                  "node string, cumulative bigint, flat bigint")
    pairs = "AB BC CD DE BF FH FG HI EI IJ".split()
    edges = spark.createDataFrame([(p[0], p[1], 1) for p in pairs], "source string, target string, cumulative bigint")
    kept, out = callgraph.prune(nodes, edges, F.lit(1000))
    assert {r["node"] for r in kept.collect()} == set("ABEFGHIJ")
    rows = {(r["source"], r["target"]): (r["cumulative"], r["is_collapsed"]) for r in out.collect()}
    assert len(rows) == 8 and rows[("B", "E")] == (2, True) and rows[("E", "I")] == (1, False)


def test_callgraph_prune_long_chain_and_cycle(spark):
    chain = [f"n{i:02d}" for i in range(40)]
    nodes = spark.createDataFrame([(n, 1, 0) for n in chain] + [("root", 1000, 0), ("leaf", 900, 0), ("x", 1, 0), ("y", 1, 0)],
                                  "node string, cumulative bigint, flat bigint")
    path = ["root"] + chain + ["leaf"]
    edges = spark.createDataFrame([(a, b, 1) for a, b in zip(path, path[1:])] + [("x", "y", 1), ("y", "x", 1)],
                                  "source string, target string, cumulative bigint")
    kept, out = callgraph.prune(nodes, edges, F.lit(1000))
    assert {r["node"] for r in kept.collect()} == {"root", "leaf", "x", "y"}
    assert collect(out, "source", "target", "cumulative", "is_collapsed") == sorted(
        [("root", "leaf", 40, True), ("x", "y", 1, False), ("y", "x", 1, False)], key=repr)


def test_source_report(spark):
    p = samples(spark, [([loc(1, line("f", 3, "/go/src/x.go")), loc(2, line("g", 9, "src/x.go"))], 2),
                        ([loc(2, line("g", 9, "src/x.go"))], 3), ([loc(5, line("h", 1, "x.go"), mapped=False)], 9)])
    assert collect(listing.source_report(p, "x.go"), "filename", "line_number", "cumulative", "flat") == [
        ("/go/src/x.go", 3, 2, 2), ("src/x.go", 9, 5, 3)]
    assert listing.source_report(p, "x.go", "other").count() == 0


def chart(spark, text):
    return fc.flamechart(aggregate.merge(folded(spark, text), group_by=("timestamp",)))


def test_flamechart_keeps_gaps(spark):
    out = chart(spark, "main;func_fib 10 1000 10\nruntime;gc 10 2000 10\nmain;func_fib 10 3000 10")
    assert sorted(r["start"] for r in out.where("depth = 1").collect()) == [1000, 2000, 3000]
    out = chart(spark, "\n".join(["main;func_fib 10 10 1", "main;func_fib 10 20 1", "main;func_add 10 30 1",
                                  "runtime;gc 10 40 1", "main;func_fib 10 50 1", "main;func_fib 10 60 1"]))
    assert sorted(r["start"] for r in out.where("depth = 1").collect()) == [10, 40, 50]


def test_flamechart_jitter(spark):
    assert chart(spark, "a;b 52 1000 52\na;c 52 1158 52\na;d 52 1211 52").count() + 1 == 6
    assert chart(spark, "a;b 52 1549 52\na;c 52 1601 52\na;b 52 1654 52").count() + 1 == 5


def test_flamechart_same_time_is_an_error(spark):
    with pytest.raises(Exception, match="same time"):
        chart(spark, "a;b 5 10 50\na;c 5 10 50").count()


def brute_chart(rows, labelled):
    """All samples of one series in order; nodes as (path, start) -> value."""
    nodes = Counter()
    children, last, node_of = defaultdict(dict), {}, {}
    for t, value, period, stack in sorted(rows):
        parent, open_ = (), True
        for depth, name in enumerate(stack):
            cr = children[parent].get(name) if open_ else None
            adjacent = (depth == 0 and not labelled) or last.get(parent) == cr
            if cr is not None and adjacent and t - (cr[-1][1] + nodes[cr]) - period // 10 <= 0:
                node = cr
            else:
                open_ = False
                node = parent + ((name, t),)
                children[parent][name] = node
            last[parent] = node
            nodes[node] += value
            parent = node
    return Counter((len(n), n[-1][0], n[-1][1], v) for n, v in nodes.items())


@pytest.mark.parametrize("labelled, piece_rows", [(False, 10**6), (True, 10**6), (False, 20), (True, 5)])
def test_flamechart_against_brute_force(spark, labelled, piece_rows):
    rng = random.Random(11)
    t, rows = 0, []
    for _ in range(400):
        t += rng.choice([9, 10, 10, 10, 11, 12, 30])
        rows.append((t, rng.choice([9, 10, 10, 11]), 20, [rng.choice("ab") for _ in range(rng.randint(1, 4))]))
    text = "\n".join(f"{';'.join(s)} {v} {t} {p}" for t, v, p, s in rows)
    df = folded(spark, text)
    group = ("labels.k",) if labelled else ()
    if labelled:
        df = df.withColumn("labels", F.create_map(F.lit("k"), F.lit("v")))
    merged = aggregate.merge(df, group_by=group + ("timestamp",))
    out = fc.flamechart(merged, group, piece_rows=piece_rows, run_rows=7)
    got = Counter((r["depth"], r["frame"], r["start"], r["cumulative"]) for r in out.collect())
    assert got == brute_chart(rows, labelled)


def test_runs_compose():
    """The node after a run, from its summary, is that of a fold sample by sample, whatever came in."""
    rng = random.Random(5)
    for _ in range(300):
        t, rows = 0, []
        for _ in range(rng.randint(1, 25)):
            t += rng.choice([5, 9, 10, 11, 12, 30])
            rows.append((rng.choice([1, 1, 1, 1, 2]), t, rng.choice([1, 9, 10, 12, 40]), rng.choice([0, 20, 50])))
        made = fc.Run()
        for row in rows:
            made.add(*row)
        summary = made.summary()
        for key, end in [(None, fc.Run.NEVER)] + [(k, e) for k in (1, 2) for e in range(-60, t + 60, 3)]:
            path = fc.OpenPath([[key, -1000, end]] if key else [])
            for k, at, value, period in rows:
                path.add([k], at, value, period)
            assert fc.after_run(summary, key, end, -1000) == (path.levels[0][0], path.levels[0][2], path.levels[0][1])


def test_gapless_root_in_many_tasks(spark):
    """A root function without a gap, and below it one that has none either, are cut into runs; rows stay the same."""
    n = 20_000
    df = spark.range(n).selectExpr(
        "'cpu' AS name", "'wall' AS sample_type", "'nanoseconds' AS sample_unit", "'cpu' AS period_type", "'nanoseconds' AS period_unit",
        "20L AS period", "0L AS duration", "0L AS timestamp", "id * 10 + id % 3 AS time_nanos", "10L AS value",
        "map('k', 'v') AS labels", "array(concat('leaf', cast(id div 7 % 5 AS string)), concat('mid', cast(id div 500 % 3 AS string)), 'loop', 'main') AS s")
    line = "named_struct('line', 1L, 'column', 0L, 'function_name', f, 'function_system_name', f, 'function_filename', 'f.go', 'function_start_line', 1L)"
    stack = f"""transform(s, f -> named_struct('address', 0L, 'mapping_start', cast(null AS bigint), 'mapping_limit', cast(null AS bigint),
      'mapping_offset', cast(null AS bigint), 'mapping_file', cast(null AS string), 'mapping_build_id', cast(null AS string), 'lines', array({line})))"""
    merged = aggregate.merge(df.selectExpr("* EXCEPT (s)", f"{stack} AS stacktrace").to(SAMPLES), group_by=("timestamp",))
    columns = ("series", "depth", "frame", "parent", "start", "parent_start", "cumulative", "flat")
    whole = collect(fc.flamechart(merged), *columns)
    assert [r for r in whole if r[1] == 1] == [("", 1, "main", None, 0, None, n * 10, 0)]
    assert collect(fc.flamechart(merged, piece_rows=1000, run_rows=500), *columns) == whole
    # the rows of the one root function are summarised in 40 runs, in as many tasks
    paths = fc.timed_paths(merged).withColumn("piece", F.lit("p")).withColumn("starts", F.array().cast("array<bigint>"))
    runs = paths.repartitionByRange(40, "piece", "time_nanos").sortWithinPartitions("piece", "time_nanos").withColumn(
        "run", F.spark_partition_id()).mapInArrow(fc._summaries, f"piece string, run int, {fc.SUMMARY}")
    sizes = [r["n"] for r in paths.repartitionByRange(40, "piece", "time_nanos").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert runs.count() >= 30 and max(sizes) < 4 * n / 40


def test_code_of_line_samples_is_short_enough_to_be_compiled(spark):
    """The JVM compiles no method of more than 8,000 bytes, and runs longer ones step by step."""
    from stackloom.sources.tables import line_samples

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stacks = line_samples(spark, "/root/testdata/sf0.001").agg(F.max(F.size("stacktrace")))
        explain = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString
        sizes = re.findall(r"maxMethodCodeSize:(\d+)", explain(stacks._jdf.queryExecution(), "codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert 0 < max(map(int, sizes)) < 8000
