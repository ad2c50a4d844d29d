"""Stack and frame filters, presets, sandwich, comparison, selection."""

import pytest
from pyspark.sql import functions as F

from helpers import collect, line, loc, samples
from stackloom.functions import keys, scalar
from stackloom.functions.registry import register
from stackloom.operators import aggregate, diff, filters as flt, select, series
from stackloom.operators.filters import BinaryFilter, Condition, Criteria, FrameFilter, FunctionNameFilter, StackFilter
from stackloom.operators.frames import frames, invert
from stackloom.operators.presets import FIXED_PRESETS, preset, presets_for
from stackloom.operators.select import ProfileType
from stackloom.plans import flamegraph as fg
from stackloom.plans.query import Diff, Query, Selection, run


def profile(spark):
    f = lambda name, address, number, file, binary="myapp": loc(address, line(name, number, file), file=f"/bin/{binary}")
    return samples(spark, [
        ([f("main", 0x1000, 10, "main.go"), f("app.server.handleRequest", 0x2000, 25, "server.go"), f("database.query", 0x3000, 45, "db.go")], 100),
        ([f("main", 0x1000, 15, "main.go"), f("runtime.gc", 0x4000, 100, "gc.go", "runtime"), f("runtime.malloc", 0x5000, 200, "malloc.go", "runtime")], 50),
        ([f("utils.helper", 0x6000, 50, "utils.go"), f("database.connect", 0x7000, 80, "db.go")], 25),
        ([f("app.worker", 0x8000, 60, "worker.go"), f("app.process", 0x9000, 90, "process.go")], 30),
        ([f("main", 0x1000, 20, "main.go"), f("app.server.handleRequest", 0x2000, 30, "server.go"), f("database.execute", 0xA000, 100, "db.go")], 45),
    ])


def values(df):
    return sorted(r["value"] for r in df.collect())


def names(df):
    return sorted(tuple(r["n"]) for r in df.select(F.transform(frames("stacktrace"), lambda f: f["name"]).alias("n")).collect())


@pytest.mark.parametrize("criteria, expected", [
    ([dict(function_name=("contains", "MAIN")), dict(function_name=("not_contains", "database"))], [50]),
    ([dict(function_name=("equal", "Main"))], [45, 50, 100]),
    ([dict(function_name=("not_equal", "main"))], [25, 30]),
    ([dict(function_name=("starts_with", "app."))], [30, 45, 100]),
    ([dict(function_name=("not_starts_with", "app."))], [25, 50]),
    ([dict(binary=("contains", "runtime"))], [50]),
    ([dict(binary=("not_contains", "runtime"))], [25, 30, 45, 50, 100]),
    ([dict(filename=("equal", "db.go"))], [25, 45, 100]),
    ([dict(filename=("not_equal", "db.go"))], [30, 50]),
    ([dict(address=("equal", 0x4000))], [50]),
    ([dict(address=("not_equal", 0x1000))], [25, 30, 45, 50, 100]),
    ([dict(line_number=("equal", 100))], [45, 50]),
    ([dict(line_number=("not_equal", 100))], [25, 30, 100]),
    ([dict(function_name=("contains", "main"), line_number=("equal", 100))], [45, 50]),
])
def test_stack_filters(spark, criteria, expected):
    made = [Criteria(**{k: Condition(*v) for k, v in c.items()}) for c in criteria]
    assert values(flt.stack_filter(profile(spark), *made)) == expected


def test_filtered_total(spark):
    f = [StackFilter(Criteria(function_name=Condition("contains", "main")))]
    assert tuple(flt.filtered_total(profile(spark), f).first()) == (250, 55)
    kept = flt.apply_filters(profile(spark), f).agg(F.sum("value")).first()[0]
    assert kept + 55 == 250


def test_unsymbolised_and_empty_stacks(spark):
    df = samples(spark, [([loc(1)], 1), ([], 2)])
    assert values(flt.stack_filter(df, Criteria(function_name=Condition("contains", "x")))) == [2]
    assert values(flt.stack_filter(df, Criteria(function_name=Condition("not_contains", "x")))) == [1, 2]


def test_frame_filter_keeps_rows_and_locations(spark):
    df = samples(spark, [([loc(1, line("f"), file="/x/test"), loc(2, line("g"), file="libpython3.11.so.1.0"),
                           loc(3, file="test")], 7), ([loc(2, line("g"), file="libc.so")], 1)])
    out = flt.frame_filter(df, Criteria(binary=Condition("contains", "test")))
    assert sorted([[x["address"] for x in r["stacktrace"]] for r in out.collect()]) == [[], [1, 3]]
    assert values(out) == [1, 7]
    # an unsymbolised location is not judged by name
    out = flt.frame_filter(df, Criteria(function_name=Condition("equal", "f")))
    assert sorted([[x["address"] for x in r["stacktrace"]] for r in out.collect()]) == [[], [1, 3]]


def test_frame_filter_on_inlined_lines(spark):
    df = samples(spark, [([loc(1, line("inner"), line("outer"))], 1)])
    out = flt.frame_filter(df, Criteria(function_name=Condition("not_equal", "inner")))
    assert names(out) == [("outer",)]


def test_frame_filter_missing_values(spark):
    nameless = dict(line("f"), function_filename=None, line=None)
    df = samples(spark, [([loc(1, nameless, mapped=False)], 1)])
    assert names(flt.frame_filter(df, Criteria(filename=Condition("not_equal", "zzz")))) == [()]
    assert names(flt.frame_filter(df, Criteria(line_number=Condition("not_equal", 1)))) == [()]
    assert names(flt.frame_filter(df, Criteria(binary=Condition("equal", "zzz")))) == [("f",)]


def test_ascii_folding_leaves_other_letters(spark):
    df = samples(spark, [(["Ärger"], 1), (["ärger"], 2)])
    assert values(flt.stack_filter(df, Criteria(function_name=Condition("equal", "ÄRGER")))) == [1]


def test_conditions_are_checked():
    with pytest.raises(ValueError):
        Condition("greater", 1)
    with pytest.raises(ValueError):
        Condition("contains", 1)


def test_older_filters():
    up = flt.upgrade_filters([FunctionNameFilter("f", exclude=True), BinaryFilter(("a", "b"))])
    assert up == [StackFilter(Criteria(function_name=Condition("not_contains", "f"))),
                  FrameFilter(Criteria(binary=Condition("contains", "a"))), FrameFilter(Criteria(binary=Condition("contains", "b")))]


def test_presets(spark):
    assert len(FIXED_PRESETS) == 9 and all(preset(k, agent="x") for k in FIXED_PRESETS)
    with pytest.raises(ValueError):
        preset("hide_cuda_internals")
    wall = ProfileType("agent", "wallclock", "nanoseconds", "samples", "count", True)
    assert len(presets_for(wall)) == 9 and len(presets_for(ProfileType("a", "b", "c", "d", "e"))) == 7
    df = samples(spark, [(["tokio::runtime::park", "main", "<tokio::x>"], 1)])
    assert names(flt.apply_filters(df, preset("hide_tokio_frames"))) == [("main",)]


def test_sandwich(spark):
    df = samples(spark, [(["leaf", "F", "mid", "F", "root"], 1), (["f", "root"], 2), (["x", "F"], 3)])
    assert names(flt.sandwich(df, "F")) == [("leaf", "F"), ("x", "F")]
    assert names(flt.sandwich(df, "F", inverted=True)) == [("F",), ("root", "F")]


def test_invert_reverses_lines(spark):
    df = samples(spark, [([loc(1, line("a"), line("b")), loc(2, line("c"))], 1)])
    assert names(df.withColumn("stacktrace", invert("stacktrace"))) == [("c", "b", "a")]


def test_diff(spark):
    base, compare = samples(spark, [([loc(1, line("f"))], 1)]), samples(spark, [([loc(2, line("f"))], 2)])
    for absolute, expected in ((True, 1), (False, 0)):
        p = diff.diff(base, compare, absolute)
        node = fg.flamegraph(p).where("depth = 1").first()
        assert (node["cumulative"], node["diff"]) == (2, expected)
    assert sorted(r["diff"] for r in diff.diff(base, compare, True).collect()) == [-1, 2]


def test_diff_with_an_empty_side(spark):
    base, compare = samples(spark, [(["f"], 0)]), samples(spark, [(["f"], 4)])
    assert sorted(r["diff"] for r in diff.diff(base, compare).collect()) == [0, 4]


def test_matchers(spark):
    df = samples(spark, [(["f"], 1, {"a": "x"}), (["f"], 2, {"a": ""}), (["f"], 3, {}), (["f"], 4, {"a": "xy"})])
    pick = lambda *m: values(select.matching(df, list(m)))
    assert pick(("a", "=", "x")) == [1] and pick(("a", "=", "")) == [2, 3]
    assert pick(("a", "!=", "x")) == [2, 3, 4] and pick(("a", "!=", "")) == [1, 4]
    assert pick(("a", "=~", "x")) == [1, 4] and pick(("a", "!~", "x")) == [2]
    assert values(df.where(select.label_re("a", "x", anchored=True))) == [1]


def test_range_and_gauge(spark):
    s = 10**9
    df = samples(spark, [(["f"], 10, {"a": "x"}, 1 * s), (["f"], 20, {"a": "x"}, 2 * s), (["f"], 5, {}, 12 * s)], duration=3 * s, period=2)
    rows = collect(series.query_range(df, 10 * s, ["a"]), "bucket", "a", "value", "duration", "count", "value_per_second")
    assert rows == sorted([(0, "x", 60, 10 * s, 2, 60 / (10 * s)), (10 * s, None, 10, 3 * s, 1, 10 / (3 * s))], key=repr)
    gauge = collect(series.query_range_gauge(df, 10 * s), "labels", "time_nanos", "value", "count")
    assert gauge == sorted([("a=x", s, 10, 2), ("", 12 * s, 5, 1)], key=repr)
    assert series.query_range_gauge(df, 0).count() == 3
    with pytest.raises(ValueError):
        series.query_range(df, 0)


def test_addresses_order_as_unsigned(spark):
    df = spark.createDataFrame([(1,), (-1,), (2**62,)], "a bigint").orderBy(scalar.unsigned_key("a"))
    assert [r["a"] for r in df.collect()] == [1, 2**62, -1]


@pytest.mark.parametrize("file, query, expected", [
    ("main.go", "main.go", True), ("/go/src/main.go", "main.go", True), ("/go/src/main.go", "src/main.go", True),
    ("/go/src/main.go", "/go/src/main.go", True), ("domain.go", "main.go", False), ("/x/domain.go", "main.go", False),
    ("main.go", "src/main.go", False), ("", "", True), ("main.go", "", False), ("", "main.go", False),
    ("/main.go", "main.go", True), ("main.go/x", "main.go", False)])
def test_filename_match(spark, file, query, expected):
    register(spark)
    assert spark.range(1).select(scalar.filename_matches(F.lit(file), query)).first()[0] is expected
    assert spark.sql("SELECT filename_matches(:f, :q)", args={"f": file, "q": query}).first()[0] is expected


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("""SELECT step_bucket(25, 10), path_basename('/a/b'), ascii_fold('AÄ'), text_contains('ABC', 'bc'),
        text_not_contains('ABC', 'bc'), value_per_second(6, 2000000000, false), value_per_second(6, 3, true)""").first()
    assert tuple(row) == (20, "b", "aÄ", True, False, 3.0, 2.0)


def test_content_ids_as_sql_functions(spark):
    register(spark)
    df = samples(spark, [([loc(0, line("a")), loc(7, line("b"), mapped=False), loc(9, build_id="")], 1), ([], 2)])
    found = df.selectExpr("stack_id(stacktrace) AS s", "transform(stacktrace, x -> x.address) AS a", "stacktrace").withColumn("want", keys.stack_id("stacktrace"))
    assert all(r["s"] == r["want"] for r in found.collect())
    one = df.where("value = 1").selectExpr("inline(stacktrace)").select("*", F.struct("*").alias("loc"))
    for r in one.select(F.expr("location_id(loc)").alias("a"), keys.location_id(F.col("loc")).alias("b"),
                        F.expr("mapping_id(mapping_build_id, mapping_file, mapping_start, mapping_limit, mapping_offset)").alias("c"),
                        keys.mapping_id("mapping_build_id", "mapping_file", "mapping_start", "mapping_limit", "mapping_offset").alias("d")).collect():
        assert (r["a"], r["c"]) == (r["b"], r["d"])
    names = spark.sql("SELECT function_id('a', 'b', 'c', 1) AS f").select("f", keys.function_id(F.lit("a"), F.lit("b"), F.lit("c"), F.lit(1)).alias("g")).first()
    assert names["f"] == names["g"]


def test_query_composes(spark):
    df = profile(spark)
    whole = Selection(ProfileType("cpu", "samples", "count", "cpu", "nanoseconds"), 0, 10)
    f = (StackFilter(Criteria(function_name=Condition("contains", "main"))),)
    totals = set()
    for report in ("flamegraph", "top", "table", "callgraph", "source", "profile"):
        out = run(df, Query(whole, report, filters=f, source_file="db.go"))
        totals.add(tuple(out.totals.first()))
        assert out.rows.count() > 0
    assert totals == {(195, 55)}
    out = run(df, Query(whole, "flamegraph", sandwich_by="main", invert=True))
    assert tuple(out.totals.first()) == (195, 0)
    out = run(df, Query(Diff(whole, whole), "top"))
    assert {r["diff"] for r in out.rows.collect()} == {0}
    assert {(r["kind"], r["value"]) for r in run(df, Query(whole, "metadata")).rows.collect()} == {
        ("mapping_file", "/bin/myapp"), ("mapping_file", "/bin/runtime")}
    with pytest.raises(ValueError):
        run(df, Query(whole, "poster"))
    with pytest.raises(ValueError):
        run(df, Query(Selection(whole.profile_type, at=1), "top", sandwich_by="main"))


def test_label_sets_with_punctuation_stay_apart(spark):
    df = samples(spark, [(["f"], 5, {"a": "1,b=2"}, 1), (["f"], 7, {"a": "1", "b": "2"}, 1), (["f"], 9, {"a": "1\\", "b": "2"}, 1)], sample_unit="x")
    assert collect(series.query_range_gauge(df, 10), "labels", "value") == sorted(
        [(r"a=1\,b\=2", 5), ("a=1,b=2", 7), (r"a=1\\,b=2", 9)], key=repr)
    group = ("labels.a", "labels.b")
    nodes = fg.flamegraph(aggregate.merge(df, group_by=group), group).where("depth = 1")
    assert sorted(r["cumulative"] for r in nodes.collect()) == [5, 7, 9]


def test_addresses_above_the_signed_range(spark):
    kernel = 0xffffffff81000000
    df = samples(spark, [([loc(kernel - 2**64), loc(5)], 1), ([loc(5)], 2)])
    assert values(flt.stack_filter(df, Criteria(address=Condition("equal", kernel)))) == [1]
    out = flt.frame_filter(df, Criteria(address=Condition("not_equal", kernel)))
    assert [[x["address"] for x in r["stacktrace"]] for r in out.collect()] == [[5], [5]]
    with pytest.raises(ValueError):
        Condition("equal", 2**64)


def test_each_bound_of_a_range_applies(spark):
    kind = ProfileType("cpu", "samples", "count", "cpu", "nanoseconds")
    df = samples(spark, [(["f"], 1, {"a": "x", "b": None}, 10), (["g"], 2, {"a": "y"}, 20)])
    assert values(run(df, Query(Selection(kind, start=15), "profile")).rows) == [2]
    assert values(run(df, Query(Selection(kind, end=15), "profile")).rows) == [1]
    assert {r["value"] for r in run(df, Query(Selection(kind), "metadata")).rows.collect()} == {"a"}  # b is null throughout


def test_single_profiles_group_and_compare(spark):
    kind = ProfileType("cpu", "samples", "count", "cpu", "nanoseconds")
    df = samples(spark, [(["f"], 1, {"a": "x"}, 10**6), (["f"], 2, {"a": "y"}, 10**6), (["g"], 4, {}, 2 * 10**6)])
    tree = run(df, Query(Selection(kind, at=10**6), "flamegraph", group_by=("labels.a",))).rows.where("labels_only")
    assert sorted(r["cumulative"] for r in tree.collect()) == [1, 2]
    both = run(df, Query(Diff(Selection(kind, at=10**6), Selection(kind, 0, 10**7), absolute=True), "profile")).rows
    assert collect(both, "value", "diff") == [(0, -3), (3, 3), (4, 4)]


def test_merge_and_single(spark):
    df = samples(spark, [(["f"], 1, {"a": "x"}, 10**6), (["f"], 2, {"a": "y"}, 2 * 10**6), (["f"], 4, {}, 2 * 10**6)], period=10, duration=7)
    assert values(aggregate.merge(df, 0, 2 * 10**6)) == [70]
    assert values(aggregate.merge(df, 0, 2 * 10**6, group_by=("labels.a",))) == [10, 20, 40]
    assert values(aggregate.merge(df, 0, 2 * 10**6, group_by=("timestamp",))) == [10, 60]
    one = aggregate.single(df, 2 * 10**6, delta=True).first()
    assert (one["value"], one["duration"]) == (6, 14)
