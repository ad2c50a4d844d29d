"""Ingest, export, symbol lookup and streams on small inputs."""

import gzip
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import collect, line, loc, samples
from stackloom.operators import aggregate, symbolize as sym
from stackloom.plans.flamechart import OpenPath
from stackloom.schema import SAMPLES
from stackloom.sources import dictionary, labels, otlp, pprof, wire
from stackloom.sources.arrow import incomplete_stacktraces, ingest_arrow_v1, ingest_arrow_v2, missing_stacktraces
from stackloom.sources.executable import parse_executable_info
from stackloom.sources.samples import read_samples, write_samples
from stackloom.streaming.agents import agents, live_agents
from stackloom.streaming.ingest import EXPORT_REQUESTS, PROFILE_FILES, ingest, stream_files, stream_otlp, stream_samples
from stackloom.streaming.series import live_flamechart, rolling_merge, step_series

STRINGS = ["", "cpu", "nanoseconds", "samples", "count", "main", "work", "main.c", "/bin/app", "build1", "thread", "t-1", "ns", "pod"]
PROFILE = dict(
    strings=STRINGS, sample_types=[dict(type=3, unit=4), dict(type=1, unit=2)], period_type=dict(type=1, unit=2),
    period=100, time_nanos=1_700_000_000_123_456_789, duration_nanos=10**10,
    mappings=[dict(id=1, memory_start=0x1000, memory_limit=0x5000, file_offset=0, filename=8, build_id=9)],
    functions=[dict(id=1, name=5, system_name=5, filename=7, start_line=1), dict(id=2, name=6, system_name=6, filename=7, start_line=9)],
    locations=[dict(id=1, mapping_id=1, address=0x1100, lines=[dict(function_id=2, line=11), dict(function_id=1, line=3)]),
               dict(id=2, mapping_id=0, address=-16, lines=[])],
    samples=[dict(location_ids=[1, 2], values=[2, 200], labels=[dict(key=10, str=11), dict(key=13, str=11)]),
             dict(location_ids=[2], values=[0, 300], labels=[])])


def write_profile(folder, profile=PROFILE, name="p.pb.gz", zipped=True):
    os.makedirs(folder, exist_ok=True)
    body = wire.encode(profile, "profile")
    with open(os.path.join(folder, name), "wb") as f:
        f.write(gzip.compress(body) if zipped else body)
    return folder


def files(spark, folder, **more):
    pairs = [F.lit(x) for kv in {"__name__": "process_cpu", "pod": "a", **more}.items() for x in kv]
    return pprof.read_files(spark, folder).withColumn("labels", F.create_map(*pairs))


def test_wire_round_trip():
    out = wire.decode(memoryview(wire.encode(PROFILE, "profile")), "profile")
    assert out["strings"] == STRINGS and out["locations"][1]["address"] == -16
    assert [s["values"] for s in out["samples"]] == [[2, 200], [0, 300]]


@pytest.mark.parametrize("zipped", [True, False])
def test_ingest_pprof(spark, tmp_path, zipped):
    df = pprof.ingest_pprof(files(spark, write_profile(str(tmp_path), zipped=zipped)))
    rows = collect(df.withColumn("d", F.size("stacktrace")), "sample_type", "value", "d", "period_type", "time_nanos", "timestamp")
    t = PROFILE["time_nanos"]
    assert rows == sorted([("samples", 2, 2, "cpu", t, t // 10**6), ("cpu", 200, 2, "cpu", t, t // 10**6),
                           ("cpu", 300, 1, "cpu", t, t // 10**6)], key=repr)
    row = df.where("value = 200").first()
    assert row["labels"] == {"pod": "a", "thread": "t-1", "exported_pod": "t-1"}
    first, second = row["stacktrace"]
    assert [x["function_name"] for x in first["lines"]] == ["work", "main"] and first["mapping_file"] == "/bin/app"
    assert second["address"] == -16 and second["mapping_start"] is None and second["lines"] == []
    plain = pprof.ingest_pprof(files(spark, str(tmp_path)), include_sample_labels=False)
    assert plain.first()["labels"] == {"pod": "a"}


def broken(**change):
    return {**PROFILE, **change}


@pytest.mark.parametrize("change, error", [
    (dict(strings=["x"] + STRINGS[1:]), "first string is not empty"),
    (dict(mappings=[dict(PROFILE["mappings"][0], filename=99)]), "mappings filename out of range"),
    (dict(functions=[dict(PROFILE["functions"][0], id=7)]), "functions ids not sequential"),
    (dict(locations=[dict(id=1, mapping_id=5, address=1), PROFILE["locations"][1]]), "location mapping out of range"),
    (dict(samples=[dict(location_ids=[9], values=[1, 1])]), "sample location out of range"),
    (dict(samples=[dict(location_ids=[1], values=[1])]), "values do not match sample types"),
    (dict(samples=[dict(location_ids=[1], values=[1, 1], labels=[dict(str=5)])]), "label without valid key"),
    (dict(sample_types=[]), "missing sample types"),
])
def test_broken_profiles_are_reported_and_left_out(spark, tmp_path, change, error):
    write_profile(str(tmp_path), broken(**change), "bad.pb.gz")
    write_profile(str(tmp_path), PROFILE, "good.pb.gz")
    with open(tmp_path / "junk.pb.gz", "wb") as f:
        f.write(b"\x1f\x8bnot gzip")
    decoded = pprof.decode_files(files(spark, str(tmp_path)))
    found = {(r["path"].rsplit("/", 1)[1], r["error"]) for r in pprof.validate_files(decoded).collect()}
    assert ("bad.pb.gz", error) in found and not any(p == "good.pb.gz" for p, _ in found)
    assert any(p == "junk.pb.gz" for p, _ in found)
    assert pprof.ingest_pprof(files(spark, str(tmp_path))).count() == 3


def test_export_round_trip(spark, tmp_path):
    df = pprof.ingest_pprof(files(spark, write_profile(str(tmp_path / "in")))).where("sample_type = 'cpu'")
    profile = aggregate.merge(df, group_by=("labels.thread",))
    meta = dict(sample_type="cpu", sample_unit="nanoseconds", period_type="cpu", period_unit="nanoseconds", period=100,
                time_nanos=5, duration=7)
    chunks = pprof.to_pprof(profile, meta).orderBy("section", "part").collect()
    os.makedirs(tmp_path / "out")
    with open(tmp_path / "out" / "p.pb.gz", "wb") as f:
        f.writelines(bytes(c["bytes"]) for c in chunks)
    raw = wire.decode(memoryview(gzip.decompress(open(tmp_path / "out" / "p.pb.gz", "rb").read())), "profile")
    assert raw["strings"][0] == "" and raw["time_nanos"] == 5 and raw["period"] == 100
    assert raw["strings"][raw["sample_types"][0]["type"]] == "cpu"
    back = pprof.ingest_pprof(files(spark, str(tmp_path / "out")))
    text = lambda d: collect(d.select("value", F.to_json("stacktrace").alias("s"),
                                      F.coalesce(F.try_element_at("labels", F.lit("thread")), F.lit("")).alias("t")), "value", "s", "t")
    assert text(back) == text(profile)


def test_export_of_a_diff_merges_equal_samples(spark):
    from stackloom.operators.diff import diff

    base, compare = samples(spark, [(["f"], 1)]), samples(spark, [(["f"], 2), ([], 9)])
    out = pprof.Export(diff(base, compare, True), is_diff=True).samples().collect()
    assert [(r["value"], r["location_ids"]) for r in out] == [(1, [1])]


def test_export_merges_loads_of_the_same_binary(spark):
    a = loc(0x1010, line("f"), start=0x1000, limit=0x2ff0)
    b = loc(0x7010, line("f"), start=0x7000, limit=0x8ff1)
    export = pprof.Export(samples(spark, [([a], 1), ([b], 2)]))
    assert export.mappings.count() == 1 and export.locations().count() == 1
    assert [r["value"] for r in export.samples().collect()] == [3]


def test_dictionary_counts_and_labels(spark):
    one = lambda schema, *rows: spark.createDataFrame(list(rows), "profile_id bigint, " + schema)
    errors = dictionary.validate_profiles(
        one("location_ids array<bigint>, values array<bigint>", (1, [1, 0], [1]), (1, [2], [1, 2])),
        one("id bigint, mapping_id bigint, address bigint, lines array<struct<function_id:bigint,line:bigint,column:bigint>>",
            (1, 1, 0, 0, []), (1, 1, 0, 0, [])),
        one("id bigint, name bigint, system_name bigint, filename bigint, start_line bigint"),
        one("id bigint, memory_start bigint, memory_limit bigint, file_offset bigint, filename bigint, build_id bigint"),
        one("idx bigint, text string", (1, 0, "oops")), one("n int", (1, 2)), one("key bigint, str bigint", (1, 0, 5)))
    assert {r["error"] for r in errors.collect()} == {
        "first string is not empty", "location id is zero", "sample location out of range", "location id repeated",
        "values do not match sample types", "label without key", "label str out of range"}


def test_label_rules(spark):
    df = spark.createDataFrame([([("a.b", "1"), ("a.b", "2"), ("pod", "x"), ("exported_pod", "y"), ("no", "")],)],
                               "l array<struct<name:string,value:string>>")
    out = df.select(labels.exported_labels(F.create_map(F.lit("pod"), F.lit("z")), F.col("l")).alias("m")).first()["m"]
    assert out == {"a_b": "1", "exported_pod": "y", "exported_exported_pod": "x"}
    nums = spark.createDataFrame([([("b", 0), ("b", 7), ("b", 8)],)], "l array<struct<name:string,num:bigint>>")
    assert nums.select(labels.numeric_labels(F.col("l")).alias("m")).first()["m"] == {"b": 7}
    bad = samples(spark, [(["f"], 1)]).withColumn("name", F.lit("a b"))
    assert labels.check_profile_types(bad).count() == 1 and labels.check_profile_types(samples(spark, [(["f"], 1)])).count() == 0


def test_executable_info(spark):
    df = spark.createDataFrame([("executableInfo=0x3;0x1000;401000",), ("executableInfo=2",), ("other",), ("executableInfo=zz",),
                                ("executableInfo=3;ffffffffffffffff;0",)], "comment string")
    assert collect(parse_executable_info(df), "elf_type", "load_offset", "load_vaddr") == sorted(
        [(3, 0x1000, 0x401000), (2, None, None), (3, -1, 0)], key=repr)


def request(spark, **change):
    d = dict(
        string_table=["", "cpu", "ns", "main", "main.c", "/bin/app", otlp.BUILD_ID_ATTRIBUTE, "thread", "host.name"],
        attribute_table=[(0, 0, None), (6, 0, "b1"), (7, 0, " t1 ")],
        mapping_table=[(0, 0, 0, 0, []), (4096, 8192, 0, 5, [1])], function_table=[(0, 0, 0, 0), (3, 3, 4, 1)],
        location_table=[(0, 0, [], []), (1, 4100, [(1, 7, 2)], []), (0, 99, [], [])],
        stack_table=[([],), ([2, 1],)], link_table=[(None, None)])
    d.update(change.pop("dictionary", {}))
    sample = dict(stack_index=1, values=[5, 0], timestamps=[], link_index=0, attribute_indices=[2])
    timed = dict(stack_index=1, values=[], timestamps=[1_000_000, 2_000_000], link_index=0, attribute_indices=[])
    profile = dict(sample_type=(1, 2), period_type=(1, 2), period=10, time_nanos=1_000_000, duration_nanos=5_000_000,
                   profile_id=None, attribute_indices=[], samples=change.pop("samples", [sample, timed]))
    profile.update(change.pop("profile", {}))
    body = dict(request_id="r", dictionary=d, resource_profiles=[dict(
        attributes=change.pop("resource", [("host.name", "h"), ("thread", "  ")]),
        scope_profiles=[dict(scope_name=change.pop("scope", "my-scope"), attributes=[("lib", "x")], profiles=[profile])])])
    return spark.createDataFrame([body], otlp.SCHEMA)


def test_ingest_otlp(spark):
    df = otlp.ingest_otlp(request(spark))
    assert collect(df, "name", "value", "time_nanos", "timestamp") == [
        ("my_scope", 1, 1_000_000, 1), ("my_scope", 1, 2_000_000, 2), ("my_scope", 5, 1_000_000, 1)]
    row = df.where("value = 5").first()
    assert row["labels"] == {"thread": "t1", "lib": "x", "host_name": "h"}
    outer, inner = row["stacktrace"]
    assert outer["address"] == 99 and outer["mapping_start"] is None
    assert inner["mapping_build_id"] == "b1" and inner["lines"][0]["function_name"] == "main"
    assert otlp.ingest_otlp(request(spark, scope="")).first()["name"] == "unknown"
    assert otlp.ingest_otlp(request(spark, resource=[("thread", "outer")])).where("value = 5").first()["labels"]["thread"] == "outer"


@pytest.mark.parametrize("change, error", [
    (dict(dictionary=dict(string_table=["x"])), "first string is not empty"),
    (dict(dictionary=dict(link_table=[])), "link table is empty"),
    (dict(dictionary=dict(mapping_table=[(1, 0, 0, 0, [])])), "first mapping entry is not empty"),
    (dict(dictionary=dict(stack_table=[([],), ([77],)])), "stack location index out of bounds"),
    (dict(dictionary=dict(link_table=[(None, None), (b"1", b"2")])), "link id has wrong length"),
    (dict(samples=[]), "samples are empty"),
    (dict(samples=[dict(stack_index=9, values=[1], timestamps=[], link_index=0, attribute_indices=[])]), "sample stack out of bounds"),
    (dict(samples=[dict(stack_index=1, values=[], timestamps=[], link_index=0, attribute_indices=[])]), "sample without values and timestamps"),
    (dict(samples=[dict(stack_index=1, values=[1, 2], timestamps=[1_000_000], link_index=0, attribute_indices=[])]), "values do not match timestamps"),
    (dict(samples=[dict(stack_index=1, values=[1], timestamps=[1], link_index=0, attribute_indices=[])]), "sample timestamp out of bounds"),
    (dict(profile=dict(period=-1)), "period is negative"),
    (dict(profile=dict(profile_id=bytes(16))), "profile id is all zeros"),
    (dict(resource=[("a", "1"), ("a", "2")]), "resource attribute key is repeated"),
])
def test_otlp_validation(spark, change, error):
    df = request(spark, **change)
    assert error in {r["error"] for r in otlp.validate_otlp(df).collect()}
    assert otlp.ingest_otlp(df).count() == 0


def test_valid_request_has_no_errors(spark):
    assert otlp.validate_otlp(request(spark)).count() == 0


def test_arrow_layouts(spark):
    stack = [loc(1, line("f"))]
    located = spark.createDataFrame([("s1", True, stack), ("s2", False, stack)],
                                    f"stacktrace_id string, is_complete boolean, locations {SAMPLES['stacktrace'].dataType.simpleString()}")
    v1 = spark.createDataFrame([("p", "a", "b", "c", "d", 1, 0, 1_500_000, 3, "s1", "x", None), ("p", "a", "b", "c", "d", 1, 0, 1, 3, "s9", "x", None)],
                               "producer string, sample_type string, sample_unit string, period_type string, period_unit string, period bigint,"
                               "duration bigint, timestamp bigint, value bigint, stacktrace_id string, `labels.k` string, `labels.n` string")
    row = ingest_arrow_v1(v1, located).collect()
    assert len(row) == 1 and row[0]["labels"] == {"k": "x"} and row[0]["timestamp"] == 1
    assert [r[0] for r in missing_stacktraces(v1, located).collect()] == ["s9"]
    assert incomplete_stacktraces(located).first()[0] == 1
    v2 = samples(spark, [(stack, 3)]).withColumnRenamed("name", "producer").drop("labels").withColumn(
        "labels", F.expr("named_struct('k', 'x', 'n', cast(null as string))")).withColumn(
        "timestamp", F.expr("timestamp_micros(1700000000123456)"))
    row = ingest_arrow_v2(v2).first()
    assert row["labels"] == {"k": "x"} and row["time_nanos"] == 1700000000123456000 and row["timestamp"] == 1700000000123


def test_symbols(spark):
    table = spark.createDataFrame([
        ("b", 100, 50, "_f", "GLOBAL", "FUNC", True), ("b", 100, 50, "f", "WEAK", "FUNC", True), ("b", 100, 0, "zz", "GLOBAL", "FUNC", True),
        ("b", 200, 10, "g", "GLOBAL", "FUNC", True), ("b", 205, 0, "none", "GLOBAL", "OBJECT", True),
        ("b", 1 << 20, 1 << 20, "big", "LOCAL", "FUNC", True), ("b", -4096, 100, "kernel", "GLOBAL", "FUNC", True)],
        "build_id string, value bigint, size bigint, name string, bind string, type string, defined boolean")
    wanted = [99, 100, 149, 150, 200, 209, 210, 1 << 20, (1 << 20) + 300_000, (2 << 20) - 1, 2 << 20, -4000, -3996]
    found = sym.asof_symbols(spark.createDataFrame([("b", a) for a in wanted] + [("other", 100)], "build_id string, address bigint"), table)
    got = {(r["build_id"], r["address"]): r["symbol"] for r in found.collect()}
    names = [None, "_f", "_f", None, "g", "g", None, "big", "big", "big", None, "kernel", None]
    assert got == {**{("b", a): n for a, n in zip(wanted, names)}, ("other", 100): None}


def test_symbolize_keeps_unknown_addresses(spark):
    p = samples(spark, [([loc(100, build_id="b"), loc(7, build_id="b"), loc(5, line("known"))], 1), ([], 2)])
    resolved = spark.createDataFrame([("b", 100, [line("f")])], f"build_id string, address bigint, lines {SAMPLES['stacktrace'].dataType.elementType['lines'].dataType.simpleString()}")
    out = sym.symbolize(p, resolved).where("value = 1").first()["stacktrace"]
    assert [[x["function_name"] for x in l["lines"]] for l in out] == [["f"], [], ["known"]]
    assert sym.symbolize(p, resolved).count() == 2


def test_samples_table_prunes_days(spark, tmp_path):
    day = 86_400 * 10**9
    df = samples(spark, [(["f"], i, {"k": str(i % 2)}, i * day // 2) for i in range(1, 9)])
    write_samples(df, str(tmp_path / "t"), promote=["k"])
    back = read_samples(spark, str(tmp_path / "t"), start=day, end=2 * day, promoted=["k"])
    assert sorted(r["value"] for r in back.collect()) == [2, 3, 4]
    plan = back.where("label_k = '0'")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(day" in plan and "EqualTo(label_k,0)" in plan


def test_streams(spark, tmp_path):
    s = 10**9
    src = str(tmp_path / "in")
    samples(spark, [(["f"], 1, {"k": "a"}, s), (["f"], 2, {"k": "a"}, 2 * s), (["g"], 4, {}, 70 * s)], period=10).write.parquet(src)
    ingest(stream_samples(spark, src), str(tmp_path / "t"), str(tmp_path / "c1")).awaitTermination()
    assert read_samples(spark, str(tmp_path / "t")).count() == 3

    def result(df, mode, name):
        df.writeStream.outputMode(mode).format("memory").queryName(name).option(
            "checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    rows = result(step_series(stream_samples(spark, src), "1 minute", ["k"]), "complete", "series")
    assert sorted((r["value"], r["count"], r["k"]) for r in rows) == [(30, 2, "a"), (40, 1, None)]
    rows = result(rolling_merge(stream_samples(spark, src), "1 minute"), "complete", "merged")
    assert sorted(r["value"] for r in rows) == [30, 40]
    rows = result(live_flamechart(stream_samples(spark, src), lateness="0 seconds"), "append", "chart")
    assert sorted((r["time_nanos"], list(r["starts"])) for r in rows) == [(s, [s]), (2 * s, [2 * s]), (70 * s, [70 * s])]
    late = str(tmp_path / "late")
    for times in ([100 * s], [99 * s, 101 * s], [10_000 * s]):
        samples(spark, [(["f"], 1, {}, t) for t in times], period=10).coalesce(1).write.mode("append").parquet(late)
    rows = result(live_flamechart(stream_samples(spark, late, files_per_trigger=1)), "append", "late_chart")
    assert sorted(r["time_nanos"] for r in rows) == [99 * s, 100 * s, 101 * s]  # the watermark hasn't passed the last one
    write_profile(str(tmp_path / "pprof"))
    ingest(stream_files(spark, str(tmp_path / "pprof"), {"__name__": "cpu"}), str(tmp_path / "t2"), str(tmp_path / "c2"),
           kind=PROFILE_FILES).awaitTermination()
    assert read_samples(spark, str(tmp_path / "t2")).count() == 3


def test_agents(spark, tmp_path):
    s = 10**9
    schema = "node string, address string, time_nanos bigint, push_nanos bigint, error string"
    rows = [("n1", "1.1", 1 * s, 5, None), ("n1", "1.1", 400 * s, 6, "boom"), (None, "2.2", 390 * s, 7, None), ("n3", "3.3", 2 * s, 1, None)]
    df = spark.createDataFrame(rows, schema)
    assert collect(agents(df), "id", "last_push", "push_duration", "last_error") == [
        ("2.2", 390 * s, 7, ""), ("n1", 400 * s, 6, "boom")]
    df.withColumn("ts", F.timestamp_micros((F.col("time_nanos") / 1000).cast("long"))).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema + ", ts timestamp").parquet(str(tmp_path / "in"))
    updates = []

    def follow():
        live_agents(stream).writeStream.outputMode("update").foreachBatch(lambda b, _: updates.extend(b.collect())).option(
            "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    follow()
    got = {r["id"]: r["last_push"] for r in updates if not r["expired"]}
    assert got == {"n11.1": 400 * s, "2.2": 390 * s, "n33.3": 2 * s}
    # n1 pushes again before its time is up, the others don't; all are silent after 800 s but the last
    for more in ([("n1", "1.1", 600 * s, 1, None), ("n1", "1.1", 600 * s, 9, "x")], [("n9", "9.9", 5000 * s, 1, None)], [("n9", "9.9", 5001 * s, 1, None)]):
        spark.createDataFrame(more, schema).withColumn("ts", F.timestamp_micros((F.col("time_nanos") / 1000).cast("long"))).write.mode(
            "append").parquet(str(tmp_path / "in"))
        follow()
    assert {(r["id"], r["last_push"], r["push_duration"], r["last_error"]) for r in updates if r["expired"]} == {
        ("n11.1", 600 * s, 9, "x"), ("2.2", 390 * s, 7, ""), ("n33.3", 2 * s, 1, "")}


def test_ingest_keeps_rejects_and_repeats_no_batch(spark, tmp_path):
    """Broken files and unusable types are told; a batch that is cut off and repeated leaves no row twice and loses none."""
    src, table, rejected = (str(tmp_path / x) for x in ("in", "t", "t_rejected"))
    write_profile(src, PROFILE, "good.pb.gz")
    write_profile(src, broken(samples=[dict(location_ids=[9], values=[1])]), "bad.pb.gz")
    write_profile(src, broken(strings=STRINGS[:1] + ["c p u"] + STRINGS[2:]), "type.pb.gz")
    with open(tmp_path / "in" / "junk.pb.gz", "wb") as f:
        f.write(b"\x1f\x8bnot gzip")

    def start(checkpoint="c"):
        ingest(stream_files(spark, src, {"__name__": "process_cpu"}), table, str(tmp_path / checkpoint), kind=PROFILE_FILES,
               promote=["thread"]).awaitTermination()

    def found():
        rows = collect(read_samples(spark, table, promoted=["thread"]), "sample_type", "value", "label_thread")
        bad = spark.read.parquet(rejected)
        return rows, sorted(((r["source"] or "").rsplit("/", 1)[-1], r["reason"].split(":")[0], r["sample"] is not None) for r in bad.collect())

    start()
    rows, bad = found()
    assert rows == sorted([("samples", 2, "t-1"), ("cpu", 200, "t-1"), ("cpu", 300, None)], key=repr)
    assert ("bad.pb.gz", "sample location out of range", False) in bad and ("bad.pb.gz", "values do not match sample types", False) in bad
    assert sum(b[0] == "junk.pb.gz" for b in bad) == 1 and sum(b == ("", "invalid profile type process_cpu", True) for b in bad) == 3
    start()  # nothing new
    assert found() == (rows, bad)
    # the batch is committed by no one: its log is gone, as if the driver had died after the writes
    for f in os.listdir(tmp_path / "c" / "commits"):
        os.remove(tmp_path / "c" / "commits" / f)
    start()
    assert found() == (rows, bad)
    write_profile(src, broken(time_nanos=PROFILE["time_nanos"] + 86_400 * 10**9), "later.pb.gz")
    start()
    assert len(found()[0]) == 6 and found()[1] == bad
    unnamed = pprof.decode_files(files(spark, src, **{"__name__": ""}))
    assert {r["error"] for r in pprof.rejected_files(unnamed).where("path LIKE '%good%'").collect()} == {"missing name"}


def test_ingest_of_requests(spark, tmp_path):
    request(spark).write.parquet(str(tmp_path / "in"))
    request(spark, samples=[]).write.mode("append").parquet(str(tmp_path / "in"))
    ingest(stream_otlp(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c"), kind=EXPORT_REQUESTS).awaitTermination()
    assert read_samples(spark, str(tmp_path / "t")).count() == 3
    assert [(r["source"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "t_rejected")).collect()] == [("r", "samples are empty")]


def test_samples_leave_their_file_finished(spark, tmp_path):
    """Above the step that multiplies rows, no plan node mentions a file's tables."""
    for df in (pprof.ingest_pprof(files(spark, write_profile(str(tmp_path)))), otlp.ingest_otlp(request(spark))):
        above, below = df._jdf.queryExecution().optimizedPlan().toString().split("Generate inline", 1)
        assert not any(x in above for x in ("dictionary", "strings", "string_table", "stacks"))
        assert below.split("\n", 1)[0].count("Generate") == 0


def test_live_chart_equals_the_batch_chart(spark, tmp_path):
    """Shuffled arrivals within the lateness, in several batches and restarts, give the rows of a fold in time order."""
    import random

    rng, s = random.Random(7), 10**9
    times = sorted(rng.sample(range(1, 400), 120))
    rows = [([rng.choice("ab"), rng.choice("xy"), "main"], 3 * s, {"k": str(t % 2)}, t * s) for t in times]
    arrivals = sorted(range(120), key=lambda i: times[i] + rng.uniform(0, 30))
    src = str(tmp_path / "in")
    got = []
    for part in (arrivals[:40], arrivals[40:80], arrivals[80:], None):
        batch = [rows[j] for j in part] if part else [(["main"], s, {"k": k}, 10_000 * s) for k in "01"]
        samples(spark, batch, period=10 * s).coalesce(1).write.mode("append").parquet(src)
        live_flamechart(stream_samples(spark, src, files_per_trigger=1), ("labels.k",), lateness="1 minute", idle="1 hour").writeStream.outputMode(
            "append").foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(
            availableNow=True).start().awaitTermination()
    want = []
    for k in "01":
        path = OpenPath()
        want += [(f"k={k}", t, path.add(list(reversed(stack)), t, v, 10 * s)) for stack, v, labels, t in rows if labels["k"] == k]
    assert sorted((r["series"], r["time_nanos"], list(r["starts"])) for r in got) == sorted(want)


def test_promoted_labels_prune_row_groups(spark, tmp_path):
    """A matcher on a stored label reaches the files and skips row groups."""
    from stackloom.operators.select import ProfileType
    from stackloom.plans.query import Query, Selection, run

    rows = spark.range(20_000).selectExpr("id", "array(concat('f', id % 3)) AS f")
    line = "named_struct('line', 1L, 'column', 0L, 'function_name', x, 'function_system_name', x, 'function_filename', uuid(), 'function_start_line', 1L)"
    stack = f"""transform(f, x -> named_struct('address', id, 'mapping_start', 0L, 'mapping_limit', 9L, 'mapping_offset', 0L, 'mapping_file', 'a',
      'mapping_build_id', 'b', 'lines', array({line})))"""
    df = rows.selectExpr("'cpu' AS name", "'samples' AS sample_type", "'count' AS sample_unit", "'cpu' AS period_type", "'nanoseconds' AS period_unit",
                         "1L AS period", "0L AS duration", "id AS timestamp", "id * 1000000 AS time_nanos", "1L AS value",
                         "map('pod', concat('pod-', id div 100)) AS labels", f"{stack} AS stacktrace").to(SAMPLES)
    spark.conf.set("parquet.block.size", 1 << 16)
    spark.sparkContext._jsc.hadoopConfiguration().setInt("parquet.block.size", 1 << 16)
    try:
        write_samples(df, str(tmp_path / "t"), promote=["pod"], partitions=1)
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
        spark.conf.unset("parquet.block.size")
    table = read_samples(spark, str(tmp_path / "t"), promoted=["pod"])
    query = Query(Selection(ProfileType("cpu", "samples", "count", "cpu", "nanoseconds"), matchers=(("pod", "=", "pod-7"),)), "profile")
    out = run(table, query).rows
    plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(label_pod,pod-7)" in plan
    chosen = table.where("label_pod = 'pod-7'")
    assert chosen.count() == 100 and out.agg(F.sum("value")).first()[0] == 100
    execution = chosen._jdf.queryExecution().executedPlan()
    execution.executeCollect()
    assert execution.collectLeaves().head().metrics().get("numOutputRows").get().value() < 5000
    for m, n in ((("pod", "!=", "pod-7"), 19_900), (("pod", "=~", "^pod-1.$"), 1000), (("pod", "=", ""), 0), (("pod", "!~", "pod"), 0)):
        q = Query(Selection(query.source.profile_type, matchers=(m,)), "profile")
        plain = run(table.drop("label_pod"), q).rows.agg(F.sum("value")).first()[0]
        assert run(table, q).rows.agg(F.sum("value")).first()[0] == plain == (n or None)


def test_lookup_spreads_heavy_keys(spark):
    """90 % of the rows on one key, and as many on null: no task has twice the mean, rows stay the same."""
    from stackloom.operators.lookup import lookup

    small = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 7).alias("v"))
    tasks, threshold = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for hot in ("7", "cast(null AS bigint)"):
            rows = spark.range(100_000).selectExpr(f"if(id % 10 < 9, {hot}, id % 300) AS k", "id")
            for how in ("left", "inner"):
                out = lookup(rows, small, ["k"], ["id"], how)
                want = rows.join(small, "k", how)
                assert sorted(out.groupBy("k", "v").count().collect(), key=str) == sorted(want.groupBy("k", "v").count().collect(), key=str)
            sizes = [r["count"] for r in lookup(rows, small, ["k"], ["id"]).groupBy(F.spark_partition_id()).count().collect()]
            assert max(sizes) < 2 * 100_000 / 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_exploded_dictionaries_are_not_broadcast(spark):
    """A string table of three profiles is three times as many rows as its file; Spark's estimate counts the file."""
    from stackloom.catalog import all_queries

    part = "/root/testdata/sf0.001"
    for name, small in (("resolve_stacks", 0), ("validate_refs", 3)):  # the three counts per profile
        plan = all_queries()[name](spark, part)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == small
        assert "SortMergeJoin" in plan


def test_messages_together_are_those_one_by_one():
    wide = dict(PROFILE, period=2**63 - 1, duration_nanos=-1, strings=["", "é漢" * 300], comments=[0, 128, -2**63], period_type=None)
    rows = [PROFILE, {}, wide, PROFILE]
    column = pa.array([wire.decode(memoryview(wire.encode(r, "profile")), "profile") for r in rows], wire.arrow_type("profile"))
    each = [wire.encode(r, "profile") for r in rows]
    data, size = wire.encode_column(column, "profile")
    assert data.tobytes() == b"".join(each) and size.tolist() == [len(x) for x in each]
    assert wire.encode_column(column.slice(2), "profile")[0].tobytes() == b"".join(each[2:])
    assert wire.decode_column(each, "profile").equals(column)
    # numbers that repeat come packed, one by one, or both
    sample = b"\x08\x07\x0a\x02\x08\x09\x10\x03\x08\x81\x01"
    mixed = b"\x12" + bytes([len(sample)]) + sample + b"\x70\x05"
    assert wire.decode_column([mixed], "profile").to_pylist() == [wire.decode(memoryview(mixed), "profile")]
    assert wire.decode_column([mixed], "profile")[0].as_py()["samples"][0]["location_ids"] == [7, 8, 9, 129]


def test_broken_files_among_good_ones():
    """Each file has the profile or the error that it has alone."""
    good = wire.encode(PROFILE, "profile")
    for bad in (good[:-1], good + b"\x0a", b"\x0a\xff", b"\x0b", good + b"\x32\x02\xff\xfe", good + b"\x49" + bytes(8), b"\x12\x02\x0a\x05"):
        try:
            want, error = wire.decode(memoryview(bad), "profile"), None
        except Exception as e:
            want, error = None, f"{type(e).__name__}: {e}"
        made, errors = pprof._profiles([good, bad, b"", good])
        alone = wire.decode(memoryview(good), "profile")
        assert made.to_pylist() == [alone, want, wire.decode(memoryview(b""), "profile"), alone] and errors == [None, error, None, None]


def test_stacks_of_files_are_not_made_again_for_each_row(spark, tmp_path):
    plan = pprof.ingest_pprof(files(spark, write_profile(str(tmp_path))))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan[: plan.index("Generate")]


@pytest.mark.parametrize("most", [0, 3, 64])
def test_few_and_many_label_lists(spark, tmp_path, monkeypatch, most):
    """Labels are the same whether lists are looked up or not."""
    monkeypatch.setattr(labels, "MOST_SETS", most)
    many = [dict(location_ids=[2], values=[1, 0], labels=[dict(key=10, str=i % 10)] if i % 11 else []) for i in range(40)]
    df = pprof.ingest_pprof(files(spark, write_profile(str(tmp_path), dict(PROFILE, samples=many))))
    got = sorted(sorted(r["labels"].items()) for r in df.select("labels").collect())
    assert got == sorted(sorted({"pod": "a", **({"thread": STRINGS[i % 10]} if i % 11 and i % 10 else {})}.items()) for i in range(40))


def test_otlp_stacks_are_not_made_again_for_each_row(spark):
    """Samples leave the row of their request finished: nothing above it goes through their stacks or labels."""
    plan = otlp.ingest_otlp(request(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan[: plan.index("Generate")]


def test_otlp_tables_are_resolved_once(spark):
    """Attributes are cleaned, and locations put together, in the tables of a request and not per sample."""
    plan = otlp.ingest_otlp(request(spark))._jdf.queryExecution().optimizedPlan().toString()
    inner = [x for x in plan.splitlines() if "Generate inline" in x][-1]
    assert "function_filename" not in inner.split("named_struct(name")[-1] and inner.count("regexp_replace") < 6


def dictionary_tables(spark, profile="long"):
    """Two profiles with the same ids; location 3 is there twice, its second line unknown, and function 9 is unknown."""
    rows = lambda data, schema: spark.createDataFrame(data, f"profile_id long, {schema}").withColumn("profile_id", F.col("profile_id").cast(profile))
    ids = [(p, i) for p in (1, 2) for i in range(1, 6)]
    locations = [(p, i, i % 3, 100 * p + i, [(1 + i % 2, i, 0)] * (i % 3)) for p, i in ids] + [(2, 3, 1, 5, [(9, 7, 0)])]
    return dict(
        locations=rows(locations, "id long, mapping_id long, address long, lines array<struct<function_id:long,line:long,column:long>>"),
        functions=rows([(p, i, i, 0, 3, p) for p in (1, 2) for i in (1, 2)], "id long, name long, system_name long, filename long, start_line long"),
        mappings=rows([(p, 1, 0, 9, 0, 3, 77) for p in (1, 2)], "id long, memory_start long, memory_limit long, file_offset long, filename long, build_id long"),
        strings=rows([(p, i, f"{t}{p}" if t else "") for p in (1, 2) for i, t in enumerate(["", "f", "g;h", "c.go"])], "idx long, text string"))


@pytest.mark.parametrize("bucket, profile", [(1 << 21, "long"), (3, "string")])
def test_stacks_are_those_of_their_locations(spark, monkeypatch, bucket, profile):
    """Unknown, absent, repeated and null ids, lists without ids, a common leaf, samples that are equal; few rows at once."""
    monkeypatch.setattr(dictionary, "BUCKET", bucket)
    tables = dictionary_tables(spark, profile)
    lists = [[1, 2, 5], [], None, [77, 1], [None, 2, 0], [3, 1], [5]] + [[4, i % 5 + 1] for i in range(60)]
    rows = [(p, x, n % 4, {"k": str(n)}) for p in (1, 2, None) for n, x in enumerate(lists)] * 2
    given = spark.createDataFrame(rows, "profile_id long, location_ids array<long>, `v.x` long, m map<string,string>").withColumn(
        "profile_id", F.col("profile_id").cast(profile))
    of = str if profile == "string" else int
    places = {}
    for r in dictionary.resolve_locations(**tables).collect():
        places.setdefault((r[0], r[1]), []).append(r[2])
    assert len(places) == 10 and {x.mapping_file for v in places.values() for x in v} == {None, "c.go1", "c.go2"}
    assert [[y.function_name for y in x.lines] for x in places[of(2), 3]] == [[None], [None]]
    assert [y.function_name for y in places[of(1), 2][0].lines] == ["f1", "f1"]

    def stack(p, ids):  # a location that is there twice is shown twice, the lesser first
        return [] if p is None else [y for i in ids or [] for y in sorted(
            places.get((of(p), i), [None]), key=lambda x: x and x.address)]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = dictionary.resolve_stacks(given, **tables)
        assert out.columns == ["profile_id", "v.x", "m", "stacktrace"]
        got = [tuple(r) for r in out.collect()]
        assert sorted(got, key=repr) == sorted([(p and of(p), v, m, stack(p, ids)) for p, ids, v, m in rows], key=repr)
        shown = dictionary.resolve_stacks(given, **tables, frame=lambda x: F.coalesce(x["address"], F.lit(-1).cast("long")))
        got = [(r[0], r[1], r[2], r[3]) for r in shown.collect()]
        assert sorted(got, key=repr) == sorted([(p and of(p), v, m, [-1 if x is None else x.address for x in stack(p, ids)])
                                                for p, ids, v, m in rows], key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_stacks_are_returned_few_at_once(monkeypatch):
    monkeypatch.setattr(dictionary, "TOGETHER", 4)
    schema = pa.schema([("kind", pa.int64()), ("profile_id", pa.int64()), ("id", pa.int64()), ("frame", pa.string()),
                        ("ids", pa.list_(pa.int64())), ("sample", pa.struct([("profile_id", pa.int64())]))])
    rows = [dict(kind=0, profile_id=1, id=i, frame=f"a{i}") for i in (2, 1)]
    rows += [dict(kind=1, ids=x, sample=dict(profile_id=1)) for x in ([1, 2], [1], [2] * 6, [], [2], [1, 1, 2])]
    rows += [dict(kind=3, ids=[], sample=dict(profile_id=7)), dict(kind=4, profile_id=3, id=1, frame="b1"),
             dict(kind=5, ids=[1], sample=dict(profile_id=3))]
    out = list(dictionary._fill(iter(pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=5))))
    assert [x for b in out for x in b["stacktrace"].to_pylist()] == [
        ["a1", "a2"], ["a1"], ["a2"] * 6, [], ["a2"], ["a1", "a1", "a2"], [], ["b1"]]
    assert max(sum(map(len, b["stacktrace"].to_pylist())) for b in out if b.num_rows > 1) <= 4
    for row in (dict(kind=1, ids=[3], sample=dict(profile_id=1)), dict(kind=1, ids=[0], sample=dict(profile_id=1)),
                dict(kind=1, ids=[None], sample=dict(profile_id=1)), dict(kind=1, ids=[1], sample=dict(profile_id=2))):
        with pytest.raises(RuntimeError):
            list(dictionary._fill(iter(pa.Table.from_pylist([*rows[:2], row], schema).to_batches())))


def test_frames_and_ids_are_not_shuffled_per_use(spark):
    """A bucket of stacks gets a location once; the strings are shuffled once for functions and mappings."""
    from stackloom.catalog import all_queries

    df = all_queries()["resolve_stacks"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("MapInArrow", 1)
    assert "Join" not in above and "Join" in below
    for join in below.split("Join ")[1:]:
        assert "location_ids" not in join.splitlines()[0]
    assert "posexplode(location_ids" not in plan
