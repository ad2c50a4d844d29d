"""OpenTelemetry profile exports, held as one nested row per export request.

The request carries its own lookup tables, so indexes are resolved inside the
row by array lookups; only the explodes multiply rows and nothing is shuffled.
"""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from stackloom.functions.scalar import int_div, record
from stackloom.schema import SAMPLES
from stackloom.sources.labels import last_wins, let, sanitized

ATTRIBUTES = "array<struct<key:string,value:string>>"
SCHEMA = f"""
  request_id string,
  dictionary struct<
    string_table: array<string>,
    attribute_table: array<struct<key_strindex:bigint,unit_strindex:bigint,value:string>>,
    mapping_table: array<struct<memory_start:bigint,memory_limit:bigint,file_offset:bigint,filename_strindex:bigint,
      attribute_indices:array<bigint>>>,
    function_table: array<struct<name_strindex:bigint,system_name_strindex:bigint,filename_strindex:bigint,start_line:bigint>>,
    location_table: array<struct<mapping_index:bigint,address:bigint,
      lines:array<struct<function_index:bigint,line:bigint,column:bigint>>,attribute_indices:array<bigint>>>,
    stack_table: array<struct<location_indices:array<bigint>>>,
    link_table: array<struct<trace_id:binary,span_id:binary>>>,
  resource_profiles array<struct<attributes:{ATTRIBUTES},
    scope_profiles:array<struct<scope_name:string,attributes:{ATTRIBUTES},
      profiles:array<struct<sample_type:struct<type_strindex:bigint,unit_strindex:bigint>,
        period_type:struct<type_strindex:bigint,unit_strindex:bigint>,period:bigint,time_nanos:bigint,
        duration_nanos:bigint,profile_id:binary,attribute_indices:array<bigint>,
        samples:array<struct<stack_index:bigint,values:array<bigint>,timestamps:array<bigint>,link_index:bigint,
          attribute_indices:array<bigint>>>>>>>>>
"""


def request_schema() -> StructType:
    return StructType.fromDDL(SCHEMA)


# Fixed value: attribute that holds a binary's build id.
BUILD_ID_ATTRIBUTE = "process.executable.build_id.gnu"


def _text(strings: Column, idx: Column) -> Column:
    return F.coalesce(F.get(strings, idx.cast("int")), F.lit(""))


def _at(table: Column, idx: Column) -> Column:
    return F.get(table, idx.cast("int"))


def resolve_otlp_locations(dictionary: str = "dictionary", function_base: int = 0) -> Column:
    """The location table of a request with mappings, functions and strings filled in.

    Indexes count from 0 and entry 0 means none. ``function_base=1`` reads
    function indexes as counting from 1.
    """
    d = {t: F.col(f"{dictionary}.{t}_table") for t in ("string", "attribute", "mapping", "function", "location")}

    def line(x):
        f = _at(d["function"], x["function_index"] - function_base)
        known = x["function_index"] != 0
        return record(
            line=x["line"], column=x["column"],
            function_name=F.when(known, _text(d["string"], f["name_strindex"])),
            function_system_name=F.when(known, _text(d["string"], f["system_name_strindex"])),
            function_filename=F.when(known, _text(d["string"], f["filename_strindex"])),
            function_start_line=F.when(known, f["start_line"]))

    def build_id(m):
        attrs = F.transform(m["attribute_indices"], lambda i: _at(d["attribute"], i))
        mine = F.filter(attrs, lambda a: _text(d["string"], a["key_strindex"]) == BUILD_ID_ATTRIBUTE)
        return F.coalesce(F.get(mine, F.lit(0))["value"], F.lit(""))

    def location(x):
        m = _at(d["mapping"], x["mapping_index"])
        has = x["mapping_index"] != 0
        return record(
            address=x["address"], mapping_start=F.when(has, m["memory_start"]),
            mapping_limit=F.when(has, m["memory_limit"]), mapping_offset=F.when(has, m["file_offset"]),
            mapping_file=F.when(has, _text(d["string"], m["filename_strindex"])),
            mapping_build_id=F.when(has, build_id(m)), lines=F.transform(x["lines"], line))

    return F.transform(d["location"], location)


def _entries(attributes: Column) -> Column:
    """Attributes as label entries, in place; blank ones have no value."""
    return F.transform(attributes, lambda a: record(
        key=sanitized(a["key"]), value=F.nullif(F.trim(F.coalesce(a["value"], F.lit(""))), F.lit(""))))


def _named(entries: Column) -> Column:
    """Label entries as a map: blank ones skipped, the last of equal names wins."""
    empty = F.array().cast("array<struct<key:string,value:string>>")
    there = F.filter(F.coalesce(entries, empty), lambda e: e["value"].isNotNull())
    return F.map_from_entries(F.aggregate(there, empty, lambda acc, x: F.array_append(F.filter(acc, lambda y: y["key"] != x["key"]), x)))


def _labels(attributes: Column) -> Column:
    """Attributes as labels: blank values skipped, values trimmed, the last of equal names wins."""
    return _named(_entries(attributes))


def _table_entries() -> Column:
    """The attribute table of a request as label entries."""
    return _entries(F.transform("dictionary.attribute_table", lambda a: record(
        key=_text(F.col("dictionary.string_table"), a["key_strindex"]), value=a["value"])))


def explode_timestamps(timestamps: Column, values: Column, time_nanos: Column) -> Column:
    """Rows (time_nanos, value) of a sample: one per timestamp (value 1 if none given), else one per non-zero value."""
    row = lambda t, v: record(time_nanos=t, value=v)
    has_values = F.coalesce(F.size(values), F.lit(0)) > 0
    timed = F.transform(timestamps, lambda t, i: row(t, F.when(has_values, F.get(values, i)).otherwise(1).cast("long")))
    plain = F.transform(F.filter(values, lambda v: v != 0), lambda v: row(time_nanos, v))
    return F.when(F.coalesce(F.size(timestamps), F.lit(0)) > 0, timed).otherwise(plain)


def ingest_otlp(requests: DataFrame, function_base: int = 0) -> DataFrame:
    """Samples of valid requests.

    The producer is the sanitised scope name, or ``unknown``. Labels come from
    sample, profile, scope and resource; the outer one wins.

    The tables of a request are resolved once, in its row, and its samples are finished there: none of the tables is copied
    to them. A sample leaves the row once, with its stack and labels, and is then repeated for its times or values.
    """
    valid = requests.where(F.size(request_errors()) == 0)
    request = valid.select("dictionary", "resource_profiles", resolve_otlp_locations("dictionary", function_base).alias("locations"),
                           _table_entries().alias("attributes"))
    strings, stacks, locations = F.col("dictionary.string_table"), F.col("dictionary.stack_table"), F.col("locations")
    from_table = lambda indices: _named(F.transform(indices, lambda i: _at(F.col("attributes"), i)))
    unnamed = lambda name: F.when(name == "", "unknown").otherwise(name)
    resources = F.transform("resource_profiles", lambda r: record(labels=_labels(r["attributes"]), scopes=r["scope_profiles"]))
    scopes = F.flatten(F.transform(resources, lambda r: F.transform(r["scopes"], lambda s: record(
        name=unnamed(sanitized(F.coalesce(s["scope_name"], F.lit("")))), labels=last_wins(_labels(s["attributes"]), r["labels"]),
        profiles=s["profiles"]))))
    profiles = F.flatten(F.transform(scopes, lambda s: F.transform(s["profiles"], lambda p: record(
        name=s["name"], labels=last_wins(from_table(p["attribute_indices"]), s["labels"]), time_nanos=p["time_nanos"],
        kind=record(sample_type=_text(strings, p["sample_type"]["type_strindex"]), sample_unit=_text(strings, p["sample_type"]["unit_strindex"]),
                    period_type=_text(strings, p["period_type"]["type_strindex"]), period_unit=_text(strings, p["period_type"]["unit_strindex"]),
                    period=p["period"], duration=p["duration_nanos"]),
        samples=p["samples"]))))
    samples = F.flatten(F.transform(profiles, lambda p: F.transform(p["samples"], lambda x: record(
        name=p["name"], kind=p["kind"], labels=last_wins(from_table(x["attribute_indices"]), p["labels"]),
        stacktrace=F.transform(_at(stacks, x["stack_index"])["location_indices"], lambda i: _at(locations, i)),
        taken=explode_timestamps(x["timestamps"], x["values"], p["time_nanos"])))))
    rows = request.select(F.inline(samples)).select("name", "kind.*", "labels", "stacktrace", F.inline("taken"))
    # in the order of the schema; to() would make each stack anew
    return rows.withColumn("timestamp", int_div("time_nanos", 1_000_000)).select(*SAMPLES.names)


def request_errors() -> Column:
    """All violations of one request, as an array of messages."""
    c = F.col
    d = lambda t: c(f"dictionary.{t}_table")
    size = lambda t: F.coalesce(F.size(d(t)), F.lit(0))
    out = lambda idx, t: (idx < 0) | (idx >= size(t))
    bad = lambda t, test: F.coalesce(F.exists(d(t), test), F.lit(False))
    none = lambda x: F.coalesce(F.size(x), F.lit(0)) == 0
    first = {t: F.get(d(t), F.lit(0)) for t in ("mapping", "function", "attribute", "location", "link", "stack")}
    empty = {
        "mapping": (first["mapping"]["memory_start"] == 0) & (first["mapping"]["memory_limit"] == 0)
        & (first["mapping"]["file_offset"] == 0) & (first["mapping"]["filename_strindex"] == 0)
        & none(first["mapping"]["attribute_indices"]),
        "function": (first["function"]["name_strindex"] == 0) & (first["function"]["system_name_strindex"] == 0)
        & (first["function"]["filename_strindex"] == 0) & (first["function"]["start_line"] == 0),
        "attribute": first["attribute"]["value"].isNull(),
        "location": (first["location"]["mapping_index"] == 0) & (first["location"]["address"] == 0)
        & none(first["location"]["lines"]) & none(first["location"]["attribute_indices"]),
        "link": (F.coalesce(F.octet_length(first["link"]["trace_id"]), F.lit(0)) == 0)
        & (F.coalesce(F.octet_length(first["link"]["span_id"]), F.lit(0)) == 0),
        "stack": none(first["stack"]["location_indices"]),
    }
    attrs = lambda x: F.exists(F.coalesce(x["attribute_indices"], F.array()), lambda i: out(i, "attribute"))
    rest = lambda t, test: F.coalesce(F.exists(F.slice(d(t), 2, F.greatest(size(t) - 1, F.lit(0))), test), F.lit(False))
    checks = [(none(c("resource_profiles")), "resource profiles are empty"),
              (size("string") == 0, "string table is empty"),
              (F.get(d("string"), F.lit(0)) != "", "first string is not empty")]
    for t in empty:
        checks.append((size(t) == 0, f"{t} table is empty"))
        # a null first entry is as good as an empty one
        checks.append(((size(t) > 0) & first[t].isNotNull() & ~F.coalesce(empty[t], F.lit(True)),
                       f"first {t} entry is not empty"))
    checks += [
        (rest("mapping", lambda m: out(m["filename_strindex"], "string") | attrs(m)), "mapping index out of bounds"),
        (rest("function", lambda f: out(f["name_strindex"], "string") | out(f["system_name_strindex"], "string")
              | out(f["filename_strindex"], "string")), "function index out of bounds"),
        (rest("attribute", lambda a: out(a["key_strindex"], "string") | out(a["unit_strindex"], "string")),
         "attribute index out of bounds"),
        (rest("attribute", lambda a: a["value"].isNull()), "attribute value is null"),
        (rest("location", lambda x: out(x["mapping_index"], "mapping") | attrs(x)
              | F.exists(F.coalesce(x["lines"], F.array()), lambda y: out(y["function_index"], "function"))),
         "location index out of bounds"),
        (rest("link", lambda x: (F.octet_length(x["trace_id"]) != 16) | (F.octet_length(x["span_id"]) != 8)),
         "link id has wrong length"),
        (rest("stack", lambda s: F.exists(s["location_indices"], lambda i: out(i, "location"))),
         "stack location index out of bounds"),
    ]
    resources = lambda test: F.exists("resource_profiles", lambda r: F.coalesce(test(
        F.coalesce(r["attributes"], F.array().cast(ATTRIBUTES))), F.lit(False)))
    checks += [
        (resources(lambda a: F.exists(a, lambda x: x["key"] == "")), "resource attribute key is empty"),
        (resources(lambda a: F.exists(a, lambda x: x["value"].isNull())), "resource attribute value is null"),
        (resources(lambda a: F.size(F.array_distinct(F.transform(a, lambda x: x["key"]))) != F.size(a)),
         "resource attribute key is repeated"),
    ]
    found = lambda tests: F.array_compact(F.array(*[F.when(test, F.lit(message)) for test, message in tests]))
    profiles = F.flatten(F.flatten(F.transform("resource_profiles", lambda r: F.transform(
        r["scope_profiles"], lambda s: s["profiles"]))))
    # made once for all checks of them
    return F.concat(found(checks), let(profiles, lambda p: found(_profile_checks(p, out, attrs))))


def _profile_checks(profiles: Column, out, attrs) -> list[tuple[Column, str]]:
    """Violations among the profiles of a request, with their messages."""
    any_profile = lambda test: F.coalesce(F.exists(profiles, lambda p: F.coalesce(test(p), F.lit(False))), F.lit(False))
    any_sample = lambda test: any_profile(lambda p: F.exists(p["samples"], lambda x: F.coalesce(test(p, x), F.lit(False))))
    n = lambda a: F.coalesce(F.size(a), F.lit(0))
    return [
        (any_profile(lambda p: out(p["sample_type"]["type_strindex"], "string")
                     | out(p["sample_type"]["unit_strindex"], "string")), "sample type out of bounds"),
        (any_profile(lambda p: n(p["samples"]) == 0), "samples are empty"),
        (any_profile(lambda p: p["period_type"].isNull()), "period type is null"),
        (any_profile(lambda p: p["period"] < 0), "period is negative"),
        (any_profile(lambda p: (F.octet_length(p["profile_id"]) > 0) & (F.octet_length(p["profile_id"]) != 16)),
         "profile id has wrong length"),
        (any_profile(lambda p: F.hex(p["profile_id"]) == "0" * 32), "profile id is all zeros"),
        (any_profile(attrs), "profile attribute out of bounds"),
        (any_sample(lambda p, x: out(x["stack_index"], "stack")), "sample stack out of bounds"),
        (any_sample(lambda p, x: (n(x["values"]) == 0) & (n(x["timestamps"]) == 0)), "sample without values and timestamps"),
        (any_sample(lambda p, x: (n(x["values"]) > 0) & (n(x["timestamps"]) > 0) & (n(x["values"]) != n(x["timestamps"]))),
         "values do not match timestamps"),
        (any_sample(lambda p, x: attrs(x)), "sample attribute out of bounds"),
        (any_sample(lambda p, x: out(x["link_index"], "link")), "sample link out of bounds"),
        (any_sample(lambda p, x: F.exists(x["timestamps"], lambda t: (t < p["time_nanos"])
                                          | (t > p["time_nanos"] + p["duration_nanos"]))), "sample timestamp out of bounds"),
    ]


def validate_otlp(requests: DataFrame) -> DataFrame:
    """One row per violation of each request."""
    return requests.select("request_id", F.explode(request_errors()).alias("error"))
