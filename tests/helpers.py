"""Small profiles written as text."""

from stackloom.schema import SAMPLES

TYPE = dict(name="cpu", sample_type="samples", sample_unit="count", period_type="cpu", period_unit="nanoseconds")


def line(name, number=1, file="f.go", system_name=None, start_line=1):
    return dict(line=number, column=0, function_name=name, function_system_name=system_name or name,
                function_filename=file, function_start_line=start_line)


def loc(address, *lines, file="a", build_id="aID", start=0, limit=1 << 20, offset=0, mapped=True):
    return dict(address=address, mapping_start=start if mapped else None, mapping_limit=limit if mapped else None,
                mapping_offset=offset if mapped else None, mapping_file=file if mapped else None,
                mapping_build_id=build_id if mapped else None, lines=list(lines))


def samples(spark, rows, **common):
    """Samples from (stack leaf first, value[, labels[, time]]); a stack may be a list of function names."""
    out = []
    for row in rows:
        stack, value, labels, t = (*row, *({}, 1)[len(row) - 2:])
        if stack and isinstance(stack[0], str):
            stack = [loc(0xa0 + sum(map(ord, n)), line(n)) for n in stack]
        base = dict(TYPE, period=1, duration=0, timestamp=t // 10**6, time_nanos=t, value=value, labels=labels, stacktrace=stack)
        out.append({**base, **common})
    return spark.createDataFrame(out, SAMPLES)


def folded(spark, text, **common):
    """Lines of ``root;..;leaf value time period``."""
    rows = []
    for entry in text.strip().splitlines():
        stack, value, t, period = entry.split()
        rows.append(dict(TYPE, sample_type="wall", sample_unit="nanoseconds", period=int(period), duration=0,
                         timestamp=0, time_nanos=int(t), value=int(value), labels={},
                         stacktrace=[loc(0, line(n)) for n in reversed(stack.split(";"))], **common))
    return spark.createDataFrame(rows, SAMPLES)


def collect(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
