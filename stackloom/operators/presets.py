"""Named filter sets for common runtimes."""

from stackloom.operators.filters import Condition, Criteria, FrameFilter, StackFilter

# Per preset its filters as (kind, field, condition, value).
FIXED_PRESETS = {
    "go_runtime_expected_off_cpu": [
        ("stack", "function_name", "not_equal", "runtime.usleep"),
        ("stack", "function_name", "not_equal", "runtime.futex"),
    ],
    "rust_runtime_expected_off_cpu": [
        ("stack", "function_name", "not_equal", "parking_lot_core::thread_parker::imp::ThreadParker::futex_wait"),
        ("stack", "function_name", "not_equal", "tokio::runtime::time::Driver::park_internal"),
        ("stack", "function_name", "not_equal", "futex_wait"),
    ],
    "hide_v8_internals": [
        ("frame", "binary", "not_contains", "node"),
        ("frame", "function_name", "not_contains", "V8"),
    ],
    "hide_cuda_internals": [
        ("frame", "binary", "not_contains", "libcudnn_engines_precompiled.so"),
        ("frame", "binary", "not_contains", "libcupti.so"),
        ("frame", "binary", "not_contains", "libcudart.so"),
        ("frame", "binary", "not_contains", "libcuda.so"),
        ("frame", "binary", "not_contains", "libcudnn.so"),
        ("frame", "binary", "not_contains", "libcudnn_graph.so"),
        ("frame", "binary", "not_contains", "lib{agent}gpucupti.so"),
        ("frame", "binary", "not_starts_with", "libcublas"),
    ],
    "hide_python_internals": [
        ("frame", "binary", "not_contains", "python3"),
        ("frame", "function_name", "not_equal", "<interpreter trampoline>"),
        ("frame", "function_name", "not_equal", "<module>"),
    ],
    "hide_libc": [
        ("frame", "binary", "not_contains", "libc.so"),
    ],
    "hide_tokio_frames": [
        ("frame", "function_name", "not_starts_with", "tokio::"),
        ("frame", "function_name", "not_starts_with", "<tokio::"),
        ("frame", "function_name", "not_contains", "tokio::runtime"),
    ],
    "hide_rust_futures": [
        ("frame", "function_name", "not_starts_with", "future"),
        ("frame", "function_name", "not_starts_with", "<future"),
        ("frame", "function_name", "not_contains", "futures_core"),
        ("frame", "function_name", "not_contains", "core::future::future::Future"),
        ("frame", "function_name", "not_starts_with", "poll"),
        ("frame", "function_name", "not_starts_with", "try_poll"),
        ("frame", "function_name", "not_starts_with", "{closure#"),
        ("frame", "function_name", "not_starts_with", "{async_block#"),
        ("frame", "function_name", "not_equal", "invoke"),
        ("frame", "function_name", "not_equal", "run"),
        ("frame", "function_name", "not_starts_with", "{async_fn#"),
    ],
    "hide_rust_panic_backtrace": [
        ("frame", "function_name", "not_starts_with", "std::panic"),
        ("frame", "function_name", "not_starts_with", "<core::panic"),
        ("frame", "function_name", "not_starts_with", "std::sys::backtrace"),
        ("frame", "function_name", "not_starts_with", "catch_unwind<"),
        ("frame", "function_name", "not_starts_with", "call_once<"),
        ("frame", "function_name", "not_starts_with", "do_call<"),
    ],
}

# Presets that make sense for off-CPU time only: sample type, unit, period type, unit, delta.
WALL_CLOCK = ("wallclock", "nanoseconds", "samples", "count", True)
RESTRICTED = {"go_runtime_expected_off_cpu": WALL_CLOCK, "rust_runtime_expected_off_cpu": WALL_CLOCK}


def preset(key: str, agent: str | None = None) -> list:
    """Filters of a preset. ``agent`` completes the library name of the profiling agent, in the preset that names it."""
    if agent is None and any("{agent}" in value for *_, value in FIXED_PRESETS[key]):
        raise ValueError(f"preset {key} needs the agent's name")
    out = []
    for kind, field, op, value in FIXED_PRESETS[key]:
        criteria = Criteria(**{field: Condition(op, value.replace("{agent}", agent or ""))})
        out.append(StackFilter(criteria) if kind == "stack" else FrameFilter(criteria))
    return out


def presets_for(profile_type=None) -> list[str]:
    """Keys of the presets offered for a profile type; all of them if none is given."""
    if profile_type is None:
        return list(FIXED_PRESETS)
    kind = (profile_type.sample_type, profile_type.sample_unit, profile_type.period_type,
            profile_type.period_unit, profile_type.delta)
    return [k for k in FIXED_PRESETS if k not in RESTRICTED or RESTRICTED[k] == kind]
