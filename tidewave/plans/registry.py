"""Operators by name, with checked parameters, and the pipelines made of them."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.operators import chunks, clustering, events, matching, metrics, neighbours, segments, sorting, synthesis, templates, timeseries

OPERATORS: dict[str, Callable] = {
    name: f
    for module in (chunks, clustering, events, matching, metrics, neighbours, segments, sorting, synthesis, templates, timeseries)
    for name, f in inspect.getmembers(module, inspect.isfunction)
    if f.__module__ == module.__name__ and not name.startswith("_")
}


def spec(name: str) -> dict:
    """Inputs (without a default) and parameters (with one) of an operator, and what it says of itself."""
    f = OPERATORS[name]
    parts = inspect.signature(f).parameters.values()
    return {"name": name, "inputs": [p.name for p in parts if p.default is p.empty], "parameters": {p.name: p.default for p in parts if p.default is not p.empty}, "description": inspect.getdoc(f) or ""}


def run(name: str, /, **arguments):  # type: ignore[no-untyped-def]
    """Calls an operator. Unknown or missing arguments raise; texts are turned into the type of a parameter's default."""
    if name not in OPERATORS:
        raise KeyError(f"no operator {name}")
    s = spec(name)
    known = {*s["inputs"], *s["parameters"]}
    if bad := arguments.keys() - known:
        raise TypeError(f"{name} has no {', '.join(sorted(bad))}")
    if missing := [i for i in s["inputs"] if i not in arguments]:
        raise TypeError(f"{name} needs {', '.join(missing)}")
    for k, v in arguments.items():
        default = s["parameters"].get(k)
        if isinstance(v, str) and isinstance(default, bool):
            arguments[k] = v.lower() in ("1", "true", "yes")
        elif isinstance(v, str) and isinstance(default, (int, float)):
            arguments[k] = type(default)(float(v))
    return OPERATORS[name](**arguments)


def sort_pipeline(series: DataFrame, geom: DataFrame, *, samplerate: float, length: int, freq_min: float = 300, freq_max: float = 6000, freq_wid: float = 1000, whiten: bool = True, curate: bool = False, **options) -> DataFrame:  # type: ignore[no-untyped-def]
    """Filter, whiten (or normalise), sort and, if asked for, curate."""
    from tidewave.plans.storage import checkpointed

    filtered = chunks.chunk_bandpass(chunks.chunked(series, length, size=30_000), samplerate, freq_min, freq_max, freq_wid)
    filtered = chunks.Chunked(checkpointed(filtered.rows), filtered.size, length)
    ready = chunks.chunk_whiten(filtered) if whiten else chunks.chunked(timeseries.normalize_channels(chunks.unchunked(filtered)), length)
    ready = chunks.Chunked(checkpointed(ready.rows), ready.size, length)
    found = sorting.sort_events(ready, geom, **options)
    return curate_pipeline(chunks.unchunked(ready), found, samplerate=samplerate, length=length, clip_size=options.get("clip_size", 50)) if curate else found


def curate_pipeline(series: DataFrame, firings: DataFrame, *, samplerate: float, length: int, clip_size: int = 50, **thresholds) -> DataFrame:  # type: ignore[no-untyped-def]
    """Cluster and isolation metrics, the label map that follows from them, and the events after it."""
    a = metrics.cluster_metrics(firings, samplerate)
    b = sorting.isolation_metrics(series, firings, clip_size, length=length)
    c = metrics.bursting_parents(firings, templates.templates(series, firings, clip_size))
    table = a.join(b, "label", "left").join(c, "label", "left")
    table = table.withColumns({"noise_overlap": F.coalesce("noise_overlap", F.lit(0.0)), "isolation": F.coalesce("isolation", F.lit(1.0))})
    return events.apply_label_map(firings, events.create_label_map(table, **thresholds))
