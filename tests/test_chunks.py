"""Chunked series against the long form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.operators import chunks, templates, timeseries
from tidewave.sources.arrays import header


@pytest.fixture(scope="module")
def wave():
    return np.random.default_rng(3).normal(size=(3, 157))


@pytest.fixture(scope="module")
def series(spark, wave):
    return spark.createDataFrame([(c, t, float(v)) for c, row in enumerate(wave, 1) for t, v in enumerate(row)], "channel int, t long, v double")


def dense(df, value="v"):
    return {(r["channel"], r["t"]): r[value] for r in df.collect()}


@pytest.mark.parametrize("size", [7, 50, 157, 1000])
def test_round_trip(series, wave, size):
    c = chunks.chunked(series, 157, size=size)
    assert dense(chunks.unchunked(c)) == {(m + 1, t): wave[m, t] for m in range(3) for t in range(157)}


def test_missing_samples_are_zero(spark):
    c = chunks.chunked(spark.createDataFrame([(1, 2, 5.0), (1, 99, 1.0), (1, -1, 1.0), (1, 3, None)], "channel int, t long, v double"), 12, size=5, channels=[1, 4])
    assert {(r["channel"], r["chunk"]): list(r["samples"]) for r in c.rows.collect()} == {(1, 0): [0, 0, 5, 0, 0], (1, 1): [0] * 5, (1, 2): [0] * 2, (4, 0): [0] * 5, (4, 1): [0] * 5, (4, 2): [0] * 2}
    assert chunks.chunked(spark.createDataFrame([], "channel int, t long, v double"), 12, size=5).rows.count() == 0


@pytest.mark.parametrize(("size", "before", "after"), [(50, 10, 3), (10, 10, 10), (10, 25, 37), (200, 20, 5), (7, 0, 0), (50, 400, 400)])
def test_halos(series, wave, size, before, after):
    padded = np.pad(wave, ((0, 0), (before, after)))
    for r in chunks.with_halo(chunks.chunked(series, 157, size=size), before, after).collect():
        first = r["chunk"] * size
        assert np.array_equal(r["samples"], padded[r["channel"] - 1, first : min(first + size, 157) + before + after])


@pytest.mark.parametrize("size", [9, 64, 500])
def test_clips_and_templates_equal_the_long_form(spark, series, size, monkeypatch):
    monkeypatch.setattr(chunks, "HOT", 3)  # a chunk with more events is repeated
    times = [-40, -6, -5, -1, 0, 1, 77, 77, 77, 77, 78.6, 150, 156, 157, 161, 162, 163, 900]
    events = spark.createDataFrame([(i, float(t), i % 3) for i, t in enumerate(times)], "event_id long, time double, label int")
    c = chunks.chunked(series, 157, size=size)
    key = lambda df: sorted((r["event_id"], r["label"], r["channel"], r["t"], r["v"]) for r in df.collect())
    for options in ({}, {"edge": "drop"}, {"rounding": "round", "channels": [3, 1]}):
        assert key(chunks.clip_rows(chunks.chunk_clips(c, events, 12, **options))) == key(templates.extract_clips(series, events, 12, **options))
    mean = lambda df: {(r["label"], r["channel"], r["t"]): r["v"] for r in df.collect()}
    ours, theirs = mean(chunks.chunk_templates(c, events, 12)), mean(templates.templates(series, events, 12))
    assert ours.keys() == theirs.keys() and all(abs(ours[k] - theirs[k]) < 1e-12 for k in ours)
    assert chunks.chunk_templates(c, events.limit(0), 12).count() == 0


def test_filters_and_products_of_channels(series):
    c = chunks.chunked(series, 157, size=40)
    a = dense(chunks.unchunked(chunks.chunk_bandpass(c, 1000, 50, 200, 20, padding=15)))
    b = dense(timeseries.bandpass_filter(series, 1000, 50, 200, 20, chunk=40, padding=15))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    assert chunks.chunk_bandpass(c, 1000, 50, 0) is c
    cov = lambda df: {(r["m1"], r["m2"]): r["w"] for r in df.collect()}
    x, y = cov(chunks.chunk_covariance(c)), cov(timeseries.covariance(series, 157))
    assert x.keys() == y.keys() and all(abs(x[k] - y[k]) < 1e-12 for k in x)
    w = dense(chunks.unchunked(chunks.chunk_whiten(c)))
    v = dense(timeseries.whiten(series, 157))
    assert w.keys() == v.keys() and all(abs(w[k] - v[k]) < 2e-4 for k in w)


def test_a_clip_is_a_row_and_a_chunk_is_a_row(spark, series):
    c = chunks.chunked(series, 157, size=64)
    events = spark.createDataFrame([(i, i * 3) for i in range(40)], "event_id long, time long")
    out = chunks.chunk_clips(c, events, 12)
    assert out.count() == 40 * 3 and all(len(r["clip"]) == 12 for r in out.collect())
    assert c.rows.groupBy("channel").agg(F.count("*").alias("n")).where("n <> 3").count() == 0


def test_array_files_as_chunks(spark, tmp_path):
    x = np.arange(2 * 23, dtype="float32").reshape(2, 23)
    for name, part in (("a", x[:, :9]), ("b", x[:, 9:])):
        (tmp_path / f"{name}.mda").write_bytes(header("float32", [2, part.shape[1]]) + part.tobytes(order="F"))
    for size, step in ((4, 8), (4, 1), (30, 100), (9, 9)):
        c = chunks.read_chunks(spark, str(tmp_path), size, chunk=step)
        assert c.length == 23 and dense(chunks.unchunked(c)) == {(m + 1, t): x[m, t] for m in range(2) for t in range(23)}
        assert all(len(r["samples"]) == min(size, 23 - r["chunk"] * size) for r in c.rows.collect())
    (tmp_path / "r.bin").write_bytes(np.arange(8, dtype="int16").tobytes())
    raw = chunks.read_chunks(spark, str(tmp_path / "r.bin"), 3, num_channels=2, dtype="int16")
    assert dense(chunks.unchunked(raw)) == {(m + 1, t): 2 * t + m for m in range(2) for t in range(4)}
