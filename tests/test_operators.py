"""Edges of the operators that the queries over the general tables don't reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.operators import clustering, events, matching, metrics, sorting, synthesis, templates, timeseries
from tidewave.plans import registry


def series(spark, values):
    return spark.createDataFrame([(c, t, float(v)) for c, row in enumerate(values, 1) for t, v in enumerate(row)], "channel int, t long, v double")


def firings(spark, rows):
    return spark.createDataFrame([(i, 1, t, k, 1.0) for i, (t, k) in enumerate(rows)], "event_id long, channel int, time long, label int, amplitude double")


def test_lists_of_numbers():
    assert events.parse_int_list("1,3-5, 9") == [1, 3, 4, 5, 9]
    assert events.parse_int_list("") == []


def test_correlogram_edges(spark):
    rows = metrics.cross_correlograms(firings(spark, [(0, 1), (10, 1)]), 10, 5, auto=True).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [1, 0, 0, 0]  # -10 is included, +10 isn't


def test_label_chains(spark):
    label_map = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 0)], "old_label int, new_label int")
    out = events.apply_label_map(firings(spark, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]), label_map)
    assert sorted((r["time"], r["label"]) for r in out.collect()) == [(0, 1), (1, 1), (2, 1), (4, 5)]


def test_clips_at_the_edges(spark):
    x = series(spark, [[1, 2, 3, 4, 5]])
    at = spark.createDataFrame([(0, 0), (1, 4)], "event_id long, time long")
    get = lambda edge: {e: [r["v"] for r in templates.extract_clips(x, at, 3, edge=edge).where(F.col("event_id") == e).orderBy("t").collect()] for e in (0, 1)}
    assert get("pad") == {0: [0, 1, 2], 1: [4, 5, 0]}
    assert get("drop") == {0: [0, 0, 0], 1: [0, 0, 0]}


def test_missing_labels_have_zero_templates(spark):
    x = series(spark, [[1, 2, 3, 4, 5]])
    means = templates.templates(x, firings(spark, [(2, 1), (2, 3)]), 3)
    dense = templates.densify_labels(means, 3).where("label = 2").collect()
    assert len(dense) == 3 and all(r["v"] == 0 for r in dense)


def test_statistics_need_two_clips(spark):
    clips = spark.createDataFrame([(1, 1, 0, 5.0), (2, 1, 0, 1.0), (2, 1, 0, 3.0)], "label int, channel int, t int, v double")
    assert {r["label"]: (r["mean"], r["stdev"]) for r in templates.clip_statistics(clips).collect()} == {1: (0, 0), 2: (2, 1)}


def test_multiscale_pads_with_zero(spark):
    out = timeseries.multiscale(series(spark, [[5, 6, 7, 8]]), 4).orderBy("factor", "stat", "t").collect()
    assert [(r["factor"], r["stat"], r["v"]) for r in out] == [(3, "max", 7), (3, "max", 8), (3, "min", 5), (3, "min", 0), (9, "max", 8), (9, "min", 0)]


def test_artifacts_reach_the_neighbours_and_the_tail(spark):
    values = [100.0] * 2 + [1.0] * 2 * 30 + [1.0]
    out = timeseries.mask_out_artifacts(series(spark, [values]), len(values), interval=2, threshold=3.0).orderBy("t").collect()
    assert [r["v"] for r in out[:5]] == [0, 0, 0, 0, 1] and out[-1]["v"] == 0


def test_detection_agrees_with_the_fold_over_everything(spark):
    from tidewave.functions.kernels import keep_peaks

    rng = np.random.default_rng(7)
    x = rng.normal(size=3000)
    ours = [r["t"] for r in timeseries.detect_events(series(spark, [x]), threshold=1.0, interval=7).orderBy("t").collect()]
    size = np.abs(x - x.mean())
    at = np.flatnonzero(size > x.std(ddof=1))
    assert ours == at[keep_peaks(at.tolist(), size[at].tolist(), 7)].tolist()


def test_whitened_channels_are_uncorrelated(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=2000)
    w = timeseries.whiten(series(spark, [a, a + 0.3 * rng.normal(size=2000)]), 2000)
    for r in timeseries.covariance(w, 2000).collect():
        assert abs(r["w"] - (r["m1"] == r["m2"])) < 1e-3


def test_mutual_best_matching(spark):
    a = firings(spark, [(0, 1), (100, 1), (200, 2)])
    b = firings(spark, [(3, 1), (105, 1), (107, 1), (500, 2)])
    m = matching.match_events(a, b, 10)
    assert sorted((r["t1"], r["t2"]) for r in m.collect()) == [(0, 3), (100, 105)]
    c = {(r["k1"], r["k2"]): r["n"] for r in matching.confusion_matrix(m, a, b).collect()}
    assert c == {(1, 1): 2, (2, 0): 1, (0, 1): 1, (0, 2): 1}


def test_split_clamps(spark):
    sessions = spark.createDataFrame([(1, 10), (2, 10)], "session int, length long")
    out = events.split_firings(firings(spark, [(-3, 1), (9, 1), (10, 1), (50, 1)]), sessions)
    assert sorted((r["session"], r["time"]) for r in out.collect()) == [(1, -3), (1, 9), (2, 0), (2, 40)]


def test_random_firings_keep_their_distance(spark):
    rows = synthesis.random_firings(spark, units=2, samplerate=1000, duration=20, rate=20, refractory_ms=10).collect()
    for k in (1, 2):
        t = np.sort([r["time"] for r in rows if r["label"] == k])
        assert len(t) > 100 and np.diff(t).min() >= 10


def test_sorting_recovers_most_of_the_truth(spark):
    from tidewave.plans.storage import checkpointed

    rate, length = 2000, 40_000
    waves = synthesis.random_waveforms(spark, channels=3, size=60, units=3, upsample=5, seed=3)
    truth = checkpointed(synthesis.random_firings(spark, units=3, samplerate=rate, duration=20, rate=4, seed=5))
    x = synthesis.synthesize_timeseries(spark, waves, truth, channels=3, length=length, size=60, upsample=5)
    geom = spark.createDataFrame([(c, float(c), 0.0) for c in (1, 2, 3)], "channel int, x double, y double")
    found = checkpointed(registry.sort_pipeline(x, geom, samplerate=rate, length=length, freq_min=10, freq_max=900, freq_wid=50, clip_size=30, detect_threshold=4))
    confusion = matching.confusion_matrix(matching.match_events(truth, found, 10), truth, found)
    scores = sorted(r["accuracy"] for r in matching.compute_accuracies(confusion).collect())
    assert scores[-1] > 0.8 and sum(s > 0.7 for s in scores) >= 2


def test_registry_checks_arguments(spark):
    assert registry.spec("apply_timestamp_offset")["inputs"] == ["firings", "offset"]
    rows = firings(spark, [(5, 1)])
    assert registry.run("apply_timestamp_offset", firings=rows, offset=3).first()["time"] == 8
    with pytest.raises(TypeError):
        registry.run("apply_timestamp_offset", firings=rows, offset=3, other=1)
    with pytest.raises(TypeError):
        registry.run("apply_timestamp_offset", firings=rows)
    with pytest.raises(KeyError):
        registry.run("nothing")


def test_neighbourhood_of_radius_zero_is_the_channel(spark):
    geom = spark.createDataFrame([(c, float(c), 0.0) for c in (1, 2, 3)], "channel int, x double, y double")
    assert sorted((r["m"], r["channel"]) for r in sorting.neighbourhoods(geom, 0).collect()) == [(1, 1), (2, 2), (3, 3)]
    assert sorting.neighbourhoods(geom, -1).count() == 9


def test_segments_share_labels(spark):
    from tidewave.operators.segments import combine_firing_segments

    shapes = {"a": [0, 5, 9, 5, 0], "b": [0, -8, 0, 8, 0], "c": [7, 7, 7, 7, 7]}

    def segment(plan):
        values, rows = np.zeros(40 * len(plan) * 3 + 40), []
        for i, (shape, label) in enumerate(plan * 3):
            at = 40 * (i + 1)
            values[at - 2 : at + 3] = shapes[shape]
            rows.append((at, label))
        return series(spark, [values]), firings(spark, rows).drop("amplitude"), len(values)

    parts = [segment([("a", 1), ("b", 2)]), segment([("b", 1), ("a", 2), ("c", 3)])]
    out = combine_firing_segments(*map(list, zip(*parts, strict=True)), clip_size=5, edge=10).orderBy("time").collect()
    assert [r["label"] for r in out] == [1, 2] * 3 + [2, 1, 3] * 3
    assert out[6]["time"] == parts[0][2] + 40


def test_a_unit_with_later_peaks_on_another_channel_is_kept_once(spark):
    t = np.arange(40)
    bump = lambda at, top: top * np.exp(-(((t - at) / 3.0) ** 2))
    first = [bump(19, 10), bump(26, 8)]  # channel 2 peaks 7 samples after channel 1
    second = [bump(12, 10), bump(19, 8)]  # the same, by the time of its peak on channel 2
    means = spark.createDataFrame([(k, c, i, float(v)) for k, unit in ((1, first), (2, second)) for c, row in enumerate(unit, 1) for i, v in enumerate(row)], "label int, channel int, t int, v double")
    central = spark.createDataFrame([(1, 1), (2, 2)], "label int, m int")
    rows = firings(spark, [x for i in range(20) for x in ((100 * i, 1), (100 * i + 7, 2))])
    assert {(r["k1"], r["k2"]): r["lag"] for r in sorting.best_lags(means, sorting.merge_candidates(means, central)).collect()} == {(1, 2): -7, (2, 1): 7}
    kept = sorting.merge_across_channels(rows, means, central).collect()
    assert len(kept) == 20 and {r["label"] for r in kept} == {1}
    apart = firings(spark, [x for i in range(20) for x in ((100 * i, 1), (100 * i + 40, 2))])
    assert sorting.merge_across_channels(apart, means, central).count() == 40


def test_peaks_come_from_all_events_and_not_from_a_sample(spark):
    rng = np.random.default_rng(11)
    x = series(spark, rng.normal(size=(2, 2000)))
    rows = firings(spark, [(int(t), 1 + i % 2) for i, t in enumerate(rng.integers(0, 2000, 120))] + [(50, 3)])
    clips = templates.extract_clips(x, rows, 8)
    whole = {(r["label"], r["channel"], r["t"]): r for r in templates.clip_statistics(clips).collect()}
    ours = templates.event_statistics(x, rows, 8).collect()
    assert len(ours) == len(whole) == 3 * 2 * 8
    for r in ours:
        want = whole[r["label"], r["channel"], r["t"]]
        assert r["mean"] == pytest.approx(want["mean"], abs=1e-9) and r["stdev"] == pytest.approx(want["stdev"], abs=1e-9)
    peaks = {r["label"]: r for r in metrics.peak_metrics(templates.clip_statistics(clips)).collect()}
    for r in sorting.isolation_metrics(x, rows, 8, length=2000, most=10).collect():
        assert r["peak_amp"] == pytest.approx(peaks[r["label"]]["peak_amp"], abs=1e-9)
        assert r["peak_snr"] == pytest.approx(peaks[r["label"]]["peak_snr"], abs=1e-9)


def test_the_synthetic_series_is_as_long_as_the_recording(spark):
    from tidewave.plans.queries import QUERIES

    events = spark.createDataFrame([(1, 1, 2_500_000, 1, 1.0)], "event_id long, channel int, time long, label int, amplitude double")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("tidewave.plans.queries.firings", lambda *_: events)
        x = QUERIES["synthesize_timeseries"](spark, None)
    span = x.agg(F.count("*").alias("n"), F.max("t").alias("top"), F.max(F.when(F.abs(F.col("t") - 2_500_000) <= 30, F.abs("v"))).alias("peak")).first()
    assert span["n"] == 5 * 2_592_000 and span["top"] == 2_591_999 and span["peak"] > 5.5


def test_fit_stage_equals_plain_passes(spark):
    rng = np.random.default_rng(21)
    size, length, mask = 7, 400, 0.1
    shape = rng.normal(size=(3, 2, size)) * 3
    shape[1, 0, :3] = 0.05  # below the mask
    x = rng.normal(size=(2, length))
    times, labels = np.sort(rng.integers(-3, length + 3, 160)), rng.integers(0, 3, 160)
    for t, k in zip(times[::2], labels[::2], strict=True):
        if 3 <= t < length - 4:
            x[:, t - 3 : t + 4] += shape[k]
    means = spark.createDataFrame([(k + 1, c + 1, t, float(shape[k, c, t])) for k in range(3) for c in range(2) for t in range(size)], "label int, channel int, t int, v double")
    rows = spark.createDataFrame([(i, int(t), int(k) + 1) for i, (t, k) in enumerate(zip(times, labels, strict=True))], "event_id long, time long, label int")
    kept, open_, y = [], [i for i, t in enumerate(times) if t - 3 >= 0 and t + 4 <= length], x.copy()
    while open_:
        w = {i: np.where(np.abs(shape[labels[i]]) > mask, shape[labels[i]], 0) for i in open_}
        score = {i: float((2 * y[:, times[i] - 3 : times[i] + 4] * w[i] - w[i] ** 2).sum()) for i in open_}
        open_ = [i for i in open_ if score[i] > 1e-9]
        best = [i for i in open_ if all((round(score[i], 6), -times[i], -i) >= (round(score[j], 6), -times[j], -j) for j in open_ if abs(times[j] - times[i]) <= size)]
        for i in best:
            y[:, times[i] - 3 : times[i] + 4] -= w[i]
        kept += best
        open_ = [i for i in open_ if i not in best]
    found = sorting.fit_stage(series(spark, x), rows, means, size, mask=mask)
    assert sorted(r["event_id"] for r in found.collect()) == sorted(kept) and 20 < len(kept) < 140


def test_many_units_of_one_channel_are_told_apart(spark):
    rng = np.random.default_rng(22)
    middles, truth = rng.normal(size=(18, 30)) * 6, rng.integers(0, 18, 5000)
    x = middles[truth] + rng.normal(size=(5000, 30))
    rows = spark.createDataFrame([(i, 1, x[i].tolist()) for i in range(5000)], "event_id long, m int, f array<double>")
    found = {r["event_id"]: r["label"] for r in clustering.cluster_all(rows)[0].collect()}
    label = np.array([found[i] for i in range(5000)])
    assert all(max((np.sum((label == j) & (truth == k)) / np.sum((label == j) | (truth == k))) for j in np.unique(label)) > 0.95 for k in range(18))


def test_subsample_is_even_however_rows_are_dealt(spark):
    rows = spark.createDataFrame([(i * 7 % 1000, 1, i, 1 + (i % 10 == 0), 1.0) for i in range(1000)], "event_id long, channel int, time long, label int, amplitude double").repartition(6)
    out = events.subsample_firings(rows, max_per_label=30).collect()
    for k in (1, 2):
        ids = sorted(r["event_id"] for r in rows.where(f"label = {k}").collect())
        assert sorted(r["event_id"] for r in out if r["label"] == k) == [ids[j * len(ids) // 30] for j in range(30)]


def test_sessions_and_peaks_don_t_depend_on_the_parts_of_time(spark):
    rng = np.random.default_rng(23)
    t = np.unique(rng.integers(0, 3000, 600))
    rows = spark.createDataFrame([(c, int(u), float(rng.random())) for c in (1, 2) for u in t], "channel int, t long, v double")
    want, number = {}, 0
    for a, b in zip([None, *t], t, strict=False):
        number += a is not None and b - a > 6
        want[int(b)] = number
    for part in (5, 40, 10_000):
        assert all(r["session"] == want[r["t"]] for r in timeseries.sessions(rows, 6, part=part).collect())


def test_features_are_projections_on_the_leading_axes(spark):
    rng = np.random.default_rng(24)
    x = rng.normal(size=(40, 2, 5)) * np.arange(1, 6) + 3
    rows = spark.createDataFrame([(i, c + 1, t, float(x[i, c, t])) for i in range(40) for c in range(2) for t in range(5)], "clip_id long, channel int, t int, v double").repartition(5)
    for subtract in (False, True):
        flat = x.reshape(40, 10) - (x.reshape(40, 10).mean(0) if subtract else 0)
        _, _, axes = np.linalg.svd(flat, full_matrices=False)
        got = np.array([r["features"] for r in templates.principal_features(rows, 3, subtract_mean=subtract).orderBy("clip_id").collect()])
        assert np.allclose(np.abs(got), np.abs(flat @ axes[:3].T), atol=1e-6)


def test_templates_of_a_band_lose_what_is_outside(spark):
    t = np.arange(2000)
    x = 5 + np.sin(2 * np.pi * 100 * t / 1000)
    rows = firings(spark, [(200 + 10 * i, 1) for i in range(100)])  # a whole number of periods apart
    out = templates.view_templates(series(spark, [x]), rows, 40, subtract_mean=False, samplerate=1000, freq_min=50, freq_max=200, freq_wid=20, padding=80)
    v = np.array([r["v"] for r in out.orderBy("t").collect()])
    assert len(v) == 40 and abs(v.mean()) < 0.05 and 0.6 < v.std() < 0.8


def test_segments_are_joined_after_alignment(spark):
    from tidewave.operators import segments

    rng = np.random.default_rng(25)
    waves, parts, fired = rng.normal(size=(2, 30)) * 5, [], []
    for seg in range(2):
        x = rng.normal(size=3000) * 0.1
        events_ = []
        for i, t in enumerate(range(50, 2900, 60)):
            k = i % 2
            x[t - 15 : t + 15] += waves[k]
            events_.append((t + (3 if seg and k else 0), (k + 1 if not seg else 2 - k)))  # other names, and one seen later
        parts.append(series(spark, [x]))
        fired.append(firings(spark, events_))
    out = segments.combine_firing_segments(parts, fired, [3000, 3000], clip_size=40, edge=20).collect()
    at = {(r["segment"], r["time"]): r["label"] for r in out}
    assert {at[0, 50], at[1, 3050]} == {at[0, 50]} and {at[0, 110], at[1, 3113]} == {at[0, 110]} and at[0, 50] != at[0, 110]
