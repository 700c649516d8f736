"""Samples and the places where they are asked for may be many and compress to little: neither is sent through the driver."""

import pytest

from tests.test_operators import firings, series
from tidewave.operators import templates


@pytest.mark.parametrize("made", [
    lambda x, rows: templates.templates(x, rows, 8),
    lambda x, rows: templates.extract_clips(x, rows, 8),
    lambda x, rows: templates.event_statistics(x, rows, 8),
    lambda x, rows: templates.amplitudes(x, rows),
])
def test_samples_are_not_broadcast(spark, made):
    x, rows = series(spark, [[0.0] * 3000, [1.0] * 3000]), firings(spark, [(10 * i, 1 + i % 2) for i in range(250)])
    out = made(x, rows)
    assert out.count()
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and ("_ts" in line or "[t#" in line)]
