"""Multiplicative exponential smoothing against the recursion written out."""

import itertools

import numpy as np
import pandas as pd
import pytest

from statweave.functions.smoothing import CurvedSmoother
from statweave.operators import timeseries


def plain(ys, theta, start, trend, seasonal, period):
    """Squared one-step errors and the end state (level, slope, seasonal terms in the order of use)."""
    alpha, beta, gamma = theta[0], theta[0] * theta[1], theta[2] * (1 - theta[0])
    level, slope = start[0], start[1] if trend else None
    season = list(start[1 + bool(trend) :][::-1])
    sse = 0.0
    for y in ys:
        base = level if not trend else level * slope if trend == "mul" else level + slope
        s = season.pop(0) if period else None
        sse += (y - (base if s is None else base * s if seasonal == "mul" else base + s)) ** 2
        clean = y if s is None else y / s if seasonal == "mul" else y - s
        new = alpha * clean + (1 - alpha) * base
        if trend:
            slope = (beta / alpha) * (new / level if trend == "mul" else new - level) + (1 - beta / alpha) * slope
        if period:
            season.append(gamma * (y / base if seasonal == "mul" else y - base) + (1 - gamma) * s)
        level = new
    return sse, [level] + ([slope] if trend else []) + season[::-1]


KINDS = [k for k in itertools.product([None, "add", "mul"], [None, "add", "mul"]) if "mul" in k]


def values(n, trend, seasonal, seed=3):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    level = 100 * (1.01**t if trend == "mul" else 1 + 0.02 * t if trend else 1)
    shape = np.array([0.8, 1.1, 1.3, 0.8])[t % 4]
    return (level * shape if seasonal == "mul" else level + 30 * (shape - 1) if seasonal else level) * np.exp(rng.normal(0, 0.02, n))


@pytest.mark.parametrize("trend,seasonal", KINDS)
def test_chunk_is_the_recursion_and_its_derivatives(trend, seasonal):
    period = 4 if seasonal else 0
    smoother = CurvedSmoother(trend, seasonal, period)
    ys = values(23, trend, seasonal)
    theta = np.array([[0.3, 0.2, 0.4], [0.7, 0.5, 0.1]])
    start = np.broadcast_to(smoother.guess(ys), (2, smoother.size))
    a, o, q, r, c = smoother.chunk(ys, theta, start)
    for i, th in enumerate(theta):
        z = start[i]
        sse, end = plain(ys, th, z, trend, seasonal, period)
        assert c[i] - 2 * r[i] @ z + z @ q[i] @ z == pytest.approx(sse, rel=1e-7)
        assert np.allclose(a[i] @ z + o[i], end, rtol=1e-10)
        for k in range(smoother.size):
            h = np.zeros(smoother.size)
            h[k] = 1e-6 * max(1, abs(z[k]))
            up, down = (np.array(plain(ys, th, z + d, trend, seasonal, period)[1]) for d in (h, -h))
            assert np.allclose(a[i][:, k], (up - down) / (2 * h[k]), rtol=1e-4, atol=1e-5)


def best_sse(ys, theta, trend, seasonal, period):
    """Gauss–Newton on the start state, with the recursion over the whole series."""
    smoother = CurvedSmoother(trend, seasonal, period)
    z = smoother.guess(ys)
    for _ in range(60):
        _, _, q, r, _ = smoother.chunk(ys, theta[None, :], z[None, :])
        z = smoother.kept_near((np.linalg.pinv(q[0], hermitian=True, rcond=1e-12) @ (r[0] - q[0] @ z) + z)[None, :], z[None, :])[0]
    return plain(ys, theta, z, trend, seasonal, period)


@pytest.mark.parametrize("trend,seasonal", [("add", "mul"), ("mul", None)])
def test_many_chunks_give_what_one_gives(spark, monkeypatch, trend, seasonal):
    period = 4 if seasonal else 0
    ys = values(60, trend, seasonal)
    rows = spark.createDataFrame(pd.DataFrame({"i": range(60), "y": ys}))
    found = []
    for size in (1000, 16):
        monkeypatch.setattr(timeseries, "SMOOTHING_ROWS", size)
        monkeypatch.setattr(timeseries, "FAN_IN", 2)
        result = timeseries.exp_smoothing(rows, "y", trend=trend, seasonal=seasonal, seasonal_periods=period or None, steps=5, order_by="i")
        found.append((result.statistics.first().asDict(), [r["forecast"] for r in result.tables["forecast"].orderBy("step").collect()]))
    (one, ahead), (many, ahead_many) = found
    assert one["warnings"] == many["warnings"] == []
    assert many["sse"] == pytest.approx(one["sse"], rel=1e-6) and np.allclose(ahead, ahead_many, rtol=1e-8)
    alpha = one["smoothing_level"]
    theta = np.array([alpha, one["smoothing_trend"] / alpha, one["smoothing_seasonal"] / (1 - alpha)])
    sse, end = best_sse(ys, theta, trend, seasonal, period)
    assert one["sse"] == pytest.approx(sse, rel=1e-6)
    assert np.allclose(ahead, CurvedSmoother(trend, seasonal, period).forecast(np.array(end), 5), rtol=1e-7)


def test_series_by_segment_and_refused_values(spark):
    t = np.arange(24)
    rows = pd.concat([pd.DataFrame({"g": g, "i": t, "y": 50.0 * growth**t}) for g, growth in (("a", 1.02), (None, 0.97))])
    result = timeseries.exp_smoothing(spark.createDataFrame(rows), "y", trend="mul", by=["g"], steps=3, order_by="i")
    ahead = {(r["g"], r["step"]): r["forecast"] for r in result.tables["forecast"].collect()}
    assert len(ahead) == 6
    assert all(v == pytest.approx(50 * (1.02 if g else 0.97) ** (23 + h), rel=1e-6) for (g, h), v in ahead.items())
    with pytest.raises(ValueError, match="positive"):
        timeseries.exp_smoothing(spark.createDataFrame([(0, 1.0), (1, 0.0)], "i int, y double"), "y", trend="mul", order_by="i")
    with pytest.raises(ValueError, match="'add', 'mul' or None"):
        timeseries.exp_smoothing(spark.createDataFrame([(0, 1.0)], "i int, y double"), "y", trend="damped", order_by="i")
