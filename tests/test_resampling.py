"""Draws in a tree of ranges, and hypergeometric draws on both sides of the generator's limit."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statweave.operators import resampling


def log_pmf(x, g, b, m):
    c = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    return c(g, x) + c(b, m - x) - c(g + b, m)


@pytest.mark.parametrize("g, b, m", [(7, 9, 6), (3, 500, 40), (500, 3, 40), (40, 40, 75), (1, 1, 1), (200, 300, 150)])
def test_ratio_of_uniforms_has_the_exact_distribution(g, b, m):
    n = 200_000
    drawn = resampling._by_ratio_of_uniforms(np.random.default_rng(4), *(np.full(n, v, np.int64) for v in (g, b, m)))
    low, high = max(0, m - b), min(g, m)
    expected = np.array([math.exp(log_pmf(x, g, b, m)) for x in range(low, high + 1)])
    seen = np.bincount(drawn - low, minlength=len(expected)) / n
    assert drawn.min() >= low and drawn.max() <= high
    assert np.abs(seen - expected).max() < 5 * math.sqrt(0.25 / n)


@pytest.mark.parametrize("g, b, m", [(4 * 10**9, 6 * 10**9, 10**7), (10**10 - 50, 50, 5 * 10**9), (30, 10**10, 10**9), (5 * 10**8 + 7, 5 * 10**8, 10**6)])
def test_large_populations(g, b, m):
    n = 40_000
    x = resampling._hypergeometric(np.random.default_rng(6), *(np.full(n, v, np.int64) for v in (g, b, m))).astype(float)
    total = g + b
    mean, var = m * g / total, m * (g / total) * (b / total) * (total - m) / (total - 1)
    assert x.mean() == pytest.approx(mean, abs=5 * math.sqrt(var / n))
    assert x.var() == pytest.approx(var, rel=0.05)
    z = (x - mean) / math.sqrt(var)
    assert abs((z**3).mean()) < 1.0


def test_both_sides_of_the_limit_agree(monkeypatch):
    args = [np.full(60_000, v, np.int64) for v in (300, 700, 250)]
    one = resampling._hypergeometric(np.random.default_rng(1), *args)
    monkeypatch.setattr(resampling, "GENERATOR_LIMIT", 10)
    two = resampling._hypergeometric(np.random.default_rng(2), *args)
    edges = np.arange(40, 112)
    assert np.abs(np.histogram(one, edges)[0] - np.histogram(two, edges)[0]).max() < 6 * math.sqrt(60_000 * 0.07)


def test_log_factorial_ratios():
    a, b = np.array([5.0, 100.0, 1e10, 1e10 + 5e6, 40.0]), np.array([3.0, 90.0, 1e10 - 3, 1e10, 10.0])
    wanted = [math.log(20), math.lgamma(101) - math.lgamma(91), 3 * math.log(1e10), None, math.lgamma(41) - math.lgamma(11)]
    for found, w in zip(resampling._log_factorial_ratio(a, b), wanted, strict=True):
        assert w is None or found == pytest.approx(w, rel=1e-9)


@pytest.mark.parametrize("fan_out, block", [(64, 250), (2, 30), (3, 1000)])
def test_tree_deals_every_draw_once(spark, fan_out, block, monkeypatch):
    monkeypatch.setattr(resampling, "FAN_OUT", fan_out)
    monkeypatch.setattr(resampling, "BLOCK", block)
    rows = spark.createDataFrame([(k, r, r + 1, 20 + k) for k in range(2) for r in range(11) if r != 4], "k int, _range int, _c long, _take long")
    assert resampling.RANGE == "_range"
    for take, total in ((None, 61), ("_take", None)):
        found = {}
        for r in resampling._draws(rows, ["k"], 70, 3, take).collect():
            found.setdefault((r["k"], r["_block"]), []).append((r["_range"], r["_before"], r["_m"]))
        for (k, _), parts in found.items():
            parts.sort()
            m, before = np.array([p[2] for p in parts]), np.array([p[1] for p in parts])
            assert (m.sum(0) == (total or 20 + k)).all() and (before == np.cumsum(m, axis=0) - m).all()
            if take:
                assert all((row <= r + 1).all() for (r, _, _), row in zip(parts, m, strict=True))
        assert sum(len(p[0][2]) for p in found.values()) == 140


def test_intervals_do_not_depend_on_the_tree_in_distribution(spark, monkeypatch):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(10, 2, 400)], "y double")
    widths = []
    for fan_out, values in ((64, 50_000), (2, 40)):
        monkeypatch.setattr(resampling, "FAN_OUT", fan_out)
        monkeypatch.setattr(resampling, "VALUES_PER_TASK", values)
        r = resampling.bootstrap_ci(df, "y", n_boot=1000).statistics.first()
        widths.append(r["ci95_high"] - r["ci95_low"])
    assert widths[0] == pytest.approx(widths[1], rel=0.15) and widths[0] == pytest.approx(2 * 1.96 * 2 / 20, rel=0.15)
    assert df.agg(F.count("y")).first()[0] == 400
