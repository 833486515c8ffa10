"""Exact likelihoods against a plain filter, and fits against a brute-force search."""

import numpy as np
import pytest

from statweave.functions.kalman import Arma, Search
from statweave.operators import likelihood, timeseries


def plain(model, x, w):
    """Log determinants and squares of one step after the other."""
    mean, phi, theta = model.lags(model.parameters(x[None]))
    r, shock = model.states, np.r_[1.0, theta[0]]
    step = np.zeros((r, r))
    step[:, 0], step[np.arange(r - 1), np.arange(1, r)] = phi[0], 1.0
    cov, a, ld, ss = model.start(phi, shock[None])[0], np.zeros(r), 0.0, 0.0
    for t, v in enumerate(w):
        f, e = cov[0, 0], v - mean[0] - a[0]
        k = step @ cov[:, 0] / f
        if t >= model.burn:
            ld, ss = ld + np.log(f), ss + e * e / f
        a, cov = step @ a + k * e, step @ cov @ step.T + np.outer(shock, shock) - np.outer(k, k) * f
    return ld, ss


MODELS = [
    (Arma(1, 1, mean=True), [0.1, 0.7, -0.3]),
    (Arma(2, 3), [0.3, -0.5, 0.2, 0.4, -0.1]),
    (Arma(0, 0), []),
    (Arma(0, 1), [-0.9]),
    (Arma(1, 1, 1, 1, 4, bounded=False), [0.5, 0.3, 0.3, -0.6]),
    (Arma(1, 0, 0, 1, 12), [0.4, 0.5]),
]


@pytest.mark.parametrize("model, x", MODELS)
@pytest.mark.parametrize("parts", [1, 40])
def test_chunks_join_to_the_plain_filter(model, x, parts):
    rng = np.random.default_rng(5)
    w = rng.normal(size=1200) + 0.1 * np.cumsum(rng.normal(size=1200))
    x = np.array(x, float)
    points = np.stack([x, 0.5 * x])
    tree = [model.element(points, part, k == 0) for k, part in enumerate(np.array_split(w, parts))]
    while len(tree) > 1:
        tree = [model.join(*tree[i : i + 2]) if i + 1 < len(tree) else tree[i] for i in range(0, len(tree), 2)]
    whole = model.unpack(model.pack(tree[0]))
    for g, point in enumerate(points):
        ld, ss = plain(model, point, w)
        assert whole[5][g] == pytest.approx(ld, rel=1e-8, abs=1e-8) and whole[6][g] == pytest.approx(ss, rel=1e-8)


def test_search_finds_the_top_of_known_functions():
    for centre in ([0.3, -2.0, 1.0], [5.0]):
        centre = np.array(centre)
        search = Search(np.zeros((2, len(centre))))
        while not search.done:
            at = search.ask() - centre
            search.tell(-(at**2).sum(1) - 3 * at[:, 0] ** 4 - 0.5 * at[:, 0] * at[:, -1])
        assert np.allclose(search.x, centre, atol=1e-5)


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(8)
    e = rng.normal(size=700)
    w = np.zeros(700)
    for i in range(1, 700):
        w[i] = 0.6 * w[i - 1] + e[i] + 0.4 * e[i - 1]
    return np.cumsum(w)


def brute(w, phi, theta):
    """Exact log likelihood of an ARMA(1, 1) from the dense covariance of all rows."""
    n = len(w)
    g = np.zeros(n)
    g[0] = (1 + 2 * phi * theta + theta**2) / (1 - phi**2)
    g[1] = (phi + theta) * (1 + phi * theta) / (1 - phi**2)
    g[2:] = g[1] * phi ** np.arange(1, n - 1)
    lower = np.linalg.cholesky(g[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))])
    ss = float(((np.linalg.solve(lower, w)) ** 2).sum())
    return -0.5 * (n * (np.log(2 * np.pi * ss / n) + 1) + 2 * np.log(np.diag(lower)).sum()), ss / n


def test_arima_is_the_likeliest(spark, walk):
    y = walk[:400]
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "i int, y double")
    result = timeseries.arima(rows, "y", order=(1, 1, 1), steps=5, order_by="i")
    got = {r["term"]: r["coef"] for r in result.tables["params"].collect()}
    stats = result.statistics.first()
    w = np.diff(y)
    value, variance = brute(w, got["ar.L1"], got["ma.L1"])
    assert stats["log_likelihood"] == pytest.approx(value, rel=1e-9) and got["sigma2"] == pytest.approx(variance, rel=1e-8)
    assert stats["aic"] == pytest.approx(6 - 2 * value)
    for a, m in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3), (1e-3, -1e-3), (-1e-3, 1e-3)):
        assert brute(w, got["ar.L1"] + a, got["ma.L1"] + m)[0] < value
    # Forecasts follow the recursion from the last level and shock.
    e = [w[0]]
    for t in range(1, len(w)):
        e.append(w[t] - got["ar.L1"] * w[t - 1] - got["ma.L1"] * e[-1])
    level, step = y[-1], got["ar.L1"] * w[-1] + got["ma.L1"] * e[-1]
    for r in result.tables["forecast"].orderBy("step").collect():
        level += step
        step *= got["ar.L1"]
        assert r["forecast"] == pytest.approx(level, abs=1e-6) and r["position"] == 399 + r["step"]
    first = result.tables["forecast"].orderBy("step").first()
    assert first["ci95_high"] - first["ci95_low"] == pytest.approx(2 * 1.959963985 * np.sqrt(got["sigma2"]), rel=1e-6)


def test_many_series_short_and_long_agree(spark, walk, monkeypatch):
    monkeypatch.setattr(likelihood, "ROUNDS", 2)
    rows = spark.createDataFrame([(k, i, float(v * (k + 1))) for k, n in enumerate((150, 70, 30, 4, 60)) for i, v in enumerate(walk[50 * k : 50 * k + n] if k < 4 else np.ones(60))], "k int, i int, y double")

    def fits():
        result = timeseries.arima(rows, "y", order=(1, 0, 1), steps=2, by=["k"], order_by="i")
        return {r["k"]: r for r in result.statistics.collect()}, {(r["k"], r["term"]): r["coef"] for r in result.tables["params"].collect()}

    one, params = fits()
    assert one[3]["aic"] is None and one[4]["aic"] is None and one[3]["warnings"]
    monkeypatch.setattr(likelihood, "ROWS", 40)
    monkeypatch.setattr(likelihood, "FAN_IN", 2)
    two, others = fits()
    assert all(two[k]["log_likelihood"] == pytest.approx(one[k]["log_likelihood"], rel=1e-7) for k in (0, 1, 2))
    assert {k for k, _ in params} == {0, 1, 2} and params.keys() == others.keys()
    assert all(params[k] == pytest.approx(others[k], rel=1e-4) for k in params)
    assert {t for _, t in params} == {"const", "ar.L1", "ma.L1", "sigma2"}


def test_one_long_series_without_keys(spark, walk, monkeypatch):
    monkeypatch.setattr(likelihood, "ROUNDS", 1)
    monkeypatch.setattr(likelihood, "ROWS", 60)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(walk[:200])], "i int, y double")
    result = timeseries.arima(rows, "y", order=(1, 1, 0), steps=2, order_by="i")
    got = {r["term"]: r["coef"] for r in result.tables["params"].collect()}
    assert result.statistics.first()["log_likelihood"] == pytest.approx(brute(np.diff(walk[:200]), got["ar.L1"], 0.0)[0], rel=1e-9)


def test_sarima_is_the_likeliest(spark):
    rng = np.random.default_rng(3)
    e = rng.normal(size=260)
    w = e.copy()
    for t in range(5, 260):
        w[t] = 0.5 * w[t - 1] + e[t] - 0.6 * e[t - 4]
    y = np.zeros(260)
    for t in range(260):
        y[t] = w[t] + (y[t - 1] if t else 0) + (y[t - 4] if t >= 4 else 0) - (y[t - 5] if t >= 5 else 0)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "i int, y double")
    result = timeseries.sarima(rows, "y", order=(1, 1, 0), seasonal_order=(0, 1, 1, 4), steps=6, order_by="i")
    got = {r["term"]: r["coef"] for r in result.tables["params"].collect()}
    assert got["ar.L1"] == pytest.approx(0.5, abs=0.12) and got["ma.S.L4"] == pytest.approx(-0.6, abs=0.12)
    model = Arma(1, 0, 0, 1, 4, bounded=False)
    d = np.diff(y)
    d = d[4:] - d[:-4]
    value = lambda a, m: model.likelihood((None,) * 5 + tuple(np.array([v]) for v in plain(model, np.array([a, m]), d)), len(d))[0][0]
    best = value(got["ar.L1"], got["ma.S.L4"])
    assert result.statistics.first()["log_likelihood"] == pytest.approx(best, rel=1e-6)
    assert all(value(got["ar.L1"] + a, got["ma.S.L4"] + m) < best for a, m in ((2e-3, 0), (-2e-3, 0), (0, 2e-3), (0, -2e-3)))
    bands = [r["ci95_high"] - r["ci95_low"] for r in result.tables["forecast"].orderBy("step").collect()]
    assert bands == sorted(bands)
