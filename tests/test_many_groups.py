"""Methods over many groups or levels against dense formulas, on both sides of the old limits."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from statweave.functions import dist
from statweave.operators import anova, survival


@pytest.fixture(scope="module")
def lives():
    rng = np.random.default_rng(1)
    n = 200
    return pd.DataFrame({"k": np.arange(n) % 2, "t": np.round(rng.exponential(10, n), 0) + 1, "e": (rng.random(n) < 0.7).astype(int), "g": [f"g{v:03d}" for v in rng.integers(0, 5, n)]})


def dense_logrank(p):
    groups = sorted(p.g.unique())
    gap, v = np.zeros(len(groups)), np.zeros((len(groups),) * 2)
    for t in sorted(p.t[p.e == 1].unique()):
        at = p[p.t >= t]
        n, d = len(at), int(((p.t == t) & (p.e == 1)).sum())
        a = np.array([(at.g == g).sum() for g in groups]) / n
        gap += np.array([((p.t == t) & (p.e == 1) & (p.g == g)).sum() for g in groups]) - d * a
        v += d * (n - d) / max(n - 1, 1) * (np.diag(a) - np.outer(a, a))
    return float(gap[:-1] @ np.linalg.pinv(v[:-1, :-1]) @ gap[:-1]), len(groups) - 1


@pytest.mark.parametrize("by, limit", [([], 3), (["k"], 3), ([], 50)])
def test_logrank_of_many_groups(spark, lives, by, limit, monkeypatch):
    monkeypatch.setattr(survival, "DENSE_GROUPS", limit)
    stats = survival.logrank(spark.createDataFrame(lives), "t", "e", "g", by=by).statistics.collect()
    for r in stats:
        part = lives[lives.k == r["k"]] if by else lives
        chi2, df = dense_logrank(part)
        assert r["chi2"] == pytest.approx(chi2, rel=1e-8) and r["df"] == df and r["n"] == len(part)
        assert r["p_value"] == pytest.approx(dist.chi2_sf(chi2, df), rel=1e-6)
    assert len(stats) == (2 if by else 1)


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(2)
    rows = []
    for i, j in itertools.product(range(4), range(3)):
        if (i + j) % 4 or i < 2:
            rows += [(i % 2, f"a{i}", f"b{j}", float(rng.normal(i - j, 1))) for _ in range(rng.integers(1, 6))]
    rows += [(0, "z1", "y1", float(v)) for v in rng.normal(3, 1, 4)]  # a component of its own
    return pd.DataFrame(rows, columns=["k", "a", "b", "y"])


def dense_twoway(p):
    one = np.ones((len(p), 1))
    d = lambda c: np.array([[float(v == u) for u in sorted(c.unique())[1:]] for v in c]).reshape(len(c), -1)
    fit = lambda x: (lambda b: (float(((p.y - x @ b[0]) ** 2).sum()), int(b[2])))(np.linalg.lstsq(x, p.y.to_numpy(), rcond=None))
    a, b = d(p.a), d(p.b)
    cell = pd.get_dummies(p.a + p.b).to_numpy(float)
    (ra, _), (rb, _), (rab, rank), (w, full) = fit(np.hstack([one, a])), fit(np.hstack([one, b])), fit(np.hstack([one, a, b])), fit(cell)
    return {"C(A)": (rb - rab, a.shape[1]), "C(B)": (ra - rab, b.shape[1]), "C(A):C(B)": (rab - w, full - rank), "Residual": (w, len(p) - full)}


@pytest.mark.parametrize("by, limit", [([], 0), (["k"], 0), ([], 200)])
def test_twoway_over_the_cell_table(spark, cells, by, limit, monkeypatch):
    monkeypatch.setattr(anova, "DENSE_LEVELS", limit)
    result = anova.twoway_anova(spark.createDataFrame(cells), "y", "a", "b", by=by)
    for r in result.tables["anova"].collect():
        part = cells[cells.k == r["k"]] if by else cells
        ss, df = dense_twoway(part)[r["term"]]
        assert r["sum_sq"] == pytest.approx(ss, rel=1e-8, abs=1e-8) and r["df"] == df


def test_twoway_coefficients_are_those_of_least_squares(spark):
    rng = np.random.default_rng(5)
    p = pd.DataFrame([(f"a{i}", f"b{j}", float(rng.normal(i * j, 2))) for i in range(3) for j in range(4) for _ in range(rng.integers(2, 6))], columns=["a", "b", "y"])
    got = {r["term"]: r for r in anova.twoway_anova(spark.createDataFrame(p), "y", "a", "b").tables["params"].collect()}
    names, columns = ["Intercept"], [np.ones(len(p))]
    for i in range(1, 3):
        names.append(f"C(A)[T.a{i}]"), columns.append(p.a == f"a{i}")
    for j in range(1, 4):
        names.append(f"C(B)[T.b{j}]"), columns.append(p.b == f"b{j}")
    for i, j in itertools.product(range(1, 3), range(1, 4)):
        names.append(f"C(A)[T.a{i}]:C(B)[T.b{j}]"), columns.append((p.a == f"a{i}") & (p.b == f"b{j}"))
    x = np.column_stack(columns).astype(float)
    beta = np.linalg.solve(x.T @ x, x.T @ p.y)
    sigma2 = float(((p.y - x @ beta) ** 2).sum()) / (len(p) - len(names))
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * sigma2)
    assert set(got) == set(names)
    for name, b, s in zip(names, beta, se, strict=True):
        r = got[name]
        assert r["coef"] == pytest.approx(b, abs=1e-9) and r["se"] == pytest.approx(s, rel=1e-9)
        assert r["p_value"] == pytest.approx(dist.t_p(b / s, len(p) - len(names)), rel=1e-6)


@pytest.mark.parametrize("block", [500, 4])
def test_tukey_by_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(anova, "PAIR_BLOCK", block)
    rng = np.random.default_rng(3)
    p = pd.DataFrame([(k, f"g{i:02d}", float(rng.normal(i / 5, 1))) for k in range(2) for i in range(11 + k) for _ in range(rng.integers(2, 7))], columns=["k", "g", "y"])
    result = anova.tukey_hsd(spark.createDataFrame(p), "y", "g", by=["k"])
    rows = result.tables["comparisons"].collect()
    for k in range(2):
        part = p[p.k == k]
        m = part.groupby("g").y.agg(["count", "mean", "var"])
        dof = len(part) - len(m)
        mse = float(((m["count"] - 1) * m["var"]).sum()) / dof
        crit = dist.studentized_range_ppf(0.95, len(m), dof)
        got = {(r["group1"], r["group2"]): r for r in rows if r["k"] == k}
        assert len(got) == math.comb(len(m), 2) and result.statistics.where(f"k = {k}").first()["n_pairs"] == len(got)
        for a, b in itertools.combinations(m.index, 2):
            gap, se = m["mean"][b] - m["mean"][a], math.sqrt(mse / 2 * (1 / m["count"][a] + 1 / m["count"][b]))
            r = got[a, b]
            assert r["meandiff"] == pytest.approx(gap) and r["upper"] - r["lower"] == pytest.approx(2 * crit * se)
            assert r["p_adj"] == pytest.approx(dist.studentized_range_sf(abs(gap) / se, len(m), dof), abs=1e-9)
            assert r["reject"] == (r["p_adj"] < 0.05)


def test_range_table_agrees_with_single_values():
    q = np.concatenate([np.linspace(-1, 12, 400), [40.0]])
    for k, df in ((3, 7.0), (25, 120.0), (5000, 1e6)):
        found = dist.studentized_range_sf_array(q, k, df)
        wanted = np.array([dist.studentized_range_sf(float(v), k, df) for v in q[::13]])
        assert np.abs(found[::13] - wanted).max() < 2e-9
