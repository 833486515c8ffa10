"""Distribution functions against published values and identities."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statweave.functions import dist


@pytest.mark.parametrize(
    "got, want",
    [
        (dist.t_ppf(0.975, 10), 2.2281388519649385),
        (dist.t_ppf(0.975, 1), 12.706204736432095),
        (dist.t_ppf(0.975, 1e6), 1.9599663),
        (dist.t_p(2.2281388519649385, 10), 0.05),
        (dist.chi2_sf(3.841458820694124, 1), 0.05),
        (dist.chi2_sf(18.307038053275146, 10), 0.05),
        (dist.f_sf(4.102821015130400, 2, 10), 0.05),
        (dist.norm_p(1.959963984540054), 0.05),
        (dist.studentized_range_ppf(0.95, 3, 5), 4.601725),
        (dist.studentized_range_ppf(0.95, 5, 20), 4.231857),
        (dist.t_power(0.5, 64, 64), 0.8014596),
        (dist.t_sample_size(0.5, 0.8), 63.76561),
        (dist.kolmogorov_sf(0.40925, 10), 0.05),
        (dist.mannwhitney_p(0, 3, 3, 0), 0.1),
        (dist.wilcoxon_p(21, 0, 6, 0), 0.03125),
        (dist.fisher_p(3, 1, 1, 3), 0.4857142857),
        (dist.fisher_p(8, 2, 1, 5), 0.03496503),
        (dist.kendall_p(6, 4, 0, 0, 0, 0, 0, 0), 2 / 24),
    ],
)
def test_published_values(got, want):
    assert got == pytest.approx(want, rel=2e-4)


def test_shapiro_example():
    x = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float)
    ranks = np.arange(11)
    score = float(dist.shapiro_scores(np.full(11, 11), ranks, np.ones(11)) @ (x - x.mean()))
    w, p = dist.shapiro(11, score, float(((x - x.mean()) ** 2).sum()), (x[0], x[1], x[-2], x[-1]))
    assert w == pytest.approx(0.7888148, abs=1e-6) and p == pytest.approx(0.0067038, rel=1e-4)


def test_normal_arrays_agree_with_the_scalar_functions():
    z = np.concatenate([np.linspace(-36, 36, 4001), [0.0, -1e-9]])
    want = np.array([dist.norm_cdf(v) for v in z])
    assert np.allclose(dist.norm_cdf_array(z), want, rtol=1e-11, atol=1e-300)
    p = np.concatenate([np.linspace(0.0005, 0.9995, 1999), 10.0 ** -np.arange(4, 300, 7)])
    assert np.allclose(dist.norm_ppf_array(p), [dist.norm_ppf(v) for v in p], rtol=1e-10, atol=1e-12)


@pytest.mark.parametrize("n", [3_900, 4_100, 4_300, 20_000])
def test_sums_of_scores_are_the_same_below_and_above_the_tail_limit(n):
    m = dist.norm_ppf_array((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    assert dist._score_square(n) == pytest.approx(float(m @ m), rel=1e-10)
    before, count = np.array([0, 10, n // 3, n // 2]), np.array([n // 2, n - 25, n // 3, n // 4])
    want = [m[b : b + c].sum() for b, c in zip(before, count, strict=True)]
    assert np.allclose(dist.shapiro_scores(np.full(4, n), before, count), want, rtol=1e-9, atol=1e-7)


@settings(max_examples=60, deadline=None)
@given(st.floats(0.01, 30), st.floats(1, 5000))
def test_t_squared_is_f(t, df):
    assert dist.t_p(t, df) == pytest.approx(dist.f_sf(t * t, 1, df), rel=1e-8, abs=1e-300)


@settings(max_examples=60, deadline=None)
@given(st.floats(0.01, 20))
def test_z_squared_is_chi_square(z):
    assert dist.norm_p(z) == pytest.approx(dist.chi2_sf(z * z, 1), rel=1e-9, abs=1e-300)


@settings(max_examples=40, deadline=None)
@given(st.floats(0.501, 0.9999), st.floats(1, 1e7))
def test_t_quantile_inverts(p, df):
    assert dist.t_sf(dist.t_ppf(p, df), df) == pytest.approx(1 - p, rel=1e-6)


def test_large_degrees_of_freedom_meet_the_limit():
    assert dist.t_p(2.0, 1e12) == pytest.approx(dist.norm_p(2.0), rel=1e-9)
    assert dist.f_sf(2.0, 3, 1e12) == pytest.approx(dist.chi2_sf(6.0, 3), rel=1e-9)
    assert dist.f_sf(2.0, 3, 9e7) == pytest.approx(dist.chi2_sf(6.0, 3), rel=1e-5)


def test_normal_log_cdf_tail():
    z = np.array([-40.0, -31.0, -29.0, -5.0, 0.0, 5.0])
    got = dist.norm_logcdf_array(z)
    assert got[0] == pytest.approx(-804.608442, rel=1e-8)
    assert got[4] == pytest.approx(math.log(0.5))
    assert np.all(np.diff(got) > 0)


def test_exact_counts_agree_with_enumeration():
    from itertools import combinations

    counts = dist._mannwhitney_counts(3, 4)
    seen = np.zeros(13)
    for chosen in combinations(range(7), 3):
        seen[sum(chosen) - 3] += 1
    assert np.array_equal(counts, seen)


def test_fisher_sums_whole_support():
    a, b, c, d = 11, 23, 31, 17
    n1, n2, k = a + b, c + d, a + c
    pmf = [math.comb(n1, i) * math.comb(n2, k - i) / math.comb(n1 + n2, k) for i in range(max(0, k - n2), min(n1, k) + 1)]
    own = pmf[a - max(0, k - n2)]
    assert dist.fisher_p(a, b, c, d) == pytest.approx(sum(p for p in pmf if p <= own * (1 + 1e-7)), rel=1e-9)
