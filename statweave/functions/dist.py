"""Tail probabilities and quantiles of the test distributions.

Scalar helpers in plain Python: they see one row per test or segment, never
the data.  The few that meet data rows (normal cdf, quantile) take arrays.
"""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()
_TINY = 1e-300
_LARGE = 1e8


# -- normal ---------------------------------------------------------------


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def norm_ppf(p: float) -> float:
    if p <= 0.0:
        return -math.inf
    if p >= 1.0:
        return math.inf
    return _NORMAL.inv_cdf(p)


def norm_p(z: float) -> float:
    """Two-sided normal p-value."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def _erfc_fit() -> np.ndarray:
    """Chebyshev coefficients of log(erfc(x) / t) + x² in t = 2 / (2 + x), for x from 0 to 26."""

    def target(u):
        x = 2.0 / _erfc_t(u) - 2.0
        return np.array([math.log(math.erfc(v) * (1.0 + v / 2.0)) + v * v for v in x])

    return np.polynomial.chebyshev.chebinterpolate(target, 40)


def _erfc_t(u: np.ndarray) -> np.ndarray:
    low = 1.0 / 14.0
    return low + (u + 1.0) * (1.0 - low) / 2.0


_ERFC = _erfc_fit()


def _erfc_array(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    size = np.minimum(np.abs(x), 26.0)
    t = 2.0 / (2.0 + size)
    upper = t * np.exp(np.polynomial.chebyshev.chebval((t - 1.0 / 14.0) * 28.0 / 13.0 - 1.0, _ERFC) - size * size)
    upper = np.where(np.abs(x) > 26.0, 0.0, upper)
    return np.where(np.isnan(x), np.nan, np.where(x >= 0, upper, 2.0 - upper))


def norm_cdf_array(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc_array(-np.asarray(z, float) / math.sqrt(2.0))


def norm_logcdf_array(z: np.ndarray) -> np.ndarray:
    z = np.asarray(z, float)
    low = z < -30.0
    safe = np.where(low, 0.0, z)
    with np.errstate(divide="ignore"):
        body = np.where(safe > 0, np.log1p(-0.5 * _erfc_array(safe / math.sqrt(2.0))), np.log(norm_cdf_array(safe)))
    far = np.where(low, z, -31.0)
    tail = -0.5 * far * far - np.log(-far) - 0.5 * math.log(2 * math.pi) + np.log1p(-1 / far**2 + 3 / far**4)
    return np.where(low, tail, body)


def norm_ppf_array(p: np.ndarray) -> np.ndarray:
    """Normal quantiles: a start by the logarithm of the tail, then Newton steps on log Φ."""
    p = np.asarray(p, float)
    tail = np.minimum(p, 1.0 - p)
    with np.errstate(divide="ignore", invalid="ignore"):
        goal = np.log(tail)
        far = np.sqrt(np.maximum(-2.0 * goal - np.log(np.maximum(-4.0 * math.pi * goal, 1.0)), 0.0))
        z = -np.where(tail < 0.1, far, (0.5 - tail) * math.sqrt(2.0 * math.pi))
        for _ in range(7):
            value = norm_logcdf_array(z)
            slope = np.exp(-0.5 * z * z - 0.5 * math.log(2.0 * math.pi) - value)
            z = z - (value - goal) / slope
        z = np.where(p < 0.5, z, -z)
    return np.where((p > 0) & (p < 1), z, np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, np.nan)))


# -- incomplete gamma and beta ---------------------------------------------


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    if math.isinf(x):
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * front)
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, 2_000_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-16:
            break
    return front * h


def _beta_fraction(a: float, b: float, x: float) -> float:
    c = 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 2_000_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + num / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_p(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta I_x(a, b); ``y`` is 1 - x if known exactly."""
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(y)
    if x < (a + 1.0) / (a + b + 2.0):
        return min(1.0, math.exp(log_front) * _beta_fraction(a, b, x) / a)
    return max(0.0, 1.0 - math.exp(log_front) * _beta_fraction(b, a, y) / b)


# -- chi-square, t, F -------------------------------------------------------


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2.0, x / 2.0)


def t_p(t: float, df: float) -> float:
    """Two-sided Student t p-value."""
    if df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    if df > _LARGE:
        return norm_p(t)
    return beta_p(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def t_sf(t: float, df: float) -> float:
    half = t_p(t, df) / 2.0
    return half if t >= 0 else 1.0 - half


def t_ppf(p: float, df: float) -> float:
    """Student t quantile by bracketing and bisection on the tail."""
    if df <= 0:
        return math.nan
    if p < 0.5:
        return -t_ppf(1.0 - p, df)
    if df > _LARGE:
        return norm_ppf(p)
    if df == 1:
        return math.tan(math.pi * (p - 0.5))
    lo, hi = 0.0, max(2.0, 2.0 * norm_ppf(p))
    while t_sf(hi, df) > 1.0 - p:
        lo, hi = hi, hi * 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_sf(mid, df) > 1.0 - p:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-14 * hi:
            break
    return 0.5 * (lo + hi)


def t_crit95(df: float) -> float:
    return t_ppf(0.975, df)


def f_sf(f: float, d1: float, d2: float) -> float:
    if d1 <= 0 or d2 <= 0:
        return math.nan
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    if d2 > _LARGE:
        return chi2_sf(f * d1, d1)
    return beta_p(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))


# -- noncentral t, studentized range ----------------------------------------

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(96)


def _scale_grid(df: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes s and weights of the density of sqrt(chi2_df / df)."""
    spread = 9.0 / math.sqrt(2.0 * df)
    lo, hi = max(0.0, 1.0 - spread), 1.0 + spread
    s = 0.5 * (hi - lo) * _NODES + 0.5 * (hi + lo)
    log_density = (
        math.log(2.0) + (df / 2.0) * math.log(df / 2.0) - math.lgamma(df / 2.0) + (df - 1) * np.log(s) - df * s * s / 2.0
    )
    return s, 0.5 * (hi - lo) * _WEIGHTS * np.exp(log_density)


def nct_cdf(t: float, df: float, nc: float) -> float:
    if df > 1e7:
        return norm_cdf(t - nc)
    s, w = _scale_grid(df)
    return float(np.sum(w * norm_cdf_array(t * s - nc)))


def t_power(d: float, n1: float, n2: float, alpha: float = 0.05) -> float:
    """Power of the two-sided two-sample t test."""
    df = n1 + n2 - 2.0
    if df <= 0:
        return math.nan
    nc = d * math.sqrt(1.0 / (1.0 / n1 + 1.0 / n2))
    crit = t_ppf(1.0 - alpha / 2.0, df)
    return min(1.0, max(0.0, 1.0 - nct_cdf(crit, df, nc) + nct_cdf(-crit, df, nc)))


def t_sample_size(d: float, power: float = 0.8, alpha: float = 0.05) -> float:
    """Observations per group needed to reach ``power`` (equal groups)."""
    if d == 0 or not 0 < power < 1:
        return math.nan
    lo, hi = 1.5, 4.0
    while t_power(d, hi, hi, alpha) < power:
        lo, hi = hi, hi * 2.0
        if hi > 1e15:
            return math.inf
    for _ in range(80):
        mid = 0.5 * (lo + hi)
        if t_power(d, mid, mid, alpha) < power:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def _range_cdf(w: np.ndarray, k: int) -> np.ndarray:
    """P(range of k normals <= w) for an array of w."""
    z = 8.5 * _NODES
    dz = 8.5 * _WEIGHTS
    phi = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    inner = np.clip(norm_cdf_array(z)[None, :] - norm_cdf_array(z[None, :] - w[:, None]), 0.0, 1.0)
    return k * np.sum(dz * phi * inner ** (k - 1), axis=1)


def studentized_range_sf(q: float, k: int, df: float) -> float:
    if q <= 0:
        return 1.0
    if df > 1e6:
        return max(0.0, 1.0 - float(_range_cdf(np.array([q]), k)[0]))
    s, w = _scale_grid(df)
    return min(1.0, max(0.0, 1.0 - float(np.sum(w * _range_cdf(q * s, k)))))


def studentized_range_sf_array(q: np.ndarray, k: int, df: float) -> np.ndarray:
    """:func:`studentized_range_sf` of many values, to about 1e-9.

    It is smooth in q, so beyond a few values it is read from polynomials through
    Chebyshev points, shared by all values of the same k and df.
    """
    q = np.asarray(q, float)
    if len(q) <= len(_NODES):
        return np.array([studentized_range_sf(float(v), k, df) for v in q])
    # Pieces of equal width in log(1 + q), as far as these values need them.
    at = np.log1p(np.maximum(q, 0.0)) / _PIECE
    pieces = _range_pieces(int(k), float(df), int(at.max()) + 1)
    piece = at.astype(np.int64)
    inside = piece < len(pieces)
    out = np.zeros(len(q))
    out[inside] = np.polynomial.chebyshev.chebval(2 * (at[inside] - piece[inside]) - 1, pieces[piece[inside]].T, tensor=False)
    return np.clip(np.where(q <= 0, 1.0, out), 0.0, 1.0)


_PIECE = 0.05
_PIECES: dict[tuple[int, float], list[np.ndarray]] = {}


def _range_pieces(k: int, df: float, count: int) -> np.ndarray:
    """Chebyshev coefficients of the upper tail piece by piece, until under 1e-10 is left; kept for the next batch."""
    degree, pieces = 14, _PIECES.setdefault((k, df), [])
    nodes = (np.cos(np.pi * (np.arange(degree + 1) + 0.5) / (degree + 1)) + 1) / 2
    while len(pieces) < count and not (pieces and np.abs(pieces[-1][0]) < 1e-10):
        values = [studentized_range_sf(float(np.expm1(v)), k, df) for v in (len(pieces) + nodes) * _PIECE]
        pieces.append(np.polynomial.chebyshev.chebfit(2 * nodes - 1, values, degree))
    return np.array(pieces)


@functools.lru_cache(maxsize=64)
def studentized_range_ppf(p: float, k: int, df: float) -> float:
    lo, hi = 0.0, 8.0
    while studentized_range_sf(hi, k, df) > 1 - p:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = 0.5 * (lo + hi)
        if studentized_range_sf(mid, k, df) > 1 - p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


# -- one-sample Kolmogorov ---------------------------------------------------


def _kolmogorov_exact(d: float, n: int) -> float:
    """P(D_n < d) from the n-th power of the transition matrix (Marsaglia, Tsang and Wang 2003)."""
    k = int(n * d) + 1
    m = 2 * k - 1
    h = k - n * d
    steps = np.subtract.outer(np.arange(m), np.arange(m)) + 1
    matrix = np.where(steps >= 0, 1.0, 0.0)
    powers = h ** np.arange(1, m + 1)
    matrix[:, 0] -= powers
    matrix[m - 1, :] -= powers[::-1]
    if 2 * h > 1:
        matrix[m - 1, 0] += (2 * h - 1) ** m
    factorial = np.array([math.lgamma(v + 1) if v > 0 else 0.0 for v in range(m + 2)])
    matrix *= np.exp(-factorial[np.clip(steps, 0, m + 1)])
    result = np.eye(m)
    scale = base_scale = 0
    power = n
    while power:
        if power & 1:
            result = result @ matrix
            scale += base_scale
        matrix = matrix @ matrix
        base_scale *= 2
        if matrix[k - 1, k - 1] > 1e140:
            matrix *= 1e-140
            base_scale += 140
        if result[k - 1, k - 1] > 1e140:
            result *= 1e-140
            scale += 140
        power >>= 1
    log_p = math.log(result[k - 1, k - 1]) + scale * math.log(10) + math.lgamma(n + 1) - n * math.log(n)
    return math.exp(log_p)


def kolmogorov_sf(d: float, n: float) -> float:
    if d <= 0:
        return 1.0
    if d >= 1:
        return 0.0
    if n * d * d <= 18 and n <= 5000 and n * d <= 120:
        return min(1.0, max(0.0, 1.0 - _kolmogorov_exact(d, int(n))))
    root = math.sqrt(n)
    z = root * d + 1 / (6 * root) + (root * d - 1) / (4 * n)
    if z < 0.2:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2.0 * k * k * z * z) for k in range(1, 60))
    return min(1.0, max(0.0, 2.0 * total))


# -- exact rank tests ---------------------------------------------------------


def mannwhitney_p(u: float, n1: float, n2: float, tie_sum: float) -> float:
    """Two-sided p-value; exact for a small untied sample, else normal with continuity."""
    big = max(u, n1 * n2 - u)
    if min(n1, n2) <= 8 and tie_sum == 0 and n1 * n2 <= 100_000:
        counts = _mannwhitney_counts(int(n1), int(n2))
        return min(1.0, 2.0 * float(counts[int(big):].sum() / counts.sum()))
    n = n1 + n2
    var = n1 * n2 / 12.0 * ((n + 1.0) - tie_sum / (n * (n - 1.0)))
    if var <= 0:
        return 1.0
    return min(1.0, 2.0 * norm_sf((big - n1 * n2 / 2.0 - 0.5) / math.sqrt(var)))


def _mannwhitney_counts(n1: int, n2: int) -> np.ndarray:
    """Coefficients of the Gaussian binomial: ways to reach each U."""
    small, large = min(n1, n2), max(n1, n2)
    size = n1 * n2 + 1
    ways = np.zeros(size)
    ways[0] = 1.0
    for i in range(1, small + 1):
        up = ways.copy()
        up[large + i:] -= ways[: size - large - i] if large + i < size else 0
        for start in range(i):
            up[start::i] = np.cumsum(up[start::i])
        ways = up
    return ways


def wilcoxon_p(r_plus: float, r_minus: float, n: float, tie_sum: float) -> float:
    if n <= 50 and tie_sum == 0:
        ways = np.zeros(int(n * (n + 1) / 2) + 1)
        ways[0] = 1.0
        for i in range(1, int(n) + 1):
            shifted = np.zeros_like(ways)
            shifted[i:] = ways[:-i]
            ways = ways + shifted
        return min(1.0, 2.0 * float(ways[: int(min(r_plus, r_minus)) + 1].sum() / ways.sum()))
    var = (n * (n + 1) * (2 * n + 1) - tie_sum / 2.0) / 24.0
    return norm_p((r_plus - n * (n + 1) / 4.0) / math.sqrt(var)) if var > 0 else 1.0


def kendall_p(s: float, n: float, x0: float, x1: float, xt: float, y0: float, y1: float, yt: float) -> float:
    """p-value of Kendall's S; t(t-1)(t-2), t(t-1)(2t+5) and t(t-1)/2 tie sums of both sides."""
    total = n * (n - 1) / 2.0
    discordant = (total - s) / 2.0
    if xt == 0 and yt == 0 and (n <= 33 or min(discordant, total - discordant) <= 1):
        return _kendall_exact(int(n), int(round(min(discordant, total - discordant))))
    m = n * (n - 1.0)
    var = (m * (2 * n + 5) - x1 - y1) / 18.0 + 2 * xt * yt / m + (x0 * y0 / (9 * m * (n - 2)) if n > 2 else 0.0)
    return norm_p(s / math.sqrt(var)) if var > 0 else math.nan


def _kendall_exact(n: int, c: int) -> float:
    if n > 170:
        # Only c in {0, 1} gets here: 1 or n permutations out of n!.
        return 0.0
    ways = np.array([1.0])
    for j in range(2, n + 1):
        ways = np.convolve(ways, np.ones(j))[: c + 1]
    total = n * (n - 1) // 2
    if 2 * c == total:
        return 1.0
    return min(1.0, 2.0 * float(ways.sum()) / math.factorial(n))


# -- 2x2 tables ----------------------------------------------------------------


def fisher_p(a: float, b: float, c: float, d: float) -> float:
    """Two-sided hypergeometric p-value: all tables at most as likely as the observed."""
    a, b, c, d = (int(v) for v in (a, b, c, d))
    row, other, column = a + b, c + d, a + c
    lo, hi = max(0, column - other), min(row, column)
    if lo == hi:
        return 1.0

    def log_pmf(k: int) -> float:
        return (
            math.lgamma(row + 1) - math.lgamma(k + 1) - math.lgamma(row - k + 1)
            + math.lgamma(other + 1) - math.lgamma(column - k + 1) - math.lgamma(other - column + k + 1)
            - math.lgamma(row + other + 1) + math.lgamma(column + 1) + math.lgamma(row + other - column + 1)
        )

    def tail(k: int, step: int) -> float:
        """Sum of the pmf from k outwards."""
        term = total = math.exp(log_pmf(k))
        while lo <= k + step <= hi and term > total * 1e-18:
            if step > 0:
                term *= (row - k) * (column - k) / ((k + 1.0) * (other - column + k + 1.0))
            else:
                term *= k * (other - column + k) / ((row - k + 1.0) * (column - k + 1.0))
            k += step
            total += term
        return total

    limit = log_pmf(a) + 1e-7
    mode = min(hi, max(lo, (row + 1) * (column + 1) // (row + other + 2)))
    if log_pmf(mode) <= limit:
        return 1.0
    if a < mode:
        near, start, stop = tail(a, -1), mode, hi
        if log_pmf(stop) > limit:
            return min(1.0, near)
        while stop - start > 1:
            mid = (start + stop) // 2
            start, stop = (start, mid) if log_pmf(mid) <= limit else (mid, stop)
        return min(1.0, near + tail(stop, +1))
    near, start, stop = tail(a, +1), mode, lo
    if log_pmf(stop) > limit:
        return min(1.0, near)
    while start - stop > 1:
        mid = (start + stop) // 2
        start, stop = (start, mid) if log_pmf(mid) <= limit else (mid, stop)
    return min(1.0, near + tail(stop, -1))


# -- Shapiro-Wilk ------------------------------------------------------------------

# Polynomial coefficients published by Royston (1995), AS R94.
_SW_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_SW_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SW_SMALL_GAMMA = (-2.273, 0.459)
_SW_SMALL_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
_SW_SMALL_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
_SW_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_SW_SD = (-0.4803, -0.082676, 0.0030302)


def _poly(coefficients: tuple, x: float) -> float:
    return sum(c * x**i for i, c in enumerate(coefficients))


# Ranks from either end that are added one by one; further in, sums of quantiles are integrals with end corrections.
_SW_TAIL = 2_000


def _quantile(i: np.ndarray, n: float) -> np.ndarray:
    return norm_ppf_array((i - 0.375) / (n + 0.25))


def _density(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * z * z) / math.sqrt(2.0 * math.pi)


def shapiro_scores(n: np.ndarray, before: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sum of the expected normal order statistics of the ranks before + 1 to before + count among n."""
    n, before, count = (np.asarray(v, float) for v in (n, before, count))
    out = np.zeros(len(n))
    short = count <= 8
    for j in range(1, 9):
        some = short & (count >= j)
        if some.any():
            out[some] += _quantile(before[some] + j, n[some])
    for k in np.flatnonzero(~short):
        low, high = int(before[k]) + 1, int(before[k] + count[k])
        inner = max(low, _SW_TAIL + 1), min(high, int(n[k]) - _SW_TAIL)
        if inner[1] - inner[0] < 100:
            out[k] = _quantile(np.arange(low, high + 1), n[k]).sum()
            continue
        ends = np.concatenate([np.arange(low, inner[0]), np.arange(inner[1] + 1, high + 1)])
        z = _quantile(np.array([inner[0] - 0.5, inner[1] + 0.5]), n[k])
        size, d = n[k] + 0.25, _density(z)
        slope = 1.0 / (size * d)
        out[k] = (_quantile(ends, n[k]).sum() if len(ends) else 0.0) + size * (d[0] - d[1]) - (slope[1] - slope[0]) / 24.0
    return out


def _score_square(n: int) -> float:
    """Sum of the squares of all expected order statistics."""
    if n <= 2 * _SW_TAIL + 200:
        m = _quantile(np.arange(1, n + 1), n)
        return float(m @ m)
    m = _quantile(np.arange(1, _SW_TAIL + 1), n)
    z = float(_quantile(np.array([_SW_TAIL + 0.5]), n)[0])
    size, d = n + 0.25, float(_density(np.array([z]))[0])
    middle = size * ((1.0 - 2.0 * norm_cdf(z)) + 2.0 * z * d)
    return 2.0 * float(m @ m) + middle - 2.0 * (-2.0 * z / (size * d)) / 24.0


def shapiro(n: int, score: float, squares: float, ends: tuple[float, float, float, float]) -> tuple[float, float]:
    """W and p of the Shapiro-Wilk test after Royston (1995).

    ``score`` is the sum of expected order statistic times value, ``squares`` the
    sum of squared deviations, ``ends`` the two smallest and two largest values.
    The published fit of p ends at n = 5000 and is carried on beyond.
    """
    if n < 3:
        return math.nan, math.nan
    first, second, next_, last_ = ends
    if first == last_ or not squares > 0:
        return 1.0, 1.0
    top = _quantile(np.array([n, n - 1]), n)
    norm2 = _score_square(n)
    if n == 3:
        total = math.sqrt(0.5) * (last_ - first)
    else:
        u = 1.0 / math.sqrt(n)
        last = top[0] / math.sqrt(norm2) + _poly(_SW_LAST, u)
        inner = score - top[0] * (last_ - first)
        if n > 5:
            nxt = top[1] / math.sqrt(norm2) + _poly(_SW_NEXT, u)
            phi = (norm2 - 2 * top[0] ** 2 - 2 * top[1] ** 2) / (1 - 2 * last**2 - 2 * nxt**2)
            total = (inner - top[1] * (next_ - second)) / math.sqrt(phi) + nxt * (next_ - second)
        else:
            phi = (norm2 - 2 * top[0] ** 2) / (1 - 2 * last**2)
            total = inner / math.sqrt(phi)
        total += last * (last_ - first)
    w = min(1.0, total**2 / squares)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1.0:
        return 1.0, 1.0
    y = math.log(1 - w)
    if n <= 11:
        gamma = _poly(_SW_SMALL_GAMMA, n)
        if y >= gamma:
            return w, 0.0
        z = (-math.log(gamma - y) - _poly(_SW_SMALL_MEAN, n)) / math.exp(_poly(_SW_SMALL_SD, n))
    else:
        z = (y - _poly(_SW_MEAN, math.log(n))) / math.exp(_poly(_SW_SD, math.log(n)))
    return w, norm_sf(z)
