"""Time-series methods over ordered rows, one series or many (``by``)."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statweave.functions import dist
from statweave.functions.columns import col, drop_missing, num, present, require, text_list, to_timestamp_any
from statweave.functions.smoothing import CurvedSmoother
from statweave.functions.tails import t_p
from statweave.operators import likelihood
from statweave.operators.groups import Y, as_list, side_by_side
from statweave.plans.gram import solve
from statweave.plans.positions import CHUNK, HALO, POS, chunk_window, chunked, order_columns, positions
from statweave.plans.tables import attach, cut, failing, per_segment
from statweave.result import StatResult

TIME = "_time"


def series(df: DataFrame, y: str, time: str | None = None, by: Sequence[str] = (), order_by: str | Sequence[str] | None = None) -> DataFrame:
    """Rows (by..., _time, _y, _pos): known values in time order, else in row order."""
    by = list(by)
    require(df, y, *by)
    keys = [col(b) for b in by]
    df = df.where(present(df, y))
    if time:
        require(df, time)
        ties = as_list(order_by)
        rows = df.select(*keys, to_timestamp_any(df, time).alias(TIME), num(df, y).alias(Y), *[col(t).alias(f"_tie{i}") for i, t in enumerate(ties)])
        rows = drop_missing(rows, [TIME])
        order = [TIME, *[f"_tie{i}" for i in range(len(ties))], Y]
    else:
        cols = order_columns(df, order_by)
        rows = df.select(*keys, F.lit(None).cast("timestamp").alias(TIME), num(df, y).alias(Y), *[col(c).alias(f"_tie{i}") for i, c in enumerate(cols)])
        order = [f"_tie{i}" for i in range(len(cols))]
    return positions(rows, order, by).select(*by, TIME, Y, POS)


def moving_average(df: DataFrame, y: str, time: str | None = None, window: int = 7, by: Sequence[str] = (), order_by=None) -> StatResult:
    """Mean of the last ``window`` rows; null until half a window is there."""
    by, w = list(by), int(window)
    placed = chunked(series(df, y, time, by, order_by), w - 1)
    frame = chunk_window(by).rowsBetween(-(w - 1), 0)
    mean = F.when(F.count(Y).over(frame) >= max(1, w // 2), F.avg(Y).over(frame))
    rows = placed.withColumn("_ma", mean).where(~F.col(HALO))
    table = rows.select(*by, col(POS).alias("position"), col(TIME).alias("time"), col(Y).alias(y), F.col("_ma").alias(f"ma_{w}"))
    stats = rows.groupBy(*by).agg(F.lit(w).cast("long").alias("window"), F.count(F.lit(1)).alias("n")).withColumn("warnings", text_list())
    return StatResult("moving_average", f"Moving average (window={w})", stats, {"series": table}, by=by)


def trend_analysis(df: DataFrame, y: str, time: str | None = None, by: Sequence[str] = (), order_by=None) -> StatResult:
    by = list(by)
    rows = series(df, y, time, by, order_by)
    base = rows.groupBy(*by).agg(
        F.regr_slope(Y, POS).alias("slope"),
        F.regr_intercept(Y, POS).alias("intercept"),
        F.corr(Y, POS).alias("r"),
        F.regr_syy(Y, POS).alias("_syy"),
        F.regr_sxx(Y, POS).alias("_sxx"),
        F.count(F.lit(1)).alias("n"),
    )
    r, n = F.col("r"), F.col("n")
    rest = (1 - r) * (1 + r)
    t = F.when(rest <= 0, F.lit(float("inf"))).otherwise(r * F.sqrt((n - 2) / F.when(rest > 0, rest)))
    stats = base.select(
        *by,
        failing(by, n >= 2, F.col("slope"), "A trend needs at least 2 observations.").alias("slope"),
        "intercept",
        r,
        t_p(F.when(n > 2, t), F.when(n > 2, n - 2)).alias("p_value"),
        F.when(n > 2, F.sqrt(F.greatest(rest, F.lit(0.0)) * F.col("_syy") / F.col("_sxx") / F.when(n > 2, n - 2))).alias("se"),
        n,
        text_list(F.lit("Neighbouring rows may depend on each other; the p-value ignores that.")).alias("warnings"),
    )
    return StatResult("trend_analysis", "Linear trend", stats, by=by)


def acf_pacf(df: DataFrame, y: str, time: str | None = None, nlags: int | None = None, by: Sequence[str] = (), order_by=None) -> StatResult:
    """Autocorrelations from one pass of lagged products; partial ones by Yule–Walker (adjusted)."""
    by = list(by)
    rows = series(df, y, time, by, order_by)
    if by or rows.count() > 0:
        base = rows.groupBy(*by).agg(F.avg(Y).alias("_m"), F.count(F.lit(1)).alias("_n"))
    most = int(nlags or 24)
    placed = chunked(attach(rows, base, by).withColumn("_d", col(Y) - F.col("_m")), most)
    window = chunk_window(by)
    lagged = placed.select(*by, HALO, "_n", "_d", *[F.lag("_d", k).over(window).alias(f"_l{k}") for k in range(1, most + 1)]).where(~F.col(HALO))
    products = [F.sum(F.col("_d") * F.col("_d")), *[F.coalesce(F.sum(F.col("_d") * F.col(f"_l{k}")), F.lit(0.0)) for k in range(1, most + 1)]]
    table = cut(lagged.groupBy(*by).agg(F.max("_n").alias("n"), F.array(*products).alias("c")))

    def lags(n: int) -> int:
        return min(int(nlags) if nlags else min(24, max(5, n // 4)), max(n - 1, 0))

    def finish(r):
        n, c = r["n"], np.array(r["c"], float)
        if not n or c[0] <= 0:
            return
        adjusted = c / (n - np.arange(len(c)).clip(max=n - 1))
        yield {"lag": 0, "acf": 1.0, "pacf": 1.0}
        # Levinson–Durbin on the adjusted autocovariances.
        phi, error = np.zeros(0), adjusted[0]
        for k in range(1, lags(n) + 1):
            last = (adjusted[k] - phi @ adjusted[k - 1 : 0 : -1]) / error if error > 0 else math.nan
            phi = np.concatenate([phi - last * phi[::-1], [last]])
            error *= 1 - last * last
            yield {"lag": k, "acf": c[k] / c[0], "pacf": last}

    result = per_segment(table, by, [("lag", "int"), ("acf", "double"), ("pacf", "double")], finish)
    n = F.col("n")
    used = F.lit(int(nlags)) if nlags else F.least(F.lit(24), F.greatest(F.lit(5), F.floor(n / 4)))
    stats = table.select(*by, F.least(used, n - 1).cast("long").alias("nlags"), n, text_list().alias("warnings"))
    return StatResult("acf_pacf", "ACF / PACF", stats, {"lags": result}, by=by)


def seasonality(df: DataFrame, y: str, time: str | None = None, period: int = 12, by: Sequence[str] = (), order_by=None) -> StatResult:
    """Mean of each position in the cycle over the whole cycles."""
    by, period = list(by), int(period)
    rows = series(df, y, time, by, order_by)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    whole = attach(rows, sizes, by).where((F.col("_all") >= 2 * period) & (col(POS) < F.floor(F.col("_all") / period) * period))
    table = whole.groupBy(*by, (col(POS) % period + 1).cast("int").alias("season")).agg(F.avg(Y).alias("mean"))
    spread = table.groupBy(*by).agg((F.max("mean") - F.min("mean")).alias("seasonal_amplitude"))
    n = F.col("_all")
    ok = n >= 2 * period
    stats = side_by_side(sizes, spread, by).select(
        *by,
        F.lit(period).cast("long").alias("period"),
        failing(by, ok, F.col("seasonal_amplitude"), "Needs two whole periods.").alias("seasonal_amplitude"),
        (F.floor(n / period) * period).alias("n"),
        text_list(F.when(~ok, F.lit("fewer than two full periods"))).alias("warnings"),
    )
    return StatResult("seasonality", "Seasonal profile", stats, {"profile": table}, by=by)


# -- ARIMA by two linear regressions ------------------------------------------------


def _difference(d: int, seasonal_d: int, s: int) -> np.ndarray:
    """Coefficients of (1 - B)^d (1 - B^s)^D by lag."""
    poly = np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    for _ in range(seasonal_d):
        poly = np.convolve(poly, np.concatenate([[1.0], np.zeros(s - 1), [-1.0]]))
    return poly


def _lag_set(p: int, seasonal_p: int, s: int) -> list[int]:
    return sorted({i + s * j for i in range(p + 1) for j in range(seasonal_p + 1)} - {0})


def _arima(df: DataFrame, y: str, time: str | None, order, seasonal, steps: int, by, order_by, method: str, label: str) -> StatResult:
    """Hannan–Rissanen: a long autoregression gives innovations, a second regression the ARMA terms."""
    by = list(by)
    p, d, q = (int(v) for v in order)
    sp, sd, sq, s = (int(v) for v in seasonal) if seasonal else (0, 0, 0, 1)
    poly = _difference(d, sd, s)
    shift = len(poly) - 1
    ar, ma = _lag_set(p, sp, s), _lag_set(q, sq, s)
    constant = shift == 0
    deepest = max([*ar, *ma, 0])
    long_lags = deepest + max(4, s) if ma else 0
    rows = series(df, y, time, by, order_by)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    halo = shift + long_lags + deepest
    placed = chunked(rows, halo)
    window = chunk_window(by)
    w = sum((F.lag(Y, k).over(window) * float(c) for k, c in enumerate(poly) if k and c), col(Y) * float(poly[0]))
    staged = placed.withColumn("_w", w)
    one = [F.lit(1.0)] if constant else []

    def normal(rows: DataFrame, x: list, tag: str) -> DataFrame:
        """Sums of products of (x..., w) over the rows where all are known."""
        full = [*x, F.col("_w")]
        usable = drop_missing(rows.where(~F.col(HALO)).select(*by, *[v.alias(f"_v{i}") for i, v in enumerate(full)]), [f"_v{i}" for i in range(len(full))])
        pairs = [(i, j) for i in range(len(full)) for j in range(i, len(full))]
        return usable.groupBy(*by).agg(
            F.count(F.lit(1)).alias(f"{tag}_n"), F.array(*[F.sum(F.col(f"_v{i}") * F.col(f"_v{j}")) for i, j in pairs]).alias(f"{tag}_q")
        )

    def least_squares(q: Sequence[float], size: int) -> tuple[np.ndarray, float]:
        m = np.zeros((size, size))
        m[np.triu_indices(size)] = np.array(q, float)
        m = m + np.triu(m, 1).T
        beta = solve(m[:-1, :-1], m[:-1, -1]) if size > 1 else np.zeros(0)
        return beta, max(0.0, float(m[-1, -1] - beta @ m[:-1, -1]))

    if ma:
        for k in range(1, long_lags + 1):
            staged = staged.withColumn(f"_w{k}", F.lag("_w", k).over(window))
        x = one + [F.col(f"_w{k}") for k in range(1, long_lags + 1)]
        width = len(x)
        fits = per_segment(normal(staged, x, "_a"), by, [("_long", "array<double>")], lambda r: [{"_long": least_squares(r["_a_q"], width + 1)[0].tolist()}] if r["_a_n"] else [])
        fits = cut(fits)
        if not by and fits.isEmpty():
            raise ValueError("The series is too short for this model.")
        innovation = F.col("_w") - sum((F.col("_long")[i] * v for i, v in enumerate(x)), F.lit(0.0))
        staged = attach(staged, fits, by).withColumn("_e", innovation).drop("_long")
    else:
        staged = staged.withColumn("_e", F.lit(0.0))
        for k in ar:
            staged = staged.withColumn(f"_w{k}", F.lag("_w", k).over(window))
    for k in ma:
        staged = staged.withColumn(f"_e{k}", F.lag("_e", k).over(window))
    x = one + [F.col(f"_w{k}") for k in ar] + [F.col(f"_e{k}") for k in ma]
    names = (["const"] if constant else []) + [f"ar.L{k}" for k in ar] + [f"ma.L{k}" for k in ma]
    sums = normal(staged, x, "_b")
    terms = len(x)
    depth = shift + deepest
    # The forecast starts from the last few rows of each series.
    tail = attach(staged.where(~F.col(HALO)), sizes, by).where(col(POS) >= F.col("_n") - max(depth, 1))
    ends = tail.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(POS, Y, "_w", "_e"))).alias("_tail"), F.max("_n").alias("n"))
    table = cut(side_by_side(sums, ends, by))

    def fit(r):
        if not r["_b_n"] or r["_b_n"] <= terms:
            return None
        beta, rss = least_squares(r["_b_q"], terms + 1)
        return beta, rss / r["_b_n"]

    def stat_row(r):
        got = fit(r)
        if got is None or got[1] <= 0:
            yield {"n": r["n"]}
            return
        k, m = terms + 1, r["_b_n"]
        llf = -m / 2 * (math.log(2 * math.pi * got[1]) + 1)
        yield {"aic": 2 * k - 2 * llf, "bic": k * math.log(m) - 2 * llf, "sigma2": got[1], "n": r["n"]}

    def parameter_rows(r):
        got = fit(r)
        if got:
            for name, b in [*zip(names, got[0]), ("sigma2", got[1])]:
                yield {"term": name, "coef": b}

    def forecast_rows(r):
        got = fit(r)
        if got is None:
            return
        beta, sigma2 = got
        lead = 1 if constant else 0
        phi = dict(zip(ar, beta[lead : lead + len(ar)]))
        theta = dict(zip(ma, beta[lead + len(ar) :]))
        ys = [t[Y] for t in r["_tail"]]
        ws = [t["_w"] for t in r["_tail"]]
        es = [t["_e"] or 0.0 for t in r["_tail"]]
        # Weights of past shocks on the level: phi(B) (1-B)^d psi(B) = theta(B).
        full = np.zeros(max(ar, default=0) + 1)
        full[0] = 1.0
        for k, v in phi.items():
            full[k] -= v
        full = np.convolve(full, poly)
        psi = np.zeros(steps)
        for i in range(steps):
            psi[i] = (1.0 if i == 0 else theta.get(i, 0.0)) - sum(full[k] * psi[i - k] for k in range(1, min(i, len(full) - 1) + 1))
        crit = dist.norm_ppf(0.975)
        for h in range(steps):
            nxt = float(beta[0]) if constant else 0.0
            nxt += sum(v * _past(ws, k) for k, v in phi.items()) + sum(v * _past(es, k) for k, v in theta.items())
            level = nxt - sum(c * _past(ys, k) for k, c in enumerate(poly) if k)
            ws.append(nxt)
            es.append(0.0)
            ys.append(level)
            half = crit * math.sqrt(sigma2 * float(np.sum(psi[: h + 1] ** 2)))
            yield {"step": h + 1, "position": r["n"] + h, "forecast": level, "ci95_low": level - half, "ci95_high": level + half}

    stats = per_segment(table, by, [("aic", "double"), ("bic", "double"), ("sigma2", "double"), ("n", "long")], stat_row)
    stats = stats.withColumns({"order": F.lit(str(tuple(order))), "warnings": text_list(F.when(F.col("aic").isNull(), F.lit("too few observations for this model")))})
    if seasonal:
        stats = stats.withColumn("seasonal_order", F.lit(str(tuple(seasonal))))
    tables = {
        "forecast": per_segment(table, by, [("step", "int"), ("position", "long"), ("forecast", "double"), ("ci95_low", "double"), ("ci95_high", "double")], forecast_rows),
        "params": per_segment(table, by, [("term", "string"), ("coef", "double")], parameter_rows),
    }
    notes = ["Fitted by two linear regressions (Hannan–Rissanen), not by exact maximum likelihood."]
    return StatResult(method, label, stats, tables, notes, label, by)


def _past(values: list, k: int) -> float:
    v = values[-k] if k <= len(values) else None
    return 0.0 if v is None or v != v else float(v)


def _fitted(df: DataFrame, y: str, time, order, seasonal, steps: int, by, order_by, method: str, label: str, fit: str) -> StatResult:
    order, seasonal = tuple(int(v) for v in order), tuple(int(v) for v in seasonal) if seasonal else None
    if fit == "regression":
        return _arima(df, y, time, order, seasonal, steps, by, order_by, method, label)
    if fit != "likelihood":
        raise ValueError("fit is 'likelihood' or 'regression'.")
    poly = _difference(order[1], seasonal[1] if seasonal else 0, seasonal[3] if seasonal else 1)
    return likelihood.arima(series(df, y, time, list(by), order_by), by, order, seasonal, poly, steps, method, label)


def arima(df: DataFrame, y: str, time: str | None = None, order=(1, 1, 1), steps: int = 12, by: Sequence[str] = (), order_by=None, fit: str = "likelihood") -> StatResult:
    """Exact maximum likelihood, stationary and invertible; ``fit="regression"`` takes two linear regressions instead."""
    return _fitted(df, y, time, order, None, int(steps), by, order_by, "arima", f"ARIMA{tuple(order)}", fit)


def sarima(
    df: DataFrame, y: str, time: str | None = None, order=(1, 1, 1), seasonal_order=(1, 1, 1, 12), steps: int = 12, by: Sequence[str] = (), order_by=None, fit: str = "likelihood"
) -> StatResult:
    """Maximum likelihood with free parameters and a diffuse start, whose rows do not count; ``fit="regression"`` as in :func:`arima`."""
    label = f"SARIMA{tuple(order)}x{tuple(seasonal_order)}"
    return _fitted(df, y, time, order, seasonal_order, int(steps), by, order_by, "sarima", label, fit)


# -- exponential smoothing ---------------------------------------------------------

SMOOTHING_ROWS = 20_000
FAN_IN = 64


def _grid(centre: Sequence[float] | None, span: float, free: Sequence[bool]) -> np.ndarray:
    """Candidate (alpha, beta, gamma); beta and gamma are relative to alpha and 1 - alpha."""
    axes = []
    for i, used in enumerate(free):
        if not used:
            axes.append([0.0])
        elif centre is None:
            axes.append([0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98] if i == 0 else [0.01, 0.1, 0.3, 0.6, 0.95])
        else:
            axes.append(sorted({min(0.9999, max(1e-4, centre[i] + span * f)) for f in (-1.0, -0.5, 0.0, 0.5, 1.0)}))
    return np.array(list(itertools.product(*axes)))


class Smoother:
    """Additive smoothing as a linear map of the state, so that chunks can be composed.

    The state is (level, slope?, the last ``m`` seasonal terms, newest first).
    For a given (alpha, beta, gamma) a chunk maps its start state z to A z + a,
    and its squared one-step errors sum to z'Qz - 2 r'z + c.
    """

    def __init__(self, trend: bool, period: int):
        self.trend, self.period = trend, period
        self.size = 1 + int(trend) + period

    def system(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, n = len(theta), self.size
        alpha, beta, gamma = theta[:, 0], theta[:, 0] * theta[:, 1], theta[:, 2] * (1 - theta[:, 0])
        h = np.zeros(n)
        h[0] = 1.0
        step, gain = np.zeros((n, n)), np.zeros((g, n))
        step[0, 0] = 1.0
        gain[:, 0] = alpha
        if self.trend:
            h[1] = step[0, 1] = step[1, 1] = 1.0
            gain[:, 1] = beta
        if self.period:
            first = 1 + int(self.trend)
            h[n - 1] = 1.0
            step[first, n - 1] = 1.0
            for i in range(first + 1, n):
                step[i, i - 1] = 1.0
            gain[:, first] = gamma
        return h, step, gain

    def chunk(self, ys: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, ...]:
        h, step, gain = self.system(theta)
        g, n = len(theta), self.size
        a_map = np.broadcast_to(np.eye(n), (g, n, n)).copy()
        a_off = np.zeros((g, n))
        q, r, c = np.zeros((g, n, n)), np.zeros((g, n)), np.zeros(g)
        for y in ys:
            u = h @ a_map
            e0 = y - a_off @ h
            q += u[:, :, None] * u[:, None, :]
            r += e0[:, None] * u
            c += e0 * e0
            a_map = step @ a_map - gain[:, :, None] * u[:, None, :]
            a_off = a_off @ step.T + gain * e0[:, None]
        return a_map, a_off, q, r, c

    @staticmethod
    def join(first: tuple, then: tuple) -> tuple:
        a1, o1, q1, r1, c1 = first
        a2, o2, q2, r2, c2 = then
        at = np.swapaxes(a1, 1, 2)
        moved = np.einsum("gij,gj->gi", q2, o1)
        q = q1 + at @ q2 @ a1
        r = r1 + np.einsum("gji,gj->gi", a1, r2 - moved)
        c = c1 + c2 - 2 * np.einsum("gi,gi->g", r2, o1) + np.einsum("gi,gi->g", o1, moved)
        return a2 @ a1, np.einsum("gij,gj->gi", a2, o1) + o2, q, r, c

    def pack(self, parts: tuple) -> list[float]:
        return np.concatenate([p.reshape(len(parts[4]), -1) for p in parts[:4]] + [parts[4][:, None]], axis=1).ravel().tolist()

    def unpack(self, flat: Sequence[float]) -> tuple:
        n = self.size
        m = np.asarray(flat, float).reshape(-1, 2 * n * n + 2 * n + 1)
        cut_at = np.cumsum([n * n, n, n * n, n])
        a, o, q, r, c = np.split(m, cut_at, axis=1)
        return a.reshape(-1, n, n), o, q.reshape(-1, n, n), r, c[:, 0]


def _summariser(smoother: Smoother, by: list[str], span: float, free: list[bool], tuned: bool):
    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS)
        theta = _grid(list(pdf["_theta"].iloc[0]) if tuned else None, span, free)
        out = pdf[[*by, CHUNK]].iloc[:1].copy()
        out["_rows"] = len(pdf)
        out["_map"] = [smoother.pack(smoother.chunk(pdf[Y].to_numpy(float), theta))]
        return out

    return summarise


def _composer(smoother: Smoother, by: list[str]):
    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part")
        parts = [smoother.unpack(m) for m in pdf["_map"]]
        whole = parts[0]
        for p in parts[1:]:
            whole = smoother.join(whole, p)
        out = pdf[[*by, CHUNK]].iloc[:1].copy()
        out["_rows"] = pdf["_rows"].sum()
        out["_map"] = [smoother.pack(whole)]
        return out

    return compose


def _chooser(smoother: Smoother, span: float, free: list[bool], tuned: bool):
    def choose(r):
        theta = _grid(list(r["_theta"]) if tuned else None, span, free)
        a, o, q, rr, c = smoother.unpack(r["_map"])
        scored = []
        for i in range(len(theta)):
            z = np.linalg.pinv(q[i], hermitian=True, rcond=1e-12) @ rr[i]
            scored.append((max(0.0, float(c[i] - 2 * rr[i] @ z + z @ q[i] @ z)), i, z))
        sse, i, z = min(scored, key=lambda e: e[0])
        yield {"_theta": theta[i].tolist(), "_state": (a[i] @ z + o[i]).tolist(), "sse": sse, "n": r["_rows"]}

    return choose


def exp_smoothing(
    df: DataFrame,
    y: str,
    time: str | None = None,
    trend: str | None = "add",
    seasonal: str | None = None,
    seasonal_periods: int | None = None,
    steps: int = 12,
    by: Sequence[str] = (),
    order_by=None,
) -> StatResult:
    """Holt–Winters with the least-squares start state; weights by grid refinement.

    Trend and season are "add", "mul" or None.  Every pass handles all chunks of
    all series in parallel; their state maps are then composed, so a long series
    does not run through one task.  A multiplicative part needs positive values
    and several passes, see :mod:`statweave.functions.smoothing`.
    """
    kinds = {None: None, "": None, "add": "add", "additive": "add", "mul": "mul", "multiplicative": "mul"}
    if trend not in kinds or seasonal not in kinds:
        raise ValueError("Trend and seasonality are 'add', 'mul' or None.")
    trend, seasonal = kinds[trend], kinds[seasonal]
    by, steps = list(by), int(steps)
    period = int(seasonal_periods) if seasonal and seasonal_periods else 0
    if "mul" in (trend, seasonal if period else None):
        return _curved(df, y, time, trend, seasonal if period else None, period, steps, by, order_by)
    smoother = Smoother(bool(trend), period)
    free = [True, bool(trend), period > 0]
    rows = series(df, y, time, by, order_by)
    rows = cut(rows.withColumn(CHUNK, F.floor(col(POS) / SMOOTHING_ROWS)).select(*by, CHUNK, POS, Y))
    key_fields = [rows.schema[b] for b in by]
    chunk_schema = T.StructType([*key_fields, T.StructField(CHUNK, T.LongType()), T.StructField("_rows", T.LongType()), T.StructField("_map", T.ArrayType(T.DoubleType()))])
    best = None
    for round_ in range(5):
        span = 0.2 / 2.0**round_

        source = rows if best is None else attach(rows, best.select(*by, "_theta"), by)
        maps = source.groupBy(*by, CHUNK).applyInPandas(_summariser(smoother, by, span, free, best is not None), chunk_schema)
        chunks = rows.agg(F.max(CHUNK)).first()[0]
        if chunks is None:
            raise ValueError(f"'{y}' holds no numbers.")
        while chunks > 0:
            maps = maps.withColumn("_part", col(CHUNK)).withColumn(CHUNK, F.floor(col(CHUNK) / FAN_IN))
            maps = maps.groupBy(*by, CHUNK).applyInPandas(_composer(smoother, by), chunk_schema)
            chunks //= FAN_IN
        combined = maps if best is None else side_by_side(maps, best.select(*by, "_theta"), by)
        fields = [("_theta", "array<double>"), ("_state", "array<double>"), ("sse", "double"), ("n", "long")]
        best = cut(per_segment(combined, by, fields, _chooser(smoother, span, free, best is not None)))

    def forecast_rows(r):
        z = r["_state"]
        first = 1 + int(bool(trend))
        for h in range(1, steps + 1):
            value = z[0] + (h * z[1] if trend else 0.0)
            if period:
                value += z[first + period - 1 - (h - 1) % period]
            yield {"step": h, "forecast": value}

    return _smoothed(best, by, forecast_rows)


def _smoothed(best: DataFrame, by: list[str], forecast_rows, *warnings) -> StatResult:
    theta = F.col("_theta")
    stats = best.select(
        *by,
        "sse",
        "n",
        theta[0].alias("smoothing_level"),
        (theta[0] * theta[1]).alias("smoothing_trend"),
        (theta[2] * (1 - theta[0])).alias("smoothing_seasonal"),
        text_list(*warnings).alias("warnings"),
    )
    tables = {"forecast": per_segment(best, by, [("step", "int"), ("forecast", "double")], forecast_rows)}
    return StatResult("exp_smoothing", "Exponential smoothing", stats, tables, by=by)


# Passes in which the start states of a round of candidates come to rest, and the relative change that counts as rest.
CURVED_PASSES = 25
STILL = 1e-9


def _both(left: DataFrame, right: DataFrame, keys: list[str], fn, schema: T.StructType) -> DataFrame:
    """``fn`` on the rows of both tables that share a key.

    A union, not a cogroup: Spark takes the size of a cogroup for the product of
    its sides, and over many passes that number alone grows past all bounds.
    """
    tagged = left.withColumn("_right", F.lit(False)).unionByName(right.withColumn("_right", F.lit(True)), allowMissingColumns=True)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["_right"].to_numpy(bool)
        return fn(pdf[~side], pdf[side])

    return tagged.groupBy(*[col(k) for k in keys]).applyInPandas(run, schema)


def _curved(df: DataFrame, y: str, time: str | None, trend: str | None, seasonal: str | None, period: int, steps: int, by: list[str], order_by) -> StatResult:
    """Smoothing whose recursion is not linear: Newton passes over all chunks at once, for a grid of weights that is refined.

    A pass linearises every chunk near its start state for every candidate, joins
    the chunks in a tree, solves for the series' start state and hands new start
    states down the same tree.
    """
    curved, linear = CurvedSmoother(trend, seasonal, period), Smoother(bool(trend), period)
    size, free = curved.size, [True, bool(trend), period > 0]
    rows = series(df, y, time, by, order_by)
    rows = cut(rows.withColumn(CHUNK, F.floor(col(POS) / SMOOTHING_ROWS)).select(*by, CHUNK, POS, Y))
    top, least = rows.agg(F.max(CHUNK), F.min(Y)).first()
    if top is None:
        raise ValueError(f"'{y}' holds no numbers.")
    if least <= 0:
        raise ValueError(f"'{y}' has to be positive for a multiplicative part.")
    keys = [rows.schema[b] for b in by]
    many = T.ArrayType(T.DoubleType())
    map_schema = T.StructType([*keys, T.StructField(CHUNK, T.LongType()), T.StructField("_rows", T.LongType()), T.StructField("_map", many), T.StructField("_used", many), T.StructField("_centre", many)])
    start_schema = T.StructType([*keys, T.StructField(CHUNK, T.LongType()), T.StructField("_starts", many), T.StructField("_theta", many), T.StructField("_best", many), T.StructField("_chosen", T.IntegerType()), T.StructField("_gap", T.DoubleType())])

    def candidates(centre, span: float) -> np.ndarray:
        return _grid(None if centre is None else list(centre), span, free)

    def linearise(span: float):
        def run(values: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
            values = values.sort_values(POS)
            ys = values[Y].to_numpy(float)
            known_ = len(starts) > 0
            centre = starts["_theta"].iloc[0] if known_ else None
            theta = candidates(centre, span)
            start = np.asarray(starts["_starts"].iloc[0], float).reshape(-1, size) if known_ else curved.guess(ys)[None, :]
            start = np.broadcast_to(start, (len(theta), size)) if len(start) == 1 else start
            out = values[[*by, CHUNK]].iloc[:1].copy()
            out["_rows"] = len(ys)
            # A series that is one chunk needs no other's end state: its passes run here.
            parts, start = curved.settled(ys, theta, start, CURVED_PASSES, STILL) if top == 0 else (curved.chunk(ys, theta, start), start)
            out["_map"] = [linear.pack(parts)]
            out["_used"] = [start.ravel().tolist()]
            out["_centre"] = [None if centre is None else list(centre)]
            return out

        return run

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _composer(linear, by)(pdf)
        first = pdf.sort_values("_part").iloc[0]
        out["_used"], out["_centre"] = [first["_used"]], [first["_centre"]]
        return out

    def choose(span: float):
        def run(r):
            theta = candidates(r["_centre"], span)
            a, o, q, rr, c = linear.unpack(r["_map"])
            used = np.asarray(r["_used"], float).reshape(-1, size)
            z, sse = curved.improved(used, q, rr, c)
            i = int(np.argmin(sse))
            yield {"_theta": theta[i].tolist(), "_state": (a[i] @ z[i] + o[i]).tolist(), "sse": float(sse[i]), "n": r["_rows"], "_starts": z.ravel().tolist(), "_chosen": i, "_centre": None if r["_centre"] is None else list(r["_centre"])}

        return run

    def hand_down(pdf: pd.DataFrame, node: pd.DataFrame) -> pd.DataFrame:
        """Start states of the parts of one node, in their order, from the node's own."""
        pdf, node = pdf.sort_values(CHUNK), node.iloc[0]
        z, i = np.asarray(node["_starts"], float).reshape(-1, size), int(node["_chosen"])
        out = []
        for flat, used in zip(pdf["_map"], pdf["_used"], strict=True):
            old = np.asarray(used, float).reshape(-1, size)
            z = curved.kept_near(z, old)
            out.append((z.ravel().tolist(), curved.change(z[i], old[i])))
            a, o, *_ = linear.unpack(flat)
            with np.errstate(all="ignore"):
                z = np.einsum("gij,gj->gi", a, z) + o
        found = pdf[[*by, CHUNK]].copy()
        found["_starts"], found["_gap"] = [s for s, _ in out], [g for _, g in out]
        found["_chosen"] = i
        for name in ("_theta", "_best"):
            found[name] = [node[name]] * len(found)
        return found[[f.name for f in start_schema.fields]]

    fields = [("_theta", "array<double>"), ("_state", "array<double>"), ("sse", "double"), ("n", "long"), ("_starts", "array<double>"), ("_chosen", "int"), ("_centre", "array<double>")]
    starts, best, gap = rows.sparkSession.createDataFrame([], start_schema), None, math.inf
    for round_ in range(5):
        span = 0.2 / 2.0**round_
        for _ in range(CURVED_PASSES):
            levels = [cut(_both(rows, starts, [*by, CHUNK], linearise(span), map_schema))]
            chunks = top
            while chunks > 0:
                parts = levels[-1].withColumn("_part", col(CHUNK)).withColumn(CHUNK, F.floor(col(CHUNK) / FAN_IN))
                levels.append(cut(parts.groupBy(*by, CHUNK).applyInPandas(compose, map_schema)))
                chunks //= FAN_IN
            best = cut(per_segment(levels[-1].drop(CHUNK), by, fields, choose(span)))
            # Down the tree; a node keeps the centre of its grid while the round lasts.
            starts = best.select(*by, "_starts", col("_centre").alias("_theta"), col("_theta").alias("_best"), "_chosen", F.lit(0).cast("long").alias(CHUNK))
            for level in reversed(levels):
                node = F.floor(col(CHUNK) / FAN_IN) if level is not levels[-1] else F.lit(0).cast("long")
                parts = level.withColumn("_node", node)
                starts = cut(_both(parts, starts.withColumnRenamed(CHUNK, "_node"), [*by, "_node"], hand_down, start_schema))
            gap = starts.agg(F.max("_gap")).first()[0]
            if gap <= STILL:
                break
        if round_ == 4:
            break
        # The next, finer grid lies round the best weights and starts from their states.
        own = F.slice(col("_starts"), col("_chosen") * size + 1, size)
        starts = cut(starts.withColumns({"_starts": own, "_theta": col("_best")}))

    def forecast_rows(r):
        for h, value in enumerate(curved.forecast(np.array(r["_state"]), steps), 1):
            yield {"step": h, "forecast": value}

    warnings = [] if gap <= STILL else [F.lit("The start states of some series had not come to rest.")]
    return _smoothed(best, by, forecast_rows, *warnings)
