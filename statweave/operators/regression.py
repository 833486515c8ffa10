"""Linear, polynomial, robust, logistic, Poisson and negative binomial regression.

Each fit needs only cross products: one aggregate pass for the coefficients of
a linear model, one more for its residual diagnostics, and one per step of the
iteratively reweighted ones.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statweave.functions import dist
from statweave.functions.columns import col, known, num, p_format, present, raw_label, require, text_list
from statweave.functions.tails import chi2_sf
from statweave.operators.anova import COEF_FIELDS, coefficient_table
from statweave.operators.groups import as_list, side_by_side
from statweave.plans.gram import Moments, dot, gram, solve
from statweave.plans.positions import HALO, chunk_window, chunked, positions
from statweave.plans.tables import attach, cut, per_segment
from statweave.result import StatResult

Y = "_y"


def design(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str], keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Complete numeric rows: outcome ``_y`` and predictors ``_x0``...; plus columns to keep."""
    require(df, y, *xs, *by, *keep)
    names = [f"_x{i}" for i in range(len(xs))]
    rows = df.where(present(df, y, *xs)).select(
        *[col(b) for b in by],
        num(df, y).alias(Y),
        *[num(df, x).alias(n) for x, n in zip(xs, names)],
        *[col(k).alias(f"_keep{i}") for i, k in enumerate(keep)],
    )
    return rows, names


class LinearFit:
    """Least squares from the moments of (x..., y)."""

    def __init__(self, m: Moments):
        p = len(m.mean) - 1
        self.n, self.p = m.n, p
        self.sxx, sxy, self.syy = m.cross[:p, :p], m.cross[:p, p], float(m.cross[p, p])
        self.inverse = solve(self.sxx)
        self.slope = self.inverse @ sxy
        self.xbar = m.mean[:p]
        self.intercept = float(m.mean[p] - self.xbar @ self.slope)
        self.rss = max(0.0, float(self.syy - self.slope @ sxy))
        self.dof = self.n - p - 1
        self.sigma2 = self.rss / self.dof if self.dof > 0 else math.nan
        # Covariance factor of (intercept, slopes).
        self.unscaled = np.zeros((p + 1, p + 1))
        self.unscaled[1:, 1:] = self.inverse
        self.unscaled[0, 1:] = self.unscaled[1:, 0] = -self.inverse @ self.xbar
        self.unscaled[0, 0] = 1 / self.n + self.xbar @ self.inverse @ self.xbar

    @property
    def beta(self) -> np.ndarray:
        return np.concatenate([[self.intercept], self.slope])

    def statistics(self) -> dict:
        n, p = self.n, self.p
        r2 = 1 - self.rss / self.syy if self.syy > 0 else math.nan
        f = ((self.syy - self.rss) / p) / self.sigma2 if self.sigma2 > 0 else math.nan
        llf = -n / 2 * (math.log(2 * math.pi * self.rss / n) + 1) if self.rss > 0 else math.nan
        return {
            "r2": r2,
            "r2_adj": 1 - (1 - r2) * (n - 1) / self.dof if self.dof > 0 else math.nan,
            "fvalue": f,
            "f_pvalue": dist.f_sf(f, p, self.dof) if f == f else math.nan,
            "aic": 2 * (p + 1) - 2 * llf,
            "bic": math.log(n) * (p + 1) - 2 * llf,
            "n": n,
            "df_model": float(p),
            "df_resid": float(self.dof),
            "residual_std": math.sqrt(self.sigma2) if self.sigma2 == self.sigma2 else math.nan,
        }


FIT_FIELDS = [("_beta", "array<double>"), ("_xbar", "array<double>"), ("_inverse", "array<double>"), ("_n", "long")]
STAT_FIELDS = [
    ("r2", "double"),
    ("r2_adj", "double"),
    ("fvalue", "double"),
    ("f_pvalue", "double"),
    ("aic", "double"),
    ("bic", "double"),
    ("n", "long"),
    ("df_model", "double"),
    ("df_resid", "double"),
    ("residual_std", "double"),
]


def _enough(m: Moments) -> bool:
    return m.ok and m.n >= len(m.mean) + 2


def residuals(rows: DataFrame, names: list[str], table: DataFrame, by: list[str]) -> DataFrame:
    """Rows with fitted value ``_fit``, residual ``_e`` and leverage ``_h``."""

    def finish(r):
        m = Moments(r)
        if _enough(m):
            f = LinearFit(m)
            yield {"_beta": f.beta.tolist(), "_xbar": f.xbar.tolist(), "_inverse": f.inverse.ravel().tolist(), "_n": f.n}

    fits = per_segment(table, by, FIT_FIELDS, finish)
    if not by and fits.isEmpty():
        raise ValueError("Not enough complete rows.")
    p = len(names)
    joined = attach(rows, fits, by)
    fitted = dot([col(n) for n in names], [F.col("_beta")[i + 1] for i in range(p)]) + F.col("_beta")[0]
    away = [col(n) - F.col("_xbar")[i] for i, n in enumerate(names)]
    leverage = F.lit(1.0) / F.col("_n")
    for i in range(p):
        leverage = leverage + away[i] * dot(away, [F.col("_inverse")[i * p + j] for j in range(p)])
    return joined.withColumn("_fit", fitted).withColumn("_e", col(Y) - F.col("_fit")).withColumn("_h", leverage).drop(
        "_beta", "_xbar", "_inverse", "_n"
    )


def _diagnostics(resid: DataFrame, names: list[str], by: list[str], order: list[str]) -> DataFrame:
    """Jarque–Bera, Breusch–Pagan and (with a row order) Durbin–Watson per segment."""
    e = F.col("_e")
    shape = resid.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.skewness("_e").alias("_g1"), F.kurtosis("_e").alias("_g2"))
    jb = F.col("_n") / 6.0 * (F.col("_g1") * F.col("_g1") + F.col("_g2") * F.col("_g2") / 4)
    shape = shape.select(*by, jb.alias("jarque_bera"), chi2_sf(jb, F.lit(2)).alias("jarque_bera_p"))

    def bp_row(r):
        m = Moments(r)
        if _enough(m):
            lm = m.n * (1 - LinearFit(m).rss / m.cross[-1, -1]) if m.cross[-1, -1] > 0 else None
            yield {"breusch_pagan": lm, "breusch_pagan_p": None if lm is None else dist.chi2_sf(lm, len(names))}

    squares = resid.select(*[col(b) for b in by], *names, (e * e).alias("_e2"))
    bp = per_segment(gram(squares, [*names, "_e2"], by), by, [("breusch_pagan", "double"), ("breusch_pagan_p", "double")], bp_row)
    out = side_by_side(shape, bp, by)
    if order:
        placed = chunked(positions(resid.select(*[col(b) for b in by], "_e", *order), order, by), 1)
        step = F.col("_e") - F.lag("_e").over(chunk_window(by))
        moved = placed.withColumn("_step", step).where(~F.col(HALO))
        dw = moved.groupBy(*by).agg(F.try_divide(F.sum(F.col("_step") * F.col("_step")), F.sum(e * e)).alias("durbin_watson"))
        return side_by_side(out, dw, by)
    return out.withColumn("durbin_watson", F.lit(None).cast("double"))


def _vif_rows(xs: list[str]):
    def finish(r):
        m = Moments(r)
        if not _enough(m):
            return
        p = len(xs)
        d = np.sqrt(np.diag(m.cross)[:p])
        d = np.where(d > 0, d, 1.0)
        factors = np.diag(np.linalg.pinv(m.cross[:p, :p] / np.outer(d, d), hermitian=True))
        for x, v in zip(xs, factors):
            yield {"term": x, "VIF": v}

    return finish


def linear_regression(
    df: DataFrame,
    y: str,
    x: str | Sequence[str],
    robust: bool = False,
    order_by: str | Sequence[str] | None = None,
    by: Sequence[str] = (),
    method: str | None = None,
) -> StatResult:
    """Least squares with the usual table and diagnostics; HC3 errors when ``robust``."""
    by, xs = list(by), as_list(x)
    if not xs:
        raise ValueError("Name at least one predictor.")
    keep = as_list(order_by)
    rows, names = design(df, y, xs, by, keep)
    table = cut(gram(rows, [*names, Y], by))
    if not by and not _enough(Moments(table.first().asDict(recursive=True))):
        raise ValueError("Not enough complete rows.")
    resid = residuals(rows, names, table, by)
    terms = ["const", *xs]

    def stat_row(r):
        m = Moments(r)
        if _enough(m):
            yield LinearFit(m).statistics()

    def coef_rows(r):
        m = Moments(r)
        if _enough(m):
            f = LinearFit(m)
            yield from coefficient_table(terms, f.beta, np.sqrt(np.clip(np.diag(f.unscaled) * f.sigma2, 0, None)), f.dof)

    stats = per_segment(table, by, STAT_FIELDS, stat_row)
    if robust:
        stats, coefficients = _hc3(resid, names, table, stats, terms, by)
    else:
        coefficients = per_segment(table, by, COEF_FIELDS, coef_rows)
    both = side_by_side(stats, _diagnostics(resid, names, by, [f"_keep{i}" for i in range(len(keep))]), by)
    vif = per_segment(table, by, [("term", "string"), ("VIF", "double")], _vif_rows(xs)) if len(xs) >= 2 else None
    notes = [
        F.when(F.col("breusch_pagan_p") < 0.05, F.concat(F.lit("Breusch–Pagan p="), p_format(F.col("breusch_pagan_p")), F.lit(": the residual spread is not constant."))),
        F.when(F.col("n") < 10 * (len(xs) + 1), F.lit("Fewer than 10 rows per parameter.")),
    ]
    if vif is not None:
        worst = vif.groupBy(*by).agg(F.max("VIF").alias("_vif"))
        both = side_by_side(both, worst, by)
        notes.insert(0, F.when(F.col("_vif") > 5, F.lit("Predictors overlap (VIF above 5).")))
    stats = both.withColumn("warnings", text_list(*notes)).drop("_vif")
    name = method or ("robust_regression" if robust else "multiple_regression" if len(xs) > 1 else "linear_regression")
    label = {
        "robust_regression": "Robust linear regression (HC3)",
        "multiple_regression": "Multiple linear regression",
        "linear_regression": "Simple linear regression",
    }.get(name, "Linear regression")
    tables = {"coefficients": coefficients}
    if vif is not None:
        tables["vif"] = vif
    return StatResult(name, label, stats, tables, formula=f"{y} ~ " + " + ".join(xs), by=by)


def _hc3(resid: DataFrame, names: list[str], table: DataFrame, stats: DataFrame, terms: list[str], by: list[str]):
    """Sandwich errors: the meat is one more weighted cross product."""
    scaled = F.col("_e") / (1 - F.col("_h"))
    weighted = resid.select(*[col(b) for b in by], *names, (scaled * scaled).alias("_w"))
    meat = gram(weighted, names, by, weight="_w").select(*by, F.col("w").alias("_mw"), F.col("s").alias("_ms"), F.col("q").alias("_mq"), F.col("c").alias("_mc"))
    both = side_by_side(table, meat, by)
    p = len(names)

    def covariance(r):
        m = Moments(r)
        if not _enough(m):
            return None
        f = LinearFit(m)
        q = np.zeros((p + 1, p + 1))
        q[0, 0] = r["_mw"]
        q[0, 1:] = q[1:, 0] = np.array(r["_ms"], float)
        inner = np.zeros((p, p))
        inner[np.triu_indices(p)] = np.array(r["_mq"], float)
        q[1:, 1:] = inner + np.triu(inner, 1).T
        # The sums are around c; move them back to the raw columns.
        move = np.eye(p + 1)
        move[1:, 0] = np.array(r["_mc"], float)
        return f, f.unscaled @ (move @ q @ move.T) @ f.unscaled

    def coef_rows(r):
        got = covariance(r)
        if got:
            f, cov = got
            yield from coefficient_table(terms, f.beta, np.sqrt(np.clip(np.diag(cov), 0, None)))

    def wald_row(r):
        got = covariance(r)
        if got:
            f, cov = got
            value = float(f.slope @ solve(cov[1:, 1:], f.slope)) / p
            yield {**f.statistics(), "fvalue": value, "f_pvalue": dist.f_sf(value, p, f.dof)}

    return per_segment(both, by, STAT_FIELDS, wald_row), per_segment(both, by, COEF_FIELDS, coef_rows)


def robust_regression(df: DataFrame, y: str, x: str | Sequence[str], order_by=None, by: Sequence[str] = ()) -> StatResult:
    return linear_regression(df, y, x, True, order_by, by)


def multiple_regression(df: DataFrame, y: str, x: str | Sequence[str], robust: bool = False, order_by=None, by: Sequence[str] = ()) -> StatResult:
    return linear_regression(df, y, x, robust, order_by, by)


def polynomial_regression(df: DataFrame, y: str, x: str, degree: int = 2, order_by=None, by: Sequence[str] = ()) -> StatResult:
    powers = {f"{x}^{d}": F.pow(num(df, x), F.lit(float(d))) for d in range(2, int(degree) + 1)}
    out = linear_regression(df.withColumns(powers) if powers else df, y, [x, *powers], False, order_by, by, "polynomial_regression")
    out.label, out.formula = f"Polynomial regression (degree {degree})", f"{y} ~ poly({x}, {degree})"
    return out


# -- iteratively reweighted fits -------------------------------------------------

MAX_STEPS = 35
TOLERANCE = 1e-9


class Family:
    """Mean, Newton weight and log-likelihood term as column expressions of the linear predictor."""

    def __init__(self, kind: str):
        self.kind = kind

    def mean(self, eta: Column) -> Column:
        return 1 / (1 + F.exp(-eta)) if self.kind == "logit" else F.exp(eta)

    def weight(self, mu: Column) -> Column:
        if self.kind == "logit":
            return mu * (1 - mu)
        return mu if self.kind == "poisson" else mu / (1 + mu)

    def slope(self, y: Column, mu: Column) -> Column:
        """Derivative of the log-likelihood in the linear predictor."""
        return (y - mu) / (1 + mu) if self.kind == "negbin" else y - mu

    def likelihood(self, y: Column, eta: Column, mu: Column) -> Column:
        if self.kind == "logit":
            return y * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta)))
        if self.kind == "poisson":
            return y * eta - mu  # minus ln(y!), added from the counts of y
        return y * (eta - F.log1p(mu)) - F.log1p(mu)

    def deviance(self, y: Column, mu: Column) -> Column:
        log_ratio = F.when(y > 0, y * F.ln(F.when(y > 0, y) / mu)).otherwise(F.lit(0.0))
        if self.kind == "poisson":
            return 2 * (log_ratio - (y - mu))
        return 2 * (log_ratio - (y + 1) * F.ln((1 + y) / (1 + mu)))

    def variance(self, mu: Column) -> Column:
        return mu if self.kind == "poisson" else mu + mu * mu

    def start(self, share: float) -> float:
        share = min(max(share, 1e-12), 1 - 1e-12) if self.kind == "logit" else max(share, 1e-12)
        return math.log(share / (1 - share)) if self.kind == "logit" else math.log(share)


def _unpack(q: Sequence[float], p: int) -> np.ndarray:
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = np.array(q, float)
    return m + np.triu(m, 1).T


def _newton(rows: DataFrame, names: list[str], family: Family, by: list[str]) -> DataFrame:
    """Coefficients per segment: by..., beta, cov (both for raw predictors), steps, converged, n, mean_y.

    Predictors are standardised with the segment's own mean and deviation.  One
    aggregate per step covers all segments; segments that have converged repeat
    their step unchanged.
    """
    p = len(names) + 1
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(Y).alias("_ybar"),
        F.array(*[F.avg(n) for n in names]).alias("_m"),
        F.array(*[F.coalesce(F.nullif(F.stddev_pop(n), F.lit(0.0)), F.lit(1.0)) for n in names]).alias("_s"),
    )
    start = per_segment(
        base,
        by,
        [("_n", "long"), ("_ybar", "double"), ("_m", "array<double>"), ("_s", "array<double>"), ("_b", "array<double>"), ("_done", "boolean"), ("_steps", "int")],
        lambda r: [] if not r["_n"] else [{**{k: r[k] for k in ("_n", "_ybar")}, "_m": list(r["_m"]), "_s": list(r["_s"]), "_b": [family.start(r["_ybar"])] + [0.0] * (p - 1), "_done": False, "_steps": 0}],
    )
    state = cut(start)
    total = state.agg(F.sum("_n")).first()[0] or 0
    if not total:
        raise ValueError("Not enough complete rows.")
    return _steps(rows, names, family, by, state)


def _eta(names: list[str]) -> tuple[list[Column], Column]:
    x = [F.lit(1.0), *[(col(n) - F.col("_m")[i]) / F.col("_s")[i] for i, n in enumerate(names)]]
    return x, dot(x, [F.col("_b")[i] for i in range(len(x))])


STATE_FIELDS = [("_n", "long"), ("_ybar", "double"), ("_m", "array<double>"), ("_s", "array<double>"), ("_b", "array<double>"), ("_done", "boolean"), ("_steps", "int"), ("_cov", "array<double>")]


def _steps(rows: DataFrame, names: list[str], family: Family, by: list[str], state: DataFrame) -> DataFrame:
    p = len(names) + 1
    keep = ["_n", "_ybar", "_m", "_s", "_b", "_done", "_steps"]
    for _ in range(MAX_STEPS):
        x, eta = _eta(names)
        joined = attach(rows, state.select(*by, "_m", "_s", "_b"), by).withColumn("_eta", eta)
        mu = family.mean(F.col("_eta"))
        staged = joined.withColumn("_mu", mu).withColumns({"_wt": family.weight(F.col("_mu")), "_g": family.slope(col(Y), F.col("_mu"))})
        sums = staged.groupBy(*by).agg(
            F.array(*[F.sum(F.col("_g") * xi) for xi in x]).alias("_score"),
            F.array(*[F.sum(F.col("_wt") * x[i] * x[j]) for i in range(p) for j in range(i, p)]).alias("_info"),
        )

        def advance(r):
            info = _unpack(r["_info"], p)
            inverse = solve(info)
            step = inverse @ np.array(r["_score"], float)
            size = float(np.max(np.abs(step)))
            if size > 5:
                step *= 5 / size
            b = np.array(r["_b"], float)
            done = bool(np.max(np.abs(step) / (1 + np.abs(b))) < TOLERANCE)
            fresh = b if r["_done"] else b + step
            yield {
                **{k: r[k] for k in ("_n", "_ybar")},
                "_m": list(r["_m"]),
                "_s": list(r["_s"]),
                "_b": fresh.tolist(),
                "_done": bool(r["_done"]) or done,
                "_steps": int(r["_steps"]) + (0 if r["_done"] else 1),
                "_cov": inverse.ravel().tolist(),
            }

        state = cut(per_segment(side_by_side(state.select(*by, *keep), sums, by), by, STATE_FIELDS, advance))
        if state.where("not _done").isEmpty():
            break
    return state


def _raw_scale(r: dict, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and covariance for the columns as given, intercept first."""
    move = np.eye(p)
    s, m = np.array(r["_s"], float), np.array(r["_m"], float)
    move[1:, 1:] = np.diag(1 / s)
    move[0, 1:] = -m / s
    return move @ np.array(r["_b"], float), move @ np.array(r["_cov"], float).reshape(p, p) @ move.T


def _model_sums(rows: DataFrame, names: list[str], family: Family, state: DataFrame, by: list[str]) -> DataFrame:
    _, eta = _eta(names)
    joined = attach(rows, state.select(*by, "_m", "_s", "_b"), by).withColumn("_eta", eta)
    joined = joined.withColumn("_mu", family.mean(F.col("_eta")))
    y, mu = col(Y), F.col("_mu")
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(Y).alias("_ybar"), F.sum(family.likelihood(y, F.col("_eta"), mu)).alias("llf")]
    if family.kind != "logit":
        aggs += [F.sum(family.deviance(y, mu)).alias("deviance"), F.sum((y - mu) * (y - mu) / family.variance(mu)).alias("pearson_chi2")]
    return joined.groupBy(*by).agg(*aggs)


def _binary(df: DataFrame, y: str) -> Column:
    """0/1 outcome; two other numeric values, or two labels, map in sorted order."""
    numbers = num(df, y)
    seen = df.select(numbers.alias("v"), raw_label(known(df, y)).alias("t")).agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"), F.count("t").alias("m"), F.min("t").alias("t0"), F.max("t").alias("t1"),
    ).first()
    if seen["m"] and not seen["n"]:
        text = raw_label(known(df, y))
        other = df.where(text.isNotNull() & ~text.isin(seen["t0"], seen["t1"])).isEmpty()
        if not other or seen["t0"] == seen["t1"]:
            raise ValueError("The outcome must be binary.")
        return F.when(text == seen["t0"], 0.0).when(text == seen["t1"], 1.0)
    lo, hi = seen["lo"], seen["hi"]
    if lo is None or not df.where(numbers.isNotNull() & ~numbers.isin(lo, hi)).isEmpty():
        raise ValueError("The outcome must be binary.")
    if lo in (0.0, 1.0) and hi in (0.0, 1.0):
        return numbers
    return F.when(numbers == lo, 0.0).when(numbers == hi, 1.0)


def logistic_regression(df: DataFrame, y: str, x: str | Sequence[str], by: Sequence[str] = ()) -> StatResult:
    by, xs = list(by), as_list(x)
    require(df, y, *xs, *by)
    rows, names = design(df.withColumn("_binary", _binary(df, y)), "_binary", xs, by)
    family, terms, p = Family("logit"), ["const", *xs], len(xs) + 1
    state = _newton(rows, names, family, by)
    sums = side_by_side(_model_sums(rows, names, family, state, by), state.select(*by, "_done"), by)

    def coef_rows(r):
        beta, cov = _raw_scale(r, p)
        for row in coefficient_table(terms, beta, np.sqrt(np.clip(np.diag(cov), 0, None))):
            yield {**row, "z": row["t"], "or": _exp(row["coef"]), "or_ci95_low": _exp(row["ci95_low"]), "or_ci95_high": _exp(row["ci95_high"])}

    fields = [(f, "double") for f in ("coef", "se", "z", "p_value", "or", "or_ci95_low", "or_ci95_high")]
    n, share, llf = F.col("n"), F.col("_ybar"), F.col("llf")
    null = n * (F.when(share > 0, share * F.ln(F.when(share > 0, share))).otherwise(0.0) + F.when(share < 1, (1 - share) * F.ln(F.when(share < 1, 1 - share))).otherwise(0.0))
    stats = sums.select(
        *by,
        (1 - F.try_divide(llf, null)).alias("prsquared"),
        (2 * p - 2 * llf).alias("aic"),
        (F.ln(n) * p - 2 * llf).alias("bic"),
        llf,
        n,
        F.col("_done").alias("converged"),
        text_list(F.when(~F.col("_done"), F.lit("The fit did not converge; the outcome may be separable."))).alias("warnings"),
    )
    table = per_segment(state, by, [("term", "string"), *fields], coef_rows)
    return StatResult("logistic_regression", "Logistic regression", stats, {"coefficients": table}, formula=f"logit(P({y}=1)) ~ " + " + ".join(xs), by=by)


def _exp(v: float) -> float:
    return math.exp(v) if v < 700 else math.inf


@F.pandas_udf(T.DoubleType())
def _log_factorial(y: pd.Series) -> pd.Series:
    return y.map(lambda v: math.lgamma(v + 1.0)).astype("float64")


def _count_model(df: DataFrame, y: str, x: str | Sequence[str], by: Sequence[str], kind: str):
    by, xs = list(by), as_list(x)
    rows, names = design(df, y, xs, by)
    family, terms, p = Family(kind), ["const", *xs], len(xs) + 1
    state = _newton(rows, names, family, by)
    sums = _model_sums(rows, names, family, state, by)

    def coef_rows(r):
        beta, cov = _raw_scale(r, p)
        yield from coefficient_table(terms, beta, np.sqrt(np.clip(np.diag(cov), 0, None)))

    return by, rows, p, sums, per_segment(state, by, COEF_FIELDS, coef_rows)


def poisson_regression(df: DataFrame, y: str, x: str | Sequence[str], by: Sequence[str] = ()) -> StatResult:
    by, rows, p, sums, table = _count_model(df, y, x, by, "poisson")
    # ln(y!) is evaluated once per distinct count.
    counts = rows.groupBy(*by, Y).agg(F.count(F.lit(1)).alias("_c"))
    factorials = counts.groupBy(*by).agg(F.sum(F.col("_c") * _log_factorial(col(Y))).alias("_lf"))
    n, dev = F.col("n"), F.col("deviance")
    dispersion = dev / F.greatest(n - p, F.lit(1))
    stats = side_by_side(sums, factorials, by).select(
        *by,
        dev,
        "pearson_chi2",
        dispersion.alias("dispersion"),
        (2 * p - 2 * (F.col("llf") - F.col("_lf"))).alias("aic"),
        n,
        text_list(
            F.when(dispersion > 1.5, F.concat(F.lit("Deviance/df = "), F.format_string("%.2f", dispersion), F.lit(": counts vary more than Poisson; see the negative binomial model.")))
        ).alias("warnings"),
    )
    return StatResult("poisson_regression", "Poisson regression", stats, {"coefficients": table}, formula=f"log(E[{y}]) ~ " + " + ".join(as_list(x)), by=by)


def negative_binomial(df: DataFrame, y: str, x: str | Sequence[str], by: Sequence[str] = ()) -> StatResult:
    """Log link with the dispersion parameter fixed at 1; the gamma terms of the likelihood then cancel."""
    by, _, p, sums, table = _count_model(df, y, x, by, "negbin")
    stats = sums.select(*by, "deviance", (2 * p - 2 * F.col("llf")).alias("aic"), "n", text_list().alias("warnings"))
    return StatResult("negative_binomial", "Negative binomial regression", stats, {"coefficients": table}, by=by)

