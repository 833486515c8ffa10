"""Kaplan–Meier, log-rank and Cox regression."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statweave.functions import dist
from statweave.functions.columns import col, drop_missing, known, num, raw_label, require, text_list
from statweave.operators.groups import as_list, side_by_side
from statweave.plans.dominance import dense_rank, ordered_pairs
from statweave.plans.gram import dot, gram, solve
from statweave.plans.ranks import attach_ranks, cut_points, running
from statweave.plans.systems import conjugate_gradients
from statweave.plans.tables import attach, centre, cut, null_safe, per_segment
from statweave.result import StatResult

# Up to so many groups each is a column of the table of times; more are rows of it.
DENSE_GROUPS = 50
# The product runs through logarithms: a curve that reaches one half exactly may land a rounding error above it.
HALF = 0.5 + 1e-12


def _sample(df: DataFrame, duration: str, event: str, group: str | None, by: list[str], xs: Sequence[str] = ()) -> DataFrame:
    require(df, duration, event, *by, *xs, *([group] if group else []))
    label = raw_label(known(df, group)) if group else F.lit("all")
    rows = df.select(
        *[col(b) for b in by],
        num(df, duration).alias("_t"),
        num(df, event).alias("_e"),
        label.alias("_g"),
        *[num(df, x).alias(f"_x{i}") for i, x in enumerate(xs)],
    )
    return drop_missing(rows, ["_t", "_e", *[f"_x{i}" for i in range(len(xs))]])


def survival_curve(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per (by, _g, time): at risk, events, and the product-limit estimate."""
    keys = [*by, "_g"]
    cuts = cut_points(rows, "_t")
    times = rows.groupBy(*keys, "_t").agg(F.count(F.lit(1)).alias("n"), F.sum("_e").alias("events"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    ran = attach(running(times, "_t", ["n"], keys, cuts, unique=True), sizes, keys)
    share = 1 - F.col("events") / (F.col("_all") - F.col("n_before"))
    staged = ran.select(
        *keys,
        "_t",
        (F.col("_all") - F.col("n_before")).alias("at_risk"),
        "events",
        # The product runs as a sum of logs; a factor of zero is carried as a count.
        F.when(share > 0, F.ln(F.when(share > 0, share))).otherwise(F.lit(0.0)).alias("_log"),
        (share <= 0).cast("long").alias("_zero"),
    )
    summed = running(staged, "_t", ["_log", "_zero"], keys, cuts, unique=True)
    alive = F.exp(F.col("_log_before") + F.col("_log"))
    survival = F.when(F.col("_zero_before") + F.col("_zero") > 0, F.lit(0.0)).otherwise(alive)
    return summed.select(*keys, col("_t").alias("time"), "at_risk", "events", survival.alias("survival"))


def kaplan_meier(df: DataFrame, duration: str, event: str, group: str | None = None, by: Sequence[str] = ()) -> StatResult:
    by = list(by)
    rows = _sample(df, duration, event, group, by)
    grouped = rows.where("_g is not null")
    keys = [*by, "_g"]
    curve = cut(survival_curve(grouped, by))
    sizes = grouped.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("_e").cast("long").alias("events"), F.min("_t").alias("_first"))
    halves = curve.groupBy(*keys).agg(F.min(F.when(F.col("survival") <= HALF, F.col("time"))).alias("median_survival"))
    medians = attach(sizes.drop("_first"), halves, keys, "left").withColumnRenamed("_g", "group")
    # Every curve starts at (0, 1).
    origin = sizes.where("_first > 0").select(*keys, F.lit(0.0).alias("time"), F.col("n").alias("at_risk"), F.lit(0.0).alias("events"), F.lit(1.0).alias("survival"))
    full = origin.unionByName(curve).withColumnRenamed("_g", "group")
    stats = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("_e").cast("long").alias("events")).withColumn("warnings", text_list())
    return StatResult("kaplan_meier", "Kaplan–Meier survival", stats, {"medians": medians, "curve": full}, by=by)


def logrank(df: DataFrame, duration: str, event: str, group: str, by: Sequence[str] = ()) -> StatResult:
    """k-sample log-rank test from observed minus expected events over the pooled event times."""
    by = list(by)
    rows = _sample(df, duration, event, group, by).where("_g is not null")
    levels = sorted(r[0] for r in rows.select("_g").distinct().limit(DENSE_GROUPS + 1).collect())
    if len(levels) > DENSE_GROUPS:
        stats = _logrank_of_many(rows, by)
        return StatResult("logrank", "Log-rank test", stats.withColumn("warnings", text_list()), by=by)
    if len(levels) < 2 and not by:
        raise ValueError("Log-rank needs at least 2 groups.")
    k = len(levels)
    counts = [f"_n{j}" for j in range(k)]
    times = rows.groupBy(*by, "_t").agg(
        F.sum("_e").alias("_d"), F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("_g") == v).alias(c) for v, c in zip(levels, counts)]
    )
    risk = running(times, "_t", ["_n", *counts], by, cut_points(rows, "_t"), unique=True, descending=True)
    n = (F.col("_n") + F.col("_n_before")).cast("double")
    shares = risk.where("_d > 0").select(
        *by,
        "_d",
        F.when(n > 1, F.col("_d") * (n - F.col("_d")) / (n - 1)).otherwise(F.lit(0.0)).alias("_w"),
        *[((F.col(c) + F.col(f"{c}_before")) / n).alias(f"_a{j}") for j, c in enumerate(counts)],
    )
    spread = gram(shares, [f"_a{j}" for j in range(k)], by, "_w", [0.0] * k).select(*by, F.col("s").alias("_ws"), F.col("q").alias("_wq"))
    observed = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("_g") == v, F.col("_e"))), F.lit(0.0)) for v in levels]).alias("_o"),
        F.array(*[F.count_if(F.col("_g") == v) for v in levels]).alias("_sizes"),
    )
    expected = shares.groupBy(*by).agg(F.array(*[F.sum(F.col("_d") * F.col(f"_a{j}")) for j in range(k)]).alias("_x"))
    table = side_by_side(side_by_side(observed, expected, by), spread, by)

    def finish(r):
        keep = [j for j, size in enumerate(r["_sizes"]) if size > 0]
        if len(keep) < 2 or r["_x"] is None:
            yield {"chi2": None, "p_value": None, "df": len(keep) - 1, "n": r["n"]}
            return
        gap = np.array(r["_o"], float) - np.array(r["_x"], float)
        q = np.zeros((k, k))
        q[np.triu_indices(k)] = np.array(r["_wq"], float)
        v = np.diag(np.array(r["_ws"], float)) - (q + np.triu(q, 1).T)
        use = keep[:-1]
        chi2 = float(gap[use] @ np.linalg.pinv(v[np.ix_(use, use)]) @ gap[use])
        yield {"chi2": chi2, "p_value": dist.chi2_sf(chi2, len(use)), "df": len(use), "n": r["n"]}

    stats = per_segment(table, by, [("chi2", "double"), ("p_value", "double"), ("df", "long"), ("n", "long")], finish)
    return StatResult("logrank", "Log-rank test", stats.withColumn("warnings", text_list()), by=by)


def _logrank_of_many(rows: DataFrame, by: list[str]) -> DataFrame:
    """The test for any number of groups, from the rows (time, group) alone.

    With n_t at risk, of them n_tj in group j, and w_t the weight of a time, the
    covariance V takes x to x_j sum_t w_t n_tj / n_t - sum_t w_t n_tj s_t / n_t^2, where
    s_t = sum_j n_tj x_j.  A row is at risk up to its time, so s_t is a running sum from
    the last time on and the sums over t are running sums from the first: V is applied
    in two passes over the rows and never written down.  The statistic is
    gap'x with V x = gap, which has a solution as all gaps add up to nothing.
    """
    cells = cut(rows.groupBy(*by, "_t", "_g").agg(F.count(F.lit(1)).alias("_c"), F.sum("_e").alias("_e")))
    cuts = cut_points(cells, "_t")
    times = cells.groupBy(*by, "_t").agg(F.sum("_c").alias("_n"), F.sum("_e").alias("_d"))
    at_risk = (F.col("_n") + F.col("_n_before")).cast("double")
    risk = running(times, "_t", ["_n"], by, cuts, unique=True, descending=True).select(*by, "_t", "_d", at_risk.alias("_r"))
    w = F.when((F.col("_r") > 1) & (F.col("_d") > 0), F.col("_d") * (F.col("_r") - F.col("_d")) / (F.col("_r") - 1)).otherwise(F.lit(0.0))
    risk = cut(risk.select(*by, "_t", w.alias("_w"), "_r", (F.col("_d") / F.col("_r")).alias("_h"), (w / F.col("_r")).alias("_v")))
    summed = running(risk, "_t", ["_h", "_v"], by, cuts, unique=True)
    upto = cut(summed.select(*by, "_t", (F.col("_h") + F.col("_h_before")).alias("_sh"), (F.col("_v") + F.col("_v_before")).alias("_sv")))
    own = null_safe(cells, upto, [*by, "_t"]).groupBy(*by, "_g").agg(F.sum("_e").alias("_o"), F.sum("_c").alias("_size"), F.sum(F.col("_c") * F.col("_sh")).alias("_x"), F.sum(F.col("_c") * F.col("_sv")).alias("_d"))
    groups = cut(own.select(*by, "_g", (F.col("_o") - F.col("_x")).alias("_b"), "_d", "_size"))

    def product(x: DataFrame) -> DataFrame:
        weighted = attach(cells, x, [*by, "_g"]).groupBy(*by, "_t").agg(F.sum(F.col("_c") * F.col("_x")).alias("_s"))
        seen = running(cut(weighted), "_t", ["_s"], by, cuts, unique=True, descending=True).select(*by, "_t", (F.col("_s") + F.col("_s_before")).alias("_s"))
        share = null_safe(risk, seen, [*by, "_t"]).select(*by, "_t", (F.col("_w") * F.col("_s") / (F.col("_r") * F.col("_r"))).alias("_q"))
        total = running(cut(share), "_t", ["_q"], by, cuts, unique=True).select(*by, "_t", (F.col("_q") + F.col("_q_before")).alias("_q"))
        taken = null_safe(cells, total, [*by, "_t"]).groupBy(*by, "_g").agg(F.sum(F.col("_c") * F.col("_q")).alias("_taken"))
        both = null_safe(null_safe(x, groups.select(*by, "_g", "_d"), [*by, "_g"]), taken, [*by, "_g"])
        return both.select(*by, "_g", (F.col("_x") * F.col("_d") - F.col("_taken")).alias("_y"))

    solved = conjugate_gradients(product, groups.select(*by, "_g", "_b", "_d"), by, ["_g"])
    table = null_safe(groups, solved, [*by, "_g"]).groupBy(*by).agg(F.sum(F.col("_b") * F.col("_x")).alias("chi2"), (F.count(F.lit(1)) - 1).alias("df"), F.sum("_size").alias("n"))

    def finish(r):
        tested = r["df"] > 0
        yield {"chi2": r["chi2"] if tested else None, "p_value": dist.chi2_sf(r["chi2"], r["df"]) if tested else None, "df": r["df"], "n": r["n"]}

    return per_segment(table, by, [("chi2", "double"), ("p_value", "double"), ("df", "long"), ("n", "long")], finish)


# -- Cox ------------------------------------------------------------------------

COX_STEPS = 30
# Points of a rule for a block of ties; a block of no more ties than this is summed as it is.
RULE_POINTS = 14


@lru_cache(maxsize=256)
def _block_rule(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights that sum a polynomial over 0, 1, ..., size - 1 exactly up to degree 2 RULE_POINTS - 1.

    The Gauss rule of the discrete uniform measure, from the recurrence of the
    discrete Chebyshev polynomials.
    """
    n = min(size, RULE_POINTS)
    if n == size:
        return np.arange(size, dtype=float), np.ones(size)
    k = np.arange(1, n, dtype=float)
    # In units of the block's half length, so that no power of a large size arises.
    beta = k * k * (1 - (k / size) ** 2) / (4 * k * k - 1)
    points, vectors = np.linalg.eigh(np.diag(np.sqrt(beta), 1) + np.diag(np.sqrt(beta), -1))
    return (size - 1) / 2 + points * size / 2, vectors[0] ** 2 * size


def _tie_rule(d: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares c = l/d and weights that stand for the sum over l = 0, ..., d - 1.

    Counted from the last tie, blocks double.  A denominator s0 - c d0 is no
    less than its distance to the last tie plus one, in steps of d0/d, so it
    changes by a factor of at most two within a block, and the rule's error is
    below 6^-28 of a term, however many ties there are.
    """
    places, weights = [np.zeros(1)], [np.ones(1)]
    start = 1
    while start < d:
        size = min(start, d - start)
        at, w = _block_rule(size)
        places.append(start + at)
        weights.append(w)
        start += size
    return (d - 1 - np.concatenate(places)) / d, np.concatenate(weights)


@F.pandas_udf(T.StructType([T.StructField(k, T.DoubleType()) for k in "labefg"]))
def _efron(s0: pd.Series, d0: pd.Series, d: pd.Series) -> pd.DataFrame:
    """Efron's tie sums per event time: over l < d of log(den), 1/den, c/den, 1/den², c/den², c²/den² with c = l/d, den = s0 - c d0."""
    out = np.zeros((len(s0), 6))
    s, t, n = s0.to_numpy(float), d0.to_numpy(float), d.to_numpy(np.int64)
    for ties in np.unique(n):
        rows = np.flatnonzero(n == ties)
        c, w = _tie_rule(int(ties))
        den = s[rows, None] - c * t[rows, None]
        inv = 1 / den
        out[rows] = np.column_stack([np.log(den) @ w, inv @ w, inv @ (c * w), inv**2 @ w, inv**2 @ (c * w), inv**2 @ (c * c * w)])
    return pd.DataFrame(out, columns=list("labefg"))


def _cox_sums(rows: DataFrame, x: list[str], by: list[str], cuts: Sequence[float], eta: Column) -> DataFrame:
    """Log-likelihood, gradient and information per segment at one coefficient vector."""
    p = len(x)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    staged = rows.withColumn("_eta", eta).withColumn("_r", F.exp("_eta")).withColumn("_dead", F.col("_e") > 0)
    r, dead = F.col("_r"), F.col("_dead")
    risk = {"_s": r, **{f"_s_{i}": r * col(x[i]) for i in range(p)}, **{f"_s_{i}_{j}": r * col(x[i]) * col(x[j]) for i, j in pairs}}
    ties = {k.replace("_s", "_d", 1): F.when(dead, v).otherwise(F.lit(0.0)) for k, v in risk.items()}
    times = staged.groupBy(*by, "_t").agg(
        *[F.sum(v).alias(k) for k, v in {**risk, **ties}.items()],
        F.count_if(dead).alias("_deaths"),
        *[F.sum(F.when(dead, col(x[i])).otherwise(F.lit(0.0))).alias(f"_x_{i}") for i in range(p)],
        F.sum(F.when(dead, F.col("_eta")).otherwise(F.lit(0.0))).alias("_own"),
    )
    ran = running(times, "_t", list(risk), by, cuts, unique=True, descending=True).where("_deaths > 0")
    full = ran.withColumns({k: F.col(k) + F.col(f"{k}_before") for k in risk})
    full = full.withColumn("_k", _efron(F.col("_s"), F.col("_d"), F.col("_deaths")))
    a, b, e, f, g = (F.col(f"_k.{c}") for c in "abefg")

    def s(*i):
        return F.col("_s" + "".join(f"_{k}" for k in i))

    def d(*i):
        return F.col("_d" + "".join(f"_{k}" for k in i))

    gradient = [F.sum(F.col(f"_x_{i}") - (s(i) * a - d(i) * b)) for i in range(p)]
    information = [
        F.sum(s(i, j) * a - d(i, j) * b - (s(i) * s(j) * e - (s(i) * d(j) + s(j) * d(i)) * f + d(i) * d(j) * g)) for i, j in pairs
    ]
    return full.groupBy(*by).agg(F.sum(F.col("_own") - F.col("_k.l")).alias("_llf"), F.array(*gradient).alias("_score"), F.array(*information).alias("_info"))


def cox_ph(df: DataFrame, duration: str, event: str, x: str | Sequence[str], by: Sequence[str] = ()) -> StatResult:
    """Proportional hazards with Efron ties: one grouped pass over the times per Newton step."""
    by, xs = list(by), as_list(x)
    if not xs:
        raise ValueError("Name at least one predictor.")
    rows = _sample(df, duration, event, None, by, xs).drop("_g")
    p = len(xs)
    middle = centre(rows, [f"_x{i}" for i in range(p)])
    names = [f"_z{i}" for i in range(p)]
    scale = rows.agg(*[F.coalesce(F.nullif(F.stddev_pop(f"_x{i}"), F.lit(0.0)), F.lit(1.0)) for i in range(p)]).first()
    rows = rows.select(*[col(b) for b in by], "_t", "_e", *[((F.col(f"_x{i}") - middle[i]) / scale[i]).alias(names[i]) for i in range(p)])
    cuts = cut_points(rows, "_t")
    fields = [("_b", "array<double>"), ("_done", "boolean"), ("_cov", "array<double>"), ("_llf", "double")]
    state = cut(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0").select(*by, F.array(*[F.lit(0.0)] * p).alias("_b"), F.lit(False).alias("_done")))
    if state.isEmpty():
        raise ValueError("No complete rows.")

    def advance(r):
        if r["_score"] is None:
            yield {"_b": [0.0] * p, "_done": True, "_cov": [math.nan] * (p * p), "_llf": None}
            return
        info = np.zeros((p, p))
        info[np.triu_indices(p)] = np.array(r["_info"], float)
        inverse = solve(info + np.triu(info, 1).T)
        step = inverse @ np.array(r["_score"], float)
        size = float(np.max(np.abs(step)))
        if size > 2:
            step *= 2 / size
        b = np.array(r["_b"], float)
        yield {"_b": (b if r["_done"] else b + step).tolist(), "_done": bool(r["_done"]) or size < 1e-9, "_cov": inverse.ravel().tolist(), "_llf": r["_llf"]}

    for _ in range(COX_STEPS):
        joined = attach(rows, state.select(*by, "_b"), by)
        sums = _cox_sums(joined, names, by, cuts, dot([col(n) for n in names], [F.col("_b")[i] for i in range(p)]))
        state = cut(per_segment(side_by_side(state.select(*by, "_b", "_done"), sums, by), by, fields, advance))
        if state.where("not _done").isEmpty():
            break

    def coef_rows(r):
        se = np.sqrt(np.clip(np.diag(np.array(r["_cov"], float).reshape(p, p)), 0, None))
        crit = dist.norm_ppf(0.975)
        for i, name in enumerate(xs):
            b, s = r["_b"][i] / scale[i], se[i] / scale[i]
            z = b / s if s > 0 else math.nan
            yield {
                "covariate": name,
                "coef": b,
                "exp_coef": math.exp(b),
                "se_coef": s,
                "coef_lower_95": b - crit * s,
                "coef_upper_95": b + crit * s,
                "exp_coef_lower_95": math.exp(b - crit * s),
                "exp_coef_upper_95": math.exp(b + crit * s),
                "z": z,
                "p": dist.norm_p(z) if z == z else None,
            }

    table = per_segment(
        state,
        by,
        [("covariate", "string"), *[(f, "double") for f in ("coef", "exp_coef", "se_coef", "coef_lower_95", "coef_upper_95", "exp_coef_lower_95", "exp_coef_upper_95", "z", "p")]],
        coef_rows,
    )
    scored = attach(rows, state.select(*by, "_b"), by)
    scored = scored.select(*by, "_t", "_e", dot([col(n) for n in names], [F.col("_b")[i] for i in range(p)]).alias("_eta"))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    base = side_by_side(side_by_side(sizes, concordance(scored, by, cuts), by), state.select(*by, "_llf", "_done"), by)
    stats = base.select(
        *by,
        "n",
        "concordance",
        F.col("_llf").alias("log_likelihood"),
        F.col("_done").alias("converged"),
        text_list(F.lit("Proportional hazards were not checked.")).alias("warnings"),
    )
    return StatResult("cox_ph", "Cox proportional hazards", stats, {"coefficients": table}, formula="h(t|X) = h0(t) exp(Xβ)", by=by)


def concordance(scored: DataFrame, by: list[str], cuts: Sequence[float]) -> DataFrame:
    """Share of comparable pairs whose earlier event has the higher risk score, ties counting half.

    An event comes before a censoring at the same time; two events at the same
    time are not comparable.
    """
    cells = scored.groupBy(*by, "_t", (F.col("_e") > 0).alias("_dead"), "_eta").agg(F.count(F.lit(1)).alias("_c"))
    ranks = dense_rank(scored, "_t", by, cuts, "_rank")
    ties = scored.groupBy(*by, "_t").agg(F.count(F.lit(1)).alias("ties"))
    ranked = attach_ranks(cells, null_safe(ranks, ties, [*by, "_t"]), "_t", by, max(1, scored.count() // 1000))
    ranked = cut(
        ranked.select(
            *by,
            (F.col("_rank") * 2 + F.when(F.col("_dead"), 0).otherwise(1)).alias("_order"),
            "_eta",
            F.when(F.col("_dead"), F.col("_c")).otherwise(F.lit(0)).alias("_left"),
            F.col("_c").alias("_right"),
        )
    )
    largest = ranked.agg(F.max("_order")).first()[0] or 0
    table = ordered_pairs(ranked, "_order", "_eta", "_left", "_right", int(largest), by)
    agree = F.col("pairs") - F.col("less") - F.col("equal")
    return table.select(*by, F.try_divide(agree + F.col("equal") / 2, F.col("pairs")).alias("concordance"))

