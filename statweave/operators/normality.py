"""Shapiro–Wilk, Anderson–Darling and Kolmogorov–Smirnov tests of normality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.functions import dist
from statweave.functions.columns import col, num, require, text_list
from statweave.functions.tails import kolmogorov_sf, norm_cdf, norm_logcdf, shapiro_scores
from statweave.operators.groups import Y, as_list, outcome
from statweave.plans.ranks import cut_points, running
from statweave.plans.tables import attach, failing, per_segment
from statweave.result import StatResult

# The published fit of the Shapiro–Wilk p-value ends here.
SHAPIRO_FIT = 5_000
# Upper points of the Anderson–Darling statistic (mean and variance estimated).
AD_LEVELS = (15.0, 10.0, 5.0, 2.5, 1.0)
AD_POINTS = (0.576, 0.656, 0.787, 0.918, 1.092)


def shapiro_table(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, W and p per segment of ``_y``, from all rows.

    The weights depend on rank and n alone.  Ties are collapsed, ranks come from
    running counts, and a value of many rows takes the sum of their weights.
    """
    by = list(by)
    data = values.select(*[col(b) for b in by], Y)
    base = data.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), (F.var_samp(Y) * (F.count(F.lit(1)) - 1)).alias("_squares"), F.avg(Y).alias("_mean")
    )
    counts = data.groupBy(*by, Y).agg(F.count(F.lit(1)).alias("n"))
    ran = attach(running(counts, Y, ["n"], by, cut_points(data, Y), unique=True), base, by)
    # The values at the second and the last but one rank, counting ties.
    second = F.min(F.when(F.col("n_before") + F.col("n") >= 2, col(Y)))
    next_ = F.max(F.when(F.col("n_before") <= F.col("_n") - 2, col(Y)))
    scored = ran.withColumn("_score", shapiro_scores(F.col("_n"), F.col("n_before"), F.col("n")) * (col(Y) - F.col("_mean")))
    facts = scored.groupBy(*by).agg(
        F.first("_n").alias("n"), F.sum("_score").alias("score"), F.first("_squares").alias("squares"),
        F.min(Y).alias("first"), second.alias("second"), next_.alias("next"), F.max(Y).alias("last"),
    )

    def finish(r):
        n = int(r["n"] or 0)
        w, p = dist.shapiro(n, r["score"], r["squares"], (r["first"], r["second"], r["next"], r["last"])) if n >= 3 else (None, None)
        yield {"n": n, "W": w, "p_value": p}

    return per_segment(facts, by, [("n", "long"), ("W", "double"), ("p_value", "double")], finish)


def unpivot_numbers(df: DataFrame, columns: Sequence[str], by: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., keep..., variable, _y) of the known numeric values."""
    require(df, *columns, *by, *keep)
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), num(df, c).alias(Y)) for c in columns])
    return df.select(*[col(b) for b in by], *[col(k) for k in keep], F.inline(pairs)).where(f"{Y} is not null")


def shapiro_wilk(df: DataFrame, column: str | Sequence[str], by: Sequence[str] = ()) -> StatResult:
    """Shapiro–Wilk per column and segment, over all rows."""
    by, columns = list(by), as_list(column)
    values = unpivot_numbers(df, columns, by)
    table = shapiro_table(values, [*by, "variable"])
    ok = F.col("n") >= 3
    far = F.lit(f"the fit of p was published up to n = {SHAPIRO_FIT} and is extrapolated")
    stats = table.select(
        *by,
        "variable",
        failing([*by, *columns[1:]], ok, F.col("W"), "Needs at least 3 values.").alias("W"),
        F.when(ok, F.col("p_value")).alias("p_value"),
        "n",
        text_list(F.when(~ok, F.lit("fewer than 3 observations")), F.when(F.col("n") > SHAPIRO_FIT, far)).alias("warnings"),
    )
    return StatResult("shapiro_wilk", "Shapiro–Wilk normality test", stats, formula="W = (∑ a_i x_(i))² / ∑ (x_i − x̄)²", by=by)


def _standardised(df: DataFrame, column: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct values with count, count below and z score; and n per segment."""
    data = outcome(df, column, by)
    base = data.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.avg(Y).alias("_mean"), F.stddev_samp(Y).alias("_sd"))
    counts = data.groupBy(*by, Y).agg(F.count(F.lit(1)).alias("n"))
    ran = running(counts, Y, ["n"], by, cut_points(data, Y), unique=True)
    z = F.try_divide(col(Y) - F.col("_mean"), F.col("_sd"))
    return attach(ran, base, by).withColumn("_z", z), base


def anderson_darling(df: DataFrame, column: str, by: Sequence[str] = ()) -> StatResult:
    by = list(by)
    rows, _ = _standardised(df, column, by)
    n, t, b = F.col("_n").cast("double"), F.col("n").cast("double"), F.col("n_before").cast("double")
    # Tied values share z; their order-statistic weights add up in closed form.
    below, above = t * (2 * b + t), t * (2 * (n - b) - t)
    terms = rows.select(*by, n.alias("_n"), (below * norm_logcdf(F.col("_z")) + above * norm_logcdf(-F.col("_z"))).alias("_term"))
    table = terms.groupBy(*by).agg(F.max("_n").alias("_n"), F.sum("_term").alias("_s"))
    size = F.col("_n")
    a2 = -size - F.col("_s") / size
    shrink = 1 + 4.0 / size - 25.0 / (size * size)
    critical = [F.round(F.lit(p) / shrink, 3) for p in AD_POINTS]
    stats = table.select(
        *by,
        failing(by, size > 0, a2, f"'{column}' holds no numbers.").alias("A2"),
        *[c.alias(f"critical_{str(level).replace('.', '_')}") for level, c in zip(AD_LEVELS, critical)],
        (a2 > critical[2]).alias("reject_at_5pct"),
        size.cast("long").alias("n"),
        text_list().alias("warnings"),
    )
    return StatResult("anderson_darling", "Anderson–Darling normality test", stats, by=by)


def kolmogorov_smirnov(df: DataFrame, column: str, by: Sequence[str] = ()) -> StatResult:
    by = list(by)
    rows, _ = _standardised(df, column, by)
    staged = rows.select(*by, "_n", "n", "n_before", norm_cdf(F.col("_z")).alias("_p"))
    n = F.col("_n").cast("double")
    gap = F.greatest((F.col("n_before") + F.col("n")) / n - F.col("_p"), F.col("_p") - F.col("n_before") / n)
    table = staged.groupBy(*by).agg(F.max(gap).alias("D"), F.max("_n").alias("n"))
    stats = table.select(
        *by,
        failing(by, F.col("n") > 0, F.col("D"), f"'{column}' holds no numbers.").alias("D"),
        kolmogorov_sf(F.col("D"), F.col("n")).alias("p_value"),
        "n",
        text_list(F.lit("Mean and deviation come from the same sample, so the p-value is too large.")).alias("warnings"),
    )
    return StatResult("kolmogorov_smirnov", "Kolmogorov–Smirnov test (normal)", stats, by=by)
