"""Mean, median and rank tests, effect sizes and power."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statweave.functions.columns import col, drop_missing, num, p_format, present, require, text_list
from statweave.functions.tails import (
    chi2_sf,
    mannwhitney_p,
    norm_p,
    t_crit95,
    t_p,
    t_power,
    t_sample_size,
    wilcoxon_p,
)
from statweave.operators.groups import (
    G,
    Y,
    group_medians,
    group_moments,
    grouped,
    hedges,
    levene_table,
    outcome,
    pooled_d,
    side_by_side,
    two_groups,
)
from statweave.plans.quantiles import exact_quantiles
from statweave.plans.ranks import cut_points, midranks
from statweave.plans.tables import attach, cut, failing
from statweave.result import StatResult

WARNINGS_TYPE = "array<string>"


def _mean_interval(n: Column, mean: Column, sd: Column) -> tuple[Column, Column, Column]:
    """Standard error and 95% bounds of a mean; zero width for one value."""
    se = F.when(n > 1, sd / F.sqrt(n)).otherwise(F.lit(0.0))
    half = F.when(n > 1, t_crit95(F.when(n > 1, n - 1)) * se).otherwise(F.lit(0.0))
    return se, mean - half, mean + half


def _effect(name: str, value: Column, magnitude: Column | None = None) -> list[Column]:
    return [
        F.lit(name).alias("effect_name"),
        value.cast("double").alias("effect_value"),
        (F.lit(None).cast("string") if magnitude is None else magnitude).alias("effect_magnitude"),
    ]


def one_sample_t(df: DataFrame, y: str, mu: float = 0.0, by: Sequence[str] = ()) -> StatResult:
    by = list(by)
    base = outcome(df, y, by).groupBy(*by).agg(F.count(Y).alias("n"), F.avg(Y).alias("mean"), F.stddev_samp(Y).alias("sd"))
    n, mean, sd = F.col("n"), F.col("mean"), F.col("sd")
    se, low, high = _mean_interval(n, mean, sd)
    t = F.try_divide(mean - mu, F.try_divide(sd, F.sqrt(n)))
    d = F.coalesce(F.try_divide(mean - mu, sd), F.lit(0.0))
    stats = base.select(
        *by,
        failing(by, n > 0, t, f"'{y}' holds no numbers.").alias("t"),
        t_p(t, F.when(n > 1, n - 1)).alias("p_value"),
        (n - 1).alias("df"),
        mean,
        F.lit(float(mu)).alias("mu0"),
        se.alias("se"),
        low.alias("ci95_low"),
        high.alias("ci95_high"),
        n,
        d.alias("cohens_d"),
        *_effect("Cohen's d", d),
        text_list().alias("warnings"),
    )
    return StatResult("one_sample_t", "One-sample t-test", stats, formula="t = (x̄ − μ₀) / (s/√n)", by=by)


def z_test(df: DataFrame, y: str, mu: float = 0.0, sigma: float | None = None, by: Sequence[str] = ()) -> StatResult:
    by = list(by)
    base = outcome(df, y, by).groupBy(*by).agg(F.count(Y).alias("n"), F.avg(Y).alias("mean"), F.stddev_samp(Y).alias("sd"))
    n, mean = F.col("n"), F.col("mean")
    s = F.lit(float(sigma)) if sigma else F.col("sd")
    z = F.try_divide(mean - mu, F.try_divide(s, F.sqrt(n)))
    warn = text_list() if sigma else text_list(
        F.lit("The standard deviation was taken from the sample; a t test accounts for that.")
    )
    stats = base.select(
        *by,
        failing(by, n > 0, z, f"'{y}' holds no numbers.").alias("z"),
        norm_p(z).alias("p_value"),
        mean,
        F.lit(float(mu)).alias("mu0"),
        s.alias("sigma"),
        n,
        warn.alias("warnings"),
    )
    return StatResult("z_test", "One-sample z-test", stats, formula="z = (x̄ − μ₀) / (σ/√n)", by=by)


def paired_t(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> StatResult:
    by = list(by)
    require(df, y, x, *by)
    diff = df.where(present(df, y, x)).select(*[col(b) for b in by], (num(df, y) - num(df, x)).alias("_d"))
    base = diff.groupBy(*by).agg(F.count("_d").alias("n"), F.avg("_d").alias("mean_diff"), F.stddev_samp("_d").alias("sd_diff"))
    n, mean, sd = F.col("n"), F.col("mean_diff"), F.col("sd_diff")
    ok = n >= 3
    _, low, high = _mean_interval(n, mean, sd)
    t = F.try_divide(mean, sd / F.sqrt(n))
    d = F.coalesce(F.try_divide(mean, sd), F.lit(0.0))
    stats = base.select(
        *by,
        failing(by, ok, t, "Needs at least 3 complete pairs.").alias("t"),
        t_p(F.when(ok, t), n - 1).alias("p_value"),
        (n - 1).alias("df"),
        mean,
        sd,
        low.alias("ci95_low"),
        high.alias("ci95_high"),
        n,
        F.when(ok, d).alias("cohens_d"),
        *_effect("Cohen's d (paired)", F.when(ok, d)),
        text_list(F.when(~ok, F.lit("fewer than 3 paired observations"))).alias("warnings"),
    )
    return StatResult("paired_t", "Paired t-test", stats, formula="t = d̄ / (s_d / √n)", by=by)


def independent_t(
    df: DataFrame,
    y: str,
    x: str,
    levels: Sequence[str] | None = None,
    equal_var: bool | None = None,
    by: Sequence[str] = (),
) -> StatResult:
    """Student's t test, or Welch's when Levene finds unequal variances and none was asked for."""
    by = list(by)
    data = grouped(df, y, x, by, levels)
    pair = two_groups(group_moments(data, by), by)
    both = side_by_side(pair, levene_table(data, by), by)
    n1, n2, v1, v2 = (F.col(c) for c in ("n_1", "n_2", "var_1", "var_2"))
    gap = F.col("mean_1") - F.col("mean_2")
    unequal = F.coalesce(F.col("levene_p") < 0.05, F.lit(False))
    equal = ~unequal if equal_var is None else F.lit(bool(equal_var))
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    student = F.try_divide(gap, F.sqrt(pooled * (1 / n1 + 1 / n2)))
    a, b = v1 / n1, v2 / n2
    welch = F.try_divide(gap, F.sqrt(a + b))
    welch_df = F.try_divide((a + b) * (a + b), F.try_divide(a * a, (n1 - 1).cast("double")) + F.try_divide(b * b, (n2 - 1).cast("double")))
    two = F.col("n_groups") == 2
    enough = two & (n1 + n2 > 2)
    t = F.when(enough, F.when(equal, student).otherwise(welch))
    dof = F.when(enough, F.when(equal, (n1 + n2 - 2).cast("double")).otherwise(welch_df))
    staged = both.select(
        "*",
        equal.alias("equal_var"),
        F.when(two, pooled_d()).alias("cohens_d"),
        failing(by, two, t, "Needs exactly 2 groups.").alias("t"),
        dof.alias("df"),
    )
    d = F.col("cohens_d")
    stats = staged.select(
        *by,
        "t",
        t_p(F.col("t"), F.col("df")).alias("p_value"),
        "df",
        "equal_var",
        "levene_W",
        "levene_p",
        "mean_1",
        "mean_2",
        F.sqrt(v1).alias("sd_1"),
        F.sqrt(v2).alias("sd_2"),
        "n_1",
        "n_2",
        "group_1",
        "group_2",
        F.when(two, gap).alias("mean_diff"),
        d,
        hedges(d, n1 + n2).alias("hedges_g"),
        (n1 + n2).alias("n"),
        *_effect("Cohen's d", d),
        text_list(
            F.when(~two, F.lit("requires exactly 2 groups")),
            F.when(
                unequal,
                F.when(F.col("equal_var"), F.concat(F.lit("Levene p="), p_format(F.col("levene_p")), F.lit("; the Welch form may fit better."))).otherwise(
                    F.concat(F.lit("Unequal variances by Levene (p="), p_format(F.col("levene_p")), F.lit("); the Welch form is given."))
                ),
            ),
            F.when(F.least(n1, n2) < 15, F.lit("A group has fewer than 15 rows; its shape matters for this test.")),
        ).alias("warnings"),
    )
    return StatResult("independent_t", "Independent-samples t-test", stats, formula="t = (x̄₁ − x̄₂) / (s_p √(1/n₁+1/n₂)), or Welch's form", by=by)


def levene(df: DataFrame, y: str, x: str, levels: Sequence[str] | None = None, by: Sequence[str] = (), normalize: bool = True) -> StatResult:
    by = list(by)
    table = levene_table(grouped(df, y, x, by, levels, normalize), by)
    stats = table.select(
        *by,
        F.col("levene_W").alias("W"),
        F.col("levene_p").alias("p_value"),
        F.col("levene_k").alias("k"),
        F.col("levene_n").alias("n"),
        text_list().alias("warnings"),
    )
    return StatResult("levene", "Levene's test (homogeneity of variance)", stats, by=by)


def effect_size(df: DataFrame, y: str, x: str, kind: str = "cohens_d", levels: Sequence[str] | None = None, by: Sequence[str] = ()) -> StatResult:
    if kind not in ("cohens_d", "hedges_g"):
        raise ValueError("Known effect sizes: cohens_d, hedges_g.")
    by = list(by)
    pair = two_groups(group_moments(grouped(df, y, x, by, levels), by), by)
    two = F.col("n_groups") == 2
    n = F.col("n_1") + F.col("n_2")
    stats = pair.select(
        *by,
        failing(by, two, pooled_d(), "Needs two groups.").alias("cohens_d"),
        F.when(two, hedges(pooled_d(), n)).alias("hedges_g"),
        "n_1",
        "n_2",
        n.alias("n"),
        text_list(F.when(~two, F.lit("requires exactly 2 groups"))).alias("warnings"),
    )
    return StatResult("effect_size", "Standardized mean difference", stats, by=by)


def power_by_segment(df: DataFrame, y: str, x: str, by: Sequence[str] = (), power: float = 0.8, alpha: float = 0.05) -> StatResult:
    """Observed effect per segment, the power it had, and the group size it would need."""
    by = list(by)
    pair = two_groups(group_moments(grouped(df, y, x, by), by), by)
    two = F.col("n_groups") == 2
    d = F.when(two, pooled_d())
    n1, n2 = F.col("n_1").cast("double"), F.col("n_2").cast("double")
    stats = pair.select(
        *by,
        d.alias("d"),
        "n_1",
        "n_2",
        t_power(d, n1, n2, F.lit(float(alpha))).alias("power"),
        t_sample_size(d, F.lit(float(power)), F.lit(float(alpha))).alias("n_per_group"),
        F.lit(float(power)).alias("target_power"),
        F.lit(float(alpha)).alias("alpha"),
        text_list(F.when(~two, F.lit("requires exactly 2 groups"))).alias("warnings"),
    )
    return StatResult("power_analysis", "Two-sample t-test power", stats, by=by)


def power_analysis(
    df: DataFrame,
    d: float | None = None,
    n: int | None = None,
    power: float | None = None,
    alpha: float = 0.05,
    y: str | None = None,
    x: str | None = None,
    by: Sequence[str] = (),
) -> StatResult:
    """Power at n per group, or n per group for a power; the effect is given or taken from the table."""
    if y and x:
        return power_by_segment(df, y, x, by, power or 0.8, alpha)
    one = df.sparkSession.range(1)
    es = F.lit(float(d or 0.5))
    a = F.lit(float(alpha))
    if n and not power:
        size = F.lit(float(n))
        stats = one.select(t_power(es, size, size, a).alias("power"), es.alias("d"), F.lit(int(n)).cast("long").alias("n_per_group"), a.alias("alpha"), text_list().alias("warnings"))
        return StatResult("power_analysis", "Two-sample t-test power", stats)
    target = F.lit(float(power or 0.8))
    stats = one.select(t_sample_size(es, target, a).alias("n_per_group"), es.alias("d"), target.alias("power"), a.alias("alpha"), text_list().alias("warnings"))
    return StatResult("sample_size", "Sample size (two-sample t)", stats)


# -- rank tests -------------------------------------------------------------------


def _rank_sums(data: DataFrame, by: list[str]) -> DataFrame:
    """Per segment and group: n, rank sum over the pooled segment, and its share of the tie term."""
    ranked = midranks(data, Y, by, [G], cut_points(data, Y))
    n, ties = F.col("n").cast("double"), F.col("ties").cast("double")
    return ranked.groupBy(*by, G).agg(
        F.sum("n").alias("n"),
        F.sum(n * F.col("rank")).alias("rank_sum"),
        F.sum(n * (ties * ties - 1)).alias("tie_sum"),
    )


def mannwhitney(df: DataFrame, y: str, x: str, levels: Sequence[str] | None = None, by: Sequence[str] = ()) -> StatResult:
    by = list(by)
    data = grouped(df, y, x, by, levels)
    groups = side_by_side_groups(_rank_sums(data, by), group_medians(data, by), by)
    pair = two_groups(groups, by)
    n1, n2 = F.col("n_1").cast("double"), F.col("n_2").cast("double")
    two = F.col("n_groups") == 2
    u = F.when(two, F.col("rank_sum_1") - n1 * (n1 + 1) / 2)
    stats = pair.select(
        *by,
        failing(by, two, u, "Needs exactly 2 groups.").alias("U"),
        mannwhitney_p(u, n1, n2, F.col("tie_sum_1") + F.col("tie_sum_2")).alias("p_value"),
        "n_1",
        "n_2",
        "group_1",
        "group_2",
        "median_1",
        "median_2",
        (1 - 2 * u / (n1 * n2)).alias("rank_biserial"),
        (u / (n1 * n2)).alias("CLES"),
        (F.col("n_1") + F.col("n_2")).alias("n"),
        *_effect("CLES", u / (n1 * n2)),
        text_list(F.when(~two, F.lit("requires exactly 2 groups"))).alias("warnings"),
    )
    return StatResult("mannwhitney", "Mann–Whitney U test", stats, formula="U = R₁ − n₁(n₁+1)/2", by=by)


def side_by_side_groups(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join two tables that hold one row per segment and group."""
    return attach(left, right, [*by, G])


def kruskal(df: DataFrame, y: str, x: str, levels: Sequence[str] | None = None, by: Sequence[str] = ()) -> StatResult:
    by = list(by)
    data = grouped(df, y, x, by, levels)
    groups = cut(side_by_side_groups(_rank_sums(data, by), group_medians(data, by), by))
    sizes = groups.groupBy(*by).agg(F.sum("n").alias("_n"), F.sum("tie_sum").alias("_ties"), F.count(F.lit(1)).alias("_k"))
    spread = F.col("rank_sum") / F.col("n") - (F.col("_n") + 1) / 2.0
    total = F.col("n").cast("double")
    base = attach(groups, sizes, by).groupBy(*by).agg(
        F.max("_k").alias("k"),
        F.max("_n").alias("n"),
        F.max("_ties").alias("_ties"),
        F.sum(F.col("n") * spread * spread).alias("_between"),
    )
    correction = 1 - F.try_divide(F.col("_ties"), total * total * total - total)
    k = F.col("k")
    ok = k >= 2
    h = F.when(ok, F.try_divide(12 * F.col("_between") / (total * (total + 1)), correction))
    eta = F.when(total > k, (h - k + 1) / F.when(total > k, total - k))
    stats = base.select(
        *by,
        failing(by, ok, h, "Needs two groups or more.").alias("H"),
        chi2_sf(h, k - 1).alias("p_value"),
        k,
        F.col("n"),
        eta.alias("eta2_approx"),
        *_effect("ε² approx", eta),
        text_list(F.when(~ok, F.lit("requires at least 2 groups"))).alias("warnings"),
    )
    table = groups.select(*by, F.col(G).alias("group"), "n", "median", (F.col("rank_sum") / F.col("n")).alias("mean_rank"))
    return StatResult("kruskal", "Kruskal–Wallis test", stats, {"groups": table}, by=by)


def wilcoxon(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> StatResult:
    by = list(by)
    require(df, y, x, *by)
    diff = df.where(present(df, y, x)).select(*[col(b) for b in by], (num(df, y) - num(df, x)).alias("_d")).where("_d != 0")
    sided = diff.select(*by, F.abs("_d").alias("_a"), (F.col("_d") > 0).alias("_up"))
    ranked = midranks(sided, "_a", by, ["_up"], cut_points(sided, "_a"))
    n, ties = F.col("n").cast("double"), F.col("ties").cast("double")
    sums = ranked.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("_up"), n * F.col("rank"))), F.lit(0.0)).alias("_plus"),
        F.coalesce(F.sum(F.when(~F.col("_up"), n * F.col("rank"))), F.lit(0.0)).alias("_minus"),
        F.sum(n * (ties * ties - 1)).alias("_ties"),
    )
    medians = exact_quantiles(diff, ["_d"], [0.5], by).select(*by, F.col("q")[0].alias("median_diff"))
    both = side_by_side(sums, medians, by)
    ok = F.col("n") >= 6
    w = F.when(ok, F.least("_plus", "_minus"))
    stats = both.select(
        *by,
        failing(by, F.coalesce(ok, F.lit(False)), w, "Needs six non-zero differences.").alias("W"),
        wilcoxon_p(F.when(ok, F.col("_plus")), F.col("_minus"), F.col("n"), F.col("_ties")).alias("p_value"),
        "n",
        "median_diff",
        text_list(F.when(~ok, F.lit("fewer than 6 non-zero differences"))).alias("warnings"),
    )
    return StatResult("wilcoxon", "Wilcoxon signed-rank test", stats, by=by)


def friedman(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> StatResult:
    """Ranks are taken inside each row, so one aggregate pass is enough."""
    by, columns = list(by), list(columns or [])
    if len(columns) < 3:
        raise ValueError("Needs three measure columns or more.")
    require(df, *columns, *by)
    k = len(columns)
    rows = df.select(*[col(b) for b in by], *[num(df, c).alias(f"_c{i}") for i, c in enumerate(columns)])
    rows = drop_missing(rows, [f"_c{i}" for i in range(k)])
    values = [F.col(f"_c{i}") for i in range(k)]

    def below(i: int) -> Column:
        return sum(((values[j] < values[i]).cast("int") for j in range(k) if j != i), F.lit(0))

    def equal(i: int) -> Column:
        return sum(((values[j] == values[i]).cast("int") for j in range(k) if j != i), F.lit(1))

    ranked = rows.select(
        *by,
        *[(below(i) + (equal(i) + 1) / 2.0).alias(f"_r{i}") for i in range(k)],
        sum((equal(i) * equal(i) - 1 for i in range(k)), F.lit(0)).alias("_t"),
    )
    middle = (k + 1) / 2.0
    sums = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_t").alias("_ties"), *[F.sum(F.col(f"_r{i}") - middle).alias(f"_s{i}") for i in range(k)]
    )
    n = F.col("n")
    squares = sum((F.col(f"_s{i}") * F.col(f"_s{i}") for i in range(k)), F.lit(0.0))
    correction = 1 - F.try_divide(F.col("_ties").cast("double"), n * float(k * (k * k - 1)))
    chi2 = F.try_divide(F.try_divide(12 * squares, n * float(k * (k + 1))), correction)
    stats = sums.select(*by, chi2.alias("chi2"), chi2_sf(chi2, F.lit(k - 1)).alias("p_value"), F.lit(k).cast("long").alias("k"), n, text_list().alias("warnings"))
    return StatResult("friedman", "Friedman test", stats, by=by)
