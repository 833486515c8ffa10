"""Analysis of variance: one-way, Tukey, two-way, covariance and repeated measures."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statweave.functions import dist
from statweave.functions.columns import col, drop_missing, known, num, p_format, raw_label, require, text_list
from statweave.functions.tails import f_sf
from statweave.operators.groups import G, Y, between_within, f_ratio, group_medians, group_moments, grouped, levene_table, side_by_side
from statweave.plans.gram import Moments, gram
from statweave.plans.systems import component_counts, conjugate_gradients
from statweave.plans.tables import attach, centre, cut, failing, null_safe, per_segment
from statweave.result import StatResult

# Groups in a block of pairs.
PAIR_BLOCK = 500
# Up to so many levels of both factors together a segment is solved at once; beyond, over its cell table.
DENSE_LEVELS = 200


def oneway_anova(df: DataFrame, y: str, x: str, levels: Sequence[str] | None = None, by: Sequence[str] = ()) -> StatResult:
    by = list(by)
    data = grouped(df, y, x, by, levels)
    medians = cut(group_medians(data, by))
    moments = group_moments(data, by)
    sums = between_within(moments, by, centre(data, [Y])[0])
    both = side_by_side(sums, levene_table(data, by, medians), by)
    k, n, ssb, ssw = (F.col(c) for c in ("k", "n", "ss_between", "ss_within"))
    ok = k >= 2
    f = F.when(ok, f_ratio())
    msw = ssw / F.greatest(n - k, F.lit(1))
    eta = F.coalesce(F.try_divide(ssb, ssb + ssw), F.lit(0.0))
    omega = F.when(n > k, F.try_divide(ssb - (k - 1) * msw, ssb + ssw + msw))
    stats = both.select(
        *by,
        failing(by, ok, f, "Needs two groups or more.").alias("F"),
        f_sf(f, k - 1, n - k).alias("p_value"),
        (k - 1).alias("df_between"),
        (n - k).alias("df_within"),
        eta.alias("eta_squared"),
        omega.alias("omega_squared"),
        "levene_W",
        "levene_p",
        "ss_between",
        "ss_within",
        k,
        n,
        F.lit("eta_squared").alias("effect_name"),
        eta.alias("effect_value"),
        F.lit(None).cast("string").alias("effect_magnitude"),
        text_list(
            F.when(~ok, F.lit("requires at least 2 groups")),
            F.when(F.col("levene_p") < 0.05, F.concat(F.lit("Levene p="), p_format(F.col("levene_p")), F.lit(": unequal variances; a rank test may fit better."))),
            F.when(F.col("min_n") < 5, F.lit("A group has fewer than 5 rows.")),
        ).alias("warnings"),
    )
    table = attach(moments, medians, [*by, G]).select(*by, F.col(G).alias("group"), "n", "mean", F.when(F.col("n") > 1, F.sqrt("var")).alias("sd"), "median")
    return StatResult("oneway_anova", "One-way ANOVA", stats, {"group_summaries": table}, formula="F = MS_between / MS_within", by=by)


def tukey_hsd(df: DataFrame, y: str, x: str, alpha: float = 0.05, by: Sequence[str] = ()) -> StatResult:
    """All pairs of group means (raw labels) with Tukey–Kramer intervals.

    Groups are numbered in order of their labels and dealt to blocks; a task takes the
    pairs between two blocks.
    """
    by = list(by)
    moments = cut(group_moments(grouped(df, y, x, by, normalize=False), by))
    levels = cut(moments.groupBy(*by).agg(F.sum("n").alias("_n_all"), F.count(F.lit(1)).alias("_k"), F.sum((F.col("n") - 1) * F.col("var")).alias("_ssw")))
    at = F.row_number().over(Window.partitionBy(*([col(c) for c in by] or [F.lit(0)])).orderBy(col(G))) - 1
    usable = levels.where((F.col("_k") >= 2) & (F.col("_n_all") > F.col("_k")))
    numbered = attach(moments.withColumn("_at", at), usable, by) if by or not usable.isEmpty() else moments.limit(0).withColumns({"_at": F.lit(0), "_n_all": F.lit(0), "_k": F.lit(0), "_ssw": F.lit(0.0)})
    block, blocks = F.floor(F.col("_at") / PAIR_BLOCK), F.ceil(F.col("_k") / PAIR_BLOCK)
    dealt = numbered.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
    dealt = dealt.withColumns({"_i": F.least(block, F.col("_o")), "_j": F.greatest(block, F.col("_o"))})
    fields = [("group1", "string"), ("group2", "string"), ("meandiff", "double"), ("p_adj", "double"), ("lower", "double"), ("upper", "double"), ("reject", "boolean")]
    schema = T.StructType([moments.schema[c] for c in by] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        k, dof, i, j = int(pdf["_k"].iloc[0]), float(pdf["_n_all"].iloc[0] - pdf["_k"].iloc[0]), pdf["_i"].iloc[0], pdf["_j"].iloc[0]
        own = pdf["_at"] // PAIR_BLOCK
        one, two = pdf[own == i].sort_values("_at"), pdf[own == j].sort_values("_at")
        a, b = (v.ravel() for v in np.meshgrid(np.arange(len(one)), np.arange(len(two)), indexing="ij"))
        later = one["_at"].to_numpy()[a] < two["_at"].to_numpy()[b]
        one, two = one.iloc[a[later]], two.iloc[b[later]]
        gap = two["mean"].to_numpy(float) - one["mean"].to_numpy(float)
        se = np.sqrt(float(pdf["_ssw"].iloc[0]) / dof / 2 * (1 / one["n"].to_numpy(float) + 1 / two["n"].to_numpy(float)))
        crit = dist.studentized_range_ppf(1 - alpha, k, dof)
        known_ = se > 0
        p = dist.studentized_range_sf_array(np.abs(gap) / np.where(known_, se, 1.0), k, dof)
        out = pd.DataFrame({"group1": one[G].to_numpy(), "group2": two[G].to_numpy(), "meandiff": gap, "p_adj": [v if ok else None for v, ok in zip(p, known_, strict=True)], "lower": gap - crit * se, "upper": gap + crit * se})
        out["reject"] = [bool(v < alpha) if ok else None for v, ok in zip(p, known_, strict=True)]
        for c in by:
            out[c] = [pdf[c].iloc[0]] * len(out)
        return out[schema.names]

    table = dealt.groupBy(*by, "_i", "_j").applyInPandas(compare, schema)
    k = F.col("_k")
    stats = levels.select(
        *by,
        F.lit(float(alpha)).alias("alpha"),
        failing(by, k >= 2, (k * (k - 1) / 2).cast("long"), "Tukey HSD needs at least 2 groups.").alias("n_pairs"),
        F.col("_n_all").alias("n"),
        text_list(F.lit("Assumes normal groups of equal variance.")).alias("warnings"),
    )
    return StatResult("tukey_hsd", "Tukey HSD pairwise comparisons", stats, {"comparisons": table}, by=by)


ANOVA_FIELDS = [("term", "string"), ("sum_sq", "double"), ("df", "double"), ("F", "double"), ("PR_F", "double")]
COEF_FIELDS = [
    ("term", "string"),
    ("coef", "double"),
    ("se", "double"),
    ("t", "double"),
    ("p_value", "double"),
    ("ci95_low", "double"),
    ("ci95_high", "double"),
]


def _cell_fit(design: np.ndarray, n: np.ndarray, mean: np.ndarray) -> tuple[float, int]:
    """Between-cell residual sum of squares and rank of a weighted fit on cell means."""
    w = np.sqrt(n)
    beta, _, rank, _ = np.linalg.lstsq(design * w[:, None], mean * w, rcond=None)
    gap = mean - design @ beta
    return float(np.sum(n * gap * gap)), int(rank)


def _dummies(labels: Sequence[str], levels: Sequence[str]) -> np.ndarray:
    return np.array([[1.0 if v == level else 0.0 for level in levels[1:]] for v in labels]).reshape(len(labels), len(levels) - 1)


def _additive_rss(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, _rss, _rank) of the best sum of a level of A and one of B, solved over the cell table.

    The unknowns are the levels, the equations those of a graph whose links are the
    cells; each step of the solution is one pass over them.
    """
    one = cells.select(*by, F.lit("a").alias("side"), F.col("_a").alias("level"), "n", "mean")
    two = cells.select(*by, F.lit("b").alias("side"), F.col("_b").alias("level"), "n", "mean")
    rhs = one.unionByName(two).groupBy(*by, "side", "level").agg(F.sum(F.col("n") * F.col("mean")).alias("_b"), F.sum("n").cast("double").alias("_d"))

    def with_levels(x: DataFrame) -> DataFrame:
        found = cells
        for side, name in (("a", "_a"), ("b", "_b")):
            values = x.where(F.col("side") == side).select(*by, F.col("level").alias(name), F.col("_x").alias(f"_x{side}"))
            found = attach(found, values, [*by, name])
        return found

    def product(x: DataFrame) -> DataFrame:
        found = with_levels(x).withColumn("_y", F.col("n") * (F.col("_xa") + F.col("_xb")))
        sides = [found.select(*by, F.lit(side).alias("side"), F.col(name).alias("level"), "_y") for side, name in (("a", "_a"), ("b", "_b"))]
        return sides[0].unionByName(sides[1]).groupBy(*by, "side", "level").agg(F.sum("_y").alias("_y"))

    solved = conjugate_gradients(product, rhs, by, ["side", "level"])
    gap = F.col("mean") - F.col("_xa") - F.col("_xb")
    rss = with_levels(solved).groupBy(*by).agg(F.sum(F.col("n") * gap * gap).alias("_rss"))
    # A component of the graph has one level too many.
    numbers = cut(rhs.select(*by, "side", "level").withColumn("_id", F.monotonically_increasing_id()))
    links = cells
    for side, name in (("a", "_a"), ("b", "_b")):
        ids = numbers.where(F.col("side") == side).select(*by, F.col("level").alias(name), F.col("_id").alias(side))
        links = null_safe(links, ids, [*by, name])
    levels = rhs.groupBy(*by).agg(F.count(F.lit(1)).alias("_levels"))
    rank = side_by_side(levels, component_counts(links, by), by).select(*by, (F.col("_levels") - F.col("_components")).alias("_rank"))
    return side_by_side(rss, rank, by)


def twoway_anova(df: DataFrame, y: str, factor1: str, factor2: str, by: Sequence[str] = ()) -> StatResult:
    """Type II sums of squares with interaction, exact from the cell counts, means and variances.

    Segments of few levels are solved at once, others over their cell table.
    Coefficients are differences of cell means from the first level of each factor; one
    that would need a cell without rows is not there.
    """
    by = list(by)
    require(df, y, factor1, factor2, *by)
    rows = df.select(*[col(b) for b in by], num(df, y).alias(Y), raw_label(known(df, factor1)).alias("_a"), raw_label(known(df, factor2)).alias("_b"))
    rows = drop_missing(rows, [Y, "_a", "_b"])
    counted = cut(rows.groupBy(*by, "_a", "_b").agg(F.count(F.lit(1)).alias("n"), F.avg(Y).alias("mean"), F.coalesce(F.var_samp(Y), F.lit(0.0)).alias("var")))
    sizes = counted.groupBy(*by).agg(
        F.count_distinct("_a").alias("_na"), F.count_distinct("_b").alias("_nb"), F.count(F.lit(1)).alias("_cells"), F.sum("n").alias("_n"), F.min("_a").alias("_a0"), F.min("_b").alias("_b0"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_shift"), F.sum((F.col("n") - 1) * F.col("var")).alias("_within"),
    )
    sizes = cut(sizes)
    cells = cut(attach(counted, sizes, by).withColumn("mean", F.col("mean") - F.col("_shift"))) if by or not sizes.isEmpty() else counted
    if not by and sizes.where("_n > 0").isEmpty():
        raise ValueError("No rows in which all three columns are known.")

    def around(*factors: str) -> DataFrame:
        """Squares of the cell means around those of a factor's levels."""
        own = cells.groupBy(*by, *factors).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_m"))
        gap = F.col("mean") - F.col("_m")
        return attach(cells, own, [*by, *factors]).groupBy(*by).agg(F.sum(F.col("n") * gap * gap).alias(f"_rss{factors[0]}"))

    few = F.col("_na") + F.col("_nb") <= DENSE_LEVELS
    listed = cells.where(few).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_a", "_b", "n", "mean"))).alias("cells"))

    def at_once(r):
        c = r["cells"]
        if not len(c):
            return
        n, mean = np.array([e["n"] for e in c], float), np.array([e["mean"] for e in c])
        a, b = sorted({e["_a"] for e in c}), sorted({e["_b"] for e in c})
        design = np.hstack([np.ones((len(c), 1)), _dummies([e["_a"] for e in c], a), _dummies([e["_b"] for e in c], b)])
        rss, rank = _cell_fit(design, n, mean)
        yield {"_rss": rss, "_rank": rank}

    additive = per_segment(listed, by, [("_rss", "double"), ("_rank", "long")], at_once)
    many = cells.where(~few)
    if not many.isEmpty():
        additive = additive.unionByName(_additive_rss(cut(many.select(*by, "_a", "_b", "n", "mean")), by))
    sums = sizes
    for part in (around("_a"), around("_b"), cut(additive), cells.groupBy(*by).agg(F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("_between"))):
        sums = side_by_side(sums, part, by)
    sums = cut(sums.where("_n > 0"))

    def anova_rows(r):
        dof = r["_n"] - r["_cells"]
        mse = r["_within"] / dof if dof > 0 else math.nan
        terms = [("C(A)", r["_rss_b"] - r["_rss"], r["_na"] - 1), ("C(B)", r["_rss_a"] - r["_rss"], r["_nb"] - 1), ("C(A):C(B)", r["_rss"], r["_cells"] - r["_rank"])]
        for term, ss, df_ in terms:
            f = ss / df_ / mse if df_ > 0 and mse > 0 else None
            yield {"term": term, "sum_sq": ss, "df": df_, "F": f, "PR_F": None if f is None else dist.f_sf(f, df_, dof)}
        yield {"term": "Residual", "sum_sq": r["_within"], "df": dof, "F": None, "PR_F": None}

    stats = sums.select(*by, F.col("_n").alias("n"), F.when(F.col("_within") + F.col("_between") > 0, F.col("_between") / (F.col("_within") + F.col("_between"))).alias("r2"), text_list().alias("warnings"))
    tables = {"anova": per_segment(sums, by, ANOVA_FIELDS, anova_rows), "params": _cell_contrasts(cells, by)}
    return StatResult("twoway_anova", "Two-way ANOVA", stats, tables, formula="Y ~ C(A) + C(B) + C(A):C(B)", by=by)


def _cell_contrasts(cells: DataFrame, by: list[str]) -> DataFrame:
    """The coefficient table of the full model, a row for each cell whose reference cells are there."""
    first_a, first_b = F.col("_a") == F.col("_a0"), F.col("_b") == F.col("_b0")
    found = cells
    for name, where, keys in (("row", first_b, ["_a"]), ("column", first_a, ["_b"]), ("corner", first_a & first_b, [])):
        values = cells.where(where).select(*by, *keys, F.col("mean").alias(f"_{name}"), (1 / F.col("n")).alias(f"_{name}_v"))
        if by or keys:
            found = null_safe(found, cut(values), [*by, *keys], "left")
        else:
            corner = values.first()
            found = found.withColumns({c: F.lit(corner[c] if corner else None).cast("double") for c in values.columns})
    mean, own = F.col("mean"), 1 / F.col("n")
    coef = (
        F.when(first_a & first_b, mean + F.col("_shift"))
        .when(first_b, mean - F.col("_corner"))
        .when(first_a, mean - F.col("_corner"))
        .otherwise(mean - F.col("_row") - F.col("_column") + F.col("_corner"))
    )
    spread = F.when(first_a & first_b, own).when(first_a | first_b, own + F.col("_corner_v")).otherwise(own + F.col("_row_v") + F.col("_column_v") + F.col("_corner_v"))
    term = (
        F.when(first_a & first_b, F.lit("Intercept"))
        .when(first_b, F.concat(F.lit("C(A)[T."), "_a", F.lit("]")))
        .when(first_a, F.concat(F.lit("C(B)[T."), "_b", F.lit("]")))
        .otherwise(F.concat(F.lit("C(A)[T."), "_a", F.lit("]:C(B)[T."), "_b", F.lit("]")))
    )
    dof = (F.col("_n") - F.col("_cells")).cast("double")
    sigma = F.when(dof > 0, F.sqrt(F.col("_within") / dof))
    rows = found.select(*by, term.alias("term"), coef.alias("coef"), (sigma * F.sqrt(spread)).alias("se"), dof.alias("_dof")).where("coef is not null")

    def finish(pdf: pd.Series, se: pd.Series, dof: pd.Series) -> pd.DataFrame:
        out = []
        for b, s, d in zip(pdf, se, dof, strict=True):
            crit = _t_critical(d) if d > 0 else math.nan
            t = b / s if s and s > 0 else math.nan
            out.append((t, dist.t_p(t, d) if t == t else math.nan, b - crit * s, b + crit * s) if s is not None and s == s else (math.nan,) * 4)
        return pd.DataFrame(out, columns=["t", "p_value", "ci95_low", "ci95_high"])

    more = F.pandas_udf(finish, "t double, p_value double, ci95_low double, ci95_high double")
    told = rows.withColumn("_f", more("coef", F.coalesce("se", F.lit(float("nan"))), "_dof"))
    known_ = lambda c: F.when(~F.isnan(c), c)
    return told.select(*by, "term", "coef", "se", *[known_(F.col(f"_f.{c}")).alias(c) for c in ("t", "p_value", "ci95_low", "ci95_high")])


@functools.lru_cache(maxsize=64)
def _t_critical(dof: float) -> float:
    return dist.t_ppf(0.975, dof)


def coefficient_table(names, beta, se, dof=None):
    """Rows of a coefficient table; normal-based without degrees of freedom."""
    crit = dist.norm_ppf(0.975) if dof is None else dist.t_ppf(0.975, dof)
    for name, b, s in zip(names, beta, se):
        t = b / s if s > 0 else math.nan
        p = math.nan if t != t else dist.norm_p(t) if dof is None else dist.t_p(t, dof)
        yield {"term": name, "coef": b, "se": s, "t": t, "p_value": p, "ci95_low": b - crit * s, "ci95_high": b + crit * s}


def ancova(df: DataFrame, y: str, x: str, covariate: str, by: Sequence[str] = ()) -> StatResult:
    """Group effect after a covariate, from per-group sums and cross products alone."""
    by = list(by)
    require(df, y, x, covariate, *by)
    rows = drop_missing(df.select(*[col(b) for b in by], num(df, y).alias(Y), num(df, covariate).alias("_x"), raw_label(known(df, x)).alias(G)), [Y, "_x", G])
    groups = rows.groupBy(*by, G).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(Y).alias("my"),
        F.avg("_x").alias("mx"),
        (F.var_pop(Y) * F.count(F.lit(1))).alias("yy"),
        (F.var_pop("_x") * F.count(F.lit(1))).alias("xx"),
        (F.covar_pop("_x", Y) * F.count(F.lit(1))).alias("xy"),
    )
    # Pooling sums: within-group products add up; between-group products need the weighted means.
    cx, cy = centre(rows, ["_x", Y])
    n, dx, dy = F.col("n"), F.col("mx") - cx, F.col("my") - cy
    sums = groups.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        *[F.sum(c).alias(c) for c in ("xx", "xy", "yy")],
        F.sum(n * dx).alias("sx"),
        F.sum(n * dy).alias("sy"),
        F.sum(n * dx * dx).alias("bxx"),
        F.sum(n * dx * dy).alias("bxy"),
        F.sum(n * dy * dy).alias("byy"),
    )

    def finish(r):
        if not r["n"]:
            return
        total, k = r["n"], r["k"]
        txx = r["xx"] + r["bxx"] - r["sx"] ** 2 / total
        txy = r["xy"] + r["bxy"] - r["sx"] * r["sy"] / total
        tyy = r["yy"] + r["byy"] - r["sy"] ** 2 / total
        full = r["yy"] - (r["xy"] ** 2 / r["xx"] if r["xx"] > 0 else 0.0)
        only_covariate = tyy - (txy**2 / txx if txx > 0 else 0.0)
        dof = total - k - 1
        mse = full / dof if dof > 0 else math.nan
        for source, ss, d in ((x, only_covariate - full, k - 1), (covariate, r["yy"] - full, 1)):
            f = ss / d / mse if d > 0 and mse > 0 else None
            yield {"Source": source, "SS": ss, "DF": d, "F": f, "p_unc": None if f is None else dist.f_sf(f, d, dof), "np2": ss / (ss + full) if ss + full > 0 else None}
        yield {"Source": "Residual", "SS": full, "DF": dof, "F": None, "p_unc": None, "np2": None}

    fields = [("Source", "string"), ("SS", "double"), ("DF", "long"), ("F", "double"), ("p_unc", "double"), ("np2", "double")]
    stats = sums.select(*by, "n", text_list(F.lit("Assumes the same covariate slope in every group.")).alias("warnings"))
    return StatResult("ancova", "ANCOVA", stats, {"ancova": per_segment(sums, by, fields, finish)}, by=by)


def repeated_anova(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> StatResult:
    """Within-subject F with Greenhouse–Geisser epsilon and Mauchly's W, from one covariance pass."""
    by, columns = list(by), list(columns or [])
    if len(columns) < 2:
        raise ValueError("Needs two measure columns or more.")
    require(df, *columns, *by)
    rows = drop_missing(df.select(*[col(b) for b in by], *[num(df, c).alias(f"_c{i}") for i, c in enumerate(columns)]), [f"_c{i}" for i in range(len(columns))])
    table = gram(rows, [f"_c{i}" for i in range(len(columns))], by)
    k = len(columns)

    def parts(r):
        m = Moments(r)
        if not m.ok or m.n < 2:
            return None
        s = m.cov()
        n = m.n
        ss_time = n * float(np.sum((m.mean - m.mean.mean()) ** 2))
        ss_subject = (n - 1) * float(s.sum()) / k
        ss_error = (n - 1) * float(np.trace(s)) - ss_subject
        df1, df2 = k - 1, (k - 1) * (n - 1)
        f = (ss_time / df1) / (ss_error / df2) if ss_error > 0 else None
        centred = s - s.mean(axis=0) - s.mean(axis=1)[:, None] + s.mean()
        eps = float(np.trace(centred) ** 2 / (df1 * np.sum(centred * centred))) if np.sum(centred * centred) > 0 else None
        roots = np.sort(np.linalg.eigvalsh(centred))[1:]
        w = float(np.prod(roots) / (roots.sum() / df1) ** df1) if k > 2 and roots.sum() > 0 else 1.0
        p_w = None
        if k > 2 and w > 0:
            scale = 1 - (2 * df1**2 + df1 + 2) / (6 * df1 * (n - 1))
            p_w = dist.chi2_sf(-(n - 1) * scale * math.log(w), k * (k - 1) / 2 - 1)
        return n, ss_time, ss_error, ss_subject, df1, df2, f, eps, w, p_w

    def anova_rows(r):
        got = parts(r)
        if got is None:
            return
        n, ss_time, ss_error, ss_subject, df1, df2, f, eps, w, p_w = got
        yield {
            "Source": "time",
            "SS": ss_time,
            "DF": df1,
            "MS": ss_time / df1,
            "F": f,
            "p_unc": None if f is None else dist.f_sf(f, df1, df2),
            "p_GG_corr": None if f is None or eps is None else dist.f_sf(f, df1 * eps, df2 * eps),
            "ng2": ss_time / (ss_time + ss_error + ss_subject) if ss_time + ss_error + ss_subject > 0 else None,
            "eps": eps,
        }
        yield {"Source": "Error", "SS": ss_error, "DF": df2, "MS": ss_error / df2}

    def stat_rows(r):
        got = parts(r)
        yield {"n_subjects": int(r["n"]), "k": k, "sphericity_W": got[8] if got else None, "sphericity_p": got[9] if got else None}

    fields = [("Source", "string"), ("SS", "double"), ("DF", "long"), ("MS", "double"), ("F", "double"), ("p_unc", "double"), ("p_GG_corr", "double"), ("ng2", "double"), ("eps", "double")]
    stats = per_segment(table, by, [("n_subjects", "long"), ("k", "long"), ("sphericity_W", "double"), ("sphericity_p", "double")], stat_rows)
    stats = stats.withColumn("n", F.col("n_subjects")).withColumn("warnings", text_list())
    return StatResult("repeated_anova", "Repeated-measures ANOVA", stats, {"anova": per_segment(table, by, fields, anova_rows)}, by=by)


