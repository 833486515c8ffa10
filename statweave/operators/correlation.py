"""Pearson, Spearman and Kendall correlation, for a pair or a whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statweave.functions.columns import col, drop_missing, num, numeric_columns, present, require, text_list
from statweave.functions.tails import kendall_p, t_p
from statweave.operators.groups import side_by_side
from statweave.plans.dominance import dense_rank, ordered_pairs
from statweave.plans.gram import WIDE, Moments, gram
from statweave.plans.ranks import attach_ranks, cut_points, midranks
from statweave.plans.tables import cut, failing, null_safe, per_segment
from statweave.result import StatResult

CAUSATION = "A correlation says nothing about cause."
# A value seen this often is joined through a broadcast table of the frequent values.
HOT_SHARE = 1000


def pair(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    require(df, x, y, *by)
    return df.where(present(df, x, y)).select(*[col(b) for b in by], num(df, x).alias("_x"), num(df, y).alias("_y"))


def r_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation from Student's t."""
    t = F.when(F.abs(r) >= 1, F.lit(float("inf"))).otherwise(r * F.sqrt((n - 2) / ((1 - r) * (1 + r))))
    return t_p(F.when(n > 2, t), F.when(n > 2, n - 2))


def _strength(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size < 0.1, "negligible").when(size < 0.3, "weak").when(size < 0.5, "moderate").when(size.isNotNull(), "strong")


def _pack(table: DataFrame, method: str, label: str, by: list[str], interval: bool, p: Column, formula: str) -> StatResult:
    r, n = F.col("_r"), F.col("n")
    ok = F.coalesce(n >= 4, F.lit(False))
    z = F.atanh(F.least(F.greatest(r, F.lit(-0.999999)), F.lit(0.999999)))
    half = 1.96 / F.sqrt(F.when(n > 3, n - 3))
    low, high = (F.tanh(z - half), F.tanh(z + half)) if interval else (F.lit(None).cast("double"), F.lit(None).cast("double"))
    stats = table.withColumn("_r", failing(by, ok, r, "Needs at least 4 complete pairs.")).select(
        *by,
        r.alias("coefficient"),
        F.when(ok, p).alias("p_value"),
        n,
        F.when(ok, low).alias("ci95_low"),
        F.when(ok, high).alias("ci95_high"),
        F.lit(method).alias("effect_name"),
        r.alias("effect_value"),
        _strength(r).alias("effect_magnitude"),
        text_list(F.lit(CAUSATION), F.when(~ok, F.lit("fewer than 4 paired observations"))).alias("warnings"),
    )
    return StatResult(method, label, stats, formula=formula, by=by)


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> StatResult:
    by = list(by)
    table = pair(df, x, y, by).groupBy(*by).agg(F.corr("_x", "_y").alias("_r"), F.count(F.lit(1)).alias("n"))
    return _pack(table, "pearson", "Pearson correlation", by, True, r_p(F.col("_r"), F.col("n")), "r = Σ (x−x̄)(y−ȳ) / √[Σ(x−x̄)² Σ(y−ȳ)²]")


def rank_correlation(base: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of the average ranks of ``_x`` and ``_y`` per segment: by..., _r, n."""
    by = list(by)
    pairs = base.groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("_c"))
    total = base.count()
    hot = max(1, total // HOT_SHARE)
    for key, out in (("_x", "_rx"), ("_y", "_ry")):
        ranks = midranks(base, key, by, cuts=cut_points(base, key)).select(*by, key, "ties", F.col("rank").alias(out))
        pairs = attach_ranks(pairs, ranks, key, by, hot).drop("ties")
    # Ranks are centred on their known mean (n + 1) / 2 per segment before multiplying.
    sizes = base.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    staged = side_by_side(pairs, sizes, by)
    dx, dy, c = F.col("_rx") - (F.col("n") + 1) / 2.0, F.col("_ry") - (F.col("n") + 1) / 2.0, F.col("_c")
    sums = staged.groupBy(*by).agg(
        F.sum(c * dx * dy).alias("_xy"), F.sum(c * dx * dx).alias("_xx"), F.sum(c * dy * dy).alias("_yy"), F.max("n").alias("n")
    )
    return sums.select(*by, F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx")) * F.sqrt(F.col("_yy"))).alias("_r"), "n")


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> StatResult:
    by = list(by)
    table = rank_correlation(pair(df, x, y, by), by)
    return _pack(table, "spearman", "Spearman rank correlation", by, True, r_p(F.col("_r"), F.col("n")), "ρ = r of the average ranks")


def tau_b(base: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Kendall's tau-b and the sums its p-value needs, per segment."""
    by = list(by)
    cells = base.groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("_c"))
    ranks = dense_rank(base, "_x", by, cut_points(base, "_x"), "_rank")
    sizes = base.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("ties"))
    ranked = attach_ranks(cells, null_safe(ranks, sizes, [*by, "_x"]), "_x", by, max(1, base.count() // HOT_SHARE)).drop("ties")
    ranked = cut(ranked)
    largest = ranked.agg(F.max("_rank")).first()[0] or 0
    table = ordered_pairs(ranked, "_rank", "_y", "_c", "_c", int(largest), by)
    table = side_by_side(table, ranked.groupBy(*by).agg(F.sum("_c").alias("n")), by)
    for key, tag in (("_x", "x"), ("_y", "y")):
        t = F.col("_t").cast("double")
        ties = ranked.groupBy(*by, key).agg(F.sum("_c").alias("_t")).groupBy(*by).agg(
            F.sum(t * (t - 1) / 2).alias(f"{tag}t"), F.sum(t * (t - 1) * (t - 2)).alias(f"{tag}0"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{tag}1")
        )
        table = side_by_side(table, ties, by)
    n = F.col("n").cast("double")
    total = n * (n - 1) / 2
    s = 2 * F.col("less") + F.col("equal") - F.col("pairs")
    return table.withColumn("_s", s).withColumn("_r", F.try_divide(F.col("_s"), F.sqrt(total - F.col("xt")) * F.sqrt(total - F.col("yt"))))


def _kendall_p() -> Column:
    return kendall_p(*[F.col(c) for c in ("_s", "n", "x0", "x1", "xt", "y0", "y1", "yt")])


def kendall(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> StatResult:
    by = list(by)
    table = tau_b(pair(df, x, y, by), by)
    return _pack(table, "kendall", "Kendall's tau", by, False, _kendall_p(), "τ = (C − D) / √[(C+D+T_x)(C+D+T_y)]")


# -- whole table -------------------------------------------------------------------


def _pearson_pairs(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """All pairs (x <= y in column order): x, y, r, n on the rows complete for the pair."""
    numbers = df.select(*[col(b) for b in by], *[num(df, c).alias(c) for c in columns])
    if len(columns) <= WIDE:
        structs = [
            F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.corr(col(a), col(b)).alias("r"), F.count_if(col(a).isNotNull() & col(b).isNotNull()).alias("n"))
            for i, a in enumerate(columns)
            for b in columns[i:]
        ]
        names = [f"_p{i}" for i in range(len(structs))]
        wide = numbers.groupBy(*by).agg(*[s.alias(k) for s, k in zip(structs, names)])
        return wide.select(*by, F.inline(F.array(*names)))
    holes = numbers.agg(*[F.count_if(col(c).isNull()).alias(f"h{i}") for i, c in enumerate(columns)]).first()
    if any(holes):
        off = _long_pairs(df, columns, by).groupBy(*by, "x", "y").agg(F.corr("_x", "_y").alias("r"), F.count(F.lit(1)).alias("n"))
        return off.unionByName(_diagonal(df, columns, by).drop("p"))

    def finish(record):
        m = Moments(record)
        for i, a in enumerate(columns):
            for j in range(i, len(columns)):
                scale = (m.cross[i, i] * m.cross[j, j]) ** 0.5 if m.ok else 0.0
                yield {"x": a, "y": columns[j], "r": m.cross[i, j] / scale if scale > 0 else None, "n": m.n}

    return per_segment(gram(numbers, columns, by), by, [("x", "string"), ("y", "string"), ("r", "double"), ("n", "long")], finish)


def _long_pairs(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Every pair of different columns as rows (x, y, _x, _y) complete for the pair."""
    structs = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), num(df, a).alias("_x"), num(df, b).alias("_y"))
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    ]
    return df.select(*[col(b) for b in by], F.inline(F.array(*structs))).where("_x is not null and _y is not null")


def _no_gaps(df: DataFrame, columns: list[str]) -> bool:
    return not any(df.agg(*[F.count_if(num(df, c).isNull()).alias(f"h{i}") for i, c in enumerate(columns)]).first())


def _as_ranks(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Columns without gaps replaced by their average ranks: each is ranked once for all its pairs."""
    rows = df.select(*[col(b) for b in by], *[num(df, c).alias(c) for c in columns])
    hot = max(1, rows.count() // HOT_SHARE)
    out = rows
    for c in columns:
        ranks = midranks(rows, c, by).select(*by, c, "ties", "rank")
        out = attach_ranks(out, ranks, c, by, hot).drop("ties", c).withColumnRenamed("rank", c)
    return out


def _diagonal(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Every column with itself: 1, unless it is constant."""
    wide = df.groupBy(*[col(b) for b in by]).agg(
        *[
            F.struct(
                F.lit(c).alias("x"),
                F.lit(c).alias("y"),
                F.when(F.min(num(df, c)) < F.max(num(df, c)), F.lit(1.0)).alias("r"),
                F.when((F.count(num(df, c)) > 3) & (F.min(num(df, c)) < F.max(num(df, c))), F.lit(0.0)).alias("p"),
                F.count(num(df, c)).alias("n"),
            ).alias(f"_d{i}")
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(*by, F.inline(F.array(*[f"_d{i}" for i in range(len(columns))])))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson", by: Sequence[str] = ()) -> StatResult:
    """All pairs, each on its own complete rows; every pair is one segment of the pair methods."""
    by = list(by)
    columns = list(columns or numeric_columns(df, by))
    require(df, *columns, *by)
    keys = [*by, "x", "y"]
    complete_ranks = method == "spearman" and _no_gaps(df, columns)
    if method == "pearson" or complete_ranks:
        numbers = _as_ranks(df, columns, by) if complete_ranks else df
        half = _pearson_pairs(numbers, columns, by).withColumn("p", F.when(F.col("n") > 3, r_p(F.col("r"), F.col("n"))))
    elif method in ("spearman", "kendall"):
        base = cut(_long_pairs(df, columns, by))
        if method == "spearman":
            half = rank_correlation(base, keys).withColumnRenamed("_r", "r")
            half = half.withColumn("p", F.when(F.col("n") > 3, r_p(F.col("r"), F.col("n"))))
        else:
            half = tau_b(base, keys).withColumnRenamed("_r", "r").withColumn("p", F.when(F.col("n") > 3, _kendall_p()))
    else:
        raise ValueError(f"Unknown correlation method '{method}'.")
    half = half.select(*keys, "r", "p", "n")
    if method != "pearson" and not complete_ranks:
        half = half.unionByName(_diagonal(df, columns, by))
    both_ways = F.array_distinct(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
    pairwise = half.select(*by, F.inline(both_ways).alias("x", "y"), "r", "p", "n")
    matrix = pairwise.groupBy(*by, F.col("x").alias("variable")).agg(*[F.max(F.when(F.col("y") == c, F.col("r"))).alias(c) for c in columns])
    complete = drop_missing(df.select(*[col(b) for b in by], *[num(df, c).alias(c) for c in columns]), columns)
    stats = complete.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select(
        *by,
        F.lit(method).alias("method"),
        F.lit(len(columns)).cast("long").alias("n_vars"),
        "n",
        text_list(F.lit("Many pairs are tested; the p-values are not adjusted.")).alias("warnings"),
    )
    return StatResult("correlation_matrix", f"{method.title()} correlation matrix", stats, {"pairwise": pairwise, "matrix": matrix}, by=by)


def top_correlations(df: DataFrame, columns: Sequence[str] | None = None, k: int = 6, method: str = "spearman") -> DataFrame:
    """The k strongest pairs, each listed once."""
    pairs = correlation_matrix(df, columns, method).tables["pairwise"]
    return pairs.where("x < y and r is not null").orderBy(F.abs("r").desc(), "x", "y").limit(k)
