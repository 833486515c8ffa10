"""Descriptive statistics and frequency tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statweave.functions.columns import col, known, num, numeric_columns, require, text_list
from statweave.functions.tails import t_crit95
from statweave.plans.quantiles import exact_quantiles
from statweave.plans.tables import attach, cut, null_safe
from statweave.result import StatResult


def sample_skewness(g1: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population one."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1.0)) / (n - 2))


def sample_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from the population one."""
    return F.when(n > 3, F.try_divide((n - 1.0), (n - 2.0) * (n - 3.0)) * ((n + 1.0) * g2 + 6))


def long_moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per segment and column: n, mean, std, min, max, skewness, kurtosis and sign counts.

    All columns share a single aggregate pass.
    """
    by = list(by)
    values = {c: num(df, c) for c in columns}
    aggs = []
    for i, c in enumerate(columns):
        v = values[c]
        aggs.append(
            F.struct(
                F.lit(c).alias("variable"),
                F.count(v).alias("n"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                F.var_samp(v).alias("variance"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
                F.skewness(v).alias("_g1"),
                F.kurtosis(v).alias("_g2"),
                F.count_if(v == 0).alias("zeros"),
                F.count_if(v < 0).alias("negatives"),
            ).alias(f"_m{i}")
        )
    wide = df.groupBy(*by).agg(*aggs)
    rows = wide.select(*by, F.inline(F.array(*[F.col(f"_m{i}") for i in range(len(columns))])))
    n = F.col("n")
    return rows.withColumns({"skewness": sample_skewness(F.col("_g1"), n), "kurtosis": sample_kurtosis(F.col("_g2"), n)}).drop("_g1", "_g2")


def smallest_mode(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The most frequent value per segment and column, the smallest among ties.

    Values are counted by a two-step aggregate, so neither a frequent value
    nor a column of distinct values lands in one task.
    """
    by = list(by)
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), num(df, c).alias("_v")) for c in columns])
    counts = df.select(*[col(b) for b in by], F.inline(pairs)).where("_v is not null").groupBy(*by, "variable", "_v").count()
    best = F.max_by(F.col("_v"), F.struct(F.col("count"), -F.col("_v")))
    return counts.groupBy(*by, "variable").agg(best.alias("mode"))


def descriptive(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> StatResult:
    by = list(by)
    columns = [c for c in (columns or numeric_columns(df, by)) if c in df.columns]
    if not columns:
        raise ValueError("There is no numeric column to describe.")
    numbers = df.select(*[col(b) for b in by], *[num(df, c).alias(c) for c in columns])
    moments = long_moments(numbers, columns, by).where("n > 0")
    quantiles = exact_quantiles(numbers, columns, [0.05, 0.25, 0.5, 0.75, 0.95], by)
    modes = smallest_mode(numbers, columns, by)
    keys = [*by, "variable"]
    joined = null_safe(null_safe(moments, quantiles, keys), modes, keys)
    n, q, mean = F.col("n"), F.col("q"), F.col("mean")
    se = F.when(n > 1, F.col("std") / F.sqrt(n)).otherwise(F.lit(0.0))
    half = F.when(n > 1, t_crit95(F.when(n > 1, n - 1)) * se).otherwise(F.lit(0.0))
    table = joined.select(
        *keys,
        n,
        mean,
        q[2].alias("median"),
        "mode",
        F.coalesce("std", F.lit(0.0)).alias("std"),
        F.coalesce("variance", F.lit(0.0)).alias("variance"),
        "min",
        "max",
        (F.col("max") - F.col("min")).alias("range"),
        q[1].alias("q1"),
        q[3].alias("q3"),
        (q[3] - q[1]).alias("iqr"),
        q[0].alias("p05"),
        q[4].alias("p95"),
        "skewness",
        "kurtosis",
        se.alias("se"),
        (mean - half).alias("ci95_low"),
        (mean + half).alias("ci95_high"),
    )
    stats = moments.groupBy(*by).agg(F.count(F.lit(1)).alias("n_variables"), F.max("n").alias("n"), text_list().alias("warnings"))
    return StatResult("descriptive", "Descriptive statistics", stats, {"descriptives": table}, by=by)


def level_counts(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    require(df, column, *by)
    return (
        df.select(*[col(b) for b in by], known(df, column).cast("string").alias("level"))
        .where("level is not null")
        .groupBy(*by, "level")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def frequency(df: DataFrame, column: str, by: Sequence[str] = ()) -> StatResult:
    """Levels by falling count with percent and the running sum of the rounded percents."""
    by = list(by)
    counts = cut(level_counts(df, column, by))
    totals = counts.groupBy(*by).agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("n_levels"))
    stats = totals.withColumn("warnings", text_list())
    rows = attach(counts, totals.select(*by, F.col("n").alias("_n")), by).withColumn("percent", F.round(100 * F.col("count") / F.col("_n"), 2)).drop("_n")
    # Levels that round to 0.00% add nothing to the running sum; the others are at most 20,000 per segment.
    keys = [col(b) for b in by] or [F.lit(0)]
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), F.asc("level"))
    shown = rows.where("percent > 0").withColumn("cum_percent", F.round(F.sum("percent").over(order.rowsBetween(Window.unboundedPreceding, 0)), 2))
    rest = rows.where("percent = 0")
    ends = shown.groupBy(*by).agg(F.max("cum_percent").alias("cum_percent"))
    if by:
        tail = null_safe(rest, ends, by, "left").withColumn("cum_percent", F.coalesce("cum_percent", F.lit(0.0)))
    else:
        tail = rest.withColumn("cum_percent", F.lit(ends.first()["cum_percent"]).cast("double"))
    table = shown.unionByName(tail.withColumn("cum_percent", F.coalesce("cum_percent", F.lit(0.0))))
    return StatResult("frequency", "Frequency table", stats, {"frequencies": table}, by=by)
