"""Outcome-by-group preparation shared by the group-comparison methods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statweave.functions.columns import col, is_missing, known, label_column, num, present, raw_label, require
from statweave.functions.tails import f_sf
from statweave.plans.quantiles import exact_quantiles
from statweave.plans.tables import attach, centre, null_safe

Y, G = "_y", "_g"


def as_list(value) -> list[str]:
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def outcome(df: DataFrame, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Segment keys and the numeric, non-missing outcome."""
    require(df, y, *by)
    return df.where(present(df, y)).select(*[col(b) for b in by], num(df, y).alias(Y))


def grouped(df: DataFrame, y: str, g: str, by: Sequence[str] = (), levels: Sequence[str] | None = None, normalize: bool = True) -> DataFrame:
    """Segment keys, numeric outcome and group label of the complete rows."""
    require(df, y, g, *by)
    label = label_column(df, g) if normalize else raw_label(known(df, g))
    rows = df.where(present(df, y) & ~is_missing(df, g))
    out = rows.select(*[col(b) for b in by], num(df, y).alias(Y), label.alias(G))
    if levels:
        out = out.where(col(G).isin([str(v).strip().title() if normalize else str(v) for v in levels]))
    return out


def group_moments(data: DataFrame, by: Sequence[str] = (), y: str = Y) -> DataFrame:
    return data.groupBy(*by, G).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(col(y)).alias("mean"),
        F.coalesce(F.var_samp(col(y)), F.lit(0.0)).alias("var"),
    )


def between_within(moments: DataFrame, by: Sequence[str], middle: float) -> DataFrame:
    """k, n, ss_between and ss_within per segment from the group table.

    ``middle`` is any value near the overall mean; it only keeps the sums of
    squared group means from cancelling.
    """
    shift = F.col("mean") - F.lit(middle)
    sums = moments.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * shift).alias("_s1"),
        F.sum(F.col("n") * shift * shift).alias("_s2"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("ss_within"),
        F.min("n").alias("min_n"),
    )
    between = F.greatest(F.col("_s2") - F.try_divide(F.col("_s1") * F.col("_s1"), F.col("n")), F.lit(0.0))
    return sums.withColumn("ss_between", between).drop("_s1", "_s2")


def f_ratio() -> Column:
    """F of a table with k, n, ss_between and ss_within."""
    within = F.try_divide(F.col("ss_within"), (F.col("n") - F.col("k")).cast("double"))
    return F.try_divide(F.try_divide(F.col("ss_between"), (F.col("k") - 1).cast("double")), within)


def group_medians(data: DataFrame, by: Sequence[str] = (), y: str = Y) -> DataFrame:
    found = exact_quantiles(data, [y], [0.5], [*by, G])
    return found.select(*by, G, F.col("q")[0].alias("median"))


def levene_table(data: DataFrame, by: Sequence[str] = (), medians: DataFrame | None = None) -> DataFrame:
    """Median-centred Levene statistic per segment: W, p-value and k."""
    medians = group_medians(data, by) if medians is None else medians
    spread = attach(data, medians, [*by, G]).select(*by, G, F.abs(col(Y) - F.col("median")).alias("_z"))
    table = between_within(group_moments(spread, by, "_z"), by, centre(spread, ["_z"])[0])
    return table.select(
        *by,
        f_ratio().alias("levene_W"),
        f_sf(f_ratio(), F.col("k") - 1, F.col("n") - F.col("k")).alias("levene_p"),
        F.col("k").alias("levene_k"),
        F.col("n").alias("levene_n"),
    )


def two_groups(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The first and second group (label order) of each segment, side by side."""
    columns = [c for c in moments.columns if c not in by]
    record = F.struct(F.col(G), *[F.col(c) for c in columns if c != G])
    pair = moments.groupBy(*by).agg(F.min(record).alias("_a"), F.max(record).alias("_b"), F.count(F.lit(1)).alias("n_groups"))
    fields = []
    for tag, side in (("1", "_a"), ("2", "_b")):
        fields.append(F.col(f"{side}.{G}").alias(f"group_{tag}"))
        fields += [F.col(f"{side}.{c}").alias(f"{c}_{tag}") for c in columns if c != G]
    return pair.select(*by, "n_groups", *fields)


def pooled_d() -> Column:
    """Cohen's d from n, mean and var of both groups."""
    n1, n2 = F.col("n_1"), F.col("n_2")
    pooled = F.sqrt(((n1 - 1) * F.col("var_1") + (n2 - 1) * F.col("var_2")) / F.greatest(n1 + n2 - 2, F.lit(1)))
    return F.when(pooled == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("mean_1") - F.col("mean_2"), pooled))


def hedges(d: Column, n: Column) -> Column:
    return F.when(n <= 2, d).otherwise(d * (1 - F.try_divide(F.lit(3.0), 4.0 * n - 9)))


def side_by_side(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join two per-segment result tables."""
    if by:
        return null_safe(left, right, by, "left")
    return attach(left, right, [])
