"""Contingency tables: chi-square, Cramér's V and Fisher's exact test."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statweave.functions.columns import col, known, raw_label, require, text_list
from statweave.functions.tails import chi2_sf, fisher_p
from statweave.operators.groups import side_by_side
from statweave.plans.tables import attach, cut, failing, null_safe
from statweave.result import StatResult

# Above this many cells only the non-empty ones are listed in the tables.


def cells(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Observed counts of the non-empty cells (raw labels, rows with a missing label dropped)."""
    require(df, x, y, *by)
    pairs = df.select(*[col(b) for b in by], raw_label(known(df, x)).alias("x"), raw_label(known(df, y)).alias("y"))
    return pairs.where("x is not null and y is not null").groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("observed"))


@F.pandas_udf(T.LongType())
def _low_cells(rows: pd.Series, columns: pd.Series, n: pd.Series) -> pd.Series:
    """Cells with expected count below 5 from (total, how many levels have it) of both sides."""
    out = []
    for r, c, total in zip(rows, columns, n):
        ct = np.array([e["total"] for e in c], float)
        cn = np.array([e["levels"] for e in c], np.int64)
        order = np.argsort(ct)
        ct, upto = ct[order], np.concatenate([[0], np.cumsum(cn[order])])
        out.append(int(sum(e["levels"] * upto[np.searchsorted(ct, 5.0 * total / e["total"], side="left")] for e in r)))
    return pd.Series(out, dtype="int64")


def _margin(table: DataFrame, side: str, by: list[str]) -> DataFrame:
    """Per level total of one side, and per segment its levels and distinct totals."""
    return table.groupBy(*by, side).agg(F.sum("observed").alias("total"))


def _margin_summary(margin: DataFrame, by: list[str], tag: str) -> DataFrame:
    # At most sqrt(2 n) totals can differ, so the list stays short whatever the number of levels.
    distinct = margin.groupBy(*by, "total").agg(F.count(F.lit(1)).alias("levels"))
    return distinct.groupBy(*by).agg(
        F.sum("levels").alias(f"{tag}_levels"), F.collect_list(F.struct("total", "levels")).alias(f"{tag}_totals")
    )


def contingency(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Cells with their margins, and one row of sums per segment."""
    by = list(by)
    observed = cut(cells(df, x, y, by))
    rows, columns = _margin(observed, "x", by), _margin(observed, "y", by)
    n = observed.groupBy(*by).agg(F.sum("observed").alias("n"))
    full = attach(attach(observed, rows.withColumnRenamed("total", "row_total"), [*by, "x"]), columns.withColumnRenamed("total", "column_total"), [*by, "y"])
    full = attach(full, n, by)
    expected = F.col("row_total").cast("double") * F.col("column_total") / F.col("n")
    gap = F.col("observed") - expected
    full = full.withColumn("expected", expected)
    # Empty cells add their expected count to chi-square; all expected counts add up to n.
    share = gap * gap / expected - expected
    a, b = F.min(F.struct("x", "y")), F.max(F.struct("x", "y"))
    sums = full.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.sum(share).alias("_share"),
        F.min(F.abs(gap)).alias("_gap"),
        F.sum(F.lit(1.0) / expected).alias("_inverse"),
        a.alias("_first"),
        b.alias("_last"),
        F.max("row_total").alias("_row"),
        F.max("column_total").alias("_column"),
    )
    shape = side_by_side(_margin_summary(rows, by, "row"), _margin_summary(columns, by, "column"), by)
    return full, side_by_side(sums, shape, by)


def _yates(n: Column) -> Column:
    """Continuity-corrected chi-square of a 2x2 table from its margins."""
    r1, c1 = F.col("_row").cast("double"), F.col("_column").cast("double")
    r2, c2 = n - r1, n - c1
    gap = F.col("_gap")  # |O - E| is the same in all four cells
    cut_gap = F.greatest(gap - F.least(gap, F.lit(0.5)), F.lit(0.0))
    inverse = n / (r1 * c1) + n / (r1 * c2) + n / (r2 * c1) + n / (r2 * c2)
    return cut_gap * cut_gap * inverse


def chi_square(df: DataFrame, x: str, y: str, by: Sequence[str] = (), method: str = "chi_square", include_empty: bool = False) -> StatResult:
    """Independence test; with Yates' correction for a 2x2 table."""
    by = list(by)
    full, sums = contingency(df, x, y, by)
    n, r, c = F.col("n"), F.col("row_levels"), F.col("column_levels")
    dof = (r - 1) * (c - 1)
    ok = F.coalesce((r >= 2) & (c >= 2), F.lit(False))
    chi2 = F.when(ok, F.when(dof == 1, _yates(n)).otherwise(F.greatest(F.col("_share") + n, F.lit(0.0))))
    v = F.sqrt(chi2 / (n * (F.least(r, c) - 1)))
    low = _low_cells(F.col("row_totals"), F.col("column_totals"), n)
    staged = sums.select(*by, n, dof.alias("df"), failing(by, ok, chi2, "The table needs two levels on both sides.").alias("chi2"), F.when(ok, v).alias("cramers_v"), low.alias("low_expected_cells"))
    v, low = F.col("cramers_v"), F.col("low_expected_cells")
    magnitude = F.when(v < 0.1, "negligible").when(v < 0.3, "small").when(v < 0.5, "medium").when(v.isNotNull(), "large")
    stats = staged.select(
        *by,
        "chi2",
        chi2_sf(F.col("chi2"), F.col("df")).alias("p_value"),
        "df",
        "n",
        v,
        low,
        F.lit("Cramér's V").alias("effect_name"),
        v.alias("effect_value"),
        magnitude.alias("effect_magnitude"),
        text_list(
            F.when(v.isNull(), F.lit("requires at least a 2×2 table")),
            F.when(low > 0, F.concat(low.cast("string"), F.lit(" cell(s) expect fewer than 5 rows; the approximation is rough."))),
        ).alias("warnings"),
    )
    label = "Cramér's V" if method == "cramers_v" else "Chi-square test of independence"
    return StatResult(method, label, stats, {"cells": cell_table(full, by, include_empty)}, formula="χ² = Σ (O−E)² / E;  V = √(χ² / (n·min(r−1,c−1)))", by=by)


def cell_table(full: DataFrame, by: list[str], include_empty: bool = False) -> DataFrame:
    """Observed and expected counts of the cells that hold rows; with ``include_empty`` of every pair of levels."""
    listed = full.select(*by, "x", "y", "observed", "expected")
    if not include_empty:
        return listed
    rows = full.select(*by, "x", "row_total", "n").distinct()
    columns = full.groupBy(*by).agg(F.collect_set(F.struct("y", "column_total")).alias("_columns"))
    grid = attach(rows, columns, by).select(*by, "x", "row_total", "n", F.inline("_columns"))
    grid = grid.select(*by, "x", "y", (F.col("row_total").cast("double") * F.col("column_total") / F.col("n")).alias("expected"))
    return null_safe(grid, full.select(*by, "x", "y", "observed"), [*by, "x", "y"], "left").select(
        *by, "x", "y", F.coalesce("observed", F.lit(0)).alias("observed"), "expected"
    )


def cramers_v(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> StatResult:
    return chi_square(df, x, y, by, "cramers_v")


def fisher_exact(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> StatResult:
    """Exact test of a 2x2 table; levels in label order."""
    by = list(by)
    observed = cut(cells(df, x, y, by))
    ends = observed.groupBy(*by).agg(
        F.min("x").alias("_x1"), F.max("x").alias("_x2"), F.min("y").alias("_y1"), F.max("y").alias("_y2")
    )
    both = attach(observed, ends, by)
    first_x, first_y = F.col("x") == F.col("_x1"), F.col("y") == F.col("_y1")
    last_x, last_y = F.col("x") == F.col("_x2"), F.col("y") == F.col("_y2")

    def count(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("observed"))), F.lit(0))

    table = both.groupBy(*by).agg(
        F.count_if(~((first_x | last_x) & (first_y | last_y))).alias("_outside"),
        (F.min(F.col("_x1") != F.col("_x2")) & F.min(F.col("_y1") != F.col("_y2"))).alias("_square"),
        count(first_x & first_y).alias("a"),
        count(first_x & last_y & ~first_y).alias("b"),
        count(last_x & ~first_x & first_y).alias("c"),
        count(last_x & ~first_x & last_y & ~first_y).alias("d"),
    )
    a, b, c, d = (F.col(k) for k in "abcd")
    ok = F.coalesce((F.col("_outside") == 0) & F.col("_square"), F.lit(False))
    odds = F.try_divide(a.cast("double") * d, b.cast("double") * c)
    stats = table.select(
        *by,
        failing(by, ok, odds, "The table must be 2×2.").alias("odds_ratio"),
        F.when(ok, fisher_p(a, b, c, d)).alias("p_value"),
        (a + b + c + d).alias("n"),
        a,
        b,
        c,
        d,
        text_list(F.when(~ok, F.lit("requires a 2×2 table"))).alias("warnings"),
    )
    return StatResult("fisher_exact", "Fisher's exact test", stats, {"observed": observed}, formula="Hypergeometric probability of tables as or more extreme than observed", by=by)
