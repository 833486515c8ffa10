"""Seeded samples of bounded size per segment."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statweave.functions.columns import ROW_ID, col
from statweave.plans.tables import attach


def draw_number(df: DataFrame, key: str | Sequence[str] | None, seed: int) -> Column:
    """Uniform number in [0, 1) per row: from a row key if there is one, so that it does not depend on the layout."""
    if key is None and ROW_ID in df.columns:
        key = ROW_ID
    if key is None:
        return F.rand(seed)
    keys = [key] if isinstance(key, str) else list(key)
    mixed = F.xxhash64(F.lit(seed), *[col(k) for k in keys])
    return (mixed.cast("double") / 2.0**64) + 0.5


def sample_per_segment(df: DataFrame, k: int, by: Sequence[str], draw: str) -> DataFrame:
    """Exactly min(k, n) rows of every segment: those with the smallest draw numbers.

    A cut-off known from the segment's size keeps about k rows before the
    final ranking, so a huge segment never reaches one task.
    """
    by = list(by)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    limit = k + 8 * math.sqrt(k) + 30
    near = attach(df, sizes, by).where(col(draw) * F.col("_size") < limit).drop("_size")
    order = Window.partitionBy(*([col(b) for b in by] or [F.lit(0)])).orderBy(col(draw))
    return near.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k).drop("_place")
