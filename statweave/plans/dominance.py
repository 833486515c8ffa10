"""Counting ordered pairs that agree or disagree in a second variable.

Pairs are never formed.  Rows get a dense rank in the first variable, and the
rank is read digit by digit (base 16): two rows first differ at exactly one
digit, where they share the prefix.  At that level the pair is counted from
running sums over the second variable within the prefix.  A table of n rows
is copied once per digit (about log16 of the distinct ranks), and every
running sum is cut into bounded ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statweave.functions.columns import col
from statweave.plans.ranks import cut_points, running
from statweave.plans.tables import attach, null_safe

BITS = 4


def dense_rank(df: DataFrame, key: str, by: Sequence[str], cuts: Sequence[float], out: str) -> DataFrame:
    """One row per (by, key) with its 0-based dense rank."""
    levels = df.select(*by, key).distinct().withColumn("_one", F.lit(1).cast("long"))
    return running(levels, key, ["_one"], by, cuts, unique=True).select(*by, key, col("_one_before").alias(out))


def digits_needed(largest_rank: int) -> int:
    levels = 1
    while largest_rank >> (BITS * levels):
        levels += 1
    return levels


def ordered_pairs(df: DataFrame, rank: str, value: str, left: str, right: str, largest_rank: int, by: Sequence[str] = ()) -> DataFrame:
    """Per segment: weight of pairs (i, j) with rank_i < rank_j, split by value_i <, =, > value_j.

    A pair weighs left_i * right_j.  Returns by..., less, equal, pairs; the
    rest, pairs - less - equal, has value_i > value_j.
    """
    by = list(by)
    base = 1 << BITS
    rows = df.select(*by, col(rank).alias("_r"), col(value).alias("_v"), col(left).alias("_l"), col(right).alias("_w"))
    digits = rows.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(digits_needed(largest_rank) - 1)))).select(
        *by,
        "_level",
        F.expr(f"shiftright(_r, (_level + 1) * {BITS})").alias("_prefix"),
        F.expr(f"cast(shiftright(_r, _level * {BITS}) & {base - 1} as int)").alias("_digit"),
        "_v",
        "_l",
        "_w",
    )
    keys = [*by, "_level", "_prefix"]

    def digit_sum(d: int, weight: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_digit") == d, F.col(weight))), F.lit(0))

    cells = digits.groupBy(*keys, "_v").agg(
        *[digit_sum(d, "_l").alias(f"_l{d}") for d in range(base - 1)], *[digit_sum(d, "_w").alias(f"_w{d}") for d in range(1, base)]
    )
    ran = running(cells, "_v", [f"_l{d}" for d in range(base - 1)], keys, cut_points(digits, "_v"), unique=True)
    # Doubles: pair counts pass 2**63 long before they lose the digits that matter.
    less, equal = F.lit(0.0), F.lit(0.0)
    for d in range(1, base):
        w = F.col(f"_w{d}").cast("double")
        less = less + w * sum((F.col(f"_l{e}_before") for e in range(d)), F.lit(0))
        equal = equal + w * sum((F.col(f"_l{e}") for e in range(d)), F.lit(0))
    split = ran.groupBy(*by).agg(F.sum(less).alias("less"), F.sum(equal).alias("equal"))
    by_rank = rows.groupBy(*by, "_r").agg(F.sum("_l").alias("_l"), F.sum("_w").alias("_w"))
    ordered = running(by_rank, "_r", ["_l"], by, cut_points(rows, "_r"), unique=True)
    every = ordered.groupBy(*by).agg(F.sum(F.col("_w").cast("double") * F.col("_l_before")).alias("pairs"))
    return null_safe(split, every, by) if by else attach(split, every, [])
