"""Exact linear-interpolation quantiles whose memory does not grow with the data.

``percentile`` keeps one counter per distinct value and group.  Columns shown
(by a sketch) to have few distinct values use it directly.  For the others a
sketch brackets each wanted rank, only the rows inside the brackets are
counted by value, and the exact order statistics are picked from those counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.functions.columns import col
from statweave.plans.ranks import cut_points, running
from statweave.plans.tables import attach, cut, null_safe

DISTINCT_LIMIT = 100_000
SKETCH_ACCURACY = 20_000


def exact_quantiles(df: DataFrame, values: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Long table (by..., variable, q array<double>) of exact quantiles of numeric columns."""
    by = list(by)
    sizes = df.agg(*[F.approx_count_distinct(col(v), 0.05).alias(f"d{i}") for i, v in enumerate(values)]).first()
    few = [v for i, v in enumerate(values) if sizes[i] <= DISTINCT_LIMIT]
    many = [v for v in values if v not in few]
    parts = []
    if few:
        wide = df.groupBy(*by).agg(
            *[F.percentile(col(v), F.array(*[F.lit(float(p)) for p in probs])).alias(f"_q{i}") for i, v in enumerate(few)]
        )
        rows = F.array(*[F.struct(F.lit(v).alias("variable"), col(f"_q{i}").alias("q")) for i, v in enumerate(few)])
        parts.append(wide.select(*by, F.inline(rows)))
    for v in many:
        parts.append(_bracketed(df.select(*by, col(v).alias("_v")).where("_v is not null"), probs, by).withColumn("variable", F.lit(v)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*by, "variable", "q")


def _bracketed(base: DataFrame, probs: Sequence[float], by: list[str]) -> DataFrame:
    accuracy = SKETCH_ACCURACY
    while True:
        picked = cut(_pick(base, probs, by, accuracy))
        if picked.where(F.exists("q", lambda v: v.isNull())).isEmpty():
            return picked
        accuracy //= 10  # wider brackets; the widest hold every row
        if accuracy < 2:
            raise RuntimeError("quantile brackets did not hold the wanted ranks")


def _pick(base: DataFrame, probs: Sequence[float], by: list[str], accuracy: int) -> DataFrame:
    slack = 3.0 / accuracy
    wanted = [p for q in probs for p in (max(0.0, q - slack), min(1.0, q + slack))]
    sketch = base.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", wanted, accuracy).alias("_a"),
    )
    bounds = []
    for j, q in enumerate(probs):
        low = F.col("_min") if wanted[2 * j] == 0.0 else F.col("_a")[2 * j]
        high = F.col("_max") if wanted[2 * j + 1] == 1.0 else F.col("_a")[2 * j + 1]
        bounds += [low.alias(f"_lo{j}"), high.alias(f"_hi{j}")]
    brackets = cut(sketch.select(*by, "_n", *bounds))
    # Rows below a bracket only count; rows inside keep their value; the rest drop out.
    marks = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col("_v") <= F.col(f"_hi{j}"),
                    F.struct(F.lit(j).alias("_j"), F.when(F.col("_v") >= F.col(f"_lo{j}"), F.col("_v")).alias("_x")),
                )
                for j in range(len(probs))
            ]
        )
    )
    counted = cut(
        attach(base, brackets, by).select(*by, F.inline(marks)).groupBy(*by, "_j", "_x").agg(F.count(F.lit(1)).alias("n"))
    )
    below = counted.where("_x is null").groupBy(*by, "_j").agg(F.sum("n").alias("_below"))
    inside = counted.where("_x is not null")
    ordered = running(inside, "_x", ["n"], [*by, "_j"], cut_points(inside, "_x"), unique=True)
    placed = null_safe(ordered, below, [*by, "_j"], "left").withColumn("_first", F.coalesce("_below", F.lit(0)) + F.col("n_before"))
    sized = attach(placed, brackets.select(*by, "_n"), by)
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_j") + 1)
    rank = (F.col("_n") - 1) * prob
    held = lambda r: (F.col("_first") <= r) & (r < F.col("_first") + F.col("n"))
    picked = sized.groupBy(*by, "_j").agg(
        F.max(F.when(held(F.floor(rank)), F.col("_x"))).alias("_low"),
        F.max(F.when(held(F.ceil(rank)), F.col("_x"))).alias("_high"),
        F.max(rank - F.floor(rank)).alias("_part"),
    )
    value = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")
    listed = F.array(*[F.max(F.when(F.col("_j") == j, value)) for j in range(len(probs))])
    return picked.groupBy(*by).agg(listed.alias("q"))
