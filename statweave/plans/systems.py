"""Linear systems and components whose unknowns are rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.functions.columns import col
from statweave.plans.tables import attach, cut, null_safe

STEPS = 1000


def conjugate_gradients(product: Callable[[DataFrame], DataFrame], rhs: DataFrame, by: Sequence[str], keys: Sequence[str], tolerance: float = 1e-24) -> DataFrame:
    """(by, keys, _x) with product(x) = _b, one system per segment, all solved side by side.

    ``rhs`` has (by, keys, _b, _d), _d the diagonal; ``product`` takes (by, keys, _x) and
    returns (by, keys, _y).  The matrix is symmetric and has no negative eigenvalue; a
    singular system must have a solution.  A step is one product and two sums a segment.
    """
    by, names = list(by), [*by, *keys]
    usable = F.when(F.col("_d") > 0, F.col("_b") / F.col("_d")).otherwise(F.lit(0.0))
    state = cut(rhs.select(*names, "_d", F.lit(0.0).alias("_x"), F.col("_b").alias("_r"), usable.alias("_p")))
    rest = F.sum(F.when(F.col("_d") > 0, F.col("_r") * F.col("_r") / F.col("_d")).otherwise(F.lit(0.0)))
    size = cut(state.groupBy(*by).agg(rest.alias("_rz")).withColumn("_first", F.col("_rz")))
    for _ in range(STEPS):
        if size.where(F.col("_rz") > tolerance * F.col("_first")).isEmpty():
            break
        made = null_safe(state, product(state.select(*names, F.col("_p").alias("_x"))), names, "left").withColumn("_y", F.coalesce("_y", F.lit(0.0)))
        made = cut(made)
        curved = attach(made.groupBy(*by).agg(F.sum(F.col("_p") * F.col("_y")).alias("_py")), size, by) if by else made.agg(F.sum(F.col("_p") * F.col("_y")).alias("_py")).crossJoin(F.broadcast(size))
        going = (F.col("_py") > 0) & (F.col("_rz") > tolerance * F.col("_first"))
        steps = cut(curved.select(*by, F.when(going, F.col("_rz") / F.col("_py")).otherwise(F.lit(0.0)).alias("_alpha"), "_rz", "_first"))
        moved = attach(made, steps.select(*by, "_alpha"), by)
        moved = cut(moved.select(*names, "_d", (F.col("_x") + F.col("_alpha") * F.col("_p")).alias("_x"), (F.col("_r") - F.col("_alpha") * F.col("_y")).alias("_r"), "_p"))
        left = moved.groupBy(*by).agg(rest.alias("_new"))
        both = attach(left, steps, by) if by else left.crossJoin(F.broadcast(steps))
        # A segment that cannot move on is done.
        size = cut(both.select(*by, F.when(F.col("_alpha") > 0, F.col("_new")).otherwise(F.lit(0.0)).alias("_rz"), "_first", F.when((F.col("_rz") > 0) & (F.col("_alpha") > 0), F.col("_new") / F.col("_rz")).otherwise(F.lit(0.0)).alias("_beta")))
        turned = attach(moved, size.select(*by, "_beta"), by)
        ahead = F.when(F.col("_d") > 0, F.col("_r") / F.col("_d")).otherwise(F.lit(0.0)) + F.col("_beta") * F.col("_p")
        state = cut(turned.select(*names, "_d", "_x", "_r", ahead.alias("_p")))
        size = size.drop("_beta")
    return state.select(*names, "_x")


def component_counts(links: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, _components) of the graphs with links (by, a, b), whose nodes are longs; every node has a link.

    Nodes are hung on the smallest in sight, larger neighbours first, smaller ones next,
    until all links lead to roots.
    """
    by = list(by)
    edges = cut(links.select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        either = edges.unionByName(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
        low = either.groupBy(*by, "a").agg(F.least(F.min("b"), F.first("a")).alias("_m"))
        larger = null_safe(either.where("b > a"), low, [*by, "a"]).select(*by, F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        low = larger.groupBy(*by, "a").agg(F.min("b").alias("_m"))
        smaller = null_safe(larger, low, [*by, "a"])
        hung = smaller.select(*by, F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b").unionByName(low.select(*by, "a", F.col("_m").alias("b")))
        before, edges = edges, cut(hung.distinct())
        if edges.count() == before.count() and edges.exceptAll(before).isEmpty():
            return edges.groupBy(*by).agg(F.count_distinct(col("b")).alias("_components"))
