"""Running sums and ranks over data-sized tables without a single-task window.

Values are cut into ranges of about equal size at approximate quantiles; the
cut points are a function of the value alone, so a recomputed task lands every
row in the same range.  A window runs inside each range, and the totals of the
earlier ranges (a small table) are added on top.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statweave.functions.columns import col
from statweave.plans import tables
from statweave.plans.tables import cut, null_safe

ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 20_000
RANGE = "_range"


def cut_points(df: DataFrame, key: str, rows_per_range: int | None = None) -> list[float]:
    """Ascending values that split ``key`` into ranges of bounded size (none if the table is small)."""
    rows_per_range = rows_per_range or ROWS_PER_RANGE
    n = df.count()
    ranges = min(MAX_RANGES, -(-n // rows_per_range))
    if ranges <= 1:
        return []
    probs = [i / ranges for i in range(1, ranges)]
    points = df.agg(F.percentile_approx(col(key).cast("double"), probs, max(10_000, 10 * ranges)).alias("p")).first()["p"]
    return sorted({p for p in points or [] if p is not None and abs(p) != float("inf")})


def with_range(df: DataFrame, key: str, cuts: Sequence[float]) -> DataFrame:
    if not cuts:
        return df.withColumn(RANGE, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    numbered = df.withColumn("_range_key", col(key).cast("double"))
    bucketizer = Bucketizer(splits=splits, inputCol="_range_key", outputCol="_range_double")
    return bucketizer.transform(numbered).withColumn(RANGE, col("_range_double").cast("int")).drop("_range_key", "_range_double")


def running(
    df: DataFrame,
    key: str,
    weights: Sequence[str],
    by: Sequence[str] = (),
    cuts: Sequence[float] = (),
    unique: bool = False,
    descending: bool = False,
) -> DataFrame:
    """Add ``<w>_before`` (sum over rows ordered strictly earlier) and ``<w>_at`` (sum at the same key).

    ``unique`` says that (by, key) occurs once, so that floating sums need no
    subtraction; the ``_at`` columns are then the weights themselves.
    """
    by = list(by)
    order = col(key).desc() if descending else col(key).asc()
    ranged = with_range(df, key, cuts)
    part = [*[col(b) for b in by], col(RANGE)]
    inside = Window.partitionBy(*part).orderBy(order)
    added = {}
    for w in weights:
        if unique:
            earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
            added[f"{w}_before"] = F.coalesce(F.sum(col(w)).over(earlier), F.lit(0).cast(df.schema[w].dataType))
            added[f"{w}_at"] = col(w)
        else:
            at = F.sum(col(w)).over(Window.partitionBy(*part, col(key)))
            upto = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
            added[f"{w}_at"] = at
            added[f"{w}_before"] = F.sum(col(w)).over(upto) - at
    out = ranged.withColumns(added)
    if not cuts:
        return out.drop(RANGE)
    totals = ranged.groupBy(*by, RANGE).agg(*[F.sum(col(w)).alias(f"_total_{w}") for w in weights])
    order_ranges = col(RANGE).desc() if descending else col(RANGE).asc()
    earlier = Window.partitionBy(*[col(b) for b in by]).orderBy(order_ranges).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, RANGE, *[F.coalesce(F.sum(f"_total_{w}").over(earlier), F.lit(0)).alias(f"_offset_{w}") for w in weights])
    # One row per range when there are no segments: at most MAX_RANGES rows.
    small = not by and len(cuts) < tables.BROADCAST_ROWS
    joined = null_safe(out, F.broadcast(offsets) if small else offsets, [*by, RANGE])
    return joined.withColumns({f"{w}_before": col(f"{w}_before") + col(f"_offset_{w}") for w in weights}).drop(
        RANGE, *[f"_offset_{w}" for w in weights]
    )


def midranks(df: DataFrame, key: str, by: Sequence[str] = (), extra: Sequence[str] = (), cuts: Sequence[float] | None = None) -> DataFrame:
    """Distinct (by, extra, key) rows with count ``n``, tied count ``ties`` and average rank ``rank``."""
    by = list(by)
    cuts = cut_points(df, key) if cuts is None else cuts
    collapsed = df.groupBy(*by, *extra, key).agg(F.count(F.lit(1)).alias("n"))
    ranked = running(collapsed, key, ["n"], by, cuts)
    return ranked.select(
        *by, *extra, key, "n", col("n_at").alias("ties"), (col("n_before") + (col("n_at") + 1) / 2.0).alias("rank")
    )


def attach_ranks(cells: DataFrame, ranks: DataFrame, key: str, by: Sequence[str], hot_rows: int) -> DataFrame:
    """Join rank columns to cells by value, keeping frequent values away from the shuffle.

    ``ranks`` holds one row per (by, key) with its count in ``ties``.  A short
    rank table is broadcast whole.  Of a long one, values with at least
    ``hot_rows`` occurrences are few by construction, so they are broadcast;
    the rest are spread evenly and joined by key.
    """
    keys = [*by, key]
    ranks = cut(ranks)
    if ranks.limit(tables.BROADCAST_ROWS + 1).count() <= tables.BROADCAST_ROWS:
        return null_safe(cells, F.broadcast(ranks), keys)
    hot = ranks.where(col("ties") >= hot_rows)
    if hot.isEmpty():
        return null_safe(cells, ranks, keys)
    marked = null_safe(cells, F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    columns = [c for c in ranks.columns if c not in keys]
    warm = marked.where(col("_hot")).drop("_hot")
    cold = marked.where(col("_hot").isNull()).drop("_hot", *columns)
    return warm.unionByName(null_safe(cold, ranks.where(col("ties") < hot_rows), keys))
