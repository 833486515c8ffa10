"""Row positions, and windows over positions, without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statweave.functions.columns import ROW_ID, col
from statweave.plans.tables import cut, null_safe

ROWS_PER_CHUNK = 1_000_000
POS = "_pos"
CHUNK = "_chunk"
HALO = "_halo"


def order_columns(df: DataFrame, order_by: str | Sequence[str] | None) -> list[str]:
    """The columns that fix the row order; the stored row number by default."""
    if order_by is None:
        if ROW_ID in df.columns:
            return [ROW_ID]
        raise ValueError("This operation depends on row order: pass order_by, or ingest the table to number its rows.")
    return [order_by] if isinstance(order_by, str) else list(order_by)


def positions(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), rows_per_chunk: int | None = None) -> DataFrame:
    """Add the 0-based position of each row within its segment.

    Small segments use one ordinary window.  Larger ones are range-partitioned
    on the whole order key (so that a hot key is split by the next column),
    numbered inside each partition, and shifted by the earlier counts.
    """
    limit = rows_per_chunk or ROWS_PER_CHUNK
    by = list(by)
    order_cols = [col(o) for o in order]
    sizes = df.groupBy(*by).count()
    largest, total = sizes.agg(F.max("count"), F.sum("count")).first()
    keys = [col(b) for b in by]
    if (largest or 0) <= limit:
        window = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order_cols)
        return df.withColumn(POS, F.row_number().over(window).cast("long") - 1)
    parts = max(2, -(-total // limit))
    # A last tie-breaker lets the range exchange split rows that are equal in all order columns.
    order_cols.append(col("_tie"))
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    # Range bounds come from sampling, so the assignment is pinned before it is used twice.
    ranged = cut(tied.repartitionByRange(parts, *keys, *order_cols).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, col("_part")).orderBy(*order_cols)
    counts = ranged.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    numbered = ranged.withColumn(POS, F.row_number().over(inside).cast("long") - 1)
    small = not by  # one row per partition of the range exchange
    joined = null_safe(numbered, F.broadcast(offsets) if small else offsets, [*by, "_part"])
    return joined.withColumn(POS, col(POS) + col("_offset")).drop("_part", "_offset", "_tie")


def chunked(df: DataFrame, halo: int, rows_per_chunk: int | None = None) -> DataFrame:
    """Split positioned rows into chunks; each also gets the ``halo`` rows before it.

    Windows that look back at most ``halo`` rows then run per (segment, chunk).
    Rows marked ``_halo`` are copies and must be filtered out afterwards.
    """
    size = max(rows_per_chunk or ROWS_PER_CHUNK, halo + 1)
    own = F.floor(col(POS) / size)
    spill = F.when(col(POS) % size >= size - halo, own + 1) if halo > 0 else F.lit(None).cast("long")
    copies = F.array_compact(F.array(own, spill))
    return df.withColumn("_own", own).withColumn(CHUNK, F.explode(copies)).withColumn(HALO, col(CHUNK) != col("_own")).drop("_own")


def chunk_window(by: Sequence[str] = ()):
    return Window.partitionBy(*[col(b) for b in by], col(CHUNK)).orderBy(col(POS))


def carry(df: DataFrame, value: str, out: str, by: Sequence[str] = (), forward: bool = True, rows_per_chunk: int | None = None) -> DataFrame:
    """Last (or next) known value by position, across chunks.

    The last known value of every earlier chunk is found on the chunk table
    (one row per chunk), then rows before the first known value of a chunk
    take it.
    """
    by = list(by)
    size = rows_per_chunk or ROWS_PER_CHUNK
    staged = df.withColumn(CHUNK, F.floor(col(POS) / size))
    order = col(POS).asc() if forward else col(POS).desc()
    chunk_order = col(CHUNK).asc() if forward else col(CHUNK).desc()
    pick = F.max_by if forward else F.min_by
    keys = [col(b) for b in by]
    known = F.when(col(value).isNotNull(), col(POS))
    edge = staged.groupBy(*by, CHUNK).agg(pick(col(value), known).alias("_edge"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
    edges = edge.select(*by, CHUNK, F.last("_edge", ignorenulls=True).over(earlier).alias("_carried"))
    inside = Window.partitionBy(*keys, col(CHUNK)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = staged.withColumn("_local", F.last(col(value), ignorenulls=True).over(inside))
    joined = null_safe(filled, edges, [*by, CHUNK])
    return joined.withColumn(out, F.coalesce("_local", "_carried")).drop("_local", "_carried", CHUNK)
