"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled by a seeded hash within their source and ranked there.  A row's
fractional rank is (rank + 1/2) / rows of its source.  In the order of fractional
ranks every source is spread evenly, so equal cuts of that order give shards that
hold the same mixture, with row counts at most one apart.

Neither step sorts a source or the table in one task.  Ranks come from buckets of
the hash, places from buckets of the fractional rank: the counts of the buckets,
a small table, give what lies before each, and rows are numbered within theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statweave.llm.common import sized, written

SHARDS = 8
SEED = 17
# Rows in a bucket, on average.
BUCKET_ROWS = 20_000


def _before(counts: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Add _before: the rows in earlier buckets of the same keys, from a table of one row per key and bucket."""
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return counts.withColumn("_before", F.sum("_rows").over(by.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)))


def shuffled(rows: DataFrame, seed: int = SEED) -> Column:
    """The hash that orders rows within their source."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in rows.columns])


def interleave(rows: DataFrame, source: str = "source", shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard).

    Every row gets a place, repeated rows one each; a null source is a source of
    its own; no rows give no rows.  All columns that are passed in take part in
    the shuffle, so pass only what identifies a row.  Columns of the added names
    are replaced.
    """
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    rows = rows.select(*[f"`{c}`" for c in names])
    whole = F.struct(*[F.col(f"`{c}`") for c in names])
    keyed = rows.select(whole.alias("_row"), F.col(f"`{source}`").cast("string").alias("_source"), shuffled(rows, seed).alias("_hash"))
    hashed = written(keyed)
    total = hashed.count()
    buckets = max(1, -(-total // bucket_rows))

    # Rank within the source: buckets of equal width over the hash.
    place = F.floor((F.col("_hash") / F.lit(2.0**64) + F.lit(0.5)) * buckets)
    dealt = hashed.withColumn("_bucket", F.least(place, F.lit(buckets - 1)).cast("int"))
    counts = dealt.groupBy("_source", "_bucket").agg(F.count("*").alias("_rows"))
    sizes = _before(counts, ["_source"], "_bucket").withColumn("_of", F.sum("_rows").over(Window.partitionBy("_source")))
    sizes = sized(written(sizes.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), "_before", "_of")))
    within = Window.partitionBy("_source", "_bucket").orderBy("_hash", "_row")
    ranked = dealt.withColumn("_rank", F.row_number().over(within)).join(sizes, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    fraction = (F.coalesce("_before", F.lit(0)) + F.col("_rank") - F.lit(0.5)) / F.col("_of")
    spread = written(ranked.select("_row", "_source", "_hash", fraction.alias("_fraction")))

    # Place in the whole order: buckets of equal width over the fractional rank.
    dealt = spread.withColumn("_bucket", F.least(F.floor(F.col("_fraction") * buckets), F.lit(buckets - 1)).cast("int"))
    counts = dealt.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    starts = sized(written(_before(counts, [], "_bucket").select(F.col("_bucket").alias("_b"), "_before")))
    order = Window.partitionBy("_bucket").orderBy("_fraction", "_source", "_hash", "_row")
    numbered = dealt.withColumn("_number", F.row_number().over(order)).join(starts, F.col("_bucket") == F.col("_b"))
    place = (F.coalesce("_before", F.lit(0)) + F.col("_number") - 1).cast("long")
    # Shard s holds the places from floor(s total / shards) up to the next.
    placed = numbered.select("_row", place.alias("_place")).withColumn("shard", F.expr(f"int((({shards} * (_place + 1)) - 1) div {max(total, 1)})"))
    first = F.expr(f"(shard * {total}L) div {shards}")
    return placed.select("_row.*", "shard", (F.col("_place") - first).alias("slot"))


def mixture(sharded: DataFrame, source: str = "source") -> DataFrame:
    """Rows of each source in each shard, to see how even the mixture is."""
    return sharded.groupBy("shard", source).agg(F.count("*").alias("rows"))
