"""Exact duplicates through an extendible-hash index on shared files, in DataFrame operations only.

A text's key is a 64-bit hash; the index has one entry per distinct key, made
with a map-side combine, so any number of copies is one entry a task.  The
directory starts with one bucket.  As long as buckets hold more entries than
their capacity, it is doubled: each overfull bucket is split by the next bits of
the key, the others keep their depth.  A bucket covers a range of keys; the
entries are written to the shared folder in key order, each task owning a
contiguous range of buckets.

Entries of more than one row are candidates.  The whole texts of their rows are
compared byte for byte by grouping, copies again collapsing on the map side, and
the distinct texts of a key form its chain.  Only keys that occur more than once
have their texts shuffled, and of those one copy a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statweave.llm.common import SPACE, forget, sized, text_of, written

# Entries that a bucket may hold.
CAPACITY = 50_000
# Bits by which overfull buckets are looked at together; each is split no deeper than it has to be.
BITS = 8
KEY_BITS = 64


def normalised(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text, SPACE, " ")


def _prefix(key: Column, depth: int) -> Column:
    """The first bits of the key as a whole number; all keys have the empty prefix 0."""
    if depth == 0:
        return F.lit(0).cast("long")
    return key if depth == KEY_BITS else F.shiftrightunsigned(key, KEY_BITS - depth)


def directory(index: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The buckets (depth, prefix, entries) of a table of distinct keys ``key``.

    No bucket holds more than ``capacity`` entries, and every one that was made by
    a split has a parent that did.  Prefixes of different depths never overlap.
    An index without entries has the one bucket that it started with.
    """
    spark = index.sparkSession
    buckets = spark.createDataFrame([(0, 0, index.count())], "depth int, prefix long, entries long")
    full, depth = buckets.where(F.col("entries") > capacity), 0
    while depth < KEY_BITS and not full.isEmpty():
        start, depth = depth, min(depth + BITS, KEY_BITS)
        inside = index
        if start:
            inside = index.join(sized(full.select(F.col("prefix").alias("_full"))), _prefix(F.col("key"), start) == F.col("_full"), "left_semi")
        counts = written(inside.groupBy(_prefix(F.col("key"), depth).alias("_p")).agg(F.count("*").alias("_n")))
        # Every ancestor of the counted prefixes, each level one doubling of the directory.
        levels = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _up("_p", depth, d).alias("prefix")) for d in range(start + 1, depth + 1)]))
        sizes = written(counts.select(levels.alias("_l"), "_n").groupBy("_l.depth", "_l.prefix").agg(F.sum("_n").alias("entries")))
        split = sizes.where(F.col("entries") > capacity).select((F.col("depth") + 1).alias("_d"), F.col("prefix").alias("_parent"))
        first = F.col("depth") == start + 1
        below = sizes.join(split, (F.col("depth") == F.col("_d")) & (_up_one("depth", "prefix") == F.col("_parent")), "left")
        reached = written(below.where(first | F.col("_d").isNotNull()).select("depth", "prefix", "entries"))
        fits = F.col("entries") <= capacity
        # A bucket that is still overfull at the last level looked at is split on in the next turn.
        buckets = written(buckets.where(fits).union(reached.where(fits)).union(reached.where(~fits & (F.col("depth") == depth))))
        full = buckets.where(F.col("entries") > capacity)
    return buckets


def _up(name: str, depth: int, to: int) -> Column:
    return F.col(name) if to == depth else F.shiftrightunsigned(F.col(name), depth - to) if to else F.lit(0).cast("long")


def _up_one(depth: str, prefix: str) -> Column:
    # At depth 64 the prefix is the key itself, whose sign bit must not be carried along.
    return F.when(F.col(depth) > 1, F.shiftrightunsigned(F.col(prefix), 1)).otherwise(F.lit(0).cast("long"))


def bucketed(index: DataFrame, buckets: DataFrame) -> DataFrame:
    """The index with ``low``, the lowest key of its bucket, which names the bucket.

    The directory is expanded to one slot per prefix of its greatest depth, as
    extendible hashing has it, where that stays small; each key looks up its slot.
    """
    depths = [r[0] for r in buckets.select("depth").distinct().collect()]
    out = None
    for depth in sorted(depths):
        slots = sized(buckets.where(F.col("depth") == depth).select(F.col("prefix").alias("_slot")))
        low = F.lit(0).cast("long") if depth == 0 else F.shiftleft(F.col("_slot"), KEY_BITS - depth) if depth < KEY_BITS else F.col("_slot")
        part = index.join(slots, _prefix(F.col("key"), depth) == F.col("_slot")).withColumn("low", low).drop("_slot")
        out = part if out is None else out.unionByName(part)
    return out


def _grouped(rows: DataFrame, capacity: int, key_bits: int) -> DataFrame:
    """The groups of rows (_row, doc_id, text), with _row."""
    key = F.xxhash64("_text")
    key = key if key_bits == KEY_BITS else F.shiftleft(F.shiftright(key, KEY_BITS - key_bits), KEY_BITS - key_bits)
    rows = rows.select("_row", "doc_id", normalised(text_of()).alias("_text"))
    rows = written(rows.select("_row", "doc_id", key.alias("key"), F.sha2("_text", 256).alias("text_sha256"), "_text"))

    entries = written(rows.groupBy("key").agg(F.count("*").alias("rows")))
    owned = bucketed(entries, directory(entries, capacity)).repartitionByRange("low").sortWithinPartitions("low", "key")
    index = written(owned)
    forget(entries)
    repeated = sized(index.where(F.col("rows") > 1).select("low", F.col("key").alias("_key")))

    # One row per distinct text of a repeated key; min_by takes the row of the smallest id.
    members = rows.select("_row", "doc_id", "key", "_text").join(repeated, F.col("key") == F.col("_key"))
    first = F.coalesce(F.min_by("_row", "doc_id"), F.min("_row")).alias("first_row")
    texts = members.groupBy("low", "key", "_text").agg(F.min("doc_id").alias("keep_id"), first, F.count("*").alias("group_size"))
    # Owner tasks take ranges of buckets and chain the texts that share a key.
    owner = Window.partitionBy("low", "key")
    chained = texts.repartitionByRange("low").withColumn("_of", F.count("*").over(owner))
    chained = written(chained.select(F.col("key").alias("_key"), F.when(F.col("_of") > 1, F.col("_text")).alias("_chained"), "keep_id", "first_row", "group_size"))

    found = ["_row", "doc_id", "key", "text_sha256", "keep_id", "first_row", "group_size"]
    alone = chained.where(F.col("_chained").isNull())
    told = rows.join(sized(alone), F.col("key") == F.col("_key"), "left").select(*found)
    collided = chained.where(F.col("_chained").isNotNull())
    if not collided.isEmpty():
        keys = sized(written(collided.select("_key").distinct()))
        told = told.join(keys, F.col("key") == F.col("_key"), "left_anti")
        same = (F.col("key") == F.col("_key")) & (F.col("_text") == F.col("_chained"))
        told = told.unionByName(rows.join(sized(collided), same).select(*found))
    single = F.col("group_size").isNull()
    return told.select(
        "_row",
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("_row") == F.col("first_row"))).alias("kept"),
        "text_sha256",
    )


def groups(documents: DataFrame, capacity: int = CAPACITY, key_bits: int = KEY_BITS) -> DataFrame:
    """Every row's group: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space is one space; a
    null text is the empty one, a text of any length counts whole.  Of equal texts
    the row with the smallest id stays, null ids after all others; of rows that
    repeat that id too exactly one stays.  A group without any id keeps one row and
    has a null keep_id.  An empty table gives no rows; other columns are ignored.
    ``key_bits`` shortens the keys, so that tests can see collisions.
    """
    rows = documents.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    return _grouped(rows, capacity, key_bits).drop("_row")


def dedup(documents: DataFrame, capacity: int = CAPACITY, key_bits: int = KEY_BITS) -> DataFrame:
    """The documents that stay, with all their columns as they are.

    Every row is carried as one value, so no column can clash with the operator's own.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    rows = written(documents.select(whole.alias("_whole")).withColumn("_row", F.monotonically_increasing_id()))
    kept = _grouped(rows.select("_row", "_whole.doc_id", "_whole.text"), capacity, key_bits).where("kept")
    return rows.join(kept.select("_row"), "_row", "left_semi").select("_whole.*")
