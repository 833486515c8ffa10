"""Document fingerprints from closed syncmers of words, in DataFrame operations only.

A window of WINDOW words is an anchor when, of the hashes of its inner runs of
INNER words, the smallest is that of its first or its last run.  Whether a window
is an anchor depends on its words alone, not on what stands around it, so texts
that share a passage share its anchors, at shifted places.

The fingerprint keeps the smallest anchor hash in each of BINS equal ranges of
hashes.  Its length is bounded, equal texts have equal ones, and the share of
ranges with the same hash estimates the likeness of the texts' anchors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statweave.llm.common import sized, text_of, written

WINDOW = 6
INNER = 2
BITS = 7
BINS = 1 << BITS
# Rows in a block of neighbouring ids, on average.
BLOCK_ROWS = 500
RUNS = WINDOW - INNER + 1


def _at(array: str, place: Column, ahead: int = 0) -> Column:
    return F.try_element_at(F.col(f"`{array}`"), place + ahead if ahead else place)


def _with_runs(rows: DataFrame, text: str) -> DataFrame:
    """Add _words, and _runs: the hashes of the runs of INNER words."""
    words = F.filter(F.split(F.col(f"`{text}`"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = rows.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w)))
    places = F.when(F.size("_words") >= WINDOW, F.sequence(F.lit(1), F.size("_words") - (INNER - 1)))
    return hashed.withColumn("_runs", F.transform(places, lambda i: F.xxhash64(*[_at("_words", i, j) for j in range(INNER)])))


def anchors(rows: DataFrame, text: str = "text", column: str = "anchors") -> DataFrame:
    """``rows`` with an array of (place, hash) of the anchors of a text; place is the first word's, from 1.

    A text in which no window qualifies is one anchor, as is one of fewer words
    than a window; a text without words has none, and a null text counts as empty.
    A column of the same name is replaced.
    """
    kept = [f"`{c}`" for c in rows.columns if c != column]
    made = _with_runs(rows.select(*kept, text_of(text).alias("_text")), "_text")
    last = F.greatest(F.size("_words") - (WINDOW - 1), F.lit(1))

    def edge(i: Column) -> Column:
        return F.least(_at("_runs", i), _at("_runs", i, RUNS - 1)) <= F.least(*[_at("_runs", i, j) for j in range(1, RUNS - 1)])

    def value(i: Column) -> Column:
        return F.xxhash64(*[_at("_runs", i, j) for j in range(0, RUNS, INNER)])

    found = F.transform(F.filter(F.sequence(F.lit(1), last), edge), lambda i: F.struct(i.alias("place"), value(i).alias("hash")))
    none = F.array().cast("array<struct<place:int,hash:bigint>>")
    whole = F.array(F.struct(F.lit(1).alias("place"), F.xxhash64("_words").alias("hash")))
    short = F.size("_words") < WINDOW
    out = F.when(F.size("_words") == 0, none).when(short | (F.size("_found") == 0), whole).otherwise(F.col("_found"))
    return made.withColumn("_found", F.when(~short, found)).select(*kept, out.alias(column))


def sketch(rows: DataFrame, text: str, column: str) -> DataFrame:
    """``rows`` with the smallest anchor hash of each range of hashes, ascending."""
    kept = [f"`{c}`" for c in rows.columns if c != column]
    made = anchors(rows, text, "_anchors").select(*kept, F.sort_array(F.array_distinct(F.col("_anchors.hash"))).alias("_sorted"))
    first = F.filter("_sorted", lambda x, i: (i == 0) | (F.shiftrightunsigned(x, 64 - BITS) != F.shiftrightunsigned(F.try_element_at("_sorted", F.greatest(i, F.lit(1))), 64 - BITS)))
    return made.select(*kept, first.alias(column))


def text_form(sketch_: Column) -> Column:
    """The fingerprint as text: sixteen hexadecimal digits for each hash; empty for a text without words."""
    return F.array_join(F.transform(sketch_, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of ranges in which two sketches have the same hash, of those in which either has one; 1 for two empty ones."""
    bins = lambda s: F.transform(s, lambda x: F.shiftrightunsigned(x, 64 - BITS))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def with_next(rows: DataFrame, prepare: Callable[[DataFrame], DataFrame], columns: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``prepare(rows)`` with ``next_<column>`` of the next row in descending doc_id, the first row's after the last.

    Rows lie in blocks of ids of equal width; each block gets the first row of the
    block after it as one more row, so no sort spans blocks.  Null ids come last;
    equal ids are ordered by their other columns.
    """
    ids = rows.select("doc_id")
    low, high, count = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, high = (low, high) if low is not None else (0, 0)
    blocks = max(1, -(-count // block_rows))
    width = float(high - low + 1) / blocks
    block = F.coalesce(F.floor((F.col("doc_id").cast("double") - float(low)) / width), F.lit(-1)).cast("long")
    placed = rows.withColumn("_block", block)
    heads = ids.withColumn("_block", block).groupBy("_block").agg(F.max("doc_id").alias("_head"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("_block"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("_block", F.lead(F.struct("_head")).over(order).alias("_next"), F.first(F.struct("_head")).over(whole).alias("_first"))
    links = written(after.select(F.col("_block").alias("_to"), F.coalesce("_next", "_first").getField("_head").alias("_head")))
    extra = rows.join(sized(links), F.col("doc_id").eqNullSafe(F.col("_head"))).withColumn("_block", F.col("_to")).select(*[f"`{c}`" for c in rows.columns], "_block")
    both = placed.withColumn("_extra", F.lit(False)).unionByName(extra.withColumn("_extra", F.lit(True)))
    within = Window.partitionBy("_block").orderBy("_extra", F.col("doc_id").desc_nulls_last(), *[f"`{c}`" for c in columns])
    led = prepare(both).select("*", *[F.lead(f"`{c}`").over(within).alias(f"next_{c}") for c in columns])
    return led.where(~F.col("_extra")).drop("_block", "_extra")


def compare(documents: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how like they are.

    An edited text has its last third (rounded down, in code points) replaced by
    as much of the next document's beginning.  Null texts count as empty;
    repeated rows and null ids are rows like any other.
    """
    rows = documents.select("doc_id", text_of().alias("text"))
    led = with_next(rows, lambda r: sketch(r, "text", "sketch"), ["text", "sketch"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    whole = led.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    again = sketch(whole, "edited", "edited_sketch")
    return again.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text_form(F.col("sketch")).alias("fingerprint"),
        text_form(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
