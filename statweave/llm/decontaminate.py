"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

An item lies in the partition of its shingle count (powers of two).  Its MinHash
sketch holds its smallest shingle hashes, as many as the partition needs: an item
of n shingles that is contained to the share t misses at most n - ceil(t n) of
them, so one more hash than that always meets a document that contains it,
however long the document is.  Documents probe with all their shingles; what a
sketch hash meets is a candidate, and exact containment of the shingles decides.

An item of under five words is one shingle of all its words, as such a document
is: it is found where it is the whole document, not inside a longer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statweave.llm.common import sized, text_hashes, text_key, text_of, written

WORDS = 5
CONTAINMENT = 0.75


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; the empty text has none."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _grams(words_: str, make) -> Column:
    """``make`` at each place of a shingle; one shingle of all words where there are fewer than five."""
    last = F.greatest(F.size(words_) - (WORDS - 1), F.lit(1))
    places = F.when(F.size(words_) > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: make(words_, i))


def _joined(words_: str, start: Column) -> Column:
    return F.array_join(F.slice(words_, start, WORDS), " ")


def _hashed(words_: str, start: Column) -> Column:
    return F.xxhash64(*[F.try_element_at(words_, start + j) for j in range(WORDS)])


def items(benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """One row per distinct item: its shingles, how many a document must hold, and its sketch.

    Items without words have no shingles and are left out.
    """
    rows = benchmark.select("item_id", text_of().alias("_text")).distinct()
    parts = rows.select(F.xxhash64("item_id", "_text").alias("_item"), "item_id", words(F.col("_text")).alias("_words"))
    hashed = parts.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    grams = hashed.select("_item", "item_id", F.array_distinct(_grams("_words", _joined)).alias("shingles"), F.array_distinct(_grams("_hashes", _hashed)).alias("_grams"))
    n = F.size("shingles")
    largest = F.pow(F.lit(2.0), F.floor(F.log2(n)) + 1) - 1  # of the item's size partition
    length = F.floor(largest * (1 - containment) + 1e-9).cast("int") + 1
    needed = F.ceil(n * F.lit(containment) - 1e-9).cast("int")
    return grams.where(n > 0).select("_item", "item_id", "shingles", needed.alias("needed"), F.slice(F.sort_array("_grams"), F.lit(1), length).alias("sketch"))


def matches(documents: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """Pairs of a text (its keys _k1, _k2) and an item that it contains to the given share, with the counts.

    Null and empty texts and items match nothing; equal texts are searched once;
    items of the same id and text count once.
    """
    known = written(items(benchmark, containment))
    sketch = sized(written(known.select("_item", "needed", F.explode("sketch").alias("_gram"))))
    texts = documents.select(*text_key(text_of()), text_of().alias("_text"))
    hashes = texts.select("_k1", "_k2", F.transform(words(F.col("_text")), lambda w: F.xxhash64(w)).alias("_hashes"))
    probes = hashes.select("_k1", "_k2", F.explode(_grams("_hashes", _hashed)).alias("_gram"))
    candidates = written(probes.join(sketch, "_gram").select("_k1", "_k2", "_item").distinct())
    wanted = sized(written(candidates.select("_k1", "_k2").distinct()))
    chosen = texts.join(wanted, ["_k1", "_k2"], "left_semi").groupBy("_k1", "_k2").agg(F.first("_text").alias("_text"))
    grams = chosen.select("_k1", "_k2", words(F.col("_text")).alias("_words")).select("_k1", "_k2", F.array_distinct(_grams("_words", _joined)).alias("_grams"))
    pairs = candidates.join(grams, ["_k1", "_k2"]).join(sized(known), "_item")
    shared = F.size(F.array_intersect("_grams", "shingles"))
    counted = pairs.select("_k1", "_k2", "item_id", F.size("shingles").alias("n_shingles"), shared.alias("n_shared"), "needed")
    return counted.where(F.col("n_shared") >= F.col("needed")).drop("needed")


def contaminated(documents: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, n_shingles, n_shared, containment.

    Repeated rows and null ids give rows like any other.
    """
    found = sized(written(matches(documents, benchmark, containment)))
    keyed = documents.select("doc_id", *text_key(text_of()))
    pairs = keyed.join(found, ["_k1", "_k2"]).drop("_k1", "_k2")
    return pairs.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def clean(documents: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The documents, all columns as they are, without those that contain an item."""
    found = sized(written(matches(documents, benchmark, containment).select("_k1", "_k2").distinct()))
    k1, k2 = text_hashes(text_of())
    marked = documents.join(found, (k1 == found["_k1"]) & (k2 == found["_k2"]), "left_anti")
    return marked.select(*[f"`{c}`" for c in documents.columns])
