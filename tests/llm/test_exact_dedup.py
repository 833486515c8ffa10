"""Exact duplicates against a plain dictionary of texts, and the directory's invariants."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from statweave.llm import exact_dedup

SCHEMA = "doc_id long, text string, source string"


def plain(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [f"text {i} of words {rng.random()}" for i in range(120)]
    out = [(i, rng.choice(texts), "s") for i in range(400)]
    out += [(1000 + i, "the hot text" if i % 2 else "the \t hot\n\ntext", None) for i in range(300)]
    out += [(500, None, "s"), (501, "", "s"), (502, " ", "s"), (503, "\n\t ", "s"), (504, "a\x1cb", "s"), (505, "a b", "s"), (506, "x" * 200_000, "s"), (507, "x" * 200_000, "t")]
    out += [(600, "same id", "a"), (600, "same id", "a"), (600, "same id", "b"), (601, "same  id", "b"), (600, "other text", "a")]
    out += [(None, "the hot text", "s"), (None, "no id at all", "s"), (None, "no id  at all", "s"), (None, None, "s")]
    return out


def expected(rows):
    groups = {}
    for i, text, _ in rows:
        groups.setdefault(plain(text), []).append(i)
    low = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted([(i, low[plain(t)], len(groups[plain(t)]), hashlib.sha256(plain(t).encode()).hexdigest()) for i, t, _ in rows], key=str), groups, low


@pytest.mark.parametrize("capacity, key_bits", [(50_000, 64), (7, 64), (3, 6), (1, 64)])
def test_groups_agree_with_a_dictionary(spark, rows, capacity, key_bits):
    found = exact_dedup.groups(spark.createDataFrame(rows, SCHEMA).repartition(5), capacity, key_bits).collect()
    wanted, groups, low = expected(rows)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], key=str) == wanted
    kept = [r for r in found if r.kept]
    assert len(kept) == len(groups) and len({r.text_sha256 for r in kept}) == len(groups)
    assert all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("small_broadcasts", [False, True])
def test_large_paths_give_the_same(spark, rows, small_broadcasts, monkeypatch):
    from statweave.llm import common

    if small_broadcasts:
        monkeypatch.setattr(common, "BROADCAST_BYTES", 1)
    found = exact_dedup.groups(spark.createDataFrame(rows, SCHEMA), 5, 8).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], key=str) == expected(rows)[0]


@pytest.mark.parametrize("capacity", [1, 4, 1000])
def test_directory_covers_every_key_once(spark, capacity):
    index = spark.range(300).select(F.when(F.col("id") < 40, F.col("id")).otherwise(F.xxhash64("id")).alias("key"))
    buckets = [r.asDict() for r in exact_dedup.directory(index, capacity).collect()]
    assert sum(b["entries"] for b in buckets) == 300 and all(b["entries"] <= capacity for b in buckets)
    keys = [r.key % 2**64 for r in index.collect()]
    for b in buckets:
        depth, prefix = b["depth"], b["prefix"] % 2**64
        assert sum(k >> (64 - depth) == prefix for k in keys) == b["entries"]
        # Its parent was overfull, so it had to be split.
        assert depth == 0 or sum(k >> (65 - depth) == prefix >> 1 for k in keys) > capacity
    placed = exact_dedup.bucketed(index, exact_dedup.directory(index, capacity)).collect()
    assert sorted(r.key for r in placed) == sorted(k - 2**64 if k >= 2**63 else k for k in keys)


def test_documents_that_stay_keep_their_columns(spark, rows):
    clash = spark.createDataFrame([(i, t, s, i, "k", 1) for i, t, s in rows], "doc_id long, text string, source string, _row long, key string, group_size int")
    kept = exact_dedup.dedup(clash)
    assert kept.columns == clash.columns
    _, groups, low = expected(rows)
    assert sorted(((plain(r.text), r.doc_id) for r in kept.collect()), key=str) == sorted(low.items(), key=str)


def test_empty_table(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.groups(nothing).collect() == [] and exact_dedup.dedup(nothing).collect() == []
