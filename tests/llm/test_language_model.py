"""Scores against the same model over exact pair counts in dictionaries."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statweave.llm import language_model as lm
from statweave.llm.shingles import words_of


def brute(rows, train):
    """The mixture with exact counts of words and pairs on the level scale: what the filters say but for false positives."""
    words, pairs = Counter(), Counter()
    for i, text in rows:
        if train(i):
            own = words_of(text) + [None]
            words.update(own)
            pairs.update(zip([None, *own[:-1]], own, strict=True))
    n, v = sum(words.values()), len(words)
    level = lambda c: 1 + math.floor(2 * math.log2(c) + 1e-9) if c else 0
    middle = lm.estimates()
    at_level, less, of = Counter(), Counter(), Counter()
    for c in words.values():
        at_level[level(c)] += c
    for (h, _), c in pairs.items():
        of[level(words[h])] += c
        less[level(words[h])] += c - 1
    smooth = sum(middle[level(c)] for c in words.values()) + v + 1
    out = defaultdict(list)
    for i, text in rows:
        own, total = words_of(text) + [None], 0.0
        for h, w in zip([None, *own[:-1]], own, strict=True):
            q = level(words[h])
            discount = less[q] / of[q] if of[q] else 0.0
            mass = min(0.95, less[q] / at_level[q]) if at_level[q] else 0.0
            ratio = min(middle[level(pairs[h, w])] / max(middle[q], 1.0), 1.0)
            total += math.log10(min(1.0, discount * ratio + (1 - mass) * (middle[level(words[w])] + 1) / smooth))
        out[i].append(total)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    out = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 120)))) for i in range(250)]
    return out + [(300, None), (301, ""), (302, "W1 w1\tw2"), (303, "w1 " * 5000), (304, "never seen before"), (5, out[5][1])]


@pytest.mark.parametrize("words, chunk", [(500_000, 400_000), (20, 300)])
def test_scores_agree_with_exact_pair_counts(spark, rows, words, chunk, monkeypatch):
    monkeypatch.setattr(lm, "LEXICON_WORDS", words)
    monkeypatch.setattr(lm, "CHUNK_TOKENS", chunk)
    train = lambda i: i % 7 != 2
    wanted = brute(rows, train)
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for r in lm.score(documents, F.col("doc_id") % 7 != 2).collect():
        # False positives of the filters raise a few levels; without them the scores would be equal.
        assert any(math.isclose(r.score, x, rel_tol=0.03) for x in wanted[r.doc_id])


def test_filters_without_false_positives_give_the_same_scores(spark, rows, monkeypatch):
    monkeypatch.setattr(lm, "BITS_PER_KEY", 4096)
    wanted = brute(rows, lambda i: i % 7 != 2)
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    for r in lm.score(documents, F.col("doc_id") % 7 != 2).collect():
        assert any(math.isclose(r.score, x, rel_tol=1e-3) for x in wanted[r.doc_id])


def test_a_lexicon_looks_each_word_up_once():
    asked = []
    lexicon = lm.Lexicon()
    numbers = lexicon.numbers("a b a")
    assert numbers.tolist() == [1, 2, 1, 0]

    def look_up(hashes):
        asked.append(len(hashes))
        return hashes

    first = lexicon.told("x", look_up)
    lexicon.numbers("b c")
    assert (lexicon.told("x", look_up)[: len(first)] == first).all()
    assert asked == [3, 1] and len(lexicon.hashes()) == 4 and lexicon.hashes()[0] == np.uint64(lm.END)


def test_distinct_words_of_a_piece_are_hashed_once_and_tokens_stay(monkeypatch):
    asked, plain = [], lm.word_hashes
    monkeypatch.setattr(lm, "word_hashes", lambda words: asked.extend(words) or plain(words))
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 50)
    texts = ["  A b ", None, "", "x\x0b\x0cY\x1cz\x85 \t", "É é\r\nÉ", "\n", "a " * 200, "b a b"]
    batches = [pa.record_batch([pa.array(texts[i : i + 3], pa.string())], ["text"]) for i in (0, 3, 6)]
    rows, hashes = [], []
    for chunk, tokens, sizes, lexicon in lm._chunks(batches):
        rows.extend(chunk.column("text").to_pylist())
        assert len(sizes) == chunk.num_rows and sizes.sum() == len(tokens)
        hashes.extend(x.tolist() for x in np.split(lexicon.hashes()[tokens], np.cumsum(sizes)[:-1]))
    assert rows == texts
    assert hashes == [[*plain(words_of(t)).tolist(), int(lm.END)] for t in texts]
    assert sorted(asked) == sorted({w for t in texts for w in words_of(t)})


def test_keys_travel_packed_and_segments_hold_the_same_bits(spark, monkeypatch):
    monkeypatch.setattr(lm, "SEGMENT_BLOCKS", 64)
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 56, 20_000))
    q = rng.geometric(0.6, len(keys)).astype(np.int32)
    entries = spark.createDataFrame(pa.table({"key": keys, "q": q}).to_pandas(), "key long, q int").repartition(3)
    blocks = math.ceil(int(q.sum()) * lm.BITS_PER_KEY / lm.BLOCK_BITS)
    bits = np.zeros(lm.segments(int(q.sum())) * 64 * lm.BLOCK_BITS, dtype=bool)
    x = keys.astype(np.uint64)
    for at in range(1, int(q.max()) + 1):
        for place in lm.Filter.places(x[q >= at], at):
            bits[(lm.Filter.block(x[q >= at], blocks) * np.uint64(lm.BLOCK_BITS) + place).astype(np.int64)] = True
    wanted = np.packbits(bits, bitorder="little")
    size, rows = 64 * lm.BLOCK_BITS // 8, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sent, of = [], type(entries).mapInArrow
    monkeypatch.setattr(type(entries), "mapInArrow", lambda self, *a, **b: sent.append(of(self, *a, **b)) or sent[-1])
    assert (lm.build(entries, int(q.sum())).bits == wanted).all()
    assert (lm.build(entries, int(q.sum()), 2, 5).bits == wanted[2 * size : 5 * size]).all()
    # A row for each segment and task, not for each key.
    assert sent[0].count() <= 3 * lm.segments(int(q.sum())) < len(keys) / 100
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == rows
