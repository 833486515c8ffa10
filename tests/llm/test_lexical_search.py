"""Ranked search against scoring every document by the stated formula, and the tree's bounds."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from statweave.llm import lexical_search
from statweave.llm.ball_tree import BallTree

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, top=10):
    texts = [(i, TERM.findall((t or "").translate(CAPITALS))) for i, t in docs]
    texts = [(i, Counter(w), len(w)) for i, w in texts if w]
    n_docs, words = len(texts), sum(n for _, _, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    out = []
    for item, text in set(items):
        terms = set(TERM.findall((text or "").translate(CAPITALS)))
        scores = []
        for i, count, n in texts:
            m = 10 + (90 * n * n_docs) // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * count[t]) // (1000 * count[t] + 8 * m)) for t in terms if t in count)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)] + ["Straße", "文字", "ÉTÉ"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(300)]
    items = [(i, text(rng.randint(1, 25))) for i in range(30)]
    docs += [(1000 + i, docs[3][1]) for i in range(150)]  # ties
    docs += [(2000, f"{text(30)} {items[4][1]} {text(30)}"), (2001, text(30_000)), (2002, "W1,w1;W2\x7fw3_w4")]
    docs += [(3000, None), (3001, ""), (3002, " .,;"), (None, items[5][1]), (None, items[5][1]), (7, docs[7][1]), (7, docs[7][1])]
    items += [(100, None), (101, ""), (102, "?!"), (103, "nowhere to be found"), (4, items[4][1]), (None, "w5 w6"), (104, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("rows, block", [(4096, 16_000_000), (20, 16_000_000), (64, 900)])
def test_agrees_with_scoring_everything(spark, tables, monkeypatch, rows, block):
    docs, items = tables
    monkeypatch.setattr(lexical_search, "TREE_ROWS", rows)
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", block)
    found = lexical_search.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in found], key=str) == brute(docs, items)


def test_empty_tables_clashing_columns_and_other_ids(spark, tables):
    docs, items = tables
    no_docs, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some_docs, some_items = spark.createDataFrame(docs[:20], DOCS), spark.createDataFrame(items[:3], ITEMS)
    for d, i in ((no_docs, some_items), (some_docs, no_items), (no_docs, no_items)):
        assert lexical_search.search(d, i).collect() == []
    clash = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], DOCS + ", n long, terms string, score int")
    clash_items = spark.createDataFrame([(i, t, 1, "x") for i, t in items[:9]], ITEMS + ", size long, item string")
    found = lexical_search.search(clash, clash_items, top=3).collect()
    assert sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in found], key=str) == brute(docs, items[:9], 3)
    named = spark.createDataFrame([(f"d{i}", t) for i, t in docs[:40]], "doc_id string, text string")
    assert {r.doc_id for r in lexical_search.search(named, some_items).collect()} <= {f"d{i}" for i, _ in docs[:40]}


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    centres = [rng.choice(400, 30, replace=False) for _ in range(12)]
    rows = []
    for k in range(1200):
        cols = np.unique(np.concatenate([rng.choice(centres[k % 12], 25), rng.integers(0, 400, 2)]))
        rows.append((cols, rng.integers(400_000, 600_000, len(cols))))
    rows += [rows[0]] * 200
    first = np.concatenate([[0], np.cumsum([len(c) for c, _ in rows])])
    columns, values = np.concatenate([c for c, _ in rows]), np.concatenate([v for _, v in rows])
    weights = rng.integers(0, 20_000, 400)
    tree = BallTree(first, columns, values, np.sqrt(np.maximum(weights, 1)), leaf=16)
    assert sorted(tree.order) == list(range(len(rows)))
    scored = 0
    for k in range(24):
        query = np.sort(rng.choice(centres[k % 12], 12, replace=False))
        dense = np.zeros(400, dtype=np.int64)
        dense[query] = weights[query]
        exact = np.array([int((v * dense[c]).sum()) for c, v in rows])
        for (a, b), bound in zip(tree.spans, tree.bounds(query, weights[query]), strict=True):
            assert exact[tree.order[a:b]].max() <= bound
        best = lexical_search.Best(10)
        best.ids = list(range(len(rows)))
        scored += tree.search(query, weights[query], best)
        assert [(-s, i) for s, _, i in best.rows] == sorted(((int(s), i) for i, s in enumerate(exact) if s > 0), key=lambda r: (-r[0], r[1]))[:10]
    assert scored < 0.5 * 24 * len(rows)


def test_middle_products_past_64_bits():
    n, total, words = np.array([10**7, 5]), 10**11, 10**13
    found = lexical_search.impacts(n, np.array([3, 1]), np.array([1, 1]), total, words)
    assert found.tolist() == [(10**9 * c) // (1000 * c + 8 * (10 + 90 * int(x) * total // words)) for x, c in zip(n, [3, 1], strict=True)]
