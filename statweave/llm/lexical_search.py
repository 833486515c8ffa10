"""Ranked lexical search: the ten best documents for each item, exact, by ball trees.

Documents are vectors over the terms of the items, with the whole-number impact of
a term in the document as component; a score is the inner product with the weights
of an item's terms.  One pass over the texts counts those terms, which also gives
the totals of the corpus; a second pass builds ball trees over runs of documents
and searches each for every item, best-first.  A task keeps the best documents of
an item from tree to tree, so that later trees are pruned by what earlier ones
found, and hands on ten rows an item; the last step ranks those.

Items are held in blocks of bounded size; each block is a pass over the documents.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statweave.llm.ball_tree import BallTree
from statweave.llm.common import text_of, written

TOP = 10
# Bytes of the items' terms that a pass holds in every task.
BLOCK_BYTES = 16_000_000
# A tree covers so many documents, or fewer with so many terms between them.
TREE_ROWS = 4096
TREE_TERMS = 1_000_000
# Bytes that are part of a term: digits, letters, and all beyond ASCII; capitals become small letters.
_TABLE = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and all other characters beyond ASCII, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The distinct items with their distinct terms, in blocks of bounded size; items without terms are left out."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sets = [sorted(set(terms_of(t.as_py()))) for t in batch.column("text")]
            size = [sum(map(len, s)) + 50 * len(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(sets, pa.list_(pa.binary())), pa.array(size, pa.int64())], ["item_id", "terms", "size"])

    items = benchmark.select("item_id", text_of().alias("text")).distinct().mapInArrow(run, f"item_id {kind}, terms array<binary>, size long")
    items = written(items.where(F.size("terms") > 0).withColumn("_part", F.xxhash64("terms")))
    total = items.agg(F.sum("size")).first()[0] or 0
    parts = -(-2 * total // BLOCK_BYTES) if total > BLOCK_BYTES else 1
    for part in range(parts if total else 0):
        own = items.where(F.pmod("_part", F.lit(parts)) == part)
        yield [(r.item_id, [bytes(t) for t in r.terms]) for r in own.orderBy("item_id", "_part").collect()]


def _counted(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of the documents with at least one term: how many terms, and those of the vocabulary."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for batch in batches:
            ns, terms, counts = [], [], []
            for text in batch.column("text"):
                words = terms_of(text.as_py())
                count = Counter(words)
                found = sorted((vocabulary[t], count[t]) for t in count.keys() & known)
                ns.append(len(words))
                terms.append([t for t, _ in found])
                counts.append([c for _, c in found])
            out = [batch.column("doc_id"), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n", "terms", "counts"])

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, counts array<long>").where("n > 0")


def weight(total: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * holding + 1)))


def impacts(n: np.ndarray, counts: np.ndarray, lengths: np.ndarray, total: int, words: int) -> np.ndarray:
    """The share of a score that a term brings per unit of its weight."""
    if len(n) and 90 * int(n.max()) * total >= 2**63:  # past 64 bits only on the way to the quotient
        m = np.array([10 + 90 * int(x) * total // words for x in n], dtype=np.int64)
    else:
        m = 10 + 90 * n * total // words
    return (1_000_000_000 * counts) // (1000 * counts + 8 * np.repeat(m, lengths))


class Best:
    """The best documents of one item so far: highest score, then smallest id, ids that are null last."""

    def __init__(self, top: int):
        self.top, self.rows, self.least, self.ids = top, [], 1, None

    def offer(self, rows: np.ndarray, scores: np.ndarray) -> None:
        for row, score in zip(rows.tolist(), scores.tolist(), strict=True):
            own = self.ids[row]
            key = (-score, own is None, own if own is not None else 0)
            if len(self.rows) < self.top or key < self.rows[-1]:
                bisect.insort(self.rows, key)
                del self.rows[self.top :]
                if len(self.rows) == self.top:
                    self.least = -self.rows[-1][0]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows for one tree each: ids, n, lengths, terms, counts."""
    held: list[pa.RecordBatch] = []

    def joined():
        table = pa.Table.from_batches(held)
        lists = table.column("terms").combine_chunks()
        flat = lambda name: table.column(name).combine_chunks().flatten().to_numpy()
        return table.column("doc_id").to_pylist(), table.column("n").to_numpy(), lists.value_lengths().to_numpy().astype(np.int64), flat("terms").astype(np.int64), flat("counts")

    rows = values = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows, values = rows + batch.num_rows, values + len(batch.column("terms").flatten())
            if rows >= TREE_ROWS or values >= TREE_TERMS:
                yield joined()
                held, rows, values = [], 0, 0
    if held:
        yield joined()


def _searched(counted: DataFrame, items: list[tuple[object, list[int]]], weights: np.ndarray, total: int, words: int, top: int, item_kind: str) -> DataFrame:
    """(item, item_id, doc_id, score): the best documents of each task for each item."""
    kind = counted.schema["doc_id"].dataType.simpleString()
    queries = [np.array(terms, dtype=np.int64) for _, terms in items]
    scale = np.sqrt(np.maximum(weights, 1).astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, schema = [Best(top) for _ in items], None
        for ids, n, lengths, terms, counts in _runs(batches):
            # A tree knows only the terms that its documents hold.
            local, columns = np.unique(terms, return_inverse=True)
            first = np.concatenate([[0], np.cumsum(lengths)])
            tree = BallTree(first, columns, impacts(n, counts, lengths, total, words), scale[local])
            for query, own in zip(queries, best, strict=True):
                at = np.searchsorted(local, query)
                hit = at < len(local)
                hit[hit] = local[at[hit]] == query[hit]
                own.ids = ids
                tree.search(at[hit], weights[query[hit]], own)
        rows = [(k, items[k][0], None if gone else doc, -score) for k, own in enumerate(best) for score, gone, doc in own.rows]
        schema = pa.schema([("item", pa.int32()), ("item_id", item_type), ("doc_id", doc_type), ("score", pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], schema.field(j).type) for j in range(4)], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    item_type, doc_type = to_arrow_type(_parse_datatype_string(item_kind)), to_arrow_type(counted.schema["doc_id"].dataType)
    return counted.where(F.size("terms") > 0).mapInArrow(run, f"item int, item_id {item_kind}, doc_id {kind}, score long")


def search(documents: DataFrame, benchmark: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents of the highest score above 0, fewer if there are no more.

    Equal scores go by ascending doc_id, null ids last.  A null or empty text has no
    terms: such an item has no rows, such a document is no document of the corpus.
    Every row of the documents is a document of its own, repeated ones too; equal rows
    of the benchmark are one item, different texts of one item_id are searched apart.
    Empty tables give no rows; other columns are ignored.
    """
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    id_kind = documents.schema["doc_id"].dataType.simpleString()
    found = []
    for block in _blocks(benchmark):
        vocabulary = {t: k for k, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        counted = written(_counted(documents, vocabulary))
        total, words = counted.agg(F.count("*"), F.sum("n")).first()
        if not total:
            continue
        # One number for each term of the block.
        holding = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).collect())
        weights = np.array([weight(total, holding.get(k, 0)) for k in range(len(vocabulary))], dtype=np.int64)
        items = [(i, [vocabulary[t] for t in terms]) for i, terms in block]
        rows = _searched(counted, items, weights, total, words, top, item_kind)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        found.append(ranked.select("item_id", "rank", "doc_id", "score"))
    if not found:
        return documents.sparkSession.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {id_kind}, score long")
    return reduce(DataFrame.unionAll, found)
