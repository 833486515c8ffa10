"""Token counts under a unigram model, by dynamic programming over a trie of the distinct words.

A word is a run of other characters than space and \\x09-\\x0D, with one space
before it.  Its best segmentation has the highest sum of piece scores, and of
equal sums the fewest pieces.  The forward scores of a word's beginning do not
depend on what follows, so words that share a beginning share them: the sorted
distinct words are the depth-first walk of their trie, and each step keeps the
scores up to where the next word leaves the last one.  The counts at the ends of
words are kept for the task; texts then only add up.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.llm.common import PIECE_CHARS, small_batches
from statweave.llm.tokens import NAME, default_folder

# Words whose counts a task keeps; emptied when full.
CACHE_WORDS = 600_000


def zipf_scores(folder: str | None = None, name: str = NAME) -> dict[bytes, float]:
    """Pieces and scores from a public vocabulary: it has ranks, which Zipf's law turns into log probabilities."""
    with open(f"{folder or default_folder()}/{name}.tiktoken", "rb") as lines:
        return {base64.b64decode(a): -math.log(int(b) + 2.0) for a, b in map(bytes.split, lines)}


class Segmenter:
    """Piece counts of words.  ``scores`` must hold all single bytes that occur; others count as one piece each at the lowest score."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.tails = {p[i:] for p in scores for i in range(len(p))}
        self.lowest = min(scores.values(), default=0.0) - 1.0
        self.counts: dict[bytes, int] = {}

    def learn(self, words: Iterable[bytes]) -> None:
        """Add the counts of new words: one walk of their trie."""
        scores, tails = self.scores, self.tails
        last = b""
        # Forward score and pieces of each beginning of the last word.
        best, pieces = [0.0], [0]
        for word in sorted(words):
            text = b" " + word
            same = 0
            for a, b in zip(text, last, strict=False):
                if a != b:
                    break
                same += 1
            del best[same + 1 :], pieces[same + 1 :]
            for end in range(same + 1, len(text) + 1):
                top, few = best[end - 1] + self.lowest, pieces[end - 1] + 1
                for start in range(end - 1, -1, -1):
                    piece = text[start:end]
                    if piece not in tails:
                        break
                    if piece in scores:
                        value = best[start] + scores[piece]
                        if value > top or value == top and pieces[start] + 1 < few:
                            top, few = value, pieces[start] + 1
                best.append(top)
                pieces.append(few)
            last = text
            self.counts[word] = pieces[-1]

    def count(self, texts: list[list[bytes]]) -> list[int]:
        """Pieces of each list of words."""
        if len(self.counts) > CACHE_WORDS:
            self.counts.clear()
        self.learn({w for words in texts for w in words if w not in self.counts})
        get = self.counts.__getitem__
        return [sum(map(get, words)) for words in texts]


def token_counts(documents: DataFrame, folder: str | None = None, name: str = NAME) -> DataFrame:
    """doc_id, n_words, n_tokens for every row; a null text has none; repeated rows are rows like any other."""
    small_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        segmenter = Segmenter(zipf_scores(folder, name))
        for batch in batches:
            words, counts, held, size = [], [], [], 0
            for text in batch.column("text"):
                held.append((text.as_py() or "").encode("utf-8", "surrogatepass").split())
                size += sum(map(len, held[-1]))
                if size > PIECE_CHARS:
                    words += map(len, held)
                    counts += segmenter.count(held)
                    held, size = [], 0
            words += map(len, held)
            counts += segmenter.count(held)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
