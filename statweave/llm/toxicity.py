"""Toxicity: Levenshtein automata over a lexicon trie, with the context of each hit.

The lexicon is learned from labelled rows: words, and stems that many endings
follow, that occur in toxic rows far above their rate.  A trie of the entries is
walked with at most one edit, in a word, in a stem, or in a learned form that a
stem covers; the walk is determinised as it meets characters, so a word costs
one table look-up per character.  Hits inside quotation marks
or beside words of reporting count apart from the rest, and a logistic model
over the counts gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statweave.llm.common import pieces, small_batches

# The classifier is fitted on at most this many labelled rows, the first in the order of a hash of the id.
SAMPLE_ROWS = 20_000
MIN_ROWS = 4
MIN_DEVIATION = 5.0
STEMS = range(4, 9)
# Shorter entries match exactly only; one edit would turn them into common words.
EDIT_LENGTH = 5
WINDOW = 8
# A text of this score or more counts as toxic.
THRESHOLD = 0.3
CACHE_WORDS = 400_000
WORD = re.compile(r"\w+")
QUOTED = re.compile(r"[\"“”„«][^\"“”„«»\n]{1,400}[\"”“»]")
# Words that report speech rather than speak.
REPORTING = {
    "said", "says", "called", "quoted", "quote", "wrote", "word", "term", "sagte", "nannte", "wort", "dit", "mot",
    "appelé", "dijo", "palabra", "llamó",
}
FEATURES = ["words", "stems", "edited", "quoted", "dense"]


class Automaton:
    """Entries within one edit of a word, by a lazily determinised walk of their trie.

    A state is a set of (trie node, edits so far).  A stem that was reached
    without an edit accepts whatever follows (STEM), and so does a stem of
    EDIT_LENGTH or more with an edit before its last letter (NEAR); an edit of
    the last letter would make it a shorter stem.  ``forms``, words that a stem
    covers, count with an edit only: without one, their stem is found.
    """

    DEAD = 0
    STEM = (-1, 0)
    NEAR = (-2, 0)

    def __init__(self, words: Sequence[str], stems: Sequence[str], forms: Sequence[str] = ()):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[bool] = [False]
        self.stem: list[bool] = [False]
        self.reach: list[bool] = [False]  # an entry long enough for an edit lies below
        self.long: set[int] = set()  # the ends of those entries
        for entries, marks in ((words, self.word), (stems, self.stem), (forms, None)):
            for entry in entries:
                node, path = 0, [0]
                for ch in entry:
                    if ch not in self.children[node]:
                        self.children[node][ch] = len(self.children)
                        self.children.append({})
                        for column in (self.word, self.stem, self.reach):
                            column.append(False)
                    node = self.children[node][ch]
                    path.append(node)
                if marks is not None:
                    marks[node] = True
                if len(entry) >= EDIT_LENGTH:
                    self.long.add(node)
                    for step in path:
                        self.reach[step] = True
        self.ids: dict[frozenset, int] = {frozenset(): self.DEAD}
        self.sets: list[frozenset] = [frozenset()]
        self.steps: list[dict[str, int]] = [{}]
        self.start = self._state(self._close({(0, 0)}))

    def _close(self, states: set) -> frozenset:
        """Add what a skipped character of an entry reaches."""
        out = set(states)
        for node, edits in states:
            if edits == 0:
                out.update((child, 1) for child in self.children[node].values() if self.reach[child])
        return frozenset(out)

    def _state(self, states: frozenset) -> int:
        if states not in self.ids:
            self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.steps.append({})
        return self.ids[states]

    def _step(self, state: int, ch: str) -> int:
        out = set()
        for node, edits in self.sets[state]:
            if node < 0:
                out.add((node, 0))
                continue
            if self.stem[node] and edits == 0:
                out.add(self.STEM)
            if ch in self.children[node]:
                child = self.children[node][ch]
                if edits == 0 or self.reach[child]:
                    out.add((child, edits))
                if edits == 1 and self.stem[child] and child in self.long:
                    out.add(self.NEAR)
            if edits == 0:
                if self.reach[node]:
                    out.add((node, 1))
                out.update((child, 1) for child in self.children[node].values() if self.reach[child])
        to = self._state(self._close({s for s in out if s[0] >= 0}) | {s for s in out if s[0] < 0})
        self.steps[state][ch] = to
        return to

    def kind(self, word: str) -> int:
        """0: none, 1: an entry's word, 2: an entry's stem, 3: a word or a stem with one edit."""
        state = self.start
        for ch in word:
            after = self.steps[state].get(ch)
            state = self._step(state, ch) if after is None else after
            if state == self.DEAD:
                return 0
        found = self.sets[state]
        if any(edits == 0 and node >= 0 and self.word[node] for node, edits in found):
            return 1
        if any((node, edits) == self.STEM or node >= 0 and edits == 0 and self.stem[node] for node, edits in found):
            return 2
        return 3 if any((node, edits) == self.NEAR or edits == 1 and node in self.long for node, edits in found) else 0


class _Kinds(dict):
    """Words already seen by this task; emptied when full."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        kind = self[word] = self.automaton.kind(word)
        return kind


def features(text: str, kinds: dict) -> list[float]:
    """Counts of the hits of one text by kind and context (logarithms), zero without hits."""
    text = text.lower()
    words = WORD.findall(text)
    found = np.fromiter(map(kinds.__getitem__, words), dtype=np.int8, count=len(words))
    at = np.flatnonzero(found)
    if not len(at):
        return [0.0] * len(FEATURES)
    spans = [m.span() for m in QUOTED.finditer(text)]
    starts = [m.start() for m in WORD.finditer(text)]
    ends = np.array([b for _, b in spans])
    counts = [0, 0, 0, 0]
    dense = 0
    for i in at:
        k = int(np.searchsorted(ends, starts[i], side="right")) if spans else 0
        inside = k < len(spans) and spans[k][0] <= starts[i]
        near = words[max(0, i - WINDOW) : i + WINDOW + 1]
        if inside or not REPORTING.isdisjoint(near):
            counts[3] += 1
        else:
            counts[found[i] - 1] += 1
            dense = max(dense, int(np.searchsorted(at, i + WINDOW, side="right") - np.searchsorted(at, i - WINDOW)))
    return [math.log1p(c) for c in counts] + [math.log1p(dense)]


@dataclass
class Model:
    words: list[str]
    stems: list[str]
    weights: list[float]  # the constant first
    rows: int
    forms: list[str] = field(default_factory=list)  # words that a stem covers

    def scorer(self):
        kinds = _Kinds(Automaton(self.words, self.stems, self.forms))
        weights = np.array(self.weights)

        def score(texts: Sequence[str | None]) -> np.ndarray:
            x = np.array([features(t or "", kinds) for t in texts], dtype=float).reshape(-1, len(FEATURES))
            return 1 / (1 + np.exp(-(weights[0] + x @ weights[1:])))

        return score


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with each word (kind 1) and each beginning of a word (kind 2) outside quotation marks, by label, summed within a piece."""
    for part in pieces(batches):
        counts: dict[tuple[str, int], list[int]] = {}
        for text, toxic in zip(part["text"], part["toxic"], strict=True):
            words = set(WORD.findall(QUOTED.sub(" ", (text or "").lower())))
            keys = {(w, 1) for w in words if len(w) > 2} | {(w[:n], 2) for w in words for n in STEMS if len(w) > n}
            for key in keys:
                counts.setdefault(key, [0, 0])[int(toxic)] += 1
        yield pd.DataFrame([(w, k, c[1], c[0]) for (w, k), c in counts.items()], columns=["entry", "kind", "toxic", "clean"])


def lexicon(rows: DataFrame, n_toxic: int, n_clean: int) -> tuple[list[str], list[str], list[str]]:
    """Words, stems, and words that a stem covers, that stand in toxic rows far above the rate of toxic rows, the strongest first."""
    p = n_toxic / max(1, n_toxic + n_clean)
    n = F.col("toxic") + F.col("clean")
    found = (
        rows.mapInPandas(_candidates, "entry string, kind int, toxic long, clean long")
        .groupBy("entry", "kind")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("toxic") >= MIN_ROWS) & (F.col("toxic") > 4 * F.col("clean")))
        .withColumn("z", (F.col("toxic") - n * p) / F.sqrt(n * p * (1 - p) + 1e-9))
        .where(F.col("z") >= MIN_DEVIATION)
        .orderBy(F.desc("z"), F.col("kind"), F.col("entry"))
        .collect()
    )
    stems: dict[str, None] = {}
    most: dict[str, int] = {}  # rows of the commonest word with a beginning
    for r in found:
        if r.kind == 1:
            for n in STEMS:
                most[r.entry[:n]] = max(most.get(r.entry[:n], 0), r.toxic)

    def covered(entry: str) -> bool:
        return any(entry[:n] in stems for n in STEMS)

    for r in found:
        if r.kind == 2 and not covered(r.entry) and r.toxic > 1.5 * most.get(r.entry, 0):
            stems[r.entry] = None  # many endings, none of them most of its rows
    words = [r.entry for r in found if r.kind == 1]
    return [w for w in words if not covered(w)], list(stems), [w for w in words if covered(w)]


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Newton steps for a ridge-penalised logistic model; the constant is not penalised."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.1)
    ridge[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(documents: DataFrame, labels: DataFrame, train=None, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Lexicon and weights from labelled documents (doc_id, text) and labels (doc_id, toxic).

    ``train`` is a condition on doc_id.  At most ``sample_rows`` labelled rows
    serve, the first by a hash of the id; rows without an id or a label are left
    out.  Without any labelled row, or without both labels, the lexicon is empty
    and the score is the share of toxic rows.
    """
    small_batches(documents.sparkSession)
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    chosen = chosen.where(train) if train is not None else chosen
    chosen = (
        chosen.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        rate = (n_toxic + 0.5) / (n_toxic + n_clean + 1.0) if n_toxic + n_clean else 0.05
        return Model([], [], [math.log(rate / (1 - rate))] + [0.0] * len(FEATURES), n_toxic + n_clean)
    words, stems, forms = lexicon(rows, n_toxic, n_clean)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = _Kinds(Automaton(words, stems, forms))
        for part in pieces(batches):
            x = [features(t or "", kinds) for t in part["text"]]
            out = pd.DataFrame(x, columns=FEATURES).assign(toxic=part["toxic"].to_numpy(), n=1)
            yield out.groupby([*FEATURES, "toxic"], as_index=False)["n"].sum()

    names = ", ".join(f"{f} double" for f in FEATURES)
    got = rows.mapInPandas(measure, f"{names}, toxic int, n long").groupBy(*FEATURES, "toxic").agg(F.sum("n").alias("n")).toPandas()
    got = got.sort_values([*FEATURES, "toxic"])
    repeat = got.index.repeat(got["n"])
    x = got.loc[repeat, FEATURES].to_numpy(dtype=float)
    return Model(words, stems, _logistic(x, got.loc[repeat, "toxic"].to_numpy(dtype=float)), n_toxic + n_clean, forms)


def score_column(model: Model, text: Column) -> Column:
    """The score of a text, from 0 to 1; a null text counts as empty."""

    @F.pandas_udf("double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for texts in batches:
            yield pd.Series(scorer(texts.tolist()))

    return apply(text.cast("string"))


def score(documents: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """Every row with its score; no row is dropped, a column of the same name is replaced."""
    return documents.withColumn(column, score_column(model, F.col("text")))
