"""Language-model scores from log-frequency Bloom filters of n-gram counts.

Counts are quantised on a logarithmic scale.  An n-gram of level q is put into a
filter q times, as (n-gram, 1) to (n-gram, q); a reader probes these in turn, and
the first that is missing tells the level.  One filter holds the words, one all
pairs of words, those that occur once too.  Both grow with the n-grams and are
built by ranges of their blocks.  The filter of pairs is broadcast in parts of a
stated size: a pass over the texts scores the tokens whose pairs lie in its part,
and the passes' scores of a text add up.

A pair's probability mixes its own estimate with the word's (add-one):
p(w|h) = a c(hw)/c(h) + (1 - m) p(w).  The discount a and the mass m depend on the
level of h and come from the counts less one, that is, from leaving each
occurrence out, summed over the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statweave.llm.common import highest, sized, small_batches, written
from statweave.llm.shingles import ODD, mixed, word_hashes

# Counts of at most this many words are broadcast, the most frequent; the rest are joined.
FREQUENT = 1 << 20
# A pass holds at most this many bytes of the filter of pairs, one segment at least; more bytes take more passes.
FILTER_BYTES = 1 << 29
BITS_PER_KEY = 12
PROBES = 6
BLOCK_BITS = 512
SEGMENT_BLOCKS = 1 << 14
LEVELS = 64
MIN_PAIR = 1
FLUSH = 4_000_000
CHUNK_TOKENS = 400_000
# Keys that a task deals to segments at once, and that Arrow hands it in a batch: they are narrow, other than texts.
DEAL = 500_000
NARROW_ROWS = 50_000
# Texts are split, and their distinct words numbered, in pieces of about this many bytes; a longer text is a piece of its own.
PIECE_BYTES = 1 << 22
# Words that a task numbers before it begins anew.
LEXICON_WORDS = 500_000
END = np.uint64(0xE4D)
# The word with the two bits that twelve bits of a hash name.
TWO_BITS = (np.uint64(1) << (np.arange(4096, dtype=np.uint64) & np.uint64(63))) | (np.uint64(1) << (np.arange(4096, dtype=np.uint64) >> np.uint64(6)))
KEY_BYTES = 7


def level(count: np.ndarray, first: int = 1) -> np.ndarray:
    """The level of a count on a scale of square roots of two, from 1 for ``first``."""
    return 1 + np.floor(2 * np.log2(count / first) + 1e-9).astype(np.int64)


def estimates(first: int = 1) -> np.ndarray:
    """The middle of the counts of each level; 0 for level 0."""
    low = np.ceil(first * 2 ** (np.arange(LEVELS) / 2) - 1e-9)
    high = np.ceil(first * 2 ** (np.arange(1, LEVELS + 1) / 2) - 1e-9) - 1
    return np.concatenate([[0.0], (low + np.maximum(low, high)) / 2])


class Filter:
    """Bits in blocks: a key's levels lie in the block that the key names.  ``bits`` may hold a part of the blocks, from ``first`` on."""

    def __init__(self, bits: np.ndarray, blocks: int, first: int = 0):
        self.bits, self.blocks, self.first = bits, blocks, first

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether a key's block lies in this part; true for all keys of an empty filter."""
        if not self.blocks:
            return np.ones(len(keys), dtype=bool)
        at = self.block(keys, self.blocks)
        return (at >= np.uint64(self.first)) & (at < np.uint64(self.first + len(self.bits) * 8 // BLOCK_BITS))

    @staticmethod
    def block(keys: np.ndarray, blocks: int) -> np.ndarray:
        return ((mixed(keys ^ ODD[3]) >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)

    @staticmethod
    def step(keys: np.ndarray, at: int) -> np.ndarray:
        """A new hash of the key for each level."""
        return mixed(keys + np.uint64(at * int(ODD[2]) & (1 << 64) - 1))

    @staticmethod
    def masks(keys: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        """The 64-bit word of the block in which (key, level) lies, and its bits there."""
        x = Filter.step(keys, at)
        probes, mask = x.view(np.int64), np.zeros(len(x), dtype=np.uint64)
        for j in range(0, PROBES, 2):
            mask |= TWO_BITS[(probes >> 6 * j) & 4095]
        return (x >> np.uint64(61)).view(np.int64), mask

    @staticmethod
    def places(keys: np.ndarray, at: int) -> np.ndarray:
        """The bits of (key, level) in the block, one row for each probe."""
        x = Filter.step(keys, at)
        return np.stack([((x >> np.uint64(61)) << np.uint64(6)) + ((x >> np.uint64(6 * j)) & np.uint64(63)) for j in range(PROBES)])

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: probes go on while a key's bits are all set."""
        out = np.zeros(len(keys), dtype=np.int64)
        if not self.blocks:
            return out
        bits = self.bits.view("<u8")
        start = (self.block(keys, self.blocks).view(np.int64) - self.first) * (BLOCK_BITS // 64)
        active = np.arange(len(keys))
        for q in range(1, LEVELS + 1):
            word, mask = self.masks(keys, q)
            hit = np.flatnonzero((bits[start + word] & mask) == mask)
            active, keys, start = active[hit], keys[hit], start[hit]
            if not len(active):
                break
            out[active] = q
        return out


def segments(keys: int) -> int:
    """The segments of a filter of so many keys."""
    return math.ceil(math.ceil(keys * BITS_PER_KEY / BLOCK_BITS) / SEGMENT_BLOCKS)


def build(entries: DataFrame, keys: int, first: int = 0, last: int | None = None) -> Filter:
    """The segments from ``first`` to before ``last`` of a filter of the rows (key, q); ``keys`` is the sum of q over all of them.

    Tasks pack their keys by segment, segments are built apart and gathered.
    """
    blocks = math.ceil(keys * BITS_PER_KEY / BLOCK_BITS)
    if not blocks:
        return Filter(np.zeros(0, dtype=np.uint8), 0)
    last = segments(keys) if last is None else last

    def deal(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > DEAL:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    def packed(batches) -> pa.RecordBatch:
        key = np.concatenate([b.column("key").to_numpy(zero_copy_only=False) for b in batches]).view(np.uint64)
        q = np.concatenate([b.column("q").to_numpy(zero_copy_only=False) for b in batches]).astype(np.uint8)
        segment = Filter.block(key, blocks).view(np.int64) // SEGMENT_BLOCKS
        inside = (segment >= first) & (segment < last)
        order = np.flatnonzero(inside)
        order = order[np.argsort(segment[order])]
        key, q, segment = key[order].astype("<u8"), q[order], segment[order]
        edge = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(order) else order
        parts = [(key[a:b].tobytes(), q[a:b].tobytes()) for a, b in pairwise([*edge.tolist(), len(order)])]
        columns = [pa.array(segment[edge].astype(np.int32)), pa.array([k for k, _ in parts], pa.binary()), pa.array([n for _, n in parts], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["segment", "keys", "levels"])

    def fill(group: pa.Table) -> pa.Table:
        segment = group.column("segment")[0].as_py()
        x = np.frombuffer(b"".join(group.column("keys").to_pylist()), dtype="<u8")
        q = np.frombuffer(b"".join(group.column("levels").to_pylist()), dtype=np.uint8)
        bits = np.zeros(SEGMENT_BLOCKS * BLOCK_BITS // 64, dtype="<u8")
        start = (Filter.block(x, blocks).view(np.int64) - segment * SEGMENT_BLOCKS) * (BLOCK_BITS // 64)
        for at in range(1, int(q.max()) + 1):
            some = np.flatnonzero(q >= at)
            x, q, start = x[some], q[some], start[some]
            word, mask = Filter.masks(x, at)
            np.bitwise_or.at(bits, start + word, mask)
        return pa.table({"segment": pa.array([segment], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    conf, name = entries.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, NARROW_ROWS)
    try:
        dealt = entries.select("key", "q").mapInArrow(deal, "segment int, keys binary, levels binary")
        found = dealt.groupBy("segment").applyInArrow(fill, "segment int, bits binary").toLocalIterator()
        size = SEGMENT_BLOCKS * BLOCK_BITS // 8
        out = np.zeros((last - first) * size, dtype=np.uint8)
        for row in found:
            at = (row["segment"] - first) * size
            out[at : at + size] = np.frombuffer(row["bits"], dtype=np.uint8)
    finally:
        conf.set(name, before)
    return Filter(out, blocks, first * SEGMENT_BLOCKS)


class Lexicon:
    """The words that a task has met, numbered by their hashes; 0 is the end of a text.  What is known of a word is looked up once."""

    def __init__(self):
        self._hashes = np.array([END], dtype=np.uint64)
        # The hashes in ascending order, and their numbers.
        self._sorted, self._number = self._hashes[:0], np.zeros(0, dtype=np.int64)
        self._told: dict[str, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self._sorted)

    def numbers(self, text: str | None) -> np.ndarray:
        return self.tokens(pa.array([text], pa.string()))[0]

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the tokens of all texts, one text after the other, and how many each text has."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy(zero_copy_only=False), _bytes(coded.dictionary)
        row = np.repeat(np.arange(len(sizes)), sizes)
        if b"" in words:
            # White space before the first word or behind the last.
            empty = words.index(b"")
            del words[empty]
            some = code != empty
            code, row = code[some] - (code[some] > empty), row[some]
            sizes = np.bincount(row, minlength=len(sizes))
        out = np.zeros(len(code) + len(sizes), dtype=np.int64)
        out[np.arange(len(code)) + row] = self._numbered(word_hashes(words))[code]
        return out, sizes + 1

    def _numbered(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of the hashes; new ones are numbered as they come."""
        order = np.argsort(hashes)
        place = np.searchsorted(self._sorted, hashes[order])
        known = self._sorted[np.minimum(place, len(self) - 1)] == hashes[order] if len(self) else np.zeros(len(order), dtype=bool)
        out = np.zeros(len(hashes), dtype=np.int64)
        out[order[known]] = self._number[place[known]]
        fresh = np.sort(order[~known])
        out[fresh] = np.arange(len(fresh)) + len(self._hashes)
        self._hashes = np.concatenate([self._hashes, hashes[fresh]])
        added = order[~known]
        self._sorted, self._number = np.insert(self._sorted, place[~known], hashes[added]), np.insert(self._number, place[~known], out[added])
        return out

    def hashes(self) -> np.ndarray:
        return self._hashes

    def told(self, name: str, look_up: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """``look_up`` of the hashes of all words, asked of new ones only."""
        hashes, known = self.hashes(), self._told.get(name)
        if known is None:
            self._told[name] = look_up(hashes)
        elif len(known) < len(hashes):
            self._told[name] = np.concatenate([known, look_up(hashes[len(known) :])])
        return self._told[name]


def _bytes(words: pa.Array) -> list[bytes]:
    _, ends, data = words.cast(pa.large_binary()).buffers()
    if not len(words):
        return []
    data = data.to_pybytes() if data else b""
    return [data[a:b] for a, b in pairwise(np.frombuffer(ends, dtype=np.int64)[: len(words) + 1].tolist())]


def _runs(sizes: np.ndarray, most: int):
    """(first, last) of consecutive rows, as many as bring their sizes to more than ``most``."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        done = ends[first - 1] if first else 0
        last = min(int(np.searchsorted(ends, done + most, side="right")) + 1, len(sizes))
        yield first, last
        first = last


def _pieces(batches):
    """Consecutive rows with about PIECE_BYTES of text together: several batches, or part of one."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        for first, last in _runs(lengths, PIECE_BYTES):
            held.append(batch.slice(first, last - first))
            size += int(lengths[first:last].sum())
            if size > PIECE_BYTES:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _chunks(batches):
    """Rows in chunks of bounded tokens: the rows, their tokens, how many each row has, and the lexicon that numbers them."""
    lexicon = Lexicon()
    for piece in _pieces(batches):
        tokens, sizes = lexicon.tokens(piece.column("text"))
        at = np.concatenate([[0], np.cumsum(sizes)])
        for first, last in _runs(sizes, CHUNK_TOKENS):
            yield piece.slice(first, last - first), tokens[at[first] : at[last]], sizes[first:last], lexicon
        if len(lexicon) > LEXICON_WORDS:
            lexicon = Lexicon()


def word_counts(texts: DataFrame) -> DataFrame:
    """(key, c): how often each token occurs; tasks add up their own first."""

    def run(batches):
        last, totals = None, np.zeros(0, dtype=np.int64)
        for _, tokens, _, lexicon in _chunks(batches):
            if last is not None and lexicon is not last:
                yield _counted(last, totals)
                totals = totals[:0]
            last, n = lexicon, np.bincount(tokens, minlength=len(totals))
            n[: len(totals)] += totals
            totals = n
        if last is not None:
            yield _counted(last, totals)

    def _counted(lexicon, totals):
        some = np.flatnonzero(totals)
        return pa.RecordBatch.from_arrays([pa.array(lexicon.hashes()[some].view(np.int64)), pa.array(totals[some])], ["key", "c"])

    return texts.mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _before(tokens: np.ndarray) -> np.ndarray:
    """The number of the word before each token; a text begins after an end."""
    out = np.empty_like(tokens)
    out[0], out[1:] = 0, tokens[:-1]
    return out


def _pair_keys(history: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """56 bits for a pair, the lowest six of them the level of its history."""
    x = mixed(history * ODD[0] + mixed(word * ODD[1]))
    return ((x >> np.uint64(8)) & ~np.uint64(63)) | np.minimum(at, 63).astype(np.uint64)


def pair_counts(texts: DataFrame, words, total: int) -> DataFrame:
    """(key, c) of the pairs that occur MIN_PAIR times or more.

    Tasks send their sorted keys in blocks by range, seven bytes a key, with a
    count only where a key repeats; each block is added up at once.
    """
    blocks = max(1, total // FLUSH + 1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = (np.arange(1, blocks, dtype=object) * (1 << 56) // blocks).astype(np.uint64)

    def packed(keys):
        return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()

    def send(batches):
        held, size = [], 0

        def flush():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            at = np.concatenate([[0], np.searchsorted(key, edges), [len(key)]])
            rows = []
            for b in range(blocks):
                k, c = key[at[b] : at[b + 1]], n[at[b] : at[b + 1]]
                if len(k):
                    rows.append((b, packed(k[c == 1]), packed(k[c > 1]), c[c > 1].astype("<u4").tobytes()))
            names = ["block", "once", "more", "counts"]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int32(), pa.binary(), pa.binary(), pa.binary()], strict=True)], names)

        for _, tokens, _, lexicon in _chunks(batches):
            hashes, levels = lexicon.hashes(), lexicon.told("level", words.value.levels)
            before = _before(tokens)
            held.append(_pair_keys(hashes[before], hashes[tokens], levels[before]))
            size += len(before)
            if size > FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def unpacked(parts) -> np.ndarray:
        raw = np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(-1, KEY_BYTES)
        wide = np.zeros((len(raw), 8), dtype=np.uint8)
        wide[:, :KEY_BYTES] = raw
        return wide.view("<u8").ravel()

    def count(group: pa.Table) -> pa.Table:
        once, more = (unpacked(group.column(c).to_pylist()) for c in ("once", "more"))
        counts = np.concatenate([np.ones(len(once), dtype=np.int64), np.frombuffer(b"".join(group.column("counts").to_pylist()), dtype="<u4").astype(np.int64)])
        keys = np.concatenate([once, more])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
        sums = np.add.reduceat(counts, start) if len(start) else counts
        keep = sums >= MIN_PAIR
        return pa.table({"key": pa.array(keys[start][keep].view(np.int64)), "c": pa.array(sums[keep])})

    sent = texts.mapInArrow(send, "block int, once binary, more binary, counts binary")
    return sent.groupBy("block").applyInArrow(count, "key long, c long")


def _levels(counts: DataFrame, first: int) -> DataFrame:
    return counts.select("key", (1 + F.floor(2 * F.log2(F.col("c") / first) + 1e-9)).cast("int").alias("q"), "c")


def score(documents: DataFrame, train: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row, learned from the rows where ``train`` holds.

    A token is a word (A-Z in lower case) or the end of a text; a null text has
    only its end.  ``base_score`` is the exact add-one word model, ``score`` the
    pair model, both as log10 probabilities of the whole text.  Repeated rows are
    rows like any other, in training too.  Without training rows every token is
    unseen and each counts 1/1.
    """
    spark = documents.sparkSession
    small_batches(spark)
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("_train"))
    texts = rows.where("_train").select("text")
    counts = written(word_counts(texts))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    graded = _levels(counts, 1)
    by_level = {r.q: (r.c, r.n) for r in graded.groupBy("q").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}
    words = build(graded, sum(q * k for q, (_, k) in by_level.items()))
    held_words = spark.sparkContext.broadcast(words)
    pairs = written(pair_counts(texts, held_words, n))

    graded_pairs = _levels(pairs, MIN_PAIR)
    at = F.col("key").bitwiseAND(F.lit(63)).alias("at")
    sums = graded_pairs.groupBy(at).agg(F.sum("c").alias("c"), F.sum(F.col("c") - 1).alias("less"), F.sum("q").alias("q")).collect()
    pair_levels = sum(r.q for r in sums)
    told = {r.at: (r.c, r.less) for r in sums}
    discount, mass = np.zeros(64), np.zeros(64)
    for q, (c, less) in told.items():
        if q in by_level and c:
            discount[q], mass[q] = less / c, min(0.95, less / by_level[q][0])

    # The levels of the most frequent words, as many as the list may hold.
    from_ = highest({q: k for q, (_, k) in by_level.items()}, FREQUENT)
    frequent = graded.where(F.col("q") >= from_).select("key", "c").toArrow()
    keys_ = frequent.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys_)
    top = keys_[order], frequent.column("c").to_numpy().astype(np.float64)[order]
    step = max(1, FILTER_BYTES * 8 // (SEGMENT_BLOCKS * BLOCK_BITS))
    parts = [(i, min(i + step, segments(pair_levels))) for i in range(0, segments(pair_levels), step)] or [(0, 0)]
    whole = math.log10(n + v + 1)
    expected, expected_pairs = estimates(), estimates(MIN_PAIR)
    smooth = sum(float(expected[min(q, LEVELS)]) * k for q, (_, k) in by_level.items()) + v + 1

    def likely(words_, pairs_, word, lexicon, starts):
        """The log10 probabilities of the tokens whose pairs lie in this part, summed by text."""
        hashes, levels = lexicon.hashes(), np.minimum(lexicon.told("level", words_.levels), LEVELS)
        before = _before(word)
        key = _pair_keys(hashes[before], hashes[word], np.minimum(levels[before], 63))
        mine = pairs_.holds(key) if len(parts) > 1 else slice(None)
        history, lone = np.minimum(levels[before[mine]], 63), (expected[levels[word[mine]]] + 1) / smooth
        both = np.minimum(pairs_.levels(key[mine]), LEVELS)
        ratio = np.minimum(expected_pairs[both] / np.maximum(expected[history], 1.0), 1.0)
        p = discount[history] * ratio + (1 - mass[history]) * lone
        each = np.zeros(len(word))
        each[mine] = np.log10(np.minimum(p, 1.0))
        return np.add.reduceat(each, starts)

    def run(batches):
        words_, pairs_, keys, c = held_words.value, model.value, *held_top.value

        def frequent_count(hashes):
            place = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
            return np.where(keys[place] == hashes, c[place], 0.0) if len(keys) else np.zeros(len(hashes))

        for chosen, word, sizes, lexicon in _chunks(batches):
            of = np.repeat(np.arange(len(sizes)), sizes)
            starts = np.cumsum(sizes) - sizes
            scores = likely(words_, pairs_, word, lexicon, starts)
            count = lexicon.told("count", frequent_count)[word]
            known = count > 0
            part = np.add.reduceat(np.log10(count + 1), starts)
            n_known = np.add.reduceat(known.astype(np.int64), starts)
            rest, rest_of = lexicon.hashes()[word[~known]], of[~known]
            pair = np.lexsort((rest, rest_of))
            rest, rest_of = rest[pair], rest_of[pair]
            edge = np.flatnonzero(np.concatenate([[True], (rest[1:] != rest[:-1]) | (rest_of[1:] != rest_of[:-1])])) if len(rest) else np.empty(0, dtype=np.int64)
            often = np.diff(np.concatenate([edge, [len(rest)]])) if len(edge) else np.empty(0, dtype=np.int64)
            row, doc_id, train_ = (chosen.column(c) for c in NAMES[:3])
            m, e = len(sizes), len(edge)
            ids = row.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [row, doc_id, train_, pa.array(sizes), pa.array(n_known), pa.array(part), pa.array(scores), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], NAMES
            )
            if e:
                none = [pa.nulls(e, t) for t in (doc_id.type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(ids[rest_of[edge]]), *none, pa.array(rest[edge].view(np.int64)), pa.array(often)], NAMES)

    def again(batches):
        for chosen, word, sizes, lexicon in _chunks(batches):
            scores = likely(held_words.value, model.value, word, lexicon, np.cumsum(sizes) - sizes)
            yield pa.RecordBatch.from_arrays([chosen.column("_row"), pa.array(scores)], ["_row", "_more"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    # Several passes read the same rows under the same numbers.
    numbered = written(numbered) if len(parts) > 1 else numbered
    held_top = spark.sparkContext.broadcast(top)
    model = spark.sparkContext.broadcast(build(graded_pairs, pair_levels, *parts[0]))
    out = written(numbered.mapInArrow(run, f"_row long, doc_id {kind}, _train boolean, n_tokens long, n_known long, part double, score double, key long, times long"))
    rare = out.where("key is not null").select("_row", "key", "times").join(counts, "key")
    added = rare.groupBy("_row").agg(F.sum("times").alias("_times"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("_part"))
    found = out.where("key is null").drop("key", "times").join(sized(written(added)), "_row", "left")
    more = []
    for part in parts[1:]:
        model.unpersist()
        model = spark.sparkContext.broadcast(build(graded_pairs, pair_levels, *part))
        more.append(written(numbered.select("_row", "text").mapInArrow(again, "_row long, _more double")))
    if more:
        sums = reduce(DataFrame.unionByName, more).groupBy("_row").agg(F.sum("_more").alias("_more"))
        found = found.join(sums, "_row").withColumn("score", F.col("score") + F.col("_more"))
    base = F.col("part") + F.coalesce("_part", F.lit(0.0)) - F.col("n_tokens") * F.lit(whole)
    return found.select(
        "doc_id",
        "_train",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_times", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )


NAMES = ["_row", "doc_id", "_train", "n_tokens", "n_known", "part", "score", "key", "times"]
