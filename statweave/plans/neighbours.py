"""Pairs of nearly equal words, counted from the forms they share and never listed.

Two words of one length differ in at most two letters exactly when they agree after
some two letters are masked; words whose lengths differ by one are near when the
longer one, without its last letter, differs from the other in at most one, or is the
other behind one more letter.  Words with the same masked form meet under its key, so
no two words are ever compared.

Masks are refined from coarse to fine: a word is cut into parts and every pair of parts
is masked.  A key is a sum of hashes of (place, letter), so a finer mask's key is the
coarser one's plus the letters shown again, and a row needs only the letters that are
still masked.  Rows are sorted by key; a task reads group after group, drops words that
share their form with no other, and refines the rest itself down to single letters.
Only a group with too many letters for a task goes back, under finer masks, for a
round of its own.  So a word of any length is shuffled once for each coarse mask.

Pairs follow from the sizes of the groups.  Under masks of two letters a pair that
differs in both counts once, one that differs in a single letter counts once for each
other letter; masks of one letter tell the latter apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statweave.plans.tables import attach, cut

# Parts into which a word is cut at first, and a masked range at each further step.
FIRST_PARTS = 6
PARTS = 3
# A task refines about so many bytes of masked letters at once.
CHUNK_BYTES = 1 << 21
# A group with more goes into another round.
GROUP_BYTES = 1 << 24

_RANGE = ["a1", "b1", "a2", "b2"]
_SAME = ["variable", "length", *_RANGE, "own"]
_INTS = [*_SAME, "role"]
_LONGS = ["id", "weight", "key"]
_ROWS = ", ".join([*(f"{c} int" for c in _INTS), *(f"{c} long" for c in _LONGS), "letters binary"])
_FOUND = _ROWS + ", kind int, one long, two long, apart long, other long"
# Kinds of rows found: words of a group that needs another round, sums, pairs.
_AGAIN, _SUMS, _PAIR = range(3)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(place: np.ndarray, letter: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(((place.astype(np.uint64) + np.uint64(1)) << np.uint64(32)) + letter.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))


def _cuts(a: int, b: int, parts: int) -> list[tuple[int, int]]:
    """The range [a, b) in at most so many parts."""
    n = b - a
    k = min(parts, n)
    return [(a + i * n // k, a + (i + 1) * n // k) for i in range(k)]


def _finer(a1: int, b1: int, a2: int, b2: int, own: int, parts: int) -> list[tuple[int, int, int, int, int]]:
    """Finer masks that cover the same letters.

    A mask stands for all pairs of a letter of its first range and one of its second;
    ``own`` adds the pairs inside the first range and its single letters (1), or
    those of the second (2).  Every pair and single letter stays in one mask.
    """
    left, right = _cuts(a1, b1, parts), _cuts(a2, b2, parts)
    masks = {(x, y): 0 for x in left for y in right}
    for flag, some, mate in ((1, left, right[:1]), (2, right, left[:1])):
        if not own & flag:
            continue
        masks |= {(x, y): 0 for i, x in enumerate(some) for y in some[i + 1 :]}
        for i, x in enumerate(some):
            if mate:
                masks[(x, mate[0]) if flag == 1 else (mate[0], x)] |= flag
            elif i + 1 < len(some):
                masks[x, some[i + 1]] |= 1
            elif i:
                masks[some[i - 1], x] |= 2
            else:
                masks[x, (x[1], x[1])] = 1
    return [(*x, *y, o) for (x, y), o in masks.items()]


def _repeated(key: np.ndarray) -> np.ndarray:
    """Places of the keys that occur more than once, in their order."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    return np.sort(order[np.append(same, False) | np.insert(same, 0, False)])


def _batch(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    n = len(rows["key"])
    letters = rows["letters"]
    # One byte a letter where that is enough; the reader tells by the size.
    data = letters.astype(np.uint8 if not letters.size or letters.max() < 256 else np.uint32)
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(data.shape[1] * data.itemsize)
    packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    columns = {**rows, "letters": packed}
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


_ROWS_SCHEMA = pa.schema([*((c, pa.int32()) for c in _INTS), *((c, pa.int64()) for c in _LONGS), ("letters", pa.binary())])
_FOUND_SCHEMA = pa.schema([*_ROWS_SCHEMA, ("kind", pa.int32()), *((c, pa.int64()) for c in ("one", "two", "apart", "other"))])


class _Words:
    """Words of one variable, length and mask: their masked letters' hashes and keys under finer masks."""

    def __init__(self, place: np.ndarray, letters: np.ndarray, key: np.ndarray):
        self.place, self.letters = place, letters
        hashes = _hashed(place[None, :], letters)
        self.upto = np.concatenate([np.zeros((len(letters), 1), np.uint64), np.cumsum(hashes, axis=1, dtype=np.uint64)], axis=1)
        self.whole = key.view(np.uint64) + self.upto[:, -1]

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Columns of the letters at [a, b)."""
        return int(np.searchsorted(self.place, a)), int(np.searchsorted(self.place, b))

    def key(self, keep: np.ndarray, *ranges: tuple[int, int]) -> np.ndarray:
        out = self.whole[keep]
        for a, b in ranges:
            i, j = self.span(a, b)
            out = out - (self.upto[keep, j] - self.upto[keep, i])
        return out

    def under(self, *ranges: tuple[int, int]) -> np.ndarray:
        return np.concatenate([self.letters[:, slice(*self.span(*r))] for r in ranges], axis=1)


def _under(fields: dict, words: _Words, mask: tuple, parts: int) -> Iterator[dict]:
    """Words of one variable, length and mask under all its finer masks."""
    every = np.arange(len(words.whole))
    for finer in _finer(*mask, parts):
        ranges = finer[:2], finer[2:4]
        rows = {c: np.full(len(every), v, np.int32) for c, v in zip([*_RANGE, "own"], finer)}
        rows |= {c: fields[c] for c in ("variable", "length", "role", "id", "weight")}
        yield rows | {"key": words.key(every, *ranges).view(np.int64), "letters": words.under(*ranges)}


def _masked(found: list[dict]) -> Iterator[pa.RecordBatch]:
    if found:
        yield from pa.Table.from_batches([_batch(rows, _ROWS_SCHEMA) for rows in found]).combine_chunks().to_batches()


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every word under each pair of its parts."""
    for batch in batches:
        fields = {c: batch.column(c).to_numpy() for c in ("variable", "role", "id", "weight")}
        text = batch.column("word").to_pylist()
        fields["length"] = np.array([len(w) for w in text], np.int32)
        flat = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
        starts = np.cumsum(fields["length"], dtype=np.int64) - fields["length"]
        found = []
        for n in map(int, np.unique(fields["length"])):
            at = np.flatnonzero(fields["length"] == n)
            # Words meet only within a variable and a length.
            key = _mixed((fields["variable"][at].astype(np.uint64) << np.uint64(32)) + np.uint64(n))
            words = _Words(np.arange(n), flat[starts[at][:, None] + np.arange(n)], key)
            found += _under({c: v[at] for c, v in fields.items()}, words, (0, n, n, n, 1), FIRST_PARTS)
        yield from _masked(found)


def _next_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of groups that were too large, under finer masks."""
    for batch in batches:
        yield from _masked([rows for fields, mask, words in _alike(_read(batch)) for rows in _under(fields, words, mask, PARTS)])


def _read(batch: pa.RecordBatch | pa.Table) -> dict:
    return {c: batch.column(c).to_numpy() for c in [*_INTS, *_LONGS]} | {"letters": np.array(batch.column("letters").to_pylist(), dtype=object)}


def _alike(rows: dict) -> Iterator[tuple[dict, tuple, _Words]]:
    """Rows of one variable, length and mask at a time, by id."""
    order = np.lexsort([rows["id"], *(rows[c] for c in _SAME)])
    columns = np.stack([rows[c][order] for c in _SAME])
    edges = np.flatnonzero(np.append(True, (columns[:, 1:] != columns[:, :-1]).any(axis=0))) if len(order) else []
    for i, j in zip(edges, [*edges[1:], len(order)]):
        fields = {c: v[order[i:j]] for c, v in rows.items()}
        a1, b1, a2, b2, own = (int(rows[c][order[i]]) for c in [*_RANGE, "own"])
        count = b1 - a1 + b2 - a2
        wide = [len(x) > count for x in fields["letters"]]
        texts = [x if w else np.frombuffer(x, np.uint8).astype(np.uint32).tobytes() for x, w in zip(fields["letters"], wide)] if any(wide) else fields["letters"]
        letters = np.frombuffer(b"".join(texts), np.uint32 if any(wide) else np.uint8).reshape(j - i, count)
        yield fields, (a1, b1, a2, b2, own), _Words(np.concatenate([np.arange(a1, b1), np.arange(a2, b2)]), letters, fields["key"])


class _Tally:
    """Sums of pairs by variable and length, and the first pairs of each variable."""

    def __init__(self, examples: int):
        self.examples, self.sums, self.first = examples, {}, {}

    def add(self, fields: dict, keep: np.ndarray, key: np.ndarray, double: bool) -> None:
        """Words under a mask of two letters, or of one; ``keep`` is in order of id."""
        order = np.argsort(key, kind="stable")
        edge = np.append(True, key[order][1:] != key[order][:-1])
        start = np.flatnonzero(edge)
        size = np.diff(np.append(start, len(order)))
        if (size < 2).all():
            return
        rows = keep[order]
        weight, role = fields["weight"][rows], fields["role"][rows]
        whole, rest = np.where(role == 0, weight, 0), np.where(role == 1, weight, 0)
        m, q, r = (np.add.reduceat(x, start) for x in (whole, whole * whole, rest))
        sums = self.sums.setdefault((int(fields["variable"][0]), int(fields["length"][0])), [0, 0, 0])
        same = int(((m * m - q) // 2).sum())
        if double:
            sums[1] += same
        else:
            sums[0] += same
            sums[2] += int((m * r).sum())
        self._pairs(int(fields["variable"][0]), fields["id"][rows], role, start, size)

    def _pairs(self, variable: int, ids: np.ndarray, role: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """The first pairs of the groups; of a group only its first members of each role can be in them.

        A pair is in one group of a mask, so the first are in the groups whose own first pairs come earliest.
        """
        k, best = self.examples, self.first.setdefault(variable, set())
        wholes = np.add.reduceat((role == 0).astype(np.int64), start)
        able = np.flatnonzero((size > 1) & (wholes > 0))
        early = ids[start[able]]
        late = np.where(role[start[able]] == 0, ids[start[able] + 1], np.minimum.reduceat(np.where(role == 0, ids, np.iinfo(np.int64).max), start)[able])
        for g in able[np.lexsort([late, early])[:k]]:
            i, j = start[g], start[g] + size[g]
            whole, rest = (ids[i:j][role[i:j] == x][: k + 1].tolist() for x in (0, 1))
            best |= {(a, b) for n, a in enumerate(whole) for b in whole[n + 1 :]} | {(min(a, b), max(a, b)) for a in whole for b in rest}
        if len(best) > k:
            self.first[variable] = set(sorted(best)[:k])

    def batches(self) -> Iterator[pa.RecordBatch]:
        found = [{"kind": _SUMS, "variable": v, "length": n, "one": s[0], "two": s[1], "apart": s[2]} for (v, n), s in self.sums.items()]
        found += [{"kind": _PAIR, "variable": v, "id": a, "other": b} for v, pairs in self.first.items() for a, b in pairs]
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=_FOUND_SCHEMA)


def _refine(fields: dict, words: _Words, keep: np.ndarray, mask: tuple, tally: _Tally) -> None:
    """Count the words of one variable, length and mask down to masks of single letters."""
    a1, b1, a2, b2, own = mask
    if b1 - a1 <= 1 and b2 - a2 <= 1:
        if b1 > a1 and b2 > a2:
            # Words without their last letter are near others that differ in one letter only.
            whole = keep[fields["role"][keep] == 0]
            if len(whole):
                tally.add(fields, whole, words.key(whole, (a1, b1), (a2, b2)), True)
        for flag, one in ((1, (a1, b1)), (2, (a2, b2))):
            if own & flag:
                tally.add(fields, keep, words.key(keep, one), False)
        return
    for finer in _finer(*mask, PARTS):
        key = words.key(keep, finer[:2], finer[2:4])
        shared = keep if finer[1] - finer[0] <= 1 and finer[3] - finer[2] <= 1 else keep[_repeated(key)]
        if len(shared):
            _refine(fields, words, shared, finer, tally)


def _counter(examples: int):
    """Reads rows sorted by key: the sums and first pairs of its groups, and the words of groups that are too large."""
    most, chunk = GROUP_BYTES, CHUNK_BYTES

    def size(some: list[pa.RecordBatch]) -> int:
        return sum(b.column("letters").nbytes for b in some)

    def single(batch: pa.RecordBatch) -> bool:
        """A mask of two letters cannot be refined; it has as many words as there are pairs of letters, at most."""
        return all(batch.column(b)[0].as_py() - batch.column(a)[0].as_py() <= 1 for a, b in (("a1", "b1"), ("a2", "b2")))

    def again(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        rest = [pa.array(np.full(n, _AGAIN, np.int32)), *(pa.nulls(n, pa.int64()) for _ in range(4))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in _ROWS_SCHEMA.names), *rest], schema=_FOUND_SCHEMA)

    def count(groups: list[pa.RecordBatch], tally: _Tally) -> None:
        if not groups:
            return
        table = pa.Table.from_batches(groups)
        key = table.column("key").to_numpy()
        same = key[1:] == key[:-1]
        shared = np.flatnonzero(np.append(same, False) | np.append(False, same))
        for fields, mask, words in _alike(_read(table.take(pa.array(shared)))):
            _refine(fields, words, np.arange(len(words.whole)), mask, tally)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(examples)
        done, last = [], []  # whole groups, and the one that may go on
        current, over = None, False
        for batch in batches:
            while batch.num_rows:
                key = batch.column("key").to_numpy()
                if key[0] == current:
                    n = int(np.searchsorted(key, current, "right"))
                    last.append(batch.slice(0, n))
                    over = over or size(last) > most and not single(last[0])
                    if over:
                        yield from map(again, last)
                        last = []
                    batch = batch.slice(n)
                else:
                    n = int(np.searchsorted(key, key[-1], "left"))
                    done += [*last, batch.slice(0, n)]
                    if size(done) >= chunk:
                        count(done, tally)
                        done = []
                    last, current, over = [], key[-1], False
                    batch = batch.slice(n)
        count(done + last, tally)
        yield from tally.batches()

    return run


def near_pairs(words: DataFrame, examples: int = 10) -> tuple[DataFrame, DataFrame]:
    """How many near pairs each variable has, and the first of them.

    ``words`` has ``variable``, ``word`` (distinct within it), ``weight`` (for how many
    labels a word stands; a pair counts for the product), ``label`` to show, and
    ``place``, a value that orders words.  Empty words have no pairs.  Returns
    (variable, pairs) and (variable, seq, first, second), the ``examples`` pairs with
    the earliest first and then second word.
    """
    base = words.where("word != ''").orderBy("variable", "place", "word").select("variable", "word", "weight", "label")
    # Ids in the order of places, so that places need not travel with the forms.
    base = cut(base.withColumns({"length": F.length("word"), "id": F.monotonically_increasing_id()}))
    names = sorted(r[0] for r in base.select("variable").distinct().collect())
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("variable")).cast("int") if names else F.lit(0)
    lengths = base.select("variable", (F.col("length") + 1).alias("length")).distinct()
    own = base.select(number.alias("variable"), "word", "weight", "length", "id")
    longer = attach(base.drop("label"), lengths, ["variable", "length"]).select(number.alias("variable"), "word", "weight", "length", "id")
    shorter = longer.select("variable", F.expr("left(word, length - 1)").alias("word"), "weight", "id", F.lit(1).alias("role"))
    whole = own.select("variable", "word", "weight", "id", F.lit(0).alias("role"))
    found = _found(whole.unionByName(shorter), examples)

    # Words of one length that differ in one letter and in two, and those of which one has a last letter more.
    parts = found.where(F.col("kind") == _SUMS).groupBy("variable", "length").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(a) for c, a in (("one", "same"), ("two", "two"), ("apart", "apart"))])
    # Longer by one: equal but for the last letter, and equal but for the first.
    short = own.select("variable", F.col("word").alias("_key"), F.col("id").alias("_id"), F.col("weight").alias("_weight"))
    front = longer.withColumns({"_key": F.expr("left(word, length - 1)"), "end": F.lit("front")})
    back = longer.withColumns({"_key": F.expr("right(word, length - 1)"), "end": F.lit("back")})
    met = cut(front.unionByName(back).join(short, ["variable", "_key"]).drop("_key"))
    product = (F.col("weight") * F.col("_weight")).cast("decimal(38,0)")
    last = met.where("end = 'front'").groupBy("variable", (F.col("length") - 1).alias("length")).agg(F.sum(product).alias("b0"))
    # A word behind one more letter may differ from the other's front in at most one letter, too; it is counted there already.
    differing = F.aggregate(F.sequence(F.lit(1), F.col("length") - 1), F.lit(0), lambda n, i: n + (F.substring("word", i, F.lit(1)) != F.substring("word", i + 1, F.lit(1))).cast("int"))
    behind = met.where("end = 'back'").where(differing > 1).groupBy("variable").agg(F.sum(product).alias("behind"))
    parts = parts.join(last, ["variable", "length"], "full")
    zero, n = F.lit(0).cast("decimal(38,0)"), F.col("length").cast("decimal(38,0)")
    same, apart, two, b0 = (F.coalesce(F.col(c), zero) for c in ("same", "apart", "two", "b0"))
    counted = parts.groupBy("variable").agg(F.sum((same + (two - (n - 1) * same) + b0 + (apart - n * b0)).cast("decimal(38,0)")).alias("pairs"))
    counted = counted.join(behind, "variable", "full").select("variable", (F.coalesce("pairs", zero) + F.coalesce("behind", zero)).cast("long").alias("pairs"))
    named = lambda df: df.withColumn("variable", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("variable")) if names else F.lit(""))

    ends = met.select("variable", F.least("id", "_id").alias("id"), F.greatest("id", "_id").alias("other"))
    ranked = Window.partitionBy("variable").orderBy("id", "other")
    top = found.where(F.col("kind") == _PAIR).select("variable", "id", "other").unionByName(ends).distinct().withColumn("seq", F.row_number().over(ranked)).where(F.col("seq") <= examples)
    # A few rows a variable, so the labels need not move.
    for at, shown in (("id", "first"), ("other", "second")):
        top = base.select(F.col("id").alias(at), F.col("label").alias(shown)).join(F.broadcast(top), at)
    return named(counted.where("pairs > 0")), named(top.select("variable", "seq", "first", "second"))


def _found(words: DataFrame, examples: int) -> DataFrame:
    """Sums and first pairs of all groups, a round of masks after the other until none is too large."""
    rows, out = words.mapInArrow(_first_rows, _ROWS), []
    while True:
        got = cut(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_counter(examples), _FOUND))
        out.append(got.where(F.col("kind") != _AGAIN))
        left = got.where(F.col("kind") == _AGAIN)
        if left.isEmpty():
            return reduce(DataFrame.unionAll, out)
        rows = left.select(*_ROWS_SCHEMA.names).mapInArrow(_next_rows, _ROWS)
