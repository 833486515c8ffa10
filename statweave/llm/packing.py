"""Best-fit packing of token pieces into sequences, certified by lower bounds.

Pieces are dealt to partitions of bounded size by a hash, and each partition packs
its pieces by best-fit decreasing.  Dual-feasible functions of its lengths give a
lower bound; a partition that meets it is certified.  One that does not is packed
again by filling sequences up exactly, and keeps the better of the two.  The pieces in unfilled
sequences of the other partitions, and in the emptiest sequence of every
partition, are exchanged: dealt anew with other partitions' pieces and packed
again.  A round that saves no sequence is undone and ends the search.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statweave.llm.common import sized, small_batches, written
from statweave.llm.tokens import encoder

CAPACITY = 1024
END = 2
# Pieces in a partition, on average.
PARTITION_PIECES = 20_000
ROUNDS = 6
# The dual-feasible functions of rounding are tried for these numbers of parts.
PARTS = range(1, 9)


def bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing of the lengths uses fewer bins: the best of the dual-feasible functions."""
    if len(lengths) == 0:
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1)
    x = np.arange(capacity + 1)
    best = -(-int(counts @ x) // capacity)
    # Lengths over capacity - e count whole, those under e not at all.
    below = np.concatenate([[0], np.cumsum(counts * x)])
    over = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])
    for e in range(1, capacity // 2 + 1):
        middle = int(below[capacity - e + 1] - below[e])
        best = max(best, int(over[capacity - e + 1]) + -(-middle // capacity))
    for k in PARTS:
        scaled = (k + 1) * x
        exact = scaled % capacity == 0
        # In units of 1 / (k capacity): x itself where it divides, else the rounded part.
        value = np.where(exact, k * x, scaled // capacity * capacity)
        best = max(best, -(-int(counts @ value) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, longest first into the fullest bin that takes it, and the number of bins."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room left
    open_ = 0  # bit r: a bin with room r
    used = 0
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = open_ >> length
        if fits:
            left = length + (fits & -fits).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                open_ ^= 1 << left
        else:
            left, at, used = capacity, used, used + 1
        bins[i], offsets[i] = at, capacity - left
        left -= length
        if left:
            room[left].append(at)
            open_ |= 1 << left
    return bins, offsets, used


def exact_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Like ``best_fit``, but each bin opens with the longest length left and is filled up exactly by one to three others where it can be.

    Bit l of ``there`` says that a length l is left, bit capacity - l of ``turned``
    the same, so that one shift and one conjunction find all pairs of a sum.
    """
    left: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, length in enumerate(lengths.tolist()):
        left[length].append(i)
    there = sum(1 << n for n in range(1, capacity + 1) if left[n])
    turned = sum(1 << capacity - n for n in range(1, capacity + 1) if left[n])
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    used = 0

    def pair(total: int) -> int:
        """The larger of two lengths left that add up to ``total``, or 0."""
        both = there & (turned >> capacity - total) & (1 << total) - 1
        while both:
            a = both.bit_length() - 1
            if 2 * a != total or len(left[a]) > 1:
                return a
            both ^= 1 << a
        return 0

    while there:
        room = capacity
        take = there.bit_length() - 1
        while take:
            i = left[take].pop()
            if not left[take]:
                there ^= 1 << take
                turned ^= 1 << capacity - take
            bins[i], offsets[i] = used, capacity - room
            room -= take
            fits = there & (1 << room + 1) - 1
            if not fits:
                break
            take = room if fits >> room & 1 else pair(room)
            tried = fits
            for _ in range(12):
                if take or not tried:
                    break
                # A first of three, from the longest down.
                a = tried.bit_length() - 1
                tried ^= 1 << a
                b = pair(room - a) if a < room else 0
                if b and (a not in (b, room - a - b) or len(left[a]) > 2):
                    take = a
            take = take or fits.bit_length() - 1
        used += 1
    return bins, offsets, used


def cut(documents: DataFrame, capacity: int = CAPACITY, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of every text's ids and the end id: doc_id, piece, start, length, ids_crc32 (and ids, 32-bit little-endian).

    A null text is empty and gives the end id alone.  Only longer texts are cut,
    into pieces of ``capacity`` of which the first may be shorter.
    """
    small_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches):
        encode = encoder(folder)
        for batch in batches:
            source, piece, start, length, crc, data = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.append(encode(text.as_py()), np.uint32(END)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    raw = ids[a:b].tobytes()
                    source.append(i), piece.append(p), start.append(a), length.append(b - a), crc.append(zlib.crc32(raw))
                    if with_ids:
                        data.append(raw)
            out = [batch.column("doc_id").take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(data, pa.binary())] * with_ids, names)

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def _round(rows: DataFrame, schema: T.StructType, number: int, count: int, capacity: int) -> DataFrame:
    """Deal the rows anew and pack each partition; adds the sequence, the offset, and the partition's fit."""
    parts = max(1, -(-count // PARTITION_PIECES))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(F.lit(number), *[F.col(f"`{f.name}`") for f in schema]), F.lit(parts)).cast("int"))

    def run(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        bins, offsets, used = best_fit(lengths, capacity)
        least = bound(lengths, capacity)
        if used > least and (other := exact_fit(lengths, capacity))[2] < used:
            bins, offsets, used = other
        fill = np.bincount(bins, weights=lengths, minlength=used).astype(np.int64)
        certified = used == least
        part = group.column("_part")[0].as_py()
        # Exchanged next: unfilled sequences of an uncertified partition, the emptiest one of any.
        loose = (fill < capacity) & (~np.full(used, certified) | (np.arange(used) == int(fill.argmin())))
        out = [group.column(f.name) for f in schema]
        out += [pa.array((number << 56) + (part << 28) + bins), pa.array(offsets), pa.array(loose[bins]), pa.array(np.full(len(bins), certified))]
        return pa.Table.from_arrays(out, names=[*[f.name for f in schema], "sequence_id", "offset", "_loose", "certified"])

    fields = [*schema, *[T.StructField(n, t) for n, t in (("sequence_id", T.LongType()), ("offset", T.LongType()), ("_loose", T.BooleanType()), ("certified", T.BooleanType()))]]
    return dealt.groupBy("_part").applyInArrow(run, T.StructType(fields))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, ``length`` from 1 to capacity) with sequence_id, offset, certified.

    Every row stays, repeated rows included; no rows give no sequences.  Columns
    of the added names are replaced.  ``certified``: the row's partition met its
    lower bound when it was packed.
    """
    added = ("sequence_id", "offset", "certified", "_loose", "_part")
    pieces = pieces.select(*[f"`{c}`" for c in pieces.columns if c not in added])
    schema = pieces.schema
    names = [f"`{f.name}`" for f in schema]
    result = written(_round(pieces, schema, 0, pieces.count(), capacity))
    kept: list[DataFrame] = []
    for number in range(1, ROUNDS + 1):
        loose = result.where("_loose")
        count, before = loose.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        if before < 2:
            break
        again = written(_round(loose.select(*names), schema, number, count, capacity))
        after = again.agg(F.count_distinct("sequence_id")).first()[0]
        if after >= before:
            break
        kept.append(result.where(~F.col("_loose")))
        result = again
    out = result
    for part in kept:
        out = out.unionByName(part)
    return out.drop("_loose")


def sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """One row per sequence with its ids joined in order of the offsets; ``pieces`` as cut with ids."""
    place = packed.select("doc_id", "piece", "ids_crc32", "sequence_id", "offset").distinct()
    rows = pieces.join(sized(written(place)), ["doc_id", "piece", "ids_crc32"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return rows.groupBy("sequence_id").agg(joined.alias("ids"))
