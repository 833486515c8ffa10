"""Training-order materialisation: token ids in fixed-stride shards, in a keyed random order.

Every text's ids and an end id are cut into sequences of a fixed length, the last
one padded.  Sequences are numbered over the encoded table: each task counts its
own, and the sums of the tasks before it, a table of one row per task, are added.
A Feistel network keyed by a seed permutes the numbers; a value outside the count
walks on through the network until it falls inside, so the slots are a
permutation without a table.  Shard s holds the slots from s * SHARD_SEQUENCES in
order, each of the same number of bytes: slot k begins at (k mod SHARD_SEQUENCES)
times the stride, and a reader resumes from a slot alone.

The numbers follow the partitions of the input; they are fixed once the encoded
table is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statweave.llm.common import sized, small_batches, written
from statweave.llm.shingles import mixed
from statweave.llm.tokens import encoder

LENGTH = 256
SHARD_SEQUENCES = 16_384
END = 2
SEED = 20
ROUNDS = 6
# Rounds in which shards are written; more take less space for shuffles and read the encoded ids more often.
WRITE_ROUNDS = 2
# Bytes of ids that a task holds before it sends them.
FLUSH_BYTES = 64 << 20


def permuted(numbers: np.ndarray, count: int, seed: int = SEED) -> np.ndarray:
    """The slots of the numbers 0 to count - 1: a balanced Feistel network on the next even number of bits, with cycle-walking."""
    half = np.uint64(max(1, (max(count - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for key in keys:
            left, right = right, left ^ (mixed(right + key) & mask)
        return left << half | right

    out = network(numbers.astype(np.uint64))
    while (outside := out >= np.uint64(count)).any():
        out[outside] = network(out[outside])
    return out.astype(np.int64)


def encode(documents: DataFrame, length: int = LENGTH, folder: str | None = None) -> DataFrame:
    """One row per document: doc_id, its ids with the end id (16-bit little-endian), how many, its task and the sequences before it there."""
    small_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches):
        ids_of, before, task = encoder(folder), 0, TaskContext.get().partitionId()
        for batch in batches:
            data = [np.append(ids_of(t.as_py()), np.uint32(END)).astype("<u2").tobytes() for t in batch.column("text")]
            size = np.array([len(d) // 2 for d in data], dtype=np.int64)
            n = -(-size // length)
            first = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary()), pa.array(size), pa.array(np.full(len(n), task)), pa.array(first), pa.array(n)], ["doc_id", "ids", "size", "task", "first", "n"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, size long, task long, first long, n long")


def training_order(documents: DataFrame, length: int = LENGTH, seed: int = SEED, folder: str | None = None) -> DataFrame:
    """The rows of ``placed`` over the encoded texts."""
    return placed(written(encode(documents, length, folder)), length, seed)


def _numbered(encoded: DataFrame) -> tuple[DataFrame, int]:
    """The encoded documents with ``at``, the number of their first sequence in the whole table, and the count of all sequences."""
    tasks = encoded.groupBy("task").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = written(tasks.select("task", F.coalesce(before, F.lit(0)).alias("start"), "n"))
    count = starts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return encoded.join(sized(starts.select("task", "start")), "task").withColumn("at", F.col("first") + F.col("start")), count


def _cut(batch: pa.RecordBatch, length: int, count: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The row, piece, size and slot of each sequence of the documents of a batch."""
    n, at, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "at", "size"))
    row = np.repeat(np.arange(len(n)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, piece, np.minimum(size[row] - piece * length, length), permuted(at[row] + piece, count, seed)


def placed(encoded: DataFrame, length: int = LENGTH, seed: int = SEED, share: tuple[int, int] = (0, 1)) -> DataFrame:
    """One row per sequence, or those of a share (k of n) of the shards, range-partitioned and sorted by slot: slot, shard, byte_offset, doc_id, piece, n_ids, ids.

    ``ids`` always has 2 * length bytes; what lies after the first ``n_ids`` is
    padding with the end id.  A null text is empty and gives one sequence; every
    row of a repeated document gets its own; an empty table gives no sequences.

    Sequences travel without padding, those of one task for one partition together
    in compressed Arrow streams, as the ids of one sequence alone compress badly.
    """
    spark = encoded.sparkSession
    numbered, count = _numbered(encoded)
    stride = 2 * length
    pad = np.uint16(END).tobytes()
    kind = encoded.schema["doc_id"].dataType.simpleString()
    shards = -(-count // SHARD_SEQUENCES)
    low, high = (shards * k // share[1] for k in (share[0], share[0] + 1))
    # Slots are dense, so equal ranges of shards are equal partitions; no sample is drawn.
    parts = max(1, min(high - low, max(int(spark.conf.get("spark.sql.shuffle.partitions")), (high - low) * SHARD_SEQUENCES * stride // (64 << 20))))

    def send(batches):
        held, size = [], 0

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks()
            part = (rows.column("slot").to_numpy() // SHARD_SEQUENCES - low) * parts // max(high - low, 1)
            rows = rows.take(pa.array(np.argsort(part, kind="stable")))
            names, sizes = np.unique(part, return_counts=True)
            at, blobs = 0, []
            for k in sizes.tolist():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(rows.slice(at, k).combine_chunks())
                blobs.append(sink.getvalue().to_pybytes())
                at += k
            return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "rows"])

        for batch in batches:
            row, piece, n_ids, slots = _cut(batch, length, count, seed)
            mine = (slots >= low * SHARD_SEQUENCES) & (slots < high * SHARD_SEQUENCES)
            row, piece, n_ids, slots = row[mine], piece[mine], n_ids[mine], slots[mine]
            ids = batch.column("ids")
            raw = [ids[i].as_py() for i in range(batch.num_rows)]
            data = [raw[i][p * stride : (p + 1) * stride] for i, p in zip(row.tolist(), piece.tolist(), strict=True)]
            columns = [pa.array(slots), batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(n_ids.astype(np.int32)), pa.array(data, pa.binary())]
            held.append(pa.RecordBatch.from_arrays(columns, ["slot", "doc_id", "piece", "n_ids", "ids"]))
            size += sum(map(len, data))
            if size > FLUSH_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def unpack(batches):
        for batch in batches:
            for blob in batch.column("rows"):
                with pa.ipc.open_stream(blob.as_buffer()) as stream:
                    for rows in stream:
                        data = [d.as_py() for d in rows.column("ids")]
                        full = pa.array([d + pad * (length - len(d) // 2) for d in data], pa.binary())
                        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("slot", "doc_id", "piece", "n_ids")), full], ["slot", "doc_id", "piece", "n_ids", "ids"])

    sent = numbered.select("doc_id", "ids", "size", "n", "at").mapInArrow(send, "part int, rows binary")
    rows = sent.repartitionById(parts, "part").mapInArrow(unpack, f"slot long, doc_id {kind}, piece int, n_ids int, ids binary")
    ranged = rows.select("slot", _shard(), _offset(length), "doc_id", "piece", "n_ids", "ids")
    return ranged.sortWithinPartitions("shard", "slot")


def _shard() -> Column:
    return F.expr(f"slot div {SHARD_SEQUENCES}L").alias("shard")


def _offset(length: int) -> Column:
    return F.expr(f"(slot % {SHARD_SEQUENCES}L) * {2 * length + 1}L").alias("byte_offset")


def index(encoded: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """The rows of ``placed`` without the ids and in no order: nothing but lengths is read, and nothing is shuffled."""
    numbered, count = _numbered(encoded.drop("ids"))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            row, piece, n_ids, slots = _cut(batch, length, count, seed)
            columns = [pa.array(slots), batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(n_ids.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["slot", "doc_id", "piece", "n_ids"])

    rows = numbered.select("doc_id", "size", "n", "at").mapInArrow(run, f"slot long, doc_id {kind}, piece int, n_ids int")
    return rows.select("slot", _shard(), _offset(length), "doc_id", "piece", "n_ids")


def write_shards(ordered: DataFrame, path: str) -> None:
    """Write the rows of ``training_order`` as raw files, one folder per shard.

    The file of a shard is its sequences in order of their slots, each followed by
    one line feed, so slot k is at ``byte_offset``.  Spark's own writer commits the
    files, so any store and retried tasks are safe.  Rows are sorted by shard and
    slot here, as the writer would put a sort by shard alone in place of another.
    """
    raw = ordered.sortWithinPartitions("shard", "slot").select("shard", F.col("ids").cast("string").alias("value"))
    raw.write.mode("append").partitionBy("shard").option("lineSep", "\n").text(path)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the job that made them ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shards(documents: DataFrame, path: str, length: int = LENGTH, seed: int = SEED, folder: str | None = None, rounds: int = WRITE_ROUNDS) -> DataFrame:
    """Write the shard files under ``path``; return their index: the rows of ``placed``, in no order, with the shard's folder in place of the ids.

    The shards are written in rounds, each of an equal range of them, and a round's
    shuffle files are removed when it ends: on disk lie the encoded ids, a round's
    share of them in a shuffle, and the files.
    """
    encoded = written(encode(documents, length, folder))
    with _shuffles_removed(documents.sparkSession):
        for k in range(rounds):
            write_shards(placed(encoded, length, seed, (k, rounds)), path)
    return index(encoded, length, seed).withColumn("folder", F.concat(F.lit(f"{path}/shard="), F.col("shard").cast("string")))
