"""Small helpers that the text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statweave.plans.tables import checkpoint_dir

# A keyed table is broadcast only after its rows and their bytes were counted to be at most this many.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64_000_000
# White space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
# A task cuts what Arrow hands it into pieces of about this many characters, so that memory stays level.
PIECE_CHARS = 4_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """At most 500 rows in an Arrow batch: texts are long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 500:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)


def scratch(spark: SparkSession) -> str:
    """A fresh folder beside the checkpoints, which all executors share."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/text-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, columnar, safe from lost executors."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table made by ``written`` once nothing reads it any more."""
    paths = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    for path in paths:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        if where.getName().startswith("text-"):
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About what a value takes in memory."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType | T.StructType):
            inner = F.aggregate(value, F.lit(0).cast("long"), lambda total, x: total + _bytes(x, kind.elementType))
            return F.coalesce(inner, F.lit(0)) + 16
        return F.coalesce(F.size(value), F.lit(0)) * 8 + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def sized(df: DataFrame) -> DataFrame:
    """Mark a written table for broadcast if its rows and bytes were counted to be few; otherwise the join shuffles."""
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16)).cast("long")
    rows, total = df.agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (total or 0) <= BROADCAST_BYTES else df


def highest(sizes: dict[int, int], most: int) -> int:
    """The lowest level from which on at most ``most`` rows lie, given the rows of each level."""
    total, lowest = 0, max(sizes, default=0) + 1
    for level in sorted(sizes, reverse=True):
        total += sizes[level]
        if total > most:
            break
        lowest = level
    return lowest


def text_of(name: str = "text") -> Column:
    """The text, with a null text as the empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_hashes(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text in joins.

    A hash of several columns is that of the last one, seeded with that of those
    before it.  The constant has to come first: behind the text it would only
    scramble the first hash, and the two would hold 64 bits between them.
    """
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def text_key(text: Column) -> list[Column]:
    return [h.alias(name) for h, name in zip(text_hashes(text), ("_k1", "_k2"), strict=True)]


def pieces(batches: Iterator[pd.DataFrame], column: str = "text") -> Iterator[pd.DataFrame]:
    """The rows of the batches in pieces of bounded text; a longer text is a piece of its own."""
    for batch in batches:
        if len(batch) == 0:
            continue
        sizes = batch[column].str.len().fillna(0).to_numpy()
        yield from (part for _, part in batch.groupby((sizes.cumsum() - sizes) // PIECE_CHARS, sort=False))
