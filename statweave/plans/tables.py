"""Materialising small tables, joining them back, and finishing them per segment."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statweave.functions.columns import col

# A table is broadcast only after its rows were counted to be at most this many.
BROADCAST_ROWS = 100_000


def checkpoint_dir(spark: SparkSession) -> None:
    """Point Spark at the folder in spark.checkpoint.dir; where that is unset, at one in the warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(shared or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, lineage cut, survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match, keeping one copy of the keys."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on: Column | None = None
    for k in keys:
        same = col(k).eqNullSafe(col(f"_r_{k}"))
        on = same if on is None else on & same
    out = left.join(renamed, on, how)
    return out.drop(*[f"_r_{k}" for k in keys]) if how not in ("left_semi", "left_anti") else out


def attach(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Add the columns of a per-key table to every row.

    The table is materialised first.  It is broadcast only when its counted
    rows are few; a larger one is joined by key, where the adaptive skew join
    splits hot keys.  Without keys the single row becomes literals.
    """
    if not keys:
        row = table.first()
        return df.withColumns({f.name: literal(row[f.name], f.dataType) for f in table.schema.fields})
    table = cut(table)
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return null_safe(df, F.broadcast(table) if small else table, keys, how)


def literal(value, data_type: T.DataType) -> Column:
    if value is None:
        return F.lit(None).cast(data_type)
    if isinstance(data_type, T.StructType):
        return F.struct(*[literal(value[f.name], f.dataType).alias(f.name) for f in data_type.fields])
    if isinstance(data_type, T.ArrayType):
        return F.array(*[literal(v, data_type.elementType) for v in value]).cast(data_type)
    return F.lit(value).cast(data_type)


def per_segment(
    table: DataFrame,
    by: Sequence[str],
    fields: Sequence[tuple[str, str]],
    finish: Callable[[dict], Iterable[dict]],
) -> DataFrame:
    """Turn each row of sufficient statistics into result rows with ``finish``."""
    names = [*by, *[n for n, _ in fields]]
    schema = T.StructType(
        [table.schema[b] for b in by] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields]
    )
    integral = {n for n, t in fields if t in ("long", "int")}

    def run(batches):
        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                for out in finish(record):
                    rows.append([*(record[b] for b in by), *(_clean(out.get(n), n in integral) for n, _ in fields)])
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return table.mapInPandas(run, schema)


def _clean(value, integral: bool):
    if value is None:
        return None
    if isinstance(value, float) or hasattr(value, "dtype") and getattr(value, "ndim", 1) == 0:
        value = value.item() if hasattr(value, "item") else value
        if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
            return None
    return int(value) if integral else value


def centre(df: DataFrame, cols: Sequence[str]) -> list[float]:
    """The mean of each column; cross products are summed around it so that they do not cancel."""
    row = df.agg(*[F.avg(col(c)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return [0.0 if v is None or v != v or abs(v) == float("inf") else float(v) for v in row]


def failing(by: Sequence[str], ok: Column, value: Column, message: str) -> Column:
    """``value`` where ``ok``; otherwise NULL per segment, or an error for a whole table."""
    if by:
        return F.when(ok, value)
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))
