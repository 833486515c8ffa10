"""Previews, table export and result export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statweave.functions.columns import ROW_ID, col, data_columns
from statweave.result import StatResult

MAX_PREVIEW_ROWS = 200


def preview(df: DataFrame, offset: int = 0, limit: int = 80) -> DataFrame:
    """An ordered slice of at most 200 rows."""
    ordered = df.orderBy(ROW_ID) if ROW_ID in df.columns else df
    return ordered.offset(int(offset)).limit(min(int(limit), MAX_PREVIEW_ROWS)).select(*[col(c) for c in data_columns(df)])


def describe_schema(df: DataFrame) -> DataFrame:
    """Column names and types with the table's row count."""
    rows = [(c, df.schema[c].dataType.simpleString()) for c in data_columns(df)]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string").withColumn("n_rows", F.lit(df.count()))


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else col(f.name) for f in df.schema.fields])


def export(df: DataFrame, fmt: str, path: str) -> None:
    """Write the whole table as csv, json (one record per line) or parquet."""
    _write(df.drop(ROW_ID), fmt, path)


def _write(df: DataFrame, fmt: str, path: str) -> None:
    if fmt == "csv":
        _flat(df).write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"Unsupported format {fmt}")


def write_result(result: StatResult, fmt: str, path: str, assumptions: DataFrame | None = None) -> list[str]:
    """One folder per result table: statistics, each table, and the assumption checks."""
    parts = {"statistics": result.statistics, **result.tables}
    if assumptions is not None:
        parts["assumptions"] = assumptions
    for name, df in parts.items():
        _write(df, fmt, f"{path.rstrip('/')}/{name}")
    return list(parts)
