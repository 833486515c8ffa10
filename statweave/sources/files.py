"""Reading files and SQL sources into DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statweave.functions.columns import ROW_ID, col, is_numeric_type, num, strip, to_timestamp_any

# Cell texts that mean "missing".
NA_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
INTEGER_TEXT = r"^\s*[+-]?\d{1,18}\s*$"
ISO_PREFIX = r"^\d{4}-\d{2}-\d{2}"


def read_delimited(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | str | None = None, multiline: bool = False) -> DataFrame:
    """Text table with a header; types come from one pass over the texts, or from ``schema``.

    Files that are not valid UTF-8 are read as Latin-1.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", multiline)
    if schema is not None:
        return reader.schema(schema).csv(path)
    texts = _missing_texts(reader.csv(path))
    facts = _text_facts(texts, ["�"])
    if facts.pop("_bad"):
        texts = _missing_texts(reader.option("encoding", "ISO-8859-1").csv(path))
        facts = _text_facts(texts, ["�"])
        facts.pop("_bad")
    return texts.select(*[_typed(c, facts[c]).alias(c) for c in texts.columns])


def _missing_texts(texts: DataFrame) -> DataFrame:
    return texts.select(*[F.when(~col(c).isin(*NA_TEXTS), col(c)).alias(c) for c in texts.columns])


def _text_facts(texts: DataFrame, bad: Sequence[str]) -> dict:
    aggs = [F.coalesce(F.max(reduce(lambda a, b: a | b, [F.coalesce(col(c).contains(bad[0]), F.lit(False)) for c in texts.columns])), F.lit(False)).alias("_bad")]
    for i, c in enumerate(texts.columns):
        v = col(c)
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.count_if(v.rlike(INTEGER_TEXT)).alias(f"l{i}"),
            F.count(num(texts, c)).alias(f"d{i}"),
            F.count_if(v.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b{i}"),
        ]
    row = texts.agg(*aggs).first()
    facts = {c: {k: row[f"{k}{i}"] for k in "nldb"} for i, c in enumerate(texts.columns)}
    facts["_bad"] = row["_bad"]
    return facts


def _typed(name: str, fact: dict) -> Column:
    v = col(name)
    if fact["n"] == 0:
        return v.cast("double")
    if fact["l"] == fact["n"]:
        return strip(v).cast("bigint")
    if fact["d"] == fact["n"]:
        return v.cast("double")
    if fact["b"] == fact["n"]:
        return F.lower(v).cast("boolean")
    return v


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = False) -> DataFrame:
    return read_delimited(spark, path, ",", schema, multiline)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return read_delimited(spark, path, "\t", schema)


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects become columns with dotted names; lists stay as they are."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        cols = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType):
                cols += [col(f.name)[g.name].alias(f"{f.name}.{g.name}") for g in f.dataType.fields]
            else:
                cols.append(col(f.name))
        df = df.select(*cols)
    return df


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of records, an object holding them under ``data``, a single object, or JSON lines."""
    text = F.trim("value")
    whole = text.startswith("{") & text.endswith("}")
    seen = spark.read.text(path).where(F.length(text) > 0).agg(F.count("*").alias("n"), F.min(whole).alias("records")).first()
    lines = seen["n"] > 1 and bool(seen["records"])
    df = spark.read.option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    if lines:
        return df
    if len(df.columns) >= 1 and "data" in df.columns and isinstance(df.schema["data"].dataType, T.ArrayType):
        if isinstance(df.schema["data"].dataType.elementType, T.StructType):
            return df.select(F.inline("data"))
        return df.select(F.explode("data").alias("0"))
    return flatten(df) if _is_object(spark, path) else df


def _is_object(spark: SparkSession, path: str) -> bool:
    """Whether the whole text begins with a brace rather than a bracket."""
    first = spark.read.option("wholetext", True).text(path).select(F.substring(F.ltrim(F.col("value")), 1, 1).alias("c"))
    return first.agg(F.min(F.col("c") == "{")).first()[0] or False


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_sql(
    spark: SparkSession,
    url: str,
    query: str | None = None,
    table: str | None = None,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int | None = None,
    **options: str,
) -> DataFrame:
    """A query, else a table, over JDBC; split by a column when one is given."""
    reader = spark.read.format("jdbc").option("url", url)
    for k, v in options.items():
        reader = reader.option(k, v)
    if partition_column and bounds and partitions:
        source = f"({query}) q" if query else table
        if not source:
            raise ValueError("read_sql needs a query or table.")
        reader = reader.option("dbtable", source).option("partitionColumn", partition_column).option("numPartitions", partitions)
        return reader.option("lowerBound", bounds[0]).option("upperBound", bounds[1]).load()
    if query:
        return reader.option("query", query).load()
    if table:
        return reader.option("dbtable", table).load()
    raise ValueError("read_sql needs a query or table.")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Reader chosen by suffix; unknown ones are read as comma-separated text."""
    name = path.lower().rstrip("/")
    if name.endswith((".parquet", ".pq")):
        return read_parquet(spark, path)
    if name.endswith(".json"):
        return read_json(spark, path)
    return read_tsv(spark, path) if name.endswith(".tsv") else read_csv(spark, path)


def _common_type(types: list[T.DataType]) -> str | None:
    if all(t == types[0] for t in types):
        return None
    if all(is_numeric_type(t) for t in types):
        return "double" if any(not isinstance(t, T.IntegralType) for t in types) else "bigint"
    return "string"


def merge_frames(dfs: Sequence[DataFrame], how: str = "concat") -> DataFrame:
    """Stack tables over the union of their columns; columns of different types are widened."""
    dfs = list(dfs)
    if not dfs:
        raise ValueError("No datasets to merge")
    if len(dfs) == 1 or how != "concat":
        return dfs[0]
    seen: dict[str, list[T.DataType]] = {}
    for d in dfs:
        for f in d.schema.fields:
            seen.setdefault(f.name, []).append(f.dataType)
    target = {c: _common_type(ts) for c, ts in seen.items()}
    widened = [d.select(*[col(c).cast(target[c]).alias(c) if target[c] else col(c) for c in d.columns]) for d in dfs]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), widened)


def infer_datetime(df: DataFrame) -> DataFrame:
    """Turn text columns of ISO dates into timestamps: over 70% of the values look like dates and over 70% of all rows parse."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    shares = [F.avg(col(c).rlike(ISO_PREFIX).cast("double")).alias(f"looks{i}") for i, c in enumerate(texts)]
    shares += [F.avg(to_timestamp_any(df, c).isNotNull().cast("double")).alias(f"parses{i}") for i, c in enumerate(texts)]
    row = df.agg(*shares).first()
    return df.withColumns({c: to_timestamp_any(df, c) for i, c in enumerate(texts) if min(row[f"looks{i}"] or 0, row[f"parses{i}"] or 0) > 0.7})


def with_row_id(df: DataFrame) -> DataFrame:
    """Number the rows in file order (growing, not dense); written once and stored with the table."""
    return df if ROW_ID in df.columns else df.withColumn(ROW_ID, F.monotonically_increasing_id())
