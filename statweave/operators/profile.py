"""Column roles, column profiles and the dataset summary."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statweave.functions.columns import (
    col,
    data_columns,
    is_missing,
    is_numeric_type,
    known,
    num,
    to_timestamp_any,
)
from statweave.operators.descriptive import long_moments
from statweave.plans.quantiles import exact_quantiles
from statweave.plans import tables
from statweave.plans.tables import cut, null_safe

# Texts read as yes/no, and names read as identifiers.
YES_NO = ("true", "false", "yes", "no", "y", "n", "0", "1", "t", "f")
ID_NAME = r"(^id$|_id$|uuid|guid|patient.?id|record.?id|row.?id)"
# Columns that the sketch puts above this many values certainly have more than any limit used here.
FEW_VALUES = 1_000
PERCENTS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def value_text(df: DataFrame, name: str) -> Column:
    return known(df, name).cast("string")


def _dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def column_facts(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, dict]:
    """Per column: role, n, n_missing and distinct count (exact when few, else a sketch).

    One aggregate over all columns, and one more over those with few values.
    """
    columns = list(columns or data_columns(df))
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        aggs += [F.count_if(is_missing(df, c)).alias(f"m{i}"), F.approx_count_distinct(known(df, c), 0.05).alias(f"d{i}")]
        if isinstance(_dtype(df, c), T.StringType):
            aggs.append(F.avg(F.when(col(c).isNotNull(), to_timestamp_any(df, c).isNotNull().cast("double"))).alias(f"t{i}"))
    row = df.agg(*aggs).first()
    dates = {c: row[f"t{i}"] or 0.0 for i, c in enumerate(columns) if isinstance(_dtype(df, c), T.StringType)}
    facts = {c: {"n": row["n"], "n_missing": row[f"m{i}"], "distinct": row[f"d{i}"], "exact": False} for i, c in enumerate(columns)}
    few = [c for c in columns if facts[c]["distinct"] <= FEW_VALUES]
    sets = []
    for i, c in enumerate(few):
        sets.append(F.size(F.collect_set(known(df, c))).alias(f"d{i}"))
        dt = _dtype(df, c)
        if is_numeric_type(dt):
            sets.append(F.min(known(df, c).isin(0, 1)).alias(f"b{i}"))
        elif isinstance(dt, T.StringType):
            sets.append(F.min(F.lower(col(c)).isin(*YES_NO)).alias(f"b{i}"))
        else:
            sets.append(F.lit(None).cast("boolean").alias(f"b{i}"))
    if sets:
        row = df.agg(*sets).first()
        for i, c in enumerate(few):
            facts[c].update(distinct=row[f"d{i}"], exact=True, binary=bool(row[f"b{i}"]))
    for c in columns:
        facts[c]["role"] = _role(_dtype(df, c), facts[c], dates.get(c, 0.0))
    return facts


def _role(dt: T.DataType, fact: dict, date_share: float) -> str:
    filled = fact["n"] - fact["n_missing"]
    distinct = fact["distinct"]
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if filled == 0:
        return "empty"
    if is_numeric_type(dt):
        return "boolean" if distinct <= 2 and fact.get("binary") else "numeric"
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return "text"
    if distinct <= 2 and fact.get("binary"):
        return "boolean"
    if date_share > 0.85:
        return "datetime"
    if distinct <= 50 and distinct / filled < 0.08:
        return "categorical"
    return "categorical" if distinct <= 20 else "text"


def column_roles(df: DataFrame) -> dict[str, str]:
    return {c: f["role"] for c, f in column_facts(df).items()}


def with_role(roles: dict[str, str], *wanted: str) -> list[str]:
    return [c for c, r in roles.items() if r in wanted]


def numeric_cols(df: DataFrame) -> list[str]:
    return with_role(column_roles(df), "numeric")


def categorical_cols(df: DataFrame) -> list[str]:
    return with_role(column_roles(df), "categorical", "boolean")


def datetime_cols(df: DataFrame) -> list[str]:
    return with_role(column_roles(df), "datetime")


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (variable, value) of the known values as text."""
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), value_text(df, c).alias("value")) for c in columns])
    return df.select(F.inline(pairs)).where("value is not null")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Exact distinct counts of several columns in one shuffle of (column, value)."""
    if not columns:
        return {}
    found = long_values(df, columns).distinct().groupBy("variable").count()
    counts = {r["variable"]: r["count"] for r in found.collect()}
    return {c: counts.get(c, 0) for c in columns}


def top_values(df: DataFrame, columns: Sequence[str], k: int | None = 12) -> DataFrame:
    """Rows (variable, rank, value, count) of the k most frequent values per column, or of all."""
    counts = long_values(df, columns).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("count"))
    order = Window.partitionBy("variable").orderBy(F.desc("count"), F.asc("value"))
    ranked = counts.withColumn("rank", F.row_number().over(order))
    return (ranked if k is None else ranked.where(F.col("rank") <= k)).select("variable", "rank", "value", "count")


def exact_facts(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, dict]:
    """:func:`column_facts` with every distinct count exact."""
    facts = column_facts(df, columns)
    for c, n in distinct_counts(df, [c for c, f in facts.items() if not f["exact"]]).items():
        facts[c].update(distinct=n, exact=True)
    return facts


def is_id_like(name: str, text: bool, fact: dict) -> bool:
    """Named like an identifier, or a text column of more than 20 rows without repeats or gaps."""
    if re.search(ID_NAME, name.lower()):
        return True
    return text and fact["n"] > 20 and fact["n_missing"] == 0 and fact["distinct"] == fact["n"]


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """One row per column; numeric, categorical and date details are filled by role."""
    columns = list(columns or data_columns(df))
    facts = exact_facts(df, columns) if exact else column_facts(df, columns)
    return _profile_table(df, facts)


def _profile_table(df: DataFrame, facts: dict[str, dict]) -> DataFrame:
    rows = []
    for i, (c, f) in enumerate(facts.items()):
        filled = f["n"] - f["n_missing"]
        rows.append(
            (
                i,
                c,
                f["role"],
                _dtype(df, c).simpleString(),
                f["n"],
                f["n_missing"],
                round(100 * f["n_missing"] / max(f["n"], 1), 2),
                f["distinct"],
                round(100 * f["distinct"] / max(filled, 1), 2),
                f["distinct"] <= 1,
                is_id_like(c, isinstance(_dtype(df, c), T.StringType), f),
            )
        )
    base = df.sparkSession.createDataFrame(
        rows,
        "position int, name string, role string, dtype string, n long, n_missing long, missing_pct double, n_unique long, "
        "unique_pct double, is_constant boolean, is_id_like boolean",
    )
    heads = [df.where(~is_missing(df, c)).select(F.lit(c).alias("name"), value_text(df, c).alias("v")).limit(8) for c in facts]
    examples = reduce(DataFrame.unionAll, heads).groupBy("name").agg(F.collect_list("v").alias("example_values"))
    out = null_safe(base, examples, ["name"], "left")
    roles = {c: f["role"] for c, f in facts.items()}
    numeric = with_role(roles, "numeric")
    if numeric:
        numbers = df.select(*[num(df, c).alias(c) for c in numeric])
        parts = null_safe(long_moments(numbers, numeric), exact_quantiles(numbers, numeric, PERCENTS), ["variable"])
        q = F.col("q")
        details = parts.select(
            F.col("variable").alias("name"),
            "mean",
            q[3].alias("median"),
            "std",
            "min",
            "max",
            q[2].alias("q1"),
            q[4].alias("q3"),
            (q[4] - q[2]).alias("iqr"),
            "skewness",
            "kurtosis",
            "zeros",
            "negatives",
            *[q[i].alias(f"p{int(100 * p):02d}") for i, p in enumerate(PERCENTS)],
        )
        out = null_safe(out, details, ["name"], "left")
    labels = with_role(roles, "categorical", "boolean", "text")
    if labels:
        tops = top_values(df, labels).groupBy(F.col("variable").alias("name")).agg(F.array_sort(F.collect_list(F.struct("rank", "value", "count"))).alias("top_values"))
        out = null_safe(out, tops, ["name"], "left")
    dates = with_role(roles, "datetime")
    if dates:
        aggs = []
        for c in dates:
            t = to_timestamp_any(df, c).cast("timestamp")
            aggs.append(F.struct(F.lit(c).alias("name"), F.min(t).alias("first_time"), F.max(t).alias("last_time"), F.count_if(~is_missing(df, c) & t.isNull()).alias("n_invalid")))
        wide = df.agg(*[a.alias(f"t{i}") for i, a in enumerate(aggs)])
        out = null_safe(out, wide.select(F.inline(F.array(*[f"t{i}" for i in range(len(aggs))]))), ["name"], "left")
    return out


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Distinct repeated rows with their ``count``; NULLs compare equal.

    Only an 8-byte fingerprint per row is shuffled first; full rows are
    compared just for fingerprints seen more than once.
    """
    columns = data_columns(df)
    marked = df.select(*[known(df, c).alias(c) for c in columns])
    marked = marked.withColumn("_print", F.xxhash64(*[col(c) for c in columns]))
    repeated = cut(marked.groupBy("_print").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("_print"))
    # Few repeated fingerprints are broadcast, so the rows themselves are not shuffled.
    small = repeated.limit(tables.BROADCAST_ROWS + 1).count() <= tables.BROADCAST_ROWS
    candidates = marked.join(F.broadcast(repeated) if small else repeated, "_print", "left_semi").drop("_print")
    return candidates.groupBy(*[col(c) for c in columns]).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)


def duplicate_count(df: DataFrame) -> int:
    return duplicate_rows(df).agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]


def mixed_type_columns(df: DataFrame) -> list[str]:
    """Text columns whose known values are partly (15–85%) numeric."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return []
    number = [F.when(col(c).isNotNull(), num(df, c).isNotNull().cast("double")) for c in texts]
    row = df.agg(*[F.struct(F.count(v).alias("n"), F.avg(v).alias("share")).alias(f"c{i}") for i, v in enumerate(number)]).first()
    return [c for i, c in enumerate(texts) if row[f"c{i}"]["n"] > 10 and 0.15 < row[f"c{i}"]["share"] < 0.85]


def score(miss_share: float, duplicates: int, n_rows: int, n_constant: int, n_mixed: int) -> float:
    points = 100.0 - min(40.0, miss_share * 120) - min(20.0, 100 * duplicates / max(n_rows, 1)) - min(15.0, 5.0 * n_constant) - 3.0 * n_mixed
    return round(max(0.0, min(100.0, points)), 1)


def profile_dataset(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The one-row dataset summary and the column profiles."""
    facts = exact_facts(df)
    return _summary(df, facts), _profile_table(df, facts)


def dataset_summary(df: DataFrame) -> DataFrame:
    return _summary(df, exact_facts(df))


def _summary(df: DataFrame, facts: dict[str, dict]) -> DataFrame:
    n_rows = next(iter(facts.values()))["n"] if facts else df.count()
    n_cols = len(facts)
    missing = sum(f["n_missing"] for f in facts.values())
    cells = max(n_rows * n_cols, 1)
    duplicates = duplicate_count(df)
    constant = [c for c, f in facts.items() if f["distinct"] <= 1]
    high = [c for c, f in facts.items() if f["role"] in ("categorical", "text") and f["distinct"] > min(100, max(20, n_rows * 0.5))]
    ids = [c for c, f in facts.items() if is_id_like(c, isinstance(_dtype(df, c), T.StringType), f)]
    roles = [f["role"] for f in facts.values()]
    kinds = ("numeric", "categorical", "datetime", "boolean", "text")
    row = (
        n_rows,
        n_cols,
        missing,
        round(100 * missing / cells, 2),
        duplicates,
        round(100 * duplicates / max(n_rows, 1), 2),
        ids,
        constant,
        high,
        *[roles.count(k) for k in kinds],
        score(missing / cells, duplicates, n_rows, len(constant), len(mixed_type_columns(df))),
    )
    schema = (
        "n_rows long, n_cols int, missing_cells long, missing_pct double, duplicate_rows long, duplicate_pct double, "
        "id_columns array<string>, constant_columns array<string>, high_cardinality_columns array<string>, "
        + ", ".join(f"n_{k} int" for k in kinds)
        + ", quality_score double"
    )
    return df.sparkSession.createDataFrame([row], schema)


def quality_score(df: DataFrame) -> float:
    return dataset_summary(df).first()["quality_score"]
