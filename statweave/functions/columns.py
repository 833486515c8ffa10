"""Column-level semantics shared by all operators."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "_row_id"
WHITESPACE = " \t\n\r\f\v"

# Date layouts accepted besides ISO 8601 text.
DATE_FORMATS = (
    "M/d/yyyy",
    "M/d/yyyy H:m",
    "M/d/yyyy H:m:s",
    "yyyy/M/d",
    "yyyy/M/d H:m:s",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "yyyyMMdd",
)
ISO_DATE = r"^\s*\d{4}-\d{1,2}-\d{1,2}"


def col(name: str) -> Column:
    """Column by exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def require(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise ValueError(f"There is no column '{name}'.")


def data_columns(df: DataFrame) -> list[str]:
    """All columns but the stored row number."""
    return [c for c in df.columns if c != ROW_ID]


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def numeric_columns(df: DataFrame, skip: list[str] | None = None) -> list[str]:
    skip = set(skip or []) | {ROW_ID}
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType) and f.name not in skip]


def fold_nan(c: Column) -> Column:
    """NaN counts as missing everywhere."""
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """NaN and infinities become NULL in results."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def num(df: DataFrame, name: str) -> Column:
    """Numeric view of a column: unparsable text and NaN become NULL."""
    require(df, name)
    dt = df.schema[name].dataType
    c = col(name)
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return fold_nan(c.cast("double"))
    if isinstance(dt, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    if isinstance(dt, T.StringType):
        # Java accepts a trailing type letter ("1d"); plain decimal text does not.
        return F.when(~c.rlike(r"(?i)[0-9.][df]\s*$"), fold_nan(c.try_cast("double")))
    return F.lit(None).cast("double")


def present(df: DataFrame, *names: str) -> Column:
    """Rows on which the columns hold numbers, said on the stored columns so that scans can skip NULLs."""
    conditions = []
    for name in names:
        dt = df.schema[name].dataType
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            conditions += [col(name).isNotNull(), ~F.isnan(col(name))]
        elif isinstance(dt, (T.NumericType, T.BooleanType)):
            conditions.append(col(name).isNotNull())
        else:
            conditions.append(num(df, name).isNotNull())
    return reduce(and_, conditions)


def is_missing(df: DataFrame, name: str) -> Column:
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def known(df: DataFrame, name: str) -> Column:
    """The column with NaN folded into NULL."""
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return fold_nan(c)
    return c


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest.

    ``initcap`` does that for plain words; only labels holding a letter right
    after something that is neither letter nor space need the longer way.
    """
    low = F.lower(c)
    words = F.split(low, r"(?<=[^\p{L}])(?=\p{L})")
    long_way = F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), ""
    )
    return F.when(low.rlike(r"[^\p{L} ]\p{L}"), long_way).otherwise(F.initcap(low))


def norm_label(c: Column) -> Column:
    """Group label with outer whitespace and letter case evened out."""
    return title_case(strip(c.cast("string")))


# Up to this many raw labels are mapped by a plain comparison chain.
MAPPED_LABELS = 64


def label_column(df: DataFrame, name: str) -> Column:
    """Normalised label of a column, worked out once per distinct raw label when there are few."""
    raw = known(df, name).cast("string")
    found = df.select(raw.alias("raw")).where("raw is not null").distinct().limit(MAPPED_LABELS + 1)
    pairs = found.select("raw", norm_label(F.col("raw")).alias("label")).collect()
    if len(pairs) > MAPPED_LABELS:
        return norm_label(raw)
    if all(r["raw"] == r["label"] for r in pairs):
        return raw
    mapped = F.lit(None).cast("string")
    for r in pairs:
        mapped = F.when(raw == r["raw"], r["label"]).otherwise(mapped)
    return mapped


def raw_label(c: Column) -> Column:
    return c.cast("string")


def to_timestamp_any(df: DataFrame, name: str) -> Column:
    """Timestamp view of a column; unparsable values become NULL."""
    dt = df.schema[name].dataType
    c = col(name)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return c
    if isinstance(dt, T.DateType):
        return c.cast("timestamp")
    if not isinstance(dt, T.StringType):
        return F.lit(None).cast("timestamp")
    iso = F.when(c.rlike(ISO_DATE), strip(c).try_cast("timestamp"))
    others = [F.try_to_timestamp(strip(c), F.lit(fmt)) for fmt in DATE_FORMATS]
    return F.coalesce(iso, F.when(c.rlike(r"\d"), F.coalesce(*others)))


def order_number(df: DataFrame, name: str) -> Column:
    """A number that sorts as the column does (used to cut ranges)."""
    dt = df.schema[name].dataType
    c = col(name)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def sig_label(p: Column, alpha: float = 0.05) -> Column:
    return (
        F.when(p.isNull(), "undetermined")
        .when(p < 0.001, "highly significant (p < 0.001)")
        .when(p < 0.01, "significant (p < 0.01)")
        .when(p < alpha, f"significant (p < {alpha})")
        .otherwise(f"not significant (p ≥ {alpha})")
    )


def p_format(p: Column) -> Column:
    return (
        F.when(p.isNull(), "n/a")
        .when(p < 0.0001, F.regexp_replace(F.format_string("%.2e", p), "e([+-])(\\d)$", "e$10$2"))
        .otherwise(F.format_string("%.4f", p))
    )


def text_list(*items: Column) -> Column:
    """Array of the non-null texts among ``items``."""
    if not items:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[i.cast("string") for i in items]))


def drop_missing(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows where all named columns are known.

    A conjunction, which Catalyst splits: one indivisible predicate over many
    derived columns makes its constraint inference grow exponentially.
    """
    return df.where(reduce(and_, [col(name).isNotNull() for name in names]))
