"""Row filters, group comparison and the exploration bundle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statweave.functions.columns import known, num, raw_label, require
from statweave.operators.correlation import correlation_matrix
from statweave.operators.groups import G, Y
from statweave.operators.profile import column_roles, profile_columns, top_values, with_role
from statweave.plans.quantiles import exact_quantiles
from statweave.plans.tables import attach, null_safe


def _as_text(df: DataFrame, name: str) -> Column:
    """The value as text; a missing one reads "nan"."""
    text = known(df, name).cast("string")
    if isinstance(df.schema[name].dataType, T.BooleanType):
        text = F.initcap(text)
    return F.coalesce(text, F.lit("nan"))


def _condition(df: DataFrame, f: dict) -> Column | None:
    name, op, value = f.get("column"), f.get("op"), f.get("value")
    if name not in df.columns:
        return None
    if op == "eq":
        return _as_text(df, name) == str(value)
    if op == "neq":
        return _as_text(df, name) != str(value)
    if op == "gt":
        return num(df, name) > float(value)
    if op == "lt":
        return num(df, name) < float(value)
    if op == "contains":
        return _as_text(df, name).rlike("(?i)" + str(value))
    if op == "in":
        wanted = value if isinstance(value, (list, tuple)) else str(value).split(",")
        return _as_text(df, name).isin([str(v).strip() for v in wanted])
    return None


def filter_rows(df: DataFrame, filters: Sequence[dict]) -> DataFrame:
    """Rows that pass all filters; filters on unknown columns are ignored."""
    for f in filters or []:
        condition = _condition(df, f)
        if condition is not None:
            df = df.where(condition)
    return df


def group_compare(df: DataFrame, y: str, g: str) -> DataFrame:
    """n, mean, sd and quartiles of a numeric column per raw group."""
    require(df, y, g)
    rows = df.select(num(df, y).alias(Y), raw_label(known(df, g)).alias(G)).where(f"{Y} is not null and {G} is not null")
    moments = rows.groupBy(G).agg(F.count(F.lit(1)).alias("n"), F.avg(Y).alias("mean"), F.stddev_samp(Y).alias("sd"))
    quartiles = exact_quantiles(rows, [Y], [0.25, 0.5, 0.75], [G]).select(G, "q")
    q = F.col("q")
    return null_safe(moments, quartiles, [G]).select(F.col(G).alias("group"), "n", "mean", "sd", q[1].alias("median"), q[0].alias("q1"), q[2].alias("q3"))


def explore(df: DataFrame) -> dict[str, DataFrame]:
    """Profiles of the numeric columns, top levels of the categorical ones, and the Pearson matrix."""
    roles = column_roles(df)
    numeric, labels = with_role(roles, "numeric"), with_role(roles, "categorical", "boolean")
    out = {}
    if numeric:
        out["descriptives"] = profile_columns(df, numeric)
    if labels:
        top = top_values(df, labels, 20)
        shown = top.groupBy("variable").agg(F.sum("count").alias("_all"))
        out["frequencies"] = attach(top, shown, ["variable"]).select(
            "variable", F.col("value").alias("level"), "count", F.round(100 * F.col("count") / F.col("_all"), 2).alias("percent")
        )
    if len(numeric) >= 2:
        out["correlation"] = correlation_matrix(df, numeric).tables["matrix"]
    return out


def numeric_snapshot(df: DataFrame, k: int | None = 5) -> DataFrame:
    """Mean, median, standard deviation and gaps of the first k numeric columns, or of all."""
    columns = with_role(column_roles(df), "numeric")[:k]
    return profile_columns(df, columns).select("name", "mean", "median", F.col("std").alias("sd"), F.col("n_missing").alias("missing"))

