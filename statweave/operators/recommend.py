"""Choosing a method for pairs of columns from a table of rules.

A pair is described by facts: the kinds of its columns, what the caller wants,
and, for the kinds that need them, measures of the data from one aggregate.  The
first rule whose conditions all hold names the method.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.functions.columns import known, norm_label, num, raw_label
from statweave.operators.association import cells
from statweave.operators.groups import G, Y, grouped
from statweave.operators.normality import shapiro_table
from statweave.operators.profile import column_roles, with_role

EVENT_NAME = r"(?i)event|status|censor|died|death"
INTENTS = ("explore", "survival", "trend", "structure", "relationship", "difference", "predict")
KINDS = {"numeric": "number", "categorical": "label", "boolean": "label", "datetime": "time"}

SCHEMA = (
    "y string, x string, intent string, method string, params string, why array<string>, alternatives array<string>, warnings array<string>"
)


@dataclass
class Rule:
    """A method, the facts it asks for, its parameters by fact or name, and what to say."""

    method: str
    when: dict
    params: Sequence[str]
    why: str
    alternatives: Sequence[str] = ()
    warning: str | None = None


@dataclass
class Pair:
    y: str | None
    x: str | None
    facts: dict = field(default_factory=dict)
    why: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


# Conditions are on facts: a value, or a set of values. The order decides.
RULES = [
    Rule("logrank", {"intent": "survival", "x": "label"}, ("duration", "event", "group"), "The question is when an event happens, by group."),
    Rule("kaplan_meier", {"intent": "survival"}, ("duration", "event", "group"), "The question is when an event happens."),
    Rule("trend_analysis", {"intent": "trend", "y": "number"}, ("y", "time"), "The question is change over time.", ("arima", "seasonality")),
    Rule("pca", {"intent": "structure"}, ("columns",), "The question is structure among columns.", ("kmeans",)),
    Rule("fisher_exact", {"y": "label", "x": "label", "square": True, "sparse": True}, ("x", "y"), "A 2×2 table where some cell expects under 5 rows."),
    Rule("chi_square", {"y": "label", "x": "label", "square": True}, ("x", "y"), "A 2×2 table where all cells expect 5 rows or more.", ("fisher_exact",)),
    Rule("chi_square", {"y": "label", "x": "label"}, ("x", "y"), "A table with more than two levels on a side.", ("cramers_v",)),
    Rule("paired_t", {"y": "number", "x": "label", "groups": 2, "paired": True}, ("y", "x"), "Two measurements belong to each subject.", ("wilcoxon",)),
    Rule("descriptive", {"y": "number", "x": "label", "groups": {0, 1}}, ("columns_y",), "There is one group.", warning="One group has nothing to be compared with."),
    Rule("independent_t", {"y": "number", "x": "label", "groups": 2, "normal": True}, ("y", "x", "levels"), "Two groups, none far from normal or all large.", ("mannwhitney",)),
    Rule("mannwhitney", {"y": "number", "x": "label", "groups": 2}, ("y", "x", "levels"), "Two groups, a small one far from normal.", ("independent_t",)),
    Rule("oneway_anova", {"y": "number", "x": "label", "normal": True}, ("y", "x", "levels"), "Several groups, none far from normal or all large.", ("kruskal", "tukey_hsd")),
    Rule("kruskal", {"y": "number", "x": "label"}, ("y", "x", "levels"), "Several groups, a small one far from normal.", ("oneway_anova",)),
    Rule("paired_t", {"y": "number", "x": "number", "intent": "difference", "paired": True}, ("y", "x"), "Two measurements in each row are compared.", ("wilcoxon",)),
    Rule("linear_regression", {"y": "number", "x": "number", "intent": "predict"}, ("y", "predictors"), "One number is to be predicted from another.", ("spearman",)),
    Rule("pearson", {"y": "number", "x": "number", "normal": True}, ("x", "y"), "Two numbers, neither far from normal.", ("spearman", "linear_regression")),
    Rule("spearman", {"y": "number", "x": "number"}, ("x", "y"), "Two numbers, one of them far from normal, so ranks serve.", ("pearson",)),
    Rule("descriptive", {}, ("columns",), "No test is made for these columns.", warning="Name an outcome and another column."),
]


def recommend_tests(df: DataFrame, pairs: Sequence[dict], paired: bool = False, roles: dict[str, str] | None = None) -> DataFrame:
    """One recommendation per pair ``{"y", "x", "intent", "paired", "levels"}``; missing y or x get defaults."""
    roles = roles or column_roles(df)
    rows = []
    for asked in pairs:
        intent = asked.get("intent") or "explore"
        if intent not in INTENTS:
            raise ValueError(f"Unknown intent '{intent}'.")
        pair = _described(df, roles, asked, intent, bool(asked.get("paired", paired)))
        rule = next(r for r in RULES if all(_holds(pair.facts.get(k), v) for k, v in r.when.items()))
        values = _values(roles, pair, asked)
        params = {k: v for k, v in (values[p] for p in rule.params) if k != "levels" or v}
        warnings = [*pair.warnings, *([rule.warning] if rule.warning else [])]
        rows.append((pair.y, pair.x, intent, rule.method, json.dumps(params), [*pair.why, rule.why], list(rule.alternatives), warnings))
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def _holds(fact, wanted) -> bool:
    return fact in wanted if isinstance(wanted, set) else fact == wanted


def _values(roles: dict[str, str], pair: Pair, asked: dict) -> dict[str, tuple]:
    """Parameter name and value of everything a rule may ask for."""
    event = next((c for c, r in roles.items() if r in ("boolean", "numeric") and re.search(EVENT_NAME, c)), None)
    facts = pair.facts
    return {
        "y": ("y", pair.y),
        "x": ("x", pair.x),
        "predictors": ("x", [pair.x]),
        "columns": ("columns", with_role(roles, "numeric")),
        "columns_y": ("columns", [pair.y]),
        "levels": ("levels", _two(asked)),
        "duration": ("duration", pair.y if facts["y"] == "number" else None),
        "event": ("event", event),
        "group": ("group", pair.x if facts["x"] == "label" else None),
        "time": ("time", pair.x if facts["x"] == "time" else None),
    }


def _two(asked: dict) -> list | None:
    levels = asked.get("levels")
    return list(levels)[:2] if levels and len(levels) >= 2 else None


def _described(df: DataFrame, roles: dict[str, str], asked: dict, intent: str, paired: bool) -> Pair:
    kinds = {c: KINDS.get(r) for c, r in roles.items()}

    def first(*wanted: str, but: str | None = None) -> str | None:
        return next((c for kind in wanted for c, k in kinds.items() if k == kind and c != but), None)

    y = asked.get("y") or first("number") or next(iter(df.columns), None)
    x = asked.get("x") or first("label", "number", but=y)
    pair = Pair(y, x, {"intent": intent, "paired": paired, "y": kinds.get(y), "x": kinds.get(x)})
    measure = MEASURES.get((pair.facts["y"], pair.facts["x"]))
    if measure and intent not in ("survival", "structure", "trend"):
        measure(df, pair, asked)
    return pair


def _tables(df: DataFrame, pair: Pair, asked: dict) -> None:
    """Levels on both sides, and the smallest expected count, from the margins in one aggregate."""
    table = cells(df, pair.y, pair.x)
    margins = table.groupBy("x").agg(F.sum("observed").alias("t")).select(F.lit("x").alias("side"), "t")
    margins = margins.unionByName(table.groupBy("y").agg(F.sum("observed").alias("t")).select(F.lit("y").alias("side"), "t"))
    sides = {r["side"]: r for r in margins.groupBy("side").agg(F.count("*").alias("k"), F.min("t").alias("least"), F.sum("t").alias("n")).collect()}
    k = [sides[s]["k"] if s in sides else 0 for s in "xy"]
    square = k == [2, 2]
    # The two smallest margins meet in the cell that expects least.
    pair.facts |= {"square": square, "sparse": square and sides["x"]["least"] * sides["y"]["least"] / sides["x"]["n"] < 5}
    pair.why.append(f"'{pair.y}' and '{pair.x}' hold labels ({k[1]} and {k[0]}).")


def _shape(table: DataFrame, by: str) -> dict:
    """Whether all samples pass for normal: too few to tell, 200 or more, or not rejected; and how many rows the smallest has."""
    passes = (F.col("n") < 8) | (F.col("n") >= 200) | F.coalesce(F.col("p_value") >= 0.05, F.lit(False))
    return shapiro_table(table, [by]).agg(F.min(passes).alias("normal"), F.min("n").alias("least")).first().asDict()


def _groups(df: DataFrame, pair: Pair, asked: dict) -> None:
    label = known(df, pair.x)
    seen = df.select(raw_label(label).alias("raw"), norm_label(label).alias("norm")).where("raw is not null")
    counts = seen.agg(F.count_distinct("raw").alias("raw"), F.count_distinct("norm").alias("norm")).first()
    groups = 2 if _two(asked) else counts["norm"]
    pair.why.append(f"'{pair.y}' is a number and '{pair.x}' makes {groups} groups.")
    if counts["raw"] != groups:
        pair.warnings.append(f"Labels of '{pair.x}' are inconsistent: they differ by blanks or case alone.")
    pair.facts["groups"] = groups
    if groups >= 2 and not (groups == 2 and pair.facts["paired"]):
        shape = _shape(grouped(df, pair.y, pair.x, [], _two(asked)), G)
        pair.facts["normal"] = bool(shape["normal"]) or (shape["least"] or 0) >= 30


def _numbers(df: DataFrame, pair: Pair, asked: dict) -> None:
    pair.why.append(f"'{pair.y}' and '{pair.x}' are numbers.")
    if pair.facts["intent"] == "predict" or pair.facts["intent"] == "difference" and pair.facts["paired"]:
        return
    both = df.select(num(df, pair.y).alias("a"), num(df, pair.x).alias("b")).where("a is not null and b is not null")
    sides = F.array(*[F.struct(F.lit(c).alias("_side"), F.col(c).alias(Y)) for c in "ab"])
    pair.facts["normal"] = bool(_shape(both.select(F.inline(sides)), "_side")["normal"])


MEASURES: dict[tuple, Callable[[DataFrame, Pair, dict], None]] = {("label", "label"): _tables, ("number", "label"): _groups, ("number", "number"): _numbers}
