"""Data-quality rules as a table of issues."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statweave.functions.columns import col, data_columns, is_missing, known, num, strip, to_timestamp_any
from statweave.operators.profile import column_facts, distinct_counts, duplicate_rows, long_values, value_text, with_role
from statweave.plans.neighbours import near_pairs
from statweave.plans.quantiles import exact_quantiles

# Name parts of quantities that cannot be negative.
NON_NEGATIVE = (
    "age", "count", "qty", "quantity", "price", "amount", "weight", "height", "duration",
    "pm2.5", "pm25", "pm10", "humidity", "rainfall", "population", "score", "rating",
)
SEVERITY_POINTS = {"low": 1, "medium": 3, "high": 6}

ISSUE_SCHEMA = (
    "seq int, id string, kind string, location string, severity string, n long, pct double, low double, high double, "
    "examples array<string>, proposed struct<operation: string, column: string, columns: array<string>, method: string, limits: double>"
)


def _proposal(operation: str, column: str | None = None, columns: list[str] | None = None, method: str | None = None, limits: float | None = None):
    return (operation, column, columns, method, limits)


def _never_negative(name: str) -> bool:
    low = name.lower()
    return any(k.replace(".", "") in low.replace(" ", "") or k in low for k in NON_NEGATIVE)


def assess_quality(df: DataFrame, now: datetime | None = None) -> DataFrame:
    """All issues in rule order: whole-table rules first, then column by column."""
    now = now or datetime.now(timezone.utc).replace(tzinfo=None)
    columns = data_columns(df)
    facts = column_facts(df)
    roles = {c: f["role"] for c, f in facts.items()}
    n_rows = next(iter(facts.values()))["n"] if facts else 0
    counts = _counts(df, columns, roles, now)
    bounds = _bounds(df, with_role(roles, "numeric"))
    outside = _outside(df, bounds)
    labels = with_role(roles, "categorical", "text")
    distinct = {c: f["distinct"] for c, f in facts.items()}
    distinct.update(distinct_counts(df, [c for c in labels if not facts[c]["exact"] and facts[c]["distinct"] > 0.3 * n_rows]))
    variants, near = _case_variants(df, labels), _near_labels(df, labels)
    issues: list[dict] = []
    wanted: dict[int, Column] = {}

    def add(kind, location, severity, n=None, pct=None, low=None, high=None, proposed=None, examples=None, pick: tuple[str, Column] | None = None):
        if pick is not None:
            wanted[len(issues)] = df.where(pick[1]).select(F.lit(len(issues)).alias("seq"), value_text(df, pick[0]).alias("v")).limit(8)
        issues.append({"kind": kind, "location": location, "severity": severity, "n": n, "pct": pct, "low": low, "high": high, "proposed": proposed, "examples": examples})

    for c in columns:
        n = facts[c]["n_missing"]
        if n:
            pct = 100 * n / max(n_rows, 1)
            method = "median" if roles[c] == "numeric" else "mode"
            add("missing_values", c, "high" if pct >= 30 else "medium" if pct >= 5 else "low", n, round(pct, 2), proposed=_proposal("impute", c, method=method))
    repeated = duplicate_rows(df)
    extra = repeated.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]
    if extra:
        shown = [str(r[0]) for r in repeated.select(F.to_json(F.struct(*[col(c) for c in columns]))).limit(5).collect()]
        share = extra / max(n_rows, 1)
        add("duplicate_rows", None, "medium" if share < 0.05 else "high", extra, round(100 * share, 2), proposed=_proposal("drop_duplicates"), examples=shown)
    for a, b in _equal_columns(df, columns, counts):
        add("duplicate_columns", f"{a} / {b}", "medium", proposed=_proposal("drop_columns", columns=[b]))
    for c in columns:
        filled = n_rows - facts[c]["n_missing"]
        if distinct[c] <= 1:
            add("constant_variable", c, "medium", distinct[c], proposed=_proposal("drop_columns", columns=[c]))
        if roles[c] in ("categorical", "text") and distinct[c] > 100 and distinct[c] > 0.4 * max(n_rows, 1):
            add("high_cardinality", c, "low", distinct[c])
        if roles[c] == "numeric":
            v = num(df, c)
            if counts[f"{c}|invalid"]:
                add("invalid_data_type", c, "high", counts[f"{c}|invalid"], proposed=_proposal("to_numeric", c), pick=(c, ~is_missing(df, c) & v.isNull()))
            if c in bounds:
                b = bounds[c]
                out, far = outside[f"{c}|out"], outside[f"{c}|far"]
                if out:
                    share = out / max(filled, 1)
                    add("outliers", c, "low" if share < 0.05 else "medium", out, round(100 * share, 2), b["low"], b["high"], _proposal("winsorize", c, limits=0.01), pick=(c, (v < b["low"]) | (v > b["high"])))
                if far:
                    add("extreme_values", c, "medium", far, round(100 * far / max(filled, 1), 2), b["far_low"], b["far_high"], pick=(c, (v < b["far_low"]) | (v > b["far_high"])))
            if counts.get(f"{c}|negative"):
                add("impossible_values", c, "high", counts[f"{c}|negative"], proposed=_proposal("clip_nonnegative", c), pick=(c, v < 0))
        if roles[c] == "datetime":
            if counts[f"{c}|bad_date"]:
                add("invalid_dates", c, "high", counts[f"{c}|bad_date"], proposed=_proposal("parse_dates", c))
            if counts[f"{c}|future"]:
                add("impossible_values", c, "medium", counts[f"{c}|future"])
        if roles[c] in ("categorical", "text"):
            if counts[f"{c}|space"]:
                add("inconsistent_categories", c, "low", counts[f"{c}|space"], proposed=_proposal("strip", c))
            if c in variants:
                add("inconsistent_categories", c, "medium", proposed=_proposal("normalize_case", c))
            if c in near:
                add("potential_data_entry_errors", c, "low", near[c][0], examples=[f"{a} ≈ {b}" for a, b in near[c][1]])
    if wanted:
        shown = reduce(DataFrame.unionAll, wanted.values()).groupBy("seq").agg(F.collect_list("v").alias("v"))
        for r in shown.collect():
            issues[r["seq"]]["examples"] = r["v"]
    rows = [
        (i, f"{e['kind']}:{e['location'] or '*'}", e["kind"], e["location"], e["severity"], e["n"], e["pct"], e["low"], e["high"], e["examples"], e["proposed"])
        for i, e in enumerate(issues)
    ]
    return df.sparkSession.createDataFrame(rows, ISSUE_SCHEMA)


def _counts(df: DataFrame, columns: list[str], roles: dict[str, str], now: datetime) -> dict[str, int]:
    """Every per-row rule of every column in one aggregate."""
    limit = F.lit(now).cast("timestamp") + F.expr("interval 1 day")
    aggs = []
    for c in columns:
        present = ~is_missing(df, c)
        # Order-free fingerprints; equal columns agree in both.
        print_ = F.xxhash64(known(df, c))
        aggs += [F.sum(print_.bitwiseAND(F.lit(0x3FFFFF))).alias(f"{c}|sum"), F.bit_xor(print_).alias(f"{c}|xor")]
        if roles[c] == "numeric":
            aggs.append(F.count_if(present & num(df, c).isNull()).alias(f"{c}|invalid"))
            if _never_negative(c):
                aggs.append(F.count_if(num(df, c) < 0).alias(f"{c}|negative"))
        elif roles[c] == "datetime":
            t = to_timestamp_any(df, c).cast("timestamp")
            aggs += [F.count_if(present & t.isNull()).alias(f"{c}|bad_date"), F.count_if(t > limit).alias(f"{c}|future")]
        elif roles[c] in ("categorical", "text"):
            v = value_text(df, c)
            aggs.append(F.count_if(strip(v) != v).alias(f"{c}|space"))
    return df.agg(*aggs).first().asDict() if aggs else {}


def _bounds(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    if not columns:
        return {}
    numbers = df.select(*[num(df, c).alias(c) for c in columns])
    found = {}
    for r in exact_quantiles(numbers, columns, [0.25, 0.75]).collect():
        q1, q3 = r["q"] or (None, None)
        if q1 is not None and q3 is not None and q3 - q1 > 0:
            iqr = q3 - q1
            found[r["variable"]] = {"low": q1 - 1.5 * iqr, "high": q3 + 1.5 * iqr, "far_low": q1 - 3 * iqr, "far_high": q3 + 3 * iqr}
    return found


def _outside(df: DataFrame, bounds: dict[str, dict]) -> dict[str, int]:
    aggs = []
    for c, b in bounds.items():
        v = num(df, c)
        aggs += [F.count_if((v < b["low"]) | (v > b["high"])).alias(f"{c}|out"), F.count_if((v < b["far_low"]) | (v > b["far_high"])).alias(f"{c}|far")]
    return df.agg(*aggs).first().asDict() if aggs else {}


def _equal_columns(df: DataFrame, columns: list[str], counts: dict) -> list[tuple[str, str]]:
    """Equal column pairs: only pairs whose fingerprints agree are compared value by value."""
    groups: dict[tuple, list[str]] = {}
    for c in columns:
        groups.setdefault((df.schema[c].dataType.simpleString(), counts[f"{c}|sum"], counts[f"{c}|xor"]), []).append(c)
    pairs = [(a, b) for g in groups.values() for i, a in enumerate(g) for b in g[i + 1 :]]
    if not pairs:
        return []
    row = df.agg(*[F.min(known(df, a).eqNullSafe(known(df, b))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    return [p for i, p in enumerate(pairs) if row[f"p{i}"]]


def _case_variants(df: DataFrame, labels: list[str]) -> set[str]:
    """Columns in which two labels differ only by case; 128-bit digests stand in for long texts."""
    if not labels:
        return set()
    digests = long_values(df, labels).select("variable", F.md5(F.lower("value").cast("binary")).alias("l"), F.md5(F.col("value").cast("binary")).alias("v"))
    mixed = digests.groupBy("variable", "l").agg((F.min("v") != F.max("v")).alias("mixed"))
    return {r["variable"] for r in mixed.groupBy("variable").agg(F.max("mixed").alias("mixed")).where("mixed").collect()}


def similar(a: Column, b: Column) -> Column:
    """Short label distance: one contains the other with one letter more, or at most two places differ."""
    a, b = F.lower(strip(a)), F.lower(strip(b))
    gap = F.abs(F.length(a) - F.length(b))
    inside = F.contains(a, b) | F.contains(b, a)
    shared = F.least(F.length(a), F.length(b))
    places = F.transform(F.sequence(F.lit(1), F.greatest(shared, F.lit(1))), lambda i: (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))).cast("int"))
    differing = F.aggregate(places, F.lit(0), lambda s, v: s + v) + gap
    return (F.length(a) > 0) & (F.length(b) > 0) & (gap <= 2) & F.when(inside, gap == 1).otherwise(differing.between(1, 2))


def near_labels(df: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """(variable, pairs): how many pairs of labels of each column are :func:`similar`; (variable, seq, first, second): the first ten, commonest labels first.

    Labels that differ only by case or outer spaces are one word of the search.
    """
    counts = long_values(df, labels).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("count"))
    place = F.struct((-F.col("count")).alias("c"), F.left("value", F.lit(40)).alias("v"))
    words = counts.groupBy("variable", F.lower(strip(F.col("value"))).alias("word")).agg(F.count(F.lit(1)).alias("weight"), F.min(place).alias("place"), F.min_by("value", place).alias("label"))
    return near_pairs(words)


def _near_labels(df: DataFrame, labels: list[str]) -> dict[str, tuple[int, list[tuple[str, str]]]]:
    if not labels:
        return {}
    pairs, first = near_labels(df, labels)
    out: dict[str, tuple[int, list[tuple[str, str]]]] = {r["variable"]: (r["pairs"], []) for r in pairs.collect()}
    if out:
        for r in first.orderBy("variable", "seq").collect():
            out[r["variable"]][1].append((r["first"], r["second"]))
    return out


def quality_summary(issues: DataFrame) -> DataFrame:
    """Issue score and the number of issues per severity."""
    penalty = F.coalesce(F.sum(F.element_at(F.create_map(*[F.lit(v) for kv in SEVERITY_POINTS.items() for v in kv]), F.col("severity"))), F.lit(0))
    return issues.agg(
        F.greatest(F.lit(0.0), 100.0 - penalty).alias("score"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")],
        F.count(F.lit(1)).alias("total"),
    )


def outlier_listing(issues: DataFrame, k: int | None = 12) -> DataFrame:
    found = issues.where(F.col("kind").isin("outliers", "extreme_values")).orderBy("seq")
    return found if k is None else found.limit(k)


def propose_cleaning(issues: DataFrame) -> DataFrame:
    """Distinct proposed operations, each with the first issue that asked for it."""
    asked = issues.where("proposed is not null")
    first = asked.groupBy(F.to_json("proposed").alias("_key")).agg(F.min_by(F.struct("seq", "proposed", "id", "severity"), "seq").alias("f"))
    return first.select("f.seq", "f.proposed.*", F.col("f.id").alias("from_issue"), "f.severity").orderBy("seq")


