"""The whole chain for pairs of columns: profile, audit, explore, recommend, run, validate, chart."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.operators.charts import auto_eda, chart_data, recommend_chart
from statweave.operators.explore import explore
from statweave.operators.profile import column_roles, profile_dataset
from statweave.operators.quality import assess_quality, propose_cleaning, quality_summary
from statweave.operators.recommend import recommend_tests
from statweave.registry import Analysis, analyze
from statweave.result import StatResult


@dataclass
class Step:
    key: str
    status: str
    payload: object = None
    note: str | None = None


@dataclass
class Report:
    steps: list[Step] = field(default_factory=list)

    def add(self, key: str, status: str, payload: object = None, note: str | None = None) -> object:
        self.steps.append(Step(key, status, payload, note))
        return payload

    def __getitem__(self, key: str) -> object:
        return next(s.payload for s in self.steps if s.key == key)

    def table(self, spark) -> DataFrame:
        """All that the steps hold, one row per row of their tables: step, key, status, part, row (as JSON)."""
        rows = [spark.createDataFrame([], "step int, key string, status string, part string, row string")]
        for i, s in enumerate(self.steps):
            for part, table in _tables(s.payload):
                row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns]), {"ignoreNullFields": "false"})
                rows.append(table.select(F.lit(i).alias("step"), F.lit(s.key).alias("key"), F.lit(s.status).alias("status"), F.lit(part).alias("part"), row.alias("row")))
        return reduce(DataFrame.unionByName, rows)


def _tables(payload: object, name: str = "") -> list[tuple[str, DataFrame]]:
    """The tables inside a payload, with a path of names."""
    if isinstance(payload, DataFrame):
        return [(name, payload)]
    if isinstance(payload, StatResult):
        return _tables({"statistics": payload.statistics, **payload.tables}, name)
    if isinstance(payload, Analysis):
        return _tables({"result": payload.result, "checks": payload.checks, "flags": payload.flags, "validation": payload.validation}, name)
    if isinstance(payload, dict):
        return [t for k, v in payload.items() for t in _tables(v, f"{name}/{k}" if name else str(k))]
    if isinstance(payload, (list, tuple)):
        return [t for k, v in enumerate(payload) for t in _tables(v, f"{name}/{k}" if name else str(k))]
    return []


def autopilot(df: DataFrame, pairs: Sequence[dict], store=None, dataset: str | None = None, charts: int | None = None) -> Report:
    """Profile, audit, explore, recommend, run and chart; cleaning is proposed, never applied.

    A pair whose data do not allow the recommended method becomes
    a step of status ``error``; any other failure ends the chain.
    """
    report = Report()
    df = df.persist()
    try:
        roles = column_roles(df)
        report.add("profile", "done", profile_dataset(df))
        issues = assess_quality(df)
        report.add("quality", "done", (quality_summary(issues), issues))
        proposals = propose_cleaning(issues)
        report.add("cleaning_proposal", "done" if proposals.isEmpty() else "awaiting_approval", proposals, "Cleaning is never applied silently.")
        report.add("eda", "done", explore(df))
        chosen = report.add("recommend", "done", recommend_tests(df, pairs, roles=roles))
        for row in chosen.collect():
            name = f"{row['method']}({row['y']}, {row['x']})"
            try:
                done = analyze(df, row["method"], json.loads(row["params"]), store=store, dataset=dataset)
                report.add(f"analysis:{name}", "done", done)
            except (ValueError, PySparkException) as error:
                # A method's own message about the data; any other failure is one of the chain.
                if isinstance(error, PySparkException) and "USER_RAISED_EXCEPTION" not in str(error):
                    raise
                report.add(f"analysis:{name}", "error", None, str(error).splitlines()[0])
            kind = recommend_chart(roles, row["x"], row["y"])
            report.add(f"chart:{name}", "done", chart_data(df, kind, row["x"], row["y"]))
        report.add("charts", "done", auto_eda(df, charts, roles))
    finally:
        df.unpersist()
    return report
