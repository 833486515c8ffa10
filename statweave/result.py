"""What a statistical method returns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class StatResult:
    """One row of statistics per segment, plus named result tables.

    Warnings that depend on the data are in the ``warnings`` column of
    ``statistics``; ``notes`` hold what is true for every run of the method.
    """

    method: str
    label: str
    statistics: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)
    formula: str | None = None
    by: list[str] = field(default_factory=list)
