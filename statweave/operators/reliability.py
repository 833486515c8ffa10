"""Scale reliability."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.functions import dist
from statweave.functions.columns import col, num, present, require, text_list
from statweave.plans.gram import Moments, gram
from statweave.plans.tables import per_segment
from statweave.result import StatResult


def cronbach_alpha(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> StatResult:
    """Alpha and item-rest correlations, all from the item covariance matrix."""
    by, columns = list(by), list(columns or [])
    if len(columns) < 2:
        raise ValueError("Needs two item columns or more.")
    require(df, *columns, *by)
    names = [f"_c{i}" for i in range(len(columns))]
    rows = df.where(present(df, *columns)).select(*[col(b) for b in by], *[num(df, c).alias(a) for c, a in zip(columns, names)])
    table = gram(rows, names, by)
    k = len(columns)

    def alpha_row(r):
        m = Moments(r)
        total = float(m.cov().sum()) if m.ok and m.n > 1 else 0.0
        alpha = k / (k - 1) * (1 - float(np.trace(m.cov())) / total) if total > 0 else None
        yield {"alpha": alpha, "n_items": k, "n": int(r["n"])}

    def item_rows(r):
        m = Moments(r)
        if not m.ok or m.n < 2:
            return
        s = m.cov()
        for i, c in enumerate(columns):
            with_rest = s[i].sum() - s[i, i]
            rest = s.sum() - 2 * s[i].sum() + s[i, i]
            scale = math.sqrt(s[i, i] * rest) if s[i, i] > 0 and rest > 0 else 0.0
            rr = with_rest / scale if scale > 0 else None
            p = None
            if rr is not None and m.n > 2:
                p = 0.0 if abs(rr) >= 1 else dist.t_p(rr * math.sqrt((m.n - 2) / (1 - rr * rr)), m.n - 2)
            yield {"item": c, "item_total_r": rr, "p_value": p, "mean": m.mean[i], "sd": math.sqrt(s[i, i])}

    a = F.col("alpha")
    band = (
        F.when(a.isNull() | (a < 0.5), "unacceptable")
        .when(a < 0.6, "poor")
        .when(a < 0.7, "questionable")
        .when(a < 0.8, "acceptable")
        .when(a < 0.9, "good")
        .otherwise("excellent, or items repeat each other")
    )
    stats = per_segment(table, by, [("alpha", "double"), ("n_items", "long"), ("n", "long")], alpha_row)
    stats = stats.withColumns({"label": band, "warnings": text_list()})
    items = per_segment(table, by, [("item", "string"), ("item_total_r", "double"), ("p_value", "double"), ("mean", "double"), ("sd", "double")], item_rows)
    return StatResult("cronbach_alpha", "Cronbach's alpha", stats, {"item_total": items}, formula="α = k/(k−1) · (1 − Σσ²_i / σ²_total)", by=by)
