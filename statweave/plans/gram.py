"""Cross products of many columns in one pass, with or without segments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statweave.functions.columns import col
from statweave.plans.tables import centre

# Up to this width the sums are plain aggregate expressions; wider ones go
# through matrix products per Arrow batch.
WIDE = 24


def gram(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), weight: str | None = None, centres: Sequence[float] | None = None) -> DataFrame:
    """Rows (by..., n, w, s, q, c): count, sum of weights, and sums of (x-c) and (x-c)(x-c)'.

    ``q`` is the upper triangle, row by row.  Rows with a NULL must have been
    dropped before.
    """
    cols = list(cols)
    centres = list(centre(df, cols) if centres is None else centres)
    if len(cols) > WIDE:
        return _wide(df, cols, list(by), weight, centres)
    x = [col(c) - F.lit(k) for c, k in zip(cols, centres)]
    w = col(weight) if weight else None
    first = [F.sum(v if w is None else w * v) for v in x]
    second = [F.sum(x[i] * x[j] if w is None else w * x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)).cast("double") if w is None else F.sum(w)).alias("w"),
        F.array(*first).alias("s"),
        F.array(*second).alias("q"),
        F.array(*[F.lit(float(k)) for k in centres]).alias("c"),
    )


def _wide(df: DataFrame, cols: list[str], by: list[str], weight: str | None, centres: list[float]) -> DataFrame:
    p = len(cols)
    upper = np.triu_indices(p)
    shift = np.array(centres)
    chosen = df.select(*[col(b) for b in by], F.array(*[col(c) for c in cols]).alias("_x"), (col(weight) if weight else F.lit(1.0)).alias("_w"))
    schema = ", ".join([f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by] + ["_k int", "_v double", "_n long"])

    def sums(batches):
        # One set of sums per segment and task; rows are (index of the sum, value).
        totals: dict = {}
        for batch in batches:
            groups = [((), batch)] if not by else batch.groupby(by, dropna=False, sort=False)
            for key, part in groups:
                x = np.vstack(part["_x"].to_numpy()) - shift
                w = part["_w"].to_numpy(float)
                xw = x * w[:, None]
                flat = np.concatenate([[w.sum()], xw.sum(axis=0), (xw.T @ x)[upper]])
                key = key if isinstance(key, tuple) else (key,)
                old = totals.get(key)
                totals[key] = (flat, len(part)) if old is None else (old[0] + flat, old[1] + len(part))
            if len(totals) > 64:
                yield from emit(totals)
                totals = {}
        yield from emit(totals)

    def emit(totals):
        for key, (flat, n) in totals.items():
            out = pd.DataFrame({"_k": np.arange(len(flat)), "_v": flat, "_n": n})
            for b, v in zip(by, key):
                out[b] = [v] * len(flat)
            yield out[[*by, "_k", "_v", "_n"]]

    parts = chosen.mapInPandas(sums, schema)
    summed = parts.groupBy(*by, "_k").agg(F.sum("_v").alias("_v"), F.sum("_n").alias("_n"))
    # One short row set per segment: 1 + p + p(p+1)/2 sums.
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda e: e["_v"])
    rows = summed.groupBy(*by).agg(F.max("_n").alias("n"), listed.alias("_l"))
    return rows.select(
        *by,
        "n",
        F.col("_l")[0].alias("w"),
        F.slice("_l", 2, p).alias("s"),
        F.slice("_l", p + 2, p * (p + 1) // 2).alias("q"),
        F.array(*[F.lit(float(k)) for k in centres]).alias("c"),
    )


class Moments:
    """Means and centred cross products of one row made by :func:`gram`."""

    def __init__(self, record: dict):
        self.n = int(record["n"] or 0)
        self.ok = self.n > 0 and record["w"] is not None and record["w"] == record["w"]
        if not self.ok:
            return
        self.w = float(record["w"])
        s = np.array(record["s"], float)
        p = len(s)
        q = np.zeros((p, p))
        q[np.triu_indices(p)] = np.array(record["q"], float)
        q = q + np.triu(q, 1).T
        self.mean = np.array(record["c"], float) + s / self.w
        self.cross = q - np.outer(s, s) / self.w

    def cov(self, ddof: int = 1) -> np.ndarray:
        return self.cross / (self.n - ddof)


def solve(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """Solve (or invert) a symmetric system after scaling its diagonal to one."""
    d = np.sqrt(np.clip(np.diag(a), 0, None))
    d = np.where(d > 0, d, 1.0)
    inverse = np.linalg.pinv(a / np.outer(d, d), hermitian=True, rcond=1e-12) / np.outer(d, d)
    return inverse if b is None else inverse @ b


def dot(cols: Sequence[Column], coefficients: Sequence[float | Column]) -> Column:
    out = F.lit(0.0)
    for c, k in zip(cols, coefficients):
        out = out + c * (k if isinstance(k, Column) else F.lit(float(k)))
    return out
