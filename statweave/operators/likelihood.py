"""ARIMA and seasonal ARIMA by exact likelihood, one series or many, short or long.

A series of at most ROWS rows is fitted where its rows are.  A longer one is cut into
chunks; for the points that its search asks for each chunk becomes one element of the
filter, elements join in a tree, and the search takes its next step.  All series go
through a pass together, and their searches live in a table.  The same search and the
same filter serve both, so the results differ by rounding only.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statweave.functions.columns import col, text_list
from statweave.functions.kalman import Arma, Search
from statweave.operators.groups import Y, side_by_side
from statweave.plans.positions import CHUNK, HALO, POS, chunk_window, chunked
from statweave.plans.tables import attach, cut, null_safe, per_segment
from statweave.result import StatResult

ROWS = 50_000
FAN_IN = 16
# Steps of the search at most.
ROUNDS = 100


def _prepared(rows: DataFrame, by: list[str], poly: np.ndarray, mean: bool, size: int) -> tuple[DataFrame, DataFrame]:
    """The differenced rows in units of their spread, by chunk, and the series: n, levels, centre, scale and the last levels."""
    shift = len(poly) - 1
    window = chunk_window(by)
    w = sum((F.lag(Y, k).over(window) * float(c) for k, c in enumerate(poly) if k and c), col(Y) * float(poly[0]))
    placed = cut(chunked(rows, shift).withColumn("_w", w).where(~F.col(HALO)).select(*by, POS, Y, "_w"))
    centre = F.avg("_w") if mean else F.lit(0.0)
    sizes = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("levels"), F.count("_w").alias("n"), centre.alias("centre"), F.avg(F.col("_w") * F.col("_w")).alias("_square"))
    spread = F.sqrt(F.greatest(F.col("_square") - F.col("centre") * F.col("centre"), F.lit(0.0)))
    sizes = cut(sizes.withColumn("scale", spread).drop("_square"))
    tail = null_safe(placed, sizes.select(*by, "levels"), by) if by else placed.crossJoin(F.broadcast(sizes.select("levels")))
    tail = tail.where(col(POS) >= F.col("levels") - max(shift, 1)).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(POS, Y))).alias("_t"))
    sizes = cut(side_by_side(sizes, tail.select(*by, F.transform("_t", lambda t: t[Y]).alias("tail")), by))
    scaled = attach(placed.where(F.col("_w").isNotNull()), sizes.select(*by, "n", "centre", "scale"), by).where("scale > 0")
    z = (F.col("_w") - F.col("centre")) / F.col("scale")
    return cut(scaled.select(*by, "n", (col(POS) - shift).alias(POS), F.floor((col(POS) - shift) / size).alias(CHUNK), z.alias("_z"))), sizes


def fitted(rows: DataFrame, by: Sequence[str], model: Arma, poly: np.ndarray, rows_at_once: int | None = None) -> DataFrame:
    """One row per series: n, levels, centre, scale, tail, _x (the point found), _llf, _variance, _state, _cov.

    A series with fewer rows than parameters and unseen start states, or without
    spread, has nulls from _x on.
    """
    by = list(by)
    size = max(rows_at_once or ROWS, model.burn + 1)
    scaled, sizes = _prepared(rows, by, poly, model.mean, size)
    fewest = model.size + model.burn + 1
    usable = scaled.where(F.col("n") > fewest)
    keys, limit = [scaled.schema[b] for b in by], ROUNDS
    found = [T.StructField(c, t) for c, t in (("_x", T.ArrayType(T.DoubleType())), ("_llf", T.DoubleType()), ("_variance", T.DoubleType()), ("_state", T.ArrayType(T.DoubleType())), ("_cov", T.ArrayType(T.DoubleType())))]

    def outcome(x: np.ndarray, whole: tuple, n: int) -> list:
        llf, variance = model.likelihood(whole, n)
        return [x.tolist(), float(llf[0]), float(variance[0]), whole[1][0].tolist(), whole[2][0].ravel().tolist()]

    def whole_series(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf.sort_values(POS)["_z"].to_numpy(float)
        search = Search(model.starts(), limit)
        while not search.done:
            search.tell(model.likelihood(model.element(search.ask(), w, True), len(w))[0])
        out = pdf[by].iloc[:1].copy()
        for field, value in zip(found, outcome(search.x, model.element(search.x[None, :], w, True), len(w)), strict=True):
            out[field.name] = [value]
        return out

    short = usable.where(F.col("n") <= size).groupBy(*by, CHUNK).applyInPandas(whole_series, T.StructType([*keys, *found]))
    fits = cut(short)
    long_ = usable.where(F.col("n") > size)
    longest = long_.agg(F.max(CHUNK)).first()[0]
    if longest is not None:
        fits = cut(fits.unionByName(_long_fits(long_, by, model, keys, found, outcome, longest)))
    return side_by_side(sizes, fits, by) if by else sizes.crossJoin(fits) if not fits.isEmpty() else sizes.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in found])


def _long_fits(rows: DataFrame, by: list[str], model: Arma, keys: list, found: list, outcome, longest: int) -> DataFrame:
    part_schema = T.StructType([*keys, T.StructField(CHUNK, T.LongType()), T.StructField("_map", T.ArrayType(T.DoubleType()))])

    def element(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS)
        points = pickle.loads(bytes(pdf["_search"].iloc[0])).ask()
        out = pdf[[*by, CHUNK]].iloc[:1].copy()
        out["_map"] = [model.pack(model.element(points, pdf["_z"].to_numpy(float), int(pdf[CHUNK].iloc[0]) == 0))]
        return out

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [model.unpack(m) for m in pdf.sort_values("_part")["_map"]]
        whole = parts[0]
        for p in parts[1:]:
            whole = model.join(whole, p)
        out = pdf[[*by, CHUNK]].iloc[:1].copy()
        out["_map"] = [model.pack(whole)]
        return out

    def passed(searches: DataFrame) -> DataFrame:
        """The element of each whole series at the points that its search asks for."""
        source = attach(rows, searches.select(*by, "_search"), by) if by else rows.withColumn("_search", F.lit(bytes(searches.first()["_search"])))
        maps, chunks = source.groupBy(*by, CHUNK).applyInPandas(element, part_schema), longest
        while chunks > 0:
            maps = maps.withColumn("_part", col(CHUNK)).withColumn(CHUNK, F.floor(col(CHUNK) / FAN_IN)).groupBy(*by, CHUNK).applyInPandas(joined, part_schema)
            chunks //= FAN_IN
        return side_by_side(maps.drop(CHUNK), searches, by) if by else maps.drop(CHUNK).crossJoin(F.broadcast(searches))

    def step(r):
        search = pickle.loads(bytes(r["_search"]))
        search.tell(model.likelihood(model.unpack(r["_map"]), r["n"])[0])
        yield {"n": r["n"], "_search": pickle.dumps(search), "_done": search.done}

    def last(r):
        search = pickle.loads(bytes(r["_search"]))
        yield dict(zip([f.name for f in found], outcome(search.x, model.unpack(r["_map"]), r["n"]), strict=True))

    fields = [("n", "long"), ("_search", "binary"), ("_done", "boolean")]
    begun = rows.groupBy(*by).agg(F.max("n").alias("n")).select(*by, "n", F.lit(pickle.dumps(Search(model.starts(), ROUNDS))).alias("_search"), F.lit(False).alias("_done"))
    searches = cut(begun)
    while not (going := searches.where(~F.col("_done"))).isEmpty():
        searches = cut(per_segment(passed(going), by, fields, step).unionByName(searches.where("_done")))

    def only_best(r):
        search = pickle.loads(bytes(r["_search"]))
        search.points = search.x[None, :]
        yield {"n": r["n"], "_search": pickle.dumps(search), "_done": True}

    at_best = cut(per_segment(searches, by, fields, only_best))
    return per_segment(passed(at_best), by, [(f.name, f.dataType.simpleString()) for f in found], last)


def arima(rows: DataFrame, by: Sequence[str], order, seasonal, poly: np.ndarray, steps: int, method: str, label: str) -> StatResult:
    """``order`` stationary and invertible, from the stationary distribution; with ``seasonal`` free parameters and a diffuse start."""
    by = list(by)
    p, _, q = order
    sp, _, sq, s = seasonal or (0, 0, 0, 1)
    model = Arma(p, q, sp, sq, s, mean=len(poly) == 1 and not seasonal, bounded=seasonal is None)
    table = cut(fitted(rows, by, model, poly))
    if not by and (table.isEmpty() or table.first()["_x"] is None):
        raise ValueError("The series is too short for this model, or does not vary.")

    def values(r):
        """The parameters in the units of the series, and the variance of its shocks."""
        out = model.parameters(np.asarray(r["_x"], float)[None, :])[0]
        if model.mean:
            out[0] = r["centre"] + r["scale"] * out[0]
        return out, r["_variance"] * r["scale"] ** 2

    def missing(r) -> bool:
        return r["_x"] is None or isinstance(r["_x"], float)

    def stat_row(r):
        if missing(r):
            yield {"n": r["levels"]}
            return
        counted = r["n"] - model.burn
        llf = r["_llf"] - counted * float(np.log(r["scale"]))
        k = model.size + 1
        yield {"aic": 2 * k - 2 * llf, "bic": k * float(np.log(counted)) - 2 * llf, "log_likelihood": llf, "sigma2": values(r)[1], "n": r["levels"]}

    def parameter_rows(r):
        if not missing(r):
            found, variance = values(r)
            for name, b in [*zip(model.names, found, strict=True), ("sigma2", variance)]:
                yield {"term": name, "coef": float(b)}

    def forecast_rows(r):
        if missing(r):
            return
        found, variance = values(r)
        state, cov = np.asarray(r["_state"], float) * r["scale"], np.asarray(r["_cov"], float).reshape(model.states, model.states)
        for h, (level, low, high) in enumerate(model.forecast(found, state, cov, variance, poly, list(r["tail"]), steps)):
            yield {"step": h + 1, "position": r["levels"] + h, "forecast": level, "ci95_low": low, "ci95_high": high}

    stats = per_segment(table, by, [("aic", "double"), ("bic", "double"), ("log_likelihood", "double"), ("sigma2", "double"), ("n", "long")], stat_row)
    stats = stats.withColumns({"order": F.lit(str(tuple(order))), "warnings": text_list(F.when(F.col("aic").isNull(), F.lit("too few observations for this model")))})
    if seasonal:
        stats = stats.withColumn("seasonal_order", F.lit(str(tuple(seasonal))))
    tables = {
        "forecast": per_segment(table, by, [("step", "int"), ("position", "long"), ("forecast", "double"), ("ci95_low", "double"), ("ci95_high", "double")], forecast_rows),
        "params": per_segment(table, by, [("term", "string"), ("coef", "double")], parameter_rows),
    }
    return StatResult(method, label, stats, tables, ["Fitted by exact maximum likelihood through a Kalman filter."], label, by)
