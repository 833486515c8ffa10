"""Building blocks: the paths for huge tables give what a plain computation gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statweave.plans.dominance import dense_rank, ordered_pairs
from statweave.plans.gram import Moments, gram
from statweave.plans.positions import HALO, POS, carry, chunk_window, chunked, positions
from statweave.plans.quantiles import exact_quantiles
from statweave.plans.ranks import attach_ranks, cut_points, midranks, running
from statweave.plans.sampling import draw_number, sample_per_segment


def frame(n=120, seed=1, ties=True):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 9, n).astype(float) if ties else rng.normal(size=n)
    # One segment and one value hold about a third of the rows.
    g = np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b", "c"], n))
    v[rng.random(n) < 0.33] = 4.0
    return pd.DataFrame({"id": np.arange(n), "g": g, "v": v, "w": rng.normal(size=n)})


@pytest.mark.parametrize("ties", [True, False])
@pytest.mark.parametrize("parts", [1, 3, 8])
def test_midranks_equal_pandas(spark, tiny_limits, ties, parts):
    pdf = frame(ties=ties)
    df = spark.createDataFrame(pdf).repartition(parts)
    got = midranks(df, "v", ["g"]).toPandas()
    pdf["rank"] = pdf.groupby("g")["v"].rank()
    want = pdf.groupby(["g", "v"])["rank"].agg(["size", "first"])
    for r in got.itertuples():
        size, rank = want.loc[(r.g, r.v)]
        assert r.n == size and r.ties == size and r.rank == pytest.approx(rank)
    assert len(got) == len(want)


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, tiny_limits, descending):
    pdf = frame(ties=False).drop_duplicates("v")
    df = spark.createDataFrame(pdf)
    got = running(df, "v", ["w"], [], cut_points(df, "v"), unique=True, descending=descending).toPandas().set_index("id")
    ordered = pdf.sort_values("v", ascending=not descending)
    before = ordered["w"].cumsum() - ordered["w"]
    assert np.allclose(got.loc[ordered["id"], "w_before"], before)


@pytest.mark.parametrize("probs", [[0.5], [0.0, 0.25, 0.9, 1.0]])
def test_exact_quantiles(spark, tiny_limits, probs):
    pdf = frame(400, ties=False)
    df = spark.createDataFrame(pdf)
    got = {r["g"]: r["q"] for r in exact_quantiles(df, ["v"], probs, ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(list(part["v"].quantile(probs)))


def test_quantiles_of_nothing(spark, tiny_limits):
    df = spark.createDataFrame([], "v double")
    assert exact_quantiles(df, ["v"], [0.5]).first()["q"] in (None, [None])


@pytest.mark.parametrize("by", [[], ["g"]])
def test_positions_and_halo(spark, tiny_limits, by):
    pdf = frame(90)
    df = spark.createDataFrame(pdf).repartition(5)
    placed = positions(df, ["v", "id"], by)
    got = placed.toPandas().set_index("id")[POS]
    order = pdf.sort_values(["v", "id"])
    want = order.groupby("g").cumcount() if by else pd.Series(range(len(order)), index=order.index)
    assert (got.loc[order["id"]].to_numpy() == want.to_numpy()).all()
    lagged = chunked(placed, 3).withColumn("p", F.lag("w", 3).over(chunk_window(by))).where(~F.col(HALO)).toPandas().set_index("id")["p"]
    expect = order.groupby("g")["w"].shift(3) if by else order["w"].shift(3)
    assert np.allclose(lagged.loc[order["id"]].to_numpy(float), expect.to_numpy(float), equal_nan=True)


@pytest.mark.parametrize("forward", [True, False])
def test_carry(spark, tiny_limits, forward):
    pdf = frame(60)
    pdf["x"] = pdf["w"].where((pdf["id"] % 7 == 3) | (pdf["id"] == 20))
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = carry(positions(df, ["id"]), "x", "f", [], forward).toPandas().set_index("id")["f"].sort_index()
    want = pdf["x"].ffill() if forward else pdf["x"].bfill()
    assert np.allclose(got.to_numpy(float), want.to_numpy(float), equal_nan=True)


def test_ordered_pairs_equal_brute_force(spark, tiny_limits):
    pdf = frame(80)
    pdf["y"] = np.random.default_rng(5).integers(0, 6, len(pdf)).astype(float)
    df = spark.createDataFrame(pdf)
    ranks = dense_rank(df, "v", ["g"], cut_points(df, "v"), "rank")
    rows = df.join(ranks, ["g", "v"]).withColumn("one", F.lit(1).cast("long"))
    got = {r["g"]: r for r in ordered_pairs(rows, "rank", "y", "one", "one", 90_000, ["g"]).collect()}
    for g, p in pdf.groupby("g"):
        v, y = p["v"].to_numpy(), p["y"].to_numpy()
        earlier = v[:, None] < v[None, :]
        assert got[g]["pairs"] == earlier.sum()
        assert got[g]["less"] == (earlier & (y[:, None] < y[None, :])).sum()
        assert got[g]["equal"] == (earlier & (y[:, None] == y[None, :])).sum()


def test_hot_values_join(spark, tiny_limits):
    pdf = frame(200)
    df = spark.createDataFrame(pdf)
    ranks = midranks(df, "v", ["g"]).select("g", "v", "ties", "rank")
    got = attach_ranks(df, ranks, "v", ["g"], 10).toPandas().set_index("id")["rank"].sort_index()
    assert np.allclose(got, pdf.groupby("g")["v"].rank())


@pytest.mark.parametrize("wide", [1, 100])
def test_gram(spark, monkeypatch, wide):
    from statweave.plans import gram as module

    monkeypatch.setattr(module, "WIDE", wide)
    pdf = frame(150, ties=False)
    pdf["v"] += 1e6
    df = spark.createDataFrame(pdf)
    for r in gram(df, ["v", "w"], ["g"]).collect():
        m = Moments(r.asDict(recursive=True))
        part = pdf[pdf["g"] == r["g"]][["v", "w"]]
        assert np.allclose(m.mean, part.mean()) and np.allclose(m.cov(), part.cov(), rtol=1e-7)


def test_seeded_sample_ignores_the_layout(spark):
    df = spark.createDataFrame(frame(3000))
    picks = []
    for parts in (1, 7):
        rows = df.repartition(parts)
        rows = rows.withColumn("d", draw_number(rows, "id", 3))
        picks.append({(r["g"], r["id"]) for r in sample_per_segment(rows, 50, ["g"], "d").collect()})
    assert picks[0] == picks[1]
    assert sum(1 for g, _ in picks[0] if g == "hot") == 50


def test_null_segments_stay(spark, tiny_limits):
    df = spark.createDataFrame([(None, float(i % 5)) for i in range(20)] + [("a", float(i)) for i in range(20)], "g string, v double")
    got = {r["g"]: r["q"][0] for r in exact_quantiles(df, ["v"], [0.5], ["g"]).collect()}
    assert got == {None: 2.0, "a": 9.5}
