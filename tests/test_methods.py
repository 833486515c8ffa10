"""Methods against brute force, and segment runs against a loop."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from statweave.functions import dist
from statweave.operators import (
    anova,
    association,
    correlation,
    descriptive,
    hypothesis,
    multivariate,
    normality,
    regression,
    resampling,
    survival,
    timeseries,
)


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(11)
    n = 150
    g = rng.choice(["Low", "High"], n)
    x = rng.normal(50, 8, n).round(1)
    z = rng.normal(0, 1, n).round(2)
    y = (3 + 0.4 * x + 2 * z + rng.normal(0, 3, n) + (g == "High") * 1.5).round(2)
    counts = rng.poisson(np.exp(0.2 + 0.4 * z))
    flag = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + 0.9 * z)))).astype(int)
    seg = rng.choice(["p", "q"], n)
    t = (rng.exponential(20, n) * np.exp(-0.3 * z)).round(0) + 1
    e = (rng.random(n) < 0.7).astype(int)
    return pd.DataFrame({"id": range(n), "g": g, "x": x, "z": z, "y": y, "c": counts, "f": flag, "s": seg, "t": t, "e": e})


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf).repartition(3).persist()


def one(result):
    return result.statistics.first().asDict()


def test_t_test_and_segments(df, pdf):
    got = one(hypothesis.independent_t(df, "y", "g"))
    a, b = pdf[pdf.g == "High"].y, pdf[pdf.g == "Low"].y
    sp = math.sqrt(((len(a) - 1) * a.var() + (len(b) - 1) * b.var()) / (len(a) + len(b) - 2))
    assert got["group_1"] == "High" and got["cohens_d"] == pytest.approx((a.mean() - b.mean()) / sp)
    assert got["t"] == pytest.approx((a.mean() - b.mean()) / (sp * math.sqrt(1 / len(a) + 1 / len(b))))
    assert got["p_value"] == pytest.approx(dist.t_p(got["t"], got["df"]))
    for row in hypothesis.independent_t(df, "y", "g", by=["s"]).statistics.collect():
        alone = one(hypothesis.independent_t(df.where(F.col("s") == row["s"]), "y", "g"))
        for k in ("t", "df", "p_value", "levene_W", "hedges_g"):
            assert row[k] == pytest.approx(alone[k])


def test_welch_is_chosen_for_unequal_spread(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.normal(0, 1, 60)] + [("b", float(v)) for v in rng.normal(0.3, 6, 40)]
    got = one(hypothesis.independent_t(spark.createDataFrame(rows, "g string, y double"), "y", "g"))
    assert got["equal_var"] is False and got["df"] < 60 and "Welch" in got["warnings"][0]


def test_wrong_group_count(spark, df):
    with pytest.raises(Exception, match="exactly 2 groups"):
        hypothesis.independent_t(df.withColumn("k", F.lit("only")), "y", "k").statistics.collect()
    rows = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 2.0), ("p", "b", 3.0), ("q", "a", 1.0)], "s string, g string, y double")
    got = {r["s"]: r for r in hypothesis.effect_size(rows, "y", "g", by=["s"]).statistics.collect()}
    assert got["p"]["cohens_d"] is not None and got["q"]["cohens_d"] is None


def test_labels_are_normalised_only_where_asked(spark):
    rows = spark.createDataFrame([(g, float(i)) for i, g in enumerate(["Urban", "urban ", "Rural", "rural"] * 5)], "g string, y double")
    assert one(hypothesis.levene(rows, "y", "g"))["k"] == 2
    assert one(hypothesis.levene(rows, "y", "g", normalize=False))["k"] == 4


def test_rank_tests_with_tiny_limits(tiny_limits, df, pdf):
    a, b = pdf[pdf.g == "High"].y.to_numpy(), pdf[pdf.g == "Low"].y.to_numpy()
    u = (a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum()
    got = one(hypothesis.mannwhitney(df, "y", "g"))
    assert got["U"] == pytest.approx(u) and got["median_1"] == pytest.approx(np.median(a))
    d = pdf.y - pdf.x
    d = d[d != 0]
    r = d.abs().rank()
    assert one(hypothesis.wilcoxon(df, "y", "x"))["W"] == pytest.approx(min(r[d > 0].sum(), r[d < 0].sum()))
    assert one(correlation.spearman(df, "x", "y"))["coefficient"] == pytest.approx(pdf.x.rank().corr(pdf.y.rank()))
    pairs = [(np.sign(pdf.x[i] - pdf.x[j]), np.sign(pdf.c[i] - pdf.c[j])) for i, j in itertools.combinations(range(len(pdf)), 2)]
    s = sum(p * q for p, q in pairs)
    tau = s / math.sqrt(sum(p != 0 for p, _ in pairs) * sum(q != 0 for _, q in pairs))
    assert one(correlation.kendall(df, "x", "c"))["coefficient"] == pytest.approx(tau)


def test_spearman_matrix_uses_pairwise_rows(spark, tiny_limits):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.integers(0, 6, (60, 3)).astype(float), columns=list("abc"))
    pdf.loc[::7, "b"] = np.nan
    got = correlation.correlation_matrix(spark.createDataFrame(pdf), list("abc"), "spearman").tables["pairwise"].collect()
    want = pdf.corr(method="spearman")
    assert len(got) == 9
    for r in got:
        assert r["r"] == pytest.approx(want.loc[r["x"], r["y"]])


def test_kruskal_equals_chi_square_of_ranks(df, pdf):
    got = one(hypothesis.kruskal(df, "c", "s"))
    r = pdf.c.rank()
    n = len(pdf)
    ties = pdf.c.value_counts()
    h = 12 / (n * (n + 1)) * sum(len(v) * (v.mean() - (n + 1) / 2) ** 2 for _, v in r.groupby(pdf.s))
    assert got["H"] == pytest.approx(h / (1 - (ties**3 - ties).sum() / (n**3 - n)))


def test_anova_identity(df, pdf):
    f = one(anova.oneway_anova(df, "y", "g"))
    t = one(hypothesis.independent_t(df, "y", "g", equal_var=True))
    assert f["F"] == pytest.approx(t["t"] ** 2) and f["p_value"] == pytest.approx(t["p_value"])
    tukey = anova.tukey_hsd(df, "y", "g").tables["comparisons"].first()
    assert tukey["p_adj"] == pytest.approx(t["p_value"], rel=1e-3)
    r = anova.repeated_anova(df, ["x", "y"]).tables["anova"].where("Source = 'time'").first()
    assert r["F"] == pytest.approx(one(hypothesis.paired_t(df, "x", "y"))["t"] ** 2)


def test_chi_square_with_empty_cells(spark):
    rows = [("a", "p")] * 8 + [("a", "q")] * 4 + [("b", "q")] * 6 + [("c", "p")] * 3
    result = association.chi_square(spark.createDataFrame(rows, "x string, y string"), "x", "y", include_empty=True)
    o = np.array([[8, 4], [0, 6], [3, 0]], float)
    e = o.sum(1)[:, None] * o.sum(0)[None, :] / o.sum()
    got = one(result)
    assert got["chi2"] == pytest.approx(((o - e) ** 2 / e).sum()) and got["low_expected_cells"] == int((e < 5).sum())
    assert result.tables["cells"].count() == 6


def test_regression_against_lstsq(df, pdf):
    result = regression.linear_regression(df, "y", ["x", "z"], order_by="id")
    design = np.column_stack([np.ones(len(pdf)), pdf.x, pdf.z])
    beta, *_ = np.linalg.lstsq(design, pdf.y, rcond=None)
    e = pdf.y - design @ beta
    got = result.tables["coefficients"].toPandas().set_index("term")
    assert np.allclose(got.loc[["const", "x", "z"], "coef"], beta)
    s2 = (e @ e) / (len(pdf) - 3)
    inverse = np.linalg.inv(design.T @ design)
    assert np.allclose(got.loc[["const", "x", "z"], "se"], np.sqrt(s2 * np.diag(inverse)))
    stats = one(result)
    assert stats["durbin_watson"] == pytest.approx(float((np.diff(e) ** 2).sum() / (e @ e)))
    h = np.einsum("ij,jk,ik->i", design, inverse, design)
    meat = (design * (np.asarray(e) ** 2 / (1 - h) ** 2)[:, None]).T @ design
    robust = regression.robust_regression(df, "y", ["x", "z"]).tables["coefficients"].toPandas().set_index("term")
    assert np.allclose(robust.loc[["const", "x", "z"], "se"], np.sqrt(np.diag(inverse @ meat @ inverse)))
    with pytest.raises(ValueError, match="Not enough"):
        regression.linear_regression(df.limit(3), "y", ["x", "z"])


@pytest.mark.parametrize("family, target", [("binomial", "f"), ("poisson", "c")])
def test_glm_against_mllib(df, family, target):
    ours = (regression.logistic_regression if family == "binomial" else regression.poisson_regression)(df, target, ["x", "z"])
    rows = VectorAssembler(inputCols=["x", "z"], outputCol="v").transform(df.withColumn("label", F.col(target).cast("double")))
    fit = GeneralizedLinearRegression(family=family, featuresCol="v", tol=1e-12, maxIter=100).fit(rows)
    got = ours.tables["coefficients"].toPandas().set_index("term")
    assert np.allclose(got.loc[["x", "z"], "coef"], fit.coefficients.toArray(), rtol=1e-6)
    assert np.allclose(got.loc[["x", "z", "const"], "se"], fit.summary.coefficientStandardErrors, rtol=1e-5)
    assert one(ours)["aic"] == pytest.approx(fit.summary.aic, rel=1e-8)


def test_negative_binomial_and_text_outcome(df, pdf):
    got = regression.negative_binomial(df, "c", "z", by=["s"]).tables["coefficients"].toPandas()
    for s, part in pdf.groupby("s"):
        b = np.zeros(2)
        x = np.column_stack([np.ones(len(part)), part.z])
        for _ in range(60):
            mu = np.exp(x @ b)
            b = b + np.linalg.solve((x * (mu / (1 + mu))[:, None]).T @ x, x.T @ ((part.c - mu) / (1 + mu)))
        mine = got[got.s == s].set_index("term")
        assert np.allclose(mine.loc[["const", "z"], "coef"], b, atol=1e-7)
    text = regression.logistic_regression(df, "g", "z").tables["coefficients"].count()
    assert text == 2
    with pytest.raises(ValueError, match="binary"):
        regression.logistic_regression(df, "c", "z")


def _cox(pdf, xs):
    """Newton on the Efron partial likelihood, written out event by event."""
    x, t, e = pdf[xs].to_numpy(float), pdf.t.to_numpy(), pdf.e.to_numpy()
    b = np.zeros(len(xs))
    for _ in range(50):
        grad, info, llf = np.zeros(len(xs)), np.zeros((len(xs), len(xs))), 0.0
        r = np.exp(x @ b)
        for when in np.unique(t[e == 1]):
            risk, dead = t >= when, (t == when) & (e == 1)
            d = dead.sum()
            llf += (x[dead] @ b).sum()
            grad += x[dead].sum(0)
            for k in range(d):
                w = r * (risk - k / d * dead)
                s0, s1 = w.sum(), w @ x
                s2 = (x * w[:, None]).T @ x
                llf -= math.log(s0)
                grad -= s1 / s0
                info += s2 / s0 - np.outer(s1, s1) / s0**2
        b = b + np.linalg.solve(info, grad)
    return b, np.sqrt(np.diag(np.linalg.inv(info))), llf


def test_cox_against_brute_force(tiny_limits, df, pdf):
    result = survival.cox_ph(df, "t", "e", ["x", "z"])
    b, se, llf = _cox(pdf, ["x", "z"])
    got = result.tables["coefficients"].toPandas().set_index("covariate")
    assert np.allclose(got["coef"], b, rtol=1e-6) and np.allclose(got["se_coef"], se, rtol=1e-6)
    stats = one(result)
    assert stats["log_likelihood"] == pytest.approx(llf, rel=1e-9)
    score = pdf[["x", "z"]].to_numpy() @ b
    good = total = 0.0
    for i, j in itertools.permutations(range(len(pdf)), 2):
        if pdf.e[i] and (pdf.t[i] < pdf.t[j] or (pdf.t[i] == pdf.t[j] and not pdf.e[j])):
            total += 1
            good += 1.0 if score[i] > score[j] else 0.5 if abs(score[i] - score[j]) < 1e-12 else 0.0
    assert stats["concordance"] == pytest.approx(good / total)


@pytest.mark.parametrize("ties", [1, 2, 14, 15, 29, 1000, 39_999, 40_001, 300_007])
@pytest.mark.parametrize("ratio", [1.0, 1.0000001, 2.0, 1e6])
def test_tie_sums_against_plain_sums(ties, ratio):
    dead = 3.7 * ties
    c = np.arange(ties) / ties
    den = dead * ratio - c * dead
    plain = [np.log(den).sum(), (1 / den).sum(), (c / den).sum(), (1 / den**2).sum(), (c / den**2).sum(), (c * c / den**2).sum()]
    got = survival._efron.func(pd.Series([dead * ratio] * 2), pd.Series([dead] * 2), pd.Series([ties] * 2))
    assert np.allclose(got.to_numpy(), [plain] * 2, rtol=1e-11, atol=0)


def test_tie_rules_grow_with_the_logarithm_of_the_ties():
    assert len(survival._tie_rule(10**12)[0]) < 600
    assert survival._tie_rule(10**12)[1].sum() == pytest.approx(1e12)


def test_cox_scores_are_zero_with_many_ties(spark):
    """At the fitted coefficient the score equation, written out tie by tie, is zero; one time holds more deaths than the rules sum one by one."""
    rng = np.random.default_rng(5)
    t = np.where(rng.random(3000) < 0.5, 2.0, rng.integers(1, 6, 3000).astype(float))
    x, e = rng.normal(size=3000), (rng.random(3000) < 0.7).astype(int)
    rows = spark.createDataFrame(pd.DataFrame({"t": t, "x": x, "e": e}))
    got = survival.cox_ph(rows, "t", "e", "x").tables["coefficients"].first()
    r, score, information = np.exp(x * got["coef"]), 0.0, 0.0
    for when in np.unique(t[e == 1]):
        risk, dead = t >= when, (t == when) & (e == 1)
        c = np.arange(dead.sum()) / dead.sum()
        s0, s1, s2 = ((r * x**k)[risk].sum() - c * (r * x**k)[dead].sum() for k in range(3))
        score += x[dead].sum() - (s1 / s0).sum()
        information += (s2 / s0 - (s1 / s0) ** 2).sum()
    assert abs(score) < 1e-6
    assert got["se_coef"] == pytest.approx(information**-0.5, rel=1e-9)


def test_survival_edges(spark):
    rows = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 1), ("a", 2.0, 0), ("a", 3.0, 1), ("b", 5.0, 0), ("b", 6.0, 0)], "g string, t double, e int")
    result = survival.kaplan_meier(rows, "t", "e", "g")
    medians = {r["group"]: r["median_survival"] for r in result.tables["medians"].collect()}
    assert medians == {"a": 2.0, "b": None}
    curve = {(r["group"], r["time"]): r["survival"] for r in result.tables["curve"].collect()}
    assert curve[("a", 0.0)] == 1.0 and curve[("a", 2.0)] == pytest.approx(0.5) and curve[("a", 3.0)] == 0.0 and curve[("b", 6.0)] == 1.0


def test_bootstrap_width_and_ranges(tiny_limits, df, pdf):
    for stat, width in (("mean", 2 * 1.96 * pdf.x.std() / math.sqrt(len(pdf))), ("std", None), ("median", None)):
        got = one(resampling.bootstrap_ci(df, "x", stat, n_boot=600))
        assert got["ci95_low"] < got["estimate"] < got["ci95_high"]
        if width:
            assert got["ci95_high"] - got["ci95_low"] == pytest.approx(width, rel=0.15)
    again = one(resampling.bootstrap_ci(df.repartition(5), "x", "mean", n_boot=600))
    assert again["ci95_low"] == one(resampling.bootstrap_ci(df, "x", "mean", n_boot=600))["ci95_low"]


def test_permutation_matches_enumeration(spark, tiny_limits):
    y = [1.0, 4.0, 2.5, 7.0, 8.0, 6.5, 3.0, 9.0]
    rows = spark.createDataFrame([("a" if i < 4 else "b", v) for i, v in enumerate(y)], "g string, y double")
    obs = abs(np.mean(y[:4]) - np.mean(y[4:]))
    sums = [abs(sum(c) / 4 - (sum(y) - sum(c)) / 4) for c in itertools.combinations(y, 4)]
    exact = np.mean([s >= obs - 1e-9 for s in sums])
    assert one(resampling.permutation_test(rows, "y", "g", n_perm=4000))["p_value"] == pytest.approx(exact, abs=0.03)


def test_shapiro_small_and_missing(spark):
    rows = spark.createDataFrame([(float(v),) for v in [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]], "v double")
    assert one(normality.shapiro_wilk(rows, "v"))["W"] == pytest.approx(0.7888148, abs=1e-6)
    with pytest.raises(Exception, match="at least 3"):
        normality.shapiro_wilk(rows.limit(2), "v").statistics.collect()


def test_smoothing_chunks_compose(spark, tiny_limits):
    rng = np.random.default_rng(4)
    y = 10 + 0.5 * np.arange(40) + np.tile([2.0, -1.0, 0.0, -1.0], 10) + rng.normal(0, 0.3, 40)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "i int, y double")
    result = timeseries.exp_smoothing(rows, "y", seasonal="add", seasonal_periods=4, steps=4, order_by="i")
    got = one(result)
    model = timeseries.Smoother(True, 4)
    theta = np.array([[got["smoothing_level"], got["smoothing_trend"] / got["smoothing_level"], got["smoothing_seasonal"] / (1 - got["smoothing_level"])]])
    _, _, q, r, c = model.chunk(y, theta)
    z = np.linalg.pinv(q[0]) @ r[0]
    level, slope, season, sse = z[0], z[1], list(z[2:]), 0.0
    for v in y:
        e = v - (level + slope + season[-1])
        sse += e * e
        s = season.pop() + got["smoothing_seasonal"] * e
        level, slope = level + slope + got["smoothing_level"] * e, slope + got["smoothing_trend"] * e
        season.insert(0, s)
    assert got["sse"] == pytest.approx(sse, rel=1e-6)
    ahead = [r["forecast"] for r in result.tables["forecast"].orderBy("step").collect()]
    assert ahead == pytest.approx([level + (h + 1) * slope + season[3 - h] for h in range(4)], rel=1e-6)


def test_arima_recovers_coefficients(spark, tiny_limits):
    rng = np.random.default_rng(8)
    e = rng.normal(size=3000)
    w = np.zeros(3000)
    for i in range(1, 3000):
        w[i] = 0.6 * w[i - 1] + e[i] + 0.4 * e[i - 1]
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.cumsum(w))], "i int, y double")
    from statweave.plans import positions

    positions.ROWS_PER_CHUNK = 500
    result = timeseries.arima(rows, "y", order=(1, 1, 1), steps=3, order_by="i")
    got = {r["term"]: r["coef"] for r in result.tables["params"].collect()}
    assert got["ar.L1"] == pytest.approx(0.6, abs=0.06) and got["ma.L1"] == pytest.approx(0.4, abs=0.08) and got["sigma2"] == pytest.approx(1.0, abs=0.08)
    bands = [r["ci95_high"] - r["ci95_low"] for r in result.tables["forecast"].orderBy("step").collect()]
    assert bands[0] < bands[1] < bands[2]


def test_acf_and_pacf(spark, tiny_limits):
    rng = np.random.default_rng(9)
    y = np.cumsum(rng.normal(size=60)) * 0.3 + rng.normal(size=60)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "i int, y double")
    got = {r["lag"]: r for r in timeseries.acf_pacf(rows, "y", nlags=4, order_by="i").tables["lags"].collect()}
    d = y - y.mean()
    c = np.array([d[k:] @ d[: len(d) - k] for k in range(5)])
    adjusted = c / (len(y) - np.arange(5))
    for k in range(1, 5):
        assert got[k]["acf"] == pytest.approx(c[k] / c[0])
        m = np.array([[adjusted[abs(i - j)] for j in range(k)] for i in range(k)])
        assert got[k]["pacf"] == pytest.approx(np.linalg.solve(m, adjusted[1 : k + 1])[-1])


def test_row_order_is_never_guessed(df):
    with pytest.raises(ValueError, match="order_by"):
        timeseries.moving_average(df, "y")


def test_multivariate(df, pdf):
    z = (pdf[["x", "y", "z"]] - pdf[["x", "y", "z"]].mean()) / pdf[["x", "y", "z"]].std(ddof=0)
    values = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    result = multivariate.pca(df, ["x", "y", "z"], keep=["id"])
    assert np.allclose([r["eigenvalue"] for r in result.tables["variance"].orderBy("component").collect()], values)
    scores = result.tables["scores"].toPandas()
    assert scores["PC1"].var() == pytest.approx(values[0])
    fa = multivariate.factor_analysis(df, ["x", "y", "z"], 1, tol=1e-9)
    load = fa.tables["loadings"].toPandas().set_index("variable")["F1"]
    noise = fa.tables["noise"].toPandas().set_index("variable")["noise_variance"]
    assert np.allclose(load**2 + noise, 1.0, atol=1e-3)
    one_dv = multivariate.manova(df, ["y"], "g").tables["mv_test"].collect()
    f = one(anova.oneway_anova(df, "y", "g"))
    assert all(r["F"] == pytest.approx(f["F"]) and r["p_value"] == pytest.approx(f["p_value"]) for r in one_dv)
    assert one(multivariate.kmeans(df, ["x", "y"], 2))["n"] == len(pdf)


def test_frequency_keeps_every_level(spark):
    rows = spark.createDataFrame([(f"v{i}",) for i in range(300)] + [("hot",)] * 30000, "v string")
    table = descriptive.frequency(rows, "v").tables["frequencies"]
    assert table.count() == 301 and table.where("level = 'hot'").first()["percent"] == 99.01


@pytest.mark.parametrize("terms", [0, 256])
def test_kmeans_agrees_with_sparks_own(spark, monkeypatch, terms):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    monkeypatch.setattr(multivariate, "EXPRESSION_TERMS", terms)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 1, (60, 3)) for m in (0, 4, 9)])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(3).cache()
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    theirs = KMeans(k=3, seed=0, maxIter=300, tol=1e-4).fit(vectors)
    centers = np.array(KMeans(k=3, seed=0, maxIter=0).fit(vectors).clusterCenters())
    moved, _ = multivariate._moved(df, centers, 300, 1e-4)
    assert np.allclose(moved, theirs.clusterCenters())
    clusters = multivariate._assigned(df, moved).collect()
    assert {r["cluster"]: r["n"] for r in clusters} == dict(enumerate(theirs.summary.clusterSizes))
    assert multivariate._silhouette(df, moved, clusters, len(x)) == pytest.approx(ClusteringEvaluator().evaluate(theirs.transform(vectors)))
