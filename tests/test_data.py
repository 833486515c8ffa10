"""Profiles, quality rules, cleaning, files, versions and the composed chains."""

import json
import math
import os
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statweave import registry
from statweave.autopilot import autopilot
from statweave.operators import assumptions, charts, cleaning, profile, quality, recommend, validate
from statweave.sources import files, sinks
from statweave.sources.store import VersionStore


@pytest.fixture(scope="module")
def dirty(spark):
    rows = [
        (i, ["Urban", "Rural"][i % 2], float(i % 13) + 1, f"2024-01-{i % 28 + 1:02d}", "x", i * 2)
        for i in range(40)
    ]
    rows[3] = (3, "urban", None, "2024-02-30", "x", 6)
    rows[4] = (4, "Urban ", -5.0, "2090-01-01", "x", 8)
    rows[5] = (5, "Rurals", 500.0, "2024-01-05", "x", 10)
    rows.append(rows[7])
    return spark.createDataFrame(rows, "code int, place string, price double, day string, k string, twice int").withColumn("copy", F.col("twice")).persist()


def test_roles(spark):
    pdf = pd.DataFrame({"i": range(60), "b": [0, 1] * 30, "yes": ["Yes", "no"] * 30, "d": ["2024-01-01"] * 60, "c": list("abc") * 20, "t": [f"w{i}" for i in range(60)]})
    df = spark.createDataFrame(pdf).withColumn("empty", F.lit(None).cast("string")).withColumn("ts", F.current_timestamp())
    assert profile.column_roles(df) == {"i": "numeric", "b": "boolean", "yes": "boolean", "d": "datetime", "c": "categorical", "t": "text", "empty": "empty", "ts": "datetime"}


def test_quality_finds_planted_defects(dirty):
    issues = quality.assess_quality(dirty, datetime(2025, 1, 1))
    found = {(r["kind"], r["location"]): r for r in issues.collect()}
    assert found[("missing_values", "price")]["n"] == 1
    assert found[("duplicate_rows", None)]["n"] == 1
    assert ("duplicate_columns", "twice / copy") in found and ("duplicate_columns", "code / twice") not in found
    assert ("constant_variable", "k") in found
    assert found[("impossible_values", "price")]["examples"] == ["-5.0"]
    assert "500.0" in found[("outliers", "price")]["examples"]
    assert ("extreme_values", "price") in found
    assert found[("invalid_dates", "day")]["n"] == 1 and found[("impossible_values", "day")]["n"] == 1
    kinds = [r["severity"] for r in issues.where("kind = 'inconsistent_categories'").orderBy("seq").collect()]
    assert kinds == ["low", "medium"]
    assert any("Rural" in e for e in found[("potential_data_entry_errors", "place")]["examples"])
    ops = [r["operation"] for r in quality.propose_cleaning(issues).collect()]
    assert ops[0] == "impute" and len(ops) == len(set(map(str, quality.propose_cleaning(issues).drop("seq", "from_issue").collect())))
    summary = quality.quality_summary(issues).first()
    assert summary["total"] == issues.count() and 0 <= summary["score"] <= 100


def test_duplicate_rows_compare_nulls_and_nans(spark):
    df = spark.createDataFrame([(None, math.nan), (None, math.nan), ("a", 1.0), ("a", 2.0)], "s string, v double")
    assert profile.duplicate_count(df) == 1


def test_quality_score_formula(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x")] * 10, "a int, b string")
    assert profile.quality_score(df) == pytest.approx(100 - 20 - 3)


def test_imputers(spark, tiny_limits):
    v = [None, 2.0, None, None, 8.0, None, 3.0, None]
    df = spark.createDataFrame([(i, x, float(i)) for i, x in enumerate(v)], "i int, v double, u double").repartition(3)

    def run(method, **kw):
        out = cleaning.apply_operation(df, {"operation": "impute", "column": "v", "method": method, "order_by": "i", **kw})[0]
        return [r["v"] for r in out.orderBy("i").collect()]

    assert run("ffill") == [None, 2.0, 2.0, 2.0, 8.0, 8.0, 3.0, 3.0]
    assert run("bfill") == [2.0, 2.0, 8.0, 8.0, 8.0, 3.0, 3.0, None]
    assert run("interpolate") == pytest.approx([None, 2.0, 4.0, 6.0, 8.0, 5.5, 3.0, 3.0])
    assert run("median")[0] == 3.0 and run("mode")[0] == 2.0 and run("constant", value=0)[0] == 0.0
    assert run("mean")[0] == pytest.approx(13 / 3)
    with pytest.raises(ValueError, match="Unknown imputation"):
        run("magic")


def test_knn_equals_brute_force(spark, tiny_limits):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"a": rng.normal(size=40), "b": rng.normal(size=40), "v": rng.normal(size=40)})
    pdf.loc[[2, 9, 17, 33, 39], "v"] = np.nan
    pdf.loc[[4, 9], "a"] = np.nan
    df = spark.createDataFrame(pdf.assign(_row_id=range(40)))
    out = cleaning.apply_operation(df, {"operation": "impute", "column": "v", "method": "knn", "k": 3})[0].toPandas().set_index("_row_id")["v"]
    for i in pdf.index[pdf.v.isna()]:
        donors = []
        for j in pdf.index[pdf.v.notna()]:
            gap = pdf.loc[i, ["a", "b"]] - pdf.loc[j, ["a", "b"]]
            if gap.notna().any():
                donors.append(((gap.dropna() ** 2).sum() * 3 / gap.notna().sum(), j))
        assert out[i] == pytest.approx(pdf.v[[j for _, j in sorted(donors)[:3]]].mean())


def test_iterative_recovers_a_linear_column(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=80), rng.normal(size=80)
    pdf = pd.DataFrame({"a": a, "b": b, "v": 2 * a - b + 1})
    truth = pdf.copy()
    pdf.loc[::9, "v"] = np.nan
    pdf.loc[4::11, "a"] = np.nan
    df = spark.createDataFrame(pdf.assign(_row_id=range(80)))
    out = cleaning.apply_operation(df, {"operation": "impute", "column": "v", "method": "iterative"})[0].toPandas().set_index("_row_id")["v"]
    only = pdf.v.isna() & pdf.a.notna()
    assert np.allclose(out[only], truth.v[only], atol=0.25)


def test_transforms_and_encodings(spark):
    df = spark.createDataFrame([(1, -1.0, "b"), (2, 4.0, "a"), (3, None, None), (4, 9.0, "b")], "i int, v double, s string")
    ops = [
        {"operation": "transform", "column": "v", "method": "log"},
        {"operation": "transform", "column": "v", "method": "sqrt"},
        {"operation": "encode", "column": "s", "method": "label", "order_by": "i"},
        {"operation": "encode", "column": "s"},
        {"operation": "rename", "column": "i", "new_name": "key"},
    ]
    out, notes = cleaning.apply_operations(df, ops)
    rows = out.orderBy("key").collect()
    assert [r["v_log"] for r in rows] == [None, math.log(4), None, math.log(9)]
    assert [r["v_sqrt"] for r in rows] == [0.0, 2.0, None, 3.0]
    assert [r["s_code"] for r in rows] == [0, 1, None, 0]
    assert [(r["s_a"], r["s_b"]) for r in rows] == [(False, True), (True, False), (False, False), (False, True)]
    assert len(notes) == len(ops)
    with pytest.raises(ValueError, match="Unknown cleaning"):
        cleaning.apply_operation(df, {"operation": "shuffle"})


def test_files(spark, folder):
    with open(f"{folder}/a.csv", "w", encoding="latin-1") as f:
        f.write('id,name,v,ok\n1,"Ren\xe9, A",1.5,True\n2,NA,n/a,False\n3,x,2,True\n')
    rows = files.read_any(spark, f"{folder}/a.csv")
    assert rows.dtypes == [("id", "bigint"), ("name", "string"), ("v", "double"), ("ok", "boolean")]
    assert [r["name"] for r in rows.orderBy("id").collect()] == ["René, A", None, "x"]
    for name, text in {"list": '[{"a":1,"b":"x"},\n{"a":2,"b":"y"}]', "data": '{"data":[{"a":1,"b":"x"},{"a":2,"b":"y"}]}', "lines": '{"a":1,"b":"x"}\n{"a":2,"b":"y"}\n'}.items():
        with open(f"{folder}/{name}.json", "w") as f:
            f.write(text)
        assert sorted(map(tuple, files.read_any(spark, f"{folder}/{name}.json").select("a", "b").collect())) == [(1, "x"), (2, "y")]
    with open(f"{folder}/one.json", "w") as f:
        f.write('{"a":1,"b":{"c":2}}')
    assert files.read_json(spark, f"{folder}/one.json").columns == ["a", "b.c"]
    with pytest.raises(ValueError, match="query or table"):
        files.read_sql(spark, "jdbc:none:")
    merged = files.merge_frames([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("x", 2.5)], "a string, b double")])
    assert sorted(merged.collect(), key=str) == [("1", None), ("x", 2.5)]


def test_version_store(spark, folder, dirty):
    store = VersionStore(spark, folder)
    assert store.ingest("d", dirty) == 1
    assert dict(store.load("d").dtypes)["day"].startswith("timestamp")
    version, notes = store.clean("d", [{"operation": "drop_duplicates"}, {"operation": "strip", "column": "place"}])
    assert version == 2 and store.load("d").count() == 40 and len(notes) == 2
    assert store.undo("d") == 1 and store.current("d") == 1
    with pytest.raises(ValueError, match="is the first of"):
        store.undo("d")
    assert store.clean("d", [{"operation": "drop_columns", "columns": ["k"]}])[0] == 3
    assert store.load("d", 2).count() == 40
    assert store.undo("d") == 1  # the version that 3 was made from, not the abandoned 2
    assert store.restore("d", 2) == 2
    history = store.history("d")
    assert [r["version"] for r in history["versions"].collect()] == [1, 2, 3]
    assert [r["operation"] for r in history["transformations"].collect()] == ["drop_duplicates", "strip", "drop_columns"]
    done = registry.analyze(store.load("d"), "independent_t", {"y": "price", "x": "place", "levels": ["urban", "rural"]}, store=store, dataset="d")
    assert store.reproduce(done.run_id)[1]
    assert [r["run_id"] for r in store.list_runs("d").collect()] == [done.run_id]
    assert sinks.preview(store.load("d"), 5, 3).count() == 3
    assert "statistics" in sinks.write_result(done.result, "json", f"{folder}/out", done.checks)
    store.drop("d")
    with pytest.raises(FileNotFoundError):
        store.load("d")


def test_writers_at_once_get_versions_of_their_own(spark, folder):
    store = VersionStore(spark, folder)
    store.write("d", spark.range(3), "first")
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda n: VersionStore(spark, folder).write("d", spark.range(n), f"{n} rows"), range(10, 18)))
    assert sorted(got) == list(range(2, 10))
    assert {store.load("d", v).count() for v in got} == set(range(10, 18))
    log = store.log("d").toPandas().sort_values("seq")
    assert list(log["seq"]) == list(range(1, 10))
    # Each version names the one that was current when it was made, so undo walks back through all of them.
    assert list(log["version_from"].iloc[1:]) == list(log["version_to"].iloc[:-1])


def test_a_lost_race_is_run_again_on_the_new_log(spark, folder):
    store, other = VersionStore(spark, folder), VersionStore(spark, folder)
    store.write("d", spark.range(1))
    asked = []

    def events():
        seen = store.log("d").count()
        asked.append(seen)
        if len(asked) == 1:
            other.write("d", spark.range(2))
        return [{"event": "note", "current": seen}]

    assert [(r["seq"], r["current"]) for r in store._record("d", events)] == [(3, 2)]
    assert asked == [1, 2] and store.log("d").count() == 3
    assert not store._publish(f"{folder}/d/log/{1:019d}.json", "{}") and store.log("d").where("seq = 1").count() == 1
    assert not [f for f in os.listdir(f"{folder}/d/log") if f.startswith(".") and not f.endswith(".crc")]


def test_notes_count_the_rows_of_every_step_in_one_job(spark, folder):
    rows = spark.createDataFrame([(i % 20, float(i % 20) if i % 20 else None, f" n{i % 3} ") for i in range(40)], "k int, v double, s string")
    rows.write.parquet(f"{folder}/rows")
    ops = [
        {"operation": "strip", "column": "s"},
        {"operation": "drop_rows_missing", "columns": ["v"]},
        {"operation": "filter", "query": "k < 10"},
        {"operation": "rename", "column": "v", "new_name": "w"},
    ]
    df, tell = cleaning.observed_operations(spark.read.parquet(f"{folder}/rows"), ops)
    spark.sparkContext.setJobGroup("notes", "")
    try:
        df.write.parquet(f"{folder}/out")
        notes = tell()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("notes")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1
    assert [n[n.index("(") :] for n in notes] == ["(40 rows, 0 fewer)", "(38 rows, 2 fewer)", "(18 rows, 20 fewer)", "(18 rows, 0 fewer)"]


def test_notes_of_all_operations_have_counts(spark, folder, dirty):
    store = VersionStore(spark, folder)
    store.ingest("d", dirty)
    ops = [
        {"operation": "drop_duplicates"},
        {"operation": "normalize_case", "column": "place", "case": "lower"},
        {"operation": "impute", "column": "price", "method": "median"},
        {"operation": "winsorize", "column": "price"},
        {"operation": "clip_nonnegative", "column": "price"},
        {"operation": "impute_all"},
        {"operation": "encode", "column": "place", "method": "label"},
        {"operation": "transform", "column": "twice", "method": "zscore"},
        {"operation": "drop_columns", "columns": ["k"]},
    ]
    version, notes = store.clean("d", ops)
    assert version == 2 and len(notes) == len(ops)
    assert notes[0] == "Repeated rows taken out (40 rows, 1 fewer)" and all(n.endswith("(40 rows, 0 fewer)") for n in notes[1:])


def test_checks_and_flags(spark):
    rng = np.random.default_rng(1)
    rows = [("s1", "a", float(v)) for v in rng.normal(0, 1, 12)] + [("s1", "b", float(v)) for v in rng.exponential(9, 12)]
    df = spark.createDataFrame(rows, "s string, g string, y double")
    done = registry.analyze(df, "independent_t", {"y": "y", "group": "g"}, ["s"])
    status = {r["check"]: r["status"] for r in done.checks.collect()}
    assert status["Homogeneity of variance (Levene)"] == "fail" and status["Independence of observations"] == "assumed"
    codes = {r["code"] for r in done.flags.collect()}
    assert {"assumptions_failed", "method_note"} <= codes and "small_n" not in codes
    bad = spark.createDataFrame([("pearson", 10, 1.5, None, None, 2.0, 1.0, None, None, None, None)], "method string, n long, p_value double, t double, df double, ci95_low double, ci95_high double, effect_name string, effect_value double, effect_magnitude string, warnings array<string>")
    flags = validate.validate_results(bad)
    assert {"invalid_p", "invalid_ci", "small_n", "not_causation"} == {r["code"] for r in flags.collect()}
    assert validate.validation_summary(bad, flags).first()["ok"] is False
    none = assumptions.check_assumptions(df, "kmeans", {}).collect()
    assert [r["check"] for r in none] == ["Method-specific assumptions"]


def test_recommendations(spark):
    rng = np.random.default_rng(1)
    n = 60
    pdf = pd.DataFrame({"num": rng.normal(size=n), "skew": rng.exponential(1, n) ** 3, "two": ["a", "b"] * 30, "three": list("xyz") * 20, "event": rng.integers(0, 2, n), "few": ["p"] * 57 + ["q"] * 3, "three2": ["m"] * 20 + ["n"] * 20 + ["M "] * 20})
    df = spark.createDataFrame(pdf)
    pairs = [{"y": "num", "x": "two"}, {"y": "num", "x": "three"}, {"y": "skew", "x": "num"}, {"y": "two", "x": "few"}, {"y": "two", "x": "three"}, {"y": "num", "x": "two", "intent": "survival"}, {"intent": "structure"}, {"y": "skew", "x": "few"}, {"y": "num", "x": "three2"}, {"y": "num", "x": "skew", "intent": "difference", "paired": True}]
    got = recommend.recommend_tests(df, pairs).collect()
    assert [r["method"] for r in got] == ["independent_t", "oneway_anova", "spearman", "fisher_exact", "chi_square", "logrank", "pca", "mannwhitney", "independent_t", "paired_t"]
    assert json.loads(got[5]["params"])["event"] == "event" and "inconsistent" in got[8]["warnings"][0]


def test_registry_and_autopilot(spark):
    assert len(registry.REGISTRY) == 54
    with pytest.raises(ValueError, match="Unknown method"):
        registry.run_method(spark.range(3), "nothing")
    with pytest.raises(ValueError, match="needs"):
        registry.run_method(spark.range(3), "pearson", {"x": "id"})
    df = spark.createDataFrame([(float(i), "ab"[i % 2], "z") for i in range(40)], "v double, g string, k string")
    report = autopilot(df, [{"y": "v", "x": "g"}, {"y": "g", "x": "k"}], charts=1)
    status = {s.key: s.status for s in report.steps}
    assert status["analysis:independent_t(v, g)"] == "done" and status["cleaning_proposal"] == "awaiting_approval"
    assert "error" in status.values()  # a one-level factor cannot be tested, and the chain goes on


def test_chart_data(spark):
    pdf = pd.DataFrame({"v": np.arange(101, dtype=float), "g": ["a"] * 50 + ["b"] * 51})
    df = spark.createDataFrame(pdf)
    bins = charts.histogram_bins(df, "v", 10).orderBy("bin").collect()
    assert [b["count"] for b in bins] == [10] * 9 + [11]
    density = charts.violin_density(df, "v", "g").toPandas()
    for _, part in density.groupby("group"):
        assert np.trapezoid(part.sort_values("value")["density"], part.sort_values("value")["value"]) == pytest.approx(1.0, abs=0.05)
    assert charts.qq_points(df, "v")["line"].first()["r"] > 0.9
    assert charts.recommend_chart({"a": "numeric", "b": "datetime"}, "b", "a") == "line"
