"""Shared column semantics on edge values."""

import math

from pyspark.sql import functions as F

from statweave.functions.columns import is_missing, norm_label, num, p_format, sig_label, title_case, to_timestamp_any


def test_num_coerces_and_never_throws(spark):
    df = spark.createDataFrame([("1",), (" 12 ",), ("1,000",), ("x",), ("",), ("nan",), ("1d",), ("-2.5e1",), (None,)], "v string")
    assert [r[0] for r in df.select(num(df, "v")).collect()] == [1.0, 12.0, None, None, None, None, None, -25.0, None]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(math.nan,), (1.0,), (None,)], "v double")
    assert [r[0] for r in df.select(num(df, "v")).collect()] == [None, 1.0, None]
    assert [r[0] for r in df.select(is_missing(df, "v")).collect()] == [True, False, True]


def test_title_case_matches_python(spark):
    words = ["urban", "URBAN", "new-york o'neil", "a1b c", "3rd place", "x_y", "éTÉ", "two  spaces"]
    df = spark.createDataFrame([(w,) for w in words], "v string")
    assert [r[0] for r in df.select(title_case(F.col("v"))).collect()] == [w.title() for w in words]


def test_labels_lose_outer_space_and_case(spark):
    df = spark.createDataFrame([("Urban ",), ("urban",), ("\tURBAN\n",)], "v string")
    assert {r[0] for r in df.select(norm_label(F.col("v"))).collect()} == {"Urban"}


def test_dates(spark):
    df = spark.createDataFrame([("2024-01-02",), ("2024-01-02T03:04:05",), ("1/2/2024",), ("5",), ("bad",), ("20240102",)], "v string")
    got = [None if r[0] is None else r[0].date().isoformat() for r in df.select(to_timestamp_any(df, "v")).collect()]
    assert got == ["2024-01-02", "2024-01-02", "2024-01-02", None, None, "2024-01-02"]


def test_p_value_texts(spark):
    df = spark.createDataFrame([(0.00001234,), (0.004,), (0.2,), (None,)], "p double")
    assert [r[0] for r in df.select(p_format(F.col("p"))).collect()] == ["1.23e-05", "0.0040", "0.2000", "n/a"]
    assert df.select(sig_label(F.col("p"))).first()[0].startswith("highly")
