"""A cross-section of the catalog against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "independent_t", "mannwhitney", "friedman", "twoway_anova", "ancova", "descriptive", "frequency", "spearman", "kendall", "fisher_exact",
    "regression_diagnostics", "poisson_regression_fit", "anderson_darling", "moving_average", "manova", "kaplan_meier", "logrank", "quality_issues",
    "impute_interpolate", "histogram_bins", "validate_results", "read_csv",
]


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize(
    "name, limits", [(n, "usual") for n in NAMES] + [(n, "tiny") for n in ("mannwhitney", "descriptive", "kendall", "kaplan_meier", "impute_interpolate")]
)
def test_agrees_with_sql(spark, name, limits, request):
    if limits == "tiny":
        request.getfixturevalue("tiny_limits")
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"create view {file.split('.')[0]} as select * from '{FOLDER}/{file}'")
    df = contract.queries()[name](spark, FOLDER)
    found = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=str)
    answer = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    wanted = sorted((tuple(plain(r[i]) for i in order) for r in answer.fetchall()), key=str)
    assert found == wanted


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
