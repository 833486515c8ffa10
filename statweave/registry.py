"""Method registry: run any method by id, with checks, validation and a run record."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.operators import (
    anova,
    association,
    correlation,
    descriptive,
    hypothesis,
    multivariate,
    normality,
    regression,
    reliability,
    resampling,
    survival,
    timeseries,
)
from statweave.operators.assumptions import check_assumptions
from statweave.operators.validate import results_table, validate_results, validation_summary
from statweave.plans.tables import cut
from statweave.result import StatResult


@dataclass(frozen=True)
class Method:
    id: str
    fn: Callable[..., StatResult]
    family: str
    needs: tuple[str, ...]


REGISTRY: dict[str, Method] = {}

# Other names under which a parameter may be given, in order.
ALIASES = {
    "y": ("y", "column", "before", "group"),
    "x": ("x", "group", "predictors", "after", "columns"),
    "column": ("column", "y", "x"),
    "columns": ("columns", "measures", "items"),
    "dvs": ("dvs", "columns"),
    "group": ("group", "x"),
    "duration": ("duration", "y"),
    "factor1": ("factor1", "x"),
    "factor2": ("factor2", "group"),
    "d": ("d", "es"),
}


def register_method(id: str, fn: Callable[..., StatResult], needs: Sequence[str] = (), family: str = "Custom") -> None:
    """Add a method; ``fn(df, ..., by=())`` must return a :class:`StatResult`."""
    REGISTRY[id] = Method(id, fn, family, tuple(needs))


def _fill() -> None:
    table = {
        "Descriptive": [("descriptive", descriptive.descriptive, "columns?"), ("frequency", descriptive.frequency, "column")],
        "Normality": [
            ("shapiro_wilk", normality.shapiro_wilk, "column"),
            ("anderson_darling", normality.anderson_darling, "column"),
            ("kolmogorov_smirnov", normality.kolmogorov_smirnov, "column"),
        ],
        "Correlation": [
            ("pearson", correlation.pearson, "x y"),
            ("spearman", correlation.spearman, "x y"),
            ("kendall", correlation.kendall, "x y"),
            ("correlation_matrix", correlation.correlation_matrix, "columns?"),
        ],
        "Association": [
            ("chi_square", association.chi_square, "x y"),
            ("fisher_exact", association.fisher_exact, "x y"),
            ("cramers_v", association.cramers_v, "x y"),
        ],
        "Hypothesis testing": [
            ("one_sample_t", hypothesis.one_sample_t, "y mu?"),
            ("independent_t", hypothesis.independent_t, "y x"),
            ("paired_t", hypothesis.paired_t, "y x"),
            ("z_test", hypothesis.z_test, "y mu?"),
            ("mannwhitney", hypothesis.mannwhitney, "y x"),
            ("wilcoxon", hypothesis.wilcoxon, "y x"),
            ("kruskal", hypothesis.kruskal, "y x"),
            ("friedman", hypothesis.friedman, "columns"),
        ],
        "ANOVA": [
            ("oneway_anova", anova.oneway_anova, "y x"),
            ("twoway_anova", anova.twoway_anova, "y factor1 factor2"),
            ("repeated_anova", anova.repeated_anova, "columns"),
            ("ancova", anova.ancova, "y x covariate"),
            ("tukey_hsd", anova.tukey_hsd, "y x"),
        ],
        "Regression": [
            ("linear_regression", regression.linear_regression, "y x"),
            ("multiple_regression", regression.multiple_regression, "y x"),
            ("polynomial_regression", regression.polynomial_regression, "y x degree?"),
            ("logistic_regression", regression.logistic_regression, "y x"),
            ("poisson_regression", regression.poisson_regression, "y x"),
            ("negative_binomial", regression.negative_binomial, "y x"),
            ("robust_regression", regression.robust_regression, "y x"),
        ],
        "Time series": [
            ("trend_analysis", timeseries.trend_analysis, "y time?"),
            ("moving_average", timeseries.moving_average, "y window?"),
            ("acf_pacf", timeseries.acf_pacf, "y"),
            ("arima", timeseries.arima, "y"),
            ("sarima", timeseries.sarima, "y"),
            ("exp_smoothing", timeseries.exp_smoothing, "y"),
            ("seasonality", timeseries.seasonality, "y period?"),
        ],
        "Multivariate": [
            ("pca", multivariate.pca, "columns?"),
            ("factor_analysis", multivariate.factor_analysis, "columns?"),
            ("manova", multivariate.manova, "dvs group"),
            ("kmeans", multivariate.kmeans, "columns? k?"),
            ("lda", multivariate.lda, "y columns?"),
        ],
        "Nonparametric": [("bootstrap_ci", resampling.bootstrap_ci, "column"), ("permutation_test", resampling.permutation_test, "y x")],
        "Survival": [
            ("kaplan_meier", survival.kaplan_meier, "duration event"),
            ("logrank", survival.logrank, "duration event group"),
            ("cox_ph", survival.cox_ph, "duration event x"),
        ],
        "Reliability": [("cronbach_alpha", reliability.cronbach_alpha, "columns")],
        "Experimental": [
            ("effect_size", hypothesis.effect_size, "y x"),
            ("power_analysis", hypothesis.power_analysis, "d? n?"),
            ("sample_size", hypothesis.power_analysis, "d? power?"),
        ],
        "Assumptions": [("levene", hypothesis.levene, "y x")],
    }
    for family, methods in table.items():
        for id, fn, needs in methods:
            register_method(id, fn, needs.split(), family)


_fill()


def run_method(df: DataFrame, method: str, params: dict | None = None, by: Sequence[str] | None = None) -> StatResult:
    """Run a registered method; parameters may use any of their accepted names."""
    entry = REGISTRY.get(method)
    if entry is None:
        raise ValueError(f"Unknown method '{method}'.")
    params = {k: v for k, v in (params or {}).items() if v is not None}
    accepted = inspect.signature(entry.fn).parameters
    args = {}
    taken: set[str] = set()
    # Parameters given under their own name first, then under another one.
    for name in accepted:
        if name in params and name not in ("df", "by", "method" if method not in ("correlation_matrix",) else ""):
            args[name] = params[name]
            taken.add(name)
    for name, spec in accepted.items():
        if name in args or name not in ALIASES:
            continue
        other = next((a for a in ALIASES[name] if a in params and a not in taken), None)
        if other is not None:
            args[name] = params[other]
            taken.add(other)
        elif spec.default is inspect.Parameter.empty:
            raise ValueError(f"Method '{method}' needs '{name}'.")
    if by:
        if "by" not in accepted:
            raise ValueError(f"Method '{method}' does not run by segment.")
        args["by"] = list(by)
    return entry.fn(df, **args)


@dataclass
class Analysis:
    result: StatResult
    checks: DataFrame
    flags: DataFrame
    validation: DataFrame
    run_id: str | None = None


def analyze(df: DataFrame, method: str, params: dict | None = None, by: Sequence[str] = (), store=None, dataset: str | None = None, version: int | None = None) -> Analysis:
    """Assumption checks, the method, validation flags and (with a store) a run record."""
    by = list(by)
    if method not in REGISTRY:
        raise ValueError(f"Unknown method '{method}'.")
    checks = cut(check_assumptions(df, method, params, by))
    result = run_method(df, method, params, by)
    result.statistics = cut(result.statistics)
    results = results_table(result)
    flags = validate_results(results, checks, by)
    validation = validation_summary(results, flags, by)
    run_id = None
    if store is not None:
        current = store.current(dataset) if version is None else version
        run_id = store.record_run(dataset, current, method, params or {}, by, result.statistics, checks, validation)
    return Analysis(result, checks, flags, validation, run_id)
