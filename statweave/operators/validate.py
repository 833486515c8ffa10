"""Rule checks over a table of results (one row per method and segment)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statweave.functions.tails import t_p
from statweave.plans.tables import null_safe
from statweave.result import StatResult

FAIL_MATTERS = ("independent_t", "oneway_anova", "paired_t", "pearson", "linear_regression")
ASSOCIATION = ("pearson", "spearman", "kendall", "chi_square")
MANY_TESTS = ("correlation_matrix", "tukey_hsd")
FIELDS = {
    "n": "long", "p_value": "double", "t": "double", "df": "double", "ci95_low": "double", "ci95_high": "double",
    "effect_name": "string", "effect_value": "double", "effect_magnitude": "string", "warnings": "array<string>",
}


def results_table(result: StatResult) -> DataFrame:
    """A result's statistics in the common layout used by :func:`validate_results`."""
    stats = result.statistics
    if "p_value" not in stats.columns and "f_pvalue" in stats.columns:
        stats = stats.withColumn("p_value", F.col("f_pvalue"))
    cols = [F.col(c).cast(t).alias(c) if c in stats.columns else F.lit(None).cast(t).alias(c) for c, t in FIELDS.items()]
    return stats.select(*result.by, F.lit(result.method).alias("method"), *cols)


def _flag(condition: Column, level: str, code: str, message: Column | str, detail: Column | None = None) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    empty = F.lit(None).cast("string") if detail is None else detail
    return F.when(condition, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), text.alias("message"), empty.alias("detail")))


def validate_results(results: DataFrame, checks: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Flags per result: by..., method, level, code, message, detail."""
    by = list(by)
    keys = [*by, "method"]
    staged = results
    if checks is not None:
        failed = checks.where("status = 'fail'").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("check")), "; ").alias("_failed"))
        staged = null_safe(results, failed, keys, "left")
    else:
        staged = results.withColumn("_failed", F.lit(None).cast("string"))
    m, p, n = F.col("method"), F.col("p_value"), F.col("n")
    low, high = F.col("ci95_low"), F.col("ci95_high")
    value = F.abs("effect_value")
    is_d = F.col("effect_name").isin("Cohen's d", "cohens_d", "Cohen's d (paired)")
    by_d = F.when(value < 0.3, "small").when(F.col("effect_name") == "Cohen's d (paired)", None)
    magnitude = F.when(is_d & by_d.isNotNull(), by_d).otherwise(F.col("effect_magnitude"))
    # The t p-value is recomputed from t and its degrees of freedom.
    again = t_p(F.when(m == "independent_t", F.col("t")), F.col("df"))
    staged = staged.withColumn("_again", again)
    significant = p < 0.05
    flags = F.array(
        _flag(F.col("_failed").isNotNull() & m.isin(*FAIL_MATTERS), "warning", "assumptions_failed", "A checked assumption failed for this method.", F.col("_failed")),
        _flag((n < 20) & ~m.isin("descriptive", "frequency"), "warning", "small_n", "Fewer than 20 rows.", F.concat(F.lit("n = "), n.cast("string"))),
        _flag(significant & magnitude.isin("small", "negligible"), "warning", "sig_small_effect", "Significant, yet the effect is small."),
        _flag(significant, "info", "significance_not_importance", "Significance is not importance."),
        _flag(m.isin(*ASSOCIATION), "info", "not_causation", "Association is not cause."),
        _flag(m.isin(*MANY_TESTS), "warning", "multiple_testing", "Several tests at once; adjust the p-values."),
        _flag((m == "independent_t") & (F.abs(F.col("_again") - p) > 1e-4), "warning", "inconsistent_p", "The p-value does not follow from t and its degrees of freedom.", F.concat(F.lit("reported p="), p.cast("string"), F.lit(", recomputed="), F.col("_again").cast("string"))),
        _flag((p < 0) | (p > 1), "error", "invalid_p", "The p-value is not a probability."),
        _flag(low > high, "error", "invalid_ci", "The lower bound exceeds the upper one."),
    )
    notes = F.transform(
        F.coalesce(F.col("warnings"), F.array().cast("array<string>")),
        lambda w: F.struct(F.lit("warning").alias("level"), F.lit("method_note").alias("code"), w.alias("message"), F.lit(None).cast("string").alias("detail")),
    )
    return staged.select(*keys, F.inline(F.concat(F.array_compact(flags), notes)))


def validation_summary(results: DataFrame, flags: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ok (no error flag), p-value and n of every result."""
    keys = [*by, "method"]
    errors = flags.groupBy(*keys).agg(F.max((F.col("level") == "error").cast("int")).alias("_e"), F.count(F.lit(1)).alias("n_flags"))
    joined = null_safe(results, errors, keys, "left")
    return joined.select(*keys, (F.coalesce("_e", F.lit(0)) == 0).alias("ok"), F.coalesce("n_flags", F.lit(0)).alias("n_flags"), "p_value", "n")


