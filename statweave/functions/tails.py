"""The distribution functions as columns: one value per result row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statweave.functions import dist


def result_column(fn: Callable[..., float]):
    """Column function from a scalar one; NULL in, NULL out."""

    def run(*cols: pd.Series) -> pd.Series:
        out = []
        for values in zip(*cols):
            if any(v is None or v != v for v in values):
                out.append(None)
            else:
                r = fn(*(float(v) for v in values))
                out.append(None if r != r else r)
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(run, T.DoubleType())


def _array_column(fn: Callable[..., np.ndarray]):
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series(fn(*[values.to_numpy(dtype=float) for values in cols]))

    return F.pandas_udf(run, T.DoubleType())


t_p = result_column(dist.t_p)
t_crit95 = result_column(dist.t_crit95)
norm_p = result_column(dist.norm_p)
chi2_sf = result_column(dist.chi2_sf)
f_sf = result_column(dist.f_sf)
mannwhitney_p = result_column(dist.mannwhitney_p)
wilcoxon_p = result_column(dist.wilcoxon_p)
kendall_p = result_column(dist.kendall_p)
fisher_p = result_column(dist.fisher_p)
kolmogorov_sf = result_column(dist.kolmogorov_sf)
t_power = result_column(dist.t_power)
t_sample_size = result_column(dist.t_sample_size)

norm_cdf = _array_column(dist.norm_cdf_array)
norm_logcdf = _array_column(dist.norm_logcdf_array)
norm_ppf = _array_column(dist.norm_ppf_array)
shapiro_scores = _array_column(dist.shapiro_scores)
