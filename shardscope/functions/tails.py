"""Upper tail probabilities of the chi-square and F distributions, for small result tables."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEPS = 500

# The functions travel with the task, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def gamma_tail(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x): power series for small x, continued fraction else.

    All values go through each step together.
    """
    a, x = (v.astype(float).ravel() for v in np.broadcast_arrays(a, x))
    out = np.where(np.isnan(x) | np.isnan(a), np.nan, np.where(x > 0, 0.0, 1.0))
    open_ = (x > 0) & (x < np.inf) & ~np.isnan(a)
    logs = np.array([math.lgamma(s) for s in np.unique(a[open_])])[np.searchsorted(np.unique(a[open_]), a[open_])]
    front = np.zeros(len(a))
    front[open_] = np.exp(a[open_] * np.log(x[open_]) - x[open_] - logs)
    low = np.flatnonzero(open_ & (x < a + 1))
    term = total = 1.0 / a[low]
    k = a[low]
    while len(low) and (term > total * 1e-17).any():
        k = k + 1
        term = term * x[low] / k
        total = total + term
    out[low] = 1.0 - front[low] * total
    high = np.flatnonzero(open_ & (x >= a + 1))
    s, v, fraction = a[high], x[high], np.zeros(len(high))
    for k in range(STEPS, 0, -1):
        fraction = k * (k - s) / (v - s + 1 + 2 * k - fraction)
    out[high] = front[high] / (v - s + 1 - fraction)
    return np.clip(out, 0.0, 1.0)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated from its far end."""
    value = 1.0
    for m in range(STEPS, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1.0 + even / (1.0 + odd / value)
    value = 1.0 - (a + b) * x / (a + 1) / value
    return 1.0 / value


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if math.isnan(x) or math.isnan(a) or math.isnan(b):
        return math.nan
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    front = math.exp(log_front) if log_front > -745 else 0.0
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def chi2_tail(statistic: pd.Series, df: pd.Series) -> pd.Series:
    tail = gamma_tail(df.to_numpy(float) / 2.0, statistic.to_numpy(float) / 2.0)
    return pd.Series(np.where(statistic.isna(), np.nan, tail))


@F.pandas_udf(T.DoubleType())
def f_tail(statistic: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    rows = zip(statistic.astype(float), df1.astype(float), df2.astype(float))
    return pd.Series(
        [
            (math.nan if math.isnan(f) else 0.0) if not math.isfinite(f) else beta_share(b / 2, a / 2, b / (b + a * f))
            for f, a, b in rows
        ]
    )
