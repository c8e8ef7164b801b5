"""Exact one-sided binomial bounds, without a statistics library."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def log_pmf(upto: int, n: int, p: float) -> np.ndarray:
    """log P(X = i) for i = 0..upto, by prefix sums of ratios."""
    i = np.arange(1, upto + 1, dtype=np.float64)
    return n * np.log1p(-p) + np.concatenate([[0.0], np.cumsum(np.log((n - i + 1) / i) + np.log(p) - np.log1p(-p))])


def cdf(errors: int, n: int, p: float) -> float:
    return float(min(1.0, np.exp(log_pmf(errors, n, p)).sum()))


@lru_cache(maxsize=4096)
def binomial_upper(errors: int, n: int, confidence: float = 0.95) -> float:
    """The rate at which `errors` or fewer of n have probability 1 - confidence: the Clopper-Pearson upper bound."""
    if not (0 <= errors <= n and n > 0 and 0.0 < confidence < 1.0):
        raise ValueError(f"no bound for {errors} of {n} trials at confidence {confidence}")
    low, high = errors / n, 1.0  # with n errors nothing is left to search
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if cdf(errors, n, mid) > 1 - confidence:
            low = mid
        else:
            high = mid
    return high


@lru_cache(maxsize=4096)
def allowed_errors(n: int, target: float, confidence: float = 0.95) -> tuple[int, bool]:
    """The largest count whose bound is at most target, and whether there is one (else 0)."""
    if n <= 0:
        return 0, False
    upto = min(n - 1, int(n * target) + 1)
    ok = np.flatnonzero(np.cumsum(np.exp(log_pmf(upto, n, target))) <= 1 - confidence)
    return (int(ok[-1]), True) if len(ok) else (0, False)


def upper(errors: Column, n: Column, confidence: float = 0.95) -> Column:
    """binomial_upper on a column; null where n is 0. Meant for aggregated rows, which are few."""

    @F.pandas_udf("double")
    def run(e: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else binomial_upper(int(a), int(b), confidence) for a, b in zip(e, m, strict=True)], dtype="float64")

    return run(errors, n)


def allowed(n: Column, target: Column, confidence: float = 0.95) -> Column:
    """allowed_errors on columns, as a struct (k, certified)."""

    @F.pandas_udf("k long, certified boolean")
    def run(m: pd.Series, t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([allowed_errors(int(a), float(b), confidence) for a, b in zip(m, t, strict=True)], columns=["k", "certified"])

    return run(n, target)
