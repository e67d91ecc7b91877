"""Quantiles of counts: vectorised Python over Arrow batches, as no built-in has them.

Small means are walked along their distribution. Where its first term would underflow the quantile is found by
bisection of the distribution function, a continued fraction of the incomplete gamma or beta function, so that
no mean is too large and no walk is cut short.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

import wardline.sources.scratch  # noqa: F401  (functions travel whole)

#: Beyond this dispersion the distribution is Poisson's, and up to this mean it is walked.
POISSON_FROM, WALK_UPTO = 1_000_000.0, 600.0


def _fraction(term: Callable[[int], tuple[float, float]], first: float) -> float:
    """first + a1 / (b1 + a2 / (b2 + ...)) for terms (a, b), by the ratios of its convergents."""
    tiny = 1e-300
    value = first or tiny
    up, down = value, 0.0
    for k in range(1, 1_000_000):
        a, b = term(k)
        down = 1 / ((b + a * down) or tiny)
        up = (b + a / up) or tiny
        value *= up * down
        if abs(up * down - 1) < 1e-16:
            break
    return value


def poisson_share(k: int, mean: float) -> float:
    """The share of counts up to k."""
    a = k + 1.0
    scale = math.exp(a * math.log(mean) - mean - math.lgamma(a))
    if mean < a + 1:
        # A series for the upper part: mean**n over rising factors.
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= mean / n
            total += term
        return 1 - scale * total
    return scale / _fraction(lambda i: (-i * (i - a), mean + 2 * i + 1 - a), mean + 1 - a)


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a

    def term(i: int) -> tuple[float, float]:
        m, odd = divmod(i, 2)
        over = -(a + m) * (a + b + m) if odd else m * (b - m)
        return over * x / ((a + 2 * m) * (a + 2 * m + 1) if odd else (a + 2 * m - 1) * (a + 2 * m)), 1.0

    return scale / _fraction(term, 1.0)


def count_quantile(mean: float, r: float, q: float) -> int:
    """The least k whose cumulative share is q: negative binomial with dispersion r, Poisson where r is infinite."""
    if not mean > 0:
        return 0
    poisson = not math.isfinite(r) or r > POISSON_FROM
    if mean <= WALK_UPTO:
        p = math.exp(-mean) if poisson else (r / (r + mean)) ** r
        total, k, failure = p, 0, 0.0 if poisson else mean / (r + mean)
        while total < q:
            p *= mean / (k + 1) if poisson else (k + r) / (k + 1) * failure
            if total + p == total and k > mean:
                break  # what is left of the tail is lost in the sum's last digit
            k += 1
            total += p
        return k
    share = (lambda k: poisson_share(k, mean)) if poisson else (lambda k: beta_share(r / (r + mean), r, k + 1.0))
    low, high = -1, math.ceil(mean)
    while share(high) < q:
        low, high = high, high * 2
    while high - low > 1:
        k = (low + high) // 2
        low, high = (low, k) if share(k) >= q else (k, high)
    return high


def control_limit(mean: Column, dispersion: Column, q: float = 0.99) -> Column:
    """The quantile of each row; a null dispersion is infinite. Equal rows of a batch are worked out once."""

    @F.pandas_udf("long")
    def limit(m: pd.Series, d: pd.Series) -> pd.Series:
        both = np.stack([m.to_numpy(float), d.fillna(math.inf).to_numpy(float)], axis=1)
        some, back = np.unique(both, axis=0, return_inverse=True)
        found = np.array([count_quantile(a, r, q) for a, r in some.tolist()], np.int64)
        return pd.Series(found[back.reshape(-1)] if len(found) else found)

    return limit(mean, dispersion)
