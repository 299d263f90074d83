"""Ratios, intervals, set scores and resampling."""

from __future__ import annotations

from decimal import Context, Decimal, localcontext
from math import comb, factorial
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def fraction(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b rounded, null where b is 0."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)


def wilson(hits: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Wilson's score interval of a share, within 0 and 1; 0 and 0 of nothing."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    n = n.cast("double")
    p = F.try_divide(hits.cast("double"), n)
    scale = 1 + F.try_divide(F.lit(z * z), n)
    middle = p + F.try_divide(F.lit(z * z / 2), n)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n))
    zero = F.lit(0.0)
    some = lambda c: F.when(n > 0, c).otherwise(zero)
    return some(F.greatest(zero, F.try_divide(middle - half, scale))), some(F.least(F.lit(1.0), F.try_divide(middle + half, scale)))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def set_scores(predicted: Column, reference: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two sets; an empty one scores 1 against an empty one and else 0."""
    common = F.size(F.array_intersect(predicted, reference))
    p, r = F.size(F.array_distinct(predicted)), F.size(F.array_distinct(reference))
    precision = F.when(p == 0, (r == 0).cast("double")).otherwise(ratio(common, p))
    recall = F.when(r == 0, (p == 0).cast("double")).otherwise(ratio(common, r))
    return precision, recall, ratio(2 * precision * recall, precision + recall)


@F.pandas_udf(T.DoubleType())
def mcnemar(improved: pd.Series, worsened: pd.Series) -> pd.Series:
    """Two-sided exact p value of as unequal a division of the changed pairs."""

    return pd.Series([mcnemar_p(int(a), int(b)) for a, b in zip(improved, worsened, strict=True)])


def _log_factorial(n: int) -> Decimal:
    """ln n! to some 50 digits within the present context, by Stirling's series from 200 on."""
    if n < 200:
        return Decimal(factorial(n)).ln()
    x = Decimal(n)
    # Bernoulli numbers over 2i (2i - 1), from 1/6 on: at 200 the terms left out are under 1e-45
    series = sum(Decimal(a) / (b * 2 * i * (2 * i - 1) * x ** (2 * i - 1)) for i, (a, b) in enumerate(_BERNOULLI, 1))
    return x * x.ln() - x + (_TWO_PI * x).ln() / 2 + series


_BERNOULLI = ((1, 6), (-1, 30), (1, 42), (-1, 30), (5, 66), (-691, 2730), (7, 6), (-3617, 510), (43867, 798), (-174611, 330), (854513, 138), (-236364091, 2730))
_TWO_PI = Decimal("6.283185307179586476925286766559005768394338798750211641949889")


def mcnemar_p(a: int, b: int) -> float:
    """Twice the share of the smaller tail of n = a + b fair draws, at most 1: all of its terms that count in a double, however many draws there are.

    The largest term, that of k = min(a, b), comes from factorials' logarithms. The others are its multiples, summed downwards as whole numbers of 2 ** -120 until
    nothing is left: about the square root of n terms, not k, and none is a number of n bits. Up to 1,000 draws whole numbers do, also where the share is a tie between doubles.
    """
    n, k = a + b, min(a, b)
    if 2 * k >= n - 1:  # an even division, or as even as an odd number allows
        return 1.0
    if n <= 1000:
        return 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n
    with localcontext(Context(prec=60)):
        top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + (1 - n) * Decimal(2).ln()
        one = term = tail = 1 << 120
        for i in range(k, 0, -1):
            term = term * i // (n - i + 1)
            if not term:
                break
            tail += term
        log = top + (Decimal(tail) / one).ln()
        return float(log.exp()) if log > -800 else 0.0  # the least double is exp(-745)


def bootstrap_interval(values: np.ndarray, resamples: int, seed: int, level: float) -> tuple[float, float]:
    """Percentile interval of the mean; a single value is its own."""
    if len(values) == 1:
        return float(values[0]), float(values[0])
    rng = np.random.default_rng(seed)
    means = np.array([values[rng.integers(0, len(values), len(values))].mean() for _ in range(resamples)])
    low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return float(low), float(high)


def bootstrap_by(frame: DataFrame, key: str, value: str, order: str, resamples: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """key, n, mean, low, high: a bootstrap of each key's values, in the order of a column, within one task for a key.

    A key's values are paired differences, one a pair, so they are few; a key with more rows than fit a task belongs into poisson_bootstrap.
    """

    def one(part: pd.DataFrame) -> pd.DataFrame:
        values = part.sort_values(order)[value].to_numpy(float)
        low, high = bootstrap_interval(values, resamples, seed, level)
        return pd.DataFrame({key: [part[key].iloc[0]], "n": [len(values)], "mean": [values.mean()], "low": [low], "high": [high]})

    kind = frame.schema[key].dataType.simpleString()
    return frame.select(key, value, order).groupBy(key).applyInPandas(one, f"{key} {kind}, n long, mean double, low double, high double")


def poisson_bootstrap(frame: DataFrame, key: str, value: str, row_id: str, resamples: int = 200, seed: int = 42, level: float = 0.95) -> DataFrame:
    """As bootstrap_by for keys of any size: each row counts in each resample as often as a Poisson draw from its id says, and resamples are sums that combine before the shuffle."""
    draw = lambda i: F.pmod(F.xxhash64(F.lit(seed), i, F.col(row_id)), F.lit(1_000_000)) / 1e6
    steps, total, p = [], 0.0, float(np.exp(-1))
    for k in range(12):
        total += p
        steps.append(total)
        p /= k + 1
    times = F.transform(F.sequence(F.lit(1), F.lit(resamples)), lambda i: F.struct(i.alias("i"), sum((draw(i) >= s).cast("int") for s in steps).alias("times")))
    rows = frame.select(key, F.col(value).cast("double").alias("v"), F.explode(times).alias("t"))
    means = rows.groupBy(key, F.col("t.i").alias("i")).agg(F.try_divide(F.sum(F.col("v") * F.col("t.times")), F.sum("t.times")).alias("m"))
    ends = means.groupBy(key).agg(F.percentile("m", (1 - level) / 2).alias("low"), F.percentile("m", (1 + level) / 2).alias("high"))
    return frame.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).join(ends, key)
