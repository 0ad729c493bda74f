"""Statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Critical values of chi-square for 1 to 30 degrees of freedom.
CHI2_05 = (3.841, 5.991, 7.815, 9.488, 11.070, 12.592, 14.067, 15.507, 16.919, 18.307, 19.675, 21.026, 22.362, 23.685, 24.996, 26.296, 27.587, 28.869, 30.144, 31.410, 32.671, 33.924, 35.172, 36.415, 37.652, 38.885, 40.113, 41.337, 42.557, 43.773)
CHI2_01 = (6.635, 9.210, 11.345, 13.277, 15.086, 16.812, 18.475, 20.090, 21.666, 23.209, 24.725, 26.217, 27.688, 29.141, 30.578, 31.999, 33.409, 34.805, 36.191, 37.566, 38.932, 40.289, 41.638, 42.980, 44.314, 45.642, 46.963, 48.278, 49.588, 50.892)
CHI2_001 = (10.828, 13.816, 16.266, 18.467, 20.515, 22.458, 24.322, 26.125, 27.877, 29.588, 31.264, 32.910, 34.528, 36.123, 37.697, 39.252, 40.790, 42.312, 43.820, 45.315, 46.797, 48.268, 49.728, 51.179, 52.620, 54.052, 55.476, 56.892, 58.301, 59.703)


def posterior_mean(successes: Column, trials: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """The smoothed rate of a Beta-Binomial model, to six places."""
    return F.bround((successes + alpha) / (trials + alpha + beta), 6)


def chi2_p_bracket(chi2: Column, df: Column) -> Column:
    """A conservative bracket of the p-value: 0.001, 0.01, 0.05 or 1; Wilson-Hilferty above 30 degrees of freedom."""
    limit = lambda table: F.element_at(F.array(*[F.lit(x) for x in table]), F.least(F.greatest(df, F.lit(1)), F.lit(30)).cast("int"))
    z = (F.pow(chi2 / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    low = F.when(chi2 >= limit(CHI2_001), 0.001).when(chi2 >= limit(CHI2_01), 0.01).when(chi2 >= limit(CHI2_05), 0.05).otherwise(1.0)
    high = F.when(z >= 3.291, 0.001).when(z >= 2.576, 0.01).when(z >= 1.960, 0.05).otherwise(1.0)
    return F.when(df < 1, None).when(df <= 30, low).otherwise(high)


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.when(b * c == 0, float("inf")).otherwise(F.bround((a * d).cast("double") / (b * c), 6))


def erfc(x: Column) -> Column:
    """The complementary error function to 1.2e-7, by Chebyshev fitting."""
    t = 1 / (1 + 0.5 * F.abs(x))
    terms = (1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    series = F.lit(0.0)
    for c in reversed(terms):
        series = t * (c + series)
    value = t * F.exp(-x * x - 1.26551223 + series)
    return F.when(x >= 0, value).otherwise(2 - value)


def proportion_power(n: Column, p0: Column, delta: float = 0.15) -> Column:
    """The power of a one-sided test of a proportion at level 0.05 to see a rise of ``delta``."""
    p1 = F.least(p0 + delta, F.lit(0.999))
    reach = p0 + 1.6448536269514729 * F.sqrt(p0 * (1 - p0) / n)
    power = 0.5 * erfc((reach - p1) / F.sqrt(p1 * (1 - p1) / n) / math.sqrt(2))
    return F.when((n <= 0) | (p0 <= 0) | (p0 >= 1), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), power)))


def power_label(power: Column) -> Column:
    return F.when(power >= 0.80, "high").when(power >= 0.50, "moderate").when(power.isNotNull(), "low")


def degree_decay(degree: Column) -> Column:
    """1, 1, one half, one quarter and so on by distance."""
    return F.pow(F.lit(0.5), F.greatest(degree - 2, F.lit(0)))


def z_score(value: Column, mean: Column, deviation: Column) -> Column:
    return F.when(deviation == 0, 0.0).otherwise(F.bround((value - mean) / deviation, 6))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
