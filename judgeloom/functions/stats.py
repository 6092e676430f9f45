"""Statistics as column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .binding import let

Z95 = 1.959963984540054


def _stirling(x: Column) -> Column:
    """What Stirling's formula lacks of ln x! for x of 1 or more: exact below 16, a series above."""
    exact = F.log(F.factorial(F.least(x, F.lit(16)).cast("int"))) - (x + 0.5) * F.log(x) + x - math.log(math.sqrt(2 * math.pi))
    return F.when(x < 16, exact).otherwise(1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x))


def _deviance(x: Column, mean: Column) -> Column:
    d = (x - mean) / mean
    return mean * ((1 + d) * F.log1p(d) - d)


def mcnemar(n01: Column, n10: Column) -> Column:
    """Two-sided exact McNemar p-value: twice the lower binomial tail at one half, at most 1.

    The tail is summed from its largest term (by the saddle-point form of the binomial) down, as far as 24 standard deviations:
    memory and time grow with the root of the discordant pairs."""
    n, k = (n01 + n10).cast("double"), F.least(n01, n10).cast("double")
    rest = n - k
    largest = F.when(k == 0, n * math.log(0.5)).otherwise(_stirling(n) - _stirling(k) - _stirling(rest) - _deviance(k, n / 2) - _deviance(rest, n / 2) + 0.5 * F.log(n / (2 * math.pi * k * rest)))
    terms = F.least(k, F.floor(12 * F.sqrt(n)) + 60).cast("long")
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(a: Column, i: Column) -> Column:
        t = a["t"] * (k - i + 1) / (rest + i)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    sums = F.when(terms > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(terms, F.lit(1).cast("long"))), start, add, lambda a: a["s"])).otherwise(1.0)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(largest) * sums))


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z of 0 or more: the series of the distribution function, whose terms fall from the square of z on; 0 beyond 8."""

    def tail(x: Column) -> Column:
        start = F.struct(x.alias("t"), x.alias("s"))

        def add(a: Column, k: Column) -> Column:
            t = a["t"] * x * x / (2 * k + 1)
            return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

        # further terms are below the last place of the sum
        terms = F.least(F.lit(150), (2 * F.ceil(x * x) + 25).cast("int"))
        series = F.aggregate(F.sequence(F.lit(1), terms), start, add, lambda a: a["s"])
        return F.when(x > 8, 0.0).otherwise(F.greatest(F.lit(0.0), 0.5 - series * F.exp(-x * x / 2) / math.sqrt(2 * math.pi)))

    # bound once: an expression inside the series would be computed for each of its terms
    return let(z.cast("double"), tail)


def wilson(k: Column, n: Column, ci: float = 0.95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, inside 0 and 1; null for n = 0."""
    z = Z95 if ci == 0.95 else NormalDist().inv_cdf(0.5 + ci / 2)
    n = F.nullif(n, F.lit(0))
    p = k / n
    mid, low = (p + z * z / (2 * n)) / (1 + z * z / n), 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / low
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), mid - half)), F.when(n.isNotNull(), F.least(F.lit(1.0), mid + half))


def effect_size(delta: Column) -> Column:
    return F.when(F.abs(delta) < 0.05, "small").when(F.abs(delta) < 0.10, "moderate").otherwise("large")


def cohens_h(p: Column, q: Column) -> Column:
    return 2 * F.asin(F.sqrt(p)) - 2 * F.asin(F.sqrt(q))


def number_needed(delta: Column) -> Column:
    return F.when(delta != 0, 1 / F.abs(delta))


def bonferroni(p: Column, over: WindowSpec) -> Column:
    return F.least(F.lit(1.0), p * F.count("*").over(over))


def holm(p: Column, keys: list[str], ties: str) -> Column:
    """Step-down adjusted p-values among the rows of equal keys; ties: a column that orders equal p-values."""
    order = Window.partitionBy(*keys).orderBy(p, ties)
    m, rank = F.count("*").over(Window.partitionBy(*keys)), F.row_number().over(order)
    return F.least(F.lit(1.0), F.max(p * (m - rank + 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def benjamini_hochberg(p: Column, keys: list[str], ties: str) -> Column:
    order = Window.partitionBy(*keys).orderBy(p, ties)
    m, rank = F.count("*").over(Window.partitionBy(*keys)), F.row_number().over(order)
    return F.least(F.lit(1.0), F.min(p * m / rank).over(order.rowsBetween(0, Window.unboundedFollowing)))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, 0 of nothing."""
    return F.coalesce(100.0 * part / F.nullif(whole, F.lit(0)), F.lit(0.0))
