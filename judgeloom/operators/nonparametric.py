"""Tests of paired differences that need no distribution: signed ranks, sign flips, strata, bias-corrected bootstrap.

All of them work on the distinct values of a group's differences with their counts, so a group of any number of pairs is as many rows as it has
different values. Differences are integers (a rating's mean in tenths, say); other exact types do as well.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..storage import written
from . import running

#: The exact distribution of signed ranks is used up to so many pairs without ties and zeros.
EXACT = 50
#: Places of the exact distribution of sign flips; beyond that its normal form with a continuity correction.
PLACES = 1 << 22


def counts(diffs: DataFrame, by: list[str], diff: str) -> DataFrame:
    """by, size, up, down, zero: how many differences of each size go up and down; null differences are left out."""
    d = F.col(diff)
    held = diffs.where(d.isNotNull()).withColumn("size", F.abs(d))
    return held.groupBy(*by, "size").agg(F.count_if(d > 0).alias("up"), F.count_if(d < 0).alias("down"), F.count_if(d == 0).alias("zero"))


def _exact_tail(n: Column, w: Column) -> Column:
    """P(W <= w) of the sum of signed ranks of n pairs without ties, by the number of subsets of 1..n with each sum."""
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), (n * (n + 1) / 2).cast("int")))

    def add(have: Column, k: Column) -> Column:
        return F.zip_with(have, F.concat(F.array_repeat(F.lit(0.0), k.cast("int")), have), lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))

    ways = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1).cast("long"))), start, add)
    return F.aggregate(F.slice(ways, F.lit(1), (F.floor(w) + 1).cast("int")), F.lit(0.0), lambda a, b: a + b) / F.pow(F.lit(2.0), n)


def wilcoxon(diffs: DataFrame, by: list[str], diff: str) -> DataFrame:
    """by, n, w_plus, w_minus, p_value: the signed-rank test with zeros left out and mean ranks for ties.

    Exact for up to EXACT pairs without ties or zeros, else by the normal tail with the correction for ties; p is 1 without a difference."""
    # the ranges of the running totals, their offsets and the ranks all read the sizes: they are counted once
    sizes = written(counts(diffs, by, diff).select(*by, "up", "down", "zero", F.col("size").cast("double").alias("__at"), (F.col("up") + F.col("down")).alias("tied")), "sizes")
    ranked = running.totals(sizes, by, "__at", {"upto": F.col("tied")})
    # the ranks of a size are those behind the smaller ones: their mean. The size 0 has no rank and none is tied in it
    rank = F.col("upto") - F.col("tied") + (F.col("tied") + 1) / 2
    met = ranked.groupBy(*by).agg(
        F.sum("tied").alias("n"), F.sum(F.col("up") * rank).alias("w_plus"), F.sum(F.col("down") * rank).alias("w_minus"),
        F.sum(F.pow(F.col("tied").cast("double"), 3) - F.col("tied")).alias("ties"), F.sum("zero").alias("zeros"),
    )
    n, least = F.col("n"), F.least("w_plus", "w_minus")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    normal = 2 * stats.normal_tail(F.abs((F.col("w_plus") - n * (n + 1) / 4) / F.nullif(spread, F.lit(0.0))))
    exact = 2 * _exact_tail(F.least(n, F.lit(EXACT).cast("long")), least)
    p = F.when(n == 0, 1.0).when((n <= EXACT) & (F.col("ties") == 0) & (F.col("zeros") == 0), exact).otherwise(normal)
    return met.select(*by, "n", "w_plus", "w_minus", F.least(F.lit(1.0), p).alias("p_value"))


def sign_flips(diffs: DataFrame, by: list[str], diff: str, places: int = PLACES) -> DataFrame:
    """by, total, p_value: the two-sided permutation test of a sum of integer differences, every sign as likely as its opposite.

    The distribution of the sum is a convolution of binomials, one a size: exact up to so many places (half of the sum of all sizes), the normal tail with a continuity
    correction beyond. A group is as many rows as it has sizes."""
    sizes = counts(diffs, by, diff).where("size <> 0").withColumn("size", F.col("size").cast("long"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sizes.select(*by).schema)

    def one(key, f):
        import numpy as np
        import pandas as pd

        size, n = f["size"].to_numpy(np.int64), (f["up"] + f["down"]).to_numpy(np.int64)
        total = int((size * (f["up"] - f["down"]).to_numpy(np.int64)).sum())
        unit = int(np.gcd.reduce(size))
        size = size // unit
        span = int((size * n).sum())
        if span <= places:
            ways = np.ones(1)
            for s, k in zip(size.tolist(), n.tolist(), strict=True):
                # weights of 0..k flips, each s places apart
                term = np.zeros(s * k + 1)
                log = np.array([math.lgamma(k + 1) - math.lgamma(j + 1) - math.lgamma(k - j + 1) - k * math.log(2) for j in range(k + 1)])
                term[::s] = np.exp(log)
                ways = np.convolve(ways, term) if min(len(ways), len(term)) < 500 else _product(ways, term)
            sums = np.abs(2 * np.arange(span + 1) - span)
            p = float(ways[sums >= abs(total // unit)].sum())
        else:
            sd = math.sqrt(float((size.astype(float) ** 2 * n).sum()))
            p = math.erfc(max(0.0, abs(total // unit) - 1) / sd / math.sqrt(2))
        return pd.DataFrame([[*key, total, min(1.0, p)]], columns=[*by, "total", "p_value"])

    return sizes.groupBy(*by).applyInPandas(one, f"{kinds}, total long, p_value double")


def _product(a, b):
    """Convolution of long arrays of probabilities."""
    import numpy as np

    n = len(a) + len(b) - 1
    size = 1 << (n - 1).bit_length()
    return np.clip(np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[:n], 0, None)


def stratified_mcnemar(pairs: DataFrame, by: list[str], stratum: str) -> DataFrame:
    """by, strata, n01, n10, p_value, least_p, odds: discordant pairs of all strata together, and the smallest tail of any stratum.

    pairs: is_accurate_base, is_accurate_other. Given the discordant pairs of every stratum each goes either way alike, so their sum is binomial: the convolution of the strata's tails.
    odds: the Mantel-Haenszel ratio of the strata."""
    b, o = F.col("is_accurate_base"), F.col("is_accurate_other")
    per = pairs.groupBy(*by, stratum).agg(F.count("*").alias("n"), F.count_if(~b & o).alias("n01"), F.count_if(b & ~o).alias("n10"))
    per = per.withColumn("p", stats.mcnemar(F.col("n01"), F.col("n10")))
    sums = per.groupBy(*by).agg(
        F.count("*").alias("strata"), F.sum("n01").alias("n01"), F.sum("n10").alias("n10"), F.min("p").alias("least_p"),
        (F.sum(F.col("n01") / F.col("n")) / F.nullif(F.sum(F.col("n10") / F.col("n")), F.lit(0.0))).alias("odds"),
    )
    return sums.select(*by, "strata", "n01", "n10", stats.mcnemar(F.col("n01"), F.col("n10")).alias("p_value"), "least_p", "odds")


def acceleration(diffs: DataFrame, by: list[str], diff: str) -> DataFrame:
    """by, n, mean, acceleration of the mean by the jackknife: leaving a pair out changes it by what the pair's value tells, so counts of values are enough."""
    d = F.col(diff).cast("double")
    values = diffs.where(d.isNotNull()).groupBy(*by, d.alias("d")).agg(F.count("*").alias("c"))
    sums = values.groupBy(*by).agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("d")) / F.sum("c")).alias("mean"))
    held = sums.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(by)), "n", "mean")
    met = values.join(held, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(by)])
    # the jackknife's mean less the value without a pair
    off = F.coalesce((F.col("d") - F.col("mean")) / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(0.0))
    out = met.groupBy(*by).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.sum(F.col("c") * F.pow(off, 3)).alias("__3"), F.sum(F.col("c") * off * off).alias("__2"))
    return out.select(*by, "n", "mean", F.when((F.col("n") > 1) & (F.col("__2") > 1e-300), F.col("__3") / (6 * F.pow(F.greatest("__2", F.lit(1e-300)), 1.5))).otherwise(0.0).alias("acceleration"))


def bca(diffs: DataFrame, by: list[str], diff: str, replicates: int = 10_000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """by, n, mean, low, high: the bias-corrected accelerated bootstrap interval of the mean difference.

    Replicates are multinomial counts of the distinct values; a group without spread has its mean as both ends."""
    d = F.col(diff).cast("double")
    values = diffs.where(d.isNotNull()).groupBy(*by, d.alias("d")).agg(F.count("*").alias("c"))
    lists = values.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("d", "c"))).alias("values"))
    held = acceleration(diffs, by, diff).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(by)), "n", "mean", "acceleration")
    met = lists.join(held, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(by)]).select(*by, "n", "mean", "acceleration", F.col("values.d").alias("d"), F.col("values.c").alias("c"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.select(*by).schema)

    def draw(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            ends = [bca_interval(np.array(r.d, float), np.array(r.c, np.int64), r.acceleration, [getattr(r, k) for k in by], replicates, ci, seed) for r in f.itertuples(index=False)]
            yield pd.concat([f[[*by, "n", "mean"]].reset_index(drop=True), pd.DataFrame(ends, columns=["low", "high"])], axis=1)

    return met.mapInPandas(draw, f"{kinds}, n long, mean double, low double, high double")


def bca_interval(d, c, acceleration: float, key: list, replicates: int, ci: float, seed: int) -> tuple[float, float]:
    """One group's interval, from its distinct values and their counts."""
    import zlib

    import numpy as np

    n, mean = int(c.sum()), float((c * d).sum() / c.sum())
    rng = np.random.RandomState(zlib.crc32("\t".join(map(str, key)).encode()) ^ seed)
    means = rng.multinomial(n, c / n, size=replicates) @ d / n
    below = (np.count_nonzero(means < mean - 1e-12) + 0.5 * np.count_nonzero(np.abs(means - mean) <= 1e-12)) / replicates
    if not 0 < below < 1 or len(d) == 1:
        return mean, mean
    normal = NormalDist()
    z = normal.inv_cdf(below)

    def place(a: float) -> float:
        x = z + normal.inv_cdf(a)
        return 100 * normal.cdf(z + x / (1 - acceleration * x))

    low, high = np.percentile(means, [place((1 - ci) / 2), place((1 + ci) / 2)])
    return float(low), float(high)
