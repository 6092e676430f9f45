"""Paired tests against enumeration and plain loops."""

import itertools
import zlib
from statistics import NormalDist

import numpy as np
import pytest

from judgeloom.functions import stats
from judgeloom.operators import nonparametric, running


def frame(spark, groups):
    return spark.createDataFrame([(g, int(d)) for g, ds in groups.items() for d in ds], "g string, d long")


def signed_ranks(d):
    """W+ and the two-sided p by all signs, where there are neither ties nor zeros."""
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    w = ranks[np.array(d) > 0].sum()
    least = min(w, ranks.sum() - w)
    sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    return w, min(1.0, 2 * np.mean(np.array(sums) <= least))


def test_signed_ranks_by_enumeration(spark):
    groups = {"a": [1, -2, 3, 4, -5, 6, 7, 8], "b": [5], "c": [-3, 9, -11, 12, 2], "d": list(range(1, 12))}
    got = {r["g"]: r for r in nonparametric.wilcoxon(frame(spark, groups), ["g"], "d").collect()}
    for g, d in groups.items():
        w, p = signed_ranks(d)
        assert got[g]["w_plus"] == w and got[g]["p_value"] == pytest.approx(p, abs=1e-12)


def test_signed_ranks_with_ties_zeros_and_nothing(spark):
    rng = np.random.RandomState(3)
    groups = {"ties": rng.randint(-4, 7, 300), "none": [0, 0], "one": [0, 2]}
    rows = frame(spark, groups).unionByName(spark.createDataFrame([(None, 3), (None, -1), ("null", None)], "g string, d long"))
    got = {r["g"]: r for r in nonparametric.wilcoxon(rows, ["g"], "d").collect()}
    d = groups["ties"][groups["ties"] != 0]
    size = np.abs(d)
    ranks = np.array([(size < x).sum() + ((size == x).sum() + 1) / 2 for x in size])
    n, t = len(d), np.unique(size, return_counts=True)[1]
    z = abs(ranks[d > 0].sum() - n * (n + 1) / 4) / np.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (t**3 - t).sum() / 48)
    assert got["ties"]["n"] == n and got["ties"]["w_plus"] == ranks[d > 0].sum() and got["ties"]["p_value"] == pytest.approx(2 * NormalDist().cdf(-z), abs=1e-12)
    assert got["none"]["n"] == 0 and got["none"]["p_value"] == 1.0 and got["one"]["n"] == 1 and got[None]["w_plus"] == 2 and "null" not in got


def test_normal_tail(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(x / 7,) for x in range(60)], "z double").select("z", stats.normal_tail(F.col("z")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(NormalDist().cdf(-r["z"]), abs=2e-15) for r in rows)


def test_sign_flips_by_enumeration(spark):
    groups = {"a": [3, -1, 2, 2, 0, -7], "b": [10, 10, 10], "c": [-4, 6, 8, 2], "d": [1, -1]}
    got = {r["g"]: r for r in nonparametric.sign_flips(frame(spark, groups), ["g"], "d").collect()}
    for g, d in groups.items():
        sums = [abs(sum(s * abs(x) for s, x in zip(signs, d, strict=True))) for signs in itertools.product((-1, 1), repeat=len(d))]
        assert got[g]["total"] == sum(d) and got[g]["p_value"] == pytest.approx(np.mean(np.array(sums) >= abs(sum(d))), abs=1e-9)
    # many pairs: the exact distribution and its normal form agree
    rng = np.random.RandomState(5)
    many = frame(spark, {"m": rng.randint(-9, 10, 4000)})
    exact, normal = (nonparametric.sign_flips(many, ["g"], "d", places).first()["p_value"] for places in (1 << 22, 0))
    assert exact == pytest.approx(normal, rel=0.02)


def test_strata_and_acceleration_against_plain_loops(spark):
    rng = np.random.RandomState(1)
    rows = [(g, s, bool(a), bool(b)) for g in "xy" for s in "uvw" for a, b in rng.randint(0, 2, (40, 2))]
    pairs = spark.createDataFrame(rows, "g string, s string, is_accurate_base boolean, is_accurate_other boolean")
    got = {r["g"]: r for r in nonparametric.stratified_mcnemar(pairs, ["g"], "s").collect()}
    from math import comb

    tail = lambda a, b: min(1.0, 2 * sum(comb(a + b, k) for k in range(min(a, b) + 1)) / 2 ** (a + b)) if a + b else 1.0
    for g in "xy":
        each = {s: ([r for r in rows if r[0] == g and r[1] == s and not r[2] and r[3]], [r for r in rows if r[0] == g and r[1] == s and r[2] and not r[3]]) for s in "uvw"}
        a, b = (sum(len(e[k]) for e in each.values()) for k in (0, 1))
        assert (got[g]["strata"], got[g]["n01"], got[g]["n10"]) == (3, a, b) and got[g]["p_value"] == pytest.approx(tail(a, b), abs=1e-9)
        assert got[g]["least_p"] == pytest.approx(min(tail(len(x), len(y)) for x, y in each.values()), abs=1e-9)
    diffs = {"a": rng.randint(-1, 2, 200), "b": [1] * 20 + [0] * 70 + [-1] * 3, "flat": [1, 1, 1], "one": [1]}
    found = {r["g"]: r for r in nonparametric.acceleration(frame(spark, diffs), ["g"], "d").collect()}
    for g, d in diffs.items():
        d = np.array(d, float)
        left = np.array([np.delete(d, i).mean() for i in range(len(d))]) if len(d) > 1 else np.zeros(1)
        off = left.mean() - left
        assert found[g]["acceleration"] == pytest.approx((off**3).sum() / (6 * (off**2).sum() ** 1.5) if (off**2).sum() > 1e-20 else 0.0, abs=1e-9)


def test_bca_against_a_plain_loop(spark):
    diffs = {"a": np.random.RandomState(2).randint(-1, 2, 150), "b": [1] * 30 + [0] * 100 + [-1] * 4, "flat": [1, 1, 1]}
    got = {r["g"]: r for r in nonparametric.bca(frame(spark, diffs), ["g"], "d").collect()}
    normal = NormalDist()
    for g in "ab":
        d = np.array(diffs[g], float)
        values, c = np.unique(d, return_counts=True)
        means = np.random.RandomState(zlib.crc32(g.encode()) ^ 42).multinomial(len(d), c / len(d), size=10_000) @ values / len(d)
        z = normal.inv_cdf(((means < d.mean() - 1e-12).sum() + 0.5 * (np.abs(means - d.mean()) <= 1e-12).sum()) / 10_000)
        left = np.array([np.delete(d, i).mean() for i in range(len(d))])
        off = left.mean() - left
        a = (off**3).sum() / (6 * (off**2).sum() ** 1.5)
        ends = [np.percentile(means, 100 * normal.cdf(z + (z + normal.inv_cdf(q)) / (1 - a * (z + normal.inv_cdf(q))))) for q in (0.025, 0.975)]
        assert [got[g]["low"], got[g]["high"]] == pytest.approx(ends, abs=1e-9)
        plain = np.percentile([np.random.RandomState(k).choice(d, len(d)).mean() for k in range(2000)], [2.5, 97.5])
        assert [got[g]["low"], got[g]["high"]] == pytest.approx(list(plain), abs=0.05)
    assert got["flat"]["low"] == got["flat"]["high"] == 1.0


def test_running_totals_without_a_window_over_a_group(spark):
    """A hot group, ties, null values and keys, few rows: the same as a plain loop, and no window by the keys alone."""
    rng = np.random.RandomState(7)
    rows = [(k, float(o), i, int(v)) for i, (k, o, v) in enumerate(zip(["hot"] * 900 + ["cold"] * 90 + [None] * 10, rng.randint(0, 200, 1000), rng.randint(0, 9, 1000), strict=True))]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "k string, o double, i long, v long")
    out = running.totals(df, ["k"], "o", {"s": F.col("v"), "n": F.lit(1)}, ["i"], 16)
    got = {r["i"]: (r["s"], r["n"]) for r in out.collect()}
    for key in ("hot", "cold", None):
        s = n = 0
        for _, _, i, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            s, n = s + v, n + 1
            assert got[i] == (s, n)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("__range" in line for line in plan.splitlines() if line.strip(" :+-").startswith("Window") and "__l_s" in line)
    assert df.limit(0).transform(lambda d: running.totals(d, ["k"], "o", {"s": F.col("v")})).count() == 0
