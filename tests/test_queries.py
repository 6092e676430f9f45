"""Every registered query against its SQL counterpart, on the smallest synthetic tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from judgeloom.plans import acquired, corpus, paired, ratings, staged

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = ratings.QUERIES | paired.QUERIES | corpus.QUERIES | acquired.QUERIES | staged.QUERIES
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no synthetic tables here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) and not math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", [n for n in OWN if n in entry.oracle_sql()])
def test_equals_sql(spark, sql, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = sql.execute(entry.oracle_sql()[name])
    head = [c[0] for c in res.description]
    assert sorted(head) == cols
    assert got == sorted(tuple(plain(r[head.index(c)]) for c in cols) for r in res.fetchall())


@pytest.mark.parametrize("name", [n for n in OWN if n not in entry.oracle_sql()])
def test_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_seeded_sample_against_plain_loop(spark):
    import random

    got = {(r["c_nationkey"], r["o_custkey"]) for r in corpus.seeded_sample(spark, DATA).collect()}
    con = duckdb.connect()
    rows = con.execute(f"SELECT o_orderkey, o_custkey, c_nationkey FROM '{DATA}/orders.parquet' JOIN '{DATA}/customer.parquet' ON o_custkey = c_custkey ORDER BY 1").fetchall()
    groups = {}
    for _, cust, nation in rows:
        groups.setdefault(nation, []).append(cust)
    rng, want = random.Random(42), set()
    for nation in sorted(groups, key=lambda n: len(groups[n]), reverse=True)[:8]:
        ids = sorted(set(groups[nation]))
        want |= {(nation, c) for c in rng.sample(ids, min(15, len(ids)))}
    assert got == want


def test_bootstraps_read_every_pair_10000_times(spark):
    import numpy as np

    groups = {}
    for r in ratings._versus(spark, DATA, "factual").collect():
        groups.setdefault(r["evaluator"], []).append((r["case_id"], r["art"], int(r["is_accurate_other"]) - int(r["is_accurate_base"])))
    want = {}
    for evaluator, rows in groups.items():
        d, rng = np.array([x for *_, x in sorted(rows)]), np.random.RandomState(42)
        want[evaluator] = np.percentile([d[rng.choice(len(d), size=len(d), replace=True)].mean() for _ in range(10_000)], [2.5, 97.5])
    got = {r["evaluator"]: (r["low"], r["high"]) for r in ratings.bootstrap_seeded(spark, DATA).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[e], want[e], rtol=0, atol=1e-6) for e in want)
    counts = ratings.pairing.comparison(ratings._versus(spark, DATA, "normative", "factual"), ["evaluator", "framing"])
    drawn = ratings.rounded(ratings.bootstrap.multinomial(counts, ["evaluator", "framing"], 10_000)).collect()
    assert sorted(drawn) == sorted(ratings.bootstrap_multinomial(spark, DATA).collect())


def test_shape_of_the_plans(spark):
    """Samples reduce in one shuffle by case, and scans read only the columns they need."""
    plan = ratings.condition_summary(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "o_comment" not in plan and "Python" not in plan
