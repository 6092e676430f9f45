"""What the findings of round 3 named, each by a case that failed before."""

import math
import os
import random
import subprocess
import sys

from pyspark.sql import functions as F

from judgeloom.operators import bootstrap
from judgeloom.operators import corpus as corpus_operators
from judgeloom.operators.store import BESIDE, Store
from judgeloom.functions import stats
from judgeloom.functions import text as X
from judgeloom.plans import acquired, corpus, paired, ratings, staged, stages
from judgeloom.sources import database, fixtures

DATA = "/root/testdata/sf0.001"


def test_exploded_responses_are_not_sent_through_the_driver(spark):
    plan = ratings.response_join(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 2


def test_an_array_is_one_file_however_its_rows_are_dealt(spark, tmp_path):
    import duckdb

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n = docs.count()
    for k in range(8):
        docs.withColumn("doc_id", F.col("doc_id") + k * n).coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    conf = {"autoBroadcastJoinThreshold": "4000", "shuffle.partitions": "48"}  # a join that turns out small while it runs is read mapper by mapper
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(f"spark.sql.{k}", v)
        got = {tuple(r) for r in acquired.json_elements(spark, str(tmp_path)).select("item_id", "text_md5", "ord").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = set(con.execute(f"SELECT item_id, text_md5, ord FROM ({acquired.ORACLES['json_elements']})").fetchall())
    assert got == want and len(got) == 8 * n


def test_counted_replicates_are_the_drawn_ones(spark):
    import time

    rng = random.Random(4)
    for n in (1, 2, 7, 1000, 30_011, 180_000, 1_800_001):
        for rep in (0, 1, 9_999, rng.randrange(10_000)):
            n01 = rng.randrange(n + 1)
            n10 = rng.randrange(n - n01 + 1)
            if n > 7:
                assert bootstrap.counted_sum(rep, n, n01, n10) == bootstrap.drawn_sum(rep, n, n01, n10)
            if n <= 1000:
                picks = [(rep * 1103515245 + i * 12345 * (rep + 7) + 1013904223) % 2147483647 % n for i in range(n)]
                assert bootstrap.drawn_sum(rep, n, n01, n10) == sum((p >= n - n01) - (p < n10) for p in picks)
    began = time.monotonic()
    wide = spark.createDataFrame([("a", 2_000_000_000, 300_000_000, 200_000_000)], "g string, n long, n01 long, n10 long")
    (row,) = bootstrap.portable(wide, ["g"], 200).collect()
    assert -1 <= row["low"] <= row["high"] <= 1 and time.monotonic() - began < 60  # 400 thousand million positions


def test_first_letters_pass_over_no_marker_and_no_conclusion(spark):
    rng = random.Random(6)
    known = [*fixtures.ASSESSMENTS, *fixtures.CONCLUSIONS]
    odd = str.maketrans({"i": "ı", "I": "İ", "s": "ſ"})
    rows = []
    for said in known:
        for form in (said, said.upper(), said.lower(), said.swapcase(), said.translate(odd), "x" + said, said[: rng.randrange(1, len(said))], said[1:]):
            rows.append((rng.choice(["", "Aa\n", "th fi as in "]) + form + rng.choice(["", "\n", " tail"]),))
    df = spark.createDataFrame(rows, "t string")
    plain = {X._ANY_CONCLUSION: X._FLAGS + "(?:" + "|".join(X.CONCLUSORY) + ")", X._ANY_MARKER: "(?dimuU)(?:" + "|".join(X.MARKERS) + ")"}
    for quick, slow in plain.items():
        assert df.where(F.split("t", quick, 2) != F.split("t", slow, 2)).count() == 0 and df.where(F.col("t").rlike(quick)).count() > 40


def test_texts_to_repair_are_truncated_once(spark):
    plan = corpus.repair(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "OPERATIVE PROVISIONS" not in plan


def test_ranks_read_counted_sizes_and_bind_z_once(spark):
    plan = paired.wilcoxon_small(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_totalprice" not in plan
    z = F.col("z") * 1.5
    got = spark.createDataFrame([(k / 40,) for k in range(240)], "z double").select((z).alias("z"), stats.normal_tail(z).alias("p"))
    assert all(abs(r["p"] - (math.erfc(r["z"] / math.sqrt(2)) / 2 if r["z"] <= 8 else 0)) < 1e-12 for r in got.collect())
    assert got._jdf.queryExecution().optimizedPlan().toString().count("* 1.5") <= 3


def test_messages_are_hashed_once_and_stages_are_asked_once(spark):
    plan = staged.stage_matrix(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
    summed = staged.cross_model_summary(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Summarise" not in summed


ON_EXECUTORS = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry
name, data, out, shared = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": shared}
entry.queries()[name](SparkSession.builder.config(map=conf).getOrCreate(), data).write.parquet(out)
"""


def on_executors(name: str, tmp_path) -> str:
    """A query's result as two executors, each a process of its own, write it."""
    import pyspark

    there, home, repo = os.path.dirname(pyspark.__file__), tmp_path / "home", os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (home / "work").mkdir(parents=True)  # executors' logs
    for p in os.listdir(there):
        if p != "work":
            (home / p).symlink_to(f"{there}/{p}")
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": f"{repo}:{os.environ.get('PYTHONPATH', '')}", "PYSPARK_PYTHON": sys.executable}
    env.pop("PYSPARK_GATEWAY_PORT", None), env.pop("PYSPARK_GATEWAY_SECRET", None)
    said = subprocess.run([sys.executable, "-c", ON_EXECUTORS, name, DATA, f"{tmp_path}/out", f"file://{tmp_path}/shared"], env=env, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr[-3000:]
    return f"{tmp_path}/out"


def test_a_database_is_read_by_every_executor(spark, tmp_path):
    want = sorted(tuple(r) for r in acquired.jdbc_pairs(spark, DATA).collect())
    assert sorted(tuple(r) for r in spark.read.parquet(on_executors("jdbc_pairs", tmp_path)).collect()) == want and want


def test_parts_of_a_database_hold_every_row_as_it_was(spark):
    texts = ['a "b" c', "", None, "two\nlines\r\nand\ttabs", "über ß 漢字 😀", "'; --", ",,\",\"", " around ", "long " * 20_000]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "item_id string, body string")
    for df, parts in ((rows, 5), (rows.limit(0), 1)):
        urls = database.load(df, "held", '"item_id" VARCHAR(40), "body" CLOB', 2)
        back = [tuple(r) for url in urls for r in spark.read.jdbc(url, "held", properties=database.DRIVER).collect()]
        assert sorted(back) == sorted(tuple(r) for r in df.collect()) and len(urls) == parts


def test_seeded_replicates_are_drawn_by_many_tasks_as_by_one(spark):
    import numpy as np

    rng, rows, want = random.Random(5), [], {}
    for g, n in {"a": 1, "b": 2, "c": 63, "d": 64, "e": 65, "f": 3000, None: 25_001}.items():
        held = [(g, i // 3 if i % 7 else None, i, rng.random() < 0.6, rng.random() < 0.7) for i in range(n)]
        d = np.array([int(o) - int(b) for _, k, i, b, o in sorted(held, key=lambda r: (r[1] is None, r[1] or 0, r[2]))])
        gen = np.random.RandomState(42)
        want[g] = tuple(np.percentile([d[gen.choice(n, size=n, replace=True)].mean() for _ in range(300)], [2.5, 97.5]))
        rows += held
    rng.shuffle(rows)
    pairs = spark.createDataFrame(rows, "g string, k long, i long, is_accurate_base boolean, is_accurate_other boolean").repartition(6)
    drawn = bootstrap.seeded(pairs, ["g"], ["k", "i"], 300, stride=1 << 12)
    assert {r["g"]: (r["low"], r["high"]) for r in drawn.collect()} == want
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "__hand" in plan  # a group's draws are not one task


def test_new_keys_stand_beside_what_is_there(spark, tmp_path):
    fields = "k string, v long, ord long"
    of = lambda *rows: spark.createDataFrame(list(rows), fields)
    store, want = Store(spark, f"{tmp_path}/t", ["k"], "ord", 2), {}
    for version in range(BESIDE + 3):
        rows = [(f"{version}-{i}", i, i) for i in range(20)]
        want |= {k: v for k, v, _ in rows}
        assert store.upsert(of(*rows), version) == [0, 1]
        assert {r["k"]: r["v"] for r in store.read().collect()} == want and store.read().count() == len(want)
        held = store.places(version)[0]
        assert held == (list(range(version + 1)) if version < BESIDE else list(range(BESIDE, version + 1)))
    store.upsert(of(("0-1", -1, 0), ("x", 1, 0), ("x", 2, 1)), 50)  # one is there, one is twice in the batch
    assert {r["k"]: r["v"] for r in store.read().collect()} == want | {"0-1": -1, "x": 2} and store.read().count() == len(want) + 1
    before = sorted(map(tuple, store.read().collect()))
    store.vacuum(1)
    assert sorted(map(tuple, store.read().collect())) == before


def test_a_refresh_keeps_no_text_twice_and_fetches_once(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def search(query, start, length):
        return 40, [{"columns": {"itemid": str(i), "docname": "A", "kpdate": f"2020-03-{i % 28 + 1:02d}T00:00:00", "conclusion": "Violation of Article 3; No violation of Article 8"}} for i in range(start, min(40, start + length))]

    def fetch(item):
        asked.add(1)
        return f"<p>{'The facts are plain enough. ' * 40}{item}</p>" + ("<p>MERITS</p><p>said</p>" if int(item) % 2 else "<p>Holds that it leaks</p>" if int(item) % 4 else "")

    says = {"a": lambda rows: rows.select("item_id", "article", F.to_json(F.struct((F.col("item_id") % 3 == 0).alias("leaks_verdict"), F.array(F.lit("The facts are plain enough.")).alias("leaking_sentences"))).alias("response"))}
    store = Store(spark, f"{tmp_path}/t", ["item_id", "article"], "ord", 4)
    stages.live(spark, store, f"{tmp_path}/run", search, fetch, says, 0, "2020-12-31")
    assert asked.value == 40
    assert all("full_case_text_no_verdict" not in spark.read.parquet(f"{tmp_path}/run/{step}").columns for step in ("cases", "cut")) and spark.read.parquet(f"{tmp_path}/run/cases").count() == 40
    cases = spark.read.parquet(f"{tmp_path}/run/cases")
    plain = stages.without_verdicts(corpus_operators.pairs(cases).drop("conclusion"), says)
    got = store.read()
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect())) and got.count() == 80
    assert got.where("verdict_removal_method LIKE '%removed leaking%'").count() > 0
