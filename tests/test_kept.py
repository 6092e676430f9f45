"""Kept steps, versioned upserts and shared files."""

import pytest
from pyspark.sql import functions as F

from judgeloom import storage
from judgeloom.operators.steps import Run
from judgeloom.operators.store import Store


def test_an_interrupted_run_repeats_only_unfinished_steps(spark, tmp_path):
    calls, broken = [], [True]

    def step(name, fail=False):
        def compute(*tables):
            calls.append(name)
            if fail and broken[0]:
                raise RuntimeError(name)
            return spark.range(1 + sum(t.count() for t in tables))

        return compute

    def run():
        return Run(spark, {"a": ([], step("a")), "b": (["a"], step("b")), "c": (["a"], step("c", True)), "d": (["b", "c"], step("d"))}, f"{tmp_path}/run")

    with pytest.raises(RuntimeError):
        run().all()
    assert calls == ["a", "b", "c"] and run().done("b") and not run().done("c")
    broken[0] = False
    again = run()
    assert again.table("d").count() == 5 and again.computed == ["c", "d"] and calls == ["a", "b", "c", "c", "d"]
    assert sorted(again.reset("b")) == ["b", "d"] and run().done("a") and not run().done("d")
    third = run()
    third.all()
    assert third.computed == ["b", "d"]
    assert {r["step"] for r in third.progress().where("done_at IS NOT NULL").collect()} == set("abcd")


def test_a_listener_hears_of_every_step(spark, tmp_path):
    heard, broken = [], [True]

    def second(first):
        if broken[0]:
            raise RuntimeError("no")
        return first

    run = Run(spark, {"a": ([], lambda: spark.range(2)), "b": (["a"], second)}, f"{tmp_path}/run", lambda event, step, about: heard.append((event, step, sorted(about))))
    with pytest.raises(RuntimeError):
        run.all()
    broken[0] = False
    run.all()
    run.reset("a")
    assert [h[:2] for h in heard] == [("began", "a"), ("done", "a"), ("kept", "a"), ("began", "b"), ("failed", "b"), ("kept", "a"), ("kept", "a"), ("began", "b"), ("done", "b"), ("reset", "b"), ("reset", "a")]
    assert heard[4][2] == ["error", "seconds"]


def test_an_upsert_rewrites_the_partitions_of_its_keys(spark, tmp_path):
    fields = "k string, a string, v long, ord long"
    store = Store(spark, f"{tmp_path}/t", ["k", "a"], "ord", 8)
    assert store.read() is None
    first = spark.createDataFrame([(f"k{i}", "x", i, i) for i in range(100)] + [("k1", "x", 777, 200), (None, "x", 5, 1)], fields)
    assert store.upsert(first, 0) == list(range(8))
    assert store.read().count() == 101 and store.read().where("k = 'k1'").first()["v"] == 777
    one = spark.createDataFrame([("k3", "x", -3, 0)], fields)
    touched = store.upsert(one, 1)
    assert len(touched) == 1 and store.upsert(one, 1) == []  # a replay changes nothing
    assert [b for b, v in store.manifest(1).items() if v == 1] == touched
    assert store.read().where("k = 'k3'").first()["v"] == -3 and store.read(0).where("k = 'k3'").first()["v"] == 3 and store.read().count() == 101
    assert len(storage.listed(spark, f"{tmp_path}/t/data/version=1/bucket=*")) == 1
    store.upsert(spark.createDataFrame([("", "x", 6, 0), ("new", None, 1, 1)], fields), 2)  # null and the empty text are one key
    assert store.read().count() == 102 and [r["v"] for r in store.read().where("coalesce(k, '') = ''").collect()] == [6]
    want = sorted(store.read().collect(), key=str)
    assert store.vacuum(1) and store.versions() == [2] and sorted(store.read().collect(), key=str) == want
    assert store.vacuum(1) == []
    store.upsert(first.limit(0), 3)
    assert sorted(store.read().collect(), key=str) == want


def test_a_version_without_its_manifest_is_written_anew(spark, tmp_path):
    fields = "k string, v long"
    store = Store(spark, f"{tmp_path}/t", ["k"], "v", 4)
    store.upsert(spark.createDataFrame([("a", 1), ("b", 2)], fields), 0)
    spark.createDataFrame([("a", 99, 0)], fields + ", bucket int").write.partitionBy("bucket").parquet(f"{tmp_path}/t/data/version=1")  # stopped before its manifest
    assert {r["k"]: r["v"] for r in store.read().collect()} == {"a": 1, "b": 2}
    store.upsert(spark.createDataFrame([("a", 3)], fields), 1)
    assert {r["k"]: r["v"] for r in store.read().collect()} == {"a": 3, "b": 2}


def test_small_files_and_the_shared_folder(spark, tmp_path):
    storage.put(spark, f"{tmp_path}/x", "one")
    storage.put(spark, f"{tmp_path}/x", "zwei é")
    assert storage.get(spark, f"{tmp_path}/x") == "zwei é" and len(storage.listed(spark, f"{tmp_path}/*")) == 1
    held = storage.written(spark.range(5).select(F.col("id") * 2), "five")
    assert held.count() == 5 and storage.shared_dir(spark).startswith("file:")
