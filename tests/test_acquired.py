"""Split JSON arrays, the paged source and its stream, the live refresh, ranges of a database."""

import json
import random

import pytest
from pyspark.sql import functions as F

from judgeloom.operators.steps import Run
from judgeloom.operators.store import Store
from judgeloom.plans import stages
from judgeloom.sources import json_split, paged, readers

FIELDS = "item_id string, text string, nested struct<a: string, b: array<struct<c: int>>>"


def array(rng, n):
    odd = ['plain "quoted" text', "braces { } [ ] , : inside", 'ends with a backslash \\', 'escaped \\" quote {"', "über ß 漢字  ", "", "line\nbreak\t{", '"}{"', "\\\\{"]
    return [{"item_id": str(i), "text": rng.choice(odd) * rng.randrange(4), "nested": {"a": rng.choice(odd), "b": [{"c": k} for k in range(rng.randrange(3))]}} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_a_split_array_equals_the_plain_reader(spark, tmp_path, indent):
    rng = random.Random(4)
    for name, n in (("a", 300), ("b", 1), ("c", 40)):
        (tmp_path / f"{name}.json").write_text(json.dumps(array(rng, n), indent=indent, ensure_ascii=name == "a"))
    (tmp_path / "empty.json").write_text("[]")
    from pyspark.sql import types as T

    fields = T.StructType.fromDDL(FIELDS)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        raw = spark.read.option("lineSep", "{").text(f"{tmp_path}/a.json")
        assert raw.rdd.getNumPartitions() > 5  # one file, several tasks
        got = sorted(map(repr, json_split.json_array(spark, f"{tmp_path}/*.json", fields).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted(map(repr, readers.json_array(spark, f"{tmp_path}/*.json", fields).collect())) and len(got) == 341


def flaky(folder, total, broken=()):
    """A service of numbered hits that fails the first time it is asked for some pages, and counts what it is asked."""
    import os

    def search(query, start, length):
        path = f"{folder}/{start}"
        with open(path, "a") as f:
            f.write("x")
        if start in broken and os.path.getsize(path) == 1:
            raise ConnectionError(start)
        return total, [{"columns": {"itemid": str(i), "docname": query}} for i in range(start, min(total, start + length))]

    return search


def test_a_failed_page_is_asked_for_again_alone(spark, tmp_path):
    import os

    name = paged.source(spark, flaky(str(tmp_path), 95, {20, 90}), "flaky_search")
    rows = spark.read.format(name).options(query="q", page="10", pause="0").load()
    assert rows.rdd.getNumPartitions() == 10
    got = rows.select("place", F.get_json_object("hit", "$.columns.itemid").alias("i")).collect()
    assert sorted((r["place"], int(r["i"])) for r in got) == [(i, i) for i in range(95)]
    asked = {int(f): os.path.getsize(tmp_path / f) for f in os.listdir(tmp_path)}
    assert {s for s in range(10, 100, 10) if asked[s] == asked[10]} == {10, 30, 40, 50, 60, 70, 80} and asked[20] > asked[10]
    none = paged.source(spark, flaky(str(tmp_path), 0), "no_hits")
    assert spark.read.format(none).load().count() == 0

    def refuses(query, start, length):
        raise ConnectionError("always")

    with pytest.raises(ConnectionError):
        paged.asked(refuses, "", 0, 1, 2, 0.0)


def test_a_stream_reads_only_new_hits(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for total in (25, 25, 60):
        name = paged.source(spark, flaky(str(tmp_path / "s"), total), "growing_search")
        stream = spark.readStream.format(name).options(page="10", pause="0").load()
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        assert sorted(r["place"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(total))


TEXT = "The facts of the case are plain enough to be told in a few words. " * 12


def service(n, calls=None):
    def search(query, start, length):
        since = query.split("kpdate:[")[1][:10] if "kpdate" in query else ""
        held = [(f"2020-03-{i + 1:02d}", str(i)) for i in range(n)]
        held = [h for h in held if h[0] >= since]
        return len(held), [{"columns": {"itemid": i, "docname": f"CASE {i}", "kpdate": f"{d}T00:00:00", "conclusion": "Violation of Article 3; No violation of Article 8"}} for d, i in held[start : start + length]]

    return search


def fetch(item):
    return None if item == "2" else f"<p>{TEXT}</p><p>MERITS</p><p>said</p>" if int(item) % 2 else f"<p>{TEXT} {item}</p>"


def test_a_live_refresh_adds_what_is_new_and_goes_on_where_it_stopped(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/t", ["item_id", "article"], "ord", 4)
    go = lambda version, n, **more: stages.live(spark, store, f"{tmp_path}/runs/{version}", service(n), more.pop("fetch", fetch), {}, version, more.pop("today", "2020-12-31"), **more)
    assert go(0, 10) and store.read().count() == 18  # one case has no text, each other one two articles
    assert {r["verdict_removal_method"] for r in store.read().collect()} == {"court_assessment_start", "no_truncation"}
    assert go(1, 10) == [] and store.versions() == [0]  # nothing new, no version

    def broken(item):
        raise InterruptedError(item)

    with pytest.raises(Exception, match="InterruptedError"):
        go(2, 14, fetch=broken)
    run = Run(spark, stages.live_steps(spark, store, service(14), fetch, {}, "2020-12-31"), f"{tmp_path}/runs/2")
    assert run.done("new") and not run.done("cases") and run.table("plan").first()["since"] == "2020-03-09" and run.computed == []
    assert sorted(r["item_id"] for r in run.table("new").collect()) == ["10", "11", "12", "13"]
    assert go(2, 14) and store.versions() == [0, 2] and store.read().count() == 26
    assert go(2, 20) == [] and store.read().count() == 26  # that version is there
    assert go(3, 20, today="2020-03-13") == []  # up to date: nothing is searched for


def test_ranges_of_a_database_meet_every_row_once(spark):
    parts = readers.date_parts("d", "2020-01-01", "2020-12-31", 5)
    rows = spark.createDataFrame([(None,), ("",), ("2019-05-01",), ("2030-01-01",), *((f"2020-{m:02d}-15",) for m in range(1, 13))], "d string")
    met = [r["d"] for p in parts for r in rows.where(p).collect()]
    assert len(parts) == 5 and sorted(map(str, met)) == sorted(str(r["d"]) for r in rows.collect())
    assert readers.date_parts("d", "2020-01-01", "2020-01-01", 4)[0].startswith("d <")
