"""What the findings of round 4 named, each by a case that failed before."""

import json
import os
import random

from pyspark.sql import functions as F

from judgeloom import storage
from judgeloom.functions import text as X
from judgeloom.plans import acquired
from judgeloom.sources import fixtures, paged, saved

DATA = "/root/testdata/sf0.001"


def test_a_database_goes_to_a_shared_folder_named_in_any_way(spark, tmp_path, monkeypatch):
    want = sorted(tuple(r) for r in acquired.jdbc_pairs(spark, DATA).collect())
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.linked.link./shared", f"file://{tmp_path}")
    for named in (f"{tmp_path}/no scheme", f"file:{tmp_path}/one", "viewfs://linked/shared/far"):
        monkeypatch.setattr(storage, "shared_dir", lambda spark, named=named: named)
        assert sorted(tuple(r) for r in acquired.jdbc_pairs(spark, DATA).collect()) == want and want


def test_a_search_of_many_pages_is_a_bounded_number_of_tasks(spark, tmp_path):
    def search(query, start, length):
        with open(f"{tmp_path}/{start}", "a") as f:
            f.write("x")
        if start == 1230 and os.path.getsize(f"{tmp_path}/{start}") == 1:
            raise ConnectionError(start)
        return 4005, [{"columns": {"itemid": str(i)}} for i in range(start, min(4005, start + length))]

    rows = spark.read.format(paged.source(spark, search, "long_search")).options(page="10", pause="0").load()
    assert rows.rdd.getNumPartitions() <= paged.TASKS
    assert sorted((r["place"], int(r["i"])) for r in rows.select("place", F.get_json_object("hit", "$.columns.itemid").alias("i")).collect()) == [(i, i) for i in range(4005)]
    asked = {int(f): os.path.getsize(tmp_path / f) for f in os.listdir(tmp_path)}
    assert set(asked) == set(range(0, 4005, 10)) and asked[1230] == asked[1220] + 1 == asked[1240] + 1  # the failed page alone


def test_hits_are_read_without_their_documents(spark, tmp_path, monkeypatch):
    texts = ['<p>a ","columns":{} b</p>', "two\nlines\r\nand \u2028", None, "", *(f"text {i}" for i in range(300))]
    rows = spark.createDataFrame(list(enumerate(texts)), "place long, html string").select("place", F.struct(F.col("place").cast("string").alias("itemid")).alias("columns"), "html")
    options = {"folder": f"file://{tmp_path}/s", "places": str(saved.save(rows, f"file://{tmp_path}/s", "place"))}
    read, loads = [], json.loads
    monkeypatch.setattr(saved.json, "loads", lambda line: read.append(line) or loads(line))
    assert saved.service(options)("", 0, 304) == (304, [{"columns": {"itemid": str(i)}} for i in range(304)])
    assert not [line for line in read if b"text" in line]
    fetch = saved.text(options)
    assert [fetch(str(i)) for i in range(304)] == texts and fetch("304") is None


def test_patterns_are_tried_only_where_their_words_are_and_none_is_missed(spark):
    rng = random.Random(7)
    odd, rows = str.maketrans({"i": "ı", "I": "İ", "s": "ſ", "k": "\u212a"}), []
    for said in [*fixtures.ASSESSMENTS, *fixtures.CONCLUSIONS, *(w for w in X._MARKER_HAS), *X._CONCLUSION_HAS]:
        for form in (said, said.upper(), said.lower(), said.swapcase(), said.translate(odd), said.upper().translate(odd), said.replace(" ", "\u3000"), said[1:]):
            for before in ("", "Ab. Cd \n", "No stop \x85\n", "İı. "):
                rows.append((before + form + rng.choice(["", "\n", " tail. And it holds that. "]),))
    df = spark.createDataFrame(rows, "t string")
    t, space = F.col("t"), r"(?U)\s+\z"
    cut, parts = F.coalesce(*(X.before_sentence(t, p) for p in X.CONCLUSORY)), F.split(t, "(?dimuU)(?:" + "|".join(X.MARKERS) + ")", 2)
    want = F.when(F.size(parts) > 1, F.struct(F.regexp_replace(parts[0], space, "").alias("text"), F.lit(X.MARKED).alias("method")))
    want = want.when(cut.isNotNull(), F.struct(F.regexp_replace(cut, space, "").alias("text"), F.lit(X.CONCLUDED).alias("method"))).otherwise(F.struct(t.alias("text"), F.lit(X.NO_TRUNCATION).alias("method")))
    got = df.select("t", X.truncate(t).alias("got"), want.alias("want")).collect()
    assert [r for r in got if r["got"] != r["want"]] == [] and len({r["got"]["method"] for r in got}) == 3
    ends = spark.createDataFrame([("a" + chr(c),) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000], "t string")
    assert ends.where(X.rstrip(t) != F.regexp_replace(t, space, "")).count() == 0
