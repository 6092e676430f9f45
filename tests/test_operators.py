import json

import pytest
from pyspark.sql import functions as F

from judgeloom import schemas
from judgeloom.functions import text as X
from judgeloom.operators import corpus, sinks, tables
from judgeloom.plans import stages
from judgeloom.sources import readers, responder, search
from judgeloom.streaming import refresh


def test_schemas_parse(spark):
    assert all(schemas.schema(n).fields for n in schemas.NAMES)


def test_dedupe_and_upsert(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, None), (None, 4, "n")], "k string, ord int, v string")
    assert {(r["k"], r["v"]) for r in tables.dedupe(df, ["k"], "ord", "last").collect()} == {("a", "y"), ("b", None), (None, "n")}
    assert {(r["k"], r["v"]) for r in tables.dedupe(df, ["k"], "ord", "first").collect()} == {("a", "x"), ("b", None), (None, "n")}
    new = spark.createDataFrame([("b", 0, "new"), ("c", 1, "z"), ("", 2, "empty")], "k string, ord int, v string")
    out = [r["v"] for r in tables.upsert(df, new, ["k"]).orderBy("place_source", "place").collect()]
    assert out == ["y", "new", "empty", "z"]
    again = tables.dedupe(tables.dedupe(df, ["k"], "ord"), ["k"], "ord")
    assert again.count() == 3


def test_json_and_csv_sources(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps([{"item_id": "1", "article": "8"}, {"item_id": "2", "article": "P1-1", "excluded": True}]))
    rows = readers.json_array(spark, f"{tmp_path}/cases.json", "case").orderBy("ord").collect()
    assert [(r["ord"], r["article"], r["excluded"]) for r in rows] == [(0, "8", None), (1, "P1-1", True)]
    assert readers.json_array(spark, f"{tmp_path}/none.json", "case", missing_ok=True).count() == 0
    (tmp_path / "m1").mkdir()
    (tmp_path / "m1" / "baseline_results.json").write_text(json.dumps([{"case_name": "c", "ratings": [1, 2]}]))
    got = readers.result_files(spark, str(tmp_path), "baseline").first()
    assert (got["model"], got["ratings"]) == ("m1", [1, 2]) and readers.result_files(spark, str(tmp_path), "rq1") is None
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "m_full.csv").write_text('case_name,article,violation_label,avg_rating,is_accurate,num_abstentions,num_samples,sample_ratings\n"a, ""b""",8,violation,2.5,True,0,2,"[2, 3]"\n')
    r = readers.evaluations(spark, f"{tmp_path}/e").first()
    assert (r["case_name"], r["article"], r["is_accurate"], r["sample_ratings"], r["file"]) == ('a, "b"', "8", True, [2, 3], "m_full.csv")
    assert [r["file"] for r in readers.files(spark, f"{tmp_path}/e", prefix="m_").collect()] == ["m_full.csv"]
    wide = spark.createDataFrame([("c", "8", "violation", [1, 4, 3], [1, 2])], "case_name string, article string, violation_label string, original_ratings array<int>, challenged_ratings array<int>")
    assert [(r["sample_idx"], r["changed"], r["is_accurate_challenged"]) for r in readers.long_challenge(wide).collect()] == [(0, False, True), (1, True, True)]


def test_case_filters(spark):
    rows = [("d", "c", "x" * 600, "UKR", "2020-01-01", "ENG"), ("A Translation", "c", "x" * 600, "UKR", "2020-01-01", "ENG"), ("d", None, "x" * 600, "UKR", "2020-01-01", "ENG"), ("d", "c", "x", "UKR", "2020-01-01", "ENG"), ("d", "c", "x" * 600, "O'R", "2021-01-01", "ENG")]
    df = spark.createDataFrame(rows, "doc_name string, conclusion string, full_text string, respondent string, kp_date string, language_iso string")
    assert readers.filtered_cases(df).count() == 2 and readers.filtered_cases(df, country="O'R").count() == 1 and readers.filtered_cases(df, until="2021-01-01", since="2020-01-01", language="ENG").count() == 1


def test_resume(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "item_id")
    assert readers.fresh(df, f"{tmp_path}/out", "item_id").count() == 5
    df.where("item_id < 2").write.parquet(f"{tmp_path}/out")
    assert readers.fresh(df, f"{tmp_path}/out", "item_id").count() == 3
    assert readers.cached_or(spark, f"{tmp_path}/out", lambda: 1 / 0).count() == 2


def fake_search(expression, start, length):
    hits = [{"columns": {"itemid": f"{i}", "docname": f"CASE OF N{i} v. Spain", "kpdate": "2020-02-03T00:00:00", "article": "8;3", "conclusion": "Violation of Article 8" if i % 2 else ""}} for i in range(23)]
    return 23, hits[start : start + length]


def fake_fetch(item):
    return None if item == "3" else "<p>short" if item == "4" else f"<p>{'Long text. ' * 80}</p>"


def test_scrape(spark, tmp_path):
    assert search.query("2020-01-01", "", "esp", fixed=("a:b",)) == 'a:b AND ((languageisocode:"ENG")) AND ((documentcollectionid:"JUDGMENTS")) AND ((respondent:"ESP")) AND ((kpdate:[2020-01-01T00:00:00 TO *]))'
    assert search.hits(spark, fake_search, "q", 5).count() == 23
    rows = stages.scrape(spark, fake_search, fake_fetch, "q").collect()
    assert len(rows) == 21 and {r["violation_label"] for r in rows} == {"violation", "unknown"}
    spark.createDataFrame([("0",), ("1",)], "item_id string").write.parquet(f"{tmp_path}/seen")
    assert stages.scrape(spark, fake_search, fake_fetch, "q", existing=f"{tmp_path}/seen", dry_run=True).count() == 21


def cases(spark):
    rows = [(f"i{k // 2}", f"name {k // 2}", "8" if k % 2 else "3", "violation" if k % 3 else "no_violation", f"text {k} " * 5) for k in range(12)]
    return spark.createDataFrame(rows, "item_id string, case_name string, article string, violation_label string, full_case_text string").withColumn("full_case_text_no_verdict", F.col("full_case_text"))


def test_stages_with_a_scripted_model(spark):
    held = cases(spark)
    base = stages.baseline(held, responder.scripted, "m", 6)
    rows = base.collect()
    assert len(rows) == 12 and all(len(r["ratings"]) == 6 for r in rows)
    for r in rows:
        assert r["avg_rating"] == pytest.approx(sum(r["ratings"]) / 6) and r["accurate"] == (r["prediction"] == r["violation_label"])
    made = stages.summaries(held, lambda a: responder.respond(a, lambda q: "ERROR: x" if q["custom_id"].endswith("_2") else "short facts", workers=2), "m")
    assert made.count() == 36 and made.where("summary = ''").count() == 12
    assert stages.on_summaries(held, made, base, responder.scripted, "m", 3).count() == 36
    framed = stages.on_framings(held, made, base, responder.scripted, "m", 3)
    assert framed.groupBy("framing").count().count() == 3 and framed.where("aligned_with_baseline is null").count() == 0
    again = stages.reconsidered(held, responder.scripted, "m", 4)
    for r in again.collect():
        changed = sum(a != b for a, b in zip(r["original_ratings"], r["challenged_ratings"], strict=True))
        assert r["change_rate"] == changed / 4 and len(r["individual_changes"]) == 4
    silent = stages.reconsidered(held, lambda a: responder.scripted(a).where("NOT endswith(custom_id, '_followup')"), "m", 4)
    assert silent.where("prediction_changed OR change_rate > 0").count() == 0
    cells = stages.matrix(held, {"full": F.col("full_case_text"), "none": F.lit("")}, ["a", "b"], responder.scripted, 2)
    assert cells.count() == 4


def test_responder_retries(spark):
    def answer(request):
        if request["custom_id"] == "bad":
            raise responder.Refused(400)
        if request["custom_id"] == "busy":
            raise responder.Refused(503)
        return "5"

    asked = spark.createDataFrame([("ok",), ("bad",), ("busy",)], "custom_id string")
    assert {r["custom_id"]: r["response"] for r in responder.respond(asked, answer, 2, 0.0).collect()} == {"ok": "5", "bad": "", "busy": ""}


def test_parsed_answers_and_ratings_of_a_case(spark):
    rows = [("c", "c_2", "Answer: 4"), ("c", "c_1", '```json\n{"leaks_verdict": true}\n```'), ("c", "c_0", "1"), ("d", "d_0", None)]
    held = spark.createDataFrame(rows, "item_id string, custom_id string, response string")
    assert [r["answer"] and r["answer"]["leaks_verdict"] for r in responder.parsed(held, "leaks_verdict boolean").orderBy("custom_id").collect()] in ([None, True, None, None], [None, True, False, None])
    got = {r["item_id"]: (r["mean"], r["ratings"]) for r in responder.ratings(held, ["item_id"]).collect()}
    assert got == {"c": (8 / 3, [1, 3, 4]), "d": (3.0, [3])}


def test_verdict_removal(spark):
    long = "Plain facts. " * 60
    rows = [("1", long + "\nMERITS\n" + "verdict " * 20), ("2", long + "Beta leaks here. " + long), ("3", long), ("4", "tiny")]
    held = spark.createDataFrame([(i, f"n{i}", "8", "violation", t) for i, t in rows], "item_id string, case_name string, article string, violation_label string, full_case_text string")

    def verify(asked):
        leak = F.col("text").contains("Beta")
        body = F.to_json(F.struct(leak.alias("leaks_verdict"), F.when(leak, F.array(F.lit("Beta leaks here."))).alias("leaking_sentences")))
        return asked.select("item_id", "article", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("response"))

    out = {r["item_id"]: r for r in stages.without_verdicts(held, {"v1": verify, "v2": lambda a: a.select("item_id", "article", F.lit("ERROR: no").alias("response"))}).collect()}
    assert out["1"]["verdict_removal_method"] == X.MARKED and out["1"]["full_case_text_no_verdict"] == long.rstrip()
    assert "Beta" not in out["2"]["full_case_text_no_verdict"] and out["2"]["verdict_removal_method"].endswith(X.REMOVED)
    assert out["3"]["verdict_removal_method"] == X.NO_TRUNCATION and out["4"]["excluded"] and len(out) == 4


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a_b", [1, 2], 0.5), ("c%", [3], None)], "k string, r array<int>, v double")
    sinks.csv(df, f"{tmp_path}/c")
    assert {r["r"] for r in spark.read.csv(f"{tmp_path}/c", header=True, escape='"').collect()} == {"[1,2]", "[3]"}
    sinks.json_lines(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    sinks.mark_done(spark, str(tmp_path), "m", "rq1")
    assert [(r["model"], r["stage"]) for r in sinks.markers(spark, str(tmp_path)).collect()] == [("m", "rq1")]
    assert r"c\% & " in sinks.latex(df.select("k", "v"), "C", "t") and sinks.percent_text(None) == "--" and sinks.percent_text(0.123, True) == "+12.3"


def test_refresh_batch_and_stream(spark, tmp_path):
    fields = "item_id string, article string, decision_date string, ord int"
    old = spark.createDataFrame([("1", "8", "2020-01-01", 0), ("2", "3", "", 1)], fields)
    new = spark.createDataFrame([("1", "3", "2021-01-01", 0), ("3", "8", "2022-01-01", 1)], fields)
    assert [r["item_id"] for r in stages.refresh(old, new).collect()] == ["3", "1", "2"]
    assert stages.refresh(old, new, by_item=False).count() == 4
    for k, df in enumerate((old, new)):
        df.write.parquet(f"{tmp_path}/in", mode="append")
        refresh.run(spark.readStream.schema(fields).parquet(f"{tmp_path}/in"), f"{tmp_path}/table", ["item_id", "article"], "ord", f"{tmp_path}/ck").awaitTermination()
        assert refresh.current(spark, f"{tmp_path}/table").count() == (2, 4)[k]
