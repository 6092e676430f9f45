"""Composite stages as queries over the documents: a scripted responder answers by the whole prompt, which SQL builds again."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import templates
from ..sources import fixtures, responder
from ..storage import written
from . import stages
from .ratings import nudged, rounded

SAMPLES = 5
KEY = "item_id, article"

CASES = """cs AS (SELECT doc_id::VARCHAR AS item_id, CASE WHEN doc_id%2=0 THEN '3' ELSE '8' END AS article, source AS case_name, CASE WHEN doc_id%3=0 THEN 'violation' ELSE 'no_violation' END AS violation_label, text FROM documents)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("item_id"),
        F.when(F.col("doc_id") % 2 == 0, "3").otherwise("8").alias("article"),
        F.col("source").alias("case_name"),
        F.when(F.col("doc_id") % 3 == 0, "violation").otherwise("no_violation").alias("violation_label"),
        F.col("text").alias("full_case_text"),
        F.col("text").alias("full_case_text_no_verdict"),
    )


def _asked(framing: str, body: str) -> str:
    """The prompt of a framing in SQL; body: an expression."""
    slots = {"case_text": body, "article": "article", "article_title": f"CASE article WHEN '3' THEN '{templates.ARTICLE_TITLES['3']}' ELSE '{templates.ARTICLE_TITLES['8']}' END"}
    parts = re.split(r"\{(\w+)\}", templates.TEMPLATES[framing])
    quoted = lambda t: "'" + t.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"
    return "(" + "||".join(slots[x] if k % 2 else quoted(x) for k, x in enumerate(parts)) + ")"


_SYSTEM = f"'system:{templates.SYSTEM}'||chr(10)||'user:'"


def _hash(said: str, ids: str) -> str:
    """The number that the scripted responder has for a request, in SQL."""
    return f"('0x' || substr(md5({said} || '#' || {ids}),1,6))::BIGINT"


#: The first rating of a hash h: no answer and errors abstain.
_FIRST = f"CASE WHEN h%{responder.SILENT}=0 OR h%{responder.FAILING}=0 THEN 3 ELSE h%5+1 END"
_FULL = "substr(coalesce(text,''),1,50000)"


def _tally(name: str, keys: str) -> str:
    """Tables of votes, means and ratings a case (v_name) from a table r_name of a rating a sample."""
    return f"""m_{name} AS (SELECT {keys}, any_value(violation_label) AS violation_label, string_agg(rating::VARCHAR, ',' ORDER BY i) AS ratings, avg(rating::DOUBLE) AS avg_rating FROM r_{name} GROUP BY {keys}),
s_{name} AS (SELECT {keys}, CASE WHEN rating<3 THEN 'violation' WHEN rating>3 THEN 'no_violation' ELSE 'abstention' END AS side, count(*) AS n, min(i) AS f FROM r_{name} GROUP BY ALL),
w_{name} AS (SELECT {keys}, side AS prediction FROM s_{name} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, f)=1),
v_{name} AS (SELECT *, prediction = violation_label AS accurate FROM m_{name} JOIN w_{name} USING ({keys}))"""


def _voted(name: str, keys: str, ids: str, prompt: str, source: str = "cs") -> str:
    """r_name and v_name over the grid of keys, from prompts."""
    return f"r_{name} AS (SELECT *, {_FIRST} AS rating FROM (SELECT {keys}, violation_label, i, {prompt} AS prompt, {_hash(_SYSTEM + '||' + prompt, ids)} AS h FROM {source}, range({SAMPLES}) t(i))),\n" + _tally(name, keys)


_BASE = _voted("b", KEY, "concat_ws('_', item_id, article, 'sample', i)", _asked("predictive", _FULL))
#: Summaries: what was answered, empty where nothing or an error was.
_MADE = f"""made AS (SELECT {KEY}, text, violation_label, version, CASE WHEN h%{responder.SILENT}=0 OR h%{responder.FAILING}=0 THEN '' ELSE 'Answer: ' || (h%5+1) END AS summary
FROM (SELECT *, {_hash(_SYSTEM + "||'Summarise:'||chr(10)||chr(10)||" + _FULL, "concat_ws('_', item_id, article, 'summary', version)")} AS h FROM cs, range(3) v(version)))"""


def _said(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays of ratings as text, so that any engine compares them."""
    return rounded(df.withColumns({c: F.array_join(F.transform(c, lambda r: r.cast("string")), ",") for c in columns}))


def stage_baseline(spark, sf_dir):
    """Every case rated on its text: votes, accuracy, abstentions."""
    got = stages.baseline(_cases(spark, sf_dir), responder.scripted, "m", SAMPLES)
    return _said(got, "ratings").select("item_id", "article", "violation_label", "prediction", "accurate", "abstained", "ratings", "avg_rating")


STAGE_BASELINE = f"WITH {CASES}, {_BASE} SELECT {KEY}, violation_label, prediction, accurate, prediction='abstention' AS abstained, ratings, round(avg_rating,6) AS avg_rating FROM v_b"


def stage_summaries(spark, sf_dir):
    """Three summaries of every case, as they were answered."""
    return rounded(stages.summaries(_cases(spark, sf_dir), responder.scripted, "m"))


STAGE_SUMMARIES = f"WITH {CASES}, {_MADE} SELECT {KEY}, version, summary FROM made"


def stage_on_summaries(spark, sf_dir):
    """Every summary version rated and compared with the baseline, with accuracy and alignment of each version."""
    cases = _cases(spark, sf_dir)
    got = stages.on_summaries(cases, stages.summaries(cases, responder.scripted, "m"), stages.baseline(cases, responder.scripted, "m", SAMPLES), responder.scripted, "m", SAMPLES)
    return rounded(got.groupBy("version").agg(F.count("*").alias("n"), F.avg(F.col("accurate").cast("double")).alias("accuracy"), F.avg(F.col("aligned").cast("double")).alias("alignment")))


STAGE_ON_SUMMARIES = f"""WITH {CASES}, {_MADE}, {_BASE}, {_voted("q", KEY + ", version", "concat_ws('_', item_id, article, version, 'sample', i)", _asked("predictive", "summary"), "made")}
SELECT version, count(*) AS n, round(avg(q.accurate::INT::DOUBLE),6) AS accuracy, round(avg((q.prediction=b.prediction)::INT::DOUBLE),6) AS alignment FROM v_q q JOIN v_b b USING ({KEY}) GROUP BY version"""


def stage_on_framings(spark, sf_dir):
    """Every framing rated on the first summary and compared with the baseline."""
    cases = _cases(spark, sf_dir)
    got = stages.on_framings(cases, stages.summaries(cases, responder.scripted, "m"), stages.baseline(cases, responder.scripted, "m", SAMPLES), responder.scripted, "m", SAMPLES)
    return _said(got, "ratings").select("item_id", "article", "framing", "prediction", "accurate", "aligned_with_baseline", "ratings")


_BODY = "coalesce(nullif(summary,''), substr(coalesce(text,''),1,5000))"
_BY_FRAMING = "CASE framing " + " ".join(f"WHEN '{f}' THEN {_asked(f, _BODY)}" for f in templates.FRAMINGS) + " END"
STAGE_ON_FRAMINGS = f"""WITH {CASES}, {_MADE}, {_BASE}, {_voted("q", KEY + ", framing", "concat_ws('_', item_id, article, framing, 'sample', i)", _BY_FRAMING, "(SELECT * FROM made WHERE version=0) made, (VALUES ('predictive'),('normative'),('factual')) f(framing)")}
SELECT {KEY}, framing, q.prediction, q.accurate, q.prediction=b.prediction AS aligned_with_baseline, q.ratings FROM v_q q JOIN v_b b USING ({KEY})"""


def stage_reconsidered(spark, sf_dir):
    """Every sample asked again behind its own answer: predictions before and after, changes and their directions."""
    got = stages.reconsidered(_cases(spark, sf_dir), responder.scripted, "m", SAMPLES).withColumn("individual_changes", F.array_join("individual_changes", ","))
    return _said(got, "original_ratings", "challenged_ratings").drop("case_name", "violation_label")


_AGAIN = _hash(f"{_SYSTEM}||prompt||chr(10)||'assistant:'||rating||chr(10)||'user:{stages.CHALLENGE}'", "concat_ws('_', item_id, article, 'sample', i, 'followup')")
STAGE_RECONSIDERED = f"""WITH {CASES}, {_BASE}, r_a AS (SELECT * REPLACE (CASE WHEN g%{responder.SILENT}=0 THEN rating WHEN g%{responder.FAILING}=0 THEN 3 ELSE g%5+1 END AS rating) FROM (SELECT *, {_AGAIN} AS g FROM r_b)), {_tally("a", KEY)},
d AS (SELECT {KEY}, avg((a.rating<>b.rating)::INT::DOUBLE) AS change_rate, string_agg(CASE WHEN a.rating>b.rating THEN 'away' WHEN a.rating<b.rating THEN 'toward' ELSE 'unchanged' END, ',' ORDER BY i) AS individual_changes FROM r_b b JOIN r_a a USING ({KEY}, i) GROUP BY ALL)
SELECT {KEY}, b.ratings AS original_ratings, a.ratings AS challenged_ratings, b.prediction AS original_prediction, a.prediction AS challenged_prediction, b.accurate AS original_accurate, a.accurate AS challenged_accurate, b.prediction<>a.prediction AS prediction_changed, round(change_rate,6) AS change_rate, individual_changes FROM v_b b JOIN v_a a USING ({KEY}) JOIN d USING ({KEY})"""


def stage_matrix(spark, sf_dir):
    """Every text by every evaluator: accuracy and abstentions."""
    texts = {"full": F.col("full_case_text"), "head": F.substring("full_case_text", 1, 5000), "none": F.lit("")}
    return rounded(stages.matrix(_cases(spark, sf_dir), texts, ["one", "two"], responder.scripted, SAMPLES))


_TEXTS = "CASE summary WHEN 'full' THEN coalesce(text,'') WHEN 'head' THEN substr(coalesce(text,''),1,5000) ELSE '' END"
STAGE_MATRIX = f"""WITH {CASES}, {_voted("q", "evaluator, summary, " + KEY, "concat_ws('_', evaluator, summary, item_id, article, 'sample', i)", _asked("predictive", _TEXTS), "cs, (VALUES ('full'),('head'),('none')) s(summary), (VALUES ('one'),('two')) e(evaluator)")},
x AS (SELECT summary, evaluator, sum((rating=3)::INT)::DOUBLE/count(*) AS abstention_rate FROM r_q GROUP BY ALL)
SELECT summary, evaluator, round(avg((CASE WHEN violation_label='violation' THEN avg_rating<3 ELSE avg_rating>3 END)::INT::DOUBLE),6) AS accuracy, round(any_value(abstention_rate),6) AS abstention_rate FROM v_q JOIN x USING (summary, evaluator) GROUP BY summary, evaluator"""


def matrix_pivots(spark, sf_dir):
    """The matrix with evaluators as columns, accuracies and abstentions side by side."""
    texts = {"full": F.col("full_case_text"), "head": F.substring("full_case_text", 1, 5000), "none": F.lit("")}
    right, silent = stages.pivots(stages.matrix(_cases(spark, sf_dir), texts, ["one", "two"], responder.scripted, SAMPLES), ["one", "two"])
    tag = lambda df, name: df.select("summary", *(F.col(c).alias(f"{name}_{c}") for c in ("one", "two")))
    return rounded(tag(right, "accuracy").join(tag(silent, "abstention"), "summary"))


MATRIX_PIVOTS = "WITH c AS (" + STAGE_MATRIX.replace("round(avg(", "(avg(").replace(",6) AS accuracy", ") AS accuracy").replace("round(any_value(abstention_rate),6)", "any_value(abstention_rate)") + ") SELECT summary, " + ", ".join(f"round(max({c}) FILTER (evaluator='{e}'),6) AS {n}_{e}" for n, c in (("accuracy", "accuracy"), ("abstention", "abstention_rate")) for e in ("one", "two")) + " FROM c GROUP BY summary"


def cross_model_summary(spark, sf_dir):
    """Fifteen figures of four stages: one model has all stages, one only the first two and three samples, one none."""
    cases = _cases(spark, sf_dir)
    # three stages read the summaries and the baselines: they are asked for once
    made, ask = written(stages.summaries(cases, responder.scripted, "m"), "summaries"), responder.scripted
    base = {n: written(stages.baseline(cases, ask, "m", n), "baseline") for n in (SAMPLES, 3)}
    tag = lambda df, model: df.withColumn("model", F.lit(model))
    both = lambda stage: tag(stage(SAMPLES), "one").unionByName(tag(stage(3), "two"))
    models = spark.createDataFrame([("one",), ("two",), ("three",)], "model string")
    out = stages.summary(
        models, both(lambda n: base[n]), both(lambda n: stages.on_summaries(cases, made, base[n], ask, "m", n)),
        tag(stages.on_framings(cases, made, base[SAMPLES], ask, "m", SAMPLES), "one"), tag(stages.reconsidered(cases, ask, "m", SAMPLES), "one"),
    )
    return rounded(out)


def _few(name: str, of: str, keys: str) -> str:
    """The tables of another with its first three samples."""
    return f"r_{name} AS (SELECT * FROM r_{of} WHERE i < 3), " + _tally(name, keys)


_RATE = "avg({}::INT::DOUBLE)"
CROSS_MODEL_SUMMARY = f"""WITH {CASES}, {_MADE}, {_BASE}, {_few("b3", "b", KEY)}, {_voted("q", KEY + ", version", "concat_ws('_', item_id, article, version, 'sample', i)", _asked("predictive", "summary"), "made")}, {_few("q3", "q", KEY + ", version")},
{_voted("f", KEY + ", framing", "concat_ws('_', item_id, article, framing, 'sample', i)", _BY_FRAMING, "(SELECT * FROM made WHERE version=0) made, (VALUES ('predictive'),('normative'),('factual')) f(framing)")},
r_a AS (SELECT * REPLACE (CASE WHEN g%{responder.SILENT}=0 THEN rating WHEN g%{responder.FAILING}=0 THEN 3 ELSE g%5+1 END AS rating) FROM (SELECT *, {_AGAIN} AS g FROM r_b)), {_tally("a", KEY)},
x AS (SELECT {KEY}, avg((a.rating<>b.rating)::INT::DOUBLE) AS change_rate FROM r_b b JOIN r_a a USING ({KEY}, i) GROUP BY ALL),
base AS (SELECT 'one' AS model, * FROM v_b UNION ALL SELECT 'two', * FROM v_b3), one AS (SELECT 'one' AS model, q.accurate, q.prediction=b.prediction AS aligned FROM v_q q JOIN v_b b USING ({KEY}) UNION ALL SELECT 'two', q.accurate, q.prediction=b.prediction FROM v_q3 q JOIN v_b3 b USING ({KEY})),
p1 AS (SELECT model, {_RATE.format("accurate")} AS a, {_RATE.format("(prediction='abstention')")} AS b, avg(avg_rating) AS c FROM base GROUP BY 1), p2 AS (SELECT model, {_RATE.format("accurate")} AS a, {_RATE.format("aligned")} AS b FROM one GROUP BY 1),
p3 AS (SELECT 'one' AS model, {", ".join(f"{_RATE.format('f.accurate')} FILTER (framing='{f}') AS {f}_a, {_RATE.format('(f.prediction=b.prediction)')} FILTER (framing='{f}') AS {f}_b" for f in templates.FRAMINGS)} FROM v_f f JOIN v_b b USING ({KEY})),
p4 AS (SELECT 'one' AS model, {_RATE.format("b.accurate")} AS a, {_RATE.format("a.accurate")} AS b, {_RATE.format("(b.prediction<>a.prediction)")} AS c, avg(change_rate) AS d FROM v_b b JOIN v_a a USING ({KEY}) JOIN x USING ({KEY}))
SELECT model, round(p1.a,6) AS baseline_accuracy, round(p1.b,6) AS baseline_abstention, round(p1.c,6) AS baseline_avg_rating, round(p2.a,6) AS rq1_accuracy, round(p2.b,6) AS rq1_alignment, {", ".join(f"round({f}_a,6) AS rq2_{f}_accuracy, round({f}_b,6) AS rq2_{f}_alignment" for f in templates.FRAMINGS)},
round(p4.a,6) AS rq3_orig_accuracy, round(p4.b,6) AS rq3_chal_accuracy, round(p4.c,6) AS rq3_change_rate, round(p4.d,6) AS rq3_avg_individual_change
FROM (VALUES ('one'),('two'),('three')) m(model) LEFT JOIN p1 USING (model) LEFT JOIN p2 USING (model) LEFT JOIN p3 USING (model) LEFT JOIN p4 USING (model)"""


_NAMES = "stage_baseline stage_summaries stage_on_summaries stage_on_framings stage_reconsidered stage_matrix matrix_pivots cross_model_summary".split()
QUERIES = {name: globals()[name] for name in _NAMES}
ORACLES = {name: nudged(globals()[name.upper()]) for name in _NAMES}
