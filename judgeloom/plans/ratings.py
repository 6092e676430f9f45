"""Queries over ratings: reducing samples, comparing paired conditions, reporting by group. Each has its SQL counterpart."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ratings as R
from ..functions import stats
from ..functions.templates import title
from ..operators import bootstrap, pairing, reduce, running, tables
from ..sources import fixtures

KEYS = ["evaluator", "framing", "case_id", "art"]
PAIR = ["evaluator", "case_id", "art"]

SAMPLES = """sx AS (SELECT * FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) v(sample_idx)),
fr AS (SELECT * FROM (VALUES (0,'predictive'),(1,'normative'),(2,'factual')) f(fid,framing)),
pairs AS (SELECT o_orderkey AS case_id, CAST(o_orderkey % 7 AS INT) AS art, o_orderpriority AS evaluator, o_custkey AS custkey,
  CASE WHEN o_orderkey % 2 = 0 THEN 'violation' ELSE 'no_violation' END AS violation_label, CAST(floor(o_totalprice) AS BIGINT) AS h FROM orders),
samples AS (SELECT case_id, art, evaluator, violation_label, framing, sample_idx, custkey,
  CAST(CASE WHEN (case_id*31 + sample_idx*17 + fid*5) % 23 = 0 THEN 1 + (h + sample_idx + fid) % 5
    WHEN h % 10 < 7 THEN CASE WHEN violation_label='violation' THEN 1 + (h+sample_idx) % 3 ELSE 3 + (h+sample_idx) % 3 END
    ELSE 1 + (h + sample_idx*3) % 5 END AS INT) AS rating
  FROM pairs CROSS JOIN fr CROSS JOIN sx)"""
CASES = (
    SAMPLES
    + """, means AS (SELECT evaluator, framing, case_id, art, violation_label = 'violation' AS is_violation, any_value(custkey) AS custkey, avg(rating::DOUBLE) AS avg_rating, count(*) AS num_samples,
  count(*) FILTER (rating = 3) AS num_abstentions FROM samples GROUP BY ALL),
sides AS (SELECT evaluator, framing, case_id, art, CASE WHEN rating < 3 THEN 'violation' WHEN rating > 3 THEN 'no_violation' ELSE 'abstention' END AS side, count(*) AS n, min(sample_idx) AS first FROM samples GROUP BY ALL),
votes AS (SELECT evaluator, framing, case_id, art, side AS prediction FROM sides QUALIFY row_number() OVER (PARTITION BY evaluator, framing, case_id, art ORDER BY n DESC, first) = 1),
cases AS (SELECT m.*, v.prediction, CASE WHEN is_violation THEN avg_rating < 3 ELSE avg_rating > 3 END AS is_accurate, avg_rating < 3 AS says_violation FROM means m JOIN votes v USING (evaluator, framing, case_id, art))"""
)


#: Added before rounding, so that a figure that ends in a five at the seventh place rounds alike in any engine.
NUDGE = "1e-9"


def nudged(sql: str) -> str:
    """SQL with every round(x,6) as round((x)+NUDGE,6)."""
    out, at = "", 0
    for m in re.finditer(r"(?<![a-z_])round\(", sql):
        if m.start() < at:
            continue
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[m.end() : end - 1]
        if inner.endswith(",6"):
            out += sql[at : m.start()] + f"round(({nudged(inner[:-2])})+{NUDGE},6)"
            at = end
    return out + sql[at:]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, integers as long: what both engines give alike."""
    as_: dict[str, Column] = {}
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            as_[name] = F.round(F.col(name) + F.lit(float(NUDGE)), 6)
        elif kind in ("int", "smallint", "tinyint"):
            as_[name] = F.col(name).cast("long")
    return df.withColumns(as_)


def judged(spark: SparkSession, sf_dir: str, *framings: str) -> DataFrame:
    samples = fixtures.samples(spark, sf_dir, *framings)
    return reduce.voted(samples, [*KEYS, "violation_label"], F.col("violation_label") == "violation")


def _versus(spark: SparkSession, sf_dir: str, *others: str) -> DataFrame:
    """Predictive cases beside those of the other framings."""
    every = judged(spark, sf_dir, "predictive", *others).select(*KEYS, "is_violation", "avg_rating", "is_accurate", "says_violation", "prediction")
    base = every.where("framing = 'predictive'").drop("framing")
    pairs = pairing.paired(base, every.where("framing != 'predictive'"), PAIR)
    return pairs.withColumnRenamed("framing_other", "framing")


def paired_mcnemar(spark, sf_dir):
    """Framings against the predictive one: accuracy, exact McNemar, alignment with its interval."""
    return rounded(pairing.comparison(_versus(spark, sf_dir, "normative", "factual"), ["evaluator", "framing"]))


_TAIL = "least(1.0, 2 * (SELECT coalesce(sum(exp(lgamma(n01+n10+1) - lgamma(k+1) - lgamma(n01+n10-k+1) + (n01+n10)*ln(0.5))), 0) FROM unnest(range(0, least(n01,n10)+1)) t(k)))"
_Z = "1.959963984540054"
PAIRED_MCNEMAR = f"""WITH {CASES}, j AS (SELECT b.evaluator, o.framing, b.is_accurate AS ba, o.is_accurate AS oa, b.says_violation = o.says_violation AS al FROM cases b JOIN cases o USING (evaluator, case_id, art) WHERE b.framing = 'predictive' AND o.framing <> 'predictive'),
s AS (SELECT evaluator, framing, count(*) AS n, avg(ba::INT::DOUBLE) AS a0, avg(oa::INT::DOUBLE) AS a1, count(*) FILTER (NOT ba AND oa) AS n01, count(*) FILTER (ba AND NOT oa) AS n10, avg(al::INT::DOUBLE) AS al, count(*) FILTER (al) AS k FROM j GROUP BY ALL),
p AS (SELECT *, CASE WHEN n01+n10=0 THEN 1.0 ELSE {_TAIL} END AS p FROM s)
SELECT evaluator, framing, n, round(a0,6) AS base_accuracy, round(a1,6) AS other_accuracy, n01, n10, round(al,6) AS alignment, k AS n_aligned, round(a1-a0,6) AS delta, round(p,6) AS p_value,
round(greatest(0.0,(al+{_Z}*{_Z}/(2*n))/(1+{_Z}*{_Z}/n) - {_Z}*sqrt(al*(1-al)/n+{_Z}*{_Z}/(4.0*n*n))/(1+{_Z}*{_Z}/n)),6) AS alignment_low, round(least(1.0,(al+{_Z}*{_Z}/(2*n))/(1+{_Z}*{_Z}/n) + {_Z}*sqrt(al*(1-al)/n+{_Z}*{_Z}/(4.0*n*n))/(1+{_Z}*{_Z}/n)),6) AS alignment_high, p < 0.05 AS significant FROM p"""


def case_metrics(spark, sf_dir):
    """Per case: mean, distance score, abstentions, accuracy, mean of the samples' scores."""
    cases = reduce.cases(fixtures.samples(spark, sf_dir, "predictive"), ["evaluator", "case_id", "art", "violation_label"])
    m = cases.select("evaluator", "case_id", "art", R.metrics(F.col("ratings"), F.col("violation_label") == "violation").alias("m"))
    scores = F.aggregate("m.sample_scores", F.lit(0.0), lambda a, x: a + x) / F.size("m.sample_scores")
    return rounded(m.select("evaluator", "case_id", "art", "m.avg_rating", "m.distance", "m.accurate", "m.abstentions", scores.alias("mean_sample_score")))


CASE_METRICS = f"""WITH {SAMPLES} SELECT evaluator, case_id, art::BIGINT AS art, round(avg(rating::DOUBLE),6) AS avg_rating, round(1-abs(avg(rating::DOUBLE)-(CASE WHEN violation_label='violation' THEN 1 ELSE 5 END))/4.0::DOUBLE,6) AS distance,
CASE WHEN violation_label='violation' THEN avg(rating::DOUBLE)<3 ELSE avg(rating::DOUBLE)>3 END AS accurate, count(*) FILTER (rating=3) AS abstentions, round(avg(1-abs(rating-(CASE WHEN violation_label='violation' THEN 1 ELSE 5 END))/4.0::DOUBLE),6) AS mean_sample_score
FROM samples WHERE framing='predictive' GROUP BY evaluator, case_id, art, violation_label"""


def majority_votes(spark, sf_dir):
    """Votes of each case; among equals the side seen first."""
    return rounded(judged(spark, sf_dir, "predictive").select("evaluator", "case_id", "art", "prediction"))


MAJORITY_VOTES = f"WITH {CASES} SELECT evaluator, case_id, art::BIGINT AS art, prediction FROM cases WHERE framing='predictive'"


def condition_summary(spark, sf_dir):
    """All figures of each evaluator and framing."""
    return rounded(judged(spark, sf_dir).groupBy("evaluator", "framing").agg(*reduce.condition_figures()))


_FIGURES = """count(*) AS n_cases, sum(num_samples)::BIGINT AS n_samples, round(avg(is_accurate::INT::DOUBLE),6) AS accuracy, round(avg((prediction = CASE WHEN is_violation THEN 'violation' ELSE 'no_violation' END)::INT::DOUBLE),6) AS vote_accuracy,
round(sum(num_abstentions)::DOUBLE/sum(num_samples),6) AS abstention_rate, round(avg((prediction='abstention')::INT::DOUBLE),6) AS vote_abstention_rate, round(sum(CASE WHEN is_accurate THEN num_samples ELSE 0 END)::DOUBLE/sum(num_samples)*100,6) AS weighted_accuracy,
round(avg(is_accurate::INT::DOUBLE) FILTER (is_violation),6) AS violation_accuracy, round(avg(is_accurate::INT::DOUBLE) FILTER (NOT is_violation),6) AS no_violation_accuracy, round(avg(avg_rating),6) AS mean_rating"""
CONDITION_SUMMARY = f"WITH {CASES} SELECT evaluator, framing, {_FIGURES} FROM cases GROUP BY ALL"


def sample_accuracy(spark, sf_dir):
    """Accuracy of every rating scored alone, before and after the challenge (the factual framing stands for it)."""
    s = fixtures.samples(spark, sf_dir, "predictive", "factual")
    ok = R.accurate(F.col("rating"), F.col("violation_label") == "violation")
    return rounded(s.groupBy("evaluator").agg(*(F.avg(F.when(F.col("framing") == f, ok.cast("double"))).alias(n) for f, n in (("predictive", "initial"), ("factual", "challenged"))), F.count("*").alias("n")))


_OK = "(CASE WHEN violation_label='violation' THEN rating<3 ELSE rating>3 END)::INT::DOUBLE"
SAMPLE_ACCURACY = f"WITH {SAMPLES} SELECT evaluator, round(avg({_OK}) FILTER (framing='predictive'),6) AS initial, round(avg({_OK}) FILTER (framing='factual'),6) AS challenged, count(*) AS n FROM samples WHERE framing<>'normative' GROUP BY ALL"


def _both(spark, sf_dir) -> DataFrame:
    """Cases with their ratings under two conditions, zipped by sample; an unequal rest is left out."""
    cases = reduce.cases(fixtures.samples(spark, sf_dir, "predictive", "factual"), [*KEYS, "violation_label"])
    base = cases.where("framing = 'predictive'").drop("framing")
    other = cases.where("framing = 'factual'").select(*PAIR, "ratings")
    pairs = pairing.paired(base, other, PAIR)
    z = F.filter(F.arrays_zip(F.col("ratings_base").alias("b"), F.col("ratings_other").alias("o")), lambda x: x["b"].isNotNull() & x["o"].isNotNull())
    return pairs.withColumn("z", z)


def challenge_table(spark, sf_dir):
    """Sample-weighted accuracies, change rate by sample, prediction changes by case, mean change rate of a case."""
    v = F.col("violation_label_base") == "violation"
    rows = _both(spark, sf_dir).select(
        "evaluator",
        F.size("z").alias("n"),
        F.size(F.filter("z", lambda x: x["b"] != x["o"])).alias("changed"),
        R.accurate(R.mean(F.col("ratings_base")), v).alias("a0"),
        R.accurate(R.mean(F.col("ratings_other")), v).alias("a1"),
        (R.vote(F.col("ratings_base")) != R.vote(F.col("ratings_other"))).alias("moved"),
    )
    weighted = lambda c: (F.sum(F.when(F.col(c), F.col("n")).otherwise(0)) / F.sum("n") * 100)
    out = rows.groupBy("evaluator").agg(F.count("*").alias("cases"), weighted("a0").alias("original_accuracy"), weighted("a1").alias("challenged_accuracy"), (F.sum("changed") / F.sum("n") * 100).alias("change_rate"), reduce.share(F.col("moved")).alias("prediction_change_rate"), F.avg(F.col("changed") / F.col("n")).alias("mean_change_rate"))
    return rounded(out.withColumn("accuracy_change", F.col("challenged_accuracy") - F.col("original_accuracy")))


CHALLENGE_TABLE = f"""WITH {CASES}, ch AS (SELECT b.evaluator, b.case_id, b.art, count(*) AS n, count(*) FILTER (b.rating<>o.rating) AS changed FROM samples b JOIN samples o USING (evaluator, case_id, art, sample_idx) WHERE b.framing='predictive' AND o.framing='factual' GROUP BY ALL),
j AS (SELECT ch.*, b.is_accurate AS a0, o.is_accurate AS a1, b.prediction<>o.prediction AS moved FROM ch JOIN cases b USING (evaluator,case_id,art) JOIN cases o USING (evaluator,case_id,art) WHERE b.framing='predictive' AND o.framing='factual'),
g AS (SELECT evaluator, count(*) AS cases, sum(CASE WHEN a0 THEN n ELSE 0 END)::DOUBLE/sum(n)*100 AS x, sum(CASE WHEN a1 THEN n ELSE 0 END)::DOUBLE/sum(n)*100 AS y, sum(changed)::DOUBLE/sum(n)*100 AS r, avg(moved::INT::DOUBLE) AS m, avg(changed::DOUBLE/n) AS i FROM j GROUP BY ALL)
SELECT evaluator, cases, round(x,6) AS original_accuracy, round(y,6) AS challenged_accuracy, round(r,6) AS change_rate, round(m,6) AS prediction_change_rate, round(i,6) AS mean_change_rate, round(y-x,6) AS accuracy_change FROM g"""


def directional_cases(spark, sf_dir):
    """Where the cases' mean ratings moved, an increase read as toward a violation."""
    return rounded(pairing.directions(_versus(spark, sf_dir, "normative", "factual"), ["evaluator", "framing"], F.col("avg_rating_base"), F.col("avg_rating_other"), True))


def _direction_sql(src: str, by: str, b: str, a: str, up: str, down: str) -> str:
    return f"""SELECT {by}, count(*) AS total, count(*) FILTER ({b}<>{a}) AS changed, round(100.0*count(*) FILTER ({b}<>{a})/count(*)::DOUBLE,6) AS pct_changed,
round(coalesce(100.0*count(*) FILTER ({a}{up}{b})/nullif(count(*) FILTER ({b}<>{a}),0)::DOUBLE,0),6) AS pct_toward, round(coalesce(100.0*count(*) FILTER ({a}{down}{b})/nullif(count(*) FILTER ({b}<>{a}),0)::DOUBLE,0),6) AS pct_away,
round(coalesce(100.0*count(*) FILTER ({b}<>3 AND {a}=3)/nullif(count(*) FILTER ({b}<>{a}),0)::DOUBLE,0),6) AS pct_to_abstention, round(coalesce(100.0*count(*) FILTER ({b}=3 AND {a}<>3)/nullif(count(*) FILTER ({b}<>{a}),0)::DOUBLE,0),6) AS pct_from_abstention,
round(coalesce(avg(abs({a}-{b})::DOUBLE) FILTER ({b}<>{a}),0),6) AS avg_magnitude FROM {src} GROUP BY ALL"""


DIRECTIONAL_CASES = f"WITH {CASES}, j AS (SELECT b.evaluator, o.framing, b.avg_rating AS x, o.avg_rating AS y FROM cases b JOIN cases o USING (evaluator,case_id,art) WHERE b.framing='predictive' AND o.framing<>'predictive') " + _direction_sql("j", "evaluator, framing", "x", "y", ">", "<")


def _sample_pairs(spark, sf_dir) -> DataFrame:
    pairs = _both(spark, sf_dir).select("evaluator", "case_id", "art", F.posexplode("z").alias("sample_idx", "s"))
    return pairs.select("evaluator", "case_id", "art", "sample_idx", F.col("s.b").alias("before"), F.col("s.o").alias("after"))


def directional_samples(spark, sf_dir):
    """Where single ratings moved, a decrease read as toward a violation."""
    return rounded(pairing.directions(_sample_pairs(spark, sf_dir), ["evaluator"], F.col("before"), F.col("after"), False))


_SP = "sp AS (SELECT evaluator, case_id, art, sample_idx, max(rating) FILTER (framing='predictive') AS x, max(rating) FILTER (framing='factual') AS y FROM samples WHERE framing <> 'normative' GROUP BY evaluator, case_id, art, sample_idx)"
DIRECTIONAL_SAMPLES = f"WITH {SAMPLES}, {_SP} " + _direction_sql("sp", "evaluator", "x", "y", "<", ">")


def change_taxonomy(spark, sf_dir):
    """Flipping, polarizing and moderating changes of single ratings."""
    return rounded(pairing.taxonomy(_sample_pairs(spark, sf_dir), ["evaluator"], F.col("before"), F.col("after")))


_KIND = "CASE WHEN x=y THEN NULL WHEN (x-3)*(y-3)<0 THEN 'flipping' WHEN abs(y-3)>abs(x-3) THEN 'polarizing' WHEN abs(y-3)<abs(x-3) THEN 'moderating' END"
CHANGE_TAXONOMY = f"WITH {SAMPLES}, {_SP}, k AS (SELECT evaluator, {_KIND} AS kind FROM sp) SELECT evaluator, count(kind) AS changed, " + ", ".join(f"count(*) FILTER (kind='{k}') AS {k}, round(coalesce(100.0*count(*) FILTER (kind='{k}')/nullif(count(kind),0)::DOUBLE,0),6) AS pct_{k}" for k in ("flipping", "polarizing", "moderating")) + " FROM k GROUP BY ALL"


def change_details(spark, sf_dir):
    """Every changed rating with its kind and direction."""
    b, a = F.col("before"), F.col("after")
    return rounded(_sample_pairs(spark, sf_dir).where(b != a).withColumn("kind", R.change(b, a)).withColumn("direction", R.direction(b, a)))


CHANGE_DETAILS = f"WITH {SAMPLES}, {_SP} SELECT evaluator, case_id, art::BIGINT AS art, sample_idx::BIGINT AS sample_idx, x::BIGINT AS before, y::BIGINT AS after, {_KIND} AS kind, CASE WHEN y<x THEN 'toward' ELSE 'away' END AS direction FROM sp WHERE x<>y"


def alignment_lookup(spark, sf_dir):
    """Votes against the first baseline vote of a case; cases without one (every fifth here) aren't aligned."""
    every = judged(spark, sf_dir, "predictive", "normative")
    base = every.where("framing = 'predictive' AND case_id % 5 != 0").select(*PAIR, "prediction").withColumn("ord", F.lit(1))
    twice = base.unionByName(base.withColumn("ord", F.lit(2)).withColumn("prediction", F.lit("abstention")))
    rows = pairing.aligned_with(every.where("framing = 'normative'"), tables.dedupe(twice, PAIR, "ord", "first"), PAIR)
    return rounded(rows.groupBy("evaluator").agg(F.count("*").alias("n"), reduce.share(F.col("aligned")).alias("alignment")))


ALIGNMENT_LOOKUP = f"WITH {CASES} SELECT o.evaluator, count(*) AS n, round(avg(coalesce(o.prediction=b.prediction,false)::INT::DOUBLE),6) AS alignment FROM cases o LEFT JOIN (SELECT * FROM cases WHERE framing='predictive' AND case_id%5<>0) b USING (evaluator,case_id,art) WHERE o.framing='normative' GROUP BY ALL"


def key_intersection(spark, sf_dir):
    """Keys that three tables share, the last of repeated rows deciding."""
    every = judged(spark, sf_dir).select(*KEYS, "is_accurate").withColumn("ord", F.lit(2))
    early = every.where("case_id % 4 = 0").withColumn("ord", F.lit(1)).withColumn("is_accurate", F.lit(False))
    one = tables.dedupe(every.unionByName(early), KEYS, "ord", "last")
    of = lambda f, name, cond: one.where(F.col("framing") == f).where(cond).select(*PAIR, F.col("is_accurate").alias(name))
    met = of("predictive", "a", "case_id % 2 = 0").join(of("normative", "b", "case_id % 3 = 0"), PAIR).join(of("factual", "c", "true"), PAIR)
    return rounded(met.groupBy("evaluator").agg(F.count("*").alias("n"), F.count_if(F.col("a") & F.col("b") & F.col("c")).alias("all_right"), F.min("case_id").alias("first_case")))


KEY_INTERSECTION = f"WITH {CASES} SELECT a.evaluator, count(*) AS n, count(*) FILTER (a.is_accurate AND b.is_accurate AND c.is_accurate) AS all_right, min(a.case_id) AS first_case FROM cases a JOIN cases b USING (evaluator,case_id,art) JOIN cases c USING (evaluator,case_id,art) WHERE a.framing='predictive' AND b.framing='normative' AND c.framing='factual' AND case_id%2=0 AND case_id%3=0 GROUP BY ALL"


def _by_country(spark, sf_dir) -> DataFrame:
    """Predictive cases with their country; customers of some nations have none."""
    orders = fixtures.pairs(spark, sf_dir).select("case_id", "custkey")
    place = fixtures.table(spark, sf_dir, "customer").where("c_nationkey % 6 != 0").join(fixtures.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("custkey"), F.col("n_name").alias("country"))
    known = orders.join(place, "custkey").select("case_id", "country")
    return judged(spark, sf_dir, "predictive").join(known, "case_id", "left").withColumn("country", F.coalesce("country", F.lit("UNKNOWN")))


_COUNTRY = "place AS (SELECT c_custkey AS custkey, n_name AS country FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE c_nationkey%6<>0), pc AS (SELECT c.*, coalesce(country,'UNKNOWN') AS country FROM cases c LEFT JOIN place USING (custkey) WHERE framing='predictive')"


def _report(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), reduce.share(F.col("is_accurate")).alias("accuracy"), reduce.share(F.col("prediction") == "abstention").alias("abstention_rate"), F.avg("avg_rating").alias("mean_rating"))


_REPORT = "count(*) AS n, round(avg(is_accurate::INT::DOUBLE),6) AS accuracy, round(avg((prediction='abstention')::INT::DOUBLE),6) AS abstention_rate, round(avg(avg_rating),6) AS mean_rating"


def country_report(spark, sf_dir):
    return rounded(_report(_by_country(spark, sf_dir), "country").orderBy("country"))


COUNTRY_REPORT = f"WITH {CASES}, {_COUNTRY} SELECT country, {_REPORT} FROM pc GROUP BY ALL"


def evaluator_country(spark, sf_dir):
    return rounded(_report(_by_country(spark, sf_dir), "evaluator", "country"))


EVALUATOR_COUNTRY = f"WITH {CASES}, {_COUNTRY} SELECT evaluator, country, {_REPORT} FROM pc GROUP BY ALL"


def article_report(spark, sf_dir):
    """By article, shorter names first, with titles."""
    rows = judged(spark, sf_dir, "predictive").withColumn("article", F.when(F.col("art") == 0, "P1-1").otherwise((F.col("art") * 2).cast("string")))
    out = _report(rows, "article").withColumn("title", title(F.col("article"), "Art. "))
    return rounded(out.orderBy(F.length("article"), "article"))


ARTICLE_REPORT = f"WITH {CASES}, a AS (SELECT *, CASE WHEN art=0 THEN 'P1-1' ELSE (art*2)::VARCHAR END AS article FROM cases WHERE framing='predictive') SELECT article, {_REPORT}, CASE article WHEN 'P1-1' THEN 'Protection of property' WHEN '2' THEN 'Right to life' WHEN '6' THEN 'Right to a fair trial' WHEN '8' THEN 'Right to respect for private and family life' WHEN '10' THEN 'Freedom of expression' ELSE 'Art. '||article END AS title FROM a GROUP BY article"


def framing_report(spark, sf_dir):
    """By framing in its fixed order, with alignment to the predictive votes."""
    every = judged(spark, sf_dir)
    base = every.where("framing = 'predictive'").select(*PAIR, "prediction")
    out = pairing.aligned_with(every, base, PAIR).groupBy("framing").agg(F.count("*").alias("n"), reduce.share(F.col("is_accurate")).alias("accuracy"), reduce.share(F.col("aligned")).alias("alignment"))
    place = F.array_position(F.array(*map(F.lit, fixtures.FRAMINGS)), F.col("framing"))
    return rounded(out.withColumn("place", place).orderBy("place"))


FRAMING_REPORT = f"WITH {CASES} SELECT o.framing, count(*) AS n, round(avg(o.is_accurate::INT::DOUBLE),6) AS accuracy, round(avg((o.prediction=b.prediction)::INT::DOUBLE),6) AS alignment, CASE o.framing WHEN 'predictive' THEN 1 WHEN 'normative' THEN 2 ELSE 3 END::BIGINT AS place FROM cases o JOIN cases b USING (evaluator,case_id,art) WHERE b.framing='predictive' GROUP BY o.framing"


def accuracy_pivot(spark, sf_dir):
    """Evaluators by framings, rounded half to even at three places; the first value that isn't null."""
    rows = judged(spark, sf_dir).groupBy("evaluator", "framing").agg(reduce.share(F.col("is_accurate")).alias("accuracy"))
    return rows.groupBy("evaluator").pivot("framing", list(fixtures.FRAMINGS)).agg(F.bround(F.first("accuracy", ignorenulls=True), 3))


ACCURACY_PIVOT = f"WITH {CASES}, r AS (SELECT evaluator, framing, avg(is_accurate::INT::DOUBLE) AS a FROM cases GROUP BY ALL) SELECT evaluator, " + ", ".join(f"round_even(max(a) FILTER (framing='{f}'),3) AS {f}" for f in fixtures.FRAMINGS) + " FROM r GROUP BY evaluator"


def wide_summary(spark, sf_dir):
    """One row an evaluator with figures of every stage; a stage that it lacks (factual, for one of them) is null."""
    every = judged(spark, sf_dir).where("NOT (framing = 'factual' AND evaluator = '5-LOW')")
    names = every.select("evaluator").distinct()
    for f in fixtures.FRAMINGS:
        part = every.where(F.col("framing") == f).groupBy("evaluator").agg(reduce.share(F.col("is_accurate")).alias(f"{f}_accuracy"), F.sum(F.round(F.col("avg_rating") * F.col("num_samples")).cast("long")).alias(f"{f}_rating_sum"), F.count("*").alias(f"{f}_n"))
        names = names.join(part, "evaluator", "left")
    return rounded(names)


WIDE_SUMMARY = f"WITH {CASES} SELECT evaluator, " + ", ".join(f"round(avg(is_accurate::INT::DOUBLE) FILTER (framing='{f}'),6) AS {f}_accuracy, sum(round(avg_rating*num_samples)::BIGINT) FILTER (framing='{f}')::BIGINT AS {f}_rating_sum, nullif(count(*) FILTER (framing='{f}'),0) AS {f}_n" for f in fixtures.FRAMINGS) + " FROM cases WHERE NOT (framing='factual' AND evaluator='5-LOW') GROUP BY evaluator"


def disagreement(spark, sf_dir):
    """How many cases get different votes from different framings."""
    per = judged(spark, sf_dir).groupBy(*PAIR).agg((F.count_distinct("prediction") > 1).alias("differs"))
    return rounded(per.groupBy("evaluator").agg(F.count("*").alias("n"), F.count_if("differs").alias("differing")))


DISAGREEMENT = f"WITH {CASES}, d AS (SELECT evaluator, case_id, art, count(DISTINCT prediction)>1 AS differs FROM cases GROUP BY ALL) SELECT evaluator, count(*) AS n, count(*) FILTER (differs) AS differing FROM d GROUP BY evaluator"


def significance_tally(spark, sf_dir):
    """How many comparisons of each framing are significant, and of which evaluators."""
    per = pairing.comparison(_versus(spark, sf_dir, "normative", "factual"), ["evaluator", "framing"])
    named = F.array_join(F.array_sort(F.collect_list(F.when(F.col("significant"), F.col("evaluator")))), ",")
    return rounded(per.groupBy("framing").agg(F.count_if("significant").alias("significant"), F.count_if(~F.col("significant")).alias("not_significant"), named.alias("evaluators")))


SIGNIFICANCE_TALLY = f"WITH r AS ({PAIRED_MCNEMAR}) SELECT framing, count(*) FILTER (significant) AS significant, count(*) FILTER (NOT significant) AS not_significant, coalesce(string_agg(evaluator, ',' ORDER BY evaluator) FILTER (significant),'') AS evaluators FROM r GROUP BY framing"


def multiple_testing(spark, sf_dir):
    """Corrections of the p-values, effect sizes and cases needed for one changed outcome."""
    per = pairing.comparison(_versus(spark, sf_dir, "normative", "factual"), ["evaluator", "framing"])
    p, keys = F.col("p_value"), ["framing"]
    out = per.select(
        "evaluator", "framing", p,
        stats.bonferroni(p, Window.partitionBy("framing")).alias("bonferroni"), stats.holm(p, keys, "evaluator").alias("holm"), stats.benjamini_hochberg(p, keys, "evaluator").alias("benjamini_hochberg"),
        stats.cohens_h(F.col("other_accuracy"), F.col("base_accuracy")).alias("cohens_h"), stats.number_needed(F.col("delta")).alias("number_needed"), stats.effect_size(F.col("delta")).alias("effect"),
    )
    return rounded(out)


MULTIPLE_TESTING = (
    "WITH r AS ("
    + PAIRED_MCNEMAR.replace("round(a0,6)", "a0").replace("round(a1,6)", "a1").replace("round(a1-a0,6)", "a1-a0").replace("round(p,6)", "p")
    + """), w AS (SELECT *, count(*) OVER (PARTITION BY framing) AS m, row_number() OVER (PARTITION BY framing ORDER BY p_value, evaluator) AS k FROM r)
SELECT evaluator, framing, round(p_value,6) AS p_value, round(least(1.0,p_value*m),6) AS bonferroni, round(least(1.0,max(p_value*(m-k+1)) OVER (PARTITION BY framing ORDER BY p_value, evaluator ROWS UNBOUNDED PRECEDING)),6) AS holm,
round(least(1.0,min(p_value*m/k) OVER (PARTITION BY framing ORDER BY p_value, evaluator ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),6) AS benjamini_hochberg, round(2*asin(sqrt(other_accuracy))-2*asin(sqrt(base_accuracy)),6) AS cohens_h,
round(CASE WHEN delta<>0 THEN 1/abs(delta) END,6) AS number_needed, CASE WHEN abs(delta)<0.05 THEN 'small' WHEN abs(delta)<0.10 THEN 'moderate' ELSE 'large' END AS effect FROM w"""
)


def legacy_predictions(spark, sf_dir):
    """The older threshold beside the canonical one."""
    rows = judged(spark, sf_dir, "predictive")
    old, new = R.predicts_violation(F.col("avg_rating"), legacy=True), F.col("says_violation")
    return rounded(rows.groupBy("evaluator").agg(F.count_if(old).alias("legacy"), F.count_if(new).alias("canonical"), F.count_if(old & new).alias("both")))


LEGACY_PREDICTIONS = f"WITH {CASES} SELECT evaluator, count(*) FILTER (avg_rating>2.5) AS legacy, count(*) FILTER (avg_rating<3) AS canonical, count(*) FILTER (avg_rating>2.5 AND avg_rating<3) AS both FROM cases WHERE framing='predictive' GROUP BY evaluator"


def run_comparison(spark, sf_dir):
    """A pilot run (every tenth case) against the full one; zero accuracies give no delta."""
    rows = judged(spark, sf_dir, "predictive")
    full = rows.groupBy("evaluator").agg(reduce.share(F.col("is_accurate")).alias("full_accuracy"), F.count("*").alias("full_n"))
    pilot = rows.where("case_id % 10 = 0").groupBy("evaluator").agg(reduce.share(F.col("is_accurate")).alias("pilot_accuracy"), F.count("*").alias("pilot_n"))
    return rounded(full.join(pilot, "evaluator").withColumn("delta", pairing.delta_unless_zero(F.col("pilot_accuracy"), F.col("full_accuracy"))))


RUN_COMPARISON = f"WITH {CASES}, g AS (SELECT evaluator, avg(is_accurate::INT::DOUBLE) AS f, count(*) AS fn, avg(is_accurate::INT::DOUBLE) FILTER (case_id%10=0) AS p, count(*) FILTER (case_id%10=0) AS pn FROM cases WHERE framing='predictive' GROUP BY evaluator) SELECT evaluator, round(f,6) AS full_accuracy, fn AS full_n, round(p,6) AS pilot_accuracy, pn AS pilot_n, round(CASE WHEN p<>0 AND f<>0 THEN f-p END,6) AS delta FROM g WHERE pn>0"


def running_accuracy(spark, sf_dir):
    """Accuracy over the cases so far, in order, for each evaluator and article: running sums by ranges, no window over a group."""
    rows = judged(spark, sf_dir, "predictive").select("evaluator", "art", "case_id", "is_accurate")
    so_far = running.totals(rows, ["evaluator", "art"], "case_id", {"right": F.col("is_accurate").cast("long"), "n": F.lit(1)})
    return rounded(so_far.select("evaluator", "art", "case_id", (F.col("right") / F.col("n")).alias("so_far")))


RUNNING_ACCURACY = f"WITH {CASES} SELECT evaluator, art::BIGINT AS art, case_id, round(avg(is_accurate::INT::DOUBLE) OVER (PARTITION BY evaluator, art ORDER BY case_id ROWS UNBOUNDED PRECEDING),6) AS so_far FROM cases WHERE framing='predictive'"

REPLICATES = 10_000


def bootstrap_portable(spark, sf_dir):
    """Bootstrap interval of the accuracy difference with 10,000 replicates drawn by integer arithmetic."""
    return rounded(bootstrap.portable(pairing.comparison(_versus(spark, sf_dir, "factual"), ["evaluator"]), ["evaluator"], REPLICATES))


BOOTSTRAP_PORTABLE = f"""WITH {CASES}, s AS (SELECT b.evaluator, count(*) AS n, count(*) FILTER (NOT b.is_accurate AND o.is_accurate) AS n01, count(*) FILTER (b.is_accurate AND NOT o.is_accurate) AS n10 FROM cases b JOIN cases o USING (evaluator,case_id,art) WHERE b.framing='predictive' AND o.framing='factual' GROUP BY 1),
k AS (SELECT evaluator, rep, n, n01, n10, ((rep*1103515245 + i*12345*(rep+7) + 1013904223) % 2147483647) % n AS pick FROM s, range({REPLICATES}) t(rep), unnest(range(n)) u(i)),
m AS (SELECT evaluator, rep, sum(CASE WHEN pick >= n-n01 THEN 1 WHEN pick < n10 THEN -1 ELSE 0 END)::DOUBLE/count(*) AS mean FROM k GROUP BY evaluator, rep)
SELECT evaluator, round(quantile_cont(mean,0.025),6) AS low, round(quantile_cont(mean,0.975),6) AS high FROM m GROUP BY evaluator"""


def bootstrap_multinomial(spark, sf_dir):
    """The same interval over all pairs with multinomial replicates: no SQL counterpart, tested for its distribution."""
    counts = pairing.comparison(_versus(spark, sf_dir, "normative", "factual"), ["evaluator", "framing"])
    return rounded(bootstrap.multinomial(counts, ["evaluator", "framing"]))


def bootstrap_seeded(spark, sf_dir):
    """The interval over all pairs as NumPy's legacy generator gives it: no SQL counterpart, tested against a plain loop."""
    rows = _versus(spark, sf_dir, "factual").select("evaluator", "case_id", "art", "is_accurate_base", "is_accurate_other")
    return rounded(bootstrap.seeded(rows, ["evaluator"], ["case_id", "art"]))


def grid_requests(spark, sf_dir):
    """Requests of every pair, framing and sample, with ids, counted by evaluator and framing."""
    from ..functions.templates import custom_id

    s = fixtures.samples(spark, sf_dir).withColumn("custom_id", custom_id(F.col("case_id"), F.col("art"), F.col("framing"), "sample", F.col("sample_idx")))
    return rounded(s.groupBy("evaluator", "framing").agg(F.count("*").alias("requests"), F.min("custom_id").alias("first_id"), F.max("custom_id").alias("last_id"), F.sum(F.length("custom_id")).alias("id_chars")))


GRID_REQUESTS = f"WITH {SAMPLES}, i AS (SELECT *, concat_ws('_', case_id, art, framing, 'sample', sample_idx) AS id FROM samples) SELECT evaluator, framing, count(*) AS requests, min(id) AS first_id, max(id) AS last_id, sum(length(id))::BIGINT AS id_chars FROM i GROUP BY evaluator, framing"


def response_join(spark, sf_dir):
    """Responses back to their requests: text to rating, a missing answer abstains, a missing challenge keeps the initial rating."""
    s = fixtures.samples(spark, sf_dir, "predictive", "factual")
    asked = s.where("framing = 'predictive'").select("evaluator", "case_id", "art", "sample_idx")
    text = F.when(F.col("case_id") % 11 == 0, F.concat(F.lit("ERROR: "), F.lit(429).cast("string"))).when(F.col("case_id") % 13 == 0, F.lit("none")).otherwise(F.concat(F.lit("Answer: "), "rating"))
    keys = ["evaluator", "case_id", "art", "sample_idx"]
    # a plan's size doesn't count what explodes: without the hint millions of responses pass for a small table and go through the driver
    of = lambda f, name, gone: s.where(F.col("framing") == f).where(gone).select(*keys, text.alias(name)).hint("merge")
    met = asked.join(of("predictive", "first", "case_id % 17 != 0"), keys, "left").join(of("factual", "second", "case_id % 19 != 0"), keys, "left")
    initial = F.when(F.col("first").isNull(), R.ABSTAIN).otherwise(R.extract(F.col("first")))
    rated = met.withColumn("initial", initial).withColumn("challenged", F.when(F.col("second").isNull(), F.col("initial")).otherwise(R.extract(F.col("second"))))
    return rounded(rated.groupBy("evaluator").agg(F.sum("initial").cast("long").alias("initial_sum"), F.sum("challenged").cast("long").alias("challenged_sum"), F.count_if(F.col("initial") != F.col("challenged")).alias("changed")))


RESPONSE_JOIN = f"""WITH {SAMPLES}, j AS (SELECT b.evaluator, b.case_id, CASE WHEN b.case_id%17=0 THEN 3 ELSE CASE WHEN b.case_id%11=0 OR b.case_id%13=0 THEN 3 ELSE b.rating END END AS i, b.case_id%19=0 AS gone, CASE WHEN o.case_id%11=0 OR o.case_id%13=0 THEN 3 ELSE o.rating END AS c FROM samples b JOIN samples o USING (evaluator,case_id,art,sample_idx) WHERE b.framing='predictive' AND o.framing='factual')
SELECT evaluator, sum(i)::BIGINT AS initial_sum, sum(CASE WHEN gone THEN i ELSE c END)::BIGINT AS challenged_sum, count(*) FILTER (i <> CASE WHEN gone THEN i ELSE c END) AS changed FROM j GROUP BY evaluator"""


def stringified_ratings(spark, sf_dir):
    """Ratings written as a list in text, read back and averaged."""
    cases = reduce.cases(fixtures.samples(spark, sf_dir, "normative"), ["evaluator", "case_id", "art"])
    text = cases.withColumn("text", F.concat(F.lit("["), F.array_join(F.transform("ratings", lambda r: r.cast("string")), ", "), F.lit("]")))
    back = R.parse_list(F.col("text"))
    return rounded(text.select("evaluator", "case_id", "art", "text", R.mean(back).alias("avg_rating"), F.size(back).alias("n")))


STRINGIFIED_RATINGS = f"WITH {SAMPLES} SELECT evaluator, case_id, art::BIGINT AS art, '[' || string_agg(rating::VARCHAR, ', ' ORDER BY sample_idx) || ']' AS text, round(avg(rating::DOUBLE),6) AS avg_rating, count(*) AS n FROM samples WHERE framing='normative' GROUP BY evaluator, case_id, art"


def completeness(spark, sf_dir):
    """Found against expected cases of every evaluator and framing; some are cut short or missing."""
    found = judged(spark, sf_dir).where("NOT (framing = 'factual' AND case_id % 3 = 0) AND NOT (framing = 'normative' AND evaluator = '2-HIGH')").groupBy("evaluator", "framing").agg(F.count("*").alias("found"))
    per = fixtures.pairs(spark, sf_dir).groupBy("evaluator").agg(F.count("*").alias("expected"))
    expected = per.withColumn("framing", F.explode(F.array(*map(F.lit, fixtures.FRAMINGS))))
    return rounded(tables.completeness(found, expected, ["evaluator", "framing"]))


COMPLETENESS = f"WITH {CASES}, f AS (SELECT evaluator, framing, count(*) AS found FROM cases WHERE NOT (framing='factual' AND case_id%3=0) AND NOT (framing='normative' AND evaluator='2-HIGH') GROUP BY ALL), e AS (SELECT evaluator, framing, count(*) AS expected FROM pairs CROSS JOIN fr GROUP BY ALL) SELECT evaluator, framing, expected, coalesce(found,0) AS found, expected-coalesce(found,0) AS missing, coalesce(found,0)>=expected AS complete FROM e LEFT JOIN f USING (evaluator, framing)"


def effect_of_abstaining(spark, sf_dir):
    """Case sets of two framings: in both, in one alone, in either."""
    every = judged(spark, sf_dir, "predictive", "factual").where("prediction = 'abstention'")
    a = every.where("framing = 'predictive'").select(*PAIR)
    b = every.where("framing = 'factual'").select(*PAIR)
    named = [("both", a.intersect(b)), ("only_predictive", a.subtract(b)), ("either", a.unionByName(b).distinct())]
    out = None
    for name, df in named:
        part = df.groupBy("evaluator").agg(F.count("*").alias("n")).withColumn("set", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return rounded(out)


EFFECT_OF_ABSTAINING = f"""WITH {CASES}, a AS (SELECT evaluator, case_id, art FROM cases WHERE framing='predictive' AND prediction='abstention'), b AS (SELECT evaluator, case_id, art FROM cases WHERE framing='factual' AND prediction='abstention')
SELECT evaluator, count(*) AS n, 'both' AS "set" FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY evaluator UNION ALL SELECT evaluator, count(*), 'only_predictive' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY evaluator UNION ALL SELECT evaluator, count(*), 'either' FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY evaluator"""

_WITH_SQL = "paired_mcnemar case_metrics majority_votes condition_summary sample_accuracy challenge_table directional_cases directional_samples change_taxonomy change_details alignment_lookup key_intersection country_report evaluator_country article_report framing_report accuracy_pivot wide_summary disagreement significance_tally multiple_testing legacy_predictions run_comparison running_accuracy bootstrap_portable grid_requests response_join stringified_ratings completeness effect_of_abstaining".split()
QUERIES = {name: globals()[name] for name in [*_WITH_SQL, "bootstrap_multinomial", "bootstrap_seeded"]}
ORACLES = {name: nudged(globals()[name.upper()]) for name in _WITH_SQL}
