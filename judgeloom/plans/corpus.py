"""Queries over case texts: labels, truncation, repair, names, merging, sampling, planning. Each has its SQL counterpart where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, templates
from ..functions import ratings as R
from ..functions import text as X
from ..operators import corpus, planning, tables
from ..schemas import schema
from ..sources import fixtures
from ..storage import written
from .ratings import nudged, rounded

def _list(values: tuple[str, ...], at: str) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{at}%{len(values)}+1]"


CASES = f"""cs AS (SELECT doc_id AS ord, doc_id::VARCHAR AS item_id, 'CASE OF ' || source || ' v. ' || upper(lang) AS case_name, source, lang, text,
  CASE WHEN doc_id%3=0 THEN 'No violation of Article 8; Violation of Article 3; Violation of Article P1-1' WHEN doc_id%3=1 THEN 'Violation of Article 6-1' ELSE 'Struck out of the list' END AS conclusion,
  CASE WHEN doc_id%3=0 THEN text || chr(10) || {_list(fixtures.ASSESSMENTS, "(doc_id//3)")} || chr(10) || text WHEN doc_id%3=1 THEN text || '. Filler. ' || {_list(fixtures.CONCLUSIONS, "(doc_id//3)")} || '. ' || text
    WHEN (doc_id//3)%3=2 THEN 'Holds that it leaks' || chr(10) || text || '. Holds that there is more.' || chr(10) || text ELSE text END AS full_case_text,
  (DATE '2020-01-01' + doc_id::INT)::VARCHAR AS decision_date FROM documents)"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _before(text: str, pattern: str) -> str:
    """SQL: the text up to the last full stop before a pattern's first match, or null."""
    return f"CASE WHEN regexp_matches({text},{_quoted('(?i)' + pattern)}) THEN nullif(regexp_extract(regexp_extract({text},{_quoted('(?s)' + chr(92) + 'A(.*?)(?i-s:' + pattern + ')')},1),'(?s)\\A(.+\\.)',1),'') END"


def _cut(text: str) -> str:
    """SQL: a struct of what truncation keeps of a text, and how it found that."""
    marks = "|".join(X.MARKERS)
    kept = "coalesce(" + ",".join(_before(text, p) for p in X.CONCLUSORY) + ")"
    return f"""CASE WHEN regexp_matches({text},{_quoted('(?im)' + marks)}) THEN struct_pack(text := regexp_replace(regexp_extract({text},{_quoted('(?s)' + chr(92) + 'A(.*?)(?im:' + marks + ')')},1),'\\s+$',''), method := '{X.MARKED}')
WHEN {kept} IS NOT NULL THEN struct_pack(text := regexp_replace({kept},'\\s+$',''), method := '{X.CONCLUDED}') ELSE struct_pack(text := {text}, method := '{X.NO_TRUNCATION}') END"""


def conclusion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and outcomes of each conclusion; cases without any stay as unknown."""
    return corpus.pairs(fixtures.cases(spark, sf_dir)).select("item_id", "article", "violation_label")


CONCLUSION_PAIRS = f"""WITH {CASES}, p AS (SELECT item_id, trim(unnest(string_split(conclusion,';'))) AS part FROM cs), m AS (SELECT item_id, regexp_extract(part,'(?i)Article\\s+([\\dP][\\d-]*)',1) AS article, CASE WHEN regexp_matches(part,'(?i)no\\s+violation') THEN 'no_violation' WHEN regexp_matches(part,'(?i)violation') THEN 'violation' END AS violation_label FROM p),
g AS (SELECT * FROM m WHERE article<>'' AND violation_label IS NOT NULL) SELECT * FROM g UNION ALL SELECT item_id, '', 'unknown' FROM cs WHERE item_id NOT IN (SELECT item_id FROM g)"""


def truncation(spark, sf_dir):
    """How and where each text was cut, with its retention."""
    out = corpus.truncated(fixtures.cases(spark, sf_dir))
    return rounded(out.select("item_id", "verdict_removal_method", "original_length", "verdict_free_length", "retention_percentage", "excluded", F.md5("full_case_text_no_verdict").alias("text_md5")))


TRUNCATION = f"""WITH {CASES}, t AS (SELECT item_id, full_case_text, u.text AS cut, u.method AS method FROM (SELECT *, {_cut("full_case_text")} AS u FROM cs))
SELECT item_id, method AS verdict_removal_method, length(full_case_text) AS original_length, length(cut) AS verdict_free_length, round(100.0::DOUBLE*length(cut)/length(full_case_text),6) AS retention_percentage, length(cut)<500 AS excluded, md5(cut) AS text_md5 FROM t"""


def truncation_stats(spark, sf_dir):
    """Per method: cases, mean retention, excluded ones, cases left to verify."""
    out = corpus.truncated(fixtures.cases(spark, sf_dir))
    return rounded(out.groupBy("verdict_removal_method").agg(F.count("*").alias("n"), F.avg("retention_percentage").alias("mean_retention"), F.count_if("excluded").alias("excluded"), F.count_if(corpus.needs_verification(out)).alias("to_verify")))


TRUNCATION_STATS = f"WITH t AS ({TRUNCATION.replace('round(100.0::DOUBLE*length(cut)/length(full_case_text),6)', '100.0::DOUBLE*length(cut)/length(full_case_text)')}) SELECT verdict_removal_method, count(*) AS n, round(avg(retention_percentage),6) AS mean_retention, count(*) FILTER (excluded) AS excluded, count(*) FILTER (NOT excluded AND verdict_removal_method='no_truncation') AS to_verify FROM t GROUP BY ALL"


#: What a verifier quotes in another case than the text has it: its beginning is found, the rest isn't.
_QUOTED_FROM, _QUOTED = 300, 70
_CASES = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def repair(spark, sf_dir):
    """Two verifiers' sentences removed from texts that nothing truncated: the first line where it stands, a misquoted one by a cut before it, conclusions that are left cut behind it."""
    # read for both verifiers and for the repair: patterns are searched for once
    out = written(corpus.truncated(fixtures.cases(spark, sf_dir)).where("verdict_removal_method = 'no_truncation'"), "truncated")
    line = F.split("full_case_text", "\n", 2)[0]
    quoted = F.concat(F.translate(F.substring("full_case_text", _QUOTED_FROM, _QUOTED), *_CASES), F.lit(" and so on"))
    turn = F.floor(F.col("ord") / 3) % 3
    sentence = F.when(turn == 1, quoted).otherwise(line)
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct((F.col("ord") % 7 != 0).alias("leaks_verdict"), F.array(sentence).alias("leaking_sentences"))), F.lit("\n```"))
    responses = out.select("item_id", F.lit("a").alias("verifier"), answer.alias("response")).unionByName(out.select("item_id", F.lit("b").alias("verifier"), F.lit("no json").alias("response")))
    leaks = corpus.verdicts(responses, ["item_id"]).where("leaks")
    done = corpus.repaired(out.join(leaks, "item_id"))
    return rounded(done.select("item_id", "verdict_removal_method", "verdict_free_length", "retention_percentage", "excluded", "exclusion_reason", F.md5("full_case_text_no_verdict").alias("text_md5")))


def _cleaned() -> str:
    """SQL: tables c0 to c13, in each of which one pattern has cut what the ones before have left."""
    out = []
    for k, p in enumerate(X.CONCLUSORY):
        kept = _before("t", p)
        out.append(f"c{k + 1} AS (SELECT * EXCLUDE (k), coalesce(regexp_replace(k,'\\s+$',''),t) AS t, method || CASE WHEN k IS NULL THEN '' ELSE '{X.CLEANED}' END AS method FROM (SELECT * EXCLUDE (t, method), t, method, {kept} AS k FROM c{k}) x)".replace("SELECT * EXCLUDE (k), coalesce", "SELECT * EXCLUDE (k, t, method), coalesce"))
    return ", ".join(out)


_STRIPPED = "regexp_replace(regexp_replace({},'^\\s+',''),'\\s+$','')"
REPAIR = f"""WITH {CASES}, u AS (SELECT item_id, ord, full_case_text AS t0, length(full_case_text) AS n, CASE WHEN (ord//3)%3=1 THEN translate(substr(full_case_text,{_QUOTED_FROM},{_QUOTED}),'{_CASES[0]}','{_CASES[1]}') || ' and so on' ELSE string_split(full_case_text,chr(10))[1] END AS s FROM cs WHERE ord%7<>0 AND ({_cut("full_case_text")}).method = '{X.NO_TRUNCATION}'),
w AS (SELECT *, {_STRIPPED.format("s")} AS p, strpos(lower(t0), substr(lower(s),1,50)) AS f FROM u),
x AS (SELECT *, s<>'' AND p<>'' AND strpos(t0,p)>0 AS exact, regexp_extract(substr(t0,1,f-1),'(?s)\\A(.+\\.)',1) AS kept FROM w),
c0 AS (SELECT item_id, n, t0, CASE WHEN exact THEN substr(t0,1,strpos(t0,p)-1) || substr(t0,strpos(t0,p)+length(p)) WHEN s<>'' AND f>1 AND kept<>'' THEN regexp_replace(kept,'\\s+$','') ELSE t0 END AS t,
'{X.NO_TRUNCATION}' || CASE WHEN exact THEN '{X.REMOVED}' WHEN s<>'' AND f>1 AND kept<>'' THEN '{X.CUT}' ELSE '' END AS method FROM x), {_cleaned()},
r AS (SELECT *, {_STRIPPED.format("t")} AS cut FROM c{len(X.CONCLUSORY)})
SELECT item_id, method AS verdict_removal_method, CASE WHEN length(cut)<500 THEN n ELSE length(cut) END AS verdict_free_length, round(CASE WHEN length(cut)<500 THEN 100.0::DOUBLE ELSE 100.0::DOUBLE*length(cut)/n END,6) AS retention_percentage,
n<500 OR length(cut)<500 AS excluded, CASE WHEN length(cut)<500 THEN 'too_short_after_repair' WHEN n<500 THEN 'too_short' ELSE '' END AS exclusion_reason, md5(CASE WHEN length(cut)<500 THEN t0 ELSE cut END) AS text_md5 FROM r"""


def html_lines(spark, sf_dir):
    """Pages as text with their paragraphs: no SQL counterpart, tested by hand."""
    return fixtures.table(spark, sf_dir, "pages").select("page_id", X.html_text(F.col("html")).alias("text")).select("page_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


_COUNTRY = {"en": "THE UNITED KINGDOM", "fr": "FRANCE", "de": "GERMANY", "es": "V. SPAIN"}


def respondents(spark, sf_dir):
    """Clean respondent names: missing ones come from the title, others are normalised."""
    title = F.concat(F.lit("CASE OF "), "source", F.lit(" v. "), F.when(F.col("lang") == "fr", "Turquie").when(F.col("lang") == "de", "the Netherlands (no. 2)").otherwise("Ukraine [GC]"))
    raw = F.when(F.col("ord") % 4 == 0, "UNKNOWN").otherwise(F.create_map(*(F.lit(x) for kv in _COUNTRY.items() for x in kv))[F.col("lang")])
    rows = fixtures.cases(spark, sf_dir).select("item_id", title.alias("title"), raw.alias("raw"))
    return rows.select("item_id", "raw", names.cleaned(F.col("raw"), F.col("title")).alias("respondent"), names.needs_extraction(F.col("raw")).alias("extracted"))


RESPONDENTS = """WITH r AS (SELECT doc_id, lang, CASE WHEN doc_id%4=0 THEN 'UNKNOWN' WHEN lang='en' THEN 'THE UNITED KINGDOM' WHEN lang='fr' THEN 'FRANCE' WHEN lang='de' THEN 'GERMANY' WHEN lang='es' THEN 'V. SPAIN' END AS raw FROM documents)
SELECT doc_id::VARCHAR AS item_id, raw, CASE WHEN doc_id%4=0 OR lang='es' THEN CASE lang WHEN 'fr' THEN 'TURKEY' WHEN 'de' THEN 'NETHERLANDS' ELSE 'UKRAINE' END WHEN lang='en' THEN 'UNITED KINGDOM' ELSE raw END AS respondent, doc_id%4=0 OR lang='es' AS extracted FROM r"""

STRATEGIES = {
    "names": {"replacements": {"[STATE]": "the State", "[STATE ADJ]": "national"}},
    "pronouns": {"complex_replacements": {"[PRONOUN]": {"type": "contextual_pronoun", "subject": "they", "object": "them", "object_verbs": ["told", "saw"]}}},
}


def placeholders(spark, sf_dir):
    """Placeholders replaced longest first, pronouns by the verb before them."""
    templates.check_conflicts(list(STRATEGIES), STRATEGIES)
    text = F.concat(F.lit("[STATE ADJ] court of [STATE] told [PRONOUN] that [PRONOUN] SAW [PRONOUN]: "), F.col("text"))
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", templates.replaced(text, list(STRATEGIES), STRATEGIES).alias("text"))


PLACEHOLDERS = "SELECT doc_id, 'national court of the State told them that they SAW them: ' || text AS text FROM documents"


def prompts(spark, sf_dir):
    """Prompts by framing over the whole text, with titles; messages and parameters by model family."""
    docs = fixtures.table(spark, sf_dir, "documents")
    framing, article = F.array(*map(F.lit, templates.FRAMINGS))[(F.col("doc_id") % 3).cast("int")], F.when(F.col("doc_id") % 2 == 0, "3").otherwise("99")
    model = F.array(F.lit("x/gemini-1"), F.lit("x/gpt-5"), F.lit("x/other"))[(F.col("doc_id") % 3).cast("int")]
    prompt = templates.by_framing(framing, F.col("text"), article)
    rows = docs.select("doc_id", model.alias("model"), prompt.alias("prompt")).withColumn("m", templates.messages(F.lit("S"), F.col("prompt"), F.col("model"))).withColumn("p", templates.parameters(F.col("model")))
    last = F.element_at("m", -1)
    return rounded(rows.select("doc_id", templates.bare_model(F.col("model")).alias("bare"), F.size("m").alias("n_messages"), F.md5(last["content"]).alias("prompt_md5"), F.col("p.temperature").alias("temperature"), F.col("p.max_tokens").alias("max_tokens"), F.col("p.max_completion_tokens").alias("max_completion_tokens"), F.col("p.reasoning_effort").alias("effort")))


_ASK = " END || ' a violation of Article ' || CASE WHEN doc_id%2=0 THEN '3 - Prohibition of torture' ELSE '99 - Article 99' END || '? Answer with the number alone.'"
PROMPTS = f"""WITH p AS (SELECT doc_id, CASE WHEN doc_id%3=0 THEN 'S' || chr(10) || chr(10) ELSE '' END || 'Facts:' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'On a scale from 1 (certainly) to 5 (certainly not): ' || CASE doc_id%3 WHEN 0 THEN 'will the court find' WHEN 1 THEN 'should the court find' ELSE 'was there'{_ASK} AS prompt FROM documents)
SELECT doc_id, CASE doc_id%3 WHEN 0 THEN 'gemini-1' WHEN 1 THEN 'gpt-5' ELSE 'other' END AS bare, CASE WHEN doc_id%3=0 THEN 1 ELSE 2 END::BIGINT AS n_messages, md5(prompt) AS prompt_md5, CASE WHEN doc_id%3<>1 THEN 1.0::DOUBLE END AS temperature, CASE doc_id%3 WHEN 0 THEN 4096 WHEN 2 THEN 100 END::BIGINT AS max_tokens, CASE WHEN doc_id%3=1 THEN 2048 END::BIGINT AS max_completion_tokens, CASE WHEN doc_id%3=1 THEN 'low' END AS effort FROM p"""


def ratings_from_text(spark, sf_dir):
    """The first digit from 1 to 5 of any text, errors as missing or as they read."""
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("ERROR: code "), F.lit("429"))).otherwise(F.col("props"))
    rows = fixtures.table(spark, sf_dir, "events").select(R.extract(text).alias("rating"), R.extract(text, errors_missing=False).alias("parity"))
    return rounded(rows.groupBy("rating", "parity").agg(F.count("*").alias("n")))


RATINGS_FROM_TEXT = "WITH e AS (SELECT event_id%7=0 AS bad, CASE WHEN event_id%7=0 THEN 'ERROR: code 429' ELSE props END AS t FROM events), r AS (SELECT bad, coalesce(nullif(regexp_extract(t,'[1-5]'),'')::INT,3) AS p FROM e) SELECT (CASE WHEN bad THEN 3 ELSE p END)::BIGINT AS rating, p::BIGINT AS parity, count(*) AS n FROM r GROUP BY ALL"


def json_answers(spark, sf_dir):
    """Verifiers' answers in code fences, parsed; what isn't JSON leaks nothing known."""
    k = F.get_json_object("props", "$.k").cast("int")
    body = F.concat(F.lit('{"leaks_verdict": '), F.when(k % 2 == 0, "true").otherwise("false"), F.lit(', "leaking_sentences": ["a", "b"], "confidence": "high"}'))
    text = F.when(F.col("event_id") % 5 == 0, "sorry").when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    a = F.from_json(X.unfenced(text), schema("leakage"))
    rows = fixtures.table(spark, sf_dir, "events").select(F.col("event_type"), a.alias("a"))
    return rounded(rows.groupBy("event_type").agg(F.count_if("a.leaks_verdict").alias("leaks"), F.count_if(F.col("a.leaks_verdict").isNull()).alias("unknown"), F.sum(F.coalesce(F.size("a.leaking_sentences"), F.lit(0))).alias("sentences")))


JSON_ANSWERS = "WITH e AS (SELECT event_type, event_id%5=0 AS bad, json_extract_string(props,'$.k')::INT%2=0 AS yes FROM events) SELECT event_type, count(*) FILTER (NOT bad AND yes) AS leaks, count(*) FILTER (bad) AS unknown, sum(CASE WHEN bad THEN 0 ELSE 2 END)::BIGINT AS sentences FROM e GROUP BY ALL"


def search_metadata(spark, sf_dir):
    """Nested hits as flat rows; hits without an id go, articles are split and trimmed."""
    docs = fixtures.table(spark, sf_dir, "documents")
    c = F.struct(
        F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("doc_id").cast("string")).alias("itemid"), F.col("source").alias("docname"), F.lit("1/20").alias("appno"), F.concat(F.date_add(F.to_date(F.lit("2020-01-01")), F.col("doc_id").cast("int")).cast("string"), F.lit("T00:00:00")).alias("kpdate"),
        F.upper("lang").alias("respondent"), F.when(F.col("doc_id") % 3 == 0, "3; 8;;P1-1 ").otherwise("6").alias("article"), *(F.lit("").alias(n) for n in ("conclusion", "languageisocode", "importance", "ecli", "doctypebranch", "separateopinion")),
    )
    out = corpus.metadata(docs.select(c.alias("columns")))
    return out.select("item_id", "case_name", "decision_date", "respondent", F.array_join("articles", ";").alias("articles"))


SEARCH_METADATA = "SELECT doc_id::VARCHAR AS item_id, source AS case_name, (DATE '2020-01-01' + doc_id::INT)::VARCHAR AS decision_date, upper(lang) AS respondent, CASE WHEN doc_id%3=0 THEN '3;8;P1-1' ELSE '6' END AS articles FROM documents WHERE doc_id%10<>0"


def dated_cases(spark, sf_dir):
    """Cases inside a range of dates, from the first of several columns that is filled."""
    rows = fixtures.cases(spark, sf_dir).select("item_id", F.when(F.col("ord") % 2 == 0, F.col("decision_date")).otherwise("").alias("date"), F.when(F.col("ord") % 5 != 0, F.concat("decision_date", F.lit("T10:00"))).alias("kp_date"))
    return tables.dated(rows, ["date", "kp_date"], "2020-02-01", "2021-01-01").select("item_id", "decision_date")


DATED_CASES = f"WITH {CASES} SELECT item_id, decision_date FROM cs WHERE (ord%2=0 OR ord%5<>0) AND decision_date >= '2020-02-01' AND decision_date < '2021-01-01'"


def published_cases(spark, sf_dir):
    """The columns given out, the text from the first that is filled."""
    out = corpus.truncated(fixtures.cases(spark, sf_dir)).withColumn("full_case_text_no_verdict", F.when(F.col("ord") % 4 == 0, "").otherwise(F.col("full_case_text_no_verdict")))
    return rounded(corpus.published(out).select("item_id", "case_name", "decision_date", F.length("case_text").alias("n_chars")))


PUBLISHED_CASES = f"WITH t AS ({TRUNCATION}), {CASES} SELECT item_id, case_name, decision_date, CASE WHEN ord%4=0 OR verdict_free_length=0 THEN original_length ELSE verdict_free_length END AS n_chars FROM cs JOIN t USING (item_id)"


def _slices(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = corpus.pairs(fixtures.cases(spark, sf_dir)).select("item_id", "article", "violation_label", "decision_date", "ord")
    return rows.where("ord % 5 < 3"), rows.where("ord % 5 >= 2").withColumn("violation_label", F.concat("violation_label", F.lit("_new")))


def merged_corpus(spark, sf_dir):
    """New rows in place of existing ones of equal keys, others behind them."""
    old, new = _slices(spark, sf_dir)
    out = tables.upsert(old, new, ["item_id", "article"])
    return rounded(out.select("item_id", "article", "violation_label", "place_source", "place"))


MERGED_CORPUS = f"WITH k AS ({CONCLUSION_PAIRS}) SELECT item_id, article, CASE WHEN item_id::BIGINT%5>=2 THEN violation_label||'_new' ELSE violation_label END AS violation_label, CASE WHEN item_id::BIGINT%5<3 THEN 0 ELSE 1 END::BIGINT AS place_source, item_id::BIGINT AS place FROM k"


def truly_new(spark, sf_dir):
    """Rows whose case, or whose case and article, isn't there yet."""
    old, new = _slices(spark, sf_dir)
    late = new.unionByName(old.where("ord % 5 = 0").withColumn("article", F.concat("article", F.lit("x"))))
    by = lambda name, keys: tables.unseen(late, old, keys).agg(F.count("*").alias("n"), F.min("ord").alias("first")).withColumn("rule", F.lit(name))
    return rounded(by("by_item", ["item_id"]).unionByName(by("by_pair", ["item_id", "article"])))


TRULY_NEW = f"WITH k AS ({CONCLUSION_PAIRS}), n AS (SELECT item_id::BIGINT AS d FROM k) SELECT count(*) AS n, min(d) AS first, 'by_item' AS rule FROM n WHERE d%5>=3 UNION ALL SELECT count(*), min(d), 'by_pair' FROM n WHERE d%5>=3 OR d%5=0"


def high_water_mark(spark, sf_dir):
    """The latest valid date, and the day before it to search from."""
    rows = fixtures.cases(spark, sf_dir).select(F.when(F.col("ord") % 9 == 0, "9999-99-99").when(F.col("ord") % 9 == 1, "soon").otherwise(F.col("decision_date")).alias("d"))
    mark = tables.high_water(rows, "d")
    return mark.select("high_water", F.date_sub(F.try_to_date("high_water", "yyyy-MM-dd"), 1).cast("string").alias("since"))


HIGH_WATER_MARK = f"WITH {CASES} SELECT max(decision_date) AS high_water, (max(decision_date)::DATE - 1)::DATE::VARCHAR AS since FROM cs WHERE ord%9>1"


def newest(spark, sf_dir):
    """The ten newest cases, undated ones last."""
    rows = fixtures.cases(spark, sf_dir).select("ord", "item_id", F.when(F.col("ord") % 2 == 0, F.col("decision_date")).otherwise("").alias("decision_date"))
    return rounded(tables.newest_first(rows, "decision_date", "ord").limit(10))


NEWEST = f"WITH {CASES} SELECT ord, item_id, CASE WHEN ord%2=0 THEN decision_date ELSE '' END AS decision_date FROM cs ORDER BY coalesce(nullif(CASE WHEN ord%2=0 THEN decision_date ELSE '' END,''),'0000-00-00') DESC, ord LIMIT 10"


def stratified_sample(spark, sf_dir):
    """All orders of fifteen drawn customers in each of the eight largest nations."""
    o = fixtures.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    draw = (F.col("o_custkey") * 7919 + 42) % 10007
    return rounded(tables.stratified(o.join(c, "o_custkey"), "c_nationkey", "o_custkey", "o_orderkey", 8, 15, draw).select("c_nationkey", "o_custkey", "o_orderkey"))


STRATIFIED_SAMPLE = """WITH j AS (SELECT o_orderkey, o_custkey, c_nationkey FROM orders JOIN customer ON o_custkey=c_custkey), t AS (SELECT c_nationkey FROM j GROUP BY 1 ORDER BY count(*) DESC, min(o_orderkey) LIMIT 8),
k AS (SELECT DISTINCT c_nationkey, o_custkey FROM j WHERE c_nationkey IN (SELECT * FROM t)), d AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY (o_custkey*7919+42)%10007, o_custkey) AS p FROM k)
SELECT j.c_nationkey::BIGINT AS c_nationkey, j.o_custkey, j.o_orderkey FROM j JOIN d USING (c_nationkey, o_custkey) WHERE p<=15"""


def seeded_sample(spark, sf_dir):
    """The same design with a sequential Mersenne Twister: no SQL counterpart, tested against a plain loop."""
    o = fixtures.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return rounded(tables.seeded_cases(o.join(c, "o_custkey"), "c_nationkey", "o_custkey", "o_orderkey", 8, 15, 42).select("c_nationkey", "o_custkey", "o_orderkey"))


def corpus_stats(spark, sf_dir):
    """Pairs, cases, share of violations and dates of each respondent."""
    rows = corpus.pairs(fixtures.cases(spark, sf_dir))
    return rounded(rows.groupBy(F.coalesce("lang", F.lit("UNKNOWN")).alias("respondent")).agg(F.count("*").alias("pairs"), F.count_distinct("item_id").alias("cases"), (100 * F.avg((F.col("violation_label") == "violation").cast("double"))).alias("violation_pct"), F.min("decision_date").alias("first_date"), F.max("decision_date").alias("last_date"), F.count_distinct("decision_date").alias("dates")))


CORPUS_STATS = f"WITH k AS ({CONCLUSION_PAIRS}), {CASES} SELECT coalesce(lang,'UNKNOWN') AS respondent, count(*) AS pairs, count(DISTINCT item_id) AS cases, round(100*avg((violation_label='violation')::INT::DOUBLE),6) AS violation_pct, min(decision_date) AS first_date, max(decision_date) AS last_date, count(DISTINCT decision_date) AS dates FROM k JOIN cs USING (item_id) GROUP BY 1"


def most_common(spark, sf_dir):
    """The ten most frequent sources, ties by first appearance."""
    return rounded(tables.value_counts(fixtures.cases(spark, sf_dir), "source", "ord", 10))


MOST_COMMON = f"WITH {CASES} SELECT source, count(*) AS n, min(ord) AS first_seen FROM cs GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 10"


def two_turns(spark, sf_dir):
    """Each user turn with the answer behind it, and the follow-up's messages."""
    c = fixtures.table(spark, sf_dir, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked"))
    said = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = user.join(said, ["conv_id", "turn"])
    turns = F.array(*(F.struct(F.lit(r).alias("role"), F.col(t).alias("content")) for r, t in (("user", "asked"), ("assistant", "answer"))), F.struct(F.lit("user").alias("role"), F.lit("Are you sure?").alias("content")))
    model = F.when(F.col("conv_id") % 2 == 0, "gemini").otherwise("other")
    sent = templates.conversation(F.lit("S"), turns, model)
    return rounded(pairs.select("conv_id", "turn", F.size(sent).alias("n_messages"), F.md5(F.array_join(F.transform(sent, lambda m: F.concat_ws(":", m["role"], m["content"])), "|")).alias("sent_md5"), templates.custom_id(F.col("conv_id"), F.col("turn"), "followup").alias("custom_id")))


TWO_TURNS = """WITH p AS (SELECT u.conv_id, u.turn, u.text AS q, a.text AS r FROM conversations u JOIN conversations a ON u.conv_id=a.conv_id AND a.turn=u.turn+1 WHERE u.role='user' AND a.role='assistant')
SELECT conv_id, turn, CASE WHEN conv_id%2=0 THEN 3 ELSE 4 END::BIGINT AS n_messages, md5(CASE WHEN conv_id%2=0 THEN 'user:S' || chr(10) || chr(10) || q ELSE 'system:S|user:' || q END || '|assistant:' || r || '|user:Are you sure?') AS sent_md5, conv_id || '_' || turn || '_followup' AS custom_id FROM p"""


def _models(spark, sf_dir) -> DataFrame:
    return fixtures.table(spark, sf_dir, "supplier").select(F.concat(F.lit("model_"), F.col("s_suppkey").cast("string")).alias("model"), (F.col("s_suppkey") * 0.25).cast("double").alias("input_cost_per_mtok"), (F.col("s_suppkey") * 1.5).cast("double").alias("output_cost_per_mtok"))


def experiment_costs(spark, sf_dir):
    """Calls and costs of every model and stage with subtotals and the total."""
    sizes = fixtures.table(spark, sf_dir, "customer").agg(F.count("*").alias("n_cases")).withColumn("n_samples", F.lit(5).cast("long"))
    return rounded(planning.cost_report(planning.costs(_models(spark, sf_dir), sizes)))


EXPERIMENT_COSTS = """WITH m AS (SELECT 'model_' || s_suppkey AS model, s_suppkey*0.25::DOUBLE AS i, s_suppkey*1.5::DOUBLE AS o FROM supplier), z AS (SELECT count(*) AS n, 5 AS s FROM customer),
c AS (SELECT model, 'baseline' AS stage, n*s AS n_calls, n*s*(16000*i+10*o)/1e6 AS usd FROM m,z UNION ALL SELECT model, 'rq1', 3*n+3*n*s, (3*n*(15000*i+600*o)+3*n*s*(800*i+10*o))/1e6 FROM m,z UNION ALL SELECT model, 'rq2', 3*n*s, 3*n*s*(800*i+10*o)/1e6 FROM m,z UNION ALL SELECT model, 'rq3', 2*n*s, 2*n*s*(16000*i+10*o)/1e6 FROM m,z)
SELECT coalesce(model,'ALL') AS model, coalesce(stage,'ALL') AS stage, sum(n_calls)::BIGINT AS n_calls, round(sum(usd),6) AS usd FROM c GROUP BY ROLLUP(model, stage)"""


def progress(spark, sf_dir):
    """Which stages of which models are done."""
    models = _models(spark, sf_dir)
    k = F.substring("model", 7, 20).cast("int")
    marks = models.select("model", F.explode(F.filter(F.array(*map(F.lit, planning.STAGES)), lambda s: (k + F.array_position(F.array(*map(F.lit, planning.STAGES)), s)) % 3 == 0)).alias("stage"))
    return planning.progress(models, marks)


PROGRESS = "SELECT 'model_' || s_suppkey AS model, " + ", ".join(f"CASE WHEN (s_suppkey+{i})%3=0 THEN 'done' ELSE 'PENDING' END AS {s}" for i, s in enumerate(planning.STAGES, 1)) + " FROM supplier"


def summaries_long(spark, sf_dir):
    """Summary versions as rows; an error or nothing is an empty summary, and framing texts fall back to the case's beginning."""
    docs = fixtures.table(spark, sf_dir, "documents")
    got = F.array(F.substring("text", 1, 20), F.when(F.col("doc_id") % 4 == 0, "ERROR: x").otherwise(F.substring("text", 5, 10)), F.lit(None).cast("string"))
    long = docs.select("doc_id", "text", F.posexplode(got).alias("version", "raw"))
    summary = F.when(templates.is_error(F.col("raw")), "").otherwise(F.col("raw"))
    return rounded(long.select("doc_id", "version", summary.alias("summary"), F.length(F.coalesce(F.nullif(summary, F.lit("")), F.substring("text", 1, 5000))).alias("used_chars")))


SUMMARIES_LONG = "WITH v AS (SELECT doc_id, text, 0 AS version, substr(text,1,20) AS s FROM documents UNION ALL SELECT doc_id, text, 1, CASE WHEN doc_id%4=0 THEN '' ELSE substr(text,5,10) END FROM documents UNION ALL SELECT doc_id, text, 2, '' FROM documents) SELECT doc_id, version::BIGINT AS version, s AS summary, length(CASE WHEN s='' THEN substr(text,1,5000) ELSE s END) AS used_chars FROM v"

_WITH_SQL = "conclusion_pairs truncation truncation_stats repair respondents placeholders prompts ratings_from_text json_answers search_metadata dated_cases published_cases merged_corpus truly_new high_water_mark newest stratified_sample corpus_stats most_common two_turns experiment_costs progress summaries_long".split()
QUERIES = {name: globals()[name] for name in [*_WITH_SQL, "html_lines", "seeded_sample"]}
ORACLES = {name: nudged(globals()[name.upper()]) for name in _WITH_SQL}
