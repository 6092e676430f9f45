"""Queries that acquire and keep corpora: paged search, split JSON arrays, a database, upserts, kept steps, a live refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ratings as R
from ..functions import templates
from ..operators import corpus, reduce, sinks
from ..operators.steps import Run
from ..operators.store import Store
from ..schemas import schema
from ..sources import database, fixtures, json_split, paged, readers, saved, search
from ..storage import scratch
from . import stages
from .corpus import CASES, CONCLUSION_PAIRS, _cut
from .ratings import SAMPLES, nudged, rounded


def _server(spark: SparkSession, sf_dir: str) -> tuple[dict, int]:
    """A search service over all case documents, saved in pages: its options, and how many places it has."""
    rows = fixtures.cases(spark, sf_dir)
    escaped = F.replace(F.replace(F.col("full_case_text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    c = F.struct(
        F.col("item_id").alias("itemid"), F.col("case_name").alias("docname"), F.lit("1/20").alias("appno"), F.concat("decision_date", F.lit("T00:00:00")).alias("kpdate"), F.upper("lang").alias("respondent"),
        F.lit("3;8").alias("article"), F.col("conclusion").alias("conclusion"), *(F.lit("").alias(n) for n in ("languageisocode", "importance", "ecli", "doctypebranch", "separateopinion")),
    )
    folder = scratch(spark, "server")
    places = saved.save(rows.select(F.col("ord").alias("place"), c.alias("columns"), escaped.alias("html")), folder, "place")
    return {"folder": folder, "places": str(places)}, places


def paged_hits(spark, sf_dir):
    """Every hit of a search, page by page, as flat rows."""
    options, _ = _server(spark, sf_dir)
    rows = spark.read.format(paged.source(spark)).options(service="judgeloom.sources.saved:service", page="120", query=search.query("2020-02-01"), **options).load()
    hits = rows.select("place", F.from_json("hit", schema("hit")).alias("h")).select("place", "h.columns")
    return corpus.metadata(hits).select("item_id", "case_name", "decision_date", "respondent", F.array_join("articles", ";").alias("articles"), "conclusion")


PAGED_HITS = f"WITH {CASES} SELECT item_id, case_name, decision_date, upper(lang) AS respondent, '3;8' AS articles, conclusion FROM cs WHERE decision_date >= '2020-02-01'"


def paged_stream(spark, sf_dir):
    """New hits as a stream, merged into a table as they come: two batches, the second of what the service has got since."""
    options, places = _server(spark, sf_dir)
    store, name, check = scratch(spark, "hits"), paged.source(spark), scratch(spark, "checkpoint")

    def merge(batch: DataFrame, number: int) -> None:
        flat = corpus.metadata(batch.select("place", F.from_json("hit", schema("hit")).alias("h")).select("place", "h.columns"))
        Store(batch.sparkSession, store, ["item_id"], "decision_date", 8).upsert(flat.select("item_id", "case_name", "decision_date"), number)

    for seen in (places // 2, places):
        stream = spark.readStream.format(name).options(service="judgeloom.sources.saved:service", page="500", **(options | {"places": str(seen)})).load()
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return Store(spark, store, ["item_id"], "decision_date", 8).read()


PAGED_STREAM = f"WITH {CASES} SELECT item_id, case_name, decision_date FROM cs"


#: Elements of one written array, at most: a file is one task's work.
ARRAY = 5000


def json_elements(spark, sf_dir):
    """Cases written as JSON arrays without line breaks, read back in splits."""
    rows = fixtures.cases(spark, sf_dir).select("item_id", "case_name", "full_case_text", F.struct(F.col("source").alias("braces"), F.lit('a "{" and }, \\').alias("odd")).alias("nested"), "ord")
    place = F.floor(F.col("ord") / 3)
    parts = rows.select((F.col("ord") % 3).alias("file"), F.floor(place / ARRAY).alias("part"), "ord", F.to_json(F.struct("item_id", "case_name", "full_case_text", "nested")).alias("value"))
    # an array a file: its elements, with the marks before and between them. A window keeps a file's rows in one task, a join would let them be dealt to several
    inside = Window.partitionBy("file", "part").orderBy("ord")
    value = F.concat(F.when(F.row_number().over(inside) == 1, "[").otherwise(", "), "value", F.when(F.lead("ord").over(inside).isNull(), "]").otherwise(""))
    folder = scratch(spark, "arrays")
    parts.select("file", "part", value.alias("value")).write.option("lineSep", " ").partitionBy("file", "part").text(folder)
    fields = "item_id string, case_name string, full_case_text string, nested struct<braces: string, odd: string>"
    back = json_split.json_array(spark, folder, T.StructType.fromDDL(fields), "path")
    before = F.regexp_extract("path", r"/part=(\d+)/", 1).cast("long") * ARRAY
    return rounded(back.select("item_id", "case_name", F.md5("full_case_text").alias("text_md5"), "nested.braces", "nested.odd", (before + F.col("ord")).alias("ord")))


JSON_ELEMENTS = f"""WITH {CASES} SELECT item_id, case_name, md5(full_case_text) AS text_md5, source AS braces, 'a "{{" and }}, \\' AS odd, ord//3 AS ord FROM cs"""


def upsert_versions(spark, sf_dir):
    """Orders in three versions of a table: each rewrites the partitions of its keys; the rows with the version that wrote each."""
    o = fixtures.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.lit(0).alias("version"))
    store = Store(spark, scratch(spark, "orders"), ["o_orderkey"], "version", 16)
    changed = lambda version, of: o.where(of).withColumns({"o_totalprice": F.col("o_totalprice") + version, "version": F.lit(version)})
    for version, rows in enumerate((o.where("o_orderkey % 5 <> 0"), changed(1, "o_orderkey % 10 = 0"), changed(2, "o_custkey % 3 = 0"))):
        store.upsert(rows, version)
    return rounded(store.read())


UPSERT_VERSIONS = """SELECT o_orderkey, o_custkey, round(o_totalprice + CASE WHEN o_custkey%3=0 THEN 2 WHEN o_orderkey%10=0 THEN 1 ELSE 0 END,6) AS o_totalprice, CASE WHEN o_custkey%3=0 THEN 2 WHEN o_orderkey%10=0 THEN 1 ELSE 0 END::BIGINT AS version
FROM orders WHERE o_orderkey%5<>0 OR o_orderkey%10=0 OR o_custkey%3=0"""


def gated_stages(spark, sf_dir):
    """A run of four steps that is stopped at the third, resumed, and reset from the second: how often each was computed, and what came out."""
    docs, broken, count = fixtures.table(spark, sf_dir, "documents"), [True], dict.fromkeys(("cases", "by_source", "by_lang", "report"), 0)

    def step(name, compute):
        def counted(*needed):
            count[name] += 1
            if name == "by_lang" and broken[0]:
                raise InterruptedError(name)
            return compute(*needed)

        return counted

    sums = lambda df, c: df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))
    steps = {
        "cases": ([], step("cases", lambda: docs.select("doc_id", "source", "lang", "n_chars"))),
        "by_source": (["cases"], step("by_source", lambda c: sums(c, "source"))),
        "by_lang": (["cases"], step("by_lang", lambda c: sums(c, "lang"))),
        "report": (["by_source", "by_lang"], step("report", lambda a, b: a.withColumn("kind", F.lit("source")).unionByName(b.withColumn("kind", F.lit("lang"))))),
    }
    run = Run(spark, steps)
    try:
        run.all()
    except InterruptedError:
        broken[0] = False
    run.all()
    run.reset("by_source")
    out = run.table("report")
    told = F.create_map(*(x for name, n in count.items() for x in (F.lit(name), F.lit(n))))
    return rounded(out.withColumns({f"runs_{name}": told[name] for name in count}))


GATED_STAGES = """SELECT value, count(*) AS n, sum(n_chars)::BIGINT AS n_chars, kind, 1::BIGINT AS runs_cases, 2::BIGINT AS runs_by_source, 2::BIGINT AS runs_by_lang, 2::BIGINT AS runs_report
FROM (SELECT source AS value, n_chars, 'source' AS kind FROM documents UNION ALL SELECT lang, n_chars, 'lang' FROM documents) GROUP BY value, kind"""


def live_refresh(spark, sf_dir):
    """Two generations of a search service: the first half of its cases on an empty table, then all of them from the latest date on; a third refresh finds nothing."""
    options, places = _server(spark, sf_dir)
    store, fetch, runs = Store(spark, scratch(spark, "live"), ["item_id", "article"], "ord", 16), saved.text(options), scratch(spark, "runs")
    unsure = {"a": lambda asked: asked.select("item_id", "article", F.lit("no json").alias("response"))}
    for version, seen in enumerate((places // 2, places, places)):
        stages.live(spark, store, f"{runs}/{version}", saved.service(options | {"places": str(seen)}), fetch, unsure, version, "9999-12-31")
    out = store.read().select("item_id", "article", "violation_label", "decision_date", "respondent", "verdict_removal_method", "verdict_free_length", "excluded", F.md5("full_case_text_no_verdict").alias("text_md5"))
    return rounded(out.withColumn("versions", F.lit(len(store.versions()))))


#: A text as it comes out of a page: white space at the ends of lines and in runs goes, and empty lines beyond one.
_PLAIN = "trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(full_case_text, '\\n{3,}', chr(10)||chr(10), 'g'), chr(10)), lambda l: trim(l, ' ')), chr(10)), '[ \\t]+', ' ', 'g'), ' ' || chr(10))"
LIVE_REFRESH = f"""WITH {CASES}, k AS ({CONCLUSION_PAIRS}), p AS (SELECT item_id, decision_date, upper(lang) AS respondent, {_PLAIN} AS plain FROM cs), t AS (SELECT *, {_cut("plain")} AS u FROM p WHERE length(plain) >= 500)
SELECT item_id, article, violation_label, decision_date, respondent, u.method AS verdict_removal_method, length(u.text) AS verdict_free_length, length(u.text) < 500 AS excluded, md5(u.text) AS text_md5, 2::BIGINT AS versions FROM t JOIN k USING (item_id)"""


def jdbc_pairs(spark, sf_dir):
    """Cases in an embedded database, read in bounded partitions with the filters pushed, a row an article and outcome."""
    rows = fixtures.cases(spark, sf_dir).select("item_id", F.col("case_name").alias("doc_name"), "conclusion", F.col("full_case_text").alias("full_text"), F.upper("lang").alias("respondent"), F.col("decision_date").alias("kp_date"), F.lit("ENG").alias("language_iso"))
    kinds = '"item_id" VARCHAR(40), "doc_name" VARCHAR(400), "conclusion" VARCHAR(400), "full_text" CLOB, "respondent" VARCHAR(20), "kp_date" VARCHAR(16), "language_iso" VARCHAR(5)'
    urls = database.load(rows, "cases", kinds)
    last = rows.agg(F.max("kp_date")).first()[0] or stages.EPOCH
    cases = readers.jdbc_cases(spark, urls, "cases", database.DRIVER, parts=('"kp_date"', stages.EPOCH, last, 4), since="2020-01-15", language="ENG")
    return corpus.pairs(cases.withColumnRenamed("full_text", "full_case_text")).select("item_id", "doc_name", "kp_date", "article", "violation_label", F.md5("full_case_text").alias("text_md5"))


JDBC_PAIRS = f"WITH {CASES}, k AS ({CONCLUSION_PAIRS}) SELECT item_id, case_name AS doc_name, decision_date AS kp_date, article, violation_label, md5(full_case_text) AS text_md5 FROM cs JOIN k USING (item_id) WHERE length(full_case_text) > 500 AND decision_date >= '2020-01-15' AND lower(case_name) NOT LIKE '%translation%'"

def csv_round_trip(spark, sf_dir):
    """Evaluations written as CSV with their ratings as text, and read back as arrays."""
    rows = reduce.cases(fixtures.samples(spark, sf_dir, "factual"), ["evaluator", "case_id", "art", "violation_label"])
    folder = scratch(spark, "csv")
    held = rows.select("evaluator", F.col("case_id").cast("string").alias("case_name"), F.col("art").cast("string").alias("article"), "violation_label", R.mean(F.col("ratings")).alias("avg_rating"), F.lit(True).alias("is_accurate"), F.lit(0).alias("num_abstentions"), F.size("ratings").alias("num_samples"), F.col("ratings").alias("sample_ratings"))
    sinks.csv(held.drop("evaluator"), folder)
    back = readers.evaluations(spark, folder)
    return rounded(back.select("case_name", "article", "violation_label", "avg_rating", "num_samples", F.array_join(F.transform("sample_ratings", lambda r: r.cast("string")), ",").alias("ratings")))


CSV_ROUND_TRIP = f"WITH {SAMPLES} SELECT case_id::VARCHAR AS case_name, art::VARCHAR AS article, violation_label, round(avg(rating::DOUBLE),6) AS avg_rating, count(*) AS num_samples, string_agg(rating::VARCHAR, ',' ORDER BY sample_idx) AS ratings FROM samples WHERE framing='factual' GROUP BY ALL"


def resumed_lines(spark, sf_dir):
    """Summaries written as lines of JSON in two runs: the second leaves out what the first has written, a cached table is read as it was."""
    docs, folder = fixtures.table(spark, sf_dir, "documents"), scratch(spark, "lines")
    rows = docs.select(F.col("doc_id").cast("string").alias("item_id"), F.lit("3").alias("article"), F.lit(0).alias("version"), F.col("text").alias("summary"))
    first = readers.cached_or(spark, f"{folder}/cached", lambda: rows.where("item_id % 3 = 0"))
    again = readers.cached_or(spark, f"{folder}/cached", lambda: rows)  # it is there: not computed
    sinks.json_lines(first, f"{folder}/lines")
    sinks.json_lines(readers.fresh(rows, f"{folder}/cached", "item_id").withColumn("version", F.lit(1)), f"{folder}/lines", "append")
    back = readers.json_rows(spark, f"{folder}/lines", "summary").withColumn("cached", F.lit(again.count()))
    return rounded(back.select("item_id", "article", "version", F.md5("summary").alias("summary_md5"), "cached"))


RESUMED_LINES = "SELECT doc_id::VARCHAR AS item_id, '3' AS article, CASE WHEN doc_id%3=0 THEN 0 ELSE 1 END::BIGINT AS version, md5(text) AS summary_md5, (SELECT count(*) FROM documents WHERE doc_id%3=0) AS cached FROM documents"


def percent_texts(spark, sf_dir):
    """Discounts, taxes and their differences as percent texts, ties and signs included."""
    l = fixtures.table(spark, sf_dir, "lineitem")  # noqa: E741
    v = (F.col("l_discount").cast("double") - F.col("l_tax").cast("double")) * F.col("l_quantity").cast("double") / 16
    return l.select("l_orderkey", "l_linenumber", v.alias("v")).groupBy("v").agg(F.count("*").alias("n")).select(templates.percent_text(F.col("v")).alias("plain"), templates.percent_text(F.col("v"), True).alias("signed"), "n").groupBy("plain", "signed").agg(F.sum("n").alias("n"))


PERCENT_TEXTS = "WITH v AS (SELECT (l_discount::DOUBLE - l_tax::DOUBLE) * l_quantity::DOUBLE / 16 AS v FROM lineitem) SELECT CASE WHEN v<0 THEN '-' ELSE '' END || printf('%.1f', abs(v*100)) AS plain, CASE WHEN v<0 THEN '-' ELSE '+' END || printf('%.1f', abs(v*100)) AS signed, count(*) AS n FROM v GROUP BY ALL"

_NAMES = "paged_hits paged_stream json_elements upsert_versions gated_stages live_refresh jdbc_pairs csv_round_trip resumed_lines percent_texts".split()
QUERIES = {name: globals()[name] for name in _NAMES}
ORACLES = {name: nudged(globals()[name.upper()]) for name in _NAMES}
