"""Composite stages: from cases to requests, responses, ratings and judged cases; acquisition and refresh of a corpus.

Cases have item_id, case_name, article, violation_label and a text. ``respond`` maps requests (custom_id, ...) to
responses (custom_id, response); every stage keys on item_id, article and sample, so that cases with
several articles never share an answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratings as R
from ..functions import templates
from ..functions import text as X
from ..operators import corpus, pairing, reduce, tables
from ..operators.steps import Run, Step
from ..operators.store import Store
from ..sources import responder, search
from ..sources.readers import fresh

Respond = Callable[[DataFrame], DataFrame]
KEY = ["item_id", "article"]
CAP, SUMMARY_VERSIONS = 50_000, 3
CHALLENGE = "Are you sure? Answer again with the number alone."


def text_of(*columns: str, cap: int = CAP) -> Column:
    """The first filled text, up to cap characters."""
    return F.substring(F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns), F.lit("")), 1, cap)


def _sampled(cases: DataFrame, n: int) -> DataFrame:
    return cases.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else cases.withColumn("sample_idx", F.lit(0)).limit(0)


def rated(grid: DataFrame, prompt: Column, respond: Respond, model: str | Column, by: list[str]) -> DataFrame:
    """grid with a rating a row; a row without an answer abstains."""
    held = grid.withColumn("custom_id", templates.custom_id(*(F.col(c) for c in by), "sample", F.col("sample_idx")))
    got = respond(responder.requests(held, model if isinstance(model, Column) else F.lit(model), prompt, F.col("custom_id")))
    # a plan's size doesn't count exploded rows: they are never sent through the driver
    return held.join(got.hint("merge"), "custom_id", "left").withColumn("rating", R.extract(F.coalesce("response", F.lit("")))).drop("response")


def _judged(rows: DataFrame, by: list[str]) -> DataFrame:
    return reduce.judged(reduce.cases(rows, [*by, "case_name", "violation_label"]), F.col("violation_label") == "violation")


def _outcome(df: DataFrame) -> DataFrame:
    """Vote, whether it is right (an abstention is wrong), and whether it abstains."""
    return df.withColumn("accurate", F.col("prediction") == F.col("violation_label")).withColumn("abstained", F.col("prediction") == "abstention")


def baseline(cases: DataFrame, respond: Respond, model: str, samples: int = 10, text: Column | None = None) -> DataFrame:
    body = text if text is not None else text_of("full_case_text_no_verdict", "full_case_text")
    prompt = templates.by_framing(F.lit("predictive"), body, F.col("article"))
    return _outcome(_judged(rated(_sampled(cases, samples), prompt, respond, model, KEY), KEY)).select(*KEY, "case_name", "violation_label", "prediction", "accurate", "abstained", "ratings", "avg_rating")


def summaries(cases: DataFrame, respond: Respond, model: str, versions: int = SUMMARY_VERSIONS) -> DataFrame:
    """item_id, article, version, summary; an error or no answer is an empty summary."""
    grid = cases.withColumn("version", F.explode(F.sequence(F.lit(0), F.lit(versions - 1)))).withColumn("custom_id", templates.custom_id(F.col("item_id"), F.col("article"), "summary", F.col("version")))
    prompt = F.concat(F.lit("Summarise:\n\n"), text_of("full_case_text_no_verdict", "full_case_text"))
    got = respond(responder.requests(grid, F.lit(model), prompt, F.col("custom_id"), max_tokens=600))
    return grid.join(got.hint("merge"), "custom_id", "left").select(*KEY, "version", F.when(templates.is_error(F.col("response")), "").otherwise(F.col("response")).alias("summary"))


def on_summaries(cases: DataFrame, made: DataFrame, base: DataFrame, respond: Respond, model: str, samples: int = 10) -> DataFrame:
    """Every summary version rated and compared with the baseline's vote."""
    by = [*KEY, "version"]
    grid = _sampled(cases.select(*KEY, "case_name", "violation_label").join(made, KEY), samples)
    out = _outcome(_judged(rated(grid, templates.by_framing(F.lit("predictive"), F.col("summary"), F.col("article")), respond, model, by), by))
    return pairing.aligned_with(out, tables.dedupe(base.withColumn("__o", F.lit(0)), KEY, "__o", "first").drop("__o"), KEY).select(*by, "case_name", "violation_label", "prediction", "accurate", "aligned", "ratings")


def on_framings(cases: DataFrame, made: DataFrame, base: DataFrame, respond: Respond, model: str, samples: int = 10) -> DataFrame:
    """All framings on the first summary, or the beginning of the text without one."""
    first = made.where("version = 0").select(*KEY, "summary")
    body = F.coalesce(F.nullif("summary", F.lit("")), text_of("full_case_text_no_verdict", "full_case_text", cap=5000))
    grid = cases.join(first, KEY, "left").withColumn("body", body).withColumn("framing", F.explode(F.array(*map(F.lit, templates.FRAMINGS))))
    by = [*KEY, "framing"]
    out = _outcome(_judged(rated(_sampled(grid, samples), templates.by_framing(F.col("framing"), F.col("body"), F.col("article")), respond, model, by), by))
    return pairing.aligned_with(out, base, KEY).withColumnRenamed("aligned", "aligned_with_baseline").select(*by, "case_name", "violation_label", "prediction", "accurate", "aligned_with_baseline", "ratings")


def reconsidered(cases: DataFrame, respond: Respond, model: str, samples: int = 10) -> DataFrame:
    """Each sample asked again behind its own answer; without a second answer the first one stands."""
    prompt = templates.by_framing(F.lit("predictive"), text_of("full_case_text_no_verdict", "full_case_text"), F.col("article"))
    first = rated(_sampled(cases, samples), prompt, respond, model, KEY)
    turns = F.array(*(F.struct(F.lit(r).alias("role"), t.alias("content")) for r, t in (("user", prompt), ("assistant", F.col("rating").cast("string")), ("user", F.lit(CHALLENGE)))))
    again = first.withColumn("custom_id", F.concat("custom_id", F.lit("_followup")))
    asked = again.select("custom_id", F.lit(model).alias("model"), templates.conversation(F.lit(templates.SYSTEM), turns, F.lit(model)).alias("messages"))
    both = again.join(respond(asked).hint("merge"), "custom_id", "left").withColumn("second", F.when(F.coalesce(F.col("response"), F.lit("")) == "", F.col("rating")).otherwise(R.extract(F.col("response"))))
    held = both.groupBy(*KEY, "case_name", "violation_label").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "rating", "second"))).alias("s"))
    a, b = F.col("s.rating"), F.col("s.second")
    rows = held.select(*KEY, "case_name", "violation_label", a.alias("original_ratings"), b.alias("challenged_ratings"))
    rows = rows.withColumn("original_prediction", R.vote(F.col("original_ratings"))).withColumn("challenged_prediction", R.vote(F.col("challenged_ratings")))
    changes = F.size(F.filter(F.arrays_zip(F.col("original_ratings").alias("a"), F.col("challenged_ratings").alias("b")), lambda x: x["a"] != x["b"]))
    return rows.select(
        "*",
        (F.col("original_prediction") == F.col("violation_label")).alias("original_accurate"),
        (F.col("challenged_prediction") == F.col("violation_label")).alias("challenged_accurate"),
        (F.col("original_prediction") != F.col("challenged_prediction")).alias("prediction_changed"),
        (changes / F.size("original_ratings")).alias("change_rate"),
        F.transform(F.arrays_zip(F.col("original_ratings").alias("a"), F.col("challenged_ratings").alias("b")), lambda x: R.direction(x["a"], x["b"])).alias("individual_changes"),
    )


def matrix(cases: DataFrame, texts: dict[str, Column], evaluators: list[str], respond: Respond, samples: int = 10) -> DataFrame:
    """summary, evaluator, accuracy, abstention_rate of every text by every evaluator: conditions are columns of one plan."""
    every = F.array(*(F.struct(F.lit(name).alias("summary"), text.alias("body")) for name, text in texts.items()))
    grid = cases.withColumn("__text", F.explode(every)).select(*KEY, "case_name", "violation_label", F.col("__text.summary").alias("summary"), F.col("__text.body").alias("body"), F.explode(F.array(*map(F.lit, evaluators))).alias("evaluator"))
    by = ["evaluator", "summary", *KEY]
    prompt = templates.by_framing(F.lit("predictive"), F.col("body"), F.col("article"))
    judged = _judged(rated(_sampled(grid, samples), prompt, respond, F.col("evaluator"), by), by)
    return judged.groupBy("summary", "evaluator").agg(reduce.share(F.col("is_accurate")).alias("accuracy"), (F.sum("num_abstentions") / F.nullif(F.sum("num_samples"), F.lit(0))).alias("abstention_rate"))


def pivots(cells: DataFrame, evaluators: list[str]) -> tuple[DataFrame, DataFrame]:
    """The matrix as two tables, a row a summary and a column an evaluator: accuracies and abstention rates."""
    wide = lambda value: cells.groupBy("summary").pivot("evaluator", evaluators).agg(F.first(value, ignorenulls=True))
    return wide("accuracy"), wide("abstention_rate")


#: Figures of the stages in the summary of all models, in their order.
SUMMARY = (
    "baseline_accuracy", "baseline_abstention", "baseline_avg_rating", "rq1_accuracy", "rq1_alignment", "rq2_predictive_accuracy", "rq2_predictive_alignment", "rq2_normative_accuracy", "rq2_normative_alignment", "rq2_factual_accuracy", "rq2_factual_alignment",
    "rq3_orig_accuracy", "rq3_chal_accuracy", "rq3_change_rate", "rq3_avg_individual_change",
)


def summary(models: DataFrame, base: DataFrame | None = None, rq1: DataFrame | None = None, rq2: DataFrame | None = None, rq3: DataFrame | None = None) -> DataFrame:
    """One row a model with all figures of SUMMARY: models (a column model) and the rows of each stage with their model. A stage that nobody or a model lacks is null."""
    rate = lambda c: reduce.share(F.col(c))
    parts = []
    if base is not None:
        # an average over cases of their mean ratings, as the cases' ratings have it
        parts.append(base.groupBy("model").agg(rate("accurate").alias("baseline_accuracy"), rate("abstained").alias("baseline_abstention"), F.avg("avg_rating").alias("baseline_avg_rating")))
    if rq1 is not None:
        parts.append(rq1.groupBy("model").agg(rate("accurate").alias("rq1_accuracy"), rate("aligned").alias("rq1_alignment")))
    if rq2 is not None:
        of = lambda f, c: F.avg(F.when(F.col("framing") == f, F.col(c).cast("double")))
        parts.append(rq2.groupBy("model").agg(*(of(f, c).alias(f"rq2_{f}_{name}") for f in templates.FRAMINGS for c, name in (("accurate", "accuracy"), ("aligned_with_baseline", "alignment")))))
    if rq3 is not None:
        parts.append(rq3.groupBy("model").agg(rate("original_accurate").alias("rq3_orig_accuracy"), rate("challenged_accurate").alias("rq3_chal_accuracy"), rate("prediction_changed").alias("rq3_change_rate"), F.avg("change_rate").alias("rq3_avg_individual_change")))
    out = models.select("model").distinct()
    for part in parts:
        out = out.join(part, "model", "left")
    return out.select("model", *(F.col(c) if c in out.columns else F.lit(None).cast("double").alias(c) for c in SUMMARY))


def scrape(spark, find: search.Search, fetch: search.Fetch, expression: str, existing: str | None = None, dry_run: bool = False) -> DataFrame:
    """Search hits with their texts as a row a case and article; ids already in the output at existing are left out."""
    hits = corpus.metadata(search.hits(spark, find, expression))
    if existing:
        hits = fresh(hits, existing, "item_id")
    if dry_run:
        return hits.withColumn("article", F.array_join("articles", ";")).drop("articles").withColumn("full_case_text", F.lit("")).withColumn("violation_label", F.lit(""))
    got = search.documents(hits, fetch).where(F.length("full_case_text") >= 500)
    return corpus.pairs(got.select("item_id", "case_name", "decision_date", "respondent", "conclusion", "full_case_text")).drop("conclusion")


def without_verdicts(cases: DataFrame, verifiers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Truncation, verification of what no pattern truncated, repair of what leaks. A verifier maps (item_id, article, text) to (item_id, article, response)."""
    return verified(corpus.truncated(cases), verifiers)


def verified(cut: DataFrame, verifiers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The second half of it, for truncated cases (best a written table, for they are read for every verifier)."""
    return mended(cut, verdicts(cut, verifiers)) if verifiers else cut


def verdicts(cut: DataFrame, verifiers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """item_id, article, leaks, sentences of what no pattern truncated."""
    asked = cut.where(corpus.needs_verification(cut)).select(*KEY, F.col("full_case_text_no_verdict").alias("text"))
    answers = None
    for name, verify in verifiers.items():
        part = verify(asked).withColumn("verifier", F.lit(name))
        answers = part if answers is None else answers.unionByName(part)
    if answers is None:
        answers = asked.select(*KEY, F.lit("").alias("response"), F.lit("").alias("verifier")).limit(0)
    return corpus.verdicts(answers, KEY)


def mended(cut: DataFrame, said: DataFrame, whole: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Truncated cases with what leaks repaired. whole: adds to rows what cut leaves out, after the join that moves them."""
    found = cut.where(corpus.needs_verification(cut)).join(said, KEY, "left")
    leaking = F.coalesce("leaks", F.lit(False))
    kept = whole(cut.where(~corpus.needs_verification(cut)))
    fixed = corpus.repaired(whole(found.where(leaking)))
    return kept.unionByName(whole(found.where(~leaking)).select(*kept.columns)).unionByName(fixed.select(*kept.columns))


def _whole(cut: DataFrame) -> DataFrame:
    """Kept steps leave out the truncated text: it is the beginning of the text, as long as its length tells."""
    return cut.withColumn("full_case_text_no_verdict", F.substring(F.col("full_case_text"), F.lit(1), F.col("verdict_free_length")))


#: Where a search begins that has nothing to go on from.
EPOCH = "2020-01-01"


def live_steps(spark, store: Store, find: search.Search, fetch: search.Fetch, verifiers: dict[str, Callable[[DataFrame], DataFrame]], today: str, since: str = "", country: str = "") -> dict[str, Step]:
    """The steps of a refresh: plan, hits, new, cases, cut, verdicts. The search begins a day before the latest date that the store has, and ends with nothing where that is today."""

    def plan() -> DataFrame:
        existing = store.read()
        dates = existing.select("decision_date") if existing is not None else spark.createDataFrame([], "decision_date string")
        day = F.date_sub(F.try_to_date("high_water", "yyyy-MM-dd"), 1).cast("string")
        begin = F.lit(since) if since else F.coalesce(day, F.lit(EPOCH))
        return tables.high_water(dates, "decision_date").select("high_water", begin.alias("since"), (begin >= F.lit(today)).alias("up_to_date"))

    def hits(planned: DataFrame) -> DataFrame:
        row = planned.first()
        found = corpus.metadata(search.hits(spark, find, search.query(row["since"], country=country)).select(F.struct("columns.*").alias("columns")))
        return found.limit(0) if row["up_to_date"] else tables.dedupe(found.withColumn("__ord", F.col("decision_date")), ["item_id"], "__ord", "first").drop("__ord")

    def new(found: DataFrame) -> DataFrame:
        existing = store.read()
        return found if existing is None else tables.unseen(found, existing, ["item_id"])

    def cases(rows: DataFrame) -> DataFrame:
        # metadata is small and would be few tasks; neighbours in time are fetched together
        dealt = rows.repartitionByRange(4 * spark.sparkContext.defaultParallelism, "decision_date", "item_id").sortWithinPartitions("decision_date", "item_id")
        return search.documents(dealt, fetch).where(F.length("full_case_text") >= X.MIN_LENGTH).select("item_id", "case_name", "decision_date", "respondent", "conclusion", "full_case_text")

    def cut(rows: DataFrame) -> DataFrame:
        return corpus.pairs(corpus.truncated(rows).drop("full_case_text_no_verdict")).drop("conclusion")

    return {"plan": ([], plan), "hits": (["plan"], hits), "new": (["hits"], new), "cases": (["new"], cases), "cut": (["cases"], cut), "verdicts": (["cut"], lambda rows: verdicts(_whole(rows), verifiers))}


def live(spark, store: Store, folder: str, find: search.Search, fetch: search.Fetch, verifiers: dict[str, Callable[[DataFrame], DataFrame]], version: int, today: str, since: str = "", country: str = "") -> list[int]:
    """One refresh of a store of cases (keys item_id and article, order ord): what the search has new, without verdicts, merged as a version.

    folder keeps the steps, so a refresh that was stopped goes on where it was; a version that is there is left as it is. Returns the buckets that were written; none, and no version, where nothing is new."""
    if version in store.versions():
        return []
    run = Run(spark, live_steps(spark, store, find, fetch, verifiers, today, since, country), folder)
    said, cut = run.table("verdicts"), run.table("cut")
    if cut.isEmpty():
        return []
    clean = mended(cut, said, _whole) if verifiers else _whole(cut)
    return store.upsert(clean.withColumn("ord", F.monotonically_increasing_id()), version)


def refresh(existing: DataFrame, incoming: DataFrame, by_item: bool = True) -> DataFrame:
    """existing with the incoming rows that it lacks: by case, or by case and article with newer rows winning."""
    new = tables.unseen(incoming, existing, ["item_id"]) if by_item else incoming
    merged = tables.upsert(existing, new, KEY)
    return tables.newest_first(merged, "decision_date", "place").drop("place", "place_source")
