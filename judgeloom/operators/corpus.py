"""Corpus stages: pairs from conclusions, truncation, verification, repair, names, publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.binding import let
from ..schemas import schema
from .tables import first_value


def pairs(cases: DataFrame, conclusion: str = "conclusion", text: str = "full_case_text") -> DataFrame:
    """A row per article and outcome; without any the case stays once, as unknown (only with a text if it has a conclusion)."""
    found = F.col("__pairs")
    unknown = F.array(F.struct(F.lit("").alias("article"), F.lit("unknown").alias("label")))
    empty = F.coalesce(F.col(conclusion), F.lit("")) == ""
    keep = F.when(F.size(found) > 0, found).when(empty | (F.coalesce(F.length(text), F.lit(0)) > 0), unknown).otherwise(F.slice(unknown, 1, 0))
    held = cases.withColumn("__pairs", X.conclusion_pairs(F.col(conclusion)))
    return held.withColumn("__pair", F.explode(keep)).select(*cases.columns, F.col("__pair.article").alias("article"), F.col("__pair.label").alias("violation_label"))


def truncated(cases: DataFrame, text: str = "full_case_text", min_length: int = X.MIN_LENGTH) -> DataFrame:
    """Adds the text before its assessment, the method, lengths, retention and whether the case is excluded as too short."""
    cut = cases.withColumn("__cut", X.truncate(F.col(text)))
    out = cut.select(*cases.columns, F.col("__cut.text").alias("full_case_text_no_verdict"), F.col("__cut.method").alias("verdict_removal_method"))
    length, whole = F.length("full_case_text_no_verdict"), F.length(text)
    return out.select(
        "*",
        whole.alias("original_length"),
        length.alias("verdict_free_length"),
        X.retention(length, whole).alias("retention_percentage"),
        (length < min_length).alias("excluded"),
        F.when(length < min_length, "too_short").otherwise("").alias("exclusion_reason"),
    )


def needs_verification(cases: DataFrame) -> Column:
    """Cases that no pattern truncated are the ones to verify."""
    return ~F.col("excluded") & (F.col("verdict_removal_method") == X.NO_TRUNCATION)


def verdicts(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Verifiers' answers (verifier, response) a case: any leak counts, their sentences together in the verifiers' order."""
    answer = F.from_json(X.unfenced(F.col("response")), schema("leakage"))
    read = responses.select(*keys, "verifier", answer.alias("a"))
    held = F.array_sort(F.collect_list(F.struct("verifier", F.coalesce("a.leaking_sentences", F.array().cast("array<string>")).alias("s"))))
    return read.groupBy(*keys).agg(F.coalesce(F.bool_or("a.leaks_verdict"), F.lit(False)).alias("leaks"), F.flatten(F.transform(held, lambda h: h["s"])).alias("sentences"))


def repaired(cases: DataFrame, sentences: str = "sentences", min_length: int = X.MIN_LENGTH) -> DataFrame:
    """Leaking sentences removed, remaining conclusory patterns cut in order; a case that gets too short is excluded and keeps its text."""
    cut = let(X.without_sentences(F.col("full_case_text_no_verdict"), F.col("verdict_removal_method"), F.col(sentences)), lambda s: X.without_conclusions(s["text"], s["method"]))
    out = cases.withColumn("__state", cut).withColumn("__text", X.strip(F.col("__state.text"))).withColumn("__method", F.col("__state.method"))
    done = F.col("__text")
    short = F.length(done) < min_length
    return out.select(
        *(c for c in cases.columns if c not in ("full_case_text_no_verdict", "verdict_removal_method", "verdict_free_length", "retention_percentage", "excluded", "exclusion_reason")),
        F.when(short, F.col("full_case_text_no_verdict")).otherwise(done).alias("full_case_text_no_verdict"),
        F.col("__method").alias("verdict_removal_method"),
        F.when(short, F.col("verdict_free_length")).otherwise(F.length(done)).alias("verdict_free_length"),
        F.when(short, F.col("retention_percentage")).otherwise(X.retention(F.length(done), F.col("original_length"))).alias("retention_percentage"),
        (F.col("excluded") | short).alias("excluded"),
        F.when(short, "too_short_after_repair").otherwise(F.col("exclusion_reason")).alias("exclusion_reason"),
    )


def published(cases: DataFrame) -> DataFrame:
    """The columns that are given out, missing ones empty."""
    plain = ("item_id", "case_name", "article", "violation_label", "decision_date", "respondent", "verdict_removal_method")
    have = [c for c in ("full_case_text_no_verdict", "case_text", "full_case_text") if c in cases.columns]
    return cases.select(*(F.coalesce(c, F.lit("")).alias(c) for c in plain if c in cases.columns), first_value("case_text", *have), *(c for c in ("original_length", "verdict_free_length", "retention_percentage") if c in cases.columns))


def metadata(hits: DataFrame) -> DataFrame:
    """Search hits (a struct called columns) as flat rows."""
    c = lambda name: F.coalesce(F.col(f"columns.{name}"), F.lit(""))
    articles = F.filter(F.transform(F.split(c("article"), ";"), lambda a: F.trim(a)), lambda a: a != "")
    return hits.select(
        c("itemid").alias("item_id"), c("docname").alias("case_name"), c("appno").alias("application_number"), F.substring(c("kpdate"), 1, 10).alias("decision_date"), c("respondent").alias("respondent"), articles.alias("articles"),
        c("conclusion").alias("conclusion"), c("languageisocode").alias("language"), c("importance").alias("importance"), c("ecli").alias("ecli"), c("doctypebranch").alias("doc_type_branch"), c("separateopinion").alias("separate_opinion"),
    ).where("item_id != ''")
