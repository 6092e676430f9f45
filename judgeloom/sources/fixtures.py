"""Ratings and cases derived from the synthetic tables by integer arithmetic, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMINGS = ("predictive", "normative", "factual")
N_SAMPLES = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, art, evaluator, violation_label, h of every order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"),
        (F.col("o_orderkey") % 7).cast("int").alias("art"),
        F.col("o_orderpriority").alias("evaluator"),
        F.when(F.col("o_orderkey") % 2 == 0, "violation").otherwise("no_violation").alias("violation_label"),
        F.floor("o_totalprice").alias("h"),
        F.col("o_custkey").alias("custkey"),
    )


def samples(spark: SparkSession, sf_dir: str, *framings: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Ratings of every pair, framing and sample: the grid is two explodes, no join. also: further columns of the pairs."""
    wanted = [(k, f) for k, f in enumerate(FRAMINGS) if not framings or f in framings]
    grid = F.array(*(F.struct(F.lit(k).alias("fid"), F.lit(f).alias("framing")) for k, f in wanted))
    rows = pairs(spark, sf_dir).withColumn("f", F.explode(grid)).select("*", "f.*").drop("f").withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(N_SAMPLES - 1))))
    rating = F.expr(
        """CASE WHEN (case_id * 31 + sample_idx * 17 + fid * 5) % 23 = 0 THEN 1 + (h + sample_idx + fid) % 5
                WHEN h % 10 < 7 THEN CASE WHEN violation_label = 'violation' THEN 1 + (h + sample_idx) % 3 ELSE 3 + (h + sample_idx) % 3 END
                ELSE 1 + (h + sample_idx * 3) % 5 END"""
    ).cast("int")
    return rows.select("case_id", "art", "evaluator", "violation_label", "framing", "sample_idx", rating.alias("rating"), *also)


#: A line for each of the beginnings of an assessment, and a sentence for each of the patterns of a conclusion, in their order.
ASSESSMENTS = (
    "II. THE COURT'S ASSESSMENT", "III. MERITS", "IV. THE MERITS", "THE COURT’S ASSESSMENT", "MERITS", "FOR THESE REASONS", "OPERATIVE PROVISIONS", "V. APPLICATION OF ARTICLE 41", "APPLICATION OF ARTICLE 41", "ARTICLE 41",
    "Next: the Court will now assess it", "The Court will first examine it", "The Court must therefore determine it", "The Court will examine the merits", "The Court notes at the outset that", "The Court observes that the parties", "Turning to the merits", "As to the merits",
)
CONCLUSIONS = (
    "The Court finds that there has been a violation here", "It holds that there has not been a breach", "In sum there has been a violation of Article 3", "There has been a breach of Article 8", "There was no violation of Article 6", "The State violated Article 3", "Accordingly, the Court holds so",
    "It follows that there has been none", "In the light of the above it finds so", "The Court therefore concludes so", "It dismisses the application", "Holds that it is so", "Decides that it is so",
)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case documents: texts with an injected assessment or conclusion, labels, dates, respondents. Of the rest every third begins with a conclusion that nothing can be cut before."""
    docs = table(spark, sf_dir, "documents")
    third, turn = F.col("doc_id") % 3, F.floor(F.col("doc_id") / 3)
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), (turn % len(values) + 1).cast("int"))
    marker = F.concat(F.lit("\n"), of(ASSESSMENTS), F.lit("\n"), "text")
    said = F.concat(F.lit(". Filler. "), of(CONCLUSIONS), F.lit(". "), "text")
    twice = F.concat(F.lit("Holds that it leaks\n"), "text", F.lit(". Holds that there is more.\n"), "text")
    return docs.select(
        F.col("doc_id").alias("ord"),
        F.col("doc_id").cast("string").alias("item_id"),
        F.concat(F.lit("CASE OF "), "source", F.lit(" v. "), F.upper("lang")).alias("case_name"),
        F.when(third == 0, "No violation of Article 8; Violation of Article 3; Violation of Article P1-1").when(third == 1, "Violation of Article 6-1").otherwise("Struck out of the list").alias("conclusion"),
        F.when(third == 0, F.concat("text", marker)).when(third == 1, F.concat("text", said)).when(turn % 3 == 2, twice).otherwise(F.col("text")).alias("full_case_text"),
        F.date_add(F.to_date(F.lit("2020-01-01")), F.col("doc_id").cast("int")).cast("string").alias("decision_date"),
        F.col("lang").alias("lang"),
        F.col("source").alias("source"),
    )
