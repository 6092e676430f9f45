"""From samples to cases to conditions.

Samples are long rows (keys, sample_idx, rating). ``voted`` has a case's figures from sums, counts and first places, which
aggregate before the shuffle. Where the ratings themselves are wanted, ``cases`` keeps them as one ordered array, on which all case
figures are array expressions: one shuffle by case, then none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratings as R


def cases(samples: DataFrame, keys: list[str], index: str = "sample_idx", rating: str = "rating") -> DataFrame:
    """keys, ratings: the samples of each case in their order."""
    held = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(rating).alias("r"))))
    return samples.groupBy(*keys).agg(F.transform(held, lambda s: s["r"]).alias("ratings"))


def judged(by_case: DataFrame, is_violation: Column) -> DataFrame:
    """Adds avg_rating, num_samples, num_abstentions, is_accurate, prediction by mean and prediction by vote."""
    average = R.mean(F.col("ratings"))
    out = by_case.withColumn("is_violation", is_violation).withColumn("avg_rating", average)
    return out.select(
        "*",
        F.size("ratings").cast("long").alias("num_samples"),
        R.abstentions(F.col("ratings")).cast("long").alias("num_abstentions"),
        R.accurate(F.col("avg_rating"), F.col("is_violation")).alias("is_accurate"),
        R.predicts_violation(F.col("avg_rating")).alias("says_violation"),
        R.vote(F.col("ratings")).alias("prediction"),
    )


def voted(samples: DataFrame, keys: list[str], is_violation: Column, index: str = "sample_idx", rating: str = "rating") -> DataFrame:
    """The figures of judged(cases(...)) without the ratings: partial sums, counts and minima of numbers alone."""
    r, sides = F.col(rating), ("violation", "no_violation", "abstention")
    inside = {"violation": r < R.ABSTAIN, "no_violation": r > R.ABSTAIN, "abstention": r == R.ABSTAIN}
    sums = [F.count("*").alias("num_samples"), F.sum(r).alias("__sum")]
    for s in sides:
        sums += [F.count_if(inside[s]).alias(f"__n_{s}"), F.min(F.when(inside[s], F.col(index))).alias(f"__first_{s}")]
    held = samples.groupBy(*keys).agg(*sums).withColumn("is_violation", is_violation).withColumn("avg_rating", F.col("__sum").cast("double") / F.col("num_samples"))

    def wins(s: str) -> Column:
        return reduce(lambda a, b: a & b, ((F.col(f"__n_{s}") > F.col(f"__n_{o}")) | (F.col(f"__n_{s}") == F.col(f"__n_{o}")) & (F.coalesce(f"__first_{o}", F.col(f"__first_{s}") + 1) > F.col(f"__first_{s}")) for o in sides if o != s))

    prediction = F.when(wins("violation"), "violation").when(wins("no_violation"), "no_violation").otherwise("abstention")
    return held.select(
        *keys,
        "is_violation",
        "avg_rating",
        "num_samples",
        F.col("__n_abstention").alias("num_abstentions"),
        R.accurate(F.col("avg_rating"), F.col("is_violation")).alias("is_accurate"),
        R.predicts_violation(F.col("avg_rating")).alias("says_violation"),
        prediction.alias("prediction"),
    )


def share(condition: Column) -> Column:
    """The share of rows that meet a condition."""
    return F.avg(condition.cast("double"))


def condition_figures() -> list[Column]:
    """The figures of one condition over its judged cases."""
    right_vote = F.col("prediction") == F.when(F.col("is_violation"), "violation").otherwise("no_violation")
    return [
        F.count("*").alias("n_cases"),
        F.sum("num_samples").alias("n_samples"),
        share(F.col("is_accurate")).alias("accuracy"),
        share(right_vote).alias("vote_accuracy"),
        (F.sum("num_abstentions") / F.nullif(F.sum("num_samples"), F.lit(0))).alias("abstention_rate"),
        share(F.col("prediction") == "abstention").alias("vote_abstention_rate"),
        (F.sum(F.when(F.col("is_accurate"), F.col("num_samples")).otherwise(0)) / F.nullif(F.sum("num_samples"), F.lit(0)) * 100).alias("weighted_accuracy"),
        F.avg(F.when(F.col("is_violation"), F.col("is_accurate").cast("double"))).alias("violation_accuracy"),
        F.avg(F.when(~F.col("is_violation"), F.col("is_accurate").cast("double"))).alias("no_violation_accuracy"),
        F.avg("avg_rating").alias("mean_rating"),
    ]
