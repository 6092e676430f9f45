"""Paired conditions: joins, discordant counts, directions, taxonomies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratings as R
from ..functions import stats
from .reduce import share


def paired(base: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows of equal keys side by side: columns of the one get _base, of the other _other."""
    tag = lambda df, s: df.select(*keys, *(F.col(c).alias(f"{c}_{s}") for c in df.columns if c not in keys))
    return tag(base, "base").join(tag(other, "other"), keys, how)


def comparison(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Accuracies, discordant counts, exact McNemar, alignment and its interval for each group."""
    b, o = F.col("is_accurate_base"), F.col("is_accurate_other")
    aligned = F.col("says_violation_base") == F.col("says_violation_other")
    sums = pairs.groupBy(*by).agg(
        F.count("*").alias("n"),
        share(b).alias("base_accuracy"),
        share(o).alias("other_accuracy"),
        F.count_if(~b & o).alias("n01"),
        F.count_if(b & ~o).alias("n10"),
        share(aligned).alias("alignment"),
        F.count_if(aligned).alias("n_aligned"),
    )
    low, high = stats.wilson(F.col("n_aligned"), F.col("n"))
    p = stats.mcnemar(F.col("n01"), F.col("n10"))
    return sums.select("*", (F.col("other_accuracy") - F.col("base_accuracy")).alias("delta"), p.alias("p_value"), low.alias("alignment_low"), high.alias("alignment_high")).withColumn("significant", F.col("p_value") < 0.05)


def directions(pairs: DataFrame, by: list[str], before: Column, after: Column, increase_is_toward: bool) -> DataFrame:
    """How many ratings changed and where to; shares of changes are zero without any."""
    changed = before != after
    where = R.direction(before, after, increase_is_toward)
    sums = pairs.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(changed).alias("changed"),
        F.count_if(changed & (where == "toward")).alias("toward"),
        F.count_if(changed & (where == "away")).alias("away"),
        F.count_if((before != R.ABSTAIN) & (after == R.ABSTAIN)).alias("to_abstention"),
        F.count_if((before == R.ABSTAIN) & (after != R.ABSTAIN)).alias("from_abstention"),
        F.avg(F.when(changed, F.abs(after - before).cast("double"))).alias("avg_magnitude"),
    )
    of = lambda c: stats.percent(F.col(c), F.col("changed")).alias(f"pct_{c}")
    return sums.select(*by, "total", "changed", stats.percent(F.col("changed"), F.col("total")).alias("pct_changed"), of("toward"), of("away"), of("to_abstention"), of("from_abstention"), F.coalesce("avg_magnitude", F.lit(0.0)).alias("avg_magnitude"))


def taxonomy(pairs: DataFrame, by: list[str], before: Column, after: Column) -> DataFrame:
    """Counts and shares of flipping, polarizing and moderating changes."""
    kind = R.change(before, after)
    kinds = ("flipping", "polarizing", "moderating")
    sums = pairs.groupBy(*by).agg(F.count(kind).alias("changed"), *(F.count_if(kind == k).alias(k) for k in kinds))
    return sums.select("*", *(stats.percent(F.col(k), F.col("changed")).alias(f"pct_{k}") for k in kinds))


def aligned_with(rows: DataFrame, baseline: DataFrame, keys: list[str], prediction: str = "prediction") -> DataFrame:
    """Left lookup of the baseline's prediction; a row without one isn't aligned."""
    base = baseline.select(*keys, F.col(prediction).alias("__base"))
    return rows.join(base, keys, "left").withColumn("aligned", F.coalesce(F.col(prediction) == F.col("__base"), F.lit(False))).drop("__base")


def delta_unless_zero(base: Column, other: Column) -> Column:
    """other - base, null if either is zero or null, as a check for truth would have it."""
    return F.when((base != 0) & (other != 0), other - base)
