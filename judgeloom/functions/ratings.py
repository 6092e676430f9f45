"""Ratings 1 to 5: 1 is a sure violation, 3 an abstention, 5 surely none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ABSTAIN = 3


def extract(text: Column, errors_missing: bool = True) -> Column:
    """The first digit from 1 to 5 of a response, else an abstention. errors_missing: text that starts with ERROR: is missing."""
    found = F.coalesce(F.nullif(F.regexp_extract(text, "[1-5]", 0), F.lit("")).cast("int"), F.lit(ABSTAIN))
    return F.when(F.startswith(text, F.lit("ERROR:")), ABSTAIN).otherwise(found) if errors_missing else found


def parse_list(text: Column) -> Column:
    """A list of ratings written as text, as an array."""
    return F.from_json(text, "array<int>")


def mean(ratings: Column) -> Column:
    """Mean of an array of ratings; an empty one is an abstention."""
    n = F.size(ratings)
    return F.when(n > 0, F.aggregate(ratings, F.lit(0.0), lambda a, r: a + r) / n).otherwise(float(ABSTAIN))


def abstentions(ratings: Column) -> Column:
    return F.size(F.filter(ratings, lambda r: r == ABSTAIN))


def accurate(average: Column, is_violation: Column) -> Column:
    """Strictly on the right side of 3."""
    return F.when(is_violation, average < ABSTAIN).otherwise(average > ABSTAIN)


def predicts_violation(average: Column, legacy: bool = False, threshold: float = 2.5) -> Column:
    """legacy: the older reading in which a high average means a violation."""
    return average > threshold if legacy else average < ABSTAIN


def distance(rating: Column, is_violation: Column) -> Column:
    """1 at the right end of the scale, 0 at the wrong one."""
    return 1 - F.abs(rating - F.when(is_violation, 1).otherwise(5)) / F.lit(4.0)


def side(rating: Column) -> Column:
    return F.when(rating < ABSTAIN, "violation").when(rating > ABSTAIN, "no_violation").otherwise("abstention")


def metrics(ratings: Column, is_violation: Column) -> Column:
    """All figures of one case as a struct."""
    average = mean(ratings)
    return F.struct(
        average.alias("avg_rating"),
        distance(average, is_violation).alias("distance"),
        F.transform(ratings, lambda r: distance(r, is_violation)).alias("sample_scores"),
        accurate(average, is_violation).alias("accurate"),
        abstentions(ratings).alias("abstentions"),
    )


def vote(ratings: Column) -> Column:
    """Majority side of an ordered array; among equals the one seen first."""
    sides = F.transform(ratings, side)
    counted = F.transform(
        F.array_distinct(sides), lambda s: F.struct((-F.size(F.filter(sides, lambda x: x == s))).alias("less"), F.array_position(sides, s).alias("first"), s.alias("side"))
    )
    return F.array_min(counted)["side"]


def change(before: Column, after: Column) -> Column:
    """Kind of a change: flipping crosses 3, polarizing leaves it, moderating nears it; null without a change."""
    far, near = F.abs(after - ABSTAIN), F.abs(before - ABSTAIN)
    return F.when(before == after, F.lit(None).cast("string")).when((before - ABSTAIN) * (after - ABSTAIN) < 0, "flipping").when(far > near, "polarizing").when(far < near, "moderating")


def direction(before: Column, after: Column, increase_is_toward: bool = False) -> Column:
    up, down = ("toward", "away") if increase_is_toward else ("away", "toward")
    return F.when(after > before, up).when(after < before, down).otherwise("unchanged")
