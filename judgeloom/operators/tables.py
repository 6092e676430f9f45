"""Table operators: de-duplication, joins by precedence, samples, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ids of a sequential draw, at most.
CURATED = 1_000_000


def dedupe(df: DataFrame, keys: list[str], order: str, keep: str = "last") -> DataFrame:
    """One row per key: the first or last by order. Partial aggregation keeps a hot key from filling one task."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(order)).alias("__row")).select(*(k for k in df.columns if k in keys), "__row.*").select(*df.columns)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Rows of both tables, new ones in place of existing ones of equal keys; a key keeps the place of its first row."""
    both = existing.withColumn("__prio", F.lit(0)).unionByName(new.withColumn("__prio", F.lit(1)), allowMissingColumns=True)
    null_safe = [F.coalesce(F.col(k), F.lit("")).alias(f"__k{i}") for i, k in enumerate(keys)]
    rest = existing.columns
    won = both.groupBy(*null_safe).agg(F.max_by(F.struct(*rest), F.struct("__prio", order)).alias("__row"), F.min(F.struct("__prio", order)).alias("__place"))
    return won.select("__row.*", F.col("__place.__prio").alias("place_source"), F.col(f"__place.{order}").alias("place"))


def unseen(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the existing table hasn't."""
    return df.join(existing.select(*keys).distinct(), keys, "left_anti")


def high_water(df: DataFrame, column: str) -> DataFrame:
    """The latest valid ISO date, or an empty text."""
    valid = F.when(F.try_to_date(F.col(column), "yyyy-MM-dd").isNotNull(), F.col(column))
    return df.agg(F.coalesce(F.max(valid), F.lit("")).alias("high_water"))


def stratified(df: DataFrame, stratum: str, case: str, order: str, top: int, per_stratum: int, draw: Column) -> DataFrame:
    """All rows of per_stratum drawn cases in each of the top strata by rows (ties: first seen)."""
    ranked = df.groupBy(stratum).agg(F.count("*").alias("__n"), F.min(order).alias("__first")).orderBy(F.desc("__n"), "__first").limit(top).select(stratum)
    cases = df.join(F.broadcast(ranked), stratum, "left_semi").select(stratum, case).distinct()
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(draw, case))
    chosen = cases.withColumn("__place", place).where(F.col("__place") <= per_stratum).select(stratum, case)
    return df.join(chosen, [stratum, case], "left_semi")


def seeded_cases(df: DataFrame, stratum: str, case: str, order: str, top: int, per_stratum: int, seed: int) -> DataFrame:
    """The same with one shared Mersenne Twister over the ranked strata, as a sequential sampler draws.

    Only ids reach the driver, of the top strata alone: a sample design for curated sets, more than CURATED ids raise. ``stratified`` is
    the one for large tables.
    """
    import random

    rng = random.Random(seed)
    ranked = [r[0] for r in df.groupBy(stratum).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(top).collect()]
    if (n := df.where(F.col(stratum).isin(ranked)).agg(F.count_distinct(stratum, case)).first()[0]) > CURATED:
        raise ValueError(f"{n} cases are too many for a sequential draw: use stratified")
    ids = {r[stratum]: r["ids"] for r in df.where(F.col(stratum).isin(ranked)).groupBy(stratum).agg(F.sort_array(F.collect_set(case)).alias("ids")).collect()}
    chosen = [(s, c) for s in ranked for c in sorted(rng.sample(ids[s], min(per_stratum, len(ids[s]))))]
    picked = df.sparkSession.createDataFrame(chosen, df.select(stratum, case).schema)
    return df.join(F.broadcast(picked), [stratum, case], "left_semi")


def value_counts(df: DataFrame, column: str, order: str, k: int | None = None) -> DataFrame:
    """Values with their counts, most first, ties by first appearance; the first k of them."""
    out = df.groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen")
    return out.limit(k) if k else out


def completeness(counts: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Expected and found numbers of each file; a file that isn't there has none."""
    got = expected.join(counts, keys, "left").withColumn("found", F.coalesce("found", F.lit(0)).cast("long"))
    return got.select(*keys, "expected", "found", (F.col("expected") - F.col("found")).alias("missing"), (F.col("found") >= F.col("expected")).alias("complete"))


def newest_first(df: DataFrame, date: str, order: str) -> DataFrame:
    """By date, missing ones last, stable."""
    return df.orderBy(F.desc(F.coalesce(F.nullif(F.col(date), F.lit("")), F.lit("0000-00-00"))), order)


def first_value(name: str, *columns: str) -> Column:
    """The first of several columns that is neither null nor empty, else empty."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns), F.lit("")).alias(name)


def dated(df: DataFrame, columns: list[str], since: str | None = None, until: str | None = None) -> DataFrame:
    """decision_date from the first filled column; rows outside [since, until) go, and undated ones if there is a bound."""
    out = df.withColumn("decision_date", F.substring(first_value("d", *columns), 1, 10))
    if since:
        out = out.where((F.col("decision_date") != "") & (F.col("decision_date") >= since))
    if until:
        out = out.where((F.col("decision_date") != "") & (F.col("decision_date") < until))
    return out
