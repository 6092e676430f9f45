"""Running totals over groups of any size: two levels of prefix sums instead of one window over a group.

Rows are cut into ranges of the order column by its quantiles, so that no range of no group holds more than about a range's share of all rows.
Sums of each group's ranges, running over the ranges, are the offsets; inside a range a window runs over its rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the order column; a window's task has about one part of so many of a group.
RANGES = 64


def ranges(df: DataFrame, order: str, n: int = RANGES) -> Column:
    """The number of a row's range, by quantiles of a numeric column; equal values share a range, nulls are in the first."""
    bounds = sorted(set(df.approxQuantile(order, [k / n for k in range(1, n)], 0.25 / n)))
    held = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>")
    return F.coalesce(F.size(F.filter(held, lambda b: b < F.col(order))), F.lit(0))


def totals(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], ties: list[str] | None = None, n: int = RANGES) -> DataFrame:
    """df with the running sum of each of values up to and with its row, by order (then ties) inside equal keys.

    order: a numeric column; ties: columns that tell rows of equal order apart. A null value counts as zero; null keys are a group."""
    held = df.withColumns({f"__v_{name}": F.coalesce(v, F.lit(0)) for name, v in values.items()}).withColumn("__range", ranges(df, order, n))
    names = [f"__k{i}" for i in range(len(keys))]
    sums = held.groupBy(*(F.col(k).alias(a) for k, a in zip(keys, names, strict=True)), F.col("__range").alias("__r")).agg(*(F.sum(f"__v_{name}").alias(f"__s_{name}") for name in values))
    before = Window.partitionBy(*names).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*names, "__r", *(F.coalesce(F.sum(f"__s_{name}").over(before), F.lit(0)).alias(f"__o_{name}") for name in values))
    same = [F.col(k).eqNullSafe(F.col(a)) for k, a in zip(keys, names, strict=True)]
    inside = Window.partitionBy(*keys, "__range").orderBy(order, *(ties or [])).rowsBetween(Window.unboundedPreceding, 0)
    local = held.withColumns({f"__l_{name}": F.sum(f"__v_{name}").over(inside) for name in values})
    met = local.join(offsets, [*same, F.col("__range") == F.col("__r")])
    return met.select(*df.columns, *((F.col(f"__o_{name}") + F.col(f"__l_{name}")).alias(name) for name in values))
