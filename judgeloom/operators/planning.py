"""Calls, costs and progress of an experiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = ("baseline", "rq1", "rq2", "rq3")
# Tokens in and out of a call of each kind, and of any other kind.
TOKENS = {"baseline": (16000, 10), "rq1_summary": (15000, 600), "rq1_eval": (800, 10), "rq2": (800, 10), "rq3": (16000, 10)}
OTHER_TOKENS = (5000, 50)


def calls(n: Column, samples: Column) -> dict[str, Column]:
    """Calls of each stage for n cases."""
    return {"baseline": n * samples, "rq1": 3 * n + 3 * n * samples, "rq2": 3 * n * samples, "rq3": 2 * n * samples}


def tokens(kind: Column) -> tuple[Column, Column]:
    table = lambda k: F.coalesce(F.create_map(*(F.lit(x) for name, t in TOKENS.items() for x in (name, t[k])))[kind], F.lit(OTHER_TOKENS[k]))
    return table(0), table(1)


def costs(models: DataFrame, sizes: DataFrame) -> DataFrame:
    """model, stage, n_calls, usd for each model (costs a million tokens) and stage; sizes: one row n_cases, n_samples."""
    n, s = F.col("n_cases"), F.col("n_samples")
    usd = lambda k: (TOKENS[k][0] * F.col("input_cost_per_mtok") + TOKENS[k][1] * F.col("output_cost_per_mtok")) / F.lit(1e6)
    made = calls(n, s)
    price = {"baseline": made["baseline"] * usd("baseline"), "rq1": 3 * n * usd("rq1_summary") + 3 * n * s * usd("rq1_eval"), "rq2": made["rq2"] * usd("rq2"), "rq3": made["rq3"] * usd("rq3")}
    each = F.array(*(F.struct(F.lit(k).alias("stage"), made[k].cast("long").alias("n_calls"), price[k].cast("double").alias("usd")) for k in STAGES))
    return models.crossJoin(F.broadcast(sizes)).select("model", F.explode(each).alias("s")).select("model", "s.*")


def cost_report(cost: DataFrame) -> DataFrame:
    """Costs with a subtotal a model and the total; stage and model are ALL there."""
    return cost.rollup("model", "stage").agg(F.sum("n_calls").alias("n_calls"), F.sum("usd").alias("usd")).select(F.coalesce("model", F.lit("ALL")).alias("model"), F.coalesce("stage", F.lit("ALL")).alias("stage"), "n_calls", "usd")


def progress(models: DataFrame, markers: DataFrame) -> DataFrame:
    """One row a model, one column a stage: done or PENDING."""
    done = models.select("model").join(markers.select("model", "stage").distinct(), "model", "left")
    seen = done.groupBy("model").pivot("stage", list(STAGES)).agg(F.count(F.lit(1)))
    return seen.select("model", *(F.when(F.col(s) > 0, "done").otherwise("PENDING").alias(s) for s in STAGES))
