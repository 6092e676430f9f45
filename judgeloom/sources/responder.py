"""Model responses for requests, through any function of one request.

Analyses never need a live endpoint: responses are a table. ``respond`` fills one with retries inside each
partition; ``scripted`` is a deterministic stand-in for tests and dry runs.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratings as R
from ..functions import templates
from ..functions import text as X

TRIES, RETRIED = 3, (429, 500, 502, 503, 504)


class Refused(Exception):
    """An answer with an error status."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def requests(grid: DataFrame, model: Column, prompt: Column, custom_id: Column, system: str = templates.SYSTEM, temperature: float = 1.0, max_tokens: int = 100) -> DataFrame:
    """custom_id, model, messages and parameters of each row of a grid."""
    p = templates.parameters(model, temperature, max_tokens)
    return grid.select(custom_id.alias("custom_id"), model.alias("model"), templates.messages(F.lit(system), prompt, model).alias("messages"), *(p[f].alias(f) for f in ("temperature", "max_tokens", "max_completion_tokens", "reasoning_effort")))


def respond(asked: DataFrame, answer: Callable[[dict], str], workers: int = 50, pause: float = 1.0) -> DataFrame:
    """custom_id, response: retries with growing pauses on passing errors, an empty response in the end."""

    def one(request: dict) -> str:
        for k in range(TRIES):
            try:
                return answer(request)
            except Refused as e:
                if e.status not in RETRIED or k == TRIES - 1:
                    return ""
                time.sleep(pause * 2**k)
        return ""

    def run(batches: Iterator) -> Iterator:
        from concurrent.futures import ThreadPoolExecutor

        import pyarrow as pa

        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                yield pa.record_batch([b.column("custom_id"), pa.array(list(pool.map(one, b.to_pylist())), pa.string())], ["custom_id", "response"])

    return asked.mapInArrow(run, "custom_id string, response string")


def parsed(responses: DataFrame, fields: str) -> DataFrame:
    """responses with ``answer``: the struct of fields in each response's JSON, fenced or not, null where there is none."""
    return responses.withColumn("answer", F.from_json(X.unfenced(F.col("response")), fields))


def ratings(responses: DataFrame, by: list[str]) -> DataFrame:
    """by, mean, ratings of repeated responses (custom_id orders them): what one case's samples come to."""
    held = responses.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("custom_id", R.extract(F.coalesce("response", F.lit(""))).alias("rating")))).alias("s"))
    return held.select(*by, R.mean(F.col("s.rating")).alias("mean"), F.col("s.rating").alias("ratings"))


#: The scripted responder gives no answer to one request in SILENT, and an error to one in FAILING.
SILENT, FAILING = 23, 19


def scripted(asked: DataFrame) -> DataFrame:
    """Answers from what is asked, without Python: a rating from 1 to 5 by the MD5 of all messages and the id, some errors, some requests unanswered."""
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    h = F.conv(F.substring(F.md5(F.concat(said, F.lit("#"), "custom_id")), 1, 6), 16, 10).cast("long")
    # a row of its own, so that the filter and the answer don't each hash the whole messages
    held = asked.select("custom_id", F.explode(F.array(h)).alias("h")).where(F.col("h") % SILENT != 0)
    return held.select("custom_id", F.when(F.col("h") % FAILING == 0, "ERROR: 429").otherwise(F.concat(F.lit("Answer: "), (F.col("h") % 5 + 1).cast("string"))).alias("response"))


def scripted_answer(request: dict) -> str:
    """The same for one request; an empty text is no answer."""
    said = "\n".join(f"{m['role']}:{m['content']}" for m in request["messages"])
    h = int(hashlib.md5(f"{said}#{request['custom_id']}".encode()).hexdigest()[:6], 16)
    return "" if h % SILENT == 0 else "ERROR: 429" if h % FAILING == 0 else f"Answer: {h % 5 + 1}"
