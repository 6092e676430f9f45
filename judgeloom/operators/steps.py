"""Steps of a run whose results are kept: a step that is done is read, one that isn't is computed, written and marked.

A step is its name and the names of the steps it needs; its folder holds its rows, and a mark beside it the time it was done. The mark is
written after the rows, so a run that is stopped anywhere repeats only what wasn't finished. A reset step resets all that need it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from ..storage import delete, get, listed, put, scratch

Step = tuple[list[str], Callable[..., DataFrame]]


class Run:
    """steps: name -> (needed steps, a function of their tables). folder: in a store that all executors reach; a new one without.

    tell is called with an event (began, failed, done, kept, reset), a step and what is known of it (seconds, the error): a tracking service hangs on there."""

    def __init__(self, spark: SparkSession, steps: dict[str, Step], folder: str | None = None, tell: Callable[[str, str, dict], None] = lambda event, step, about: None):
        self.spark, self.steps, self.folder, self.tell = spark, steps, folder or scratch(spark, "run"), tell
        self.computed: list[str] = []

    def _mark(self, name: str) -> str:
        return f"{self.folder}/marks/{name}.done"

    def done(self, name: str) -> str | None:
        """When a step was done (UTC), if it was."""
        return get(self.spark, self._mark(name)) if listed(self.spark, self._mark(name)) else None

    def reset(self, name: str) -> list[str]:
        """Forget a step and all that need it; their names."""
        gone = [name]
        for other, (needs, _) in self.steps.items():
            if other not in gone and set(needs) & set(gone):
                gone += [x for x in self.reset(other) if x not in gone]
        for x in gone:
            if listed(self.spark, self._mark(x)):
                delete(self.spark, self._mark(x))
                self.tell("reset", x, {})
        return gone

    def table(self, name: str) -> DataFrame:
        """A step's rows: kept ones, or computed after what it needs."""
        needs, compute = self.steps[name]
        path = f"{self.folder}/{name}"
        if at := self.done(name):
            self.tell("kept", name, {"done_at": at})
        else:
            tables, began = [self.table(n) for n in needs], time.monotonic()
            self.tell("began", name, {"needs": needs})
            try:
                compute(*tables).write.mode("overwrite").option("compression", "zstd").parquet(path)
            except BaseException as e:
                self.tell("failed", name, {"seconds": time.monotonic() - began, "error": repr(e)})
                raise
            put(self.spark, self._mark(name), datetime.now(UTC).isoformat())
            self.computed.append(name)
            self.tell("done", name, {"seconds": time.monotonic() - began})
        return self.spark.read.parquet(path)

    def all(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in self.steps}

    def progress(self) -> DataFrame:
        """step, needs, done_at of every step."""
        rows = [(name, ",".join(needs), self.done(name)) for name, (needs, _) in self.steps.items()]
        return self.spark.createDataFrame(rows, "step string, needs string, done_at string")
