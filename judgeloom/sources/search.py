"""Search expressions, hits through the ``paged_search`` source, documents fetched by id.

The transport is a function (query, start, length) -> (total, hits), so that a service, a folder of saved
pages or a test stands behind it alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import schema
from . import paged

PAGE, SHORTEST = paged.PAGE, 100
Search = paged.Service
Fetch = Callable[[str], str | None]


# The clauses of the outside service's query language.
def query(since: str = "", until: str = "", country: str = "", language: str = "ENG", collection: str = "JUDGMENTS", fixed: tuple[str, ...] = ()) -> str:
    """A search expression: the fixed clauses and one for each argument that isn't empty, joined by AND; an open end of a date range is *."""
    clauses = list(fixed)
    clauses += [f'((languageisocode:"{language}"))'] if language else []
    clauses += [f'((documentcollectionid:"{collection}"))'] if collection else []
    clauses += [f'((respondent:"{country.upper()}"))'] if country else []
    if since or until:
        day = lambda d: f"{d}T00:00:00" if d else "*"
        clauses.append(f"((kpdate:[{day(since)} TO {day(until)}]))")
    return " AND ".join(clauses)


def hits(spark: SparkSession, search: Search, expression: str, page: int = PAGE) -> DataFrame:
    """All hits of a search, a page a partition of the ``paged_search`` source, with their places."""
    rows = spark.read.format(paged.source(spark, search)).option("query", expression).option("page", page).load()
    return rows.select(F.from_json("hit", schema("hit")).alias("h"), "place").select("h.*", "place")


def documents(rows: DataFrame, fetch: Fetch, key: str = "item_id") -> DataFrame:
    """Rows with full_case_text; documents that don't come or are very short go."""

    @F.arrow_udf("string")
    def load(ids):
        import pyarrow as pa

        return pa.array([X.plain_text(fetch(i)) for i in ids.to_pylist()], pa.string())

    # a fetch is not a function of its id: it is never pushed below a shuffle or done again for a filter
    return rows.withColumn("full_case_text", load.asNondeterministic()(F.col(key))).where(F.length("full_case_text") > SHORTEST)
