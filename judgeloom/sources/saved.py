"""A search service over pages saved by Spark: one folder a page with lines of JSON, first those of its hits, then those of their documents, each in the order of their places.

``save`` writes a table of hits so, ``service`` answers from it like a paged search, ``text`` like its document store. Files are read by Arrow's
file systems, wherever these reach the folder.
"""

from __future__ import annotations

import functools
import io
import json
import re
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paged import Service

SAVED, FIRST_DAY = 200, date(2020, 1, 1)


def save(hits: DataFrame, folder: str, place: str, page: int = SAVED) -> int:
    """Write hits (a struct columns, html) in pages by place (0, 1, ... in the order of their dates); returns how many places there are."""
    at = F.col(place).alias("place")
    line = F.posexplode(F.array(F.to_json(F.struct(at, "columns")), F.to_json(F.struct(at, "html")))).alias("kind", "value")
    rows = hits.select((F.col(place) / page).cast("long").alias("page"), at, line)
    rows.repartition("page").sortWithinPartitions("page", "kind", "place").select("page", "value").write.mode("overwrite").option("compression", "gzip").partitionBy("page").text(folder)
    return (hits.agg(F.max(place)).first()[0] or -1) + 1 if not hits.isEmpty() else 0


def _lines(folder: str, page: int, field: str) -> dict[int, object]:
    """place -> what a page's lines have as field. Lines of hits come first, so documents aren't read for them."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    out = {}
    for f in store.get_file_info(fs.FileSelector(f"{path}/page={page}", allow_not_found=True)):
        if f.base_name.startswith("part-"):
            with store.open_input_stream(f.path) as stream, io.BufferedReader(stream, 1 << 16) as lines:
                for line in lines:
                    is_hit = b',"columns":{' in line[:48]  # no text can hold that: its quotes are escaped
                    if is_hit == (field == "columns"):
                        one = json.loads(line)
                        out[one["place"]] = one.get(field)
                    elif not is_hit:
                        break
    return out


@functools.lru_cache(maxsize=8)
def _hits(folder: str, page: int) -> dict[int, dict]:
    return _lines(folder, page, "columns")


@functools.lru_cache(maxsize=8)
def _texts(folder: str, page: int) -> dict[int, str | None]:
    return _lines(folder, page, "html")


def service(options: dict) -> Service:
    """Options: folder, places, page_size; a query's lower end of dates skips the places before it (a place is a day from FIRST_DAY on)."""
    folder, places, size = options["folder"], int(options["places"]), int(options.get("page_size", SAVED))

    def search(query: str, start: int, length: int) -> tuple[int, list[dict]]:
        since = re.search(r"kpdate:\[(\d{4}-\d\d-\d\d)", query)
        skipped = max(0, (date.fromisoformat(since[1]) - FIRST_DAY).days) if since else 0
        low, high = skipped + start, min(places, skipped + start + length)
        got = [hit for p in range(low // size, -(-high // size)) for at, hit in sorted(_hits(folder, p).items()) if low <= at < high]
        return max(0, places - skipped), [{"columns": h} for h in got]

    return search


def text(options: dict):
    """A function of a place (as text) that gives the document there."""
    folder, size = options["folder"], int(options.get("page_size", SAVED))

    def fetch(item: str) -> str | None:
        return _texts(folder, int(item) // size).get(int(item))

    return fetch
