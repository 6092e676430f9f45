"""A table that takes upserts by rewriting only the partitions their keys are in.

Rows are dealt into buckets by a hash of their keys. A version is a manifest, one line a bucket with the data versions that hold
it; data of a version is one folder a bucket that it wrote. An upsert reads, merges and writes the buckets of its own keys and then puts the manifest in
place, whole; where all its keys are new, its rows stand beside what is there, which is neither read nor moved. So a reader sees the version before or after. A version that is there already isn't written again: a batch that
runs twice changes nothing. ``vacuum`` deletes data that the last versions don't use.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete, get, listed, put
from .tables import upsert

BUCKETS = 64
#: Data versions of a bucket, at most: the next upsert merges them into one.
BESIDE = 8


class Store:
    """keys: columns that name a row (null and the empty text are one key, as in upsert); order: the column that tells which of a batch's rows is the last."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], order: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.keys, self.order, self.buckets = spark, folder.rstrip("/"), keys, order, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in self.keys)), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        return sorted(int(p.rsplit("/", 1)[1].removesuffix(".json")) for p in listed(self.spark, f"{self.folder}/manifests/*.json"))

    def places(self, version: int) -> dict[int, list[int]]:
        """bucket -> the data versions that hold it."""
        held = json.loads(get(self.spark, f"{self.folder}/manifests/{version}.json"))
        return {int(b): v if isinstance(v, list) else [v] for b, v in held["buckets"].items()}

    def manifest(self, version: int) -> dict[int, int]:
        """bucket -> the last data version in it."""
        return {b: vs[-1] for b, vs in self.places(version).items()}

    def _read(self, places: dict[int, list[int]], schema: str) -> DataFrame:
        paths = [f"{self.folder}/data/version={v}/bucket={b}" for b, vs in sorted(places.items()) for v in vs]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _schema(self, version: int) -> str:
        return json.loads(get(self.spark, f"{self.folder}/manifests/{version}.json"))["schema"]

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as of a version, or of the last one; None before the first."""
        known = self.versions()
        if not known:
            return None
        version = known[-1] if version is None else version
        return self._read(self.places(version), self._schema(version))

    def upsert(self, batch: DataFrame, version: int) -> list[int]:
        """Write a version: the one before it with the rows of batch in place of those of equal keys. Returns the buckets that were written."""
        known = self.versions()
        if version in known:
            return []
        earlier = [v for v in known if v < version]
        base = self.places(earlier[-1]) if earlier else {}
        schema = self._schema(earlier[-1]) if earlier else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
        dealt = batch.withColumn("__bucket", self.bucket())
        touched = sorted(r[0] for r in dealt.select("__bucket").distinct().collect())  # at most as many as there are buckets
        existing = self._read({b: base[b] for b in touched if b in base}, schema)
        beside = {b: [*base.get(b, []), version] for b in touched}
        if max(map(len, beside.values()), default=0) <= BESIDE and self._all_new(batch, existing):
            rows = batch.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in existing.schema)).withColumn("bucket", self.bucket())
        else:
            beside = {b: [version] for b in touched}
            merged = upsert(existing, batch.select(*existing.columns), self.keys, self.order).drop("place", "place_source")
            rows = merged.withColumn("bucket", self.bucket()).repartition(max(1, len(touched)), "bucket")
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/data/version={version}")
        put(self.spark, f"{self.folder}/manifests/{version}.json", json.dumps({"schema": schema, "buckets": {**base, **beside}}))
        return touched

    def _all_new(self, batch: DataFrame, existing: DataFrame) -> bool:
        """Whether no key is twice in batch, or in batch and existing; only keys are read."""
        keys = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"__k{i}") for i, k in enumerate(self.keys)]
        return batch.select(*keys).unionAll(existing.select(*keys)).groupBy(*(f"__k{i}" for i in range(len(keys)))).count().where("count > 1").isEmpty()

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete manifests before the last keep, and the data that none of these uses; the folders deleted."""
        known = self.versions()
        old, held = known[:-keep], known[-keep:]
        used = {(v, b) for m in held for b, vs in self.places(m).items() for v in vs}
        for v in old:
            delete(self.spark, f"{self.folder}/manifests/{v}.json")
        gone = []
        for path in listed(self.spark, f"{self.folder}/data/version=*/bucket=*"):
            v, b = (int(x.split("=")[1]) for x in path.rsplit("/", 2)[1:])
            # data without a manifest of its own may be a version that is being written
            if (v, b) not in used and v in known:
                delete(self.spark, path)
                gone.append(path)
        return gone
