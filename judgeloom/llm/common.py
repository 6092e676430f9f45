"""Small helpers that the operators share: shared tables, batch sizes, text hashing."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir

#: Rows in one Arrow batch. Documents differ in length by orders of magnitude, so batches stay small.
BATCH_ROWS = 400

_written: list[tuple[SparkSession, str]] = []
_PARALLEL = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


def written(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    few: files of the advisory size of shuffled partitions, however many cores there are."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/judgeloom/{name}-{uuid.uuid4().hex}"
    schema, before = df.schema, spark.conf.get(_PARALLEL)
    if few:
        spark.conf.set(_PARALLEL, "false")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_PARALLEL, before)
    _written.append((spark, path))
    return spark.read.schema(schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


#: Bytes of one Arrow batch, where rows are long.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Keep Arrow batches of whole documents small enough for a worker's memory, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def give_back() -> None:
    """Return memory that is free but still held by the allocators of Arrow and C to the system: workers stay between stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work over a task's batches; its worker's free memory goes back at the end."""

    def worked(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            give_back()

    return worked


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of(column: str):
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


#: Bits of a filter over hashed keys for each key, and at most (32 MB reach the driver and each worker).
KEY_BITS, MOST_BITS = 8, 1 << 28


def bit_column(keys: list[str], bits: np.ndarray) -> Column:
    """The place of a row's keys in a bitmap."""
    return F.pmod(F.xxhash64(*keys), F.lit(8 * len(bits)))


def bit_filter(df: DataFrame, keys: list[str]) -> np.ndarray:
    """One bit for every hashed key of df. Beyond MOST_BITS / KEY_BITS keys it clears fewer rows; what it doesn't clear is joined."""
    size = 1 << 16
    while size < min(MOST_BITS, KEY_BITS * df.count()):
        size *= 2
    return bitmap(df.select(F.pmod(F.xxhash64(*keys), F.lit(size)).alias("bit")), size)


def bitmap(bit: DataFrame, size: int) -> np.ndarray:
    """The numbers below size in column bit, as a bitmap: Spark ors them into bytes, which arrive as one Arrow table."""
    byte = bit.groupBy(F.shiftright("bit", 3).alias("at")).agg(F.bit_or(F.expr("1 << cast(bit & 7 as int)")).alias("byte")).toArrow()
    out = np.zeros(size // 8, np.uint8)
    out[byte.column("at").to_numpy()] = byte.column("byte").to_numpy()
    return out


def maybe_in(bits: np.ndarray, keys: list[str]) -> Column:
    """Whether a row's key may be in the filtered table: false is certain."""

    @F.arrow_udf("boolean")
    def held(bit):
        import pyarrow as pa

        at = bit.to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return held(bit_column(keys, bits))


def maybe(df: DataFrame, bits: np.ndarray, keys: list[str]) -> DataFrame:
    """The rows whose key may be in the filtered table; none at all where that is empty."""
    return df.where(maybe_in(bits, keys)) if bits.any() else df.limit(0)


def without(df: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """df without the rows whose keys (null-safe) are in dropped. Only rows that the bit filter can't clear are shuffled."""
    bits = bit_filter(dropped, keys)
    if not bits.any():
        return df
    marked = df.withColumn("__maybe", maybe_in(bits, keys))
    gone = dropped.select(*(F.col(k).alias(f"__gone{i}") for i, k in enumerate(keys))).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__gone{i}")) for i, k in enumerate(keys)]
    unsure = marked.where("__maybe").join(gone, same, "left_anti")
    return marked.where("not __maybe").unionByName(unsure).drop("__maybe")


def texts(batch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column of an Arrow batch; null is empty."""
    import pyarrow as pa

    col = batch.column(column)
    return [x or b"" for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound and computed anew after that."""

    bound = 100_000

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.bound:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


word_hashes = WordHashes()


def hashed(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, as one array."""
    return np.fromiter(map(word_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
