"""Shared folders: where driver and executors meet."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where that is unset and everything runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="judgeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        _made.append((spark, found))
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the session ends."""
    path = f"{shared_dir(spark)}/judgeloom/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path in the machines' own file system of a folder, which is made; None where it is in another store. A path without a scheme is where the default store has it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    uri = fs.resolvePath(target).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in whatever store Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return [f.getPath().toString() for f in found or []]


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside its place and moved there."""
    jvm = spark._jvm
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(beside, target):
        fs.delete(target, False)
        if not fs.rename(beside, target):
            raise OSError(f"can't write {path}")


def get(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return
