"""Files that are one JSON array of objects, read in as many tasks as they have splits.

Spark's text source cuts a file at every opening brace, in any of its splits. Whether a piece begins inside a string follows from the quotes of all pieces before it, how deep it is from
the braces outside of strings: two running sums, of which each split's total is one row and the rest is local to the split. Where a brace opens an object at depth 0 an element
begins; its pieces meet by the element's number and are parsed. A file needs no line breaks, and may have any inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import schema


def _running(df: DataFrame, value: Column, name: str) -> DataFrame:
    """df with the sum of value over all pieces before each, file by file: totals of splits, then places inside a split."""
    held = df.withColumn("__v", value)
    sums = held.groupBy("file", "split").agg(F.sum("__v").alias("__t"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("file", "split", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    local = held.withColumn("__l", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    return local.join(offsets, ["file", "split"]).withColumn(name, F.col("__o") + F.col("__l")).drop("__v", "__l", "__o")


def elements(spark: SparkSession, path: str) -> DataFrame:
    """file, ord, value: the text of each object of the arrays in path, numbered from 0 in each file."""
    raw = spark.read.option("lineSep", "{").text(path)
    pieces = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    pieces = pieces.withColumn("quotes", F.length(plain) - F.length(F.replace(plain, F.lit('"'))))
    quoted = _running(pieces, F.col("quotes"), "quotes_before")
    inside = F.col("quotes_before") % 2 == 1
    # what stands outside of strings: a piece that begins inside one closes it first
    outside = F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), F.regexp_replace("value", r"(?s)\\.", "")), r'"[^"]*("|\z)', "")
    opens = F.col("quotes_before") % 2 == 0
    # the brace before a piece (the file's first piece has none) and the braces that close in it
    first = (F.col("split") == 0) & (F.row_number().over(Window.partitionBy("file", "split").orderBy("at")) == 1)
    held = quoted.withColumn("opens", (opens & ~first).cast("int")).withColumn("closes", F.length(outside) - F.length(F.replace(outside, F.lit("}"))))
    deep = _running(held, F.col("opens") - F.col("closes"), "depth")
    starts = deep.withColumn("starts", ((F.col("opens") == 1) & (F.col("depth") == 0)).cast("int"))
    numbered = _running(starts, F.col("starts"), "begun").withColumn("ord", F.col("begun") + F.col("starts") - 1).where("ord >= 0")
    whole = numbered.groupBy("file", "ord").agg(F.array_sort(F.collect_list(F.struct("split", "at", "value"))).alias("p"))
    text = F.concat(F.lit("{"), F.array_join(F.transform("p", lambda x: x["value"]), "{"))
    return whole.select("file", "ord", F.regexp_extract(text, r"(?s)\A(.*\})", 1).alias("value"))


def json_array(spark: SparkSession, path: str, kind: str | T.StructType, file: str = "") -> DataFrame:
    """The objects of the arrays in path with their order as ord: the same rows as readers.json_array, in as many tasks as there are splits. file: a column for the file they are in."""
    fields = schema(kind) if isinstance(kind, str) else kind
    rows = elements(spark, path).select("file", "ord", F.from_json("value", fields).alias("row"))
    return rows.select("row.*", F.col("ord").cast("int").alias("ord"), *([F.col("file").alias(file)] if file else []))
