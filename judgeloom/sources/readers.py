"""Readers: JSON arrays, evaluation files, JDBC tables, existing outputs. Schemas are explicit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ratings as R
from ..schemas import schema


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or a glob) is there, in whatever store Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return bool(found)


def json_array(spark: SparkSession, path: str, kind: str | T.StructType, missing_ok: bool = False) -> DataFrame:
    """A file with one JSON array of objects, with its order as ord; a missing file is an empty table if allowed."""
    fields = schema(kind) if isinstance(kind, str) else kind
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], fields).withColumn("ord", F.lit(0).cast("int"))
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", T.ArrayType(fields))).alias("ord", "row"))
    return rows.select("row.*", "ord")


def json_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Large corpora: one object a line, or arrays that need no order."""
    return spark.read.schema(schema(kind)).json(path, multiLine=False)


def aliased(df: DataFrame, new: str, old: str) -> DataFrame:
    """The column new, taken from old where it is missing."""
    if old not in df.columns:
        return df
    return df.withColumn(new, F.coalesce(F.col(new), F.col(old)) if new in df.columns else F.col(old)).drop(old)


def result_files(spark: SparkSession, folder: str, stage: str) -> DataFrame | None:
    """model and the rows of folder/<model>/<stage>_results.json over all models; None if no model has it."""
    path = f"{folder.rstrip('/')}/*/{stage}_results.json"
    if not exists(spark, path):
        return None
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("model"), F.posexplode(F.from_json("value", T.ArrayType(schema(stage)))).alias("ord", "row"))
    return rows.select("model", "ord", "row.*")


def evaluations(spark: SparkSession, path: str, kind: str = "evaluation") -> DataFrame:
    """Evaluation CSV files with the file they come from; ratings written as text become arrays."""
    rows = spark.read.schema(schema(kind)).csv(path, header=True, quote='"', escape='"', multiLine=True).select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
    lists = [c for c in rows.columns if c.endswith("_ratings")]
    return rows.withColumns({c: R.parse_list(F.col(c)) for c in lists})


def files(spark: SparkSession, folder: str, pattern: str = "*.csv", prefix: str = "") -> DataFrame:
    """Names of the files of a folder."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return names.where(F.startswith("file", F.lit(prefix)))


def long_challenge(wide: DataFrame) -> DataFrame:
    """Challenge rows with two arrays as one row a sample."""
    zipped = F.arrays_zip(F.col("original_ratings").alias("a"), F.col("challenged_ratings").alias("b"))
    rows = wide.select("case_name", "article", "violation_label", F.posexplode(zipped).alias("sample_idx", "s")).where("s.a is not null and s.b is not null")
    v = F.col("violation_label") == "violation"
    return rows.select("case_name", "article", "violation_label", "sample_idx", F.col("s.a").alias("initial_rating"), F.col("s.b").alias("challenged_rating"), (F.col("s.a") != F.col("s.b")).alias("changed"), R.accurate(F.col("s.a"), v).alias("is_accurate_initial"), R.accurate(F.col("s.b"), v).alias("is_accurate_challenged"))


def case_filters(country: str | None = None, since: str | None = None, until: str | None = None, language: str | None = None) -> list[str]:
    """Conditions on a table of cases; all of them must hold."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    out = ["full_text IS NOT NULL", "length(full_text) > 500", "conclusion IS NOT NULL", "lower(doc_name) NOT LIKE '%translation%'"]
    out += [f"respondent = {quoted(country)}"] if country else []
    out += [f"kp_date >= {quoted(since)}"] if since else []
    out += [f"kp_date < {quoted(until)}"] if until else []
    return out + ([f"language_iso = {quoted(language)}"] if language else [])


def filtered_cases(df: DataFrame, **bounds: str | None) -> DataFrame:
    """The same conditions on a DataFrame: they reach a scan that can take them."""
    for condition in case_filters(**bounds):
        df = df.where(condition)
    return df


def date_parts(column: str, first: str, last: str, n: int) -> list[str]:
    """n conditions that cut a text column of ISO dates into ranges; together they are met by every row once, null included."""
    from datetime import date, timedelta

    low, high = date.fromisoformat(first), date.fromisoformat(last)
    cuts = sorted({(low + timedelta(days=(high - low).days * k // n)).isoformat() for k in range(1, n)})
    if not cuts:
        return ["1 = 1"]
    return [f"{column} < '{cuts[0]}' OR {column} IS NULL", *(f"{column} >= '{a}' AND {column} < '{b}'" for a, b in zip(cuts, cuts[1:], strict=False)), f"{column} >= '{cuts[-1]}'"]


def jdbc_cases(spark: SparkSession, url: str | list[str], table: str, options: dict[str, str] | None = None, parts: tuple[str, str, str, int] | None = None, **bounds: str | None) -> DataFrame:
    """A table of cases over JDBC: filters and columns are pushed to the database. url: of the database or of its parts, which have each some of the rows.
    parts: a column of dates, its ends, and into how many reads they are cut."""
    columns = ["item_id", "doc_name", "conclusion", "full_text", "respondent", "kp_date", "language_iso"]
    rows = None
    for one in [url] if isinstance(url, str) else url:
        if parts:
            some = spark.read.jdbc(one, table, predicates=date_parts(*parts), properties=options or {})
        else:
            some = spark.read.format("jdbc").options(url=one, dbtable=table, **(options or {})).load()
        rows = some if rows is None else rows.unionAll(some)
    return filtered_cases(rows.select(*columns), **bounds).orderBy("kp_date")


def fresh(df: DataFrame, path: str, key: str) -> DataFrame:
    """Rows whose key an earlier output at path hasn't: resuming after a stop."""
    spark = df.sparkSession
    if not exists(spark, path):
        return df
    return df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")


def cached_or(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The output at path if there is one, else computed and written there."""
    if not exists(spark, path + "/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
