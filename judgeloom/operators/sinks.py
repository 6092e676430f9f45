"""Sinks: CSV with lists as text, JSON lines, markers of finished stages, small tables for papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, which CSV can hold."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return df.withColumns({c: F.to_json(c) for c in nested})


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    flat(df).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def mark_done(spark: SparkSession, folder: str, model: str, stage: str) -> None:
    """A marker with the time in UTC; ``markers`` reads them."""
    row = spark.range(1).select(F.lit(model).alias("model"), F.lit(stage).alias("stage"), F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("string").alias("at"))
    row.coalesce(1).write.mode("append").json(f"{folder}/markers")


def markers(spark: SparkSession, folder: str) -> DataFrame:
    from ..sources.readers import exists

    fields = "model string, stage string, at string"
    return spark.read.schema(fields).json(f"{folder}/markers") if exists(spark, f"{folder}/markers") else spark.createDataFrame([], fields)


def percent_text(value: float | None, signed: bool = False) -> str:
    """A share as percent with one place; nothing as dashes."""
    return "--" if value is None or value != value else f"{value * 100:+.1f}" if signed else f"{value * 100:.1f}"


#: Tables for papers have this many rows at most.
PRINTED = 100


def latex(df: DataFrame, caption: str, label: str) -> str:
    """A small result as a LaTeX table; more than PRINTED rows raise."""
    rows = df.limit(PRINTED + 1).collect()
    if len(rows) > PRINTED:
        raise ValueError(f"more than {PRINTED} rows")
    safe = lambda v: ("--" if v is None else str(v)).replace("%", r"\%").replace("_", r"\_").replace("&", r"\&")
    lines = [r"\begin{table}", r"\centering", r"\begin{tabular}{l" + "r" * (len(df.columns) - 1) + "}", r"\toprule", " & ".join(map(safe, df.columns)) + r" \\", r"\midrule"]
    lines += [" & ".join(map(safe, r)) + r" \\" for r in rows]
    return "\n".join([*lines, r"\bottomrule", r"\end{tabular}", rf"\caption{{{caption}}}", rf"\label{{{label}}}", r"\end{table}"])
