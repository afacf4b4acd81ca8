"""Logs of one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SESSION = "command string, tool string, success boolean, response_bytes int, estimated_tokens int, duration_ms bigint"
READ = "file string, file_type string, file_lines int, start_line int, end_line int, command_source string, override boolean"


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a log in which any malformed line is an error; blank lines are passed over."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_reporting(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the lines that are blank or malformed."""
    lines = spark.read.text(path)
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = (F.trim("value") == "") | F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.filter(~bad).select("r.*").drop("_bad"), parsed.filter(bad).select("value")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def decode_events(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Read events of single JSON objects; what does not parse or names no file goes to the second."""
    r = lines.select(column, F.from_json(column, READ).alias("r"))
    good = F.col("r").isNotNull() & (F.coalesce("r.file", F.lit("")) != "")
    return r.filter(good).select("r.*"), r.filter(~good).select(column)
