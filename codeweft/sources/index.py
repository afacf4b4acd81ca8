"""The code index as relations: live symbols, edges as a set, search tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeweft.functions import text
from codeweft.operators.versions import current_rows
from codeweft.session import table


def live(symbols: DataFrame, deletes: DataFrame) -> DataFrame:
    """Current rows that were not deleted after they were last indexed; docstrings never null."""
    gone = deletes.groupBy("id").agg(F.max("deleted_at").alias("deleted_at"))
    rows = current_rows(symbols).join(gone, "id", "left")
    return (rows.filter(F.col("deleted_at").isNull() | (F.col("deleted_at") < F.col("indexed_at")))
            .drop("deleted_at").withColumn("docstring", F.coalesce("docstring", F.lit(""))))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "symbol_deletes"))


def as_set(edges: DataFrame) -> DataFrame:
    return edges.filter((F.col("from_id") != "") & (F.col("to_id") != "")).select("from_id", "to_id", "kind").distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_set(table(spark, sf_dir, "edges"))


def query_texts(df: DataFrame, key: str, prompt: str) -> DataFrame:
    """query, prompt and what retrieval needs of a text."""
    p = F.col("prompt")
    return (
        df.select(F.col(key).alias("query"), F.col(prompt).alias("prompt")).filter("prompt is not null")
        .select("query", "prompt", text.compound_idents(p).alias("idents"), text.query_words(p).alias("words"),
                text.search_terms(p).alias("terms"), text.compound_parts(p).alias("parts"), F.coalesce(text.is_precise(p), F.lit(False)).alias("precise"))
        .withColumn("scoring", F.concat("terms", "parts"))
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search tasks: a table of fixed size."""
    return query_texts(table(spark, sf_dir, "task_manifest"), "item_id", "prompt")
