"""Measures of ranked retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def first_ranks(results: DataFrame, targets: DataFrame) -> DataFrame:
    """query, target, rank: the best rank of each wanted id, null where it was not found."""
    hit = targets.join(results.select("query", F.col("id").alias("target"), "rank"), ["query", "target"], "left")
    return hit.groupBy("query", "target").agg(F.min("rank").alias("rank"))


def recall_mrr(ranks: DataFrame) -> DataFrame:
    """One row: targets, Recall@5, Recall@10, mean reciprocal rank of each query's first hit."""
    per = ranks.groupBy("query").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("n"),
                                     F.count_if(F.col("rank") <= 5).alias("at5"), F.count_if(F.col("rank") <= 10).alias("at10"))
    return per.agg(F.sum("n").alias("targets"), F.round(F.sum("at5") / F.sum("n"), 6).alias("recall_5"),
                   F.round(F.sum("at10") / F.sum("n"), 6).alias("recall_10"),
                   F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("best"), F.lit(0.0))), 6).alias("mrr"))


def rank_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Queries whose best rank improved, worsened or stayed from a to b; no rank is the worst."""
    def best(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("query").agg(F.coalesce(F.min("rank"), F.lit(2**31 - 1)).alias(name))

    both = best(a, "x").join(best(b, "y"), "query")
    return both.agg(F.count_if(F.expr("y < x")).alias("improved"), F.count_if(F.expr("y > x")).alias("worsened"), F.count_if(F.expr("y = x")).alias("unchanged"))


def violation_rate(results: DataFrame, forbidden: DataFrame) -> DataFrame:
    """One row: forbidden pairs, how many of them were returned, and their share."""
    f = forbidden.select("query", "id").distinct()
    met = f.join(results.select("query", "id").distinct().withColumn("hit", F.lit(1)), ["query", "id"], "left")
    return met.agg(F.count(F.lit(1)).alias("forbidden"), F.count("hit").alias("violations"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("rate"))


def averages(kept: DataFrame) -> DataFrame:
    """One row: queries, average results and average tokens of a query."""
    per = kept.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("used").alias("tokens"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("n"), 6).alias("results"), F.round(F.avg("tokens"), 6).alias("tokens"))
