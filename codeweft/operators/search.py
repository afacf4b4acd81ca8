"""Full-text search by an inverted index, for a whole table of queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from codeweft.functions import scoring as sc, text
from codeweft.operators.lookup import first_per

GENERATED_KEPT = 5


def postings(symbols: DataFrame) -> DataFrame:
    """token, seq, id of every symbol whose name, its words, signature or docstring has the token."""
    whole = F.concat_ws(" ", "name", text.decompose(F.col("name")), "signature", "docstring")
    return symbols.select("seq", "id", F.explode(text.tokens(whole)).alias("token"))


def document_postings(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    return docs.filter(F.col(body).isNotNull()).select(F.col(key).alias("seq"), F.col(key).cast("string").alias("id"), F.explode(text.tokens(F.col(body))).alias("token"))


def fetch_limit():
    return (30 + 10 * F.size("terms")) * 3


def any_term(index: DataFrame, queries: DataFrame, limit, most: int) -> DataFrame:
    """query, seq, id, pos: of each query the first ``limit`` records, in order of insertion,
    that hold any of its terms.

    The first records of a query are among the first of each of its terms, so lists of
    terms are cut at ``most`` (no query's limit is larger) before they meet the queries. A
    term that every record holds thus costs no more than one that few hold.
    """
    heads = first_per(index, ["token"], ["seq"], most, "place").drop("place")
    asked = queries.withColumn("limit", limit).select("query", "limit", F.explode("terms").alias("token"))
    hits = heads.join(asked, "token").groupBy("query", "limit", "seq", "id").agg(F.count(F.lit(1)).alias("terms_hit"))
    w = Window.partitionBy("query").orderBy("seq", "id")
    return hits.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= F.col("limit")).drop("limit")


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("records"), F.min("seq").alias("first_seq"))


def bm25(index_counts: DataFrame, lengths: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query, id, score of the k best records by BM25 (beyond the index's own order).

    index_counts: token, id, tf. lengths: id, words. Frequencies cover all records.
    """
    n, avg = lengths.agg(F.count(F.lit(1)), F.avg("words")).first()
    asked = queries.select("query", F.explode("terms").alias("token"))
    index_counts = index_counts.join(asked.select("token").distinct(), "token", "left_semi")  # no other token is counted or joined
    df = index_counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("words") / F.lit(float(avg or 1))))
    scored = (index_counts.join(df, "token").join(asked, "token").join(lengths, "id")
              .groupBy("query", "id").agg(F.round(F.sum(weight * tf), 6).alias("score")))
    return first_per(scored, ["query"], [F.desc("score"), "id"], k)


def positional(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """Hits with their symbols, source before generated, generated ones capped; adds n, at
    (position in that order, from 0) and frequency of the name among the query's hits."""
    # what terms are looked for in is made once per symbol, before the join, not once per hit and term
    haystack = symbols.select("id", "name", "kind", "package", "file", sc.searchable().alias("haystack"))
    full = hits.select("query", "id", F.col("pos").alias("hit")).join(haystack, "id")
    generated = text.is_generated(F.col("file"))
    per = Window.partitionBy("query")
    ranked = full.withColumn("generated", generated).withColumn(
        "place", F.row_number().over(Window.partitionBy("query", "generated").orderBy("hit")))
    sources = F.sum(F.when(~F.col("generated"), 1).otherwise(0)).over(per)
    kept = ranked.withColumn("sources", sources).filter(
        ~F.col("generated") | (F.col("sources") == 0) | (F.col("place") <= GENERATED_KEPT))
    order = Window.partitionBy("query").orderBy("generated", "hit")
    return (kept.withColumn("n", F.count(F.lit(1)).over(per)).withColumn("at", F.row_number().over(order) - 1)
            .withColumn("same_name", F.count(F.lit(1)).over(Window.partitionBy("query", F.lower("name")))))


def scored(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """query, the symbol and the score of its text match."""
    c = F.col
    q = queries.select("query", "scoring")
    bonus = F.when((c("same_name") < 3) & F.array_contains(c("scoring"), F.lower("name")), sc.name_bonus(c("kind"))).otherwise(sc.num(0))
    score = ((c("n") - c("at")).cast("double") / c("n") + bonus + sc.term_coverage(c("scoring"), c("haystack"))
             + sc.kind_weight(c("kind")) + sc.impl_boost(c("kind"), c("package")) + sc.generated_penalty(c("file")))
    return hits.join(q, "query").withColumn("score", score).withColumn("why", F.lit("semantic match")).drop("scoring", "haystack")
