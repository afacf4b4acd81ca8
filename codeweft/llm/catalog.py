"""Queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeweft.session import checkpointed, table
from codeweft.llm import docpairs, garble, leakage, neighbours, percentiles, sourceclass, spans, tokenize


#: The house whose hand-written source is to remain.
HOUSE = "Kestrel Orchard Works"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourceclass.found(p1_classes(spark, sf_dir))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourceclass.classify(table(spark, sf_dir, "source_files"), HOUSE)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbours.similar_pairs(table(spark, sf_dir, "symbols"), 0.9)
    return pairs.select(F.col("a").alias("seq_a"), F.col("b").alias("seq_b"))


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar rows of every current row, approximate."""
    return neighbours.nearest_rows(table(spark, sf_dir, "symbols"))


def p3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth row searched in the graph."""
    graph = checkpointed(p3_neighbours(spark, sf_dir))
    codes = neighbours.current_codes(table(spark, sf_dir, "symbols"), "seq", "id", "embedding_model", "embedding", 8)
    queries = codes.filter("seq % 100 = 0").select(F.col("seq").alias("query"), "model", "code")
    return neighbours.greedy_search(graph, codes, queries)


def p4_tool_day_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ["metric", "tool", "day"]
    keys = percentiles.keyed(percentiles.measures(table(spark, sf_dir, "session_telemetry")), groups, "value", whole=True)
    return percentiles.wide(percentiles.select(keys, groups, list(percentiles.QUANTILES.values()), whole=True), groups)


def p4_tool_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ["metric", "tool"]
    keys = percentiles.keyed(percentiles.measures(table(spark, sf_dir, "session_telemetry")), groups, "value", whole=True)
    return percentiles.wide(percentiles.select(keys, groups, list(percentiles.QUANTILES.values()), whole=True), groups)


def p4_merged_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = percentiles.day_states(table(spark, sf_dir, "session_telemetry"))
    groups = ["metric", "tool"]
    return percentiles.bounds(percentiles.merge(states, groups), groups, list(percentiles.QUANTILES.values()), whole=True)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.found_pairs(table(spark, sf_dir, "symbols"))


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.pairs(table(spark, sf_dir, "symbols"))


def _shared_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = table(spark, sf_dir, "symbols")
    return spans.shared_windows(symbols, symbols.groupBy("id").agg(F.max("seq").alias("seq")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.sharing_pairs(_shared_windows(spark, sf_dir))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that share a span with others, by class: linear in the records."""
    classes = spans.sharing_classes(_shared_windows(spark, sf_dir))
    least = classes.groupBy("full").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("members"))
    return classes.join(least, "full").groupBy("seq").agg(F.min("first_seq").alias("first_seq"), F.max("members").alias("members"), F.count(F.lit(1)).alias("classes"))


def p6_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.intervals(_shared_windows(spark, sf_dir))


def p6_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "symbols")
    return spans.coverage(p6_intervals(spark, sf_dir), s, current=s.groupBy("id").agg(F.max("seq").alias("seq")))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "task_manifest"))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.clean_documents(table(spark, sf_dir, "documents"), p8_leaks(spark, sf_dir)).select("doc_id", "n_chars")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_repaired(spark, sf_dir).select("doc_id")


def p9_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garble.find_garbled(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_classes, p3_found, p3_neighbours, p3_search, p4_tool_day_percentiles, p4_tool_percentiles, p4_merged_bounds, p5_found, p5_pairs, p6_found, p6_classes, p6_intervals, p6_coverage,
    p7_ids, p8_found, p8_leaks, p8_clean, p9_found, p9_repaired)}

_MEASURES = """
WITH once AS (SELECT DISTINCT event_no, recorded_at, tool, duration_ms, estimated_tokens FROM session_telemetry),
m AS (SELECT 'duration_ms' AS metric, lower(trim(tool)) AS tool, CAST(recorded_at AT TIME ZONE 'UTC' AS DATE) AS day, CAST(duration_ms AS BIGINT) AS v FROM once
      UNION ALL SELECT 'estimated_tokens', lower(trim(tool)), CAST(recorded_at AT TIME ZONE 'UTC' AS DATE), CAST(estimated_tokens AS BIGINT) FROM once)
SELECT {groups}, count(*) AS n, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.9) AS p90,
       quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99
FROM m WHERE v >= 0 GROUP BY {groups}"""

_LEAKS = """
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(prompt), '[a-z0-9]+') AS w FROM task_manifest WHERE prompt IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw WHERE len(w) >= 12)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw WHERE len(w) >= 12)),
found AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))
"""

_CURRENT = "SELECT * FROM symbols QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1"
_SPANS = f"""
WITH cur AS ({_CURRENT}),
w AS (SELECT seq, place, substr(body, place + 1, 200) AS span FROM (SELECT seq, body, unnest(range(0, length(body) - 199)) AS place FROM cur WHERE length(body) >= 200)),
rep AS (SELECT span FROM w GROUP BY span HAVING min(seq) < max(seq)), sh AS (SELECT w.* FROM w JOIN rep USING (span))
"""
_INTERVALS = """
, f AS (SELECT seq, place, CASE WHEN place > lag(place) OVER (PARTITION BY seq ORDER BY place) + 200 THEN 1 ELSE 0 END AS fresh FROM sh),
p AS (SELECT seq, place, sum(fresh) OVER (PARTITION BY seq ORDER BY place) AS part FROM f),
iv AS (SELECT seq, min(place)::INTEGER AS start, (max(place) + 200)::INTEGER AS "end" FROM p GROUP BY seq, part)
"""

ORACLE = {
    "p3_found": f"""WITH v AS (SELECT seq, embedding_model AS m, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM ({_CURRENT})
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
        SELECT a.seq AS seq_a, b.seq AS seq_b FROM v a JOIN v b ON a.m = b.m AND a.seq < b.seq WHERE list_cosine_similarity(a.e, b.e) >= 0.9""",
    "p4_merged_bounds": """WITH once AS (SELECT DISTINCT event_no, recorded_at, tool, duration_ms, estimated_tokens FROM session_telemetry),
        m AS (SELECT 'duration_ms' AS metric, lower(trim(tool)) AS tool, CAST(duration_ms AS BIGINT) AS v FROM once UNION ALL SELECT 'estimated_tokens', lower(trim(tool)), CAST(estimated_tokens AS BIGINT) FROM once),
        b AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE length(bin(v)) * 1024 + (v >> greatest(length(bin(v)) - 9, 0)) END AS bucket,
                     row_number() OVER (PARTITION BY metric, tool ORDER BY v) AS r, count(*) OVER (PARTITION BY metric, tool) AS n FROM m WHERE v >= 0),
        t AS (SELECT metric, tool, q, n, bucket FROM b, (SELECT unnest([0.5, 0.9, 0.95, 0.99]::DOUBLE[]) AS q) WHERE r = greatest(ceil(q * n), 1))
        SELECT t.metric, t.tool, q, t.n, min(v)::DOUBLE AS low, max(v)::DOUBLE AS high FROM t JOIN b ON b.metric = t.metric AND b.tool IS NOT DISTINCT FROM t.tool AND b.bucket = t.bucket GROUP BY ALL""",
    "p6_found": _SPANS + "SELECT DISTINCT a.seq AS seq_a, b.seq AS seq_b FROM sh a JOIN sh b ON a.span = b.span AND a.seq < b.seq",
    "p6_intervals": _SPANS + _INTERVALS + "SELECT * FROM iv",
    "p6_coverage": _SPANS + _INTERVALS + """, per AS (SELECT seq, sum("end" - start)::BIGINT AS shared FROM iv GROUP BY seq)
        SELECT seq, coalesce(shared, 0) AS shared, coalesce(length(body), 0) AS chars, CASE WHEN length(body) > 0 THEN coalesce(shared, 0) / length(body) ELSE 0 END AS share FROM cur LEFT JOIN per USING (seq)""",
    "p4_tool_day_percentiles": _MEASURES.format(groups="metric, tool, day"),
    "p4_tool_percentiles": _MEASURES.format(groups="metric, tool"),
    "p8_found": _LEAKS + "SELECT doc_id, item_id FROM found",
    "p8_clean": _LEAKS + "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM found)",
}
