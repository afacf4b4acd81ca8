"""Read decisions and counts over telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeweft.functions import text

#: Extensions of source files (fixed values).
SOURCE = (".go", ".ts", ".tsx", ".js", ".jsx", ".proto", ".rs", ".py", ".java", ".c", ".cc", ".cpp", ".h", ".hpp", ".cs", ".rb", ".swift", ".kt")
TARGETED, WHOLE = 200, 350


def once(events: DataFrame, key: str = "event_no") -> DataFrame:
    """Redelivered events once."""
    return events.dropDuplicates([key])


def lines_read() -> Column:
    ranged = (F.col("start_line") > 0) & (F.col("end_line") >= F.col("start_line"))
    return F.when(ranged, F.col("end_line") - F.col("start_line") + 1).otherwise(F.coalesce("file_lines", F.lit(0)))


def decide(events: DataFrame, mode: str = "block") -> DataFrame:
    """class, lines, proposed, allowed, overridden of every read."""
    low = F.lower("file")
    command = F.lower(F.coalesce("command_source", F.lit("")))
    exempt = command.rlike("hook|mcp")
    generated = low.contains("/generated/") | low.contains("/gen/") | low.endswith(".pb.go") | low.endswith("_generated.go")
    kind_of_file = F.lower(F.coalesce("file_type", F.lit("")))
    source = ~kind_of_file.isin("binary", "asset") & (text.extension(low).isin(*SOURCE) | (kind_of_file == "source"))
    ranged = (F.col("start_line") > 0) & (F.col("end_line") >= F.col("start_line"))
    kind = (F.when(exempt, "exempt").when(generated, "generated").when(~source, "non-source")
            .when(F.coalesce(ranged, F.lit(False)), "targeted-source").otherwise("whole-source"))
    limit = F.when(F.col("class") == "targeted-source", TARGETED).when(F.col("class") == "whole-source", WHOLE)
    over = F.coalesce(F.col("lines") > limit, F.lit(False))
    overridden = F.coalesce("override", F.lit(False))
    return (events.withColumn("lines", F.coalesce(lines_read(), F.lit(0))).withColumn("class", kind)
            .withColumn("proposed", F.when(over, "block").otherwise("allow"))
            .withColumn("allowed", F.lit(mode != "block") | (F.col("proposed") == "allow") | overridden)
            .withColumn("overridden", overridden & F.lit(mode == "block") & (F.col("proposed") == "block")))


def decision_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("class").agg(
        F.count(F.lit(1)).alias("reads"), F.count_if(F.col("proposed") == "block").alias("blocks"),
        F.count_if(~F.col("allowed")).alias("denied"), F.count_if("overridden").alias("overrides"))


def class_map(decided: DataFrame) -> DataFrame:
    """One row: totals and a map from class to reads."""
    per = decision_counts(decided)
    return per.agg(F.sum("reads").alias("total"), F.sum("blocks").alias("proposed_blocks"), F.sum("denied").alias("denied"), F.sum("overrides").alias("overrides"),
                   F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "reads"))))).alias("classes"))


def nearest_ranks(rows: DataFrame, by: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """by and a column for every quantile: the least value that so large a part of the rows does not
    exceed. Values are counted, combined before the shuffle, and the window runs over counts."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("n").over(Window.partitionBy(by))
    ranked = counts.withColumn("upto", upto).withColumn("total", total)
    return ranked.groupBy(by).agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("total")), F.col(value))).cast("long").alias(n) for n, q in quantiles.items()])


def session_counts(telemetry: DataFrame, *by: str) -> DataFrame:
    ok = F.count_if("success")
    return telemetry.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), ok.alias("ok"), (F.count(F.lit(1)) - ok).alias("failed"),
        F.sum(F.col("response_bytes").cast("long")).alias("bytes"), F.sum(F.col("estimated_tokens").cast("long")).alias("tokens"))
