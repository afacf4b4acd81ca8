"""Structured Streaming over the logs; every query drains what there is and ends."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeweft.functions import text
from codeweft.operators import graph, policy
from codeweft.session import shared_folder


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table as a stream of files."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).format("parquet")
    if os.path.isdir(path) or not os.path.exists(path):
        return reader.load(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").load(sf_dir)


def closed(stream: DataFrame, time: str) -> DataFrame:
    """The stream with a last row far in the future: it moves the watermark past all that came
    before, so that every window closes, is given out and leaves the state. The row's own window
    stays open and is never given out. For logs that have ended."""
    spark = stream.sparkSession
    path = shared_folder(spark, "end-of-log")
    row = [F.lit("9999-01-01").cast("timestamp").alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema]
    spark.range(1).select(*row).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all there is into files of the shared folder, and read those."""
    spark = stream.sparkSession
    out, state = shared_folder(spark, name), shared_folder(spark, f"{name}-state")
    q = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def decisions(events: DataFrame) -> DataFrame:
    """Every read decided as it comes."""
    return policy.decide(events).select("event_no", "class", "lines", "proposed", "allowed", "overridden")


def deduplicated(events: DataFrame, lateness: str = "30 days") -> DataFrame:
    """Redelivered events once, state being kept for as long as redelivery may take."""
    return events.withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(["event_no"])


def tumbling(telemetry: DataFrame, width: str = "1 day") -> DataFrame:
    """Calls and failures per window of event time and repo."""
    return (telemetry.withWatermark("recorded_at", "30 days").groupBy(F.window("recorded_at", width), "repo")
            .agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("success")).alias("failed"))
            .select("repo", F.col("window.start").alias("start"), "calls", "failed"))


def debounced(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """Bursts of reads of one language: a burst closes after a gap without a read."""
    return (events.withColumn("ext", text.extension(F.lower("file"))).withWatermark("recorded_at", "30 days")
            .groupBy(F.session_window("recorded_at", gap), "ext")
            .agg(F.count(F.lit(1)).alias("reads"), F.count(F.when(F.col("start_line").isNull(), 1)).alias("whole"))
            .select("ext", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "reads", "whole"))


def relinked(stream: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """The edges after every batch of symbols has been merged into the folder and the links from methods
    to rpcs have been made anew. Each batch writes a version of both, so one that is run again after a
    failure gives the same."""
    merge, done = merge_into(f"{path}/symbols", "id", "seq"), []

    def write(batch: DataFrame, no: int) -> None:
        merge(batch, no)
        now = batch.sparkSession.read.parquet(f"{path}/symbols/v{no}")
        graph.relink(edges, now).write.mode("overwrite").parquet(f"{path}/edges/v{no}")
        done.append(no)

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(edges.schema).parquet(f"{path}/edges/v{done[-1]}") if done else edges


def merge_into(path: str, key: str, order: str):
    """foreachBatch function that keeps the newest row per key in a folder, version by version."""
    def write(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        # every batch writes a version, so one that cannot be read is an error and not an empty base
        old = spark.read.parquet(f"{path}/v{no - 1}") if no else None
        rows = batch if old is None else old.unionByName(batch)
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{path}/v{no}")

    return write
