"""References to records that do not exist at the time of the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ALWAYS, DELETED, INDEXED, REFERENCE = 0, 1, 2, 3


def edge_ends(edges: DataFrame) -> DataFrame:
    """One row per non-empty edge end: edge_no, side, id, ts."""
    ends = F.array(
        F.struct(F.lit("from_id").alias("side"), F.col("from_id").alias("id")),
        F.struct(F.lit("to_id").alias("side"), F.col("to_id").alias("id")),
    )
    return (
        edges.select("edge_no", F.col("indexed_at").alias("ts"), F.explode(ends).alias("e"))
        .select("edge_no", "ts", "e.side", "e.id")
        .filter(F.col("id").isNotNull() & (F.col("id") != ""))
    )


def _salts(refs: DataFrame, total: int, piece_rows: int, most_hot: int) -> DataFrame:
    """Ids with more references than one piece, and into how many pieces each is cut.

    A piece is never smaller than total / most_hot, so at most ``most_hot`` ids qualify (some
    20 MB): the table is small enough to broadcast whatever the size of the input. A piece is one
    sorted run that a window streams over and that may spill.
    """
    piece = max(piece_rows, -(-total // most_hot))
    return (
        refs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > piece)
        .select("id", F.ceil(F.col("n") / piece).cast("int").alias("pieces"))
    )


def resolve(
    refs: DataFrame, indexed: DataFrame, deleted: DataFrame, always: DataFrame,
    piece_rows: int = 50_000, most_hot: int = 200_000,
) -> DataFrame:
    """State of the parent of every reference at the reference's own time.

    refs: edge_no, side, id, ts. indexed, deleted: id, ts. always: id.
    References and parent events are partitioned by id, sorted by time and merged in one
    forward pass (a running window), which is linear in both. References to a hot id are
    cut into pieces; its parent events go to every piece. Adds ``state``: the kind of the
    last parent event up to the reference, null where there is none; ALWAYS wins.

    Nulls: a reference or parent event of null id or null ts is left out by the caller or
    sorts before all times. An index and a deletion at the same instant: the index counts
    as the later. Repeated references are kept, each its own row. Empty tables: without
    parents every state is null.
    """
    hot = F.broadcast(_salts(refs, refs.count(), piece_rows, most_hot))
    cut = refs.join(hot, "id", "left").select(
        "id", F.lit(REFERENCE).alias("what"), "ts", "edge_no", "side",
        F.coalesce(F.pmod(F.xxhash64("edge_no", "side"), F.col("pieces")), F.lit(0)).cast("int").alias("piece"),
    )

    def event(df: DataFrame, what: int, ts: Column) -> DataFrame:
        return df.select("id", F.lit(what).alias("what"), ts.alias("ts"))

    parents = (
        event(always, ALWAYS, F.lit(None).cast("timestamp"))
        .unionByName(event(indexed, INDEXED, F.col("ts")))
        .unionByName(event(deleted, DELETED, F.col("ts")))
    )
    parents = parents.join(hot, "id", "left").select(
        "id", "what", "ts", F.lit(None).cast("long").alias("edge_no"), F.lit(None).cast("string").alias("side"),
        F.explode(F.sequence(F.lit(0), F.coalesce(F.col("pieces"), F.lit(1)) - 1)).alias("piece"),
    )
    upto = (
        Window.partitionBy("id", "piece").orderBy("ts", "what")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    parent = F.when(F.col("what") != REFERENCE, F.col("what"))
    return (
        cut.unionByName(parents)
        .withColumn("first", F.min(parent).over(upto))
        .withColumn("last", F.last(parent, ignorenulls=True).over(upto))
        .filter(F.col("what") == REFERENCE)
        .select("edge_no", "side", "id", "ts",
                F.when(F.col("first") == ALWAYS, F.lit(ALWAYS)).otherwise(F.col("last")).alias("state"))
    )


def orphans(edges: DataFrame, symbols: DataFrame, deletes: DataFrame, always: DataFrame, **kw) -> DataFrame:
    """Every edge end whose id was not live at the edge's time, with the last state."""
    states = resolve(
        edge_ends(edges),
        symbols.select("id", F.col("indexed_at").alias("ts")),
        deletes.select("id", F.col("deleted_at").alias("ts")),
        always.select("id"), **kw,
    )
    return states.filter(F.col("state").isNull() | (F.col("state") == DELETED))


def classify_orphans(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds reason: deleted, late (indexed only afterwards) or missing (never indexed).

    Only orphans without an earlier event are matched with the parent ids, once per id.
    """
    nowhere = found.filter(F.col("state").isNull())
    known = nowhere.select("id").distinct().join(symbols.select("id"), "id", "left_semi").withColumn("known", F.lit(True))
    return (
        nowhere.join(known, "id", "left")
        .withColumn("reason", F.when(F.col("known"), F.lit("late")).otherwise(F.lit("missing"))).drop("known")
        .unionByName(found.filter(F.col("state").isNotNull()).withColumn("reason", F.lit("deleted")))
    )


def orphans_by_month(classified: DataFrame) -> DataFrame:
    """Orphan ends per side, month and reason."""
    return (
        classified.groupBy("side", F.date_format("ts", "yyyy-MM").alias("month"), "reason")
        .agg(F.count(F.lit(1)).alias("ends"), F.count_distinct("id").alias("ids"))
    )
