"""Keeping the index: merges, deletes and restored vectors as joins that give a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from codeweft.functions import text


def upsert(base: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows of base with changes merged by id.

    A changed row keeps package, name and kind, takes the rest, and keeps its vector and
    model only where name, signature and docstring are as before; its seq is the change's.
    base, changes: one row per id.
    """
    b, c = base.alias("b"), changes.alias("c")
    both = b.join(c, F.col("b.id") == F.col("c.id"), "full_outer")
    old, new = (lambda n: F.col(f"b.{n}")), (lambda n: F.col(f"c.{n}"))
    same = (old("name") == new("name")) & (old("signature") == new("signature")) & F.equal_null(old("docstring"), new("docstring"))

    def value(n: str):
        if n in ("id", "package", "name", "kind"):
            return F.coalesce(old(n), new(n))
        if n in ("embedding", "embedding_model"):
            lost = F.lit(None) if n == "embedding" else F.lit("")
            return F.when(new("id").isNull(), old(n)).when(old("id").isNull(), new(n)).when(same, old(n)).otherwise(lost)
        return F.when(new("id").isNotNull(), new(n)).otherwise(old(n))

    return both.select(*[value(n).alias(n) for n in base.columns])


def versions(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First row of every id, and the last where it is another: a base and its changes."""
    rows = log.dropDuplicates(["seq"])
    span = rows.groupBy("id").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    base = rows.join(span.select(F.col("lo").alias("seq")), "seq", "left_semi")
    changes = rows.join(span.filter("lo < hi").select(F.col("hi").alias("seq")), "seq", "left_semi")
    return base, changes


def delete_files(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols without those of the files, and edges without those that touch one of them."""
    dead = symbols.join(files, "file", "left_semi").select("id")
    kept = edges
    for end in ("from_id", "to_id"):
        kept = kept.join(dead.select(F.col("id").alias(end)), end, "left_anti")
    return symbols.join(files, "file", "left_anti"), kept.select(*edges.columns)


def delete_edges(edges: DataFrame, kind: str, packages: DataFrame | None = None, to_symbols: DataFrame | None = None) -> DataFrame:
    """Edges without those of a kind: all, those from the packages (exactly), or those to the symbols."""
    of_kind = edges.filter(F.col("kind") == kind)
    if packages is not None:
        of_kind = of_kind.withColumn("package", text.parent_id(F.col("from_id"))).join(packages.select("package"), "package", "left_semi")
    if to_symbols is not None:
        of_kind = of_kind.join(to_symbols.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return edges.join(of_kind.select("from_id", "to_id", "kind"), ["from_id", "to_id", "kind"], "left_anti")


def delete_edges_below(edges: DataFrame, kind: str, packages: DataFrame) -> DataFrame:
    """Edges without those of a kind whose from_id begins with one of the packages, sibling packages
    of a longer name included. Prefixes of the ids, of the lengths that packages have, are joined by equality."""
    lengths = packages.select(F.sort_array(F.collect_set(F.length("package"))).alias("lengths"))  # one row; paths are short, so lengths are few
    ids = edges.filter(F.col("kind") == kind).select("from_id").distinct()
    cut = ids.crossJoin(F.broadcast(lengths)).select("from_id", F.explode(F.transform("lengths", lambda n: F.substring(F.col("from_id"), F.lit(1), n))).alias("package"))
    gone = cut.join(packages.select("package").distinct(), "package", "left_semi").select("from_id").distinct().withColumn("kind", F.lit(kind))
    return edges.join(gone, ["from_id", "kind"], "left_anti").select(*edges.columns)


def update_vectors(base: DataFrame, fresh: DataFrame) -> DataFrame:
    """base with vector and model taken from fresh (id, embedding, embedding_model) where it has the id; no row is added."""
    f = fresh.select("id", F.col("embedding").alias("e"), F.col("embedding_model").alias("m"), F.lit(True).alias("hit"))
    both = base.join(f, "id", "left")
    return both.select(*[F.when(F.col("hit"), F.col({"embedding": "e", "embedding_model": "m"}[c])).otherwise(F.col(c)).alias(c)
                         if c in ("embedding", "embedding_model") else F.col(c) for c in base.columns])


def restorable(snapshot: DataFrame, fresh: DataFrame) -> DataFrame:
    """id, embedding, embedding_model of the snapshot for fresh rows of unchanged text."""
    keys = ["id", "name", "signature"]
    a = snapshot.filter("embedding is not null and embedding_model <> ''").withColumn("doc", F.coalesce("docstring", F.lit("")))
    b = fresh.select(*keys, F.coalesce("docstring", F.lit("")).alias("doc"))
    return a.join(b, [*keys, "doc"], "left_semi").select("id", "embedding", "embedding_model")


def unembedded(symbols: DataFrame, model: str) -> DataFrame:
    return symbols.filter(F.col("embedding").isNull() | (F.col("embedding_model") != model)).select(
        "id", "seq", text.embedding_text(F.col("signature"), F.col("docstring")).alias("text"))


def stale_files(symbols: DataFrame, files: DataFrame, *extensions: str) -> DataFrame:
    """Files of the index, of the extensions, that are not in the listing."""
    mine = symbols.select("file").filter(text.extension(F.col("file")).isin(*extensions)).distinct()
    return mine.join(files.select("file"), "file", "left_anti")


def nearest_folder(files: DataFrame, folders: DataFrame) -> DataFrame:
    """file, folder: the longest of the folders that holds a file, by joining every ancestor."""
    parts = F.split("file", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    up = files.select("file", F.explode(F.array_distinct(ancestors)).alias("folder"))
    w = Window.partitionBy("file").orderBy(F.desc(F.length("folder")))
    return up.join(folders, "folder", "left_semi").withColumn("r", F.row_number().over(w)).filter("r = 1").select("file", "folder")
