"""Hybrid retrieval for a whole table of tasks: exact names, text, graph; ranked and trimmed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from codeweft.functions import scoring as sc, text
from codeweft.operators import graph, lookup, search, vectors
from codeweft.session import checkpointed

BUDGET = 2000
#: Fixed values of the vector phase: weight of a cosine, hits that are merged.
VECTOR, VECTOR_HITS = 1.5, 30
BRIEF_LEAST = 5  # no row costs less, so no more than budget / 5 rows are kept


def exact_hits(queries: DataFrame, symbols: DataFrame, *carried: str) -> DataFrame:
    """query, id, score, why of symbols that a task names: whole names, and names within names; and what
    is carried of the symbols."""
    # identifiers meet the symbols without their task's words, which would go with every one of them;
    # hits and words meet once
    text_of = F.xxhash64("words")
    asked = queries.select("query", text_of.alias("text_of"), F.explode("idents").alias("ident"))
    whole = lookup.by_name(symbols).join(asked, F.col("name") == F.col("ident"))
    kind = F.when(F.col("kind") == "field", sc.num(0)).otherwise(sc.kind_weight(F.col("kind")))
    columns = ["query", "text_of", "ident", "id", *carried]
    first = whole.select(*columns, (sc.num(sc.EXACT) + kind + sc.impl_boost(F.col("kind"), F.col("package"))
                         + sc.generated_penalty(F.col("file"))).alias("base"), F.lit(0).alias("phase"))
    needles = asked.filter(F.octet_length("ident") >= 10).select(F.col("ident").alias("needle")).distinct()
    inside = (lookup.names_containing(symbols, needles).select("needle", "id").join(symbols, "id")
              .join(asked, F.col("needle") == F.col("ident")))
    second = inside.select(*columns, (sc.num(sc.CONTAINS) + sc.kind_weight(F.col("kind")) + sc.generated_penalty(F.col("file"))).alias("base"), F.lit(1).alias("phase"))
    said = queries.select("query", text_of.alias("said_of"), sc.asked_words(F.col("words")).alias("said"))
    score = F.col("base") + sc.affinity(F.col("said"), F.col("id"), F.col("ident"))
    why = F.when(F.col("phase") == 0, F.lit("exact name match")).otherwise(F.concat(F.lit("name contains "), F.col("ident")))
    # by task alone, so that its hits need not be moved again; a key of two texts keeps each to its own words,
    # in two comparisons because an equality would become part of the key
    every = (first.unionByName(second).join(said, "query").filter((F.col("text_of") <= F.col("said_of")) & (F.col("text_of") >= F.col("said_of")))
             .select("query", "id", *carried, score.alias("score"), why.alias("why"), "phase"))
    return lookup.first_per(every, ["query", "id"], ["phase", F.desc("score"), "why"], 1).drop("pos")


def text_hits(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    most = queries.select(F.max(search.fetch_limit())).first()[0] or 0  # one number
    hits = search.any_term(search.postings(symbols), queries, search.fetch_limit(), most)
    return search.scored(search.positional(hits, symbols), queries)


def candidates(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """query, id, score, why: exact hits, then text hits of symbols not yet there. A precise task
    (one identifier) is not searched as text: its words would find what it does not name."""
    found = exact_hits(queries, symbols).unionByName(
        text_hits(queries.filter(~F.col("precise")), symbols).select("query", "id", "score", "why", F.lit(2).alias("phase")))
    return lookup.first_per(found, ["query", "id"], ["phase"], 1).select("query", "id", F.round("score", 9).alias("score"), "why")


def usable(dimensions: int = 64):
    """Whether a symbol's vector can be compared."""
    return vectors.valid("embedding") & (F.size("embedding") == dimensions)


def task_vectors(queries: DataFrame, symbols: DataFrame, dimensions: int = 64, named: DataFrame | None = None) -> DataFrame:
    """query, model, vector: what a task means, by the vector of the best symbol it names (of equal
    scores the lesser id). Tasks that name none, or none with a usable vector, have no row.
    named: the exact hits with ``usable``, where they are there already."""
    if named is None:
        named = exact_hits(queries, symbols.withColumn("usable", usable(dimensions)), "usable")
    best = lookup.first_per(named.filter("usable").select("query", "id", "score"), ["query"], [F.desc(F.round("score", 9)), "id"], 1)
    return best.join(symbols.select("id", "embedding_model", "embedding"), "id").select("query", F.col("embedding_model").alias("model"), F.col("embedding").alias("vector"))


def vector_hits(asked: DataFrame, symbols: DataFrame, k: int = VECTOR_HITS, without: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """query, id, score, why of the k symbols of the model nearest to every task's vector. Symbols
    without a usable vector of the same length take no part; a task without a vector has no hits.
    without: (query, seq) that are among the k but not told. digits: of the score, rounded once."""
    s = symbols.select("seq", "id", "kind", "package", "file", "embedding", "embedding_model")
    q = asked.select(F.col("query").alias("seq"), F.col("vector").alias("embedding"), F.col("model").alias("embedding_model"))
    near = vectors.nearest(s, q.withColumn("seq", -F.col("seq") - 1), k, "seq", "embedding_model").select((-F.col("query") - 1).alias("query"), F.col("neighbour").alias("seq"), "sim")
    if without is not None:
        near = near.join(without.select("query", "seq"), ["query", "seq"], "left_anti")
    score = (F.round("sim", 9) * sc.num(VECTOR) + sc.kind_weight(F.col("kind")) + sc.impl_boost(F.col("kind"), F.col("package")) + sc.generated_penalty(F.col("file")))
    return near.join(s.drop("embedding", "embedding_model"), "seq").select("query", "id", F.round(score, digits).alias("score"), F.lit("vector match").alias("why"))


def with_vectors(found: DataFrame, queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """Candidates and the vector hits that are not among them: recall is only ever added."""
    hits = vector_hits(task_vectors(queries, symbols), symbols)
    return found.select("query", "id", "score", "why").unionByName(hits.join(found.select("query", "id"), ["query", "id"], "left_anti"))


def vectors_add(queries: DataFrame, symbols: DataFrame, digits: int = 9) -> DataFrame:
    """Of with_vectors over the exact hits, what the vectors add. The hits are found once, and their long
    ids are not moved again: they serve as flags and numbers."""
    found = checkpointed(exact_hits(queries, symbols.withColumn("usable", usable()), "seq", "usable").select("query", "seq", "id", "score", "usable"))
    return vector_hits(task_vectors(queries, symbols, named=found), symbols, without=found, digits=digits)


def dedup_generated(rows: DataFrame) -> DataFrame:
    """Of copies in /gen/ folders (same last name and kind within a query) the backend's, else the best, stays."""
    key = ["query", text.last_name(F.col("id")), "kind"]
    best = Window.partitionBy(*key, "in_gen").orderBy(F.desc(F.col("file").contains("backend")), F.desc("score"), "id")
    return (rows.withColumn("in_gen", F.col("file").contains("/gen/")).withColumn("r", F.row_number().over(best))
            .filter(~F.col("in_gen") | (F.col("r") == 1)).drop("in_gen", "r"))


def dedup_boilerplate(rows: DataFrame) -> DataFrame:
    """Three or more symbols of one last name within a query: the best stays, its score lowered."""
    key = ["query", text.last_name(F.col("id"))]
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    r = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "id"))
    return (rows.withColumn("n", n).withColumn("r", r).filter("n < 3 or r = 1")
            .withColumn("why", F.when(F.col("n") >= 3, F.concat("why", F.lit(" (+"), F.col("n") - 1, F.lit(" similar "), text.last_name(F.col("id")), F.lit(" omitted)"))).otherwise(F.col("why")))
            .withColumn("score", F.when(F.col("n") >= 3, F.round(F.col("score") - (F.col("n") - 2) * sc.num(0.15), 9)).otherwise(F.col("score")))
            .drop("n", "r"))


def with_expansion(scored: DataFrame, edges: DataFrame, symbols: DataFrame, depth: int = 1) -> DataFrame:
    """Scored rows and what calls join to them; scored ones come first."""
    near = graph.expand(scored.select("query", "id"), edges, symbols, depth).select("query", "id", F.round("score", 9).alias("score"), "why")
    return scored.select("query", "id", "score", "why").unionByName(near)


def ranked(rows: DataFrame) -> DataFrame:
    """rank: source before generated (unless named by the task), then score, then id."""
    named = F.col("why").startswith("name contains ") | F.col("why").startswith("exact name match")
    demoted = text.is_generated(F.col("file")) & ~named
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(demoted, F.desc("score"), "id")))


def whole_ranks(rows: DataFrame, *order, name: str = "rank", by: str = "query") -> DataFrame:
    """rows with the place of each within ``by``, for groups of any size: rows are spread by ranges of the
    order, numbered within (group, range), and moved on by what the ranges before hold. A group that
    holds much of the table lies in many ranges, and no task sees more than one of them."""
    spread = checkpointed(rows.withColumns({f"o{i}_": o for i, o in enumerate(order)}).repartitionByRange(by, *_directed(order)).withColumn("part", F.spark_partition_id()))
    sizes = spread.groupBy(by, "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(by, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(by, "part").orderBy(*_directed(order)))
    return (spread.withColumn("inside", inside).join(sizes, [by, "part"]).withColumn(name, (F.col("inside") + F.col("before")).cast("int"))
            .select(*rows.columns, name))


def _directed(order):
    """The columns o0_, o1_, ... that stand for an order's values, all ascending."""
    return [F.col(f"o{i}_") for i in range(len(order))]


def source_first(rows: DataFrame) -> DataFrame:
    """As ranked, for lists without a bound: a whole package, a whole index."""
    named = F.col("why").startswith("name contains ") | F.col("why").startswith("exact name match")
    return whole_ranks(rows, text.is_generated(F.col("file")) & ~named, -F.col("score"), F.col("id"))


def as_text(kept: DataFrame, full: DataFrame) -> DataFrame:
    """query, text: what a task is answered with, one line per symbol in order, the packages before and
    what was cut off after. No text is longer than the budget under which ``kept`` was trimmed allows."""
    place = F.when(F.col("line_end") > F.col("line_start"), F.concat_ws("-", F.col("line_start").cast("string"), F.col("line_end").cast("string"))).otherwise(F.col("line_start").cast("string"))
    line = F.concat_ws(" \u2014 ", F.concat_ws(" ", "kind", "id"), "signature", F.concat_ws(":", F.col("file"), place))

    def joined(rows: DataFrame, order, text_) -> DataFrame:
        return rows.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text_.alias("t")))), lambda x: x["t"]), "\n").alias("t"))

    lines = joined(kept, ["rank"], line).withColumnRenamed("t", "lines")
    packages = package_summary(kept).withColumn("less", -F.col("symbols"))
    heads = joined(packages, ["less", "folder"], F.concat(F.lit("  "), F.col("folder"), F.lit(" \u2014 "), F.col("symbols").cast("string"), F.lit(" ("), F.col("kinds"), F.lit(")")))
    heads = heads.select("query", F.concat(F.lit("packages:\n"), "t", F.lit("\n")).alias("head"))
    cut = trace(full, kept).select("query", "truncated")
    foot = F.when(F.col("truncated") > 0, F.concat(F.lit("(+"), F.col("truncated").cast("string"), F.lit(" more)")))
    return lines.join(heads, "query", "left").join(cut, "query").select("query", F.concat_ws("\n", "head", "lines", foot).alias("text"))


def trimmed(rows: DataFrame, budget: int = BUDGET, cost=None) -> DataFrame:
    """The longest prefix whose running cost stays within the budget. The window runs per task
    over no more rows than the budget could hold."""
    upto = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (rows.filter(F.col("rank") <= budget // BRIEF_LEAST).withColumn("cost", sc.cost_brief() if cost is None else cost)
            .withColumn("used", F.sum("cost").over(upto)).filter(F.col("used") <= budget))


def context(queries: DataFrame, symbols: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    """All ranked candidates of every task, before trimming."""
    meta = symbols.select("id", "kind", "file", "signature", "docstring", "package")
    scored = candidates(queries, symbols).join(meta, "id")
    kept = checkpointed(dedup_boilerplate(dedup_generated(scored)).select("query", "id", "score", "why"))  # read by each branch of the expansion
    full = with_expansion(kept, edges, symbols, depth).join(meta, "id")
    return ranked(full)


def package_summary(rows: DataFrame, by: str = "query") -> DataFrame:
    """by, package folder, count and kinds of rows; nothing where there is but one row or one folder."""
    kinds = rows.groupBy(by, text.dirname(F.col("file")).alias("folder"), "kind").agg(F.count(F.lit(1)).alias("n"))
    label = F.when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit(" "), F.col("kind"), F.lit("s"))).otherwise(F.col("kind"))
    per = kinds.groupBy(by, "folder").agg(F.sum("n").alias("symbols"), F.array_join(F.sort_array(F.collect_list(label)), ", ").alias("kinds"))
    w = Window.partitionBy(by)
    return per.withColumn("folders", F.count(F.lit(1)).over(w)).filter("folders > 1").drop("folders")


def trace(all_rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Per task: candidates, kept, cut off, tokens."""
    a = all_rows.groupBy("query").agg(F.count(F.lit(1)).alias("candidates"))
    k = kept.groupBy("query").agg(F.count(F.lit(1)).alias("returned"), F.max("used").alias("tokens"))
    return a.join(k, "query", "left").select("query", "candidates", F.coalesce("returned", F.lit(0)).alias("returned"),
                                             (F.col("candidates") - F.coalesce("returned", F.lit(0))).alias("truncated"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
