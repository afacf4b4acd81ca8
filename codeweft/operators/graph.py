"""Traversal of the symbol graph as joins over the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from codeweft.functions import scoring as sc, text
from codeweft.operators.lookup import first_per
from codeweft.session import checkpointed

#: Bytes of a name from which bodies that only hold it count as callers.
MENTION = 6


def of_kind(edges: DataFrame, kind: str) -> DataFrame:
    return edges.filter(F.col("kind") == kind).select("from_id", "to_id")


def resolved(edges: DataFrame, symbols: DataFrame, kind: str) -> DataFrame:
    """Edges of a kind both ends of which are live symbols; dangling ones fall out."""
    ids = symbols.select("id")
    return (of_kind(edges, kind).join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
            .join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi"))


def neighbours(edges: DataFrame, symbols: DataFrame, kind: str, towards: str) -> DataFrame:
    """id and its neighbour other over edges of a kind: ``callers`` (in-edges) or ``callees``."""
    e = resolved(edges, symbols, kind)
    a, b = ("to_id", "from_id") if towards == "callers" else ("from_id", "to_id")
    return e.select(F.col(a).alias("id"), F.col(b).alias("other"))


def body_callers(symbols: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """id, other: functions whose body calls the name of a symbol, other than itself.

    The names a body calls are taken out once and joined by equality, in place of a search
    of every body for every name. targets: the symbols (id, name) asked for; all if not given.
    """
    code = symbols.filter(F.col("kind").isin("func", "method"))
    calls = code.select(F.col("id").alias("other"), F.explode(text.called_names(F.col("body"))).alias("name"))
    named = (symbols if targets is None else targets).select("id", "name")
    return calls.join(named, "name").filter("id <> other").select("id", "other").distinct()


def body_mentions(symbols: DataFrame, targets: DataFrame, n: int = 15) -> DataFrame:
    """id, other: of the n earliest functions whose body holds a target's name, in any case, those other than itself.

    targets: id, name. Names of fewer than MENTION bytes find nothing. Runs of word letters
    are taken out of the bodies once and cut to the n earliest bodies of each; a run holds a
    name if the two share the name's first letters, and then the whole is compared. A name that
    holds anything else is looked for in the texts between white space.
    """
    named = targets.filter(F.octet_length("name") >= MENTION).select("id", F.lower("name").alias("low"))
    plain = F.col("low").rlike(r"^[\p{L}\p{M}\p{N}_]+$")
    code = symbols.filter(F.col("kind").isin("func", "method")).select("id", "seq", F.lower("body").alias("low"))

    def holding(names: DataFrame, run: str) -> DataFrame:
        runs = code.select(F.col("id").alias("other"), "seq", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(run), F.lit(0)))).alias("run"))
        runs = first_per(runs, ["run"], ["seq", "other"], n).drop("pos")
        size = F.least(F.length("low"), F.lit(MENTION))
        wanted = names.select("low").distinct().withColumn("gram", F.substring(F.col("low"), F.lit(1), size))
        grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(MENTION)), lambda k: F.when(F.length("run") >= k, F.transform(
            F.sequence(F.lit(1), F.length("run") - k + 1), lambda i: F.substring(F.col("run"), i, k))).otherwise(F.array().cast("array<string>")))))
        short = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("run") - (MENTION - 1)), lambda i: F.substring(F.col("run"), i, F.lit(MENTION))))
        # names of MENTION bytes have that many letters, but for those outside ASCII
        met = runs.select("run").distinct().filter(F.octet_length("run") >= MENTION).select("run", F.explode(
            F.when(F.length("run") == F.octet_length("run"), short).otherwise(grams)).alias("gram"))
        hits = met.join(wanted, "gram").filter(F.contains("run", "low")).select("run", "low")
        return hits.join(runs, "run").select("low", "other", "seq").distinct()

    held = holding(named.filter(plain), r"[\p{L}\p{M}\p{N}_]+")
    if not symbols.select(F.lower("name").alias("low")).filter(~plain).isEmpty():
        held = held.unionByName(holding(named.filter(~plain), r"\S+"))
    first = first_per(held, ["low"], ["seq", "other"], n).select("low", "other")
    return named.join(first, "low").filter("id <> other").select("id", "other")


def tiered_callers(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """id, other, tier, why: direct callers; else what it implements; else bodies that call its
    name; else, for names of 6 or more bytes, bodies that hold it."""
    direct = neighbours(edges, symbols, "calls", "callers").select("id", "other", F.lit(1).alias("tier"), F.lit("direct caller").alias("why"))
    impl = neighbours(edges, symbols, "implements", "callees").join(
        symbols.select(F.col("id").alias("other"), F.col("kind").alias("other_kind"), "signature"), "other")
    entry = impl.select("id", "other", F.lit(2).alias("tier"), F.when(
        F.col("other_kind") == "rpc", F.concat(F.lit("gRPC entry point: "), F.col("signature"))).otherwise("implements interface").alias("why"))
    linked = direct.unionByName(entry)
    left = symbols.select("id", "name").join(linked.select("id"), "id", "left_anti")
    calling = checkpointed(body_callers(symbols, left))
    called = calling.select("id", "other", F.lit(3).alias("tier"), F.lit("body reference (heuristic)").alias("why"))
    held = body_mentions(symbols, left.join(calling.select("id"), "id", "left_anti")).select(
        "id", "other", F.lit(4).alias("tier"), F.lit("body reference (non-call)").alias("why"))
    every = linked.join(linked.groupBy("id").agg(F.min("tier").alias("tier")), ["id", "tier"], "left_semi").select("id", "other", "tier", "why")
    return every.unionByName(called).unionByName(held)


def tiered_callees(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """id, other, tier, why: direct callees; else the ten earliest symbols of every exported name the body calls."""
    direct = neighbours(edges, symbols, "calls", "callees").select("id", "other", F.lit(1).alias("tier"), F.lit("direct callee").alias("why"))
    left = symbols.select("id", "body").join(direct.select("id"), "id", "left_anti")
    names = left.select("id", F.explode(text.call_idents(F.col("body"))).alias("name"))
    named = first_per(symbols.select(F.col("id").alias("other"), "name", "seq"), ["name"], ["seq"], 10).select("other", "name")
    called = names.join(named, "name").filter("id <> other").select("id", "other").distinct()
    return direct.unionByName(called.select("id", "other", F.lit(2).alias("tier"), F.lit("body reference (heuristic)").alias("why")))


def flow(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """id, role, other: callers and callees of every symbol that has either."""
    return (neighbours(edges, symbols, "calls", "callers").withColumn("role", F.lit("caller"))
            .unionByName(neighbours(edges, symbols, "calls", "callees").withColumn("role", F.lit("callee"))))


def expand(seeds: DataFrame, edges: DataFrame, symbols: DataFrame, depth: int) -> DataFrame:
    """seed group, id, score, why: what lies within ``depth`` calls of any seed of the group.

    seeds: query, id. A caller scores 0.4 / (hop), a callee 0.3 / (hop); the first hop that
    reaches a symbol counts, of one hop the larger score, then the lesser why. Every hop is one
    join on distinct ids and one anti-join with what was seen, both spread by (query, id);
    the frontier is written between hops, so plans do not grow. No hop looks at a driver.
    """
    calls = resolved(edges, symbols, "calls")
    seen = seeds.select("query", "id").distinct()
    frontier, out = seen, None
    for hop in range(1, max(0, min(depth, 4)) + 1):
        into = frontier.join(calls, F.col("id") == F.col("to_id")).select(
            "query", F.col("from_id").alias("id"), F.lit(sc.CALLER / hop).alias("score"), F.lit(f"caller at hop {hop}").alias("why"))
        outof = frontier.join(calls, F.col("id") == F.col("from_id")).select(
            "query", F.col("to_id").alias("id"), F.lit(sc.CALLEE / hop).alias("score"), F.lit(f"callee at hop {hop}").alias("why"))
        reached = (into.unionByName(outof).join(seen, ["query", "id"], "left_anti").groupBy("query", "id")
                   .agg(F.max(F.struct("score", "why")).alias("r")).select("query", "id", F.col("r.score").alias("score"), F.col("r.why").alias("why"))
                   .withColumn("hop", F.lit(hop)))
        if hop < depth:
            reached = checkpointed(reached)
        out = reached if out is None else out.unionByName(reached)
        frontier = reached.select("query", "id")
        seen = seen.unionByName(frontier)
    if out is None:
        return seen.filter(F.lit(False)).withColumns({"score": F.lit(0.0), "why": F.lit(""), "hop": F.lit(0)})
    return out


def viz_edges(roots: DataFrame, edges: DataFrame, symbols: DataFrame, depth: int = 2) -> DataFrame:
    """root, from_id, to_id: the call edges met on the way out to ``depth`` (2 where it is 0 or
    less, at most 4), each once."""
    depth = 2 if depth <= 0 else min(depth, 4)
    calls = resolved(edges, symbols, "calls")
    seeds = roots.select(F.col("id").alias("query"), "id")
    near = expand(seeds, edges, symbols, depth - 1).select("query", "id") if depth > 1 else None
    visited = seeds if near is None else seeds.unionByName(near)
    touch = [visited.join(calls, F.col("id") == F.col(end)).select(F.col("query").alias("root"), "from_id", "to_id") for end in ("from_id", "to_id")]
    return touch[0].unionByName(touch[1]).distinct()


def viz_towards(roots: DataFrame, edges: DataFrame, symbols: DataFrame, direction: str, depth: int = 2) -> DataFrame:
    """root, from_id, to_id: as viz_edges, going only to ``callers`` or only to ``callees``."""
    depth = 2 if depth <= 0 else min(depth, 4)
    calls = resolved(edges, symbols, "calls")
    at, to = ("to_id", "from_id") if direction == "callers" else ("from_id", "to_id")
    seen = frontier = roots.select(F.col("id").alias("root"), "id")
    out = None
    for hop in range(depth):
        met = frontier.join(calls, F.col("id") == F.col(at)).select("root", "from_id", "to_id")
        if hop + 1 < depth:
            met = checkpointed(met)
            frontier = met.select("root", F.col(to).alias("id")).distinct().join(seen, ["root", "id"], "left_anti")
            seen = seen.unionByName(frontier)
        out = met if out is None else out.unionByName(met)
    return out.distinct()


def dot(viz: DataFrame) -> DataFrame:
    """root, nodes, edges, dot: a drawing of each root's neighbourhood as DOT text."""
    nodes = viz.select("root", F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    numbered = nodes.withColumn("no", F.row_number().over(Window.partitionBy("root").orderBy("id")) - 1)
    label = F.substring_index("id", "/", -1)
    node_text = numbered.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
        "no", F.concat(F.lit("n"), F.col("no"), F.lit(' [label="'), label, F.lit('"];')).alias("t")))), lambda x: x["t"]), "\n").alias("node_text"))
    a = numbered.select("root", F.col("id").alias("from_id"), F.col("no").alias("a"))
    b = numbered.select("root", F.col("id").alias("to_id"), F.col("no").alias("b"))
    lines = viz.join(a, ["root", "from_id"]).join(b, ["root", "to_id"]).groupBy("root").agg(
        F.count(F.lit(1)).alias("edges"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", "b"))), lambda x: F.concat(
            F.lit("n"), x["a"].cast("string"), F.lit(" -> n"), x["b"].cast("string"), F.lit(";"))), "\n").alias("edge_text"))
    return node_text.join(lines, "root").select("root", "nodes", "edges", F.concat_ws(
        "\n", F.lit("digraph {"), "node_text", "edge_text", F.lit("}")).alias("dot"))


def link_rpcs(symbols: DataFrame) -> DataFrame:
    """from_id (method), to_id (rpc): for every rpc the method of its name, in a svc package if there is one."""
    rpc = symbols.filter("kind = 'rpc'").select(F.col("id").alias("to_id"), "name")
    m = symbols.filter("kind = 'method'").select(F.col("id").alias("from_id"), "name", "package", "seq").filter(~text.is_generated(F.col("file")))
    pairs = rpc.join(m, "name")
    return first_per(pairs, ["to_id"], [F.desc(F.col("package").contains("svc")), "seq"], 1).select("from_id", "to_id")


def relink(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """The edge set with all implements edges to rpcs replaced by fresh links."""
    rpcs = symbols.filter("kind = 'rpc'").select(F.col("id").alias("to_id"))
    stale = edges.filter("kind = 'implements'").join(rpcs, "to_id", "left_semi").select("from_id", "to_id", "kind")
    kept = edges.join(stale, ["from_id", "to_id", "kind"], "left_anti")
    return kept.unionByName(link_rpcs(symbols).withColumn("kind", F.lit("implements"))).distinct()


def body_references(symbols: DataFrame, n: int = 10) -> DataFrame:
    """id, other, pos: the first n symbols named in each body, calls before types, itself and generated ones left out."""
    body = F.col("body")
    words = F.array_distinct(F.concat(text.call_idents(body), text.type_idents(body)))
    named = symbols.filter(F.col("kind").isin("func", "method")).select("id", F.posexplode(words).alias("word_at", "name"))
    target = first_per(symbols.select(F.col("id").alias("other"), "name", "file", F.col("seq").alias("other_seq")), ["name"], ["other_seq"], 10)
    hits = named.join(target, "name").filter((F.col("id") != F.col("other")) & ~text.is_generated(F.col("file")))
    once = hits.groupBy("id", "other").agg(F.min(F.struct("word_at", "other_seq")).alias("at"))
    return first_per(once, ["id"], ["at", "other"], n).select("id", "other", "pos")


def degree(edges: DataFrame) -> DataFrame:
    """kind, edges, to_ids, most (edges into one symbol)."""
    into = edges.groupBy("kind", "to_id").agg(F.count(F.lit(1)).alias("n"))
    return into.groupBy("kind").agg(F.sum("n").alias("edges"), F.count(F.lit(1)).alias("to_ids"), F.max("n").alias("most"))
