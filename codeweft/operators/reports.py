"""Reports over the symbol graph: impact across layers, patterns, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from codeweft.functions import text
from codeweft.operators import graph, lookup
from codeweft.operators.lookup import first_per


def impact(targets: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """target, id, branch, why: what a change of every target reaches; the first branch counts.

    Branches: 1 same name, 2 messages of an rpc, 3 what it implements, 4 what implements it,
    5 callers of it and of what 1 to 4 found by hand-written code, 6 bodies that call its name.
    """
    t = targets.select(F.col("id").alias("target"), F.col("name").alias("target_name"), F.col("kind").alias("target_kind"), "signature")
    names = first_per(symbols.select("id", "name", "seq"), ["name"], ["seq"], 10).select("id", "name")
    same = t.join(names, F.col("target_name") == F.col("name")).select("target", "id", F.lit(1).alias("branch"), F.lit("same name").alias("why"))
    req, resp = text.rpc_messages(F.col("signature"))
    msgs = (t.filter("target_kind = 'rpc'").select("target", F.explode(F.array(req, resp)).alias("name")).filter("name <> ''")
            .join(names, "name").select("target", "id", F.lit(2).alias("branch"), F.lit("request/response message").alias("why")))
    impl = graph.resolved(edges, symbols, "implements")
    ups = t.join(impl, F.col("target") == F.col("from_id")).select("target", F.col("to_id").alias("id"), F.lit(3).alias("branch"), F.lit("implements interface").alias("why"))
    downs = t.filter(F.col("target_kind").isin("interface", "rpc", "service")).join(impl, F.col("target") == F.col("to_id")).select(
        "target", F.col("from_id").alias("id"), F.lit(4).alias("branch"), F.concat(F.lit("implements "), F.col("target_name")).alias("why"))

    def firsts(df: DataFrame) -> DataFrame:
        return first_per(df.filter("id <> target"), ["target", "id"], ["branch", "why"], 1).drop("pos")

    near = firsts(same.unionByName(msgs).unionByName(ups).unionByName(downs))
    meta = symbols.select("id", "kind", "file")
    seeds = (near.join(meta, "id").filter(~text.is_generated(F.col("file")) & ~F.col("kind").isin("rpc", "message", "service", "enum"))
             .select("target", F.col("id").alias("seed")).unionByName(t.select("target", F.col("target").alias("seed"))))
    calls = graph.resolved(edges, symbols, "calls")
    callers = seeds.join(calls, F.col("seed") == F.col("to_id")).select("target", F.col("from_id").alias("id"), F.lit(5).alias("branch"), F.lit("calls").alias("why")).distinct()
    code = symbols.filter(F.col("kind").isin("func", "method")).select("id", "seq", F.explode(text.call_idents(F.col("body"))).alias("name"))
    bodies = first_per(code.join(t.select("target_name").distinct(), F.col("name") == F.col("target_name")), ["name"], ["seq", "id"], 15)
    refs = t.join(bodies.select("id", "name"), F.col("target_name") == F.col("name")).select("target", "id", F.lit(6).alias("branch"), F.lit("body reference (heuristic)").alias("why"))
    return firsts(near.unionByName(callers).unionByName(refs))


def impact_layers(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """target, layer, symbols and the total over layers (layer null)."""
    rows = found.join(symbols.select("id", "file"), "id").withColumn("layer", text.layer(F.col("file")))
    return rows.rollup("target", "layer").agg(F.count(F.lit(1)).alias("symbols")).filter("target is not null")


def dedup_layer_copies(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """Of generated copies (same last name and kind per target) one: the backend's if a later copy is one."""
    rows = found.join(symbols.select("id", "file", "kind", "seq"), "id").filter(text.is_generated(F.col("file")))
    key = ["target", text.last_name(F.col("id")), "kind"]
    pos = F.row_number().over(Window.partitionBy(*key).orderBy("branch", "seq", "id"))
    copies = F.count(F.lit(1)).over(Window.partitionBy(*key))
    rows = rows.withColumn("place", pos).withColumn("copies", copies)
    later = (F.col("place") > 1) & F.col("file").contains("backend")
    w = Window.partitionBy("target", "name_", "kind").orderBy(F.desc("later"), "place")
    return (rows.withColumn("name_", text.last_name(F.col("id"))).withColumn("later", later).withColumn("r", F.row_number().over(w))
            .filter("r = 1").select("target", "id", F.when(F.col("copies") > 1, F.concat(F.lit("+"), F.col("copies") - 1, F.lit(" copies"))).otherwise(F.lit("")).alias("why")))


def _field_references(fields: DataFrame, symbols: DataFrame, n: int = 15) -> DataFrame:
    """field, id: of every field and pattern ('GetX(', '.X', 'X:', in any case) the n earliest bodies that hold it.

    fields: field, go. A pattern is a name at the end or beginning of a run of word letters, so
    the runs are taken out of the bodies once, cut to the n earliest bodies of each, and met with
    the names at their ends by equality.
    """
    run, low = r"(?<![a-z0-9_])([a-z0-9_]++)", F.lower("body")
    runs = F.concat(*[F.transform(F.array_distinct(F.regexp_extract_all(low, F.lit(p), F.lit(1))), lambda t: F.struct(F.lit(k).alias("pattern"), t.alias("run")))
                      for k, p in (("call", run + r"\("), ("access", r"\.([a-z0-9_]++)"), ("literal", run + ":"))])
    code = symbols.filter(F.col("kind").isin("func", "method")).select("id", "seq", F.explode(runs).alias("r")).select("id", "seq", "r.pattern", "r.run")
    code = first_per(code, ["pattern", "run"], ["seq", "id"], n).drop("pos")
    go = F.lower("go")
    names = fields.filter("go <> ''").select("field", F.explode(F.array(*[F.struct(F.lit(k).alias("pattern"), x.alias("part")) for k, x in (
        ("call", F.concat(F.lit("get"), go)), ("access", go), ("literal", go))])).alias("p")).select("field", "p.pattern", "p.part")
    wanted = names.select("pattern", "part").distinct()
    most = wanted.agg(F.coalesce(F.max(F.length("part")), F.lit(0)).alias("most"))  # one row
    width = F.least(F.length("run"), F.col("most"))
    ends = F.transform(F.sequence(F.lit(1), width), lambda k: F.when(F.col("pattern") == "access", F.substring(F.col("run"), F.lit(1), k)).otherwise(F.right("run", k)))
    parts = code.select("pattern", "run").distinct().crossJoin(F.broadcast(most)).filter("most > 0").select("pattern", "run", F.explode(ends).alias("part"))
    held = parts.join(wanted, ["pattern", "part"]).join(code, ["pattern", "run"]).select("pattern", "part", "id", "seq").distinct()
    first = first_per(held, ["pattern", "part"], ["seq", "id"], n).select("pattern", "part", "id")
    return names.join(first, ["pattern", "part"]).select("field", "id").distinct()


def field_impact(symbols: DataFrame) -> DataFrame:
    """field, id, why: the message that declares a field, the getters generated for it, and bodies
    that call a getter, access the field or name it in a literal; the first of these counts."""
    f = symbols.filter("kind = 'field'").select(F.col("id").alias("field"), text.parent_id(F.col("id")).alias("message"), text.go_field_name(F.col("name")).alias("go"))
    messages = symbols.select(F.col("id").alias("message"), F.col("name").alias("message_name"))
    declared = f.join(messages, "message", "left")
    declaring = declared.filter("message_name is not null").select("field", F.col("message").alias("id"), F.lit("declaring message").alias("why"))
    getters = symbols.filter("kind = 'method' and name like 'Get%'").select("id", "name")
    mine = declared.join(getters, F.concat(F.lit("Get"), F.col("go")) == F.col("name")).filter(
        F.col("message_name").isNull() | F.contains("id", F.concat(F.lit("."), F.col("message_name"), F.lit("."))))
    found = declaring.unionByName(mine.select("field", "id", F.lit("generated getter").alias("why")))
    refs = _field_references(f.select("field", "go"), symbols).filter("id <> field").join(found.select("field", "id"), ["field", "id"], "left_anti")
    return found.unionByName(refs.join(f.select("field", "go"), "field").select("field", "id", F.concat(F.lit("references "), F.col("go"), F.lit(" (heuristic)")).alias("why")))


def body_rows(symbols: DataFrame, queries: DataFrame, module: str) -> DataFrame:
    """One row for every (possibly shortened) id: query, id, short_id, body, hint, references (the
    ids of the first ten symbols the body names, in order)."""
    found = lookup.fuzzy(symbols, queries)
    refs = graph.body_references(symbols).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "other"))), lambda r: r["other"]), " ").alias("references"))
    short = text.elide(F.col("id"), module)
    hint = F.when(F.col("id") != F.col("query"), F.concat(F.lit('Fuzzy match: requested "'), F.col("query"), F.lit('", resolved to "'), short, F.lit('"'))).otherwise("")
    return found.select("query", "id").join(symbols.select("id", "body"), "id").join(refs, "id", "left").select(
        "query", "id", short.alias("short_id"), "body", hint.alias("hint"), F.coalesce("references", F.lit("")).alias("references"))


def gaps(symbols: DataFrame) -> DataFrame:
    """service, rpc, state: missing, stubbed or implemented, for every rpc of every service."""
    rpc = symbols.filter("kind = 'rpc'").select(F.col("id").alias("rpc"), "name", text.parent_id(F.col("id")).alias("service"))
    methods = symbols.filter("kind = 'method'").filter(~text.is_generated(F.col("file"))).groupBy("name").agg(
        F.min(F.col("body").contains("codes.Unimplemented")).alias("stubbed"))
    state = F.when(F.col("stubbed").isNull(), "missing").when(F.col("stubbed"), "stubbed").otherwise("implemented")
    return rpc.join(methods, "name", "left").select("service", "rpc", state.alias("state"))


def gap_counts(rows: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return rows.groupBy("service").agg(F.count(F.lit(1)).alias("total"), n("implemented"), n("stubbed"), n("missing"))


def simplest(symbols: DataFrame, edges: DataFrame, n: int = 3) -> DataFrame:
    """kind, id, callees, pos: of every kind of callable the n that call the least, but something."""
    calls = graph.resolved(edges, symbols, "calls").groupBy("from_id").agg(F.count(F.lit(1)).alias("callees"))
    rows = calls.join(symbols.select(F.col("id").alias("from_id"), "kind"), "from_id").select("kind", F.col("from_id").alias("id"), "callees")
    return first_per(rows, ["kind"], ["callees", "id"], n)


def pattern(symbols: DataFrame) -> DataFrame:
    """rpc with its implementation, request and response: one wide row each."""
    rpc = symbols.filter("kind = 'rpc'")
    req, resp = text.rpc_messages(F.col("signature"))
    links = graph.link_rpcs(symbols).select(F.col("to_id").alias("rpc"), F.col("from_id").alias("implementation"))
    msg = first_per(symbols.filter("kind = 'message'").select("name", "id", "seq"), ["name"], ["seq"], 1).select("name", "id")
    r = rpc.select(F.col("id").alias("rpc"), req.alias("req"), resp.alias("resp"))
    return (r.join(links, "rpc", "left")
            .join(msg.select(F.col("name").alias("req"), F.col("id").alias("request")), "req", "left")
            .join(msg.select(F.col("name").alias("resp"), F.col("id").alias("response")), "resp", "left")
            .select("rpc", "implementation", "request", "response"))


def proto_declarations(files: DataFrame) -> DataFrame:
    """file, kind, name of what the heads of proto files declare."""
    h = F.regexp_replace("head", r"//[^\n]*", "")
    proto = files.filter(F.lower("file").endswith(".proto") & F.col("head").isNotNull()).select("file", h.alias("h")).distinct()

    def all_of(kind: str, pattern: str):
        return F.transform(F.regexp_extract_all("h", F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))

    found = F.concat(all_of("service", r"\bservice\s+(\w+)\s*\{"), all_of("rpc", r"\brpc\s+(\w+)\s*\("), all_of("message", r"\bmessage\s+(\w+)\s*\{"),
                     all_of("enum", r"\benum\s+(\w+)\s*\{"),
                     all_of("field", r"(?m)^\s*(?:optional\s+|repeated\s+)?(?!message\b|option\b|return\b|package\b|syntax\b|reserved\b)(?:map\s*<[^>]*>|[\w.]+)\s+(\w+)\s*=\s*\d+\s*(?:\[[^\]]*\])?\s*;"))
    return proto.select("file", F.explode(found).alias("d")).select("file", "d.kind", "d.name")
