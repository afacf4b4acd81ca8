"""Registered queries of the core. Each runs over the whole of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeweft.functions import scoring as sc, text
from codeweft.operators import evaluation, graph, lookup, maintenance, policy, references, reports, retrieval, search, vectors
from codeweft.operators.versions import current_rows
from codeweft.plans import oracle
from codeweft.session import checkpointed, shared_folder, table
from codeweft.sources import index, vectors as vector_io
from codeweft.streaming import streams

MODULE = "kestrel.example"
QUERIES: dict = {}
ORACLE = oracle.SQL


def query(f):
    QUERIES[f.__name__] = f
    return f


# references


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphans(*(table(spark, sf_dir, t) for t in ("edges", "symbols", "symbol_deletes", "dep_symbols")))


@query
def p2_found(spark, sf_dir):
    return _orphans(spark, sf_dir).select("edge_no", "side")


@query
def p2_orphans_by_month(spark, sf_dir):
    return references.orphans_by_month(references.classify_orphans(_orphans(spark, sf_dir), table(spark, sf_dir, "symbols")))


# lookups


@query
def lookup_exact(spark, sf_dir):
    ids = index.edges(spark, sf_dir).select(F.col("to_id").alias("id")).distinct()
    return index.symbols(spark, sf_dir).join(ids, "id", "left_semi").select("id", "kind", "file", "line_start", "line_end")


@query
def lookup_by_name_top10(spark, sf_dir):
    return lookup.by_name(index.symbols(spark, sf_dir)).select("name", "id", "pos")


@query
def lookup_by_name_kind(spark, sf_dir):
    return index.symbols(spark, sf_dir).groupBy("name", "kind").agg(F.count(F.lit(1)).alias("symbols"), F.min("id").alias("first_id"))


@query
def lookup_by_kind(spark, sf_dir):
    return index.symbols(spark, sf_dir).filter("kind = 'service'").select("id", "name", "package", "file")


@query
def lookup_by_file(spark, sf_dir):
    return lookup.by_file(index.symbols(spark, sf_dir)).select("file", "pos", "id", "line_start")


@query
def lookup_ext_files(spark, sf_dir):
    return lookup.files_with_extension(index.symbols(spark, sf_dir), ".ts", ".tsx")


@query
def lookup_children_prefix(spark, sf_dir):
    return lookup.children(index.symbols(spark, sf_dir), "rpc", "field", "method").select("parent", "parent_kind", "id", "kind")


@query
def lookup_name_contains(spark, sf_dir):
    s = index.symbols(spark, sf_dir)
    needles = s.filter(F.col("kind").isin("func", "method")).select(F.regexp_extract("name", "^[A-Z][a-z]+([A-Z].*)$", 1).alias("needle"))
    return lookup.names_containing(s, needles).select("needle", "id", "pos")


def _short_ids(spark, sf_dir):
    """What people write of an id: its last two parts."""
    ends = index.edges(spark, sf_dir).select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    return ends.select(F.regexp_extract(F.substring_index("id", "/", -1), r"([^.]+\.[^.]+)$", 1).alias("query")).filter("query <> ''").distinct()


@query
def lookup_fuzzy_tiered(spark, sf_dir):
    return lookup.fuzzy(index.symbols(spark, sf_dir), _short_ids(spark, sf_dir))


@query
def lookup_best_candidate(spark, sf_dir):
    s = index.symbols(spark, sf_dir)
    q = s.select("id", "name", "package", "seq").withColumn("query", F.concat(F.lit("gen."), F.col("name")))
    scored = q.withColumn("score", F.greatest(lookup.best_candidate_score(F.col("package"), F.col("query")), F.lit(-1.0)))
    return lookup.first_per(scored, ["query"], [F.desc("score"), "seq"], 1).select("query", "id", "score")


@query
def lookup_elided(spark, sf_dir):
    return index.symbols(spark, sf_dir).select("id", text.elide(F.col("id"), MODULE).alias("short_id"), text.dirname(F.col("file")).alias("folder"))


@query
def lookup_expand_ids(spark, sf_dir):
    s = index.symbols(spark, sf_dir)
    ids = index.edges(spark, sf_dir).select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    return lookup.expand_ids(s, ids.select(F.explode(F.array(F.col("id"), text.elide(F.col("id"), MODULE))).alias("query")), MODULE)


# bodies


@query
def body_rows(spark, sf_dir):
    return reports.body_rows(index.symbols(spark, sf_dir), _short_ids(spark, sf_dir), MODULE)


@query
def body_declarations(spark, sf_dir):
    s = index.symbols(spark, sf_dir)
    return s.select("id", text.declaration(F.col("body")).alias("declaration")).withColumn("lines", F.size(F.split("declaration", "\n")))


@query
def body_contains(spark, sf_dir):
    s = index.symbols(spark, sf_dir)
    return s.filter(F.col("kind").isin("func", "method") & F.lower("body").contains("context")).select("id", "seq")


@query
def body_callers(spark, sf_dir):
    return graph.body_callers(index.symbols(spark, sf_dir))


@query
def body_call_idents(spark, sf_dir):
    return index.symbols(spark, sf_dir).select("id", F.explode(text.call_idents(F.col("body"))).alias("ident"))


@query
def body_type_idents(spark, sf_dir):
    return index.symbols(spark, sf_dir).select("id", F.explode(text.type_idents(F.col("body"))).alias("ident"))


@query
def body_references(spark, sf_dir):
    return graph.body_references(index.symbols(spark, sf_dir))


@query
def body_first_lines(spark, sf_dir):
    s = index.symbols(spark, sf_dir)
    return s.select("id", text.line_range(F.col("body"), F.lit(1), F.lit(3)).alias("lines"), text.is_line_reference(F.col("body")).alias("reference"),
                    F.size(F.split("body", "\n")).alias("n_lines"), text.token_estimate(F.col("body")).alias("tokens"))


# scalar functions over whole columns


@query
def scalar_names(spark, sf_dir):
    n = F.col("name")
    return index.symbols(spark, sf_dir).select("id", text.decompose(n).alias("words"), text.is_compound(n).alias("compound"),
                                               text.go_field_name(n).alias("go_name"), text.last_name(F.col("id")).alias("last_name"))


@query
def scalar_rpc_messages(spark, sf_dir):
    req, resp = text.rpc_messages(F.col("signature"))
    return index.symbols(spark, sf_dir).filter("kind = 'rpc'").select("id", req.alias("request"), resp.alias("response"))


@query
def scalar_layers(spark, sf_dir):
    f = F.col("file")
    return table(spark, sf_dir, "source_files").select("file").distinct().select(
        "file", text.layer(f).alias("layer"), text.extension(f).alias("ext"), text.dirname(f).alias("folder"), text.is_generated(f).alias("generated"))


@query
def scalar_left_out(spark, sf_dir):
    files = table(spark, sf_dir, "source_files").select("file", text.is_left_out(F.col("file"), F.col("head")).alias("out"))
    return files.groupBy("file").agg(F.bool_or("out").alias("left_out"))


@query
def lookup_without_paths(spark, sf_dir):
    return lookup.without_paths(index.symbols(spark, sf_dir), "/gen", "/internal").groupBy("package").agg(F.count(F.lit(1)).alias("symbols"))


@query
def scalar_query_terms(spark, sf_dir):
    q = index.query_texts(table(spark, sf_dir, "documents"), "doc_id", "text")
    j = lambda c: F.array_join(c, " ").alias(c)
    return q.select("query", j("idents"), j("words"), j("terms"), j("parts"))


@query
def scalar_document_idents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", F.explode(text.compound_idents(F.col("text"))).alias("ident")).groupBy("ident").agg(
        F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"))


# text search


@query
def fts_document_frequency(spark, sf_dir):
    return search.document_frequency(search.postings(index.symbols(spark, sf_dir)))


@query
def fts_or_search(spark, sf_dir):
    q = index.tasks(spark, sf_dir)
    most = q.select(F.max(search.fetch_limit())).first()[0] or 0
    return search.any_term(search.postings(index.symbols(spark, sf_dir)), q, search.fetch_limit(), most).select("query", "id", "pos")


@query
def fts_by_kind(spark, sf_dir):
    s = index.symbols(spark, sf_dir).filter(F.col("kind").isin("rpc", "service", "method"))
    return search.any_term(search.postings(s), index.tasks(spark, sf_dir), F.lit(20), 20).select("query", "id", "pos")


@query
def fts_design_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("doc_kind = 'design'")
    return search.any_term(search.document_postings(d), index.tasks(spark, sf_dir), F.lit(5), 5).select("query", F.col("seq").alias("doc_id"), "pos")


@query
def fts_scored(spark, sf_dir):
    q = index.tasks(spark, sf_dir)
    return retrieval.text_hits(q, index.symbols(spark, sf_dir)).select("query", "id", F.col("at").alias("place"), F.round("score", 6).alias("score"))


@query
def fts_bm25(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    words = d.select(F.col("doc_id").alias("id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("token"))
    counts = words.groupBy("token", "id").agg(F.count(F.lit(1)).alias("tf"))
    lengths = words.groupBy("id").agg(F.count(F.lit(1)).alias("words"))
    return search.bm25(counts, lengths, index.tasks(spark, sf_dir)).select("query", F.col("id").alias("doc_id"), "pos", "score")


# graph


@query
def graph_callers(spark, sf_dir):
    return graph.neighbours(index.edges(spark, sf_dir), index.symbols(spark, sf_dir), "calls", "callers")


@query
def graph_callees(spark, sf_dir):
    return graph.tiered_callees(index.edges(spark, sf_dir), index.symbols(spark, sf_dir)).select("id", "other")


@query
def graph_implementors(spark, sf_dir):
    return graph.neighbours(index.edges(spark, sf_dir), index.symbols(spark, sf_dir), "implements", "callers")


@query
def graph_callers_tiered(spark, sf_dir):
    return graph.tiered_callers(index.edges(spark, sf_dir), index.symbols(spark, sf_dir))


@query
def graph_flow(spark, sf_dir):
    return graph.flow(index.edges(spark, sf_dir), index.symbols(spark, sf_dir))


def _roots(s):
    """Starts of a traversal, a group each: all symbols."""
    return s.select(F.col("id").alias("query"), "id")


@query
def graph_expand_1(spark, sf_dir):
    s = index.symbols(spark, sf_dir)
    return graph.expand(_roots(s), index.edges(spark, sf_dir), s, 1).select("query", "id", "score", "hop")


@query
def graph_expand_2(spark, sf_dir):
    s = index.symbols(spark, sf_dir)
    return graph.expand(_roots(s), index.edges(spark, sf_dir), s, 2).select("query", "id", F.round("score", 6).alias("score"), "hop")


@query
def graph_viz_edges(spark, sf_dir):
    s = index.symbols(spark, sf_dir)
    return graph.viz_edges(_roots(s), index.edges(spark, sf_dir), s, 2)


@query
def graph_viz_dot(spark, sf_dir):
    s = index.symbols(spark, sf_dir)
    return graph.dot(graph.viz_edges(_roots(s), index.edges(spark, sf_dir), s, 1))


@query
def graph_link_rebuild(spark, sf_dir):
    return graph.relink(index.edges(spark, sf_dir), index.symbols(spark, sf_dir))


@query
def graph_degree(spark, sf_dir):
    return graph.degree(index.edges(spark, sf_dir))


@query
def graph_viz_callers(spark, sf_dir):
    s = index.symbols(spark, sf_dir)
    return graph.viz_towards(_roots(s), index.edges(spark, sf_dir), s, "callers", 2)


@query
def graph_viz_callees(spark, sf_dir):
    s = index.symbols(spark, sf_dir)
    return graph.viz_towards(_roots(s), index.edges(spark, sf_dir), s, "callees", 2)


# retrieval


def _short_tasks(spark, sf_dir):
    """Shortened ids in the part of tasks: each asks for one identifier."""
    ids = _short_ids(spark, sf_dir).select(F.xxhash64("query").alias("key"), F.col("query").alias("text"))
    return index.query_texts(ids, "key", "text")


@query
def query_classes(spark, sf_dir):
    """Tasks, documents and shortened ids by whether they ask for one identifier or for discovery."""
    texts = table(spark, sf_dir, "task_manifest").select(F.lit("task").alias("source"), F.col("prompt").alias("text"))
    texts = texts.unionByName(table(spark, sf_dir, "documents").select(F.lit("document").alias("source"), "text"))
    texts = texts.unionByName(_short_ids(spark, sf_dir).select(F.lit("id").alias("source"), F.col("query").alias("text"))).filter("text is not null")
    return texts.groupBy("source", F.when(text.is_precise(F.col("text")), "precise").otherwise("discovery").alias("class")).agg(F.count(F.lit(1)).alias("texts"))


@query
def context_precise(spark, sf_dir):
    """Candidates of tasks that are one identifier: exact hits alone."""
    q = _short_tasks(spark, sf_dir)
    found = retrieval.candidates(q, index.symbols(spark, sf_dir))
    return found.join(q.select("query", "prompt"), "query").select("prompt", "id", "score", "why")


@query
def context_vector(spark, sf_dir):
    """What the vectors of named symbols add to the exact hits of the design documents."""
    q = index.query_texts(table(spark, sf_dir, "documents").filter("doc_kind = 'design'"), "doc_id", "text")
    # texts are taken apart once, versions chosen once
    q = checkpointed(q.select("query", "idents", "words"))
    s = checkpointed(index.symbols(spark, sf_dir).select("seq", "id", "name", "kind", "package", "file", "embedding", "embedding_model"))
    return retrieval.vectors_add(q, s, digits=6).select("query", "id", "score")


def _context(spark, sf_dir, depth=1):
    return retrieval.context(index.tasks(spark, sf_dir), index.symbols(spark, sf_dir), index.edges(spark, sf_dir), depth)


@query
def context_candidates(spark, sf_dir):
    return retrieval.candidates(index.tasks(spark, sf_dir), index.symbols(spark, sf_dir)).select("query", "id", "score", "why")


@query
def context_discovery(spark, sf_dir):
    return retrieval.trimmed(_context(spark, sf_dir)).select("query", "rank", "id", "score", "used")


@query
def context_packages(spark, sf_dir):
    return retrieval.package_summary(retrieval.trimmed(_context(spark, sf_dir)))


@query
def context_trace(spark, sf_dir):
    full = checkpointed(_context(spark, sf_dir))
    return retrieval.trace(full, retrieval.trimmed(full))


@query
def context_text(spark, sf_dir):
    full = checkpointed(_context(spark, sf_dir))
    lines = index.symbols(spark, sf_dir).select("id", "line_start", "line_end")
    return retrieval.as_text(retrieval.trimmed(full).join(lines, "id"), full)


@query
def context_verbose(spark, sf_dir):
    """What the budget holds where documentation and reasons are given too."""
    return retrieval.trimmed(_context(spark, sf_dir), cost=sc.cost_verbose()).select("query", "rank", "id", "used")


def _ranked_files(spark, sf_dir):
    """Symbols of every folder scored by kind and place, the folder in the part of a task."""
    s = index.symbols(spark, sf_dir)
    score = F.round(sc.kind_weight(F.col("kind")) + sc.impl_boost(F.col("kind"), F.col("package")) + sc.generated_penalty(F.col("file")), 9)
    return s.select(F.col("package").alias("query"), "id", "kind", "file", "signature", score.alias("score"), F.lit("listed").alias("why"))


@query
def rank_source_first(spark, sf_dir):
    return retrieval.source_first(_ranked_files(spark, sf_dir)).select("query", "id", "rank", F.round("score", 6).alias("score"))


@query
def rank_budget_trim(spark, sf_dir):
    return retrieval.trimmed(retrieval.ranked(_ranked_files(spark, sf_dir)), 400).select("query", "id", "rank", "used")


@query
def dedup_generated(spark, sf_dir):
    rows = _ranked_files(spark, sf_dir).withColumn("query", F.substring_index("file", "/", 1))
    return retrieval.dedup_generated(rows).select("query", "id", "kind")


@query
def dedup_boilerplate(spark, sf_dir):
    rows = _ranked_files(spark, sf_dir).withColumn("query", F.substring_index("file", "/", 1))
    return retrieval.dedup_boilerplate(rows).select("query", "id", F.round("score", 6).alias("score"), "why")


@query
def package_summary(spark, sf_dir):
    rows = index.symbols(spark, sf_dir).select(F.substring_index("file", "/", 1).alias("query"), "file", "kind")
    return retrieval.package_summary(rows)


# vectors


@query
def vector_valid(spark, sf_dir):
    s = index.symbols(spark, sf_dir).select("embedding_model", F.coalesce(F.size("embedding"), F.lit(-1)).alias("length"), F.coalesce(vectors.valid("embedding"), F.lit(False)).alias("valid"))
    return s.groupBy("embedding_model", "length", "valid").agg(F.count(F.lit(1)).alias("symbols"))


@query
def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").withColumn("label", F.lit("all"))
    return vectors.nearest(e, e.filter("vec_id % 100 = 0")).select("query", "neighbour", "pos", F.round("sim", 6).alias("sim"))


@query
def vector_by_label(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return vectors.nearest(e, e.filter("vec_id % 100 = 0"), 5).select("query", "neighbour", "pos", F.round("sim", 6).alias("sim"))


@query
def vector_symbols(spark, sf_dir):
    """Ten most similar of the same model for every hundredth symbol, against all symbols."""
    s = index.symbols(spark, sf_dir).select("seq", "embedding", "embedding_model").filter(F.size("embedding") == 64)
    return vectors.nearest(s, s.filter("seq % 100 = 0"), 10, "seq", "embedding_model").select("query", "neighbour", "pos", F.round("sim", 6).alias("sim"))


@query
def vector_unembedded(spark, sf_dir):
    return maintenance.unembedded(index.symbols(spark, sf_dir), "loom-code-v2")


@query
def vector_embed_totals(spark, sf_dir):
    """A pass over all symbols without a vector of the model, by the stand-in service."""
    rows = maintenance.unembedded(index.symbols(spark, sf_dir), "loom-code-v2")
    return vector_io.totals(vector_io.embed_texts(rows, vector_io.hash_embedder()))


# reports


def _targets(s):
    """What a change may start from: all symbols but fields, which have impact_field."""
    return s.filter("kind <> 'field'")


@query
def impact_generic(spark, sf_dir):
    s = index.symbols(spark, sf_dir)
    return reports.impact(_targets(s), s, index.edges(spark, sf_dir)).select("target", "id", "branch")


@query
def impact_layers(spark, sf_dir):
    s = index.symbols(spark, sf_dir)
    found = reports.impact(_targets(s), s, index.edges(spark, sf_dir))
    return reports.impact_layers(found, s)


@query
def impact_generated_copies(spark, sf_dir):
    s = index.symbols(spark, sf_dir)
    found = reports.impact(_targets(s), s, index.edges(spark, sf_dir))
    return reports.dedup_layer_copies(found, s)


@query
def impact_field(spark, sf_dir):
    return reports.field_impact(index.symbols(spark, sf_dir))


@query
def pattern_slice(spark, sf_dir):
    return reports.pattern(index.symbols(spark, sf_dir))


@query
def simplest_topk(spark, sf_dir):
    return reports.simplest(index.symbols(spark, sf_dir), index.edges(spark, sf_dir))


@query
def unimplemented(spark, sf_dir):
    return reports.gaps(index.symbols(spark, sf_dir))


@query
def unimplemented_counts(spark, sf_dir):
    return reports.gap_counts(reports.gaps(index.symbols(spark, sf_dir)))


@query
def proto_declarations(spark, sf_dir):
    return reports.proto_declarations(table(spark, sf_dir, "source_files")).groupBy("file", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"))


# maintenance


@query
def dml_upsert_merge(spark, sf_dir):
    merged = maintenance.upsert(*maintenance.versions(table(spark, sf_dir, "symbols")))
    return merged.select("id", "seq", "kind", "line_start", "embedding_model", F.coalesce(F.size("embedding"), F.lit(-1)).alias("length"))


@query
def dml_edge_upsert(spark, sf_dir):
    return index.edges(spark, sf_dir)


@query
def dml_delete_by_file(spark, sf_dir):
    files = table(spark, sf_dir, "symbol_deletes").select("file").distinct()
    return maintenance.delete_files(current_rows(table(spark, sf_dir, "symbols")), index.edges(spark, sf_dir), files)[1]


@query
def dml_delete_packages(spark, sf_dir):
    packages = index.symbols(spark, sf_dir).filter(F.col("file").endswith(".proto")).select("package").distinct()
    return maintenance.delete_edges(index.edges(spark, sf_dir), "calls", packages=packages)


@query
def dml_delete_prefix(spark, sf_dir):
    packages = index.symbols(spark, sf_dir).filter(F.col("file").endswith(".proto")).select("package").distinct()
    return maintenance.delete_edges_below(index.edges(spark, sf_dir), "calls", packages)


@query
def dml_update_vectors(spark, sf_dir):
    base, changes = maintenance.versions(table(spark, sf_dir, "symbols"))
    merged = maintenance.update_vectors(base, changes.filter("embedding is not null"))
    return merged.select("id", "embedding_model", F.coalesce(F.size("embedding"), F.lit(-1)).alias("length"))


@query
def dml_delete_to_kind(spark, sf_dir):
    rpcs = index.symbols(spark, sf_dir).filter("kind = 'interface'")
    return maintenance.delete_edges(index.edges(spark, sf_dir), "implements", to_symbols=rpcs)


@query
def dml_stale_files(spark, sf_dir):
    read = table(spark, sf_dir, "read_events").select(text.plain_path(F.col("file")).alias("file")).distinct()
    return maintenance.stale_files(index.symbols(spark, sf_dir), read, ".go", ".ts", ".tsx", ".py")


@query
def dml_restore_vectors(spark, sf_dir):
    base, changes = maintenance.versions(table(spark, sf_dir, "symbols"))
    return maintenance.restorable(base, changes).select("id", "embedding_model", F.size("embedding").alias("length"))


@query
def dml_nearest_module(spark, sf_dir):
    files = table(spark, sf_dir, "source_files").select("file").distinct()
    heads = files.select(F.regexp_extract("file", r"^([^/]+(?:/(?:web|proto|pkg|core|internal))?)/", 1).alias("folder")).filter("folder <> ''").distinct()
    return maintenance.nearest_folder(files, heads)


# telemetry


@query
def policy_decisions(spark, sf_dir):
    return policy.decide(policy.once(table(spark, sf_dir, "read_events"))).select("event_no", "class", "lines", "proposed", "allowed", "overridden")


@query
def policy_stats(spark, sf_dir):
    return policy.decision_counts(policy.decide(policy.once(table(spark, sf_dir, "read_events"))))


@query
def policy_class_map(spark, sf_dir):
    return policy.class_map(policy.decide(policy.once(table(spark, sf_dir, "read_events"))))


@query
def session_stats(spark, sf_dir):
    return policy.session_counts(policy.once(table(spark, sf_dir, "session_telemetry")), "repo", "command")


@query
def session_rollup(spark, sf_dir):
    t = policy.once(table(spark, sf_dir, "session_telemetry")).withColumn("tool", F.lower(F.trim(F.coalesce("tool", F.lit("none")))))
    return t.rollup("tool", "command").agg(F.count(F.lit(1)).alias("calls"), F.grouping_id().alias("level"))


@query
def session_percentiles(spark, sf_dir):
    """Nearest-rank percentiles of response sizes per command."""
    t = policy.once(table(spark, sf_dir, "session_telemetry"))
    return policy.nearest_ranks(t, "command", "response_bytes", {"p50": 0.5, "p95": 0.95})


@query
def eval_recall_mrr(spark, sf_dir):
    return evaluation.recall_mrr(_ranks(spark, sf_dir)[0])


def _ranks(spark, sf_dir):
    """Ranks of each package's exported callables when listed source first, and when listed by name."""
    rows = _ranked_files(spark, sf_dir)
    targets = rows.filter(F.col("kind").isin("interface", "service")).select("query", F.col("id").alias("target"))
    by_name = retrieval.whole_ranks(rows, F.col("id"))
    return evaluation.first_ranks(retrieval.source_first(rows), targets), evaluation.first_ranks(by_name, targets)


@query
def eval_violations(spark, sf_dir):
    """Generated symbols are not to be among what a package's budget holds."""
    rows = _ranked_files(spark, sf_dir)
    return evaluation.violation_rate(retrieval.trimmed(retrieval.ranked(rows), 400), rows.filter(text.is_generated(F.col("file"))))


@query
def eval_averages(spark, sf_dir):
    return evaluation.averages(retrieval.trimmed(retrieval.ranked(_ranked_files(spark, sf_dir)), 400))


@query
def eval_rank_delta(spark, sf_dir):
    return evaluation.rank_delta(*_ranks(spark, sf_dir))


# streams


@query
def stream_policy(spark, sf_dir):
    return streams.drain(streams.decisions(streams.source(spark, sf_dir, "read_events")), "policy")


@query
def stream_tumbling(spark, sf_dir):
    return streams.drain(streams.tumbling(streams.closed(streams.source(spark, sf_dir, "session_telemetry"), "recorded_at")), "tumbling")


@query
def stream_debounce(spark, sf_dir):
    return streams.drain(streams.debounced(streams.closed(streams.source(spark, sf_dir, "read_events"), "recorded_at")), "debounce")


@query
def stream_relink(spark, sf_dir):
    return streams.relinked(streams.source(spark, sf_dir, "symbols"), index.edges(spark, sf_dir), shared_folder(spark, "relink"))


@query
def stream_dedup(spark, sf_dir):
    return streams.drain(streams.deduplicated(streams.source(spark, sf_dir, "read_events")).select("event_no", "file"), "dedup")
