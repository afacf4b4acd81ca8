"""The registered queries of the core in SQL, for comparison with the Spark plans."""

from __future__ import annotations

# Fixed values, stated here once more so that a slip in the library shows.
_STOP = "'a', 'an', 'the', 'to', 'for', 'in', 'on', 'of', 'and', 'or', 'is', 'it', 'add', 'make', 'how', 'do', 'i', 'we', 'my'"
_KEYWORDS = ("'Break', 'Case', 'Chan', 'Const', 'Continue', 'Default', 'Defer', 'Else', 'Fallthrough', 'For', 'Func', 'Go', 'Goto', 'If', "
             "'Import', 'Interface', 'Map', 'Package', 'Range', 'Return', 'Select', 'Struct', 'Switch', 'Type', 'Var'")
_SOURCE = "'.go', '.ts', '.tsx', '.js', '.jsx', '.proto', '.rs', '.py', '.java', '.c', '.cc', '.cpp', '.h', '.hpp', '.cs', '.rb', '.swift', '.kt'"


def _ordered(expr: str) -> str:
    """Distinct items of a list in order of their first place."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


BASE = """
WITH cur AS (SELECT seq, id, package, name, kind, signature, coalesce(docstring, '') AS docstring, file, line_start, line_end, body,
                    embedding, embedding_model, indexed_at
             FROM symbols QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
gone AS (SELECT id, max(deleted_at) AS deleted_at FROM symbol_deletes GROUP BY id),
sym AS (SELECT cur.* FROM cur LEFT JOIN gone USING (id) WHERE gone.deleted_at IS NULL OR gone.deleted_at < cur.indexed_at),
edg AS (SELECT DISTINCT from_id, to_id, kind FROM edges WHERE from_id <> '' AND to_id <> ''),
live AS (SELECT * FROM edg WHERE from_id IN (SELECT id FROM sym) AND to_id IN (SELECT id FROM sym)),
calls AS (SELECT from_id, to_id FROM live WHERE kind = 'calls'),
impl AS (SELECT from_id, to_id FROM live WHERE kind = 'implements')
"""

_WORDS = "list_filter(str_split_regex(prompt, '\\s+'), lambda w: w <> '')"
_TRIM = r"regexp_replace({w}, '^[^A-Za-z0-9_.]+|[^A-Za-z0-9_.]+$', '', 'g')"
_COMPOUND = "(strlen({w}) >= 3 AND (regexp_matches({w}, '[A-Za-z0-9]_[A-Za-z0-9]') OR regexp_matches({w}, '[a-z][A-Z]')))"
_T = f"list_transform({_WORDS}, lambda v: {_TRIM.format(w='v')})"
_LAST = r"regexp_extract({w}, '\.([^.]+)$', 1)"
_IDENTS = f"""list_filter(flatten(list_transform({_T}, lambda v: [CASE WHEN {_COMPOUND.format(w='v')} THEN v END,
  CASE WHEN length({_LAST.format(w='v')}) >= 2 AND (regexp_matches({_LAST.format(w='v')}, '^[A-Z]') OR contains({_LAST.format(w='v')}, '_'))
       THEN {_LAST.format(w='v')} END])), lambda z: z IS NOT NULL)"""
_DECOMPOSE = r"lower(ltrim(regexp_replace({w}, '([A-Z])', ' \1', 'g')))"
_PARTS = f"flatten(list_transform(list_filter({_WORDS}, lambda w: {_COMPOUND.format(w='w')}), lambda w: str_split_regex({_DECOMPOSE.format(w='w')}, '\\s+')))"
_TERMS = f"list_filter(str_split_regex(lower(regexp_replace(prompt, '[^A-Za-z0-9]', ' ', 'g')), ' +'), lambda w: w <> '' AND w NOT IN ({_STOP}))"

TASKS = f"""
, raw AS (SELECT item_id AS query, prompt, {_IDENTS} AS idents0, list_filter({_T}, lambda w: strlen(w) >= 3) AS words, {_TERMS} AS terms0, {_PARTS} AS parts0
          FROM task_manifest WHERE prompt IS NOT NULL),
tasks AS (SELECT query, prompt, words, {_ordered('idents0')} AS idents, {_ordered('terms0')} AS terms, {_ordered('parts0')} AS parts FROM raw)
"""

_KW = ("CASE kind WHEN 'method' THEN 0.3::DOUBLE WHEN 'func' THEN 0.2::DOUBLE WHEN 'interface' THEN 0.1::DOUBLE WHEN 'struct' THEN -0.3::DOUBLE WHEN 'type' THEN -0.2::DOUBLE "
       "WHEN 'const' THEN -0.2::DOUBLE WHEN 'var' THEN -0.2::DOUBLE WHEN 'field' THEN -0.6::DOUBLE ELSE 0::DOUBLE END")
_IMPL = "CASE WHEN kind IN ('func', 'method') AND regexp_matches(lower(package), 'svc|server|service') THEN 0.5::DOUBLE ELSE 0::DOUBLE END"
_PEN = "CASE WHEN file LIKE '%.pb.go' OR file LIKE '%.pb.gw.go' THEN -0.6::DOUBLE ELSE 0::DOUBLE END"
_GEN = "(file LIKE '%.pb.go' OR file LIKE '%.pb.gw.go' OR contains(file, '/gen/'))"
_DIR = "CASE WHEN contains(file, '/') THEN regexp_extract(file, '^(.*)/[^/]*$', 1) ELSE '.' END"
_EXT = r"regexp_extract({f}, '(\.[^./]*)$', 1)"
_LASTNAME = "split_part(id, '.', -1)"
_PARENT = r"regexp_extract(id, '^(.*)\.[^.]*$', 1)"

_POSTINGS = r"""
, post AS (SELECT DISTINCT seq, id, unnest(regexp_extract_all(lower(name || ' ' || """ + _DECOMPOSE.format(w="name") + r""" || ' ' || signature || ' ' || docstring), '[\p{L}\p{N}]+')) AS token FROM {src})
"""
_HITS = """
, asked AS (SELECT query, {limit} AS lim, unnest(terms) AS token FROM tasks),
found AS (SELECT DISTINCT query, lim, seq, id FROM post JOIN asked USING (token)),
hits AS (SELECT query, seq, id, row_number() OVER (PARTITION BY query ORDER BY seq, id) AS pos, lim FROM found QUALIFY pos <= lim)
"""
_FETCH = "(30 + 10 * len(terms)) * 3"
_SCORED = f"""
, full_hits AS (SELECT h.query, h.pos AS hit, s.*, {_GEN} AS generated FROM hits h JOIN sym s ON s.id = h.id),
capped AS (SELECT *, row_number() OVER (PARTITION BY query, generated ORDER BY hit) AS place, sum(CASE WHEN generated THEN 0 ELSE 1 END) OVER (PARTITION BY query) AS sources FROM full_hits),
kept_hits AS (SELECT * FROM capped WHERE NOT generated OR sources = 0 OR place <= 5),
placed AS (SELECT *, count(*) OVER (PARTITION BY query) AS n, row_number() OVER (PARTITION BY query ORDER BY generated, hit) - 1 AS ord,
                  count(*) OVER (PARTITION BY query, lower(name)) AS same_name FROM kept_hits),
withterms AS (SELECT p.*, list_concat(t.terms, t.parts) AS scoring,
                     lower(concat_ws(' ', name, {_DECOMPOSE.format(w='name')}, package, signature, docstring)) AS hay FROM placed p JOIN tasks t USING (query)),
matched AS (SELECT *, len(list_filter(scoring, lambda t: contains(hay, t)))::DOUBLE AS m FROM withterms),
textual AS (SELECT query, id, ord, (n - ord)::DOUBLE / n
        + CASE WHEN same_name < 3 AND list_contains(scoring, lower(name)) THEN CASE WHEN kind IN ('func', 'method') THEN 1.0::DOUBLE WHEN kind = 'interface' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END ELSE 0::DOUBLE END
        + CASE WHEN len(scoring) <= 1 OR m <= 1 THEN 0::DOUBLE ELSE (m / len(scoring)) * (m / len(scoring)) * 1.5::DOUBLE END
        + {_KW} + {_IMPL} + {_PEN} AS score FROM matched)
"""
_EXACT = f"""
, idents AS (SELECT query, words, unnest(idents) AS ident FROM tasks),
top_names AS (SELECT * FROM sym QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq) <= 10),
needles AS (SELECT DISTINCT ident AS needle FROM idents WHERE strlen(ident) >= 10),
inside AS (SELECT needle, s.* FROM sym s JOIN needles ON contains(lower(name), lower(needle)) AND name <> needle
           QUALIFY row_number() OVER (PARTITION BY needle ORDER BY length(name), id) <= 25),
named AS (SELECT query, id, 3.0::DOUBLE + CASE WHEN kind = 'field' THEN 0::DOUBLE ELSE {_KW} END + {_IMPL} + {_PEN} AS base, words, ident, 'exact name match' AS why, 0 AS phase
          FROM top_names JOIN idents ON name = ident
          UNION ALL SELECT query, id, 2.0::DOUBLE + {_KW} + {_PEN}, words, ident, 'name contains ' || ident, 1 FROM inside JOIN idents ON needle = ident),
exacts AS (SELECT query, id, why, phase, base + 0.75::DOUBLE * len(list_filter(words, lambda w: lower(w) <> lower(ident) AND CASE WHEN contains(w, '.') THEN contains(lower(id), lower(w))
                  ELSE list_contains(str_split_regex(lower(id), '[./]'), lower(w)) END)) AS score FROM named
           QUALIFY row_number() OVER (PARTITION BY query, id ORDER BY phase, score DESC, why) = 1),
cand AS (SELECT query, id, round(score, 9) AS score, why FROM (SELECT query, id, score, why, phase FROM exacts UNION ALL SELECT query, id, score, 'semantic match', 2 FROM textual)
         QUALIFY row_number() OVER (PARTITION BY query, id ORDER BY phase) = 1)
"""
_DEDUP = """
, gen_once AS (SELECT * FROM (SELECT *, contains(file, '/gen/') AS in_gen FROM {src})
               QUALIFY NOT in_gen OR row_number() OVER (PARTITION BY query, """ + _LASTNAME + """, kind, in_gen ORDER BY contains(file, 'backend') DESC, score DESC, id) = 1)
"""
_BOILER = f"""
, grouped AS (SELECT *, count(*) OVER (PARTITION BY query, {_LASTNAME}) AS n, row_number() OVER (PARTITION BY query, {_LASTNAME} ORDER BY score DESC, id) AS r FROM {{src}}),
boiled AS (SELECT * EXCLUDE (n, r) REPLACE (CASE WHEN n >= 3 THEN why || ' (+' || (n - 1) || ' similar ' || {_LASTNAME} || ' omitted)' ELSE why END AS why,
                  CASE WHEN n >= 3 THEN round(score - (n - 2) * 0.15::DOUBLE, 9) ELSE score END AS score) FROM grouped WHERE n < 3 OR r = 1)
"""
_RANK = f"""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ({_GEN} AND NOT (starts_with(why, 'name contains ') OR starts_with(why, 'exact name match'))), score DESC, id) AS rank FROM {{src}})
"""
_COST = "((strlen(id) + strlen(kind) + strlen(signature) + strlen(file) + 20) // 4)"
_TRIMMED = f"""
, costed AS (SELECT *, sum({_COST}) OVER (PARTITION BY query ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM ranked),
trimmed AS (SELECT * FROM costed WHERE used <= {{budget}})
"""
_CONTEXT = (
    BASE + TASKS + _POSTINGS.replace("{src}", "sym") + _HITS.format(limit=_FETCH) + _SCORED + _EXACT
    + ", scored AS (SELECT c.query, c.id, c.score, c.why, s.kind, s.file FROM cand c JOIN sym s USING (id))"
    + _DEDUP.format(src="scored") + _BOILER.format(src="gen_once")
    + """, near AS (SELECT b.query, c.from_id AS id, 0.4::DOUBLE AS score FROM boiled b JOIN calls c ON c.to_id = b.id
                    UNION ALL SELECT b.query, c.to_id, 0.3::DOUBLE FROM boiled b JOIN calls c ON c.from_id = b.id),
         fresh AS (SELECT query, id, max(score) AS score FROM near GROUP BY query, id),
         grown AS (SELECT query, id, score, why FROM boiled UNION ALL
                   SELECT f.query, f.id, f.score, CASE WHEN f.score > 0.35 THEN 'caller at hop 1' ELSE 'callee at hop 1' END FROM fresh f
                   LEFT JOIN boiled b ON b.query = f.query AND b.id = f.id WHERE b.id IS NULL),
         whole AS (SELECT g.*, s.kind, s.file, s.signature FROM grown g JOIN sym s USING (id))"""
    + _RANK.format(src="whole"))
_LISTED = f", listed AS (SELECT package, {{query}} AS query, id, kind, file, signature, round({_KW} + {_IMPL} + {_PEN}, 9) AS score, 'listed' AS why FROM sym)"
_PACKAGES = f"""
, kinds AS (SELECT query, {_DIR} AS folder, kind, count(*) AS n FROM {{src}} GROUP BY ALL),
folders AS (SELECT query, folder, sum(n)::BIGINT AS symbols, array_to_string(list_sort(list(CASE WHEN n > 1 THEN n || ' ' || kind || 's' ELSE kind END)), ', ') AS kinds FROM kinds GROUP BY ALL)
SELECT query, folder, symbols, kinds FROM folders QUALIFY count(*) OVER (PARTITION BY query) > 1
"""
_CALL_IDENTS = r"list_filter(regexp_extract_all(body, '([A-Za-z0-9_]+)[ \t]*\(', 1), lambda x: regexp_matches(x, '^[A-Z]'))"
_TYPE_IDENTS = r"list_filter(regexp_extract_all(regexp_replace(body, '[^A-Za-z0-9_]+', ' ', 'g'), '[A-Za-z0-9_]+'), lambda x: regexp_matches(x, '^[A-Z][A-Za-z0-9_]{2,}$') AND regexp_matches(x, '[a-z]') AND x NOT IN (" + _KEYWORDS + "))"
_CODE = f", code AS (SELECT DISTINCT id, seq, unnest({_CALL_IDENTS}) AS name FROM sym WHERE kind IN ('func', 'method')), top_names AS (SELECT id, name, seq FROM sym QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq) <= 10)"
_BODY_CALLERS = r", called AS (SELECT DISTINCT id, unnest(regexp_extract_all(body, '([A-Za-z0-9_]+)[ \t]*\(', 1)) AS name FROM sym WHERE kind IN ('func', 'method')), bodycall AS (SELECT DISTINCT n.id, c.id AS other FROM called c JOIN sym n USING (name) WHERE n.id <> c.id)"
_REQ = r"trim(regexp_extract(signature, '\(([^)]*)\)', 1))"
_RESP = r"trim(regexp_extract(signature, 'returns[^(]*\(([^)]*)\)', 1))"
_LAYER = f"CASE WHEN file LIKE '%.proto' THEN 'proto' WHEN {_GEN} THEN 'generated' WHEN file LIKE '%\\_test.go' ESCAPE '\\' THEN 'test' ELSE 'implementation' END"

_IMPACT = _CODE.replace("top_names AS (SELECT id, name, seq", "names AS (SELECT id, name") + f"""
, t AS (SELECT id AS target, name AS tname, kind AS tkind, signature FROM sym WHERE kind <> 'field'),
b14 AS (SELECT target, n.id, 1 AS branch FROM t JOIN names n ON n.name = tname
        UNION ALL SELECT target, n.id, 2 FROM (SELECT target, unnest([{_REQ}, {_RESP}]) AS m FROM t WHERE tkind = 'rpc') JOIN names n ON n.name = m WHERE m <> ''
        UNION ALL SELECT target, to_id, 3 FROM t JOIN impl ON from_id = target
        UNION ALL SELECT target, from_id, 4 FROM t JOIN impl ON to_id = target WHERE tkind IN ('interface', 'rpc', 'service')),
near14 AS (SELECT target, id, min(branch) AS branch FROM b14 WHERE id <> target GROUP BY ALL),
seeds AS (SELECT target, id AS seed FROM near14 JOIN (SELECT id, kind, file FROM sym) USING (id) WHERE NOT {_GEN} AND kind NOT IN ('rpc', 'message', 'service', 'enum')
          UNION ALL SELECT target, target FROM t),
b5 AS (SELECT DISTINCT target, from_id AS id, 5 AS branch FROM seeds JOIN calls ON to_id = seed),
bodies AS (SELECT c.id, c.name FROM code c WHERE c.name IN (SELECT tname FROM t) QUALIFY row_number() OVER (PARTITION BY c.name ORDER BY c.seq, c.id) <= 15),
found AS (SELECT target, id, min(branch) AS branch FROM (SELECT * FROM near14 UNION ALL SELECT * FROM b5 UNION ALL SELECT target, bodies.id, 6 FROM t JOIN bodies ON bodies.name = tname)
          WHERE id <> target GROUP BY ALL)
"""
_EXPAND1 = """, seeds AS (SELECT id AS query, id FROM sym),
n1 AS (SELECT query, c.from_id AS id, 0.4::DOUBLE AS score FROM seeds s JOIN calls c ON c.to_id = s.id UNION ALL SELECT query, c.to_id, 0.3::DOUBLE FROM seeds s JOIN calls c ON c.from_id = s.id),
h1 AS (SELECT query, id, max(score) AS score, 1 AS hop FROM n1 WHERE query <> id GROUP BY query, id)
"""
_EXPAND2 = _EXPAND1 + """, n2 AS (SELECT query, c.from_id AS id, 0.2::DOUBLE AS score FROM h1 s JOIN calls c ON c.to_id = s.id UNION ALL SELECT query, c.to_id, 0.15::DOUBLE FROM h1 s JOIN calls c ON c.from_id = s.id),
h2 AS (SELECT n2.query, n2.id, max(n2.score) AS score, 2 AS hop FROM n2 LEFT JOIN h1 ON h1.query = n2.query AND h1.id = n2.id WHERE h1.id IS NULL AND n2.query <> n2.id GROUP BY ALL)
"""
_DECIDE = f"""
WITH ev AS (SELECT DISTINCT ON (event_no) * FROM read_events),
a AS (SELECT *, lower(file) AS low, lower(coalesce(command_source, '')) AS cmd, lower(coalesce(file_type, '')) AS ft, coalesce(start_line > 0 AND end_line >= start_line, false) AS ranged FROM ev),
b AS (SELECT *, CASE WHEN regexp_matches(cmd, 'hook|mcp') THEN 'exempt' WHEN regexp_matches(low, '/generated/|/gen/|\\.pb\\.go$|_generated\\.go$') THEN 'generated'
     WHEN NOT (ft NOT IN ('binary', 'asset') AND ({_EXT.format(f='low')} IN ({_SOURCE}) OR ft = 'source')) THEN 'non-source' WHEN ranged THEN 'targeted-source' ELSE 'whole-source' END AS class,
     CASE WHEN ranged THEN end_line - start_line + 1 ELSE coalesce(file_lines, 0) END AS lines FROM a),
c AS (SELECT *, CASE WHEN class = 'targeted-source' AND lines > 200 OR class = 'whole-source' AND lines > 350 THEN 'block' ELSE 'allow' END AS proposed FROM b),
d AS (SELECT event_no, class, lines, proposed, proposed = 'allow' OR coalesce("override", false) AS allowed, coalesce("override", false) AND proposed = 'block' AS overridden FROM c)
"""
_ORPHANS = """
WITH refs AS (SELECT edge_no, 'from_id' AS side, from_id AS id, indexed_at AS ts FROM edges
              UNION ALL SELECT edge_no, 'to_id', to_id, indexed_at FROM edges),
ev AS (SELECT id, indexed_at AS ts, 1 AS live FROM symbols UNION ALL SELECT id, deleted_at, 0 FROM symbol_deletes),
state AS (SELECT r.edge_no, r.side, r.id, r.ts, max_by(ev.live, (epoch_us(ev.ts), ev.live)) AS live
          FROM refs r LEFT JOIN ev ON ev.id = r.id AND ev.ts <= r.ts
          WHERE r.id IS NOT NULL AND r.id <> '' AND r.id NOT IN (SELECT id FROM dep_symbols)
          GROUP BY ALL),
found AS (SELECT *, CASE WHEN live = 0 THEN 'deleted' WHEN id IN (SELECT id FROM symbols) THEN 'late' ELSE 'missing' END AS reason
          FROM state WHERE live IS NULL OR live = 0)
"""
_VERSIONS = """
WITH log AS (SELECT DISTINCT ON (seq) * FROM symbols), span AS (SELECT id, min(seq) AS lo, max(seq) AS hi FROM log GROUP BY id),
base AS (SELECT log.* FROM log JOIN span ON log.id = span.id AND seq = lo), chg AS (SELECT log.* FROM log JOIN span ON log.id = span.id AND seq = hi WHERE lo < hi)
"""
_TOPK = """
WITH v AS (SELECT {key} AS k, {group} AS g, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM {src}
           WHERE embedding IS NOT NULL AND len(embedding) {length} AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.k AS query, b.k AS neighbour, list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))
        / (sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x)))) AS sim
      FROM v a JOIN v b ON a.g = b.g AND a.k <> b.k AND a.k % 100 = 0)
SELECT query, neighbour, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, neighbour) AS pos, round(sim, 6) AS sim FROM s QUALIFY pos <= {n}
"""
_RANKS = BASE + _LISTED.format(query="package") + _RANK.format(src="listed") + """
, by_name AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY id) AS place FROM listed),
want AS (SELECT query, id AS target FROM listed WHERE kind IN ('interface', 'service')),
ra AS (SELECT want.query, target, min(rank) AS rank FROM want JOIN ranked ON ranked.query = want.query AND ranked.id = target GROUP BY ALL),
rb AS (SELECT want.query, target, min(place) AS rank FROM want JOIN by_name ON by_name.query = want.query AND by_name.id = target GROUP BY ALL)
"""
_BEST = "(CASE WHEN contains(lower(package), '/gen/') OR contains(lower(package), 'unimplemented') THEN -2.0 ELSE 0.0 END + CASE WHEN package <> '' AND contains(lower(query), lower(package)) THEN strlen(package)::DOUBLE ELSE 0.0 END + CASE WHEN regexp_matches(lower(package), 'svc|server|service') THEN 1.0 ELSE 0.0 END)"
_ONCE = "WITH t AS (SELECT DISTINCT ON (event_no) * FROM session_telemetry)"

SQL = {
    "p2_found": _ORPHANS + "SELECT edge_no, side FROM found",
    "p2_orphans_by_month": _ORPHANS + "SELECT side, strftime(ts AT TIME ZONE 'UTC', '%Y-%m') AS month, reason, count(*) AS ends, count(DISTINCT id) AS ids FROM found GROUP BY ALL",
    "lookup_exact": BASE + "SELECT id, kind, file, line_start, line_end FROM sym WHERE id IN (SELECT to_id FROM edg)",
    "lookup_by_name_top10": BASE + "SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY seq) AS pos FROM sym QUALIFY pos <= 10",
    "lookup_by_name_kind": BASE + "SELECT name, kind, count(*) AS symbols, min(id) AS first_id FROM sym GROUP BY ALL",
    "lookup_by_kind": BASE + "SELECT id, name, package, file FROM sym WHERE kind = 'service'",
    "lookup_by_file": BASE + "SELECT file, row_number() OVER (PARTITION BY file ORDER BY line_start, seq) AS pos, id, line_start FROM sym",
    "lookup_ext_files": BASE + f"SELECT DISTINCT file FROM sym WHERE lower({_EXT.format(f='file')}) IN ('.ts', '.tsx')",
    "lookup_children_prefix": BASE + f"SELECT p.id AS parent, p.kind AS parent_kind, c.id, c.kind FROM sym c JOIN sym p ON p.id = {_PARENT.replace('id,', 'c.id,')} WHERE c.kind IN ('rpc', 'field', 'method')",
    "lookup_name_contains": BASE + """, needles AS (SELECT DISTINCT needle FROM (SELECT regexp_extract(name, '^[A-Z][a-z]+([A-Z].*)$', 1) AS needle FROM sym WHERE kind IN ('func', 'method')) WHERE needle <> '')
        SELECT needle, id, row_number() OVER (PARTITION BY needle ORDER BY length(name), id) AS pos FROM sym JOIN needles ON contains(lower(name), lower(needle)) AND name <> needle QUALIFY pos <= 25""",
    "lookup_fuzzy_tiered": BASE + rf""", q AS (SELECT DISTINCT regexp_extract(split_part(id, '/', -1), '([^.]+\.[^.]+)$', 1) AS query FROM (SELECT from_id AS id FROM edg UNION SELECT to_id FROM edg)),
        every AS (SELECT query, id, 1 AS tier, 0.0 AS score, seq FROM q JOIN sym ON id = query
            UNION ALL SELECT query, id, 2, length(id)::DOUBLE, seq FROM q JOIN sym ON lower({_LASTNAME}) = lower(split_part(query, '.', -1)) AND ends_with(lower(id), lower(query))
            UNION ALL SELECT query, id, 3, -greatest({_BEST}, -1.0), seq FROM q JOIN sym ON lower({_LASTNAME}) = lower(split_part(query, '.', -1)) AND name = split_part(query, '.', -1))
        SELECT query, id, tier FROM every WHERE query <> '' QUALIFY row_number() OVER (PARTITION BY query ORDER BY tier, score, seq, id) = 1""",
    "lookup_best_candidate": BASE + f""", q AS (SELECT *, 'gen.' || name AS query FROM sym)
        SELECT query, id, greatest({_BEST}, -1.0) AS score FROM q QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, seq) = 1""",
    "lookup_elided": BASE + f"SELECT id, CASE WHEN starts_with(id, 'kestrel.example/') THEN id[17:] ELSE id END AS short_id, {_DIR} AS folder FROM sym",
    "body_contains": BASE + "SELECT id, seq FROM sym WHERE kind IN ('func', 'method') AND body ILIKE '%context%'",
    "body_callers": BASE + _BODY_CALLERS + "SELECT id, other FROM bodycall",
    "body_call_idents": BASE + f"SELECT DISTINCT id, unnest({_CALL_IDENTS}) AS ident FROM sym",
    "body_type_idents": BASE + f"SELECT DISTINCT id, unnest({_TYPE_IDENTS}) AS ident FROM sym",
    "body_first_lines": BASE + "SELECT id, array_to_string(string_split(body, chr(10))[1:3], chr(10)) AS lines, body = '' OR starts_with(body, '/*') AS reference, len(string_split(body, chr(10))) AS n_lines, strlen(body) // 4 AS tokens FROM sym",
    "scalar_names": BASE + f"SELECT id, {_DECOMPOSE.format(w='name')} AS words, {_COMPOUND.format(w='name')} AS compound, array_to_string(list_transform(list_filter(string_split(name, '_'), lambda p: p <> ''), lambda p: upper(p[1:1]) || p[2:]), '') AS go_name, {_LASTNAME} AS last_name FROM sym",
    "scalar_rpc_messages": BASE + f"SELECT id, {_REQ} AS request, {_RESP} AS response FROM sym WHERE kind = 'rpc'",
    "scalar_layers": f"SELECT DISTINCT file, {_LAYER} AS layer, {_EXT.format(f='file')} AS ext, {_DIR} AS folder, {_GEN} AS generated FROM source_files",
    "scalar_query_terms": "WITH " + TASKS.lstrip()[1:].replace("SELECT item_id AS query, prompt,", "SELECT doc_id AS query, prompt,").replace("FROM task_manifest WHERE", "FROM (SELECT doc_id, text AS prompt FROM documents) WHERE") + "SELECT query, array_to_string(idents, ' ') AS idents, array_to_string(words, ' ') AS words, array_to_string(terms, ' ') AS terms, array_to_string(parts, ' ') AS parts FROM tasks",
    "fts_document_frequency": BASE + _POSTINGS.replace("{src}", "sym") + "SELECT token, count(*) AS records, min(seq) AS first_seq FROM post GROUP BY token",
    "fts_or_search": BASE + TASKS + _POSTINGS.replace("{src}", "sym") + _HITS.format(limit=_FETCH) + "SELECT query, id, pos FROM hits",
    "fts_by_kind": BASE + TASKS + ", picked AS (SELECT * FROM sym WHERE kind IN ('rpc', 'service', 'method'))" + _POSTINGS.replace("{src}", "picked") + _HITS.format(limit="20") + "SELECT query, id, pos FROM hits",
    "fts_design_documents": BASE + TASKS + r", post AS (SELECT DISTINCT doc_id AS seq, doc_id::VARCHAR AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents WHERE doc_kind = 'design' AND text IS NOT NULL)"
        + _HITS.format(limit="5") + "SELECT query, seq AS doc_id, pos FROM hits",
    "fts_scored": BASE + TASKS + _POSTINGS.replace("{src}", "sym") + _HITS.format(limit=_FETCH) + _SCORED + "SELECT query, id, ord AS place, round(score, 6) AS score FROM textual",
    "fts_bm25": BASE + TASKS + r"""
, words AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents WHERE text IS NOT NULL),
tf AS (SELECT token, id, count(*) AS tf FROM words GROUP BY ALL), lens AS (SELECT id, count(*) AS words FROM words GROUP BY ALL), stat AS (SELECT count(*)::DOUBLE AS n, avg(words) AS avg FROM lens),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY ALL), asked AS (SELECT query, unnest(terms) AS token FROM tasks),
sc AS (SELECT query, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * words / avg))), 6) AS score FROM tf JOIN df USING (token) JOIN asked USING (token) JOIN lens USING (id), stat GROUP BY ALL)
SELECT query, id AS doc_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS pos, score FROM sc QUALIFY pos <= 10""",
    "graph_callers": BASE + "SELECT to_id AS id, from_id AS other FROM calls",
    "graph_callees": BASE + _CODE.replace(" WHERE kind IN ('func', 'method')", "") + """SELECT from_id AS id, to_id AS other FROM calls
        UNION ALL SELECT DISTINCT c.id, n.id FROM code c JOIN top_names n USING (name) WHERE c.id <> n.id AND c.id NOT IN (SELECT from_id FROM calls)""",
    "graph_implementors": BASE + "SELECT to_id AS id, from_id AS other FROM impl",
    "graph_callers_tiered": BASE + _BODY_CALLERS + """, linked AS (SELECT to_id AS id, from_id AS other, 1 AS tier, 'direct caller' AS why FROM calls
        UNION ALL SELECT from_id, to_id, 2, CASE WHEN s.kind = 'rpc' THEN 'gRPC entry point: ' || s.signature ELSE 'implements interface' END FROM impl JOIN sym s ON s.id = to_id),
        left_ AS (SELECT id, lower(name) AS low, name FROM sym WHERE id NOT IN (SELECT id FROM linked)),
        rest AS (SELECT * FROM left_ WHERE strlen(name) >= 6 AND id NOT IN (SELECT id FROM bodycall)),
        holds AS (SELECT low, c.id AS other FROM (SELECT DISTINCT low FROM rest) JOIN (SELECT id, seq, lower(body) AS text FROM sym WHERE kind IN ('func', 'method')) c ON contains(text, low)
                  QUALIFY row_number() OVER (PARTITION BY low ORDER BY seq, c.id) <= 15)
        SELECT * FROM linked QUALIFY tier = min(tier) OVER (PARTITION BY id)
        UNION ALL SELECT id, other, 3, 'body reference (heuristic)' FROM bodycall WHERE id IN (SELECT id FROM left_)
        UNION ALL SELECT id, other, 4, 'body reference (non-call)' FROM rest JOIN holds USING (low) WHERE id <> other""",
    "graph_flow": BASE + "SELECT to_id AS id, 'caller' AS role, from_id AS other FROM calls UNION ALL SELECT from_id, 'callee', to_id FROM calls",
    "graph_expand_1": BASE + _EXPAND1 + "SELECT query, id, score, hop FROM h1",
    "graph_expand_2": BASE + _EXPAND2 + "SELECT query, id, round(score, 6) AS score, hop FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2)",
    "graph_viz_edges": BASE + _EXPAND1 + ", visited AS (SELECT query, id FROM seeds UNION SELECT query, id FROM h1) SELECT DISTINCT query AS root, from_id, to_id FROM visited JOIN calls ON id = from_id OR id = to_id",
    "graph_viz_dot": BASE + """, v AS (SELECT DISTINCT s.id AS root, from_id, to_id FROM sym s JOIN calls ON s.id = from_id OR s.id = to_id),
        nodes AS (SELECT root, id, row_number() OVER (PARTITION BY root ORDER BY id) - 1 AS no FROM (SELECT root, from_id AS id FROM v UNION SELECT root, to_id FROM v)),
        nt AS (SELECT root, count(*) AS nodes, string_agg('n' || no || ' [label="' || split_part(id, '/', -1) || '"];', chr(10) ORDER BY no) AS t FROM nodes GROUP BY root),
        et AS (SELECT v.root, count(*) AS edges, string_agg('n' || a.no || ' -> n' || b.no || ';', chr(10) ORDER BY a.no, b.no) AS t FROM v JOIN nodes a ON a.root = v.root AND a.id = from_id JOIN nodes b ON b.root = v.root AND b.id = to_id GROUP BY v.root)
        SELECT nt.root, nodes, edges, 'digraph {' || chr(10) || nt.t || chr(10) || et.t || chr(10) || '}' AS dot FROM nt JOIN et USING (root)""",
    "graph_link_rebuild": BASE + f""", links AS (SELECT m.id AS from_id, r.id AS to_id FROM sym r JOIN (SELECT * FROM sym WHERE kind = 'method' AND NOT {_GEN}) m USING (name) WHERE r.kind = 'rpc'
        QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY contains(m.package, 'svc') DESC, m.seq) = 1)
        SELECT from_id, to_id, kind FROM edg WHERE NOT (kind = 'implements' AND to_id IN (SELECT id FROM sym WHERE kind = 'rpc')) UNION SELECT from_id, to_id, 'implements' FROM links""",
    "graph_degree": BASE + "SELECT kind, sum(n)::BIGINT AS edges, count(*) AS to_ids, max(n) AS most FROM (SELECT kind, to_id, count(*) AS n FROM edg GROUP BY ALL) GROUP BY kind",
    "context_candidates": BASE + TASKS + _POSTINGS.replace("{src}", "sym") + _HITS.format(limit=_FETCH) + _SCORED + _EXACT + "SELECT query, id, score, why FROM cand",
    "context_discovery": _CONTEXT + _TRIMMED.format(budget=2000) + "SELECT query, rank, id, score, used FROM trimmed",
    "context_packages": _CONTEXT + _TRIMMED.format(budget=2000) + _PACKAGES.format(src="trimmed"),
    "context_trace": _CONTEXT + _TRIMMED.format(budget=2000) + """SELECT a.query, candidates, coalesce(returned, 0) AS returned, candidates - coalesce(returned, 0) AS truncated, coalesce(tokens, 0) AS tokens
        FROM (SELECT query, count(*) AS candidates FROM ranked GROUP BY query) a LEFT JOIN (SELECT query, count(*) AS returned, max(used) AS tokens FROM trimmed GROUP BY query) k USING (query)""",
    "rank_source_first": BASE + _LISTED.format(query="package") + _RANK.format(src="listed") + "SELECT query, id, rank, round(score, 6) AS score FROM ranked",
    "rank_budget_trim": BASE + _LISTED.format(query="package") + _RANK.format(src="listed") + _TRIMMED.format(budget=400) + "SELECT query, id, rank, used FROM trimmed",
    "dedup_generated": BASE + _LISTED.format(query="split_part(file, '/', 1)") + _DEDUP.format(src="listed") + "SELECT query, id, kind FROM gen_once",
    "dedup_boilerplate": BASE + _LISTED.format(query="split_part(file, '/', 1)") + _BOILER.format(src="listed") + "SELECT query, id, round(score, 6) AS score, why FROM boiled",
    "package_summary": BASE + ", rows_ AS (SELECT split_part(file, '/', 1) AS query, file, kind FROM sym)" + _PACKAGES.format(src="rows_"),
    "vector_valid": BASE + """SELECT embedding_model, coalesce(len(embedding), -1) AS length, coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS valid, count(*) AS symbols
        FROM sym GROUP BY ALL""",
    "vector_topk": _TOPK.format(key="vec_id", group="1", src="embeddings", length="> 0", n=10),
    "vector_by_label": _TOPK.format(key="vec_id", group="label", src="embeddings", length="> 0", n=5),
    "vector_unembedded": BASE + "SELECT id, seq, CASE WHEN docstring = '' THEN signature ELSE signature || chr(10) || docstring END AS text FROM sym WHERE embedding IS NULL OR embedding_model <> 'loom-code-v2'",
    "impact_generic": BASE + _IMPACT + "SELECT target, id, branch FROM found",
    "impact_layers": BASE + _IMPACT + f"SELECT target, {_LAYER} AS layer, count(*) AS symbols FROM found JOIN (SELECT id, file FROM sym) USING (id) GROUP BY target, layer UNION ALL SELECT target, NULL, count(*) FROM found GROUP BY target",
    "impact_field": BASE + f""", f AS (SELECT id AS field, {_PARENT} AS message, array_to_string(list_transform(list_filter(string_split(name, '_'), lambda p: p <> ''), lambda p: upper(p[1:1]) || p[2:]), '') AS go FROM sym WHERE kind = 'field'),
        d AS (SELECT f.*, m.name AS mname FROM f LEFT JOIN sym m ON m.id = message),
        found AS (SELECT field, message AS id, 'declaring message' AS why FROM d WHERE mname IS NOT NULL
        UNION ALL SELECT field, g.id, 'generated getter' FROM d JOIN sym g ON g.kind = 'method' AND g.name = 'Get' || go AND (mname IS NULL OR contains(g.id, '.' || mname || '.'))),
        pats AS (SELECT field, go, unnest(['get' || lower(go) || '(', '.' || lower(go), lower(go) || ':']) AS pat FROM f WHERE go <> ''),
        holds AS (SELECT pat, c.id FROM (SELECT DISTINCT pat FROM pats) JOIN (SELECT id, seq, lower(body) AS text FROM sym WHERE kind IN ('func', 'method')) c ON contains(text, pat)
                  QUALIFY row_number() OVER (PARTITION BY pat ORDER BY seq, c.id) <= 15)
        SELECT * FROM found UNION ALL SELECT DISTINCT field, h.id, 'references ' || go || ' (heuristic)' FROM pats JOIN holds h USING (pat)
        WHERE h.id <> field AND NOT EXISTS (SELECT 1 FROM found x WHERE x.field = pats.field AND x.id = h.id)""",
    "pattern_slice": BASE + f""", links AS (SELECT m.id AS from_id, r.id AS to_id FROM sym r JOIN (SELECT * FROM sym WHERE kind = 'method' AND NOT {_GEN}) m USING (name) WHERE r.kind = 'rpc'
        QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY contains(m.package, 'svc') DESC, m.seq) = 1),
        msg AS (SELECT name, id FROM sym WHERE kind = 'message' QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq) = 1), r AS (SELECT id AS rpc, {_REQ} AS req, {_RESP} AS resp FROM sym WHERE kind = 'rpc')
        SELECT rpc, from_id AS implementation, a.id AS request, b.id AS response FROM r LEFT JOIN links ON to_id = rpc LEFT JOIN msg a ON a.name = req LEFT JOIN msg b ON b.name = resp""",
    "simplest_topk": BASE + ", c AS (SELECT from_id AS id, count(*) AS callees FROM calls GROUP BY from_id) SELECT kind, id, callees, row_number() OVER (PARTITION BY kind ORDER BY callees, id) AS pos FROM c JOIN sym USING (id) QUALIFY pos <= 3",
    "unimplemented": BASE + f""", m AS (SELECT name, min(CASE WHEN contains(body, 'codes.Unimplemented') THEN 1 ELSE 0 END) AS stubbed FROM sym WHERE kind = 'method' AND NOT {_GEN} GROUP BY name)
        SELECT {_PARENT} AS service, id AS rpc, CASE WHEN stubbed IS NULL THEN 'missing' WHEN stubbed = 1 THEN 'stubbed' ELSE 'implemented' END AS state FROM sym LEFT JOIN m USING (name) WHERE kind = 'rpc'""",
    "unimplemented_counts": BASE + f""", m AS (SELECT name, min(CASE WHEN contains(body, 'codes.Unimplemented') THEN 1 ELSE 0 END) AS st FROM sym WHERE kind = 'method' AND NOT {_GEN} GROUP BY name)
        SELECT {_PARENT} AS service, count(*) AS total, count(*) FILTER (WHERE st = 0) AS implemented, count(*) FILTER (WHERE st = 1) AS stubbed, count(*) FILTER (WHERE st IS NULL) AS missing FROM sym LEFT JOIN m USING (name) WHERE kind = 'rpc' GROUP BY service""",
    "dml_upsert_merge": _VERSIONS + """SELECT base.id, coalesce(chg.seq, base.seq) AS seq, base.kind, coalesce(chg.line_start, base.line_start) AS line_start,
        CASE WHEN chg.id IS NULL OR same THEN base.embedding_model ELSE '' END AS embedding_model, coalesce(CASE WHEN chg.id IS NULL OR same THEN len(base.embedding) END, -1) AS length
        FROM base LEFT JOIN (SELECT chg.*, chg.name = b.name AND chg.signature = b.signature AND chg.docstring IS NOT DISTINCT FROM b.docstring AS same FROM chg JOIN base b USING (id)) chg USING (id)""",
    "dml_edge_upsert": BASE + "SELECT from_id, to_id, kind FROM edg",
    "dml_delete_by_file": BASE + ", dead AS (SELECT id FROM cur WHERE file IN (SELECT file FROM symbol_deletes)) SELECT from_id, to_id, kind FROM edg WHERE from_id NOT IN (SELECT id FROM dead) AND to_id NOT IN (SELECT id FROM dead)",
    "dml_delete_packages": BASE + f", p AS (SELECT DISTINCT package FROM sym WHERE file LIKE '%.proto') SELECT from_id, to_id, kind FROM edg WHERE NOT (kind = 'calls' AND {_PARENT.replace('id,', 'from_id,')} IN (SELECT package FROM p))",
    "dml_delete_to_kind": BASE + "SELECT from_id, to_id, kind FROM edg WHERE NOT (kind = 'implements' AND to_id IN (SELECT id FROM sym WHERE kind = 'interface'))",
    "dml_stale_files": BASE + f"SELECT DISTINCT file FROM sym WHERE {_EXT.format(f='file')} IN ('.go', '.ts', '.tsx', '.py') AND file NOT IN (SELECT "
        + r"regexp_replace(regexp_replace(file, '[\\/]+', '/', 'g'), '^(/work/checkout/|\./)', '') FROM read_events)",
    "dml_restore_vectors": _VERSIONS + """SELECT base.id, base.embedding_model, len(base.embedding) AS length FROM base JOIN chg USING (id)
        WHERE base.embedding IS NOT NULL AND base.embedding_model <> '' AND base.name = chg.name AND base.signature = chg.signature AND coalesce(base.docstring, '') = coalesce(chg.docstring, '')""",
    "dml_nearest_module": r"""WITH f AS (SELECT DISTINCT file FROM source_files), h AS (SELECT DISTINCT regexp_extract(file, '^([^/]+(?:/(?:web|proto|pkg|core|internal))?)/', 1) AS folder FROM f)
        SELECT file, folder FROM f JOIN h ON folder <> '' AND starts_with(file, folder || '/') QUALIFY row_number() OVER (PARTITION BY file ORDER BY length(folder) DESC) = 1""",
    "policy_decisions": _DECIDE + "SELECT * FROM d",
    "policy_stats": _DECIDE + "SELECT class, count(*) AS reads, count_if(proposed = 'block')::BIGINT AS blocks, count_if(NOT allowed)::BIGINT AS denied, count_if(overridden)::BIGINT AS overrides FROM d GROUP BY class",
    "session_stats": _ONCE + "SELECT repo, command, count(*) AS total, count_if(success)::BIGINT AS ok, count_if(NOT success)::BIGINT AS failed, sum(response_bytes)::BIGINT AS bytes, sum(estimated_tokens)::BIGINT AS tokens FROM t GROUP BY ALL",
    "session_rollup": _ONCE + ", u AS (SELECT lower(trim(coalesce(tool, 'none'))) AS tool, command FROM t) SELECT tool, command, count(*) AS calls, grouping(tool, command) AS level FROM u GROUP BY ROLLUP (tool, command)",
    "session_percentiles": _ONCE + "SELECT command, quantile_disc(response_bytes, 0.5) AS p50, quantile_disc(response_bytes, 0.95) AS p95 FROM t GROUP BY command",
    "eval_recall_mrr": _RANKS + """, per AS (SELECT query, min(rank) AS best, count(*) AS n, count_if(rank <= 5) AS a, count_if(rank <= 10) AS b FROM ra GROUP BY query)
        SELECT sum(n)::BIGINT AS targets, round(sum(a) / sum(n), 6) AS recall_5, round(sum(b) / sum(n), 6) AS recall_10, round(avg(1.0 / best), 6) AS mrr FROM per""",
    "eval_rank_delta": _RANKS + """SELECT count_if(y < x)::BIGINT AS improved, count_if(y > x)::BIGINT AS worsened, count_if(y = x)::BIGINT AS unchanged
        FROM (SELECT query, min(rank) AS x FROM ra GROUP BY query) JOIN (SELECT query, min(rank) AS y FROM rb GROUP BY query) USING (query)""",
    "stream_policy": _DECIDE.replace("SELECT DISTINCT ON (event_no) * FROM read_events", "SELECT * FROM read_events") + "SELECT * FROM d",
    "stream_tumbling": "SELECT repo, date_trunc('day', recorded_at AT TIME ZONE 'UTC') AS start, count(*) AS calls, count_if(NOT success)::BIGINT AS failed FROM session_telemetry GROUP BY ALL",
    "stream_debounce": f"""WITH e AS (SELECT {_EXT.format(f='lower(file)')} AS ext, recorded_at AT TIME ZONE 'UTC' AS ts, start_line FROM read_events),
        g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY ext ORDER BY ts) + INTERVAL 2 HOUR OR lag(ts) OVER (PARTITION BY ext ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM e),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY ext ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
        SELECT ext, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS reads, count_if(start_line IS NULL)::BIGINT AS whole FROM s GROUP BY ext, no""",
    "stream_dedup": "SELECT DISTINCT ON (event_no) event_no, file FROM read_events",
    "body_references": BASE + f""", w0 AS (SELECT id, list_concat({_CALL_IDENTS}, {_TYPE_IDENTS}) AS ws FROM sym WHERE kind IN ('func', 'method')),
        w AS (SELECT id, name, min(p) AS p FROM (SELECT id, unnest(ws) AS name, generate_subscripts(ws, 1) AS p FROM w0) GROUP BY ALL),
        target AS (SELECT id AS other, name, file, seq FROM sym QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq) <= 10),
        hits AS (SELECT id, other, min((p, seq)) AS spot FROM w JOIN target USING (name) WHERE id <> other AND NOT {_GEN} GROUP BY id, other)
        SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY spot, other) AS pos FROM hits QUALIFY pos <= 10""",
    "scalar_document_idents": "WITH " + TASKS.lstrip()[1:].replace("SELECT item_id AS query, prompt,", "SELECT doc_id AS query, prompt,").replace("FROM task_manifest WHERE", "FROM (SELECT doc_id, text AS prompt FROM documents) WHERE")
        + "SELECT ident, count(*) AS documents, min(query) AS first_doc FROM (SELECT query, unnest(idents) AS ident FROM tasks) GROUP BY ident",
    "vector_symbols": BASE + _TOPK.strip().replace("WITH v", ", v").format(key="seq", group="embedding_model", src="sym", length="= 64", n=10),
    "impact_generated_copies": BASE + _IMPACT + f""", copies AS (SELECT target, s.id, branch, s.seq, s.kind, s.file, split_part(s.id, '.', -1) AS last FROM found JOIN sym s USING (id) WHERE {_GEN.replace('file', 's.file')}),
        spots AS (SELECT *, row_number() OVER (PARTITION BY target, last, kind ORDER BY branch, seq, id) AS place, count(*) OVER (PARTITION BY target, last, kind) AS n FROM copies)
        SELECT target, id, CASE WHEN n > 1 THEN '+' || (n - 1) || ' copies' ELSE '' END AS why FROM spots
        QUALIFY row_number() OVER (PARTITION BY target, last, kind ORDER BY (place > 1 AND contains(file, 'backend')) DESC, place) = 1""",
    "policy_class_map": _DECIDE + """, per AS (SELECT class, count(*) AS reads, count_if(proposed = 'block') AS blocks, count_if(NOT allowed) AS denied, count_if(overridden) AS overrides FROM d GROUP BY class)
        SELECT sum(reads)::BIGINT AS total, sum(blocks)::BIGINT AS proposed_blocks, sum(denied)::BIGINT AS denied, sum(overrides)::BIGINT AS overrides,
               '{' || string_agg('"' || class || '":' || reads, ',' ORDER BY class) || '}' AS classes FROM per""",
    "proto_declarations": r"""WITH h AS (SELECT DISTINCT file, regexp_replace(head, '//[^\n]*', '', 'g') AS h FROM source_files WHERE lower(file) LIKE '%.proto' AND head IS NOT NULL),
        m AS (SELECT file, unnest(regexp_extract_all(h, '(?m)^\s*(?:optional\s+|repeated\s+)?(?:map\s*<[^>]*>|[\w.]+)\s+\w+\s*=\s*\d+\s*(?:\[[^\]]*\])?\s*;')) AS line FROM h),
        d AS (SELECT file, 'service' AS kind, unnest(regexp_extract_all(h, '\bservice\s+(\w+)\s*\{', 1)) AS name FROM h
              UNION ALL SELECT file, 'rpc', unnest(regexp_extract_all(h, '\brpc\s+(\w+)\s*\(', 1)) FROM h
              UNION ALL SELECT file, 'message', unnest(regexp_extract_all(h, '\bmessage\s+(\w+)\s*\{', 1)) FROM h
              UNION ALL SELECT file, 'enum', unnest(regexp_extract_all(h, '\benum\s+(\w+)\s*\{', 1)) FROM h
              UNION ALL SELECT file, 'field', regexp_extract(line, '(\w+)\s*=', 1) FROM m WHERE NOT regexp_matches(line, '^\s*(?:optional\s+|repeated\s+)?(?:message|option|return|package|syntax|reserved)\b'))
        SELECT file, kind, count(*) AS n, min(name) AS first_name FROM d GROUP BY ALL""",
    "lookup_expand_ids": BASE + """, e AS (SELECT from_id AS id FROM edg UNION SELECT to_id FROM edg),
        q AS (SELECT DISTINCT query FROM (SELECT id AS query FROM e UNION ALL SELECT CASE WHEN starts_with(id, 'kestrel.example/') THEN id[17:] ELSE id END FROM e) WHERE query <> '')
        SELECT query, coalesce(a.id, b.id) AS id FROM q LEFT JOIN sym a ON a.id = query LEFT JOIN sym b ON b.id = 'kestrel.example/' || query WHERE a.id IS NOT NULL OR b.id IS NOT NULL""",
    "graph_viz_callers": BASE + """, h AS (SELECT DISTINCT s.id AS root, from_id FROM sym s JOIN calls ON to_id = s.id)
        SELECT DISTINCT to_id AS root, from_id, to_id FROM calls UNION SELECT root, c.from_id, c.to_id FROM h JOIN calls c ON c.to_id = h.from_id WHERE h.from_id <> root""",
    "graph_viz_callees": BASE + """, h AS (SELECT DISTINCT s.id AS root, to_id FROM sym s JOIN calls ON from_id = s.id)
        SELECT DISTINCT from_id AS root, from_id, to_id FROM calls UNION SELECT root, c.from_id, c.to_id FROM h JOIN calls c ON c.from_id = h.to_id WHERE h.to_id <> root""",
    "query_classes": BASE + rf""", q AS (SELECT DISTINCT regexp_extract(split_part(id, '/', -1), '([^.]+\.[^.]+)$', 1) AS query FROM (SELECT from_id AS id FROM edg UNION SELECT to_id FROM edg)),
        texts AS (SELECT 'task' AS source, prompt FROM task_manifest UNION ALL SELECT 'document', text FROM documents UNION ALL SELECT 'id', query FROM q WHERE query <> ''),
        words AS (SELECT source, {_WORDS} AS ws FROM texts WHERE prompt IS NOT NULL), w AS (SELECT source, len(ws) AS n, {_TRIM.format(w='ws[1]')} AS word FROM words)
        SELECT source, CASE WHEN n = 1 AND ({_COMPOUND.format(w='word')} OR contains(word, '.')) THEN 'precise' ELSE 'discovery' END AS class, count(*) AS texts FROM w GROUP BY ALL""",
    "context_precise": BASE + rf""", q AS (SELECT DISTINCT regexp_extract(split_part(id, '/', -1), '([^.]+\.[^.]+)$', 1) AS prompt FROM (SELECT from_id AS id FROM edg UNION SELECT to_id FROM edg)),
        raw AS (SELECT prompt AS query, {_IDENTS} AS idents0, list_filter({_T}, lambda w: strlen(w) >= 3) AS words FROM q WHERE prompt <> ''),
        tasks AS (SELECT query, words, {_ordered('idents0')} AS idents FROM raw)""" + _EXACT[:_EXACT.index("cand AS")].rstrip().rstrip(",") + " SELECT query AS prompt, id, round(score, 9) AS score, why FROM exacts",
    "dml_delete_prefix": BASE + ", p AS (SELECT DISTINCT package FROM sym WHERE file LIKE '%.proto') SELECT from_id, to_id, kind FROM edg WHERE NOT (kind = 'calls' AND EXISTS (SELECT 1 FROM p WHERE starts_with(from_id, package)))",
    "dml_update_vectors": _VERSIONS + """SELECT base.id, CASE WHEN chg.embedding IS NULL THEN base.embedding_model ELSE chg.embedding_model END AS embedding_model, coalesce(len(coalesce(chg.embedding, base.embedding)), -1) AS length
        FROM base LEFT JOIN chg ON chg.id = base.id""",
    "eval_violations": BASE + _LISTED.format(query="package") + _RANK.format(src="listed") + _TRIMMED.format(budget=400) + f"""
        SELECT count(*) AS forbidden, count(t.id) AS violations, round(avg(CASE WHEN t.id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS rate
        FROM (SELECT query, id FROM listed WHERE {_GEN}) f LEFT JOIN trimmed t ON t.query = f.query AND t.id = f.id""",
    "eval_averages": BASE + _LISTED.format(query="package") + _RANK.format(src="listed") + _TRIMMED.format(budget=400) + """
        SELECT count(*) AS queries, round(avg(n), 6) AS results, round(avg(tokens), 6) AS tokens FROM (SELECT query, count(*) AS n, max(used) AS tokens FROM trimmed GROUP BY query)""",
    "context_vector": BASE + TASKS.replace("SELECT item_id AS query, prompt,", "SELECT doc_id AS query, prompt,").replace("FROM task_manifest WHERE", "FROM (SELECT doc_id, text AS prompt FROM documents WHERE doc_kind = 'design') WHERE")
        + _EXACT[:_EXACT.index("cand AS")].rstrip().rstrip(",") + f""",
        v AS (SELECT s.*, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM sym s WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        tv AS (SELECT x.query, v.embedding_model AS m, v.e AS q FROM exacts x JOIN v USING (id) QUALIFY row_number() OVER (PARTITION BY x.query ORDER BY round(x.score, 9) DESC, id) = 1),
        near AS (SELECT query, id, kind, package, file, round(list_cosine_similarity(q, e), 9) AS sim FROM tv JOIN v ON embedding_model = m
                 QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, seq) <= 30)
        SELECT query, id, round(sim * 1.5::DOUBLE + {_KW} + {_IMPL} + {_PEN}, 6) AS score FROM near WHERE NOT EXISTS (SELECT 1 FROM exacts x WHERE x.query = near.query AND x.id = near.id)""",
}
SQL["body_rows"] = SQL["lookup_fuzzy_tiered"].replace("        SELECT query, id, tier FROM every", "        , best AS (SELECT query, id, tier FROM every") + ")" + SQL["body_references"][len(BASE):].replace(
    "SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY spot, other) AS pos FROM hits QUALIFY pos <= 10",
    """, few AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY spot, other) AS pos FROM hits QUALIFY pos <= 10),
    refs AS (SELECT id, string_agg(other, ' ' ORDER BY pos) AS refs FROM few GROUP BY id),
    named AS (SELECT b.query, s.id, s.body, CASE WHEN starts_with(s.id, 'kestrel.example/') THEN s.id[17:] ELSE s.id END AS short_id FROM best b JOIN sym s USING (id))
    SELECT query, id, short_id, body, CASE WHEN id <> query THEN 'Fuzzy match: requested "' || query || '", resolved to "' || short_id || '"' ELSE '' END AS hint, coalesce(refs, '') AS "references"
    FROM named LEFT JOIN refs USING (id)""")
SQL["context_verbose"] = _CONTEXT + """, costed AS (SELECT r.*, sum((strlen(r.signature) + strlen(docstring) + strlen(r.id) + strlen(why) + strlen(r.file) + 110) // 4)
          OVER (PARTITION BY query ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM ranked r JOIN (SELECT id, docstring FROM sym) USING (id))
        SELECT query, rank, id, used FROM costed WHERE used <= 2000"""
SQL["context_text"] = _CONTEXT + _TRIMMED.format(budget=2000) + _PACKAGES.format(src="trimmed").replace("SELECT query, folder, symbols, kinds FROM folders", ", many AS (SELECT query, folder, symbols, kinds FROM folders") + """),
        heads AS (SELECT query, 'packages:' || chr(10) || string_agg('  ' || folder || ' \u2014 ' || symbols || ' (' || kinds || ')', chr(10) ORDER BY symbols DESC, folder) || chr(10) AS head FROM many GROUP BY query),
        body AS (SELECT query, count(*) AS n, string_agg(kind || ' ' || id || ' \u2014 ' || signature || ' \u2014 ' || file || ':' || line_start
          || CASE WHEN line_end > line_start THEN '-' || line_end ELSE '' END, chr(10) ORDER BY rank) AS lines FROM trimmed JOIN (SELECT id, line_start, line_end FROM sym) USING (id) GROUP BY query),
        every AS (SELECT query, count(*) AS total FROM ranked GROUP BY query)
        SELECT query, concat_ws(chr(10), head, lines, CASE WHEN total > n THEN '(+' || (total - n) || ' more)' END) AS text FROM body JOIN every USING (query) LEFT JOIN heads USING (query)"""
SQL["body_declarations"] = BASE + """, l AS (SELECT id, string_split(body, chr(10)) AS l FROM sym),
        p AS (SELECT id, l, list_transform(range(1, len(l) + 1), lambda i: array_to_string(l[1:i], '')) AS upto FROM l),
        e AS (SELECT id, l, coalesce(list_filter(range(1, len(l) + 1), lambda i: CASE WHEN contains(upto[i], '{') THEN length(replace(upto[i], '{', '')) >= length(replace(upto[i], '}', '')) ELSE i = 1 END)[1], len(l)) AS n FROM p)
        SELECT id, array_to_string(l[1:n], chr(10)) AS declaration, n::INTEGER AS lines FROM e"""
SQL["scalar_left_out"] = """SELECT file, bool_or(NOT (file LIKE '%.pb.go' OR file LIKE '%.pb.gw.go') AND (
          len(list_filter(string_split(file, '/'), lambda p: starts_with(p, '.') OR p IN ('vendor', 'gen', 'generated'))) > 0 OR ends_with(file, '_gen.go') OR ends_with(file, '_generated.go')
          OR contains(array_to_string(string_split(coalesce(head, ''), chr(10))[1:5], chr(10)), 'Code generated'))) AS left_out FROM source_files GROUP BY file"""
SQL["lookup_without_paths"] = BASE + "SELECT package, count(*) AS symbols FROM sym WHERE NOT contains(package, '/gen') AND NOT contains(package, '/internal') GROUP BY package"
SQL["vector_embed_totals"] = BASE + "SELECT count(*) AS considered, count(*) AS embedded, 0::BIGINT AS failed FROM sym WHERE embedding IS NULL OR embedding_model <> 'loom-code-v2'"
SQL["stream_relink"] = SQL["graph_link_rebuild"].replace(" LEFT JOIN gone USING (id) WHERE gone.deleted_at IS NULL OR gone.deleted_at < cur.indexed_at", "")
