"""Training-data operators against brute force, round trips and held-out accuracy."""

import datetime as dt
import math
import os
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from codeweft.llm import docpairs, garble, leakage, neighbours, percentiles, sourceclass, spans, tokenize

VOCABULARY = f"{tokenize.VOCABULARIES}/byte_bpe_50k.json"
has_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files here")


# percentiles


def test_order_key_is_order_preserving(spark):
    xs = [0.0, -0.0, 1.5, -1.5, 1e-300, -1e300, 1e300, float("inf"), float("-inf"), 2.0**53]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,), (float("nan"),)], "x double")
    got = df.select("x", percentiles.order_key("x").alias("k")).withColumn("back", percentiles.key_value("k")).collect()
    known = sorted((r for r in got if r.k is not None), key=lambda r: r.k)
    assert [r.x for r in known] == sorted(r.x for r in known) and all(r.x == r.back for r in known)
    assert sum(r.k is None for r in got) == 2


def test_select_is_exact_and_states_merge(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(3), rnd.choice([rnd.gauss(0, 1e6), float(rnd.randrange(5)), None, 3.0])) for _ in range(3000)]
    rows += [("one", 0, 7.25)]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    qs = [0.01, 0.5, 0.95, 1.0]
    keys = percentiles.keyed(df, ["g"], "v")
    got = {(r.g, r.q): (r.n, r.value) for r in percentiles.select(keys, ["g"], qs).collect()}
    for g in ("a", "b", None, "one"):
        vs = sorted(v for k, _, v in rows if k == g and v is not None)
        for q in qs:
            assert got[(g, q)] == (len(vs), vs[max(1, math.ceil(q * len(vs))) - 1])
    by_day = percentiles.histogram(percentiles.keyed(df, ["g", "day"], "v"), ["g", "day"])
    for r in percentiles.bounds(percentiles.merge(by_day, ["g"]), ["g"], qs).collect():
        v = got[(r.g, r.q)][1]
        assert r.low <= v <= r.high and r.high - r.low <= abs(v) / 128 + 1e-12
    assert percentiles.select(keys.limit(0), ["g"], qs).count() == 0


def test_whole_numbers_are_exact(spark):
    rnd = random.Random(3)
    vs = [rnd.choice([rnd.randrange(10), rnd.randrange(2**62), 2**53 + rnd.randrange(5), 2**62 + rnd.randrange(2**20), -rnd.randrange(2**60), -rnd.randrange(9)]) for _ in range(2000)] + [2**63 - 1, 0]
    keys = percentiles.keyed(spark.createDataFrame([("a", v) for v in vs], "g string, v long"), ["g"], "v", whole=True)
    qs = [i / 40 for i in range(1, 41)]
    got = {r.q: r.value for r in percentiles.select(keys, ["g"], qs, whole=True).collect()}
    assert got == {q: sorted(vs)[max(1, math.ceil(q * len(vs))) - 1] for q in qs}
    for r in percentiles.bounds(percentiles.histogram(keys, ["g"], whole=True), ["g"], qs, whole=True).collect():
        assert r.low <= float(got[r.q]) <= r.high and r.high - r.low <= abs(got[r.q]) / 128 + 1e-9


def test_measures_cases(spark):
    t = dt.datetime(2025, 1, 1, 5)
    rows = [(1, t, " Get_Body ", 5, 7), (1, t, " Get_Body ", 5, 7), (2, t, None, -1, 0), (3, t, "get_body", None, None)]
    df = spark.createDataFrame(rows, "event_no long, recorded_at timestamp, tool string, duration_ms long, estimated_tokens int").withColumn("value", F.lit("clash"))
    got = sorted((r.metric, r.tool or "", r.value) for r in percentiles.measures(df).collect())
    assert got == [("duration_ms", "get_body", 5), ("estimated_tokens", "", 0), ("estimated_tokens", "get_body", 7)]


# encoding


@has_vocabulary
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_merge_replay_equals_the_library(texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(VOCABULARY)
    lib.encode_special_tokens = True
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["aaaaaaa bbbb<|endoftext|> don't  \n\n x"]
    words = [tokenize.regex.findall(tokenize.WORD_PATTERN, t) for t in texts]
    ids = tokenize.MergeReplay(*tokenize.load_vocabulary(VOCABULARY)).encode({w for ws in words for w in ws})
    for t, ws in zip(texts, words):
        assert [i for w in ws for i in ids[w]] == lib.encode(t, add_special_tokens=False).ids


@has_vocabulary
def test_both_forms_of_a_vocabulary_agree():
    a, b = (tokenize.load_vocabulary(f"{tokenize.VOCABULARIES}/byte_bpe_50k.{x}") for x in ("json", "tiktoken"))
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


@has_vocabulary
def test_encode_corpus_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (4, "x" * 20000)], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = tokenize.encode_corpus(df).collect()
    by = {r.doc_id: r.ids for r in got}
    assert len(got) == 5 and by[1] == [] and by[2] == [] and by[3] == [31373, 995] and len(by[4]) > 100
    assert tokenize.encode_corpus(df.limit(0)).count() == 0
    for few in (0, 1):  # words beyond the frequent ones are replayed where they are met
        assert sorted((r.doc_id, r.ids) for r in tokenize.encode_corpus(df, frequent=few).collect()) == sorted((r.doc_id, r.ids) for r in got)


# leaks


def test_leaks_in_blocks_of_items(spark):
    items = spark.createDataFrame([(i, f"common start of item {i} " + " ".join(f"w{i}x{j}" for j in range(14))) for i in range(9)], "item_id long, prompt string")
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("before "), "prompt", F.lit(" after")).alias("text"))
    whole = sorted(map(tuple, leakage.find_leaks(docs, items).collect()))
    assert len(whole) == 9 and sorted(map(tuple, leakage.find_leaks(docs, items, block_bytes=200).collect())) == whole


def naive_leaks(docs, items, n=12):
    import re

    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower().replace("İ", " "))
    grams = lambda w: {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
    ig = {i: grams(re.findall("[A-Za-z0-9]+".lower(), p.lower())) for i, p in items if p}
    out = set()
    for d, t in docs:
        g = grams(words(t))
        out |= {(d, i) for i, x in ig.items() if g & x}
    return out


def test_leaks_against_brute_force(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([5, 12, 30, 60])))) for i in range(20)] + [(98, None), (99, "a a a a a a a a a a a a a a")]
    docs = [(1, None), (2, ""), (3, "a " * 13), (4, "A, a! a? a a a a\na a a a")]
    for d in range(5, 60):
        ws = [rnd.choice(vocab) for _ in range(rnd.randrange(50))]
        src = (items[rnd.randrange(20)][1]).split()
        at = rnd.randrange(len(src))
        piece = src[at:at + rnd.choice([8, 11, 12, 13, 40])]
        sep = rnd.choice([" ", "\n", "... ", "é", "_"])
        docs.append((d, " ".join(ws) + sep + sep.join(x.upper() if rnd.random() < 0.3 else x for x in piece) + sep + " ".join(ws)))
    dd = spark.createDataFrame(docs + docs[:2], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    ii = spark.createDataFrame(items, "item_id long, prompt string")
    got = leakage.find_leaks(dd, ii)
    rows = got.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == naive_leaks(docs, items)
    assert all(r.words >= 12 for r in rows)
    assert leakage.find_leaks(dd.limit(0), ii).count() == 0 and leakage.find_leaks(dd, ii.limit(0)).count() == 0
    clean = {r.doc_id for r in leakage.clean_documents(dd, got).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in naive_leaks(docs, items)}


def test_suffix_array_is_sorted():
    s = np.random.default_rng(0).integers(1, 4, 300)
    order = leakage.suffix_array(s, 16)
    cut = [tuple(s[i:i + 16]) for i in order]
    assert cut == sorted(cut) and sorted(order) == list(range(300))


# garbling

SAMPLES = {"fr": "Voilà pourquoi la clé n’a pas été retenue à l’étape", "de": "Möglicherweise gehört die Prüfung zunächst größer", "ru": "Ошибка в модуле найдено лишних строк",
           "ja": "呼び出し元が見つからなくなります。", "pt": "ATENÇÃO: A EXCLUSÃO NÃO É REVERSÍVEL", "en": "It doesn’t matter — Zoë’s café “demo” ≥ 5 · 40 µs ± 2 … naïve",
           "tree": "├── cmd\n│   └── scan\n└── pkg", "signs": "½ × ¾ ≈ ⅜ §4 12 °C n≤5 a≠b", "de2": "„groß“ und „Spaß“, „Ä“", "fr2": "mot—était allé : « été »", "other": "한국어 주석 مرحبا हिन्दी שלום 👩‍🔧 𝕌𝕟𝕚 ﬁle é", "pl": "Zażółć gęślą jaźń", "ru2": "уже её Рёбра Объём"}


@pytest.mark.parametrize("key", SAMPLES)
def test_correct_text_is_left_alone(key):
    assert garble.repair(SAMPLES[key], {}) == (SAMPLES[key], [], False)


@pytest.mark.parametrize("key,right,wrong", [("fr", "utf-8", "cp1252"), ("en", "utf-8", "mac_roman"), ("de", "utf-8", "latin-1"), ("ru", "utf-8", "cp1252"), ("ru", "utf-8", "cp1251"), ("ja", "utf-8", "latin-1"),
                                             ("fr", "utf-8", "cp437"), ("pt", "utf-8", "cp1250"), ("de", "cp1252", "mac_roman"), ("fr", "cp1252", "cp437"), ("ru", "koi8_r", "cp1251"), ("ru", "cp1251", "latin-1"), ("ja", "euc_jp", "latin-1")])
def test_round_trip(key, right, wrong):
    bad = SAMPLES[key].encode(right)
    bad = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in bad) if wrong.startswith("cp12") else bad.decode(wrong)
    text, layers, found = garble.repair(bad, {})
    assert found and layers
    same = sum(a == b for a, b in zip(text.split(), SAMPLES[key].split())) / len(SAMPLES[key].split())
    assert same >= 0.6, text


def test_nested_layers():
    twice = "n’a été".encode().decode("cp1252").encode().decode("cp1252")
    assert garble.repair(twice, {})[0] == "n’a été"


def test_seven_layers():
    text = "été"
    for _ in range(7):
        text = text.encode().decode("latin-1")
    assert garble.repair(text, {})[0] == "été"


def test_garbled_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "plain"), (4, "cafÃ©"), (4, "cafÃ©"), (5, "caf�"), (6, "café " * 5000), (7, "Ã©t" * 4000)], "doc_id long, text string").withColumn("layers", F.lit("clash"))
    got = garble.find_garbled(df).collect()
    assert Counter(r.doc_id for r in got) == {4: 2, 5: 1, 7: 1}
    assert {r.doc_id: (r.restored, r.whole) for r in got}[4] == ("café", True)
    assert garble.find_garbled(df.limit(0)).count() == 0


# documentation

TRIVIAL = ["", None, " \n", "TODO", "FIXME: later", "SaveParcel", "SaveParcel.", "SaveParcel ...", "SaveParcel saves parcel.", "The SaveParcel method.", "SaveParcel is the implementation of the SaveParcel method.", "---------", "N/A",
           "See above.", "Please refer to the design document for more information about this function.", "nolint:gocyclo", "go:generate x -type=A", "@inheritdoc", "@param ctx\n@param lateCoil\n@returns", "@param {string} lateCoil - the late coil",
           "Function: SaveParcel\nDescription:\nParameters:\nReturns:", "r.x = r.Do(ctx, 1)\nreturn r.y, nil", "FIXME add a description here, this text is only a placeholder for now", "save parcel", "TODO(me): write a proper comment"]
REAL = ["nil once the lease expires.", "Sorted by date, newest first.", "SaveParcel deletes the split harbor too.", "Panics if the parcel is empty.", "Renvoie le plus proche, ou une erreur.", "結果を返します。", "Возвращает ошибку.",
        "Skips any parcel that has no lamp.\n\nTODO: cover the empty case", "@param ctx carries the lamp\n@returns the parcel nearest to 4", "nolint:gocyclo\nBlocks until the parcel drains."]
SIGNATURE = "func SaveParcel(ctx context.Context, lateCoil []byte) error"


@pytest.mark.parametrize("doc", TRIVIAL)
def test_trivial(doc):
    assert docpairs.is_trivial(doc, "SaveParcel", SIGNATURE)


@pytest.mark.parametrize("doc", REAL)
def test_not_trivial(doc):
    assert not docpairs.is_trivial(doc, "SaveParcel", SIGNATURE)


def test_islands():
    doc, code = docpairs.parse_function("// Licence.\n\n// Blocks until done.\nfunc A(s string) {\n\tx := \"}\" // }\n}\nvar water = 1\n", "a.go")
    assert doc.strip() == "// Blocks until done." and code.endswith("// }\n}") and "water" not in code
    doc, code = docpairs.parse_function('@cached\ndef a(self, b="):"):\n    """Blocks."""\n    return 1\n', "a.py")
    assert doc == "Blocks." and "Blocks" not in code
    doc, code = docpairs.parse_function("/**\n * Blocks.\n */\n@Inject()\nasync a() { return `}${b}`; }", "a.ts")
    assert "Blocks." in doc and code.startswith("@Inject()")


@pytest.mark.parametrize("file,doc,code", [
    ("a.go", "// Blocks.\n", "func A() {\n\tr := '{'\n\ts := `}\\`\n\tuse(r, s)\n}"),
    ("a.ts", "/** Blocks. */\n", "function a(x: string) {\n  return `}${x.replace(/[}/]{2}/g, `${'}'}`)}` + x / 2 / 3;\n}"),
    ("a.js", "// Blocks.\n", "const a = (x) => {\n  if (/}/.test(x)) return /\\/}/;\n  return x / 1;\n}"),
    ("A.java", "/** Blocks. */\n", '@Override\npublic String a() {\n  return """\n  } " }\n  """;\n}'),
    ("a.proto", "// Blocks.\n", "rpc A(B) returns (C);"),
    ("a.proto", "// Blocks.\n", "rpc A(B) returns (C) {\n  option x = \"}\";\n}"),
])
def test_islands_by_language(file, doc, code):
    got = docpairs.parse_function(doc + code + "\nwater { }\n", file)
    assert "Blocks." in got[0] and got[1] == code


def test_pairs_cases(spark):
    schema = "seq long, id string, kind string, name string, signature string, docstring string, file string, body string"
    go = "func SaveParcel() {}"
    rows = [(1, "a", "func", "SaveParcel", SIGNATURE, "nil once it expires.", "a.go", go), (2, "a", "func", "SaveParcel", SIGNATURE, "TODO", "a.go", go), (3, "b", "func", "SaveParcel", SIGNATURE, "nil once it expires.", "a.go", "/* a.go:1-2 */"),
            (4, "c", "struct", "X", "", "nil once it expires.", "a.go", go), (5, "d", "method", "X", SIGNATURE, None, "a.go", "// nil once it expires.\n" + go), (5, "d", "method", "X", SIGNATURE, None, "a.go", "// nil once it expires.\n" + go),
            (6, "e", "func", "X", SIGNATURE, "nil once it expires.", "a.go", ""), (7, "f", "func", None, None, "nil once it expires.", None, "func X() {" + "x()\n" * 20000 + "}")]
    df = spark.createDataFrame(rows, schema).withColumn("found", F.lit("clash"))
    assert sorted(r.seq for r in docpairs.found_pairs(df).collect()) == [5, 7]
    assert sorted(r.seq for r in docpairs.pairs(df).collect()) == [5, 7]
    assert docpairs.found_pairs(df.limit(0)).count() == 0


# shared spans


def test_spans_against_brute_force(spark):
    rnd = random.Random(9)
    letters = "ab \n\té漢"
    text = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    common = [text(n) for n in (39, 40, 41, 80)]
    bodies = []
    for i in range(60):
        b = text(rnd.randrange(60))
        for _ in range(rnd.randrange(3)):
            b += rnd.choice(common) + text(rnd.randrange(20))
        bodies.append((i, b))
    bodies += [(100, None), (101, ""), (102, bodies[0][1]), (103, common[3] * 2)]
    df = spark.createDataFrame(bodies + bodies[:3], "seq long, body string").withColumn("at", F.lit("clash"))
    shared = spans.shared_windows(df, df.select("seq"), window=30, least=40)
    own = {}
    for k, b in bodies:
        for p in range(len(b or "") - 39):
            own.setdefault(b[p:p + 40], set()).add(k)
    pairs = {(a, b) for ks in own.values() for a in ks for b in ks if a < b}
    assert {tuple(r) for r in spans.sharing_pairs(shared).collect()} == pairs
    cover = {}
    for k, b in bodies:
        for p in range(len(b or "") - 39):
            if len(own[b[p:p + 40]]) > 1:
                cover.setdefault(k, set()).update(range(p, p + 40))
    got = {r.seq: r.shared for r in spans.coverage(spans.intervals(shared, least=40), df).collect()}
    assert got == {k: len(v) for k, v in cover.items()}
    assert spans.shared_windows(df.limit(0), df.select("seq")).count() == 0


def test_coverage_of_records_that_share_nothing(spark):
    rows = spark.createDataFrame([(1, "x" * 10), (2, "y" * 20), (3, ""), (4, None), (5, "old")], "seq long, body string")
    found = spark.createDataFrame([(1, 0, 4), (1, 6, 7)], "seq long, start int, end int")
    got = {r.seq: (r.shared, r.chars, r.share) for r in spans.coverage(found, rows, current=rows.filter("seq < 5")).collect()}
    assert got == {1: (5, 10, 0.5), 2: (0, 20, 0.0), 3: (0, 0, 0.0), 4: (0, 0, 0.0)}


def test_repeated_values_hot_and_cold(spark):
    rnd = random.Random(8)
    rows = [(7, rnd.randrange(50), i) for i in range(300)] + [(8, 1, i) for i in range(200)] + [(rnd.randrange(100, 400), rnd.randrange(40), i) for i in range(400)]
    rows += [(None, 1, 0), (None, 2, 0)]
    df = spark.createDataFrame(rows, "fp long, seq long, at int")
    keys = {}
    for fp, k, _ in rows:
        keys.setdefault(fp, set()).add(k)
    want = sorted(r for r in rows if r[0] is not None and len(keys[r[0]]) > 1)
    assert sorted(tuple(r) for r in spans._repeated(df.filter("fp is not null"), "fp", "seq").collect()) == want


# neighbours


def test_similar_pairs_recall(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((600, 64))
    near = base[:80] + rng.standard_normal((80, 64)) * 0.3
    x = np.concatenate([base, near, base[:5]])
    rows = [(i, f"s{i}", v.tolist(), "m" if i % 7 else "n") for i, v in enumerate(x.astype(np.float32))]
    rows += [(2000, "s0", None, "m"), (2001, "u1", [], "m"), (2002, "u2", [0.0] * 64, "m"), (2003, "u3", [float("nan")] * 64, "m"), (2004, "u4", [1.0] * 32, "m"), (2005, "u5", [1e38] * 64, None)]
    df = spark.createDataFrame(rows + rows[:4], "seq long, id string, embedding array<float>, embedding_model string").withColumn("code", F.lit("clash"))
    got = {(r.a, r.b) for r in neighbours.similar_pairs(df, 0.9).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i in range(1, len(x)) for j in range(i + 1, len(x)) if s[i, j] >= 0.9 and (i % 7 > 0) == (j % 7 > 0)}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 30
    assert neighbours.similar_pairs(df.limit(0), 0.9).count() == 0


def test_graph_and_search_recall(spark):
    """Recall of the graph and of the greedy search against brute force, and what the rounds add to the start."""
    rng = np.random.default_rng(6)
    x = (rng.standard_normal((4000, 16)) @ rng.standard_normal((16, 64)) + 0.5 * rng.standard_normal((4000, 64))).astype(np.float32)
    x[2000:2400] = x[0] + 0.01 * rng.standard_normal((400, 64))  # a dense cluster, larger than what a node keeps
    df = spark.createDataFrame([(i, f"s{i}", v.tolist(), "m") for i, v in enumerate(x)], "seq long, id string, embedding array<float>, embedding_model string")
    codes = neighbours.current_codes(df, "seq", "id", "embedding_model", "embedding", 8)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(0, 4000, 40) for j in np.argsort(-s[i])[:10] if s[i, j] < 0.99}
    recall = lambda rows: len(want & {tuple(r)[:2] for r in rows}) / len(want)
    start = recall(neighbours.neighbour_graph(codes, trees=2, leaf=64, rounds=0).collect())
    graph = neighbours.neighbour_graph(codes, trees=2, leaf=64)
    after = recall(graph.collect())
    assert start < 0.6 and after >= 0.9
    queries = codes.filter("seq % 40 = 0").select(F.col("seq").alias("query"), "model", "code")
    assert recall(neighbours.greedy_search(graph, codes, queries).collect()) >= 0.9


# source classes


def test_notices_and_names():
    house = "Kestrel Orchard Works"
    n = lambda h: sourceclass.notice(h, house)
    assert n("// Code generated by x v1. DO NOT EDIT.\npackage a") == sourceclass.GENERATED
    assert n("// Copyright 2025 Kestrel Orchard Works.\n\n/* Autogenerated by x, do not touch. */\npackage a") == sourceclass.GENERATED
    assert n("// Copyright 2025 Kestrel Orchard Works. Internal use only.\npackage a") == sourceclass.HAND
    assert n("// Started from a x template; maintained by hand since 2021.\npackage a") == sourceclass.HAND
    assert n("// Copyright (c) 2021 The Quillon Authors. All rights reserved.\npackage a") == sourceclass.VENDORED
    assert n("// Copyright 2025 Kestrel Orchard Works.\n// Automatisch erzeugt mit x. Nicht von Hand bearbeiten.\n\npackage a") == sourceclass.GENERATED
    assert n("# 自動生成\nx = 1") == sourceclass.GENERATED and n("// Généré automatiquement, ne pas modifier.\npackage a") == sourceclass.GENERATED
    assert n("// Licences are renewed automatically.\npackage a") is None
    assert n("package a\n// Code generated by x. DO NOT EDIT.") is None and n('package a\nconst h = "// Code generated by x. DO NOT EDIT."') is None and n(None) is None
    assert sourceclass.named("m/internal/deps/a.go") is None and sourceclass.named("m/deps/lib/a.go") == sourceclass.VENDORED and sourceclass.named("m/codegen/a.go") is None


def test_forest_finds_unlabelled_files(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 9)))

    def hand():
        return "\n".join(rnd.choice([f"\tif {word()} == nil {{", f"\t{word()} := {word()}({word()}, {rnd.randrange(99)})", f"// {word()} {word()}", f"\tfor _, {word()} := range {word()} {{", "\t}", f'\treturn fmt.Errorf("{word()}")']) for _ in range(25))

    def made():
        return "\n\n".join(f"func (x *T) Get{word()}() string {{\n\treturn x.{word()}\n}}" for _ in range(12))

    def packed():
        return "".join(f"function a(b){{return b[{rnd.randrange(99999)}]+c}}" for _ in range(30))

    rows = []
    for i in range(60):
        rows += [(f"m/h{i}.go", "// Copyright 2025 Kestrel Orchard Works.\n" + hand(), 40, 1200), (f"m/g{i}.go", "// Code generated by x. DO NOT EDIT.\n" + made(), 60, 2000), (f"m/p{i}.min.js", packed(), 1, 90000)]
    for i in range(20):
        rows += [(f"m/uh{i}.go", hand(), 40, 1200), (f"m/ug{i}.go", made(), 60, 2000), (f"m/up{i}.js", packed(), 1, 90000)]
    rows += [("m/n.go", None, 40, 1200), (None, "x", 1, 1), ("m/e.go", "", 0, 0)]
    df = spark.createDataFrame(rows + rows[:5], "file string, head string, n_lines int, n_bytes long").withColumn("class", F.lit("clash"))
    got = {r.file for r in sourceclass.found(sourceclass.classify(df, "Kestrel Orchard Works")).collect()}
    want = {r[0] for r in rows if r[0] and r[0].split("/")[1][:2].strip("u0123456789.")[:1] in ("g", "p")}
    held = {f"m/u{k}{i}.{'js' if k == 'p' else 'go'}" for k in "hgp" for i in range(20)}
    assert sum((f in got) == (f in want) for f in held) / len(held) >= 0.9
    assert "m/n.go" not in got
    assert sourceclass.classify(df.limit(0), "x").count() == 0


def test_forest_decides_seen_content(spark):
    house = "Kestrel Orchard Works"
    assert sourceclass.notice("// Made from the x template: do not modify the template.\n// This file is maintained by hand.\npackage a", house) == sourceclass.HAND
    assert sourceclass.notice("// Code generated by x; this file is not maintained by hand.\npackage a", house) == sourceclass.GENERATED
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 9)))
    own = "// Copyright 2025 Kestrel Orchard Works.\n"
    hand = lambda: "\n".join(rnd.choice([f"\tif {word()} == nil {{", f"\t{word()} := {word()}({word()})", f"// {word()} {word()}", "\t}", f'\treturn fmt.Errorf("{word()}")']) for _ in range(25))
    packed = lambda: "".join(f"function a(b){{return b[{rnd.randrange(99999)}]+c}}" for _ in range(30))
    rows = [(f"m/h{i}.go", own + hand(), 26, 1200) for i in range(60)] + [(f"m/p{i}.min.js", packed(), 1, 90000) for i in range(60)]
    rows += [("m/order_data.go", hand(), 26, 1200), ("m/gen/helper.go", own + hand(), 26, 1200), ("m/banner.js", own + packed(), 1, 90000),
             ("m/vendor/x/a.go", hand(), 26, 1200), ("m/made.go", "// Code generated by x. DO NOT EDIT.\n" + hand(), 26, 1200), ("m/blind.pb.go", None, 26, 1200)]
    df = spark.createDataFrame(rows, "file string, head string, n_lines int, n_bytes long")
    got = {r.file for r in sourceclass.found(sourceclass.classify(df, house)).collect()}
    assert not got & {"m/order_data.go", "m/gen/helper.go"}
    assert got >= {"m/banner.js", "m/vendor/x/a.go", "m/made.go", "m/blind.pb.go"}
