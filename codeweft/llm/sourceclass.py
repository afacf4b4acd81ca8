"""Source files that no one at the house wrote by hand.

A random forest judges the content: compression ratio, token entropy, identifier lengths,
comment density and the like. It is trained on the files that say in their header (or by
the name a tool gave them) what they are; headers and names are hidden from the features,
so the forest also finds the files that say nothing. Copies of other people's hand-written
code cannot be told by content; for them the header's notice and the folder speak.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

HAND, GENERATED, MINIFIED, BLOB, VENDORED = range(5)
#: Most labelled rows the forest is fitted on; beyond it a random part of them, of every class
#: alike, is taken. All rows are classified.
LABELLED_ROWS = 200_000
TREES, DEPTH, SEED = 60, 10, 11

_GENERATED_NOTICE = re.compile(
    r"\bdo not (?:edit|modify|touch)\b|@generated\b|\bauto-?generated\b|\bautomatically (?:generated|produced|created|written)\b|"
    r"\b(?:edits|changes|modifications)\b.{0,30}\bwill be (?:lost|overwritten|discarded)\b|\bcode generated (?:by|from)\b|"
    r"\bgenerated (?:by|from)\b.{0,60}\b(?:protoc|openapi|swagger|grpc|thrift|antlr)\b|"
    r"\bautomatisch (?:erzeugt|generiert|erstellt)|\bnicht (?:von hand |manuell )?(?:bearbeiten|ändern|editieren)\b|"
    r"\b(?:généré|créé)e?s? automatiquement|\bne pas (?:modifier|éditer)\b|\b(?:generad[oa]s?|cread[oa]s?) automáticamente|\bno (?:editar|modificar)\b|"
    r"\bgerad[oa]s? automaticamente|\bnão (?:editar|modificar|edite|modifique)\b|\bgenerat[oaie] automaticamente|\bnon modificare\b|\bautomatisch gegenereerd|\bniet (?:bewerken|wijzigen)\b|"
    r"автоматически (?:создан|сгенерирован)|сгенерирован[оа]? автоматически|не (?:редактировать|изменять|редактируйте|изменяйте)|自動生成|自動的に生成|編集しないで|自动生成|请勿(?:编辑|修改)|자동 ?생성", re.I)
_MINIFIED_NOTICE = re.compile(r"\bminified\b|/\*!\s|sourceMappingURL", re.I)
_BY_HAND = re.compile(r"(?<!not )\b(?:maintained by hand|written by hand|hand-?written)\b|\bgo:generate\b", re.I)
_KEPT_BY_HAND = re.compile(r"(?<!not )\b(?:maintained|kept) by hand\b", re.I)
_COPIED_NOTICE = re.compile(
    r"\b(?:copied|taken|vendored|imported|adapted|derived|ported|forked)\b.{0,40}\b(?:from|unmodified|unchanged|verbatim)\b|\bsee LICENSE\.\w+|"
    r"\b\d+\.\d+(?:\.\d+)?\s*\|\s*\(c\)|\breleased under the\b|\bredistribution (?:is|and)\b|\bpublic terms\b", re.I)
_COPYRIGHT = re.compile(r"copyright\s+(?:\(c\)\s*|©\s*)?(?:\d{4}(?:-\d{4})?,?\s+)?(?:the\s+)?(.+?)(?:\.|,|\ball rights\b|$)", re.I)

_GENERATED_NAME = re.compile(
    r"\.pb(?:\.gw|\.validate)?\.go$|\.pb\.(?:cc|h)$|_pb2(?:_grpc)?\.pyi?$|_pb(?:_service)?\.(?:d\.)?[jt]sx?$|_grpc_pb\.[jt]s$|\.(?:gen|generated|g)\.\w+$|"
    r"_(?:gen|generated)\.\w+$|(?:^|/)zz_generated\.|(?:^|/)mocks?/mock_[^/]+$|(?:^|/)(?:gen|generated|__generated__)/", re.I)
_MINIFIED_NAME = re.compile(r"\.(?:min|bundle|chunk)\.(?:js|mjs|css)$|[-.][0-9a-f]{8,}\.(?:js|mjs|css)$", re.I)
_BLOB_NAME = re.compile(r"_(?:data|assets|blob|bindata)\.\w+$", re.I)
_VENDORED_PLACE = re.compile(
    r"(?:^|/)(?:vendor|node_modules|third_party|thirdparty|Godeps|bower_components|jspm_packages)/|^[^/]+/(?:extern|external|deps)/[^/]+/")

_COMMENT = re.compile(r"\s*(?://|#(?!!)|/\*|\*|--|<!--)")
_IDENT = re.compile(r"[A-Za-z_$][\w$]*")
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|[^\w\s]")

FEATURES = ("seen", "compression", "entropy", "ident_mean", "ident_single", "ident_distinct", "comments", "longest_line",
            "mean_line", "bytes_per_line", "lines", "bytes", "digits", "longest_token", "spaces", "shapes", "distinct_shapes")


def split_header(head: str) -> tuple[list[str], str]:
    """Comment lines before the first line of code, and the text from there on."""
    lines = head.replace("\r\n", "\n").split("\n")
    block, out = False, 0
    for i, line in enumerate(lines):
        s = line.strip()
        if block:
            block = "*/" not in s
        elif s.startswith("/*"):
            block = "*/" not in s
        elif s and not (s.startswith("//") or s.startswith("#") or s.startswith("--")):
            break
        out = i + 1
    return [x for x in lines[:out] if x.strip()], "\n".join(lines[out:])


def kept_by_hand(head: str | None) -> bool:
    """Whether a line of the header says so."""
    return bool(head) and any(_KEPT_BY_HAND.search(line) for line in split_header(head)[0])


def notice(head: str | None, house: str) -> int | None:
    """What the header says of the file; HAND for the house's own notice; None if nothing."""
    if not head:
        return None
    header, _ = split_header(head)
    own = False
    found: int | None = None
    kept = kept_by_hand(head)  # then another line's "do not modify" speaks of the template
    for line in header:
        if _BY_HAND.search(line):
            own = True
        elif _GENERATED_NOTICE.search(line):
            if not kept:
                return GENERATED
        elif _MINIFIED_NOTICE.search(line):
            found = MINIFIED
        elif _COPIED_NOTICE.search(line):
            found = VENDORED
        elif (m := _COPYRIGHT.search(line)):
            if house.lower() in line.lower():
                own = True
            elif m[1].strip():
                found = found or VENDORED
    return found if found is not None else HAND if own else None


def named(file: str) -> int | None:
    """What tools that name or place files say of it."""
    path = file.replace("\\", "/")
    if _VENDORED_PLACE.search(path):
        return VENDORED
    if _GENERATED_NAME.search(path):
        return GENERATED
    if _MINIFIED_NAME.search(path):
        return MINIFIED
    if _BLOB_NAME.search(path):
        return BLOB
    return None


def _entropy(counts: Counter) -> float:
    total = sum(counts.values())
    return -sum(c / total * math.log2(c / total) for c in counts.values()) if total else 0.0


def features(head: str | None, n_lines: float, n_bytes: float) -> list[float]:
    """Numbers on the content, the header comments taken off; -1 where nothing of it is seen."""
    size = [(n_bytes or 0) / max(1, n_lines or 0), math.log1p(max(0, n_lines or 0)), math.log1p(max(0, n_bytes or 0))]
    text = split_header(head)[1] if head else ""
    if not text.strip():
        return [0.0] + [-1.0] * 8 + size + [-1.0] * 5
    raw = text.encode("utf-8", "surrogatepass")
    lines = [x for x in text.split("\n") if x.strip()]
    idents = _IDENT.findall(text)
    tokens = Counter(_TOKEN.findall(text))
    shapes = Counter(re.sub(r"\d+", "0", _IDENT.sub("a", x.strip())) for x in lines)
    return [
        1.0, len(zlib.compress(raw, 6)) / len(raw), _entropy(tokens),
        sum(map(len, idents)) / len(idents) if idents else 0.0,
        sum(len(x) == 1 for x in idents) / len(idents) if idents else 0.0,
        len(set(idents)) / len(idents) if idents else 0.0,
        sum(bool(_COMMENT.match(x)) for x in lines) / len(lines),
        float(max(map(len, lines))), sum(map(len, lines)) / len(lines), *size,
        sum(ch.isdigit() for ch in text) / len(text),
        float(max((len(x) for x in re.split(r"[^\w+/=]+", text)), default=0)),
        sum(ch.isspace() for ch in text) / len(text),
        _entropy(shapes), len(shapes) / len(lines),
    ]


def described(files: DataFrame, house: str) -> DataFrame:
    """file, notice, kept, named, features of every distinct path.

    Repeated rows count once. A null head leaves the sizes as features; a null path is left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({
                "file": f["file"],
                "notice": pd.array([notice(h, house) for h in f["head"]], dtype="Int32"),
                "kept": [kept_by_hand(h) for h in f["head"]],
                "named": pd.array([named(p) for p in f["file"]], dtype="Int32"),
                "features": [features(h, 0 if a != a else a, 0 if b != b else b)
                             for h, a, b in zip(f["head"], f["n_lines"], f["n_bytes"])],
            })

    once = files.filter("file is not null").groupBy("file").agg(
        F.max(F.struct("n_bytes", "n_lines", "head")).alias("r")).select("file", "r.head", "r.n_lines", "r.n_bytes")
    return once.mapInPandas(run, "file string, notice int, kept boolean, named int, features array<double>")


def labelled(rows: DataFrame, most: int = LABELLED_ROWS) -> DataFrame:
    """Rows that say what they are, as training rows: label and vector.

    Vendored code is written by hand, somewhere else: for the forest it is no example.
    Every row is given a second time as the forest sees a file without a head.
    """
    said = F.coalesce(F.when(F.col("notice") != VENDORED, F.col("notice")), F.when(F.col("named") != VENDORED, F.col("named")))
    known = rows.withColumn("label", said.cast("double")).filter("label is not null")
    n = known.count()
    if n > most:
        known = known.sample(False, most / n, SEED)
    blank = F.transform("features", lambda x, i: F.when((i >= 9) & (i <= 11), x).when(i == 0, F.lit(0.0)).otherwise(F.lit(-1.0)))
    both = known.select("label", F.explode(F.array("features", blank)).alias("features"))
    return both.select("label", array_to_vector("features").alias("vector"))


def classify(files: DataFrame, house: str, most: int = LABELLED_ROWS) -> DataFrame:
    """file, class, chance (of not being written by hand), by (what decided).

    The forest decides wherever content is seen, with two exceptions: a header that says the
    file is generated or kept by hand stands, and copies from elsewhere are told by notice or
    folder. Where nothing of the content is seen, the notice or the tool's name for the file
    stands. Files of an empty table give no row; where fewer than two classes are labelled
    notices and names are all there is.
    """
    from codeweft.session import checkpointed

    rows = checkpointed(described(files, house))
    train = labelled(rows, most)
    kinds = [r[0] for r in train.select("label").distinct().collect()]  # at most five
    if len(kinds) < 2:
        judged = rows.withColumn("chance", F.lit(None).cast("double")).withColumn("guess", F.lit(HAND))
    else:
        model = RandomForestClassifier(labelCol="label", featuresCol="vector", numTrees=TREES, maxDepth=DEPTH, maxBins=64,
                                       seed=SEED, subsamplingRate=0.8, minInstancesPerNode=2).fit(train)
        p = vector_to_array("probability")
        judged = (model.transform(rows.withColumn("vector", array_to_vector("features")))
                  .withColumn("chance", F.lit(1.0) - p[0]).withColumn("guess", F.col("prediction").cast("int"))
                  .withColumn("guess", F.when(F.col("chance") >= 0.5, F.when(F.col("guess") == HAND, GENERATED).otherwise(F.col("guess"))).otherwise(HAND)))
    unseen = F.lit(True) if len(kinds) < 2 else F.col("features")[0] != 1.0
    placed = F.when(F.col("named").isin(GENERATED, VENDORED) | F.col("notice").isNull(), F.col("named"))
    strong = (F.when(F.col("named") == VENDORED, F.lit(VENDORED)).when(F.col("notice").isin(GENERATED, VENDORED), F.col("notice"))
              .when(F.col("kept") & (F.col("notice") == HAND), F.lit(HAND)).when(unseen, F.coalesce(placed, F.col("notice"))))
    return judged.select(
        "file", F.coalesce(strong, F.col("guess")).alias("class"), "chance",
        F.when(strong == HAND, F.lit("house notice")).when(strong.isNotNull(), F.lit("notice or name")).otherwise(F.lit("forest")).alias("by"),
        F.col("guess").alias("forest_class"), "notice", "named")


def found(classes: DataFrame) -> DataFrame:
    """Paths that are not written by hand at the house."""
    return classes.filter(F.col("class") != HAND).select("file")
