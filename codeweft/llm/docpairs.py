"""Functions paired with their documentation, read by island grammars.

Per language only the islands are parsed: documentation, annotations, the signature and the
balanced body; all other code is water that is passed over. Documentation that says no more
than the name does is trivial, and its function is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

LINE_REFERENCE = re.compile(r"\s*(?:/\*|//|#)\s*[^\s*]+:\d+(?:-\d+)?\s*(?:\*/)?\s*")

#: Words that carry no statement of their own beside a name.
FILLER = frozenset("""
the a an is are be was were it its this that these those which who of for to in on with by from at as and or
function func fn method procedure routine member callable implementation implements implement implementing
does do did done performs perform performing performed operation operations nothing else say here just simply
simple basic main handles handle handling handler helper name named description descriptions desc summary
parameter parameters param params argument arguments arg args return returns returned returning result results
input inputs output outputs value values given provided corresponding class object type string number int bool
boolean void any float byte bytes constructor getter setter accessor wrapper
""".split())
DIRECTIVE = re.compile(
    r"^\s*(?:nolint\b|go:\w+|\+build\b|eslint\b|eslint-|tslint:|@ts-|prettier-ignore|istanbul\b|c8 ignore|noqa\b|"
    r"pylint:|type:\s*ignore|mypy:|flake8:|pragma\b|noinspection|@inheritdoc\b|\{@inheritdoc\}|@override\b|@internal\b|"
    r"@generated\b|lint:|coverage:|fmt:\s*(?:off|on)|isort:|black:|#region|#endregion|biome-ignore|swagger:|"
    r"export\s+\w+\s*$|line\s+\S+:\d+)", re.I)
TASK = re.compile(r"^\s*\W*(?:TODO|FIXME|XXX|HACK|TBD|WIP|BUG|Deprecated\s*:|@deprecated)\b", re.I)
PLACEHOLDER = re.compile(
    r"^\W*(?:n\s*/\s*a|none|tbd|tba|todo|undocumented|no (?:description|documentation|comment|docs?)(?: (?:yet|available|provided|needed))*|"
    r"(?:add|write|insert|put|missing|your)\b.{0,40}\b(?:description|documentation|comment|docs?|doc comment|docstring)\b.{0,60}|"
    r"(?:description|documentation|comment|docs?)\b.{0,20}\b(?:here|missing|pending|to follow|goes here|to be written|to be added).{0,40}|"
    r"(?:this (?:text|comment) is )?(?:only |just )?a? ?placeholder\b.{0,40}|lorem ipsum.*|document (?:this|me)|self[- ]explanatory|as the name says)\W*$", re.I)
POINTER = re.compile(
    r"^\W*(?:please\s+|for (?:more |further )?(?:details|information)[, ]+)?(?:also\s+)?(?:@?see\b|refer\s+to\b|consult\b|read\b.{0,30}\bdocs?\b|cf\b|siehe\b|vgl\b|voir\b|"
    r"véase\b|ver\s+(?:o|a|el|la)\b|consulte\b|veja\b|см\b|смотри|@link\b|documented (?:in|at|on|elsewhere)|described (?:in|at|on|elsewhere)|same as above|as above|ditto|"
    r"(?:more |further )?(?:details|information|documentation|docs?) (?:is|are|can be found)? ?(?:in|at|on)\b)", re.I)
POINTER_CJK = re.compile(r"参照(?:して|のこと|ください|。|$)")
CODE_LINE = re.compile(
    r"^\s*(?:return\s+[\w.()\[\]&*\"']+(?:\s*,\s*[\w.()\[\]&*\"']+)*;?|return;?|[\w.\[\]\"', ]+\s*(?::=|[-+*/|&]?=)\s*\S.*|"
    r"[\w.]*[\w]\([^)]*\)(?:\.[\w]+\([^)]*\))*;?|[{}()\[\];]+|.*[;{]\s*|\}\s*else.*|(?:if|for|while|switch)\b.*[{:]\s*|"
    r"(?:const|let|var|func|def|import|package|type|defer|go)\s+[\w.]+\s*[=(:{].*)$")
_MARK = re.compile(r"^\s*(?:/\*+|\*+/|\*(?!\*)|//+!?|#+(?!\w)|--)?\s?|\s*\*+/\s*$")
_WORD = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+|\d+")


def words_of(identifier: str) -> set[str]:
    return {w.lower() for w in _CAMEL.findall(identifier) if not w.isdigit()}


def _forms(word: str) -> list[str]:
    """The word and what it may be inflected from."""
    out = [word]
    for end, back in (("ies", "y"), ("es", ""), ("es", "e"), ("s", ""), ("ied", "y"), ("ed", ""), ("ed", "e"), ("d", ""),
                      ("ing", ""), ("ing", "e"), ("er", ""), ("er", "e"), ("or", "e")):
        if word.endswith(end) and len(word) > len(end) + 1:
            stem = word[:-len(end)] + back
            out.append(stem)
            if back == "" and len(stem) > 2 and stem[-1] == stem[-2]:
                out.append(stem[:-1])
    return out


def parameters(signature: str) -> tuple[set[str], set[str]]:
    """Names of the parameters; words of receiver and parameters."""
    head = re.match(r"\s*func\s*\(([^)]*)\)", signature)
    receiver = set(words_of(head[1])) if head else set()
    rest = signature[head.end():] if head else signature
    inner = re.search(r"\(([^)]*)\)", rest)
    names = set()
    for part in (inner[1].split(",") if inner else []):
        m = re.match(r"\s*(?:\.\.\.|\*{1,2}|readonly |public |private )?([A-Za-z_$][\w$]*)", part)
        if m:
            names.add(m[1])
    return names, receiver.union({"ctx", "self"}, *(words_of(n) for n in names))


def statement(doc: str, name: str, signature: str) -> str:
    """What the documentation states beyond form, tasks, directives, pointers and code."""
    kept, skip = [], False
    for line in doc.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = _MARK.sub("", line)
        if not line.strip():
            skip = False
            continue
        if TASK.match(line):
            skip = True  # to the end of its paragraph
        if skip or DIRECTIVE.match(line) or CODE_LINE.match(line):
            continue
        kept.append(line.strip())
    text = "\n".join(kept)
    out = []
    for s in re.split(r"(?<=[.!?])\s+|(?<=[。！？])|\n", text):
        if not s.strip() or PLACEHOLDER.match(s) or POINTER.match(s) or POINTER_CJK.search(s):
            continue
        out.append(s.strip())
    return "\n".join(out)


def is_trivial(doc: str | None, name: str, signature: str) -> bool:
    """Whether the documentation says nothing that the name does not."""
    if not doc or not doc.strip():
        return True
    text = statement(doc, name, signature)
    if not text:
        return True
    names, known = parameters(signature)
    known = known | words_of(name)
    text = re.sub(r"https?://\S+|\{[^{}\n]*\}|@\w+|<[^<>\n]*>", " ", text)
    for token in _WORD.findall(text.replace(name, " ") if name else text):
        if token in names:
            continue
        for w in _CAMEL.findall(token):
            w = w.lower()
            if w.isdigit() or w in FILLER or len(w) == 1 and w.isascii():
                continue
            if not any(f in known for f in _forms(w)):
                return False
    return True


#: Which grammar reads a file, by its extension (fixed values).
LANGUAGES = {"py": "python", "pyi": "python", "go": "go", "ts": "script", "tsx": "script", "js": "script", "jsx": "script", "mjs": "script", "cjs": "script",
             "java": "java", "kt": "java", "scala": "java", "proto": "proto"}


def _language(file: str) -> str:
    return LANGUAGES.get(file.rpartition(".")[2].lower() if file else "", "braces")


def _skip_string(s: str, i: int, raw: str) -> int:
    """Index after the string literal that starts at i; marks in ``raw`` know no escapes and may span lines."""
    q, n = s[i], len(s)
    if s.startswith(q * 3, i) and q != "`":
        end = s.find(q * 3, i + 3)
        return n if end < 0 else end + 3
    i += 1
    while i < n and s[i] != q:
        if s[i] == "\n" and q != "`":
            return i  # not a literal after all (an apostrophe)
        i += 2 if s[i] == "\\" and q not in raw else 1
    return min(n, i + 1)


def _skip_template(s: str, i: int) -> int:
    """Index after the template string that starts at i; what stands in ${...} is code, templates included."""
    i, n = i + 1, len(s)
    while i < n and s[i] != "`":
        if s.startswith("${", i):
            end = _balanced(s, i + 1, "script")
            i = n if end < 0 else end
        else:
            i += 2 if s[i] == "\\" else 1
    return min(n, i + 1)


_PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_VALUE_BEFORE = re.compile(r"(?:[\w$)\]}\"'`])\s*$")
_OPERATOR_WORD = re.compile(r"\b(?:return|typeof|case|in|of|do|else|void|delete|throw|new|instanceof|yield|await)\s*$")
_ISLAND = re.compile(r"[\"'`]|//[^\n]*|/\*.*?(?:\*/|\Z)|[{}()\[\]]", re.S)
_SCRIPT_ISLAND = re.compile(r"[\"'`]|//[^\n]*|/\*.*?(?:\*/|\Z)|[{}()\[\]/]", re.S)


def _balanced(s: str, start: int, language: str = "braces") -> int:
    """End of the first balanced {...} after start, literals and comments being water; -1 if none.

    Go: `raw` strings and runes. Script: template strings with code inside, regular expressions.
    Java: text blocks. Proto: a declaration may end with ; in place of a body.
    """
    depth, i, n = 0, start, len(s)
    island = _SCRIPT_ISLAND if language == "script" else _ISLAND
    while (m := island.search(s, i)):
        if language == "proto" and depth == 0 and (stop := s.find(";", i, m.start())) >= 0:
            return stop + 1
        c, i = m[0], m.end()
        if c == "`" and language == "script":
            i = _skip_template(s, m.start())
        elif c in "\"'`":
            i = _skip_string(s, m.start(), "`")
        elif c == "/":
            before = s[max(0, m.start() - 40):m.start()]
            if (not _VALUE_BEFORE.search(before) or _OPERATOR_WORD.search(before)) and (r := _PATTERN.match(s, m.start())):
                i = r.end()
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return i
    if language == "proto" and depth == 0 and (stop := s.find(";", i)) >= 0:
        return stop + 1
    return n if depth > 0 else -1


_LEAD = re.compile(r"[ \t]*(?://[^\n]*|/\*.*?(?:\*/|\Z))[ \t]*(?:\n|\Z)|[ \t]*\n", re.S)
_ANNOTATION = re.compile(r"[ \t]*@\w[\w.]*(?:\([^)\n]*\))?[ \t]*\n")
_PY_LEAD = re.compile(r"[ \t]*#[^\n]*(?:\n|\Z)|[ \t]*\n|[ \t]*@[^\n]*\n")
_PY_DEF = re.compile(r"[ \t]*(?:async\s+)?def\s+\w+\s*\(")
_PY_STRING = re.compile(r"\s*[rRuUbB]{0,2}(\"\"\"|'''|\"|')")


def parse_function(body: str, file: str) -> tuple[str | None, str]:
    """Documentation that lies in the body, and the code without it ('' where there is none)."""
    body = body.replace("\r\n", "\n")
    i = 0
    if _language(file) == "python":
        while (m := _PY_LEAD.match(body, i)) and m.end() > i:
            i = m.end()
        d = _PY_DEF.match(body, i)
        if not d:
            return None, body[i:].strip()
        depth, j = 1, d.end()
        while j < len(body) and depth:
            c = body[j]
            if c in "\"'":
                j = _skip_string(body, j, "")
                continue
            depth += (c in "([{") - (c in ")]}")
            j += 1
        colon = body.find(":\n", j)
        colon = len(body) if colon < 0 else colon + 1
        s = _PY_STRING.match(body, colon)
        if not s:
            return None, body[i:].strip()
        end = _skip_string(body, s.start(1), "")
        q = len(s[1])
        return body[s.end(1):end - q], (body[i:colon] + body[end:]).strip()
    doc: list[str] = []
    while (m := _LEAD.match(body, i)) and m.end() > i:
        piece = m[0]
        if not piece.strip():
            doc = []  # a blank line: what came before is not directly before
        elif not LINE_REFERENCE.fullmatch(piece):
            if piece.lstrip().startswith("/*"):
                doc = []  # a block stands alone
            doc.append(piece)
        i = m.end()
    start = i
    while (m := _ANNOTATION.match(body, i)):
        i = m.end()
    end = _balanced(body, i, _language(file))
    code = body[start:] if end < 0 else body[start:end]
    return "".join(doc) if doc else None, code.strip()


def pair(name: str, signature: str, docstring: str | None, file: str, body: str) -> tuple[str, str] | None:
    """(code, description) of one function, or None where either is wanting."""
    if not body or not body.strip() or LINE_REFERENCE.fullmatch(body):
        return None
    inner, code = parse_function(body, file or "")
    if not code:
        return None
    doc = docstring if docstring and docstring.strip() else inner
    if is_trivial(doc, name or "", signature or ""):
        return None
    return code, statement(doc, name or "", signature or "")


def documented(symbols: DataFrame, with_text: bool = True) -> DataFrame:
    """seq, id, found, code, description of every row of symbols.

    The work is per row and happens before the choice of current rows, so that no body has
    to be shuffled for it. Kinds other than func and method, empty bodies, bodies that are
    a line reference only, and null names count as not found. Very long bodies are scanned
    whole, in time in proportion to their length. Extra columns are not read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [pair(*r[1:]) if r[0] in ("func", "method") else None
                    for r in zip(f["kind"], f["name"], f["signature"], f["docstring"], f["file"], f["body"])]
            out = pd.DataFrame({"seq": f["seq"], "id": f["id"], "found": [r is not None for r in rows]})
            out["code"] = [r[0] if r and with_text else None for r in rows]
            out["description"] = [r[1] if r and with_text else None for r in rows]
            yield out

    cols = symbols.select("seq", "id", "kind", "name", "signature", "docstring", "file", "body")
    return cols.mapInPandas(run, "seq long, id string, found boolean, code string, description string")


def found_pairs(symbols: DataFrame) -> DataFrame:
    """seq of the current rows that make a pair."""
    top = documented(symbols, with_text=False).groupBy("id").agg(F.max(F.struct("seq", "found")).alias("r"))
    return top.filter("r.found").select("r.seq")


def pairs(symbols: DataFrame) -> DataFrame:
    """seq, code, description of the current rows that make a pair; repeated rows once."""
    top = symbols.groupBy("id").agg(F.max("seq").alias("seq")).select("seq")
    return (documented(symbols).filter("found").join(top, "seq", "left_semi")
            .dropDuplicates(["seq"]).select("seq", "code", "description"))
