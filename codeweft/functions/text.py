"""Column builders for identifiers, words, paths and signatures."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Words a full-text query leaves out (fixed values).
STOP_WORDS = ("a", "an", "the", "to", "for", "in", "on", "of", "and", "or", "is", "it", "add", "make", "how", "do", "i", "we", "my")
#: Capitalised keywords, which name no type (fixed values).
NO_TYPES = ("Break", "Case", "Chan", "Const", "Continue", "Default", "Defer", "Else", "Fallthrough", "For", "Func", "Go", "Goto", "If",
            "Import", "Interface", "Map", "Package", "Range", "Return", "Select", "Struct", "Switch", "Type", "Var")


def decompose(name: Column) -> Column:
    """Words of a camel-case name: split before every ASCII capital, in lower case."""
    return F.lower(F.regexp_replace(name, "(?<!^)([A-Z])", " $1"))


def is_compound(word: Column) -> Column:
    """snake_case or camelCase, at least three bytes."""
    return (F.octet_length(word) >= 3) & (word.rlike("[A-Za-z0-9]_[A-Za-z0-9]") | word.rlike("[a-z][A-Z]"))


def fields(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def trimmed(word: Column) -> Column:
    """Without what is not a letter, digit, _ or . at the edges."""
    return F.regexp_replace(word, r"^[^A-Za-z0-9_.]+|[^A-Za-z0-9_.]+$", "")


def compound_idents(text: Column) -> Column:
    """Distinct compound identifiers and names after the last dot, in order."""
    def of(w: Column, last: Column) -> Column:
        named = (F.length(last) >= 2) & (last.rlike("^[A-Z]") | last.contains("_"))
        return F.array_compact(F.array(F.when(is_compound(w), w), F.when(named, last)))

    # one step after another: what stands in an inner step is made once per word, not once per use
    words = F.transform(fields(text), trimmed)
    pairs = F.transform(words, lambda w: F.struct(w.alias("w"), F.regexp_extract(w, r"\.([^.]+)$", 1).alias("last")))
    return F.array_distinct(F.flatten(F.transform(pairs, lambda p: of(p["w"], p["last"]))))


def compound_parts(text: Column) -> Column:
    parts = F.transform(F.filter(fields(text), is_compound), lambda w: F.split(decompose(w), r"\s+"))
    return F.array_distinct(F.flatten(parts))


def is_precise(text: Column) -> Column:
    """Whether a task is one identifier (compound, or with a dot) and so asks for just that."""
    words = fields(text)
    word = trimmed(F.get(words, 0))
    return (F.size(words) == 1) & (is_compound(word) | word.contains("."))


def query_words(text: Column) -> Column:
    return F.filter(F.transform(fields(text), trimmed), lambda w: F.octet_length(w) >= 3)


def search_terms(text: Column) -> Column:
    """Distinct words of ASCII letters and digits without stop words, in order."""
    words = F.split(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", " ")), " +")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS)))


def tokens(text: Column) -> Column:
    """Distinct letter-and-digit words in lower case, as the text index keeps them."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def call_idents(body: Column) -> Column:
    """Exported names that are followed by a parenthesis."""
    found = F.regexp_extract_all(body, F.lit(r"([A-Za-z0-9_]+)[ \t]*\("), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: x.rlike("^[A-Z]")))


def called_names(body: Column) -> Column:
    """All names that are followed by a parenthesis, exported or not."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r"([A-Za-z0-9_]+)[ \t]*\("), F.lit(1)))


def type_idents(body: Column) -> Column:
    """Capitalised words with a small letter that may name types."""
    found = F.regexp_extract_all(body, F.lit(r"(?<![A-Za-z0-9_])([A-Z][A-Za-z0-9_]{2,})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: x.rlike("[a-z]") & ~x.isin(*NO_TYPES)))


def last_name(id_: Column) -> Column:
    return F.substring_index(id_, ".", -1)


def parent_id(id_: Column) -> Column:
    """Everything before the last dot; empty where there is none."""
    return F.regexp_extract(id_, r"^(.*)\.[^.]*$", 1)


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def plain_path(path: Column, root: str = "/work/checkout/") -> Column:
    """A path as the index spells it: slashes, none doubled, without the root of the checkout or a leading dot."""
    slashed = F.regexp_replace(path, r"[\\/]+", "/")
    return F.regexp_replace(slashed, f"^(?:{root}|\\./)", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def elide(id_: Column, module: str) -> Column:
    """Without the module's prefix."""
    return F.when(id_.startswith(module + "/"), id_.substr(F.lit(len(module) + 2), F.length(id_))).otherwise(id_)


def rpc_messages(signature: Column) -> tuple[Column, Column]:
    """What stands in the first parentheses, and in the first after ``returns``, as written."""
    return (F.trim(F.regexp_extract(signature, r"\(([^)]*)\)", 1)),
            F.trim(F.regexp_extract(signature, r"returns[^(]*\(([^)]*)\)", 1)))


def go_field_name(name: Column) -> Column:
    """pickup_time -> PickupTime."""
    parts = F.filter(F.split(name, "_"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))), "")


def is_generated(file: Column) -> Column:
    return file.endswith(".pb.go") | file.endswith(".pb.gw.go") | file.contains("/gen/")


def is_left_out(file: Column, head: Column) -> Column:
    """Whether a file is not indexed: in a hidden, vendored or generated folder, named or marked as generated in
    its first five lines. Files generated from proto definitions are kept, for they define interfaces. A null head says nothing."""
    proto = file.endswith(".pb.go") | file.endswith(".pb.gw.go")
    folder = F.exists(F.split(file, "/"), lambda p: p.startswith(".") | p.isin("vendor", "gen", "generated"))
    marked = F.exists(F.slice(F.split(F.coalesce(head, F.lit("")), "\n"), 1, 5), lambda x: x.contains("Code generated"))
    return ~proto & (folder | file.endswith("_gen.go") | file.endswith("_generated.go") | marked)


def declaration(source: Column) -> Column:
    """A declaration from the start of a text to the line that closes its first braces; the first line
    alone where that opens none, the whole text where they are never closed."""
    lines = F.split(source, "\n")
    n = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(False).alias("opened"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        depth, opened = s["depth"] + n(x, "{") - n(x, "}"), s["opened"] | x.contains("{")
        done = (opened & (depth <= 0)) | ((s["n"] == 0) & ~opened)
        return F.when(s["done"], s).otherwise(F.struct((s["n"] + 1).alias("n"), depth.alias("depth"), opened.alias("opened"), done.alias("done")))

    return F.array_join(F.slice(lines, F.lit(1), F.aggregate(lines, start, step)["n"]), "\n")


def is_test(file: Column) -> Column:
    return file.endswith("_test.go")


def layer(file: Column) -> Column:
    return (F.when(file.endswith(".proto"), "proto").when(is_generated(file), "generated")
            .when(is_test(file), "test").otherwise("implementation"))


def is_line_reference(body: Column) -> Column:
    return (body == "") | body.startswith("/*")


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end of a text, counted from 1, inclusive."""
    return F.array_join(F.slice(F.split(text, "\n"), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def token_estimate(text: Column) -> Column:
    return (F.octet_length(text) / 4).cast("long")


def embedding_text(signature: Column, docstring: Column) -> Column:
    return F.when(F.coalesce(docstring, F.lit("")) == "", signature).otherwise(F.concat_ws("\n", signature, docstring))
