"""Scores of retrieval: one place for every weight. All are doubles, added in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codeweft.functions import text

#: Fixed values.
KIND_WEIGHT = {"method": 0.3, "func": 0.2, "interface": 0.1, "struct": -0.3, "type": -0.2, "const": -0.2, "var": -0.2, "field": -0.6}
EXACT, CONTAINS, AFFINITY = 3.0, 2.0, 0.75
CALLER, CALLEE = 0.4, 0.3


def num(x: float) -> Column:
    return F.lit(float(x))


def kind_weight(kind: Column) -> Column:
    out = F.when(F.lit(False), num(0))
    for k, w in KIND_WEIGHT.items():
        out = out.when(kind == k, num(w))
    return out.otherwise(num(0))


def name_bonus(kind: Column) -> Column:
    return F.when(kind.isin("func", "method"), num(1.0)).when(kind == "interface", num(0.7)).otherwise(num(0.3))


def impl_boost(kind: Column, package: Column) -> Column:
    served = F.lower(package).rlike("svc|server|service")
    return F.when(kind.isin("func", "method") & served, num(0.5)).otherwise(num(0))


def generated_penalty(file: Column) -> Column:
    return F.when(file.endswith(".pb.go") | file.endswith(".pb.gw.go"), num(-0.6)).otherwise(num(0))


def searchable(s: str = "") -> Column:
    c = lambda n: F.col(f"{s}{n}")
    return F.lower(F.concat_ws(" ", c("name"), text.decompose(c("name")), c("package"), c("signature"), c("docstring")))


def term_coverage(terms: Column, haystack: Column) -> Column:
    """1.5 (m/t)**2 where more than one of more than one terms occurs, else 0."""
    m = F.size(F.filter(terms, lambda t: F.contains(haystack, t))).cast("double")
    share = m / F.size(terms)
    return F.when((F.size(terms) <= 1) | (m <= 1), num(0)).otherwise(share * share * num(1.5))


def _of(value: Column, f) -> Column:
    """f of a value that is made once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def asked_words(words: Column) -> Column:
    """A query's words as affinity asks for them, in lower case: the distinct ones without a dot, the repeats
    of these, and those with a dot. Made once per query, so that no symbol is met with every word one by one."""
    # sorted, so that a word is a repeat where the one before it is the same
    sides = _of(F.sort_array(F.filter(F.transform(words, F.lower), lambda w: ~w.contains("."))), lambda p: F.struct(
        F.array_distinct(p).alias("plain"), F.filter(p, lambda w, i: (i > 0) & (F.get(p, i - 1) == w)).alias("again")))
    return F.struct(sides["plain"].alias("plain"), sides["again"].alias("again"),
                    F.filter(F.transform(words, F.lower), lambda w: w.contains(".")).alias("dotted"))


def affinity(said: Column, id_: Column, own: Column) -> Column:
    """0.75 for each other query word (see asked_words) that is a segment of the id, or, dotted, a part of it."""
    def of(x: Column) -> Column:
        segments = F.array_remove(F.array_distinct(F.split(x["low"], "[./]")), x["own"])
        plain = _of(F.array_intersect(segments, said["plain"]), lambda found: F.size(found) + F.size(F.filter(said["again"], lambda w: F.array_contains(found, w))))
        return plain + F.size(F.filter(said["dotted"], lambda w: (w != x["own"]) & F.contains(x["low"], w)))

    return _of(F.struct(F.lower(id_).alias("low"), F.lower(own).alias("own")), of) * num(AFFINITY)


def cost_brief() -> Column:
    return ((F.octet_length("id") + F.octet_length("kind") + F.octet_length("signature") + F.octet_length("file") + 20) / 4).cast("long")


def cost_verbose() -> Column:
    return ((F.octet_length("signature") + F.octet_length("docstring") + F.octet_length("id") + F.octet_length("why")
             + F.octet_length("file") + 110) / 4).cast("long")
