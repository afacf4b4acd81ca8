"""Lookups of symbols, each for a whole table of keys at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from codeweft.functions import text

GRAM = 8


def first_per(df: DataFrame, by: list[str], order: list, n: int, pos: str = "pos") -> DataFrame:
    """The first n rows of every group; Spark prunes before the shuffle and again after it."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(pos, F.row_number().over(w)).filter(F.col(pos) <= n)


def by_name(symbols: DataFrame, n: int = 10) -> DataFrame:
    """The n earliest symbols of every name."""
    return first_per(symbols, ["name"], ["seq"], n)


def by_file(symbols: DataFrame) -> DataFrame:
    """Symbols of every file in order of their lines."""
    w = Window.partitionBy("file").orderBy("line_start", "seq")
    return symbols.withColumn("pos", F.row_number().over(w))


def files_with_extension(symbols: DataFrame, *extensions: str) -> DataFrame:
    return symbols.filter(F.lower(text.extension(F.col("file"))).isin(*extensions)).select("file").distinct()


def children(symbols: DataFrame, *kinds: str) -> DataFrame:
    """parent_id, id of every symbol of the kinds whose id lies under that of another symbol."""
    child = symbols.filter(F.col("kind").isin(*kinds)).select(text.parent_id(F.col("id")).alias("parent"), "id", "kind")
    return child.join(symbols.select(F.col("id").alias("parent"), F.col("kind").alias("parent_kind")), "parent")


def names_containing(symbols: DataFrame, needles: DataFrame, n: int = 25) -> DataFrame:
    """needle, id, name of the n shortest names that contain a needle and are not it.

    Instead of comparing every needle with every name, names are cut into runs of GRAM
    letters and met with the needles that begin with that run; then the whole is compared.
    Case does not count within, but a name that differs from the needle only by case counts.
    Needles shorter than GRAM are met with runs of their own length.
    """
    low = F.lower(F.col("name"))

    def runs(size: int):
        positions = F.sequence(F.lit(1), F.greatest(F.length(low) - (size - 1), F.lit(1)))
        return F.array_distinct(F.transform(positions, lambda i: F.substring(low, i, F.lit(size))))

    wanted = needles.filter("needle <> ''").select("needle", F.substring(F.lower("needle"), 1, GRAM).alias("gram")).distinct()
    long = symbols.filter(F.length(low) >= GRAM).select("id", "name", F.explode(runs(GRAM)).alias("gram"))
    hits = long.join(wanted.filter(F.length("gram") >= GRAM), "gram").filter(F.contains(low, F.lower("needle")) & (F.col("name") != F.col("needle")))
    every = hits.select("needle", "id", "name")
    short = wanted.filter(F.length("gram") < GRAM)
    for size in (r["size"] for r in short.select(F.length("gram").alias("size")).distinct().collect()):  # at most GRAM - 1
        part = symbols.filter(F.length(low) >= size).select("id", "name", F.explode(runs(size)).alias("gram"))
        met = part.join(short.filter(F.length("gram") == size), "gram").filter(F.col("name") != F.col("needle"))
        every = every.unionByName(met.select("needle", "id", "name"))
    return first_per(every, ["needle"], [F.length("name"), "id"], n)


def best_candidate_score(package, query):
    """Of candidates of one name: generated ones last, then by how the package fits the query."""
    low = F.lower(package)
    base = F.when(low.contains("/gen/") | low.contains("unimplemented"), F.lit(-2.0)).otherwise(F.lit(0.0))
    fit = F.when(F.contains(F.lower(query), low) & (package != ""), F.octet_length(package).cast("double")).otherwise(F.lit(0.0))
    return base + fit + F.when(low.rlike("svc|server|service"), F.lit(1.0)).otherwise(F.lit(0.0))


def without_paths(symbols: DataFrame, *parts: str) -> DataFrame:
    """Symbols whose package path holds none of the parts."""
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.col("package").contains(p)
    return symbols.filter(~hit)


def fuzzy(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """query, id, tier: the symbol a possibly shortened id means.

    Tier 1 is the id itself, tier 2 the shortest id that ends with the query, tier 3 a
    symbol of the query's last name, by package. The first tier with an answer counts. An
    id that ends with a dotted query has the query's last name, so tiers 2 and 3 are one
    equi-join on it. A query without a dot must be a whole last name: ends of words are not
    looked for.
    """
    q = queries.filter("query <> ''").select("query").distinct().withColumn("last", F.lower(text.last_name(F.col("query"))))
    s = symbols.select("id", "name", "package", "seq")
    exact = q.join(s, F.col("query") == F.col("id")).select("query", "id", F.lit(1).alias("tier"), F.lit(0.0).alias("score"), "seq")
    near = q.join(s.withColumn("last", F.lower(text.last_name(F.col("id")))), "last")
    suffix = near.filter(F.endswith(F.lower("id"), F.lower("query"))).select(
        "query", "id", F.lit(2).alias("tier"), F.length("id").cast("double").alias("score"), "seq")
    named = near.filter(F.col("name") == text.last_name(F.col("query"))).select(
        "query", "id", F.lit(3).alias("tier"),
        (-F.greatest(best_candidate_score(F.col("package"), F.col("query")), F.lit(-1.0))).alias("score"), "seq")
    every = exact.unionByName(suffix).unionByName(named)
    return first_per(every, ["query"], ["tier", "score", "seq", "id"], 1).select("query", "id", "tier")


def expand_ids(symbols: DataFrame, queries: DataFrame, module: str) -> DataFrame:
    """query, id: the symbol that a full id, or one without the module's prefix, names."""
    q = queries.filter("query <> ''").select("query").distinct()
    ids = symbols.select("id")
    whole = q.join(ids, F.col("query") == F.col("id"))
    return whole.unionByName(q.join(whole.select("query"), "query", "left_anti").join(ids, F.concat(F.lit(module + "/"), F.col("query")) == F.col("id")))
