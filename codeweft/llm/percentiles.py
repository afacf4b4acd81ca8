"""Percentiles of very large numeric columns by radix selection.

Values become order-preserving integers: the bits of a double, negatives inverted; whole numbers
are their own. Per
group a histogram of the leading bits is counted; only the bucket that holds a target rank
is opened and counted by its next bits, until it holds a single value. Histograms of
separate days or partitions add up bucket by bucket.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from codeweft.session import checkpointed

#: Leading bits of the first histogram: sign, 11 of exponent, 8 of mantissa, so that any
#: value of a bucket is within 2**-8 of any other.
FIRST_BITS = 20
NEXT_BITS = 22


@F.pandas_udf(T.LongType())
def order_key(v: pd.Series) -> pd.Series:
    """Signed integer that sorts as the double does; -0.0 as 0.0; NaN and null: null."""
    x = v.to_numpy(dtype="float64", na_value=np.nan) + 0.0
    bits = x.view("int64")
    keys = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
    return pd.Series(keys).astype("Int64").mask(np.isnan(x))


@F.pandas_udf(T.DoubleType())
def key_value(k: pd.Series) -> pd.Series:
    """Inverse of order_key."""
    keys = k.to_numpy(dtype="int64", na_value=0)
    bits = np.where(keys < 0, keys ^ np.int64(0x7FFFFFFFFFFFFFFF), keys)
    return pd.Series(bits.view("float64")).mask(k.isna().to_numpy())


def _bucket(bits: int, whole: bool = False):
    """The leading bits of a key: of the double's 64, or of those that a whole number has from its
    highest on (FIRST_BITS less the twelve of sign and exponent after that)."""
    if not whole:
        return F.shiftright("key", 64 - bits)
    if bits > 64:
        return F.col("key")
    size = F.abs(F.greatest(F.col("key"), F.lit(-(2**63 - 1))))
    high = F.coalesce(F.floor(F.log2(size.cast("double"))), F.lit(-1)).cast("int")  # any monotone estimate does
    top = F.call_function("shiftright", size, F.greatest(high - (bits - 12), F.lit(0)))
    place = (high + 1).cast("long") * (1 << bits - 10) + top
    return F.when(F.col("key") < 0, -place).otherwise(place)


def keyed(df: DataFrame, groups: list[str], value: str, whole: bool = False) -> DataFrame:
    """groups and key of every row whose value is neither null nor NaN. whole: the value is an
    integer column (bigint, int) and is exact to its last digit."""
    key = F.col(value).cast("long") if whole else order_key(F.col(value).cast("double"))
    return df.select(*groups, key.alias("key")).filter("key is not null")


def _value(key: str, whole: bool):
    return F.col(key) if whole else key_value(key)


def histogram(keys: DataFrame, groups: list[str], bits: int = FIRST_BITS, whole: bool = False) -> DataFrame:
    """Mergeable state: per group and bucket of leading bits the count, least and greatest key."""
    return keys.groupBy(*groups, _bucket(bits, whole).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))


def merge(states: DataFrame, groups: list[str]) -> DataFrame:
    """State of coarser groups out of the states of finer ones (days, partitions, files)."""
    return states.groupBy(*groups, "bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _locate(state: DataFrame, groups: list[str], quantiles: list[float]) -> DataFrame:
    """Bucket of every nearest-rank target; rank becomes the rank within the bucket.

    The window runs over buckets, never over rows: a group has at most a few thousand.
    """
    w = Window.partitionBy(*groups).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = state.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*groups)))
    targets = F.explode(F.array(*[
        F.struct(F.lit(q).alias("q"), F.greatest(F.ceil(F.lit(q).cast("double") * F.col("total")), F.lit(1)).alias("target"))
        for q in quantiles]))
    return (
        ranked.select("*", targets.alias("t"))
        .filter((F.col("t.target") <= F.col("upto")) & (F.col("t.target") > F.col("upto") - F.col("n")))
        .select(*groups, F.col("t.q").alias("q"), "total", "bucket", "lo", "hi",
                (F.col("t.target") - F.col("upto") + F.col("n")).alias("rank"))
    )


def bounds(state: DataFrame, groups: list[str], quantiles: list[float], whole: bool = False) -> DataFrame:
    """Percentiles from a state alone: the value lies between low and high, at most 2**-8 apart."""
    return _locate(state, groups, quantiles).select(
        *groups, "q", F.col("total").alias("n"), _value("lo", whole).cast("double").alias("low"), _value("hi", whole).cast("double").alias("high"))


def select(keys: DataFrame, groups: list[str], quantiles: list[float], whole: bool = False) -> DataFrame:
    """Exact nearest-rank percentiles: groups, q, n, value.

    keys: output of ``keyed``; it is written once, as narrow columns, and read once per pass,
    two or three passes in all; only the rows of opened buckets go on. Group columns may be null (one group). Groups
    without values give no row; ties and repeats count each; an empty table gives none.
    """
    keys = checkpointed(keys)
    found = checkpointed(_locate(histogram(keys, groups, whole=whole), groups, quantiles))
    done, bits = [found.filter("lo = hi")], FIRST_BITS
    open_ = found.filter("lo < hi")
    rest = keys.withColumn("bucket", _bucket(bits, whole))
    while not open_.isEmpty():
        buckets = open_.select(*groups, "bucket").distinct()
        a, b = rest.alias("a"), buckets.alias("b")
        same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups]
        rest = a.join(b, [*same, F.col("a.bucket") == F.col("b.bucket")], "left_semi")
        bits = bits + NEXT_BITS if whole else min(64, bits + NEXT_BITS)
        sub = rest.groupBy(*groups, F.col("bucket").alias("parent"), _bucket(bits, whole).alias("bucket")).agg(
            F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        w = Window.partitionBy(*groups, "parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = sub.withColumn("upto", F.sum("n").over(w)).alias("s")
        t = open_.withColumnRenamed("bucket", "parent").alias("t")
        hit = [F.col(f"s.{g}").eqNullSafe(F.col(f"t.{g}")) for g in groups] + [F.col("s.parent") == F.col("t.parent")]
        found = checkpointed(
            ranked.join(t, hit)
            .filter("t.rank <= s.upto and t.rank > s.upto - s.n")
            .select(*[f"t.{g}" for g in groups], "t.q", "t.total", "s.bucket", "s.lo", "s.hi",
                    F.expr("t.rank - s.upto + s.n").alias("rank")))
        done.append(found.filter("lo = hi"))
        open_ = found.filter("lo < hi")
        rest = rest.withColumn("bucket", _bucket(bits, whole))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*groups, "q", F.col("total").alias("n"), _value("lo", whole).alias("value"))


METRICS = ("duration_ms", "estimated_tokens")
QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def measures(telemetry: DataFrame) -> DataFrame:
    """metric, tool, day, value of session telemetry.

    A redelivered event (same event_no, all columns equal) counts once. Tools are compared
    trimmed and in lower case; a null tool is the group null. Null and negative values are
    no measurements; zero and very large ones are.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("value")) for m in METRICS])
    once = telemetry.select("event_no", "recorded_at", "tool", *METRICS).distinct()
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros("recorded_at") / 86_400_000_000).cast("int"))  # whatever the session's time zone
    return (
        once.select(F.lower(F.trim("tool")).alias("tool"), day.alias("day"), F.explode(pairs).alias("p"))
        .select("p.metric", "tool", "day", "p.value").filter("value >= 0")
    )


def wide(rows: DataFrame, groups: list[str]) -> DataFrame:
    """One row per group with a column for each of QUANTILES."""
    cols = [F.max(F.when(F.col("q") == q, F.col("value"))).cast("long").alias(name) for name, q in QUANTILES.items()]
    return rows.groupBy(*groups).agg(F.max("n").alias("n"), *cols)


def day_states(telemetry: DataFrame) -> DataFrame:
    """The state of every metric, tool and day, to be kept and merged."""
    groups = ["metric", "tool", "day"]
    return histogram(keyed(measures(telemetry), groups, "value", whole=True), groups, whole=True)
