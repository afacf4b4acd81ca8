"""Long exact spans shared between records.

Rabin-Karp hashes of all windows of a fixed length are rolled over every text. Of each run of
consecutive windows that together span the least length looked for, the least hash stands for
the run, so two texts with a common span of that length have a representative in common, and
one row in some thirty goes into the counts. Windows whose representative is repeated are hashed at
full length, in the same way with other character values, and counted; a repeated one lies in a
shared span, and overlapping ones merge into maximal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codeweft.session import checkpointed

LEAST = 200
WINDOW = 150
#: Characters hashed at a time in a task, whole texts each (a longer text is taken alone).
SLICE = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Roller:
    """Hashes of all windows of a slice of texts and their representatives."""

    def __init__(self, window: int = WINDOW, least: int = LEAST):
        self.window, self.least, self.run = window, least, least - window + 1
        self.grow(SLICE + 4096)

    def grow(self, n: int) -> None:
        self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)

    def windows(self, texts: list[str], length: int, values: int) -> np.ndarray:
        """Hash of every window of ``length`` characters of the texts laid end to end. values: which
        of the independent numberings of characters is hashed."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        n = len(codes)
        if n < length:
            return np.zeros(0, dtype=np.uint64)
        if n + 1 > len(self.up):
            self.grow(2 * n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_mix(codes + np.uint64(values)) * self.up[:n], dtype=np.uint64, out=sums[1:])
        return _mix((sums[length:] - sums[:-length]) * self.down[:n - length + 1])

    def representatives(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For every position of the texts laid end to end: whether a span of ``least`` starts
        there and stays within its text, and the representative hash of that span."""
        n = sum(map(len, texts))
        if n < self.least:
            return np.zeros(n, dtype=bool), np.zeros(n, dtype=np.uint64)
        h = self.windows(texts, self.window, 1)
        low, span = h, 1
        while 2 * span <= self.run:  # least of a run, by doubling
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < self.run:
            low = np.minimum(low[:len(low) - (self.run - span)], low[self.run - span:])
        ends = np.cumsum([len(t) for t in texts])
        starts_ok = np.zeros(n + 1, dtype=np.int32)
        begin = ends - [len(t) for t in texts]
        long = (ends - begin) >= self.least
        np.add.at(starts_ok, begin[long], 1)
        np.add.at(starts_ok, ends[long] - self.least + 1, -1)
        valid = np.cumsum(starts_ok[:n]) > 0
        rep = np.zeros(n, dtype=np.uint64)
        rep[:len(low)] = low
        return valid, rep


def _slices(seqs: list, texts: list) -> Iterator[tuple[list, list]]:
    at, size, n = 0, 0, len(texts)
    for i in range(n):
        size += len(texts[i])
        if size >= SLICE or i == n - 1:
            yield seqs[at:i + 1], texts[at:i + 1]
            at, size = i + 1, 0


def fingerprints(rows: DataFrame, key: str, text: str, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """fp, key, at, n: the representative of the spans that start at at .. at + n - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(window, least)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for ks, ts in _slices(keys, texts):
                valid, rep = roller.representatives(ts)
                pos = np.flatnonzero(valid)
                if not len(pos):
                    continue
                lengths = np.array([len(t) for t in ts])
                begin = np.cumsum(lengths) - lengths
                owner = np.searchsorted(begin, pos, "right") - 1
                r = rep[pos]
                first = np.concatenate([[True], (r[1:] != r[:-1]) | (owner[1:] != owner[:-1])])
                lead = np.flatnonzero(first)
                count = np.diff(np.concatenate([lead, [len(pos)]]))
                own = owner[lead]
                yield pa.RecordBatch.from_arrays([
                    pa.array(r[lead].view(np.int64)), pa.array(np.array(ks, dtype=np.int64)[own]),
                    pa.array((pos[lead] - begin[own]).astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["fp", key, "at", "n"])

    return rows.select(key, text).filter(F.col(key).isNotNull() & (F.length(text) >= least)).mapInArrow(
        run, f"fp long, `{key}` long, at int, n int")


def _repeated(rows: DataFrame, by: str, key: str) -> DataFrame:
    """Rows whose ``by`` (long) occurs with more than one key. rows: written, for they are read twice.

    The keys of a value are compared by an aggregate that is combined before its shuffle, so no
    value, however many rows hold it, meets in one task; rows are matched with the repeated values afterwards,
    by a broadcast where adaptive execution finds them small, else by a join whose skewed parts it splits.
    """
    several = rows.groupBy(by).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).filter("lo < hi").select(by)
    return rows.join(several, by, "left_semi")


def full_windows(rows: DataFrame, ranges: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """full, key, at, first: the hash of every span named in ranges; first marks its first place in
    the record. The ranges of a record are no more than its characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(least, least)
        for batch in batches:
            keys, texts, named = (c.to_pylist() for c in batch.columns)
            at = 0
            for ks, ts in _slices(keys, texts):
                h = roller.windows(ts, least, 2)
                lengths = np.array([len(t) for t in ts])
                begin = np.cumsum(lengths) - lengths
                start, count, owner = [], [], []
                for i in range(len(ts)):
                    for r in named[at + i]:
                        start.append(r["at"])
                        count.append(r["n"])
                        owner.append(i)
                at += len(ts)
                start, count, owner = np.array(start), np.array(count), np.array(owner)
                inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                place, own = np.repeat(start, count) + inner, np.repeat(owner, count)
                full = h[begin[own] + place].view(np.int64)
                order = np.lexsort((place, full, own))
                lead = np.concatenate([[True], (own[order][1:] != own[order][:-1]) | (full[order][1:] != full[order][:-1])])
                first = np.zeros(len(full), dtype=bool)
                first[order[lead]] = True
                yield pa.RecordBatch.from_arrays([
                    pa.array(full), pa.array(np.array(ks, dtype=np.int64)[own]), pa.array(place.astype(np.int32)), pa.array(first)],
                    names=["full", key, "at", "first"])

    per = ranges.groupBy(key).agg(F.collect_set(F.struct("at", "n")).alias("ranges"))
    return rows.select(key, text).join(per, key).dropDuplicates([key]).mapInArrow(
        run, f"full long, `{key}` long, at int, first boolean")


def shared_windows(rows: DataFrame, current: DataFrame, key: str = "seq", text: str = "body",
                   window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """full, key, at, first of every span of ``least`` characters that occurs in more than one record.

    rows: key (long, unique to a record; repeated rows count once) and text. current: the
    keys that take part. Characters are code points and compared exactly, white space too.
    Null, empty and shorter texts share nothing. A span that recurs within one record only
    is not shared. Very long texts are hashed whole, each alone.
    """
    # written once and narrow: the texts are not hashed again by the counts
    alike = checkpointed(_repeated(checkpointed(fingerprints(rows, key, text, window, least)), "fp", key))
    # versions of a record that are not current drop out before anything is compared
    alike = _repeated(checkpointed(alike.join(current.select(key), key, "left_semi")), "fp", key)
    full = checkpointed(full_windows(rows, alike.select(key, "at", "n"), key, text, least))
    return checkpointed(_repeated(full, "full", key))


def sharing_classes(shared: DataFrame, key: str = "seq") -> DataFrame:
    """full, key: one class for every set of records that have a span in common, and its members.
    However many records hold a span, there are as many rows; sharing_pairs writes the pairs out.

    A long common span makes hundreds of groups of the same members; one group stands for
    all that have the same count and sums over their members.
    """
    once = shared.filter("first")
    hashed = F.xxhash64(key)
    groups = once.groupBy("full").agg(
        F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"),
        F.bit_xor(hashed).alias("x"), F.sum(F.shiftrightunsigned(hashed, 24)).alias("s"))
    standing = groups.groupBy("n", "lo", "hi", "x", "s").agg(F.min("full").alias("full")).select("full")
    return once.join(standing, "full", "left_semi").select("full", key)


def sharing_pairs(shared: DataFrame, key: str = "seq") -> DataFrame:
    """seq_a < seq_b of the records that have a span in common, each pair once."""
    members = sharing_classes(shared, key)
    a, b = members.withColumnRenamed(key, "seq_a"), members.withColumnRenamed(key, "seq_b")
    return a.join(b, "full").filter("seq_a < seq_b").select("seq_a", "seq_b").distinct()


def intervals(shared: DataFrame, key: str = "seq", least: int = LEAST) -> DataFrame:
    """key, start, end (exclusive): the maximal intervals of a record covered by shared spans."""
    w = Window.partitionBy(key).orderBy("at")
    fresh = F.when(F.col("at") > F.lag("at").over(w) + least, 1).otherwise(0)
    return (
        shared.select(key, "at").withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(w))
        .groupBy(key, "part").agg(F.min("at").alias("start"), (F.max("at") + least).alias("end"))
        .select(key, "start", "end")
    )


def coverage(spans: DataFrame, rows: DataFrame, key: str = "seq", text: str = "body", current: DataFrame | None = None) -> DataFrame:
    """key, shared (characters in shared spans), chars, share: of the records of ``current``, 0
    where nothing is shared; where it is not given, of those that share something."""
    per = spans.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("shared"))
    lengths = rows.groupBy(key).agg(F.max(F.length(text)).alias("chars"))
    if current is None:
        return per.join(lengths, key).select(key, "shared", "chars", (F.col("shared") / F.col("chars")).alias("share"))
    every = current.select(key).distinct().join(lengths, key, "left").join(per, key, "left").withColumns({
        "shared": F.coalesce("shared", F.lit(0).cast("long")), "chars": F.coalesce("chars", F.lit(0))})
    return every.select(key, "shared", "chars", F.when(F.col("chars") > 0, F.col("shared") / F.col("chars")).otherwise(F.lit(0.0)).alias("share"))
