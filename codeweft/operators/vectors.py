"""Nearest vectors of a stated set of queries, by comparison with all rows in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codeweft.session import checkpointed

#: Rows and queries that meet in one task, at most about so many of each (64 dimensions of 4 bytes: 8 MB a side).
ROWS, QUERIES = 32768, 32768
#: Sides of the tables of similarities made at a time.
ASKED = 512
#: Similarities of which one is looked at to find what a query's least can be; pairs that are made exact at a time.
GROUP, EXACT = 32, 1 << 16


def valid(vector: str):
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


def _best(k: int):
    """The k most similar rows of every query of one cell; of equal similarities the lesser keys."""
    schema = pa.schema([("query", pa.int64()), ("neighbour", pa.int64()), ("sim", pa.float64())])

    def unit(t: pa.Table):
        keys = t.column("k").to_numpy()
        flat = t.column("v").combine_chunks()
        flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
        x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), -1)
        x /= np.abs(x).max(axis=1, keepdims=True)  # first, so that no square overflows
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        keys, first = np.unique(keys, return_index=True)  # rows of one key meet in one cell
        return keys, x[first]

    def exact(q, x, i, j):
        out = np.empty(len(i))
        for at in range(0, len(i), EXACT):
            part = slice(at, at + EXACT)
            out[part] = np.einsum("nd,nd->n", q[i[part]], x[j[part]])
        return np.round(out, 9)

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = [schema.empty_table()]
        if len(rows) and len(asked):
            (keys, x), (ids, q) = unit(rows), unit(asked)
            n, d = x.shape
            low, coarse = np.ascontiguousarray(x.T, np.float32), q.astype(np.float32)
            # what 32-bit floats may be off by (twice the bound for products and sums of d terms), and nine digits
            off = (d + 8) * 2.0 ** -23 + 1e-9
            groups = n // GROUP if n // GROUP >= 4 * k else n
            for at in range(0, len(ids), ASKED):
                own = ids[at:at + ASKED]
                s = coarse[at:at + ASKED] @ low
                place = np.minimum(np.searchsorted(keys, own), n - 1)
                me = np.flatnonzero(keys[place] == own)
                s[me, place[me]] = -np.inf  # not itself
                # the k-th of the largest of each group is no more than the k-th of all
                most = s if groups == n else s[:, :n // groups * groups].reshape(len(s), -1, groups).max(axis=1)
                kth = np.partition(most, max(groups - k, 0), axis=1)[:, max(groups - k, 0)].astype(np.float64)
                i, j = np.divmod(np.flatnonzero(s >= np.maximum(kth - 2 * off, -1.5).astype(np.float32)[:, None]), n)
                sim = exact(q[at:at + ASKED], x, i, j)  # all that may be among the k, in 64 bits
                order = np.lexsort((j, -sim, i))
                i, j, sim = i[order], j[order], sim[order]
                first = np.searchsorted(i, i, "left")
                top = np.arange(len(i)) - first < k
                out.append(pa.table([own[i[top]], keys[j[top]], sim[top]], schema=schema))
        return pa.concat_tables(out)

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", group: str = "label", vector: str = "embedding") -> DataFrame:
    """query, neighbour, sim, pos: the k rows of the same group most similar to each query.

    Every query is compared with every row of its group, in cells of a bounded number of rows and of
    queries: each row goes to as many cells as there are blocks of queries, each query to as many as
    there are blocks of rows, so both sides are read once and nothing passes the driver. A cell keeps k rows a query. Rows that are null, empty, zero, not finite or of
    another length take no part. Ties go to the lesser key, similarities being rounded to nine digits.
    """
    def side(df: DataFrame) -> DataFrame:
        v = F.col(vector)
        return (df.filter(valid(vector) & F.col(key).isNotNull() & F.col(group).isNotNull())
                .select(F.col(key).cast("long").alias("k"), F.col(group).cast("string").alias("g"), F.size(v).alias("d"), v.alias("v")))

    r, q = checkpointed(side(rows)), checkpointed(side(queries).dropDuplicates(["k"]))
    n, m = r.count(), q.count()
    across, down = max(-(-n // ROWS), rows.sparkSession.sparkContext.defaultParallelism), max(1, -(-m // QUERIES))
    block = lambda parts: F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    cell = ["g", "d", "x", "y"]
    left = r.withColumn("x", block(across)).withColumn("y", every(down)).groupBy(*cell)
    right = q.withColumn("y", block(down)).withColumn("x", every(across)).groupBy(*cell)
    found = left.cogroup(right).applyInArrow(_best(k), "query long, neighbour long, sim double")
    w = Window.partitionBy("query").orderBy(F.desc("sim"), "neighbour")
    return found.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)
