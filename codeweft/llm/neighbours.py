"""Most similar vectors for every vector: a neighbour graph by NN-descent.

From a light start (a fixed, small number of random-hyperplane trees) the graph is refined in
rounds that join neighbours of neighbours until nothing new is found. Vectors travel as four
or eight bits a dimension; pairs that are reported are checked on the vectors themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codeweft.session import checkpointed, forget

DIMENSIONS = 64
NEIGHBOURS = 10
#: The start: trees, rows compared with one another in each, and edges kept of each.
TREES, LEAF, STARTED = 6, 768, 4
#: Neighbours kept of every node, more than are asked for; of the pairs that meet at a node those
#: that each is told; most that meet at a node.
KEPT, BEST, MEET = 16, 3, 48
ROUNDS, LEAST_CHANGE = 7, 0.02
#: Rounds of the search for pairs before it may end: one round without a new pair does not yet mean that
#: lists have settled, and work stays in proportion to the rows.
LEAST_ROUNDS = 6
#: What rounding to four bits may take from a similarity.
SLACK = 0.05
SEED = 5


def usable(vector: str = "embedding", dimensions: int = DIMENSIONS):
    """Whether a vector has the right length, only finite values and is not all zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(v) == dimensions) & ~bad & F.exists(v, lambda x: x != 0)


def _codes(batches, key: str, bits: int):
    """Directions, each component in parts of the largest: in four bits (-7 to 7), two to a
    byte, or in eight (-127 to 127)."""
    for batch in batches:
        flat = batch.column(2).combine_chunks() if isinstance(batch.column(2), pa.ChunkedArray) else batch.column(2)
        x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
        if not len(x):
            continue
        x /= np.abs(x).max(axis=1, keepdims=True)  # first, so that no square overflows
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x /= np.abs(x).max(axis=1, keepdims=True)
        if bits == 8:
            q = (np.rint(x * 127) + 128).astype(np.uint8)
        else:
            q = (np.rint(x * 7) + 8).astype(np.uint8)
            q = q[:, ::2] << 4 | q[:, 1::2]
        data = pa.py_buffer(q.tobytes())
        offsets = pa.py_buffer((np.arange(len(q) + 1, dtype=np.int32) * q.shape[1]).tobytes())
        column = pa.Array.from_buffers(pa.binary(), len(q), [None, offsets, data])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), column], names=[key, "model", "code"])


def unit_codes(rows: DataFrame, key: str, model: str, vector: str, bits: int = 4) -> DataFrame:
    """key, model, code of every row with a usable vector."""
    good = rows.filter(usable(vector) & F.col(key).isNotNull() & F.col(model).isNotNull())
    return good.select(key, F.col(model).alias("model"), vector).mapInArrow(
        lambda b: _codes(b, key, bits), f"`{key}` long, model string, code binary")


def _matrix(column) -> np.ndarray:
    """The codes of a column as whole numbers in float32."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0)
    n = len(column)
    buf = column.buffers()
    width = np.frombuffer(buf[1], dtype=np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset:column.offset + n + 1]
    return _numbers(np.frombuffer(buf[2], dtype=np.uint8)[width[0]:width[-1]].reshape(n, -1))


def _numbers(q: np.ndarray) -> np.ndarray:
    """Codes, a row of bytes each, as whole numbers in float32."""
    if q.shape[1] == DIMENSIONS:
        x = q.astype(np.float32) - 128
    else:
        x = np.empty((len(q), 2 * q.shape[1]), dtype=np.float32)
        x[:, ::2], x[:, 1::2] = q >> 4, q & 15
        x -= 8
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    """Reciprocal lengths. Products of codes are whole numbers that float32 holds exactly, so the
    similarity of two rows is the same wherever and in whichever order they meet."""
    return (1 / np.sqrt((x * x).sum(axis=-1))).astype(np.float32)


def _sorted_batches(batches, by: int, shortened=None):
    """Batches anew, cut so that no group of equal values in column ``by`` is divided. Rows come
    sorted by it; ``shortened`` bounds what is held of a group that goes on in the next batch."""
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        values = batch.column(by).to_numpy()
        last = int(np.searchsorted(values, values[-1], "left"))
        if last:
            yield batch.slice(0, last)
        rest = batch.slice(last) if shortened is None else shortened(batch.slice(last))
    if rest is not None:
        yield rest


def placed(codes: DataFrame, key: str, n: int, dimensions: int, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """tree, m (hash of the model), cell, along, key, code: every row once per tree. A tree is some random planes
    through the origin (their signs are the cell; as many as make cells of about ``leaf`` rows)
    and one more direction, along which the rows of a cell are ordered."""
    depth = max(0, math.ceil(math.log2(max(1, n) / leaf)))
    planes = np.random.default_rng(SEED).standard_normal((dimensions, trees * (depth + 1))).astype(np.float32)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            at = (_matrix(batch.column(2)) @ planes).reshape(len(batch), trees, depth + 1)
            cell = ((at[:, :, :depth] > 0) * (1 << np.arange(depth, dtype=np.int64))).sum(axis=2).astype(np.int64)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(batch), t, np.int32)), batch.column(1), pa.array(cell[:, t]),
                    pa.array(at[:, t, depth]), batch.column(0), batch.column(2)], names=["tree", "m", "cell", "along", key, "code"])

    return codes.select(key, F.xxhash64("model").alias("m"), "code").mapInArrow(
        run, f"tree int, m long, cell long, along float, `{key}` long, code binary")


def _block_edges(k: int, leaf: int):
    """Candidates of every row: the k nearest of its block, which is up to ``leaf`` consecutive
    rows of one tree and model."""

    def run(batches):
        for batch in _blocks(batches, leaf):
            ids, x = batch.column(4).to_numpy(), _matrix(batch.column(5))
            u = _unit(x)
            s = (x @ x.T) * (u[:, None] * u[None, :])
            np.fill_diagonal(s, -2.0)
            k_ = min(k, len(x) - 1)
            if k_ < 1:
                continue
            i = np.arange(len(x))
            for _ in range(k_):  # few are kept, so as many searches for the largest are less than a partial sort
                j = s.argmax(axis=1)
                yield _candidates(ids[i], ids[j], s[i, j])
                s[i, j] = -2.0

    return run


def _blocks(batches, leaf: int):
    """Runs of at most ``leaf`` rows of one tree and one model, in the order in which they come."""
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        tree, m = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero((tree[1:] != tree[:-1]) | (m[1:] != m[:-1])) + 1, [len(batch)]])
        rest = None
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            while b - a > leaf:
                yield batch.slice(a, leaf)
                a += leaf
            if b == len(batch):
                rest = batch.slice(a, b - a)
            else:
                yield batch.slice(a, b - a)
    if rest is not None:
        yield rest


def _nearest(edges: DataFrame, by: str, other: str, k: int) -> DataFrame:
    """The k most similar edges of every node; ties by the lesser key."""
    w = Window.partitionBy(by).orderBy(F.desc("sim"), other)
    return edges.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).drop("place")


def _similar(pairs: DataFrame, codes: DataFrame, key: str) -> DataFrame:
    """src, dst, sim of pairs of one model."""

    def run(batches):
        for b in batches:
            if len(b):
                x, y = _matrix(b.column(2)), _matrix(b.column(3))
                s = (x * y).sum(axis=1) * (_unit(x) * _unit(y))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s.astype(np.float32))], names=["src", "dst", "sim"])

    a = codes.select(F.col(key).alias("src"), F.col("code").alias("ca"))
    b = codes.select(F.col(key).alias("dst"), F.col("code").alias("cb"))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", "ca", "cb").mapInArrow(run, "src long, dst long, sim float")


#: What the nodes are told: a pair (back 0), who points to them (back 1, packed); the nodes themselves have no back.
CANDIDATE = "key long, other long, s float, back byte, node binary"
MESSAGE = "centre long, message binary"
_CANDIDATE = pa.schema([("key", pa.int64()), ("other", pa.int64()), ("s", pa.float32()), ("back", pa.int8()), ("node", pa.binary())])
_MESSAGE = pa.schema([("centre", pa.int64()), ("message", pa.binary())])
_EDGE = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("sim", pa.float32()), ("fresh", pa.bool_())])


def _node(code: int, k: int, r: int) -> np.dtype:
    """A node as it travels: its code, the k nearest it knows (filled up with -1), whether they are
    new since the last round, and up to r that lately said to point to it."""
    return np.dtype([("code", np.uint8, code), ("near", np.int64, k), ("sim", np.float32, k), ("new", np.bool_, k),
                     ("back", np.int64, r), ("back_sim", np.float32, r), ("back_new", np.bool_, r)])


def _message(code: int) -> np.dtype:
    """What a node tells one it points to, or one that pointed to it: its key and code, how similar the two are, whether
    that is new, the similarity of the farthest it knows, and whether it points there."""
    return np.dtype([("node", np.int64), ("sim", np.float32), ("least", np.float32), ("new", np.bool_), ("points", np.bool_), ("code", np.uint8, code)])


def _told(r: int) -> np.dtype:
    """Up to r nodes that say to point to a node, in one column: filled up with -1, nearest first."""
    return np.dtype([("back", np.int64, r), ("back_sim", np.float32, r), ("back_new", np.bool_, r)])


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes of one width as a binary column."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.dtype.itemsize * int(np.prod(rows.shape[1:])))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def _unpacked(column: pa.Array, kind: np.dtype) -> np.ndarray:
    width = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=kind, count=len(column), offset=int(width[0])) if len(column) else np.zeros(0, kind)


def _filled(n: int, kind: np.dtype) -> np.ndarray:
    out = np.zeros(n, kind)
    for name, value in (("near", -1), ("sim", -2), ("back", -1), ("back_sim", -2)):
        if name in kind.names:
            out[name] = value
    return out


def _candidates(key, other, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(other), pa.array(sim.astype(np.float32)), pa.array(np.zeros(len(key), np.int8)),
                                       pa.nulls(len(key), pa.binary())], schema=_CANDIDATE)


def _messages(kind: np.dtype):
    """Every node tells its code to those it points to and to those that lately pointed to it."""

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            key, v = b.column(0).to_numpy(), _unpacked(b.column(1), kind)
            near, new, back = v["near"], v["new"], v["back"]
            k = near.shape[1]
            least = np.where(near[:, -1] >= 0, v["sim"][:, -1], np.float32(-2))
            same = (near[:, :, None] == back[:, None, :]) & (near[:, :, None] >= 0)
            new = new | (same & v["back_new"][:, None, :]).any(axis=2)
            to = np.concatenate([near, np.where(same.any(axis=1), -1, back)], axis=1)
            row, at = np.nonzero(to >= 0)
            m = np.zeros(len(row), _message(v["code"].shape[1]))
            m["node"], m["least"], m["points"], m["code"] = key[row], least[row], at < k, v["code"][row]
            m["new"] = np.concatenate([new, v["back_new"]], axis=1)[row, at]
            m["sim"] = np.concatenate([v["sim"], v["back_sim"]], axis=1)[row, at]
            yield pa.RecordBatch.from_arrays([pa.array(to[row, at]), _binary(m)], schema=_MESSAGE)

    return run


def _local_joins(code: int, most: int, r: int, best: int, wanted: float):
    """At every centre the at most ``most`` nearest of those that told it their code meet. Of the
    pairs of which one is new to the centre a node is told its ``best``, and all that are
    ``wanted``, if they are nearer than the farthest it knows; the centre is told who points to it."""

    kind = _message(code)

    def nearest(b):
        if len(b) <= most:
            return b
        return b.take(pa.array(np.argpartition(-_unpacked(b.column(1), kind)["sim"], most - 1)[:most]))

    def run(batches):
        for b in _sorted_batches(batches, 0, nearest):
            centre, m = b.column(0).to_numpy(), _unpacked(b.column(1), kind)
            # by centre, as they come, and of one the nearest first
            group = np.cumsum(np.concatenate([[0], centre[1:] != centre[:-1]]))
            order = np.argsort(group << 32 | ((1.0 - m["sim"].astype(np.float64)) * (1 << 29)).astype(np.int64), kind="stable")
            centre, m = centre[order], m[order]
            node, new, sim, least, points, x = m["node"], m["new"], m["sim"], m["least"], m["points"], _numbers(m["code"])
            u = _unit(x)
            first = np.flatnonzero(np.concatenate([[True], centre[1:] != centre[:-1]]))
            sizes = np.diff(np.concatenate([first, [len(centre)]]))
            place = np.arange(len(centre)) - np.repeat(first, sizes)
            if r:
                rank = np.cumsum(points) - 1
                rank -= np.repeat(rank[first] - points[first] + 1, sizes)
                told = np.flatnonzero(points & (rank < r))
                who, owner = np.unique(centre[told], return_inverse=True)
                v = _filled(len(who), _told(r))
                v["back"][owner, rank[told]], v["back_sim"][owner, rank[told]], v["back_new"][owner, rank[told]] = node[told], sim[told], new[told]
                if len(who):
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.nulls(len(who), pa.int64()), pa.nulls(len(who), pa.float32()),
                                                      pa.array(np.ones(len(who), np.int8)), _binary(v)], schema=_CANDIDATE)
            sizes = np.minimum(sizes, most)
            order = np.argsort(sizes, kind="stable")  # centres of like size together
            for at in range(0, len(order), 256):
                which = order[at:at + 256]
                size = sizes[which]
                width = int(size.max())
                if width < 2:
                    continue
                slot = np.arange(width)
                inside = slot[None, :] < size[:, None]
                row = np.where(inside, first[which][:, None] + slot[None, :], 0)
                y, v, fresh, who = x[row], np.where(inside, u[row], np.float32(np.nan)), new[row] & inside, node[row]
                # of a pair the second axis is who is told of, the third who is told; what is not inside compares as false
                s = np.matmul(y, y.transpose(0, 2, 1)) * (v[:, :, None] * v[:, None, :])
                ok = s > least[row][:, None, :]
                ok &= fresh[:, :, None] | fresh[:, None, :]
                ok[:, slot, slot] = False
                if width > best:
                    s = np.where(ok, s, np.float32(-3))
                    limit = s.max(axis=1)
                    for _ in range(best - 1):
                        limit = np.where(s < limit[:, None, :], s, np.float32(-3)).max(axis=1)
                    ok &= s >= np.minimum(limit, wanted)[:, None, :]
                g, j, i = np.nonzero(ok)
                if len(g):
                    yield _candidates(who[g, i], who[g, j], s[g, j, i])

    return run


def _best_of(owner, other, sim, new, n: int, k: int):
    """Per owner (0 to n - 1) the k nearest, an entry not being new where it was known before."""
    near, sims, fresh = np.full((n, k), -1, np.int64), np.full((n, k), -2, np.float32), np.zeros((n, k), bool)
    if not len(owner):
        return near, sims, fresh
    # equal pairs have equal similarities, so one order brings them together
    place = ((1.0 - sim.astype(np.float64)) * (1 << 19)).astype(np.int64)
    order = np.lexsort((other, owner.astype(np.int64) << 21 | place))
    owner, other, sim, new = owner[order], other[order], sim[order], new[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])]))
    new = np.logical_and.reduceat(new, first)
    owner, other, sim = owner[first], other[first], sim[first]
    begin = np.concatenate([[True], owner[1:] != owner[:-1]])
    rank = np.arange(len(owner)) - np.flatnonzero(begin)[np.cumsum(begin) - 1]
    top = rank < k
    near[owner[top], rank[top]], sims[owner[top], rank[top]], fresh[owner[top], rank[top]] = other[top], sim[top], new[top]
    return near, sims, fresh


def _merge(kind: np.dtype):
    """The nodes with their lists after the candidates of a round."""
    k, r = kind["near"].shape[0], kind["back"].shape[0]

    def run(batches):
        for b in _sorted_batches(batches, 0):
            key, packed = b.column(0).to_numpy(), b.column(4)
            mark = b.column(3).fill_null(-1).to_numpy(zero_copy_only=False)
            at, told, rest = (np.flatnonzero(mark == m) for m in (-1, 1, 0))  # nodes, who points to them, pairs
            if not len(at):
                continue
            keys, v = key[at], _unpacked(packed.take(pa.array(at)), kind)
            g, i = np.nonzero(v["near"] >= 0)
            owner = np.searchsorted(keys, key[rest])
            other, s = (b.column(c).take(pa.array(rest)).to_numpy(zero_copy_only=False) for c in (1, 2))
            out = _filled(len(keys), kind)
            out["code"] = v["code"]
            out["near"], out["sim"], out["new"] = _best_of(
                np.concatenate([g, owner]), np.concatenate([v["near"][g, i], other]), np.concatenate([v["sim"][g, i], s]),
                np.concatenate([np.zeros(len(g), bool), np.ones(len(owner), bool)]), len(keys), k)
            if len(told):
                t, to = _unpacked(packed.take(pa.array(told)), _told(r)), np.searchsorted(keys, key[told])
                for name in ("back", "back_sim", "back_new"):
                    out[name][to] = t[name]
            yield pa.RecordBatch.from_arrays([pa.array(keys), _binary(out)], names=["key", "node"])

    return run


def _after(nodes: DataFrame, candidates: DataFrame, kind: np.dtype) -> DataFrame:
    state = nodes.select("key", F.lit(None).cast("long").alias("other"), F.lit(None).cast("float").alias("s"), F.lit(None).cast("byte").alias("back"), "node")
    return state.unionByName(candidates).repartition("key").sortWithinPartitions("key").mapInArrow(_merge(kind), "key long, node binary")


def _edges(nodes: DataFrame, kind: np.dtype) -> DataFrame:
    def run(batches):
        for b in batches:
            v = _unpacked(b.column(1), kind)
            row, at = np.nonzero(v["near"] >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[row]), pa.array(v["near"][row, at]), pa.array(v["sim"][row, at]),
                                              pa.array(v["new"][row, at])], schema=_EDGE)

    return nodes.mapInArrow(run, "src long, dst long, sim float, fresh boolean")


def _started(code: int, kind: np.dtype):
    def run(batches):
        for b in batches:
            out = _filled(len(b), kind)
            out["code"] = _unpacked(b.column(1), np.dtype((np.uint8, code))).reshape(len(b), code)
            yield pa.RecordBatch.from_arrays([b.column(0), _binary(out)], names=["key", "node"])

    return run


def neighbour_graph(codes: DataFrame, key: str = "seq", k: int = KEPT, trees: int = TREES, leaf: int = LEAF, started: int = STARTED,
                    rounds: int = ROUNDS, least_change: float = LEAST_CHANGE, wanted: float = 2.0, best: int = BEST, reverse: int = KEPT, meet: int = MEET, least_rounds: int = 1,
                    report=None) -> DataFrame:
    """src, dst, sim: k most similar rows of the same model for every row, by NN-descent.

    codes: key (long, not negative), model, code. The start is light: in each of a fixed number of trees every row
    is compared with the at most ``leaf`` rows beside it and keeps the ``started`` nearest. Then
    rounds of joining neighbours of neighbours: every node sends its code to those it points to and to the ``reverse`` nearest
    that pointed to it; all that arrive at a node meet there, and of the pairs that are new to it each learns the
    nearest, and all of at least ``wanted``. Two shuffles a round, both linear in the nodes; work per node has a bound. Rounds end
    when fewer than ``least_change`` of the edges (of those of at least ``wanted``, where it is
    given, when none after ``least_rounds``) are new. report: called with the round and its edges.
    """
    n, code = codes.agg(F.count(F.lit(1)), F.max(F.length("code"))).first()
    if not n:
        return codes.select(F.col(key).alias("src"), F.col(key).alias("dst"), F.lit(0.0).cast("float").alias("sim"))
    kind = _node(code, k, reverse)
    spread = placed(codes, key, n, DIMENSIONS, trees, leaf).repartitionByRange("tree", "m", "cell", "along", key)
    start = spread.sortWithinPartitions("tree", "m", "cell", "along", key).mapInArrow(_block_edges(started, leaf), CANDIDATE)
    empty = codes.select(F.col(key).alias("key"), "code").mapInArrow(_started(code, kind), "key long, node binary")
    nodes = checkpointed(_after(empty, start, kind))
    if report:
        report(0, _edges(nodes, kind))
    for number in range(1, rounds + 1):
        told = nodes.mapInArrow(_messages(kind), MESSAGE).repartition("centre").sortWithinPartitions("centre")
        after = checkpointed(_after(nodes, told.mapInArrow(_local_joins(code, meet, reverse, best, wanted), CANDIDATE), kind))
        forget(nodes)
        nodes = after
        if report:
            report(number, _edges(nodes, kind))
        told = _edges(nodes, kind).filter(F.col("sim") >= (wanted if wanted <= 1 else -2.0)).agg(F.count(F.lit(1)).alias("n"), F.count_if("fresh").alias("new")).first()
        if number >= least_rounds and told["new"] <= (0 if wanted <= 1 else least_change * told["n"]):
            break
    return _edges(nodes, kind).drop("fresh")


def nearest_rows(rows: DataFrame, key: str = "seq", record: str = "id", model: str = "embedding_model", vector: str = "embedding",
                 k: int = NEIGHBOURS) -> DataFrame:
    """src, dst, sim: the k rows of its model most similar to every current row, by NN-descent
    over eight-bit codes."""
    codes = current_codes(rows, key, record, model, vector, 8)
    return _nearest(neighbour_graph(codes, key), "src", "dst", k)


def greedy_search(graph: DataFrame, codes: DataFrame, queries: DataFrame, key: str = "seq", k: int = NEIGHBOURS, beam: int = 40,
                  entries: int = 40, steps: int = 6) -> DataFrame:
    """query, neighbour, sim: the k nearest nodes met by walking the graph greedily.

    queries: query, model, code. Every query starts at the ``entries`` nodes of its model with
    the least keys' hashes, and in each step goes to all neighbours of the ``beam`` nearest nodes
    met so far that it has not yet met; it ends when a step brings nothing nearer. Work per query
    and step is bounded by beam * k whatever the number of rows.
    """
    w = Window.partitionBy("model").orderBy(F.xxhash64(key), key)
    doors = codes.select(key, "model", F.row_number().over(w).alias("n")).filter(F.col("n") <= entries).select("model", F.col(key).alias("node"))
    q = checkpointed(queries.select("query", "model", "code"))

    def measured(pairs: DataFrame) -> DataFrame:
        both = codes.select(F.col(key).alias(key), "code").unionByName(q.select((-F.col("query") - 1).alias(key), "code"))
        got = _similar(pairs.select((-F.col("query") - 1).alias("src"), F.col("node").alias("dst")), both, key)
        return got.select((-F.col("src") - 1).alias("query"), F.col("dst").alias("node"), "sim")

    met = checkpointed(measured(q.join(doors, "model").select("query", "node").filter("query <> node")).withColumn("step", F.lit(0)))
    edges = graph.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    edges = edges.unionByName(edges.select(F.col("next").alias("node"), F.col("node").alias("next"))).distinct()
    best = Window.partitionBy("query").orderBy(F.desc("sim"), "node")
    for step in range(1, steps + 1):
        near = met.withColumn("place", F.row_number().over(best)).filter((F.col("place") <= beam) & (F.col("step") == step - 1))
        ahead = (near.join(edges, "node").select("query", F.col("next").alias("node")).filter("query <> node").distinct()
                 .join(met.select("query", "node"), ["query", "node"], "left_anti"))
        fresh = checkpointed(measured(ahead).withColumn("step", F.lit(step)))
        if fresh.isEmpty():
            break
        met = met.unionByName(fresh)
    return _nearest(met.select(F.col("query").alias("src"), F.col("node").alias("dst"), "sim"), "src", "dst", k).select(
        F.col("src").alias("query"), F.col("dst").alias("neighbour"), "sim")


def cosine(a: str, b: str):
    """Cosine of two vectors, summed in double from left to right."""
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda s, x: s + x)
    norm = [F.sqrt(F.aggregate(F.transform(c, lambda x: x.cast("double") * x.cast("double")), zero, lambda s, x: s + x)) for c in (a, b)]
    return dot / (norm[0] * norm[1])


def current_codes(rows: DataFrame, key: str, record: str, model: str, vector: str, bits: int = 4) -> DataFrame:
    """unit_codes of the rows that are the last of their record; repeated rows once."""
    last = rows.groupBy(record).agg(F.max(key).alias(key)).select(key)
    return checkpointed(unit_codes(rows, key, model, vector, bits).join(last, key, "left_semi").dropDuplicates([key]))


def similar_pairs(rows: DataFrame, least: float, key: str = "seq", record: str = "id", model: str = "embedding_model",
                  vector: str = "embedding", k: int = NEIGHBOURS + 2, rounds: int = 2 * ROUNDS) -> DataFrame:
    """a < b, sim: pairs of current rows of one model whose cosine is at least ``least``.

    Vectors that are null, of another length, all zero or not finite take no part. Rows whose
    vectors are equal to a byte are one node of the graph and are paired with each other and
    with each other's neighbours afterwards. Edges of the graph are approximate, so more
    neighbours than the ten that a row may have are kept and pairs down to SLACK below ``least`` go on
    to the check on the vectors themselves. Rounds end when one finds no such pair.
    """
    codes = current_codes(rows, key, record, model, vector)
    groups = checkpointed(codes.groupBy("model", "code").agg(F.min(key).alias("node"), F.count(F.lit(1)).alias("n")))
    graph = checkpointed(neighbour_graph(groups.select(F.col("node").alias(key), "model", "code"), key, k, wanted=least - SLACK, best=2, reverse=k, rounds=rounds, least_rounds=LEAST_ROUNDS))
    near = graph.filter(F.col("sim") >= least - SLACK).select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    alike = groups.filter("n > 1").select(F.col("node").alias("x"), F.col("node").alias("y"))
    members = codes.join(groups.filter("n > 1"), ["model", "code"]).select("node", F.col(key).alias("member"))
    ends = near.unionByName(alike)
    for end in ("x", "y"):
        m = members.select(F.col("node").alias(end), F.col("member").alias(f"{end}_member"))
        ends = ends.join(m, end, "left").withColumn(f"{end}_row", F.coalesce(f"{end}_member", end)).drop(f"{end}_member")
    pairs = checkpointed(ends.select(F.least("x_row", "y_row").alias("a"), F.greatest("x_row", "y_row").alias("b")).filter("a < b").distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    vectors = checkpointed(rows.select(key, vector).join(wanted, key, "left_semi").dropDuplicates([key]))
    left = vectors.select(F.col(key).alias("a"), F.col(vector).alias("va"))
    right = vectors.select(F.col(key).alias("b"), F.col(vector).alias("vb"))
    return (pairs.join(left, "a").join(right, "b").withColumn("sim", cosine("va", "vb"))
            .filter(F.col("sim") >= least).select("a", "b", "sim"))
