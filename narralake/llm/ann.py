"""Operator 10: approximate nearest neighbours by largest inner product: a graph by NN-descent, searched greedily.

1. Equal vectors form one node (the least id); a node keeps its k + 1 least ids, which is all that a result can hold.
   Vectors get one more component that makes all lengths equal, so that the nearest by angle are the largest products.
2. The graph holds NEAR neighbours of each node, about 2 log2(n). It begins with the nearest within groups of about
   GROUP nodes (fewer in small tables) on the same side of random planes, TABLES times over; what is compared there in
   memory needs no round. Then NN-descent: every node brings together its
   neighbours and those that have it as a neighbour, of which one at least must be new since they last met; all pairs
   in such a group of bounded size are compared (vectors as bytes), and whatever is nearer than a node's worst neighbour
   replaces it. Rounds go on until under SETTLED of all edges change. A new edge waits for its turn if a node has more
   than it can bring at once; so do those who have a popular node as a neighbour.
3. A query starts at its own node's neighbours and at the longest vectors. Every step it opens the unopened nodes among
   its best POOL, their neighbours are scored in single precision where their vectors lie, and the pool is renewed, until
   no pool holds an unopened node. About SAMPLE queries are also compared with every node: while their recall is under
   RECALL, pools are doubled and the search goes on. There is no other limit; a pool may come to hold every node.
4. The best are scored again in double precision on the original vectors.
Every vector is indexed. Groups, pools, lists and blocks of queries are of bounded size; hot nodes are salted.

Nulls: null, zero and non-finite vectors, those with null components, and null ids take no part. Vectors of different
lengths have no inner product: such a table is a ValueError. Ties go to the smaller id. Empty tables give no rows.
Repeated ids count once, with their least vector. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narralake.llm.common import bound_arrow, materialize

GROUP, TABLES, SETTLED, SALTS = 4096, 8, 0.001, 8
RECALL, SAMPLE, POOL, BEAM, HELD, ENTRIES, SPARE, PART = 0.95, 200, 128, 64, 4, 32, 12, 8192


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), width)


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _as_bytes(x: np.ndarray) -> pa.Array:
    """Each row as its scale and one signed byte a component."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-30) / 127
    rows = np.rint(x / scale[:, None]).astype(np.int8)
    return pa.array([s.tobytes() + r.tobytes() for s, r in zip(scale.astype(np.float32), rows, strict=True)], pa.binary())


def _of_bytes(rows: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(rows), np.int8).reshape(len(rows), -1)
    return raw[:, 4:].astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


def _runs(u: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(u)), bool), u[1:] != u[:-1]]))


def _packed(u: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """One row for each run of equal u: u, and what each column holds there as bytes."""
    starts = _runs(u)
    ends = np.append(starts, len(u))
    return [pa.array(u[starts]), *(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * c.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(c))]) for c in columns)]


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of the rows, one after the other, and how many each row has."""
    item = np.dtype(kind).itemsize
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    size = int(ends[-1] - ends[0]) // item
    return np.frombuffer(column.buffers()[2], kind, size, int(ends[0])) if size else np.zeros(0, kind), np.diff(ends) // item


def _nodes(vectors: DataFrame, id_col: str, vector_col: str, keep: int) -> tuple[DataFrame, DataFrame, int]:
    """(node, vec) and (node, vec_id) for at most `keep` ids of a node, and the vectors' length."""
    clean = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = clean.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)).withColumn("v", F.transform("v", lambda x: x + 0.0))
    once = materialize(fine.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    sizes = once.agg(F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    if sizes.lo != sizes.hi:
        raise ValueError(f"vectors of {sizes.lo} and of {sizes.hi} components have no inner product")
    width = sizes.hi or 0
    key = F.xxhash64("v")
    least = materialize(once.groupBy(key.alias("k"), "v").agg(F.min("vec_id").alias("node")), "nodes")
    rank = Window.partitionBy("node").orderBy("vec_id")
    members = once.select("vec_id", key.alias("k"), "v").join(least, ["k", "v"]).select("node", "vec_id").withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= keep).drop("r")
    return least.select("node", "v"), materialize(members, "members"), width


def _best(part: DataFrame, k: int) -> DataFrame:
    """The k nearest nodes of each q; the limit per query also runs before the shuffle."""
    w = Window.partitionBy("q").orderBy(F.desc("s"), "node")
    return part.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def _some(part: DataFrame, count: int, most: int) -> DataFrame:
    """About `most` of the `count` rows, by a hash of their node; all where there are no more."""
    return part if count <= most else part.filter(F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * most / count))


def near_of(count: int) -> int:
    """Neighbours of a node in the graph."""
    return max(16, 2 * int(np.ceil(np.log2(max(2, count)))))


def group_of(count: int) -> int:
    """About how many nodes are compared with each other at the start."""
    return min(GROUP, max(256, count // 16))


def _part(node: np.ndarray, count: int) -> np.ndarray:
    """The part of about PART nodes that holds each node's vector."""
    mixed = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(-(-count // PART) or 1)).astype(np.int32)


def _ready(nodes: DataFrame, width: int) -> tuple[DataFrame, int]:
    """(node, x in single precision, y in bytes, the added component, codes of the sides of random planes, part), and their number."""
    longest = nodes.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.count("*")).first()
    top, count = float(longest[0] or 1.0), longest[1]
    bits = max(1, round(np.log2(max(2, count / group_of(count)))))
    planes = np.random.default_rng(7).standard_normal((width + 1, TABLES * bits)).astype(np.float32)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, width)
            more = np.sqrt(np.maximum(0.0, top - (x * x).sum(axis=1)))
            x = (np.concatenate([x, more[:, None]], axis=1) / np.sqrt(top)).astype(np.float32)
            codes = ((x @ planes) > 0).reshape(len(x), TABLES, bits) @ (1 << np.arange(bits))
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(x), _as_bytes(x), pa.array(x[:, -1]), pa.array(codes.tolist(), pa.list_(pa.int64())), pa.array(_part(batch.column(0).to_numpy(), count))], ["node", "x", "y", "added", "codes", "part"])

    return materialize(nodes.mapInArrow(prepare, "node long, x binary, y binary, added float, codes array<long>, part int"), "ready"), count


def _pruned(u: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each u's k best different v."""
    order = np.lexsort((v, u))
    u, v, s = u[order], v[order], s[order]
    first = np.ones(len(u), bool)
    first[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    u, v, s = u[first], v[first], s[first]
    order = np.lexsort((v, -s, u))
    u, v, s = u[order], v[order], s[order]
    keep = np.arange(len(u)) - np.searchsorted(u, u) < k
    return u[keep], v[keep], s[keep]


_FOUND = "u long, v binary, s binary, state binary"


def _meetings(near: int, start: bool):
    kind = ["u", "v", "s", "state"]

    def rows_of(u: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(_packed(u, v, s.astype(np.float32), np.full(len(u), 2, np.int8)), kind)

    def begin(ids: np.ndarray, rows: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Half a list for each node from a large group of new nodes, in blocks of rows; its other groups bring the rest."""
        x, most = _of_bytes(rows), min(near // 2, len(ids) - 1)
        step = max(1, (1 << 22) // len(ids))
        for i in range(0, len(ids), step):
            s = x[i : i + step] @ x.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
            top = np.argpartition(s, -most, axis=1)[:, -most:]
            yield rows_of(np.repeat(ids[i : i + step], most), ids[top].ravel(), np.take_along_axis(s, top, axis=1).ravel())

    def meet(ids: np.ndarray, new: np.ndarray, worst: np.ndarray, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(u, v, s) for all pairs of a group, one of them new, where s beats the worst neighbour of u."""
        x = _of_bytes(rows)
        s = x @ x.T
        s[(s <= worst[:, None]) | (ids[:, None] == ids[None, :]) | ~(new[:, None] | new[None, :])] = -np.inf
        if len(ids) > 4 * near:  # u has no use for more than `near` of a group
            s[s < np.partition(s, -near, axis=1)[:, -near][:, None]] = -np.inf
        i, j = np.nonzero(s > -np.inf)
        return ids[i], ids[j], s[i, j]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, node, new, worst, y) come sorted by key; one group is held at a time."""
        held: list[tuple] = []
        found: list[tuple] = []
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal size
            ids, new, worst = (np.concatenate([h[i] for h in held]) for i in range(1, 4))
            rows = [r for h in held for r in h[4]]
            held.clear()
            if len(rows) > 1 and start and len(rows) > 4 * near:
                yield from begin(ids, rows)
            elif len(rows) > 1:
                found.append(meet(ids, new, worst, rows))
                size += len(found[-1][0])

        def flush() -> pa.RecordBatch:
            nonlocal size
            out = _pruned(*(np.concatenate([f[i] for f in found]) for i in range(3)), near)
            found.clear()
            size = 0
            return rows_of(*out)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids, new, worst = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            rows = batch.column(4).to_pylist()
            cuts = [*_runs(key).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0][0] != key[a]:
                    yield from done()
                held.append((key[a], ids[a:b], new[a:b], worst[a:b], rows[a:b]))
            if size > 1 << 20:
                yield flush()
        if held:
            yield from done()
        if found:
            yield flush()

    return compare


_GRAPH = "u long, nbr binary, sim binary, fresh binary, used binary, worst float, changed int"


def _merged(near: int, brought: int, round_: int):
    """Rows (u, and v, s, state of some of its edges as bytes) come sorted by u. state: 0 known for long, 1 not yet brought together, 2 just found."""
    kind = pa.schema([("u", pa.int64()), *((c, pa.binary()) for c in ("nbr", "sim", "fresh", "used")), ("worst", pa.float32()), ("changed", pa.int32())])

    def merge(u: np.ndarray, v: np.ndarray, s: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((state, v, u))
        u, v, s, state = u[order], v[order], s[order], state[order]
        first = np.ones(len(u), bool)
        first[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
        u, v, s, state = u[first], v[first], s[first], state[first]
        order = np.lexsort((v, -s, u))
        u, v, s, state = u[order], v[order], s[order], state[order]
        keep = np.arange(len(u)) - np.searchsorted(u, u) < near
        u, v, s, state = u[keep], v[keep], s[keep], state[keep]
        # Of the edges that are still to be brought, the first `brought` by a hash of node and round have their turn.
        turn = (v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(round_)) * np.uint64(0xC2B2AE3D27D4EB4F)
        order = np.lexsort((turn, state == 0, u))
        used = np.zeros(len(u), bool)
        used[order] = np.arange(len(u)) - np.searchsorted(u, u) < brought
        used &= state > 0
        starts = _runs(u)
        ends = np.append(starts[1:], len(u))
        worst = np.where(ends - starts >= near, s[ends - 1], np.float32(-2))
        changed = np.add.reduceat((state == 2).astype(np.int32), starts)
        return pa.RecordBatch.from_arrays([*_packed(u, v, s, (state > 0) & ~used, used), pa.array(worst.astype(np.float32)), pa.array(changed.astype(np.int32))], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            (v, sizes), (s, _), (state, _) = (_unpacked(batch.column(i), t) for i, t in ((1, np.int64), (2, np.float32), (3, np.int8)))
            now = [np.repeat(batch.column(0).to_numpy(), sizes), v, s, state]
            held = [np.concatenate(c) for c in zip(held, now, strict=True)] if held else now
            last = int(np.searchsorted(held[0], held[0][-1]))  # the last u may go on in the next batch
            if last and len(held[0]) > 1 << 16:
                yield merge(*(c[:last] for c in held))
                held = [c[last:] for c in held]
        if held:
            yield merge(*held)

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, s, state): 0 known, 1 fresh, 2 has its turn."""
    for batch in batches:
        (v, sizes), (s, _), (fresh, _), (used, _) = (_unpacked(batch.column(c), t) for c, t in (("nbr", np.int64), ("sim", np.float32), ("fresh", np.int8), ("used", np.int8)))
        u, state = np.repeat(batch.column("u").to_numpy(), sizes), fresh + 2 * used
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s), pa.array(state)], ["u", "v", "s", "state"])


def _met(rows: DataFrame, near: int, start: bool = False) -> DataFrame:
    return rows.select("key", "node", "new", "worst", "y").repartition("key").sortWithinPartitions("key").mapInArrow(_meetings(near, start), _FOUND)


def build_graph(ready: DataFrame, count: int) -> DataFrame:
    """ready: (node, y, codes) -> (u, v, s), the neighbours of each node."""
    near = near_of(count)
    brought = 5 * near // 8
    coded = ready.select("node", "y", F.posexplode("codes").alias("t", "code"))
    sizes = materialize(coded.groupBy("t", "code").agg(F.ceil(F.count("*") / (2 * group_of(count))).cast("int").alias("parts")), "sizes")
    key = F.xxhash64("t", "code", F.pmod(F.xxhash64("node", "t"), F.col("parts")))
    first = coded.join(sizes, ["t", "code"]).select(key.alias("key"), "node", F.lit(True).alias("new"), F.lit(-2.0).cast("float").alias("worst"), "y")

    def merged(edges: DataFrame, round_: int) -> DataFrame:
        return materialize(edges.repartition("u").sortWithinPartitions("u").mapInArrow(_merged(near, brought, round_), _GRAPH), f"graph{round_}")

    graph, round_ = merged(_met(first, near, start=True), 0), 0
    while True:
        edges = graph.mapInArrow(_edges, "u long, v long, s float, state tinyint")
        met = edges.filter("state <> 1").select("u", "v", (F.col("state") == 2).alias("new"))
        both = met.select(F.col("u").alias("key"), F.col("v").alias("node"), "new", F.lit(False).alias("back")).unionByName(met.select(F.col("v").alias("key"), F.col("u").alias("node"), "new", F.lit(True).alias("back")))
        turn = Window.partitionBy("key", "new", "back").orderBy(F.xxhash64("key", "node", F.lit(round_)))
        around = both.repartition("key").withColumn("r", F.row_number().over(turn)).filter((F.col("r") <= brought) | ~F.col("back"))
        groups = around.groupBy("key").agg(F.collect_set(F.when(F.col("new"), F.col("node"))).alias("a"), F.collect_set(F.when(~F.col("new"), F.col("node"))).alias("b")).filter("size(a) > 0")
        mark = lambda new: lambda x: F.struct(x.alias("node"), F.lit(new).alias("new"))
        members = groups.select("key", F.explode(F.concat(F.transform("a", mark(True)), F.transform(F.array_except("b", "a"), mark(False)))).alias("m")).select("key", "m.node", "m.new", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"))
        detail = ready.select("node", "y").join(graph.select(F.col("u").alias("node"), "worst"), "node", "left").select("node", "y", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
        found = _met(members.join(detail, ["node", "salt"]), near)
        known = graph.select("u", F.col("nbr").alias("v"), F.col("sim").alias("s"), F.col("fresh").alias("state"))
        graph, round_ = merged(known.unionByName(found), round_ + 1), round_ + 1
        changed = graph.agg(F.sum("changed")).first()[0] or 0
        if changed <= SETTLED * near * count:
            return graph.mapInArrow(_edges, "u long, v long, s float, state tinyint").select("u", "v", "s")


def _top(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, in any order."""
    return np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(s), 1))


def exact_neighbours(ready: DataFrame, asked: DataFrame, width: int, k: int) -> DataFrame:
    """asked: a sample of (node, x) -> (q, node, s), the k best of all nodes for each."""
    sample = asked.collect()
    own = np.array([r.node for r in sample], np.int64)
    x = np.stack([np.frombuffer(r.x, np.float32) for r in sample]) if sample else np.zeros((0, width), np.float32)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, best = np.zeros((len(own), 0), np.int64), np.zeros((len(own), 0), np.float32)
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                batch = whole.slice(i, 4096)
                node = batch.column(0).to_numpy()
                s = x @ _matrix(batch.column(1), width).T
                s[own[:, None] == node[None, :]] = -np.inf
                near = _top(s, k)
                best, ids = np.concatenate([best, np.take_along_axis(s, near, axis=1)], axis=1), np.concatenate([ids, node[near]], axis=1)
                keep = _top(best, k)
                best, ids = np.take_along_axis(best, keep, axis=1), np.take_along_axis(ids, keep, axis=1)
        good = np.isfinite(best).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, best.shape[1])[good]), pa.array(ids.ravel()[good]), pa.array(best.ravel()[good].astype(np.float64))], ["q", "node", "s"])

    return _best(ready.select("node", "x").mapInArrow(exact, "q long, node long, s double"), k)


_STATE = "q long, x binary, nodes binary, scores binary, opened binary, open int"
_FLOAT = np.finfo(np.float32)


class _Pools:
    """The steps of the search on rows of _STATE; nodes of a pool lie best first."""

    def __init__(self, width: int, count: int, pool: int):
        self.width, self.count, self.pool, self.beam, self.held = width, count, pool, max(BEAM, pool // 2), HELD * pool

    def _turn(self, opened: np.ndarray) -> np.ndarray:
        """Places of the nodes that are opened next."""
        return np.flatnonzero(~opened[: self.pool])[: self.beam]

    def opens(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, u = [], [np.zeros(0, np.int64)]
            for own, nodes, opened in zip(*(batch.column(c).to_pylist() for c in ("q", "nodes", "opened")), strict=True):
                u.append(np.frombuffer(nodes, np.int64)[self._turn(np.frombuffer(opened, bool))])
                q += [own] * len(u[-1])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(np.concatenate(u))], ["q", "u"])

    def asks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, q, x, floor, nodes): what the part has to score, and the least score that counts."""
        for batch in batches:
            rows = []
            for q, x, nodes, scores, around in zip(*(batch.column(c) for c in ("q", "x", "nodes", "scores", "around")), strict=True):
                known, best = np.frombuffer(nodes.as_py(), np.int64), np.frombuffer(scores.as_py(), np.float32)
                fresh = np.setdiff1d(around.values.to_numpy(), known)
                part = _part(fresh, self.count)
                order = np.argsort(part, kind="stable")
                fresh, part = fresh[order], part[order]
                floor = float(best[-1]) if len(best) >= self.held else float(_FLOAT.min)
                ends = np.flatnonzero(np.concatenate([part[1:] != part[:-1], [True]])) + 1 if len(part) else []
                rows += [(int(part[b - 1]), q.as_py(), x.as_py(), floor, fresh[a:b].tobytes()) for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.float64(), pa.binary()))], ["part", "q", "x", "floor", "nodes"])

    def score(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (part, asks, id, x, floor, nodes) come sorted by part, its vectors before what is asked; one part's vectors are held at a time."""
        part, held, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, asks, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            change = np.flatnonzero((parts[1:] != parts[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *change], [*change, len(parts)], strict=True):
                if parts[a] != part:
                    part, held, ready = parts[a], [], None
                x = _matrix(batch.column(3).slice(a, b - a), self.width)
                if not asks[a]:
                    held.append((ids[a:b], x))
                    continue
                if ready is None:
                    node = np.concatenate([h[0] for h in held])
                    order = np.argsort(node)
                    ready = node[order], np.concatenate([h[1] for h in held])[order]
                out = []
                floors, wanted = batch.column(4).slice(a, b - a).to_numpy(), batch.column(5).slice(a, b - a).to_pylist()
                for q, own, floor, nodes in zip(ids[a:b].tolist(), x, floors, wanted, strict=True):
                    nodes = np.frombuffer(nodes, np.int64)
                    s = ready[1][np.searchsorted(ready[0], nodes)] @ own
                    good = s >= floor
                    if good.any():
                        out.append((q, nodes[good].tobytes(), s[good].astype(np.float32).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["q", "found", "values"])

    def renew(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Marks what was opened and takes in what was found; found and values are null where nothing was."""
        for batch in batches:
            rows = []
            for q, x, nodes, scores, opened, more in zip(*(batch.column(c).to_pylist() for c in ("q", "x", "nodes", "scores", "opened", "more")), strict=True):
                opened = np.frombuffer(opened, bool).copy()
                opened[self._turn(opened)] = True
                node = np.concatenate([np.frombuffer(b, np.int64) for b in (nodes, *(m["found"] for m in more or ()))])
                s = np.concatenate([np.frombuffer(b, np.float32) for b in (scores, *(m["values"] for m in more or ()))])
                done = np.concatenate([opened, np.zeros(len(node) - len(opened), bool)])
                order = np.lexsort((node, -s))[: self.held]
                node, s, done = node[order], s[order], done[order]
                rows.append((q, x, node.tobytes(), s.tobytes(), done.tobytes(), int((~done[: self.pool]).sum())))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), *[pa.binary()] * 4, pa.int32()))], ["q", "x", "nodes", "scores", "opened", "open"])

    def reopened(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts anew how many nodes of a larger pool are unopened."""
        for batch in batches:
            count = [int((~np.frombuffer(o, bool)[: self.pool]).sum()) for o in batch.column("opened").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(count, pa.int32())], batch.schema.names)


def _first(keep: int):
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(q, node, s) of the best `keep` of each pool and the query's own node, which stands anywhere in it."""
        for batch in batches:
            for q, nodes, scores in zip(*(batch.column(c).to_pylist() for c in ("q", "nodes", "scores")), strict=True):
                node, s = np.frombuffer(nodes, np.int64), np.frombuffer(scores, np.float32)
                some = (np.arange(len(node)) < keep) | (node == q)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(some.sum()), q)), pa.array(node[some]), pa.array(s[some].astype(np.float64))], ["q", "node", "s"])

    return take


def search(ready: DataFrame, graph: DataFrame, asked: DataFrame, width: int, count: int, k: int) -> DataFrame:
    """asked: (node, x) with 0 as x's last component -> (q, node, s), the k + SPARE best nodes found for each."""
    near = near_of(count)
    rank = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s").withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= 2 * near).drop("r")
    lists = materialize(graph.unionByName(back).groupBy("u").agg(F.collect_set("v").alias("around")), "lists")
    queries = asked.count()
    truth = materialize(exact_neighbours(ready, _some(asked, queries, SAMPLE), width, k), "truth")
    wanted = truth.count()
    entries = ready.orderBy("added", "node").limit(ENTRIES).select("node", "x").collect()  # the longest vectors
    entry_ids = np.array([r.node for r in entries], np.int64)
    entry_x = np.stack([np.frombuffer(r.x, np.float32) for r in entries]) if entries else np.zeros((0, width), np.float32)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for q, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(x, np.float32)
                other = entry_ids != q
                node, s = np.concatenate([[q], entry_ids[other]]), np.concatenate([[own @ own], entry_x[other] @ own]).astype(np.float32)
                order = np.lexsort((node, -s))
                rows.append((q, x, node[order].tobytes(), s[order].tobytes(), bytes(len(node)), len(node)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), *[pa.binary()] * 4, pa.int32()))], ["q", "x", "nodes", "scores", "opened", "open"])

    state = materialize(asked.mapInArrow(start, _STATE), "state")
    vectors = ready.select("part", F.lit(False).alias("asks"), F.col("node").alias("id"), "x", F.lit(0.0).alias("floor"), F.lit(b"").alias("nodes"))
    pool, step = min(POOL, max(1, count)), 0
    while True:
        pools = _Pools(width, count, pool)
        while (state.agg(F.sum("open")).first()[0] or 0) > 0:
            opens = state.mapInArrow(pools.opens, "q long, u long").join(lists, "u").groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("around"))).alias("around"))
            asks = state.join(opens, "q").select("q", "x", "nodes", "scores", "around").mapInArrow(pools.asks, "part int, q long, x binary, floor double, nodes binary")
            rows = vectors.unionByName(asks.select("part", F.lit(True).alias("asks"), F.col("q").alias("id"), "x", "floor", "nodes"))
            scored = rows.repartition("part").sortWithinPartitions("part", "asks").mapInArrow(pools.score, "q long, found binary, values binary")
            more = scored.groupBy("q").agg(F.collect_list(F.struct("found", "values")).alias("more"))
            state = materialize(state.join(more, "q", "left").mapInArrow(pools.renew, _STATE), f"state{step}")
            step += 1
        top = state.mapInArrow(_first(k + 1), "q long, node long, s double")
        if pool >= count or top.join(truth.select("q", "node"), ["q", "node"], "left_semi").count() >= RECALL * wanted:
            return state.mapInArrow(_first(k + SPARE), "q long, node long, s double")
        pool = min(2 * pool, count)
        state = materialize(state.mapInArrow(_Pools(width, count, pool).reopened, _STATE), f"state{step}")


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries point along the vectors themselves, without the component that was added."""
    for batch in batches:
        rows = [r[:-4] + bytes(4) for r in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["node", "x"])


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the ids divisible by `every`, against all other rows."""
    bound_arrow(vectors.sparkSession)
    nodes, members, width = _nodes(vectors, id_col, vector_col, k + 1)
    nodes = materialize(nodes, "index")
    # A query beyond its node's first k + 1 ids is found again by its own row.
    clean = vectors.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("query_id") % every == 0).withColumn("v", F.transform("v", lambda x: x + 0.0))
    asked = materialize(clean.groupBy("query_id").agg(F.min("v").alias("v")).join(nodes, "v").select("query_id", "node"), "queries")
    ready, count = _ready(nodes, width)
    graph = materialize(build_graph(ready, count), "graph")
    own = materialize(ready.join(asked.select("node").distinct(), "node").select("node", "x").mapInArrow(_flat, "node long, x binary"), "asked")
    near = search(ready.select("node", "x", "added", "part"), graph, own, width + 1, count, k)
    dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    found = near.join(nodes, "node").join(nodes.select(F.col("node").alias("q"), F.col("v").alias("qv")), "q").select("q", "node", dot.alias("s"))
    rows = asked.join(found.select(F.col("q").alias("node"), F.col("node").alias("near"), "s"), "node").join(members.withColumnRenamed("node", "near"), "near").filter("vec_id <> query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("s").alias("score"))
