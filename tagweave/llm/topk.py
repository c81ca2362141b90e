"""Exact top-k inner-product search: ball trees over shards, branch and bound.

1. Regions: planes fitted on at most ``SAMPLE_ROWS`` rows cut the space into at most 2^``MAX_DEPTH``
   regions; every row is placed.  A region is dealt into as many shards as its size asks for, so a region
   (or one vector) that holds a third of all rows makes many shards.
2. A shard's ball tree is built once and stored: nodes in preorder with centre and radius, rows in leaf order.
   No vector below a node scores more than <q, centre> + |q| * radius.
3. Roots are packed in groups.  A block of queries meets each group; every query first searches its best
   root of the group.  The k-th score it has reached over all groups is where the rest starts:
   a query is sent on only to shards whose root can reach it.
4. In a tree a query opens the node of highest bound next; an inner node adds its children, a leaf is
   scored, and all ends once the highest bound is below the current k-th score.

Scale: queries meet root groups in blocks and shards as the part of a block that can still win; all are of bounded
size, and no pair of single rows is formed.  A block and a shard give at most k rows per query.

Defined results: vectors that are null or hold null or non-finite components take no part, neither as
query nor as candidate; only vectors of equal length meet; ties go to the smaller vec_id; a repeated vec_id is a row of
its own, but never a candidate of a query with that id; fewer than k candidates give fewer rows; null
vec_id takes no part; arithmetic is exact (64-bit floats while all products stay below 2^53, else
Python integers, kept to the range of a long).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lookup import lookup
from .common import staged

SHARD_ROWS = 8192
BLOCK_ROWS = 2048
LEAF_ROWS = 128
GROUP_ROOTS = 1024
SAMPLE_ROWS = 4096
MAX_DEPTH = 8
NO_FLOOR = np.iinfo(np.int64).min
SLACK = 1e-9  # of the bounds, against rounding


def far_ends(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two rows at opposite ends of the ball around ``x``."""
    a = x[np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1))]
    return a, x[np.argmax(((x - a) ** 2).sum(axis=1))]


class BallTree:
    """Rows in leaf order; nodes in preorder: first row, end row, left and right child (-1: a leaf), centre, radius."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS):
        x = rows.astype(np.float64)
        order = np.arange(len(ids))
        nodes, centre, radius = [], [], []
        todo = [(0, len(ids), None)]
        while todo:
            lo, hi, link = todo.pop()
            own, at = order[lo:hi], len(nodes)
            c = x[own].mean(axis=0)
            nodes.append([lo, hi, -1, -1])
            centre.append(c)
            radius.append(np.sqrt(((x[own] - c) ** 2).sum(axis=1).max()))
            if link:
                nodes[link[0]][link[1]] = at
            if hi - lo > leaf:
                a, b = far_ends(x[own])
                if (a != b).any():
                    mid = (lo + hi) // 2
                    order[lo:hi] = own[np.argsort(x[own] @ (b - a), kind="stable")]
                    todo += [(mid, hi, (at, 3)), (lo, mid, (at, 2))]
        self.ids, self.rows = ids[order], rows[order]
        self.nodes, self.centre, self.radius = np.array(nodes, np.int64), np.array(centre), np.array(radius)

    def pack(self) -> bytes:
        head = np.array([*self.rows.shape, len(self.nodes)], dtype=np.int64)
        return b"".join(a.tobytes() for a in (head, self.ids, self.rows, self.nodes, self.centre, self.radius))

    @classmethod
    def unpack(cls, raw: bytes) -> BallTree:
        t = cls.__new__(cls)
        n, d, s = np.frombuffer(raw, np.int64, 3).tolist()
        at = 24
        parts = []
        for dtype, shape in ((np.int64, (n,)), (np.int64, (n, d)), (np.int64, (s, 4)), (np.float64, (s, d)), (np.float64, (s,))):
            size = int(np.prod(shape))
            parts.append(np.frombuffer(raw, dtype, size, at).reshape(shape))
            at += 8 * size
        t.ids, t.rows, t.nodes, t.centre, t.radius = parts
        return t


def bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Query x ball: no inner product with a vector of the ball is above this."""
    norm = np.sqrt((q ** 2).sum(axis=1))[:, None]
    b = q @ centre.T + norm * radius
    return b + SLACK * (1 + np.abs(b) + norm * (1 + np.sqrt((centre ** 2).sum(axis=1)) + radius))


def products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    big = float(np.abs(q).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1]
    if big < 2 ** 53:
        return (rows.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    exact = rows.astype(object) @ q.astype(object)
    return np.array([max(-2 ** 63, min(2 ** 63 - 1, int(v))) for v in exact], dtype=np.int64)


def search(tree: BallTree, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, scored: np.ndarray | None = None):
    """(query index, vec_id, score) of each query's best k rows of this tree that reach ``floor``.

    All queries go in step: each round every open query takes its node of highest bound, and the queries that
    took one node share a matrix product.  ``scored`` counts each query's leaves.
    """
    n = len(q_ids)
    if not n or not len(tree.ids):
        return np.zeros((3, 0), np.int64)
    qf, rows = q.astype(np.float64), tree.rows.astype(np.float64)
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(rows).max(initial=0)) * q.shape[1] < 2 ** 53
    best_s, best_i, have = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros(n, np.int64)
    kth = floor.astype(np.int64).copy()
    front = np.full((n, len(tree.nodes)), -np.inf)
    front[:, :1] = bounds(qf, tree.centre[:1], tree.radius[:1])
    open_ = np.arange(n)
    while True:
        node = front[open_].argmax(axis=1)
        high = front[open_, node]
        ahead = (high >= kth[open_]) & (high > -np.inf)
        open_, node = open_[ahead], node[ahead]
        if not len(open_):
            break
        front[open_, node] = -np.inf
        by = np.argsort(node, kind="stable")
        for own in np.split(by, np.flatnonzero(np.diff(node[by])) + 1):
            qi, (a, b, left, right) = open_[own], tree.nodes[node[own[0]]]
            if left >= 0:
                pair = [left, right]
                front[np.ix_(qi, pair)] = bounds(qf[qi], tree.centre[pair], tree.radius[pair])
                continue
            if scored is not None:
                scored[qi] += 1
            if exact:
                s = (qf[qi] @ rows[a:b].T).astype(np.int64)
            else:
                s = np.array([products(q[i], tree.rows[a:b]) for i in qi])
            ids = np.broadcast_to(tree.ids[a:b], s.shape)
            live = (s >= kth[qi][:, None]) & (ids != q_ids[qi][:, None])
            for j in np.flatnonzero(live.any(axis=1)):
                at, i = np.flatnonzero(live[j]), qi[j]
                all_s = np.concatenate([best_s[i, :have[i]], s[j, at]])
                all_i = np.concatenate([best_i[i, :have[i]], ids[j, at]])
                top = np.lexsort((all_i, ~all_s))[:k]
                have[i] = len(top)
                best_s[i, :have[i]], best_i[i, :have[i]] = all_s[top], all_i[top]
                if have[i] == k:
                    kth[i] = max(kth[i], best_s[i, -1])
    found = np.arange(k) < have[:, None]
    return np.stack([np.nonzero(found)[0], best_i[found], best_s[found]])


def quantised(vectors: DataFrame, factor: int = 64) -> DataFrame:
    """(vec_id, v): floor(factor * x) of every component, as longs; unusable vectors left out."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"),
                                    F.transform(x, lambda e: F.floor(e * factor).cast("long")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), -1)


def fit_planes(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Normals and offsets of a full tree of ``depth`` levels of planes, each halving its rows; rows above go right."""
    normal, offset = np.zeros((2 ** depth - 1, x.shape[1])), np.zeros(2 ** depth - 1)
    parts = {0: x}
    for node in range(2 ** depth - 1):
        own = parts.pop(node)
        if len(own) > 1:
            a, b = far_ends(own)
            normal[node] = b - a
            along = own @ normal[node]
            offset[node] = np.median(along)
            parts[2 * node + 1], parts[2 * node + 2] = own[along <= offset[node]], own[along > offset[node]]
        else:
            parts[2 * node + 1], parts[2 * node + 2] = own, own[:0]
    return normal, offset


def region_of(x: np.ndarray, normal: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Leaf number of each row in the tree of planes."""
    node = np.zeros(len(x), np.int64)
    for _ in range(len(offset).bit_length()):
        node = 2 * node + 1 + ((x * normal[node]).sum(axis=1) > offset[node])
    return node - len(offset)


def _placer(planes: dict):
    """(vec_id, v) -> with the vector's length and region."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.column(0), batch.column(1)
            dim = pc.list_value_length(v).to_numpy(zero_copy_only=False)
            region = np.zeros(len(dim), np.int32)
            for d in np.unique(dim).tolist():
                if d in planes:
                    at = np.flatnonzero(dim == d)
                    region[at] = region_of(_matrix(v.take(pa.array(at))).astype(np.float64), *planes[d])
            yield pa.RecordBatch.from_arrays([ids, v, pa.array(dim, pa.int32()), pa.array(region)],
                                             names=["vec_id", "v", "dim", "region"])
    return run


def _planes(vectors: DataFrame, n_shards: int) -> dict:
    """Planes of every length in a sample of ``SAMPLE_ROWS`` rows, least id hash first."""
    depth = min(MAX_DEPTH, (n_shards - 1).bit_length())
    if not depth:
        return {}
    by_dim: dict[int, list] = {}
    for row in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).collect():
        by_dim.setdefault(len(row["v"]), []).append(row["v"])
    return {d: fit_planes(np.array(v, np.float64), depth) for d, v in by_dim.items()}


def _packed_trees(t: pa.Table) -> pa.Table:
    tree = BallTree(t.column("vec_id").to_numpy(), _matrix(t.column("v")))
    return pa.table({**{c: t.column(c).slice(0, 1) for c in ("dim", "region", "piece")},
                     "centre": pa.array([tree.centre[0].tobytes()]), "radius": pa.array([float(tree.radius[0])]),
                     "tree": pa.array([tree.pack()], pa.binary())})


def _packed_queries(t: pa.Table) -> pa.Table:
    ids, rows = t.column("vec_id").to_numpy(), _matrix(t.column("v"))
    return pa.table({"dim": [t.column("dim")[0].as_py()], "block": [t.column("block")[0].as_py()], "ids": [ids.tobytes()],
                     "rows": [rows.tobytes()]},
                    schema=pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary())]))


def _floors(ids: np.ndarray, known: list | None) -> np.ndarray:
    at = {f["query_id"]: f["kth"] for f in known or ()}
    return np.array([at.get(i, NO_FLOOR) for i in ids.tolist()], dtype=np.int64)


_SENT = "dim int, region int, piece int, ids binary, rows binary, floors binary"


def _router(pilot: bool):
    """Map over (query block [, floors], root group) rows: the queries to send to a shard of the group.  The pilot
    round sends each query to its best root, the other round to all other roots that reach its floor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids = np.frombuffer(row["ids"], np.int64)
                q = np.frombuffer(row["rows"], np.int64).reshape(len(ids), -1)
                roots = row["roots"]
                centre = np.frombuffer(b"".join(r["centre"] for r in roots)).reshape(len(roots), -1)
                high = bounds(q.astype(np.float64), centre, np.array([r["radius"] for r in roots]))
                first = high.argmax(axis=1)[:, None] == np.arange(len(roots))
                floor = np.full(len(ids), NO_FLOOR) if pilot else _floors(ids, row["floors"])
                go = first if pilot else ~first & (high >= floor[:, None])
                for j in np.flatnonzero(go.any(axis=0)):
                    at = go[:, j]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["dim"]], pa.int32()), pa.array([roots[j]["region"]], pa.int32()),
                         pa.array([roots[j]["piece"]], pa.int32()), pa.array([ids[at].tobytes()], pa.binary()),
                         pa.array([q[at].tobytes()], pa.binary()), pa.array([floor[at].tobytes()], pa.binary())],
                        names=["dim", "region", "piece", "ids", "rows", "floors"])
    return run


def _searcher(k: int):
    """Map over (queries, tree) rows, one row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                ids, floor = (np.frombuffer(column[c][i].as_py(), np.int64) for c in ("ids", "floors"))
                q = np.frombuffer(column["rows"][i].as_py(), np.int64).reshape(len(ids), -1)
                at, vec, score = search(BallTree.unpack(column["tree"][i].as_py()), ids, q, floor, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(vec), pa.array(score)],
                                                 names=["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS,
          block_rows: int = BLOCK_ROWS, group_roots: int = GROUP_ROOTS) -> DataFrame:
    """``vectors`` and ``queries``: (vec_id, v array<long>).  (query_id, rank, vec_id, score)."""
    spark = vectors.sparkSession
    vectors = staged(vectors.select("vec_id", "v"), "topk-vectors")
    queries = staged(queries.select("vec_id", "v").distinct(), "topk-queries")
    n_shards = max(1, -(-vectors.count() // shard_rows))
    n_blocks = max(1, -(-queries.count() // block_rows))
    parts = max(1, min(n_shards * n_blocks, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))

    # a written row number deals a region's rows into its shards, whatever ids and vectors repeat
    placed = staged(vectors.mapInArrow(_placer(_planes(vectors, n_shards)), "vec_id long, v array<bigint>, dim int, region int")
                    .withColumn("no", F.monotonically_increasing_id()), "topk-placed")
    cell = F.col("dim").cast("long") * 2 ** MAX_DEPTH + F.col("region")
    sizes = placed.groupBy(cell.alias("cell")).agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("pieces"))
    dealt = lookup(placed, sizes, cell, "cell").withColumn("piece", F.pmod(F.xxhash64("no"), F.col("pieces")).cast("int"))
    trees = staged(dealt.select("dim", "region", "piece", "vec_id", "v").groupBy("dim", "region", "piece").applyInArrow(
        _packed_trees, "dim int, region int, piece int, centre binary, radius double, tree binary"), "topk-trees")
    n_groups = max(1, -(-trees.count() // group_roots))
    groups = staged(trees.groupBy("dim", F.pmod(F.xxhash64("region", "piece"), F.lit(n_groups)).cast("int").alias("group")).agg(
        F.collect_list(F.struct("region", "piece", "centre", "radius")).alias("roots")), "topk-roots")

    # block x root group: a group stands for GROUP_ROOTS shards, so its ids are few
    own_groups = groups.groupBy(F.col("dim").alias("of_dim")).agg(F.collect_list("group").alias("groups"))
    blocks = staged(queries.withColumn("dim", F.size("v")).withColumn(
        "block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).cast("int")).groupBy("dim", "block").applyInArrow(
        _packed_queries, "dim int, block int, ids binary, rows binary"), "topk-blocks")

    def searched(to_send: DataFrame, pilot: bool) -> DataFrame:
        met = lookup(to_send, own_groups, F.col("dim"), "of_dim").withColumn("group", F.explode("groups")).drop("groups", "of_dim")
        met = met.repartition(parts, "dim", "block", "group").join(groups, ["dim", "group"])
        sent = met.mapInArrow(_router(pilot), _SENT).repartition(parts, "dim", "region", "piece")
        keys = ["dim", "region", "piece"]
        return sent.join(trees.select(*keys, "tree"), keys).mapInArrow(_searcher(k), "query_id long, vec_id long, score long")

    first = staged(searched(blocks, True), "topk-pilot")
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    reached = first.withColumn("place", F.row_number().over(place)).where(F.col("place") == k) \
        .select("query_id", F.col("score").alias("kth"))
    floors = reached.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(n_blocks)).cast("int")) \
        .groupBy("block").agg(F.collect_list(F.struct("query_id", "kth")).alias("floors"))
    rest = searched(blocks.join(floors, "block", "left"), False)
    return first.unionByName(rest).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def report(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """Queries: the rows whose vec_id is divisible by ``every``, against all rows."""
    vectors = quantised(embeddings)
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)
