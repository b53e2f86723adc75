"""Exact inner-product top-k by dual cover-tree search.

One set of centres, the top of a cover tree over a bounded sample, indexes queries and data
alike; every row goes to its nearest centre, whose covering radius is exact over all rows.  A
query node and a data node are compared only if the bound on their inner products reaches the
node's worst kth score; inside a pair of blocks, cover trees of both sides go on in the same way.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.functions.durable import stored

SAMPLE = 4096  # vectors the centres are taken from, by the hash of their id
NODES = 64  # centres at most, of queries and of data
QUERY_ROWS, DATA_ROWS = 512, 2048  # wanted rows of a block
LEAF, CHILDREN = 32, 16


def packed(matrix: np.ndarray) -> bytes:
    """Whole-number vectors as float32 where that is exact, else float64."""
    exact = not matrix.size or np.abs(matrix).max() <= 1 << 24
    return (b"4" if exact else b"8") + matrix.astype("<f4" if exact else "<f8").tobytes()


def unpacked(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw[1:], "<f4" if raw[:1] == b"4" else "<f8").astype(np.float64).reshape(rows, -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows; Python integers where doubles could round."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 1 << 53:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return whole(a) @ whole(b).T


def cover(points: np.ndarray, separation: float, most: int) -> np.ndarray | None:
    """Farthest-first centres until all points are within ``separation``; None past ``most``."""
    chosen, far = [0], np.linalg.norm(points - points[0], axis=1)
    while far.max() > separation:
        if len(chosen) == most:
            return None
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return np.array(chosen)


class CoverTree:
    """Rows under nodes with a centre and a covering radius; children halve the radius.

    A node whose rows are few, equal, or too far apart for ``CHILDREN`` centres is a leaf.
    """

    def __init__(self, points: np.ndarray, rows: np.ndarray | None = None):
        self.rows = np.arange(len(points)) if rows is None else rows
        mine = points[self.rows]
        self.centre = mine[0]
        self.radius = float(np.linalg.norm(mine - self.centre, axis=1).max())
        self.norm = float(np.linalg.norm(self.centre))
        self.children: list[CoverTree] = []
        if len(mine) <= LEAF or self.radius == 0:
            return
        centres = cover(mine, self.radius / 2, CHILDREN)
        if centres is None or len(centres) < 2:
            return
        nearest = ((mine[centres] ** 2).sum(1) - 2 * mine @ mine[centres].T).argmin(1)
        for c in range(len(centres)):
            part = self.rows[nearest == c]
            if len(part):
                self.children.append(CoverTree(points, part))


def upper_bound(q: CoverTree, d: CoverTree) -> float:
    """No inner product of the two nodes' rows is larger."""
    exact = float(q.centre @ d.centre) + q.radius * d.norm + d.radius * q.norm + q.radius * d.radius
    return exact + 1e-9 * abs(exact) + 1e-6


def dual_search(
    queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, floor: float = -np.inf
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query row, id, score)`` of the ``k`` best of each query; scores below ``floor`` may be
    missing.  Equal scores go to the smaller id; a query's own id is left out."""
    order = np.argsort(ids, kind="stable")
    data, ids = data[order], ids[order]
    best = np.full((len(queries), k), -np.inf, object if np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * data.shape[1] >= 1 << 53 else float)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
    count = 0
    q, d = CoverTree(queries), CoverTree(data)
    heap = [(-upper_bound(q, d), count, q, d)]
    while heap:
        bound, _, q, d = heapq.heappop(heap)
        if -bound < max(floor, float(best[q.rows, -1].min())):
            continue
        if not q.children and not d.children:
            rows = d.rows
            score = np.where(ids[rows] == query_ids[q.rows][:, None], -np.inf, products(queries[q.rows], data[rows]))
            both = np.concatenate([best[q.rows], score], 1)
            names = np.concatenate([best_id[q.rows], np.broadcast_to(ids[rows], score.shape)], 1)
            # Best first, equal scores by id: a stable sort by id, then by score.
            by_id = np.argsort(names, axis=1, kind="stable")
            both, names = np.take_along_axis(both, by_id, 1), np.take_along_axis(names, by_id, 1)
            top = np.argsort(-both, axis=1, kind="stable")[:, :k]
            best[q.rows], best_id[q.rows] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
            continue
        split_q = q.children and (not d.children or q.radius > d.radius)
        for a, b in ((c, d) for c in q.children) if split_q else ((q, c) for c in d.children):
            count += 1
            heapq.heappush(heap, (-upper_bound(a, b), count, a, b))
    row, place = np.nonzero(best_id < np.iinfo(np.int64).max)
    real = best[row, place] != -np.inf
    row, place = row[real], place[real]
    return row, best_id[row, place], best[row, place].astype(np.int64)


def whole_vectors(rows: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """``_id, dim, v``: floor(scale * x) of every usable vector, packed one by one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_v").cast(pa.large_list(pa.float64()))
            ids, dims, out = [], [], []
            values = lists.values.fill_null(np.nan).to_numpy(zero_copy_only=False)
            offsets = lists.offsets.to_numpy()
            for i, (s, e) in enumerate(zip(offsets, offsets[1:])):
                if lists[i].is_valid and e > s and np.isfinite(values[s:e]).all():
                    ids.append(i)
                    dims.append(e - s)
                    out.append(packed(np.floor(values[s:e] * scale)))
            took = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(took), pa.array(dims, pa.int64()), pa.array(out, pa.binary())], names=["_id", "dim", "v"]
            )

    usable = rows.select(F.col(vec_id).cast("bigint").alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    return usable.filter("_id is not null").mapInArrow(work, "_id bigint, dim bigint, v binary")


def _blocks(rows: DataFrame, centres: np.ndarray, limit: int) -> DataFrame:
    """``node, n, radius, ids, m``: rows of each task packed by their nearest centre."""
    given = rows.sparkSession.sparkContext.broadcast(centres)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = given.value
        held: dict[int, list] = {}

        def out(node: int) -> pa.RecordBatch:
            ids, points = (np.concatenate(x) for x in zip(*held.pop(node)))
            radius = float(np.linalg.norm(points - middle[node], axis=1).max())
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((node, pa.int64()), (len(ids), pa.int64()), (radius, pa.float64()), (ids.astype("<i8").tobytes(), pa.binary()), (packed(points), pa.binary()))],
                names=["node", "n", "radius", "ids", "m"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, limit):
                part = batch.slice(at, limit)
                ids = part.column("_id").to_numpy()
                points = np.concatenate([unpacked(v, 1) for v in part.column("v").to_pylist()])
                nearest = ((middle**2).sum(1) - 2 * points @ middle.T).argmin(1)
                for node in np.unique(nearest):
                    mine = nearest == node
                    held.setdefault(int(node), []).append((ids[mine], points[mine]))
                    if sum(len(x) for x, _ in held[int(node)]) >= limit:
                        yield out(int(node))
        for node in list(held):
            yield out(node)

    return rows.mapInArrow(work, "node bigint, n bigint, radius double, ids binary, m binary")


def _searched(units: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score``: the ``k`` best of every unit (a query block and a data block)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                queries, data = unpacked(row["qm"], row["qn"]), unpacked(row["m"], row["n"])
                query_ids, ids = np.frombuffer(row["qids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                at, vec, score = dual_search(queries, query_ids, data, ids, k, row["floor"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_ids[at]), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"]
                )

    return units.mapInArrow(work, "query_id bigint, vec_id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def _of_dimension(spark, data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    sample = data.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).toArrow()
    points = np.concatenate([unpacked(v, 1) for v in sample["v"].to_pylist()])
    n_data, n_queries = data.count(), queries.count()

    def centres(n: int, wanted: int) -> np.ndarray:
        most = int(min(NODES, -(-n // wanted)))
        spread = np.linalg.norm(points - points[0], axis=1).max()
        # The finest level of the cover tree that has no more nodes than wanted.
        found = np.zeros(1, np.int64)
        while spread > 0 and (finer := cover(points, spread / 2, most)) is not None:
            found, spread = finer, spread / 2
        return points[found]

    c_q, c_d = centres(n_queries, QUERY_ROWS), centres(n_data, DATA_ROWS)
    # Few, small partitions: a block should be as large as wanted.
    q_blocks = stored(_blocks(queries.coalesce(max(1, n_queries // (4 * QUERY_ROWS))), c_q, QUERY_ROWS))
    d_blocks = stored(_blocks(data, c_d, DATA_ROWS))
    q_blocks = q_blocks.select(
        F.col("node").alias("qnode"), F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("m").alias("qm"), "radius"
    )
    # At most NODES rows each.
    reach = lambda blocks, node: {r[0]: r[1] for r in blocks.groupBy(node).agg(F.max("radius")).collect()}
    r_q, r_d = reach(q_blocks, "qnode"), reach(d_blocks, "node")
    q_blocks = q_blocks.drop("radius")

    def bound(q: int, d: int) -> float:
        a, b = np.linalg.norm(c_q[q]), np.linalg.norm(c_d[d])
        exact = float(c_q[q] @ c_d[d]) + r_q[q] * b + r_d[d] * a + r_q[q] * r_d[d]
        return exact + 1e-9 * abs(exact) + 1e-6

    def units(pairs: list[tuple[int, int, float]]) -> DataFrame:
        table = spark.createDataFrame(pairs, "qnode bigint, node bigint, floor double")
        return d_blocks.drop("radius").join(F.broadcast(table), "node").join(q_blocks, "qnode")

    # First the data node with the largest bound for each query node: that gives worst kth scores.
    first = {q: max(r_d, key=lambda d: bound(q, d)) for q in r_q}
    begun = stored(_best(_searched(units([(q, d, float("-inf")) for q, d in first.items()]), k), k))
    nodes = q_blocks.select("qnode", F.col("qids"))
    given = _query_nodes(nodes)
    kth = begun.filter(F.col("rank") == k).select("query_id", "score")
    worst = given.join(kth, "query_id", "left").groupBy("qnode").agg(
        F.min(F.coalesce(F.col("score").cast("double"), F.lit(float("-inf")))).alias("floor")
    )
    floors = {r[0]: r[1] for r in worst.collect()}  # at most NODES rows
    rest = [(q, d, floors[q]) for q in r_q for d in r_d if d != first[q] and bound(q, d) >= floors[q]]
    found = begun.drop("rank")
    if rest:
        found = found.unionAll(_searched(units(rest), k))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def _query_nodes(blocks: DataFrame) -> DataFrame:
    """``qnode, query_id`` of every query."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, ids in zip(batch.column("qnode").to_pylist(), batch.column("qids").to_pylist()):
                mine = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), node)), pa.array(mine)], names=["qnode", "query_id"])

    return blocks.mapInArrow(work, "qnode bigint, query_id bigint")


def top_k(
    rows: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best rows for every query row.

    Components are floor(scale * x); the score is their integer inner product, equal scores go to
    the smaller id, a query's own id takes no part.  With fewer candidates all are returned.

    Vectors that are null, empty or hold a null or non-finite component, and rows without an id,
    take no part.  Vectors of one length are searched among themselves.  Rows that share an id are
    candidates each; as queries their answers are one list.  Scores must fit a bigint.
    """
    spark = rows.sparkSession
    data = whole_vectors(rows, vec_id, vector, scale).withColumn("_query", F.lit(False))
    asked = whole_vectors(rows.filter(is_query), vec_id, vector, scale).withColumn("_query", F.lit(True))
    both = stored(data.unionAll(asked))
    out = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    for (dim,) in both.filter("_query").select("dim").distinct().collect():
        mine = both.filter(F.col("dim") == dim)
        out = out.unionAll(_of_dimension(spark, mine.filter("not _query"), mine.filter("_query"), k))
    return out
