"""Exact top-k by inner product: a ball tree per shard, searched best bound first, shards sharing each query's k-th score.

A shard holds a bounded number of vectors and is packed into one row with its tree; a block of queries is one row as well, so memory
is bounded by the two blocks.  A pilot shard is searched first; its k-th scores are lower bounds that every other shard starts from.

Defined results: rows without an id and vectors that are null, empty, of another length than the first, or hold null or non-finite parts take no part; rows
that share an id count once (the least vector); ties go to the smaller id; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8192
QUERY_ROWS = 2048
LEAF = 128

TREE = "shard long, ids binary, vectors binary, nodes binary, size int"


def build_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows and nodes (from, to, left, right, radius, centre...) of a ball tree; children are halves along the widest direction."""
    order = np.arange(len(v))
    nodes: list[np.ndarray] = []

    def grow(lo: int, hi: int) -> int:
        rows = v[order[lo:hi]]
        centre = rows.mean(axis=0)
        gap = rows - centre
        far = np.sqrt((gap * gap).sum(axis=1))
        at = len(nodes)
        nodes.append(np.concatenate([[lo, hi, -1, -1, far.max()], centre]))
        if hi - lo > LEAF and far.max() > 0:
            pole = rows[far.argmax()]
            other = rows[((rows - pole) ** 2).sum(axis=1).argmax()]
            side = rows @ (other - pole)
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argsort(side, kind="stable")]
            nodes[at][2] = grow(lo, lo + mid)
            nodes[at][3] = grow(lo + mid, hi)
        return at

    grow(0, len(v))
    return order, np.array(nodes)


def search(queries: np.ndarray, qids: np.ndarray, floor: np.ndarray, ids: np.ndarray, v: np.ndarray, nodes: np.ndarray, k: int):
    """Best k rows of one shard for each query, given scores ``floor`` that its k-th best reaches for sure (-inf if unknown)."""
    n = len(queries)
    best = np.full((n, k), -np.inf)
    who = np.full((n, k), np.iinfo(np.int64).max)
    norms = np.sqrt((queries * queries).sum(axis=1))
    bound = floor.copy()

    def upper(node: np.ndarray, rows: np.ndarray) -> np.ndarray:
        # Rounding of centres is covered by the last term: bounds may be loose but never too low.
        reach = norms[rows] * node[4]
        middle = queries[rows] @ node[5:]
        return middle + reach + 1e-6 * (1.0 + np.abs(middle) + reach)

    every = np.arange(n)
    first = upper(nodes[0], every)
    heap = [(-float(first.max(initial=-np.inf)), 0, every, first)]
    while heap:
        _, at, rows, ub = heapq.heappop(heap)
        alive = ub >= bound[rows]
        rows = rows[alive]
        if not len(rows):
            continue
        node = nodes[at]
        if node[2] >= 0:
            for child in (int(node[2]), int(node[3])):
                ub = upper(nodes[child], rows)
                on = ub >= bound[rows]
                if on.any():
                    heapq.heappush(heap, (-float(ub[on].max()), child, rows[on], ub[on]))
            continue
        lo, hi = int(node[0]), int(node[1])
        scores = queries[rows] @ v[lo:hi].T
        scores[qids[rows][:, None] == ids[None, lo:hi]] = -np.inf
        hit = np.flatnonzero((scores >= bound[rows][:, None]).any(axis=1))
        if not len(hit):
            continue
        rows, scores = rows[hit], scores[hit]
        both = np.concatenate([best[rows], scores], axis=1)
        names = np.concatenate([who[rows], np.broadcast_to(ids[lo:hi], scores.shape)], axis=1)
        pick = np.lexsort((names, -both), axis=1)[:, :k]
        best[rows] = np.take_along_axis(both, pick, axis=1)
        who[rows] = np.take_along_axis(names, pick, axis=1)
        bound[rows] = np.maximum(bound[rows], best[rows, -1])
    return best, who


def _pack_shard(dim: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        v = np.array(rows["v"].tolist(), np.float64).reshape(len(rows), dim)
        ids = rows["id"].to_numpy(np.int64)
        if len(ids) > 1 and (ids[1:] == ids[:-1]).any():
            keep = np.lexsort((*v.T[::-1], ids))
            v, ids = v[keep], ids[keep]
            once = np.concatenate([[True], ids[1:] != ids[:-1]])
            v, ids = v[once], ids[once]
        order, nodes = build_tree(v)
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "ids": [ids[order].tobytes()], "vectors": [v[order].tobytes()], "nodes": [nodes.tobytes()], "size": [len(ids)]})

    return pack


def _pack_queries(dim: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("id")
        v = np.array(rows["v"].tolist(), np.float64).reshape(len(rows), dim)
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "qids": [rows["id"].to_numpy(np.int64).tobytes()], "queries": [v.tobytes()]})

    return pack


def _search_rows(dim: int, k: int):
    def run(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                q = np.frombuffer(r.queries, np.float64).reshape(-1, dim)
                qids = np.frombuffer(r.qids, np.int64)
                floor = np.full(len(q), -np.inf) if r.floors is None else np.frombuffer(r.floors, np.float64)
                v = np.frombuffer(r.vectors, np.float64).reshape(-1, dim)
                nodes = np.frombuffer(r.nodes, np.float64).reshape(-1, dim + 5)
                best, who = search(q, qids, floor, np.frombuffer(r.ids, np.int64), v, nodes, k)
                row, col = np.nonzero(np.isfinite(best))
                yield pd.DataFrame({"block": r.block, "query_id": qids[row], "vec_id": who[row, col], "score": best[row, col]})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, stage) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` from columns ``id`` and ``v`` (arrays of double); a query never finds its own id.

    ``stage`` writes a table and reads it back.  Scores are exact while they stay below 2**53.
    """
    whole = lambda d: d.where("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    vectors, queries = whole(vectors.select("id", "v").where("id is not null")), whole(queries.select("id", "v").where("id is not null"))
    shape = vectors.agg(F.count(F.lit(1)).alias("n"), F.min_by(F.size("v"), "id").alias("dim")).first()
    asked = queries.count()
    dim, spark = shape["dim"], vectors.sparkSession
    if not dim or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_shards, n_blocks = -(-shape["n"] // SHARD_ROWS), -(-asked // QUERY_ROWS)
    same = F.size("v") == dim
    shards = stage(
        vectors.where(same).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n_shards))).groupBy("shard").applyInPandas(_pack_shard(dim), TREE)
    )
    blocks = stage(
        queries.where(same).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_blocks))).groupBy("block").applyInPandas(
            _pack_queries(dim), "block long, qids binary, queries binary"
        )
    )
    found = "block long, query_id long, vec_id long, score double"
    meet = blocks.withColumn("floors", F.lit(None).cast("binary")).withColumn("shard", F.least(F.col("block"), F.lit(0)))  # shard 0
    # One row of at most SHARD_ROWS vectors goes to every task; a join by key would bring all blocks to it.
    pilot = stage(meet.repartition("block").join(F.broadcast(shards.where("shard = 0")), "shard").mapInPandas(_search_rows(dim, k), found))
    kth = pilot.groupBy("block", "query_id").agg(F.when(F.count("score") == k, F.min("score")).alias("kth"))

    def with_floor(group: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return group.assign(floors=pd.Series(dtype=object))
        at = dict(zip(bounds["query_id"], bounds["kth"].fillna(-np.inf), strict=True))
        qids = np.frombuffer(group["qids"].iloc[0], np.int64)
        return group.assign(floors=[np.array([at.get(q, -np.inf) for q in qids.tolist()], np.float64).tobytes()])

    bounded = blocks.groupBy("block").cogroup(kth.groupBy("block")).applyInPandas(with_floor, "block long, qids binary, queries binary, floors binary")
    rest = bounded.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)).cast("array<long>"))).where("shard > 0")
    others = rest.repartition("shard", "block").join(shards, "shard").mapInPandas(_search_rows(dim, k), found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pilot.unionByName(others).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
