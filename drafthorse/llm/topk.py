"""Exact top-k search by integer inner product, block at a time.

Rows stand in blocks of consecutive ids. A block has, for each dimension (term), its greatest and its least weight;
the sum over the dimensions of the greater of q * max and q * min bounds every score of query q in the block. A
query takes the blocks of a tile in the order of these bounds, scores a block through its forward index (its rows),
and stops when the next bound is below its k-th best score so far. Bounds that equal it are still looked at, for ties.

A query is first scored in the tile of rows that it stands in itself: its k-th best score there is a floor under its
k-th best score of all. Bounds of all blocks, in tiles of bounds, then tell the shards that can reach the floor; a query
goes to these alone, and looks in each at the blocks whose bounds reach the floor. How many these are depends on the
vectors: ids in an order that keeps like ones together prune much, random unit vectors nothing.

Queries and rows are dealt into tiles of bounded size (blocks of queries against shards of blocks), so neither side
is collected or broadcast; each tile hands on at most k rows a query, and the k best of those are taken.

Defined cases. Vectors that are null, empty or hold null or non-finite components take no part, nor do null ids and
vectors of another length than the most usual one. Of rows that repeat an id the least
vector stands. Components and scores beyond 64 bits count as the least or greatest long. Fewer than k candidates: all
are returned. No query or an empty table: empty.
"""

from __future__ import annotations

from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .vectors import above, best, ranked, renewed, usable

BLOCK = 512
SHARD = 16
#: Blocks whose bounds are worked out at once.
BOUNDS = 1024
QUERIES = 2048
LOWEST = np.iinfo(np.int64).min


def _long_lists(t: pa.Table, name: str, dim: int) -> np.ndarray:
    return t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _floors(k: int, dim: int):
    """(id, floor) of the queries of a tile: the k-th best score among the tile's other rows, LOWEST if these are fewer."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, floor = left.column("id").to_numpy(), np.full(left.num_rows, LOWEST, np.int64)
        if left.num_rows and right.num_rows > k:
            q, x, xid = _long_lists(left, "v", dim), _long_lists(right, "v", dim), right.column("id").to_numpy()
            if float(np.abs(q).max()) * float(np.abs(x).max()) * dim < 2**53:
                x = x.astype(np.float64)
                for i in range(0, len(q), 256):
                    s = q[i : i + 256].astype(np.float64) @ x.T
                    s[xid[None, :] == ids[i : i + 256, None]] = -np.inf
                    floor[i : i + 256] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k].astype(np.int64)
        return pa.table({"id": ids, "floor": floor}, schema=pa.schema([("id", pa.int64()), ("floor", pa.int64())]))

    return run


def _summaries(dim: int):
    """(shard, piece, block, top, low): the greatest and least weights of each block of a tile."""
    longs = pa.list_(pa.int64())
    types = pa.schema([("shard", pa.int64()), ("piece", pa.int32()), ("block", pa.int64()), ("top", longs), ("low", longs)])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        x, block = _long_lists(t, "v", dim), t.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        x, block = x[order], block[order]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1])
        lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, dim, dtype=np.int32)), pa.array(m.ravel()))
        n = len(starts)
        shard, piece = (k.as_py() for k in key)
        return pa.table([np.full(n, shard), np.full(n, piece, np.int32), block[starts], lists(np.maximum.reduceat(x, starts)), lists(np.minimum.reduceat(x, starts))], schema=types)

    return run


def _reached(dim: int):
    """(id, shard, piece): the tiles with a block whose bound reaches a query's floor."""
    types = pa.schema([("id", pa.int64()), ("shard", pa.int64()), ("piece", pa.int32())])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return types.empty_table()
        q, top, low = (a.astype(np.float64) for a in (_long_lists(left, "v", dim), _long_lists(right, "top", dim), _long_lists(right, "low", dim)))
        ids, floor = left.column("id").to_numpy(), left.column("floor").to_numpy()
        shard, piece = right.column("shard").to_numpy(), right.column("piece").to_numpy()
        tiles, tile = np.unique(np.stack([shard, piece.astype(np.int64)]), axis=1, return_inverse=True)
        order = np.argsort(tile.ravel(), kind="stable")
        starts = np.searchsorted(tile.ravel()[order], np.arange(tiles.shape[1]))
        out = []
        for i in range(0, len(q), 512):
            some = q[i : i + 512]
            bound = np.maximum.reduceat((np.maximum(some, 0) @ top.T + np.minimum(some, 0) @ low.T)[:, order], starts, axis=1)
            # bounds of great weights are not exact in doubles: a little is added
            given = floor[i : i + 512, None]
            r, c = np.nonzero((bound + 1e-9 * np.abs(bound) >= given.astype(np.float64)) | (given == LOWEST))
            out.append((ids[r + i], tiles[0][c], tiles[1][c].astype(np.int32)))
        return pa.table([np.concatenate([o[j] for o in out]) for j in range(3)], schema=types)

    return run


def _search(k: int, dim: int):
    types = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return types.empty_table()
        flat = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        q, qid, given = flat(left), left.column("id").to_numpy(), left.column("floor").to_numpy()
        x, xid, block = flat(right), right.column("id").to_numpy(), right.column("block").to_numpy()
        order = np.lexsort((xid, block))
        x, xid, block = x[order], xid[order], block[order]
        most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * dim
        if most < 2**53:  # exact in doubles, so BLAS may do it
            q, x = q.astype(np.float64), x.astype(np.float64)
        elif most >= 2**63:
            return _in_whole_numbers(q, qid, x, xid, k, types)
        ends = np.append(np.flatnonzero(np.diff(block)) + 1, len(block))
        starts = np.concatenate([[0], ends[:-1]])
        top, low = np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)
        bound = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
        way = np.argsort(-bound, axis=1, kind="stable")
        have = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, x.dtype))
        lowest = np.iinfo(np.int64).min if x.dtype == np.int64 else -np.inf
        given = np.where(given == LOWEST, lowest, given).astype(x.dtype)
        floor, live = given.copy(), np.arange(len(q))
        for turn in range(len(starts)):
            live = live[bound[live, way[live, turn]] >= floor[live]]
            if not len(live):
                break
            at = way[live, turn]
            parts = [have]
            for b in np.unique(at):
                rows = live[at == b]
                s = q[rows] @ x[starts[b] : ends[b]].T
                own = xid[None, starts[b] : ends[b]] == qid[rows][:, None]
                s[own] = lowest
                r, c = above(s, floor[rows], k)
                ok = ~own[r, c]
                parts.append((rows[r[ok]], xid[starts[b] + c[ok]], s[r[ok], c[ok]]))
            have = best(*(np.concatenate([p[i] for p in parts]) for i in range(3)), k)
            if not len(have[0]):
                continue
            n = np.bincount(have[0], minlength=len(q))
            last = np.cumsum(n) - 1
            floor = np.maximum(given, np.where(n == k, have[2][np.maximum(last, 0)], lowest))
        return pa.table({"query_id": qid[have[0]], "id": have[1], "score": have[2].astype(np.int64)}, schema=types)

    return run


def _in_whole_numbers(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, types: pa.Schema) -> pa.Table:
    """As _search, for scores that may pass 64 bits: Python's integers, held to the least and greatest long at the end."""
    rows, out = [[int(c) for c in v] for v in x], []
    for a, v in zip(qid.tolist(), q, strict=True):
        v = [int(c) for c in v]
        scores = ((max(-(2**63), min(2**63 - 1, sum(c * d for c, d in zip(v, r, strict=True)))), i) for r, i in zip(rows, xid.tolist(), strict=True) if i != a)
        out += [(a, i, s) for s, i in nsmallest(k, scores, key=lambda p: (-p[0], p[1]))]
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((), (), ()))], schema=types)


def top_k(vectors: DataFrame, is_query: Column | str, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, id_col, score): for each row that is_query (a condition on id_col) its k best other rows.

    A component x becomes floor(scale * x), x as double; the score is the integer inner product; ties go to the
    smaller id. Blocks hold `block` consecutive places in id order, shards `shard` blocks.
    """
    asked = vectors.filter(is_query).select(F.col(id_col).cast("long").alias("id")).filter("id is not null").distinct()
    x = usable(vectors, id_col, vector_col).select("id", F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c).cast("long")).alias("v"))
    dims = x.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    span = x.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).collect()[0]
    types = "query_id long, id long, score long"
    if not dims:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    dim = dims[0]["d"]
    x = x.filter(F.size("v") == dim)
    # an id range of `wide` ids holds about `block` rows; ranges that hold more are cut by a hash, so no shard grows
    wide = max(1, (span["hi"] - span["lo"] + 1) * block // max(1, span["n"]))
    place = F.floor((F.col("id") - span["lo"]) / F.lit(wide)).cast("long")
    blocks = x.withColumn("block", place)
    heavy = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 4 * block).withColumn("cut", F.ceil(F.col("n") / block).cast("int")).drop("n")
    blocks = blocks.join(heavy, "block", "left").withColumn("cut", F.coalesce("cut", F.lit(1)))
    blocks = blocks.withColumn("shard", F.floor(F.col("block") / shard).cast("long")).withColumn("piece", F.pmod(F.xxhash64("id"), "cut").cast("int"))
    blocks = materialize(blocks.select("shard", "piece", "block", "id", "v"))
    q = blocks.join(asked, "id", "left_semi")
    parts = max(1, -(-q.count() // queries))
    tile = ["shard", "piece"]
    floors = renewed(q).groupBy(*tile).cogroup(renewed(blocks).groupBy(*tile)).applyInArrow(_floors(k, dim), "id long, floor long")
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    q = materialize(q.select("id", "v").join(floors, "id").withColumn("part", part))
    bounds = materialize(blocks.groupBy(*tile).applyInArrow(_summaries(dim), "shard long, piece int, block long, top array<long>, low array<long>"))
    chunks = max(1, -(-bounds.count() // BOUNDS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select("part", every(chunks).alias("chunk"), "id", "v", "floor")
    right = bounds.select(every(parts).alias("part"), F.pmod(F.xxhash64(*tile), F.lit(chunks)).cast("int").alias("chunk"), *tile, "top", "low")
    reached = renewed(left).groupBy("part", "chunk").cogroup(renewed(right).groupBy("part", "chunk")).applyInArrow(_reached(dim), "id long, shard long, piece int")
    left = q.join(reached, "id").select("part", *tile, "id", "v", "floor")
    right = blocks.select(every(parts).alias("part"), *tile, "block", "id", "v")
    keys = ["part", *tile]
    found = renewed(left).groupBy(*keys).cogroup(renewed(right).groupBy(*keys)).applyInArrow(_search(k, dim), types)
    return ranked(found, k, "score").select("query_id", "rank", F.col("id").alias(id_col), "score")
