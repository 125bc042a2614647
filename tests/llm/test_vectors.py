import numpy as np
import pyarrow as pa
import pytest

from drafthorse.llm import queries, topk
from drafthorse.llm.ann import axes, hadamard, nearest, recall
from drafthorse.llm.topk import top_k

Q = "vec_id % 20 = 0"


def table(spark, n=900, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:400] = x[100]  # a third are one vector
    rows = [(int(i), [float(c) for c in v], 1) for i, v in enumerate(x)]
    odd = [(2000, None, 1), (2020, [], 1), (2040, [1.0, None] + [0.0] * (dim - 2), 1), (2060, [float("nan")] * dim, 1), (2080, [0.0] * dim, 1), (2100, [1.0] * (dim + 1), 1), (None, [0.1] * dim, 1), (7, [9.0] * dim, 1)]
    return x, spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, x int")


def test_top_k_exact(spark):
    x, df = table(spark)
    ids, v = list(range(900)) + [2080], np.floor(64 * np.vstack([x, np.zeros(16)])).astype(np.int64)
    got = {}
    for r in top_k(df, Q, k=20, block=64, shard=3, queries=16).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in ids if i % 20 == 0}
    for q, rows in got.items():
        s = v @ v[ids.index(q)]
        want = sorted(((-int(c), i) for i, c in zip(ids, s) if i != q))[:20]
        assert sorted(rows) == [(k + 1, i, -c) for k, (c, i) in enumerate(want)]


def test_bounds_leave_far_blocks_out(spark):
    """Ids in the order of directions: a query goes to few shards, and the result is still that of all pairs."""
    rng = np.random.default_rng(8)
    angle = np.linspace(0, np.pi, 2000)
    x = np.stack([np.cos(angle), np.sin(angle)], axis=1) + rng.normal(scale=1e-3, size=(2000, 2))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    v = np.floor(1000 * x).astype(np.int64)
    got = {}
    for r in top_k(df, Q, k=5, scale=1000.0, block=20, shard=2, queries=64).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 2000, 20):
        s = v @ v[q]
        want = sorted((-int(c), i) for i, c in enumerate(s) if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -c) for k, (c, i) in enumerate(want)]
    # one tile of bounds by hand: the direction of a block decides
    lists = lambda m: pa.array([list(map(int, r)) for r in m], pa.list_(pa.int64()))
    left = pa.table({"id": [1], "v": lists([[1000, 0]]), "floor": [900_000]})
    right = pa.table({"shard": [0, 1], "piece": pa.array([0, 0], pa.int32()), "top": lists([[1000, 10], [100, 1000]]), "low": lists([[950, 0], [0, 990]])})
    assert topk._reached(2)((), left, right).to_pylist() == [{"id": 1, "shard": 0, "piece": 0}]


def test_top_k_small(spark):
    df = spark.createDataFrame([(0, [1.0]), (20, [2.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(df, Q).collect())) == [(0, 1, 20, 8192), (20, 1, 0, 8192)]
    assert top_k(df.limit(0), Q).count() == 0
    assert nearest(df.limit(0), Q).count() == 0
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in nearest(df, Q).collect()) == [(0, 20, 2.0), (20, 0, 2.0)]


def test_nearest(spark):
    x, df = table(spark)
    got = nearest(df, Q, k=20, tile=128).cache()
    rows = got.collect()
    true = []
    for q in range(0, 900, 20):
        s = x @ x[q]
        s[q] = -9
        for i in np.lexsort((np.arange(900), -np.round(s, 12)))[:20]:
            true.append((q, int(i)))
    for r in rows:
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]), abs=1e-12)
    assert {r["query_id"] for r in rows} == set(range(0, 900, 20))
    assert all(sum(r["query_id"] == q for r in rows) == 20 for q in (0, 100, 880))
    assert recall(got, spark.createDataFrame(true, "query_id long, vec_id long")) >= 0.9


@pytest.mark.parametrize("n", [0, 1, 2, 10, 21, 45])
def test_nearest_of_few(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 8))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in nearest(df, Q, k=20).collect())
    want = []
    for q in range(0, n, 20):
        others = sorted((i for i in range(n) if i != q), key=lambda i: (-float(x[i] @ x[q]), i))[:20]
        want += [(q, k, i) for k, i in enumerate(others, 1)]
    assert got == sorted(want)


def test_blocks_and_buckets_agree(spark):
    _, df = table(spark)
    one, two = (sorted(map(tuple, nearest(df, Q, k=5, probes=3, tables=6, **kw).collect())) for kw in ({"block": 100}, {"block": 4, "tile": 64}))
    assert one == two


def test_query_recall(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet' where embedding is not null").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    true = set()
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        true |= {(int(ids[q]), int(i)) for i in ids[np.lexsort((ids, -s))[:20]]}
    got = {(r["query_id"], r["vec_id"]) for r in queries.op5_ann(spark, sf).collect()}
    assert len(got & true) / len(true) >= 0.9


def test_scores_past_64_bits(spark):
    df = spark.createDataFrame([(0, [1e9, 2.0]), (1, [1e9, 1.0]), (2, [-1e9, 1.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k(df, Q, k=2, scale=64.0).collect()))
    s = lambda a, b: sum(int(64 * p) * int(64 * q) for p, q in zip(a, b, strict=True))
    v = {0: (1e9, 2.0), 1: (1e9, 1.0), 2: (-1e9, 1.0), 20: (1.0, 1.0)}
    want = []
    for q in (0, 20):
        best = sorted((-max(-(2**63), min(2**63 - 1, s(v[q], v[i]))), i) for i in v if i != q)[:2]
        want += [(q, k, i, -c) for k, (c, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_rotation_is_orthogonal():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    a = axes(x, 4)
    assert np.allclose(a[:, :16], -a[:, 16:]) and np.allclose(np.linalg.norm(a[:, :16], axis=1), np.linalg.norm(x, axis=1))
