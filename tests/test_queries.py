"""Every registered query against its SQL on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from drafthorse.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def canon(v):
    if isinstance(v, float):
        return f"{v:.9g}" if v else "0"
    return tuple(map(canon, v)) if isinstance(v, list) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(catalog.ORACLE_SQL[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert sorted(d[0] for d in cur.description) == cols
    assert got == sorted(tuple(canon(r[i]) for i in at) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def narrow(spark, folder, name, scale):
    """(rows of the query, rows of its SQL) where all operations lie within a few `scale`."""
    import random

    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, scale) for _ in range(64)], i % 2) for i in range(80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    cur = c.execute(catalog.ORACLE_SQL[name])
    at = [[d[0] for d in cur.description].index(x) for x in df.columns]
    return sorted(tuple(map(canon, r)) for r in df.collect()), sorted(tuple(canon(r[i]) for i in at) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["j18_nearest_owned_op", "w08_top_candidates", "w08_center_candidates"])
def test_same_as_sql_where_distances_tie(spark, tmp_path, name):
    got, want = narrow(spark, tmp_path, name, 1e-5)
    assert got == want


def exactly(spark, folder, name, rows):
    """(rows of the query, rows of its SQL) to the last bit, where these are the embeddings."""
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    cur = c.execute(catalog.ORACLE_SQL[name])
    at = [[d[0] for d in cur.description].index(x) for x in df.columns]
    return sorted(tuple(map(repr, r)) for r in df.collect()), sorted(tuple(repr(r[i]) for i in at) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["j18_nearest_owned_op", "w08_top_candidates"])
def test_same_as_sql_where_distances_differ_in_last_bits(spark, tmp_path, name):
    import random

    rng = random.Random(951)  # all operations lie along one line, each cut in other places
    point = lambda: [float(rng.randint(-50, 50)), float(rng.randint(-50, 50))]
    rows = [(3 * i, point() + [float(c) for k in (rng.randint(-40, 40) for _ in range(31)) for c in (3 * k, 7 * k + 1)], 0) for i in range(9)]
    got, want = exactly(spark, tmp_path, name, rows)
    assert got == want


@pytest.mark.parametrize("name", ["j18_nearest_owned_op", "w08_top_candidates"])
@pytest.mark.parametrize("what", ["infinite", "far", "wide"])
def test_same_as_sql_on_odd_vectors(spark, tmp_path, name, what):
    import random

    rng, inf, nan = random.Random(6), float("inf"), float("nan")
    rows = [(i, [rng.gauss(0, 0.125) for _ in range(64)], i % 2) for i in range(40)]
    rows += {
        "infinite": [(40, [inf] * 64, 0), (41, [0.1] * 31 + [-inf] + [0.2] * 32, 1), (42, [-inf] + [0.1] * 63, 0), (43, [nan, 0.1] * 32, 1), (45, [0.1, None] * 32, 1), (48, None, 0)],
        "far": [(42, [rng.gauss(0, 1e9) for _ in range(64)], 0), (45, [rng.choice((-1e12, 0.0, 1e12)) for _ in range(64)], 1)],
        "wide": [(40 + i, [rng.gauss(0, 1e5) for _ in range(64)], i % 2) for i in range(40)],
    }[what]
    got, want = exactly(spark, tmp_path, name, rows)
    assert got == want


def test_entry_works_without_the_optional_parts(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["page", "pos", "line", "covered"]


def test_nothing_outside_imports_the_optional_part():
    root = Path(catalog.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p


def test_walks_runs_and_discovery_over_all_rows(spark):
    from collections import defaultdict

    import pandas as pd

    from drafthorse.operators import matching

    read = lambda t: pd.read_parquet(f"{SF}/{t}.parquet")
    items, parts = read("lineitem"), read("part")
    # seven steps from every start
    to = defaultdict(set)
    for a, b in zip(items["l_suppkey"], items["l_partkey"] % 100 + 1, strict=True):
        to[a].add(b)
    want = set()
    for start in to:
        at, depth = {start: 0}, 0
        front = {start}
        while front and depth < 7:
            depth += 1
            front = {b for a in front for b in to.get(a, ())} - at.keys()
            at.update(dict.fromkeys(front, depth))
        want |= {(start, p, d) for p, d in at.items()}
    got = [(r["start"], r["at"], r["depth"]) for r in catalog.QUERIES["j17_endpoint_walk"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want
    # components of suppliers and parts
    least = {}
    find = lambda x: x if least.setdefault(x, x) == x else find(least[x])
    for a, b in zip(items["l_suppkey"], items["l_partkey"] + 1000000, strict=True):
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    got = {r["op_index"]: r["least"] for r in catalog.QUERIES["w12_connected_runs"](spark, SF).collect()}
    assert got == {x: find(x) for x in least}
    # runs of all parts
    runs = catalog.QUERIES["w12_run_numbers"](spark, SF).collect()
    assert sorted(r["op_index"] for r in runs) == sorted(parts["p_partkey"])
    # discovery
    atoms = items.assign(grp=items["l_orderkey"] % 20, m=items["l_suppkey"] % 10).groupby(["grp", "l_partkey"])["m"].agg(lambda m: sorted(set(m))).reset_index()
    want = set()
    for g, rows in atoms.groupby("grp"):
        found = matching.discover(pd.DataFrame({"atom": rows["l_partkey"], "motifs": rows["m"]}), 3)
        want |= {(g, *r) for r in found[["atom", "motif", "turn"]].itertuples(index=False)}
    assert {(r["grp"], r["atom"], r["motif"], r["turn"]) for r in catalog.QUERIES["w18_discovery"](spark, SF).collect()} == want
