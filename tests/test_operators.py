import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from drafthorse.functions import geom, text
from drafthorse.functions.geom import Box
from drafthorse.functions.pages_spec import pages_of
from drafthorse.operators import linetypes, pages, sequence, state, votes
from drafthorse.operators.graph import connected_components
from drafthorse.operators.numbering import number_within
from drafthorse.operators.spatial import box_join
from drafthorse.streaming import incremental

BOX = "page long, k int, y0 double, x0 double, y1 double, x1 double"


def test_valid_box_edges(spark):
    nan = float("nan")
    rows = [(1, 0, 5.0, 5.0, 5.0, 9.0), (1, 1, 0.0, 0.0, 1000.0, 1000.0), (1, 2, -0.1, 0.0, 5.0, 5.0), (1, 3, 0.0, 0.0, 1000.1, 5.0), (1, 4, nan, 0.0, 5.0, 5.0), (1, 5, None, 0.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, BOX)
    assert [r["k"] for r in df.filter(geom.valid(Box())).collect()] == [1]


def test_cover_at_exactly_the_gap(spark):
    lines = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 500.0, 0.0, 510.0, 10.0), (2, 0, 0.0, 0.0, 10.0, 10.0)], BOX)
    seen = spark.createDataFrame([(1, 7, 15.0, 0.0, 20.0, 10.0), (1, 8, 515.01, 0.0, 520.0, 10.0), (2, 9, 5.0, 5.0, 5.0, 9.0)], BOX)
    got = {(r["page"], r["k"]): r["covered"] for r in pages.cover_split(lines, seen.drop("k"), key="k").collect()}
    assert got == {(1, 0): True, (1, 1): False, (2, 0): False}


def test_box_join_against_all_pairs(spark):
    rng = random.Random(5)
    make = lambda n: [(rng.randint(1, 2), k, *(lambda y, x: (y, x, y + rng.uniform(1, 120), x + rng.uniform(1, 400)))(rng.uniform(-50, 900), rng.uniform(0, 600))) for k in range(n)]
    a, b = make(60), make(70)
    gap = lambda p, q: max(p[2] - q[4], q[2] - p[4], p[3] - q[5], q[3] - p[5])
    want = {(p[0], p[1], q[1]) for p in a for q in b if p[0] == q[0] and gap(p, q) <= 5}
    l, r = spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX)
    rows = [tuple(x) for x in box_join(l, r, 5.0).select("page", "l_k", "r_k").collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert {(x["page"], x["k"]) for x in box_join(l, r, 5.0, how="left_anti").collect()} == {(p[0], p[1]) for p in a} - {w[:2] for w in want}


def test_union_boundary(spark):
    cols = "page long, tok string, y0 double, x0 double, y1 double, x1 double"
    first = spark.createDataFrame([(1, "A", 0.0, 0.0, 10.0, 29.0)], cols)
    second = spark.createDataFrame([(1, "B", 0.0, 11.0, 10.0, 40.0), (1, "C", 0.0, 10.9, 10.0, 39.9), (1, "A", 0.0, 44.0, 10.0, 60.0), (1, "A", 0.0, 44.1, 10.0, 60.0), (1, "", 0.0, 29.0, 10.0, 60.0)], cols)
    got = sorted((r["tok"], r["x0"]) for r in pages.union_runs(first, second).filter("run = 'second'").collect())
    assert got == [("", 29.0), ("A", 44.1), ("B", 11.0)]  # 18/40 = 0.45 is no twin, 18.1/39.9 is


def test_votes(spark):
    rows = [("g", 1, 5.0), ("g", 2, 2.0), ("g", 2, 2.0), ("g", 1, 1.0), ("h", 3, 1.0), ("h", 2, 1.0), ("i", 9, 1.0)]
    t = votes.tally(spark.createDataFrame(rows, "grp string, line_type_number int, distance double"), ["grp"])
    got = {r["grp"]: (r["line_type_number"], r["tied"]) for r in votes.winners(t, ["grp"]).collect()}
    assert got == {"g": (2, True), "h": (2, True), "i": (9, False)}


@pytest.mark.parametrize("row, want", [
    ((36.0, 4, None, None, False), ("bound", 4)), ((36.01, 4, None, None, False), ("too-far", None)), ((5.0, None, 12.0, 7, False), ("bound", 7)), ((5.0, None, 12.01, 7, False), ("residual", None)),
    ((None, None, None, None, False), ("no-geometry", None)), ((1.0, 2, 48.0, 7, True), ("bound", 7)), ((1.0, 2, 48.01, 7, True), ("too-far", None)), ((1.0, 2, None, None, True), ("bound", 2)),
])
def test_verdicts(spark, row, want):
    df = spark.createDataFrame([row], "distance double, owner int, owned_distance double, owned_owner int, is_center boolean")
    r = votes.verdicts(df).collect()[0]
    assert (r["state"], r["number"]) == want


def test_gate_words(spark):
    df = spark.createDataFrame([("GATE",), ("5' ORNAMENTAL STEEL FENCE & GATE",), ("gates",), ("fencing",), ("navigate",)], "t string")
    assert [r[0] for r in df.select(text.is_gate(F.col("t"))).collect()] == [True, False, True, False, False]


def test_pages_of(spark):
    df = spark.createDataFrame([("1,3-5",), ("5-3 9",), ("",), (None,), ("ALL",), ("0,11-20",)], "s string")
    assert [r[0] for r in df.select(pages_of(F.col("s"), F.lit(10))).collect()] == [[1, 3, 4, 5], [3, 4, 5, 9], list(range(1, 11)), list(range(1, 11)), list(range(1, 11)), []]


def test_json_recovery(spark):
    df = spark.createDataFrame([('```json\n[{"a": 1}, 2]\n```',), ('[{"a": 1}, {"b": ',), ("none",), ("[]",), (None,), ("[]\n[]",)], "s string")
    assert [r[0] for r in df.select(text.recover_json_array("s")).collect()] == [['{"a": 1}', "2"], ['{"a": 1}'], [], [], None, []]


def test_nfkc_token(spark):
    df = spark.createDataFrame([("ﬁ x  ½",), (None,)], "s string")
    assert [r[0] for r in df.select(text.text_token("s")).collect()] == ["FI X 1⁄2", None]


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(100)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: root(n) for n in nodes}


def test_numbering(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i % 40) for i in range(200)], "g string, k long")
    got = {}
    for r in number_within(df, ["g"], ["k"], "n", chunks=5).collect():
        got.setdefault(r["g"], []).append(r["n"])
    assert {g: sorted(v) for g, v in got.items()} == {"a": list(range(133)), "b": list(range(67))}


def test_sequences(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 3, 4), (1, 8, 10), (2, 1, 1)], "g int, lo int, hi int")
    assert {r["g"]: r["covered"] for r in sequence.covered_length(df, ["g"], "lo", "hi").collect()} == {1: 7}
    assert {r["g"]: r["peak"] for r in sequence.peak_concurrency(df, ["g"], "lo", "hi").collect()} == {1: 2, 2: 0}
    n = spark.createDataFrame([(1, v) for v in (1, 2, 3, 7, 9, 10, 10)], "g int, v int")
    assert sorted((r["start"], r["stop"]) for r in sequence.ranges(n, ["g"], "v").collect()) == [(1, 4), (7, 8), (9, 11)]


def test_state(spark):
    want = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "k int, sig string")
    have = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "k int, sig string")
    assert {r["k"]: r["state"] for r in state.currency(want, have, ["k"], ["sig"]).collect()} == {1: "current", 2: "stale", 3: "current", 4: "missing"}
    once = state.merge_rows(want, have, ["k"], ["sig"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, state.merge_rows(once, have, ["k"], ["sig"]).collect())) == [(1, "a"), (2, "x"), (3, None), (4, "d")]


def test_line_type_parts():
    rows = pd.DataFrame({"key": [3, 1, 2, 4], "value": [0.0, 0.04, 0.02, 0.07]})
    assert linetypes.complete_link(rows, 0.05).set_index("key")["family"].to_dict() == {1: 0, 2: 0, 3: 0, 4: 1}
    m = pd.DataFrame({"match": [1, 2, 3], "members": [[1, 2], [2, 3, 4], [5]]})
    assert linetypes.greedy_disjoint(m).set_index("match")["kept"].to_dict() == {2: True, 1: False, 3: True}
    p = np.array([[0, 0], [1, 0], [2, 0], [2, 1], [1, 0.1]])
    tree = linetypes.spanning_tree(p)
    assert len(tree) == 4 and linetypes.tree_diameter(5, tree, p)[0] == 0
    assert linetypes.shortest_path([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0)], 0, 2) == (2.0, [0, 1, 2]) and linetypes.shortest_path([], 0, 1) is None
    assert linetypes.simplify(np.array([[0, 0], [1, 0.01], [2, 0], [2, 2]]), 0.1) == [0, 2, 3]


def test_incremental(spark, tmp_path):
    src, schema = f"{tmp_path}/in", "k long, v long"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    sink = incremental.upsert(f"{tmp_path}/out", ["k"], ["v"])
    frame([(1, 1), (2, 1)]).coalesce(1).write.mode("append").parquet(src)
    args = (spark, src, frame([]).schema, f"{tmp_path}/cp", sink)
    incremental.drain(*args)
    frame([(2, 5), (3, 3)]).coalesce(1).write.mode("append").parquet(src)
    incremental.drain(*args)
    incremental.drain(*args)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/v=1").select("k", "v").collect())) == [(1, 1), (2, 5), (3, 3)]


def test_matching():
    from drafthorse.operators import matching

    p = pd.DataFrame({"a": [1, 1, 2, 3], "b": [1, 2, 1, 2], "cost": [0.0, 1.0, 0.0, 0.0]})
    got = matching.assign(p)
    assert len(got) == 2 and got["a"].is_unique and got["b"].is_unique
    v = pd.DataFrame({"key": [4, 1, 2, 3], "value": [1.0, 0.0, 0.1, 5.0]})
    assert matching.families(v, 0.5).set_index("key")["family"].to_dict() == {1: 0, 2: 0}
    d = matching.discover(pd.DataFrame({"atom": [1, 2, 3, 4, 5], "motifs": [[1], [1, 2], [1, 2], [2], [2]]}), 2)
    assert d.set_index("atom")["motif"].to_dict() == {2: 2, 3: 2, 4: 2, 5: 2}


def test_contour_signature_reads_all_points_either_way(spark):
    rng = random.Random(20)
    base = [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(32)]
    late = base[:20] + [(base[20][0] + 0.5, base[20][1])] + base[21:]
    other_y = base[:3] + [(base[3][0], base[3][1] + 0.5)] + base[4:]
    shapes = [base, base[5:] + base[:5], base[::-1], base[::-1][9:] + base[::-1][:9], late, other_y]
    df = spark.createDataFrame([(i, k, x, y) for i, c in enumerate(shapes) for k, (x, y) in enumerate(c)], "op_index long, k int, x double, y double")
    got = {r["op_index"]: r["sig"] for r in linetypes.contour_signatures(df).collect()}
    assert len({got[i] for i in range(4)}) == 1 and len(set(got.values())) == 3


def test_motif_clusters_against_all_pairs(spark):
    rng = random.Random(13)
    rows = [(i, 1.3 ** rng.uniform(-6, 6), rng.uniform(0, 2.4)) for i in range(110)]
    rows += [(500, 1.3**20 * 0.999, 9.0), (501, 1.3**20 * 1.001, 9.01), (502, 1.3**20 * 1.001, 8.99), (503, None, 1.0)]
    root = {r[0]: r[0] for r in rows}
    find = lambda a: a if root[a] == a else find(root[a])
    for a in rows[:-1]:
        for b in rows[:-1]:
            if abs(np.log(a[1] / b[1])) <= np.log(1.3) and abs(a[2] - b[2]) <= 0.2:
                p, q = sorted((find(a[0]), find(b[0])))
                root[q] = p
    want = {}
    for r in rows:
        want[find(r[0])] = want.get(find(r[0]), 0) + 1
    df = spark.createDataFrame(rows, "op_index long, scale double, aspect double")
    got = [(r["first"], r["support"]) for r in linetypes.motif_clusters(df).collect()]
    assert sorted(got) == sorted((k, n) for k, n in want.items() if n >= 3) and (500, 3) in got and len(got) > 3


def test_box_join_against_all_pairs(spark):
    import random

    from drafthorse.operators.spatial import box_join

    rng = random.Random(6)

    def boxes(n):
        rows = []
        for i in range(n):
            y, x = rng.uniform(-50, 900), rng.uniform(0, 900)
            rows.append((rng.randrange(3), i, y, x, y + rng.choice([1.0, 30.0, 400.0]), x + rng.uniform(1, 300)))
        return [*rows, (0, n, None, None, None, None), (9, n + 1, 1.0, 1.0, 2.0, 2.0)]

    a, b = boxes(60), boxes(50)
    types = "page int, i int, y0 double, x0 double, y1 double, x1 double"
    left, right = spark.createDataFrame(a, types), spark.createDataFrame(b[:-1], types)
    near = lambda p, q: p[0] == q[0] and None not in (p[2], q[2]) and max(p[2] - q[4], q[2] - p[4], p[3] - q[5], q[3] - p[5]) <= 7
    want = {(p[0], p[1], q[1]) for p in a for q in b[:-1] if near(p, q)}
    pairs = box_join(left, right, 7.0).collect()
    assert len(pairs) == len(want) and {(r["page"], r["l_i"], r["r_i"]) for r in pairs} == want
    hit = {(p, i) for p, i, _ in want}
    semi, anti = (box_join(left, right, 7.0, how=how) for how in ("left_semi", "left_anti"))
    assert semi.columns == left.columns and sorted((r["page"], r["i"]) for r in semi.collect()) == sorted(hit)
    assert sorted((r["page"], r["i"]) for r in anti.collect()) == sorted((p[0], p[1]) for p in a if (p[0], p[1]) not in hit)


def test_nearest_ops_with_and_without_a_grid(spark):
    import random

    from drafthorse.operators import linetypes

    rng = random.Random(2)
    ops = spark.createDataFrame([(i % 2, i, k, rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(20) for k in range(4)], "grp int, op_index int, k int, x double, y double")
    tips = spark.createDataFrame([(i % 2, i, i, rng.uniform(-1.5, 1.5), rng.uniform(-1, 1)) for i in range(30)], "grp int, tip int, own int, px double, py double")
    found = [sorted((r["tip"], r["rank"], r["op_index"]) for r in linetypes.nearest_ops(tips, linetypes.segments(ops), 3, near=near).collect()) for near in (None, 0.05, 0.4)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 90


def test_nearest_ops_beside_segments_that_are_not_filed(spark):
    segs = [(0, 3, -0.5, 0.0015, 0.5, 0.0015), (0, 4, -5e3, 0.001, 5e3, 0.001), (0, 5, 0.0, -0.0012, 1e30, -0.0012), (0, 6, float("inf"), 0.0, 1.0, 0.0), (0, 8, float("nan"), 0.0, 1.0, 0.0)]
    segs = spark.createDataFrame(segs, "grp int, op_index int, ax double, ay double, bx double, by double")
    tips = [(0, 7, 7, 0.0, 0.0), (0, 9, 9, 3e3, 0.0), (0, 10, 10, 1e9, 0.0), (0, 11, 11, float("inf"), 0.0), (0, 12, 12, None, 0.0)]
    tips = spark.createDataFrame(tips, "grp int, tip int, own int, px double, py double")
    for k in (1, 2, 3, 5):
        found = [sorted((r["tip"], r["rank"], r["op_index"]) for r in linetypes.nearest_ops(tips, segs, k, near=near, cell=0.02).collect()) for near in (None, 0.002, (0.0011, 0.002))]
        assert found[0] == found[1] == found[2] and len(found[0]) == 5 * k and found[0][0] == (7, 1, 4)


def test_cells_hold_all_that_is_near_and_little_else(spark):
    rng = random.Random(4)
    segs = [(0, i, *(round(rng.uniform(-1, 1), 2) for _ in range(4))) for i in range(40)] + [(0, 40, 0.1, -1.0, 0.1, 1.0), (0, 41, -1.0, 0.2, 1.0, 0.2), (0, 42, 0.3, 0.3, 0.3, 0.3)]
    got = linetypes._cells(spark.createDataFrame(segs, "grp int, op_index int, ax double, ay double, bx double, by double"), 0.01, 0.05)
    got = {(r["op_index"], r["cx"], r["cy"]) for r in got.collect()}
    for _, i, ax, ay, bx, by in segs:
        for t in np.linspace(0, 1, 200):
            for u in np.linspace(0, 2 * np.pi, 8):
                x, y = ax + t * (bx - ax) + 0.0099 * np.cos(u), ay + t * (by - ay) + 0.0099 * np.sin(u)
                assert (i, int(np.floor(x / 0.05)), int(np.floor(y / 0.05))) in got
    assert len(got) < 130 * len(segs)  # whole boxes would be several times as many


def test_few_edges_are_settled_in_few_jobs(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(300)] + [(rng.randint(400, 900), rng.randint(400, 900)) for _ in range(250)] + [(5, 5), (7, -7), (2, 1), (1000, 1000)]
    least = {}
    find = lambda x: x if least.setdefault(x, x) == x else find(least[x])
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            least[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "src long, dst long")
    jobs = []
    for last in (0, 100, 1 << 14):  # rounds alone, rounds and then one task, one task
        spark.sparkContext.setJobGroup(f"components {last}", "")
        got = connected_components(df, last_edges=last).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {last}")))
        assert len(got) == len(least) and {r["node"]: r["component"] for r in got} == {x: find(x) for x in least}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[2] <= 12 and jobs[2] < jobs[1] < jobs[0]
    assert connected_components(df.filter("src = 5 and dst = 5")).collect() == []


def test_nearest_ops_that_tie_on_twelve_places(spark):
    ops = lambda rows: spark.createDataFrame([(0, i, -1.0 if y is not None else None, y, 1.0, y or 0.0) for i, y in rows], "grp int, op_index int, ax double, ay double, bx double, by double")
    tips = spark.createDataFrame([(0, 7, 7, 0.0, 0.0)], "grp int, tip int, own int, px double, py double")
    found = lambda rows, k, near: [r["op_index"] for r in sorted(linetypes.nearest_ops(tips, ops(rows), k, near=near).collect(), key=lambda r: r["rank"])]
    for near in (None, 0.0005, 0.001, 0.02):
        # 9 is nearer than 5 by 2e-14 in the square, 2 is farther by 3e-6, 3 has no distance
        rows = [(9, 0.001 - 1e-11), (5, 0.001 + 1e-11), (2, 0.002), (3, None)]
        assert found(rows, 1, near) == [5] and found(rows, 4, near) == [5, 9, 2, 3]
        assert found([(9, 1e-9), (5, 1e-8), (2, 1e-5)], 2, near) == [5, 9]


def test_families_against_plain_joining():
    import random

    import pandas as pd

    from drafthorse.operators import matching

    rng = random.Random(4)
    for _ in range(40):
        x = sorted(round(rng.uniform(0, 1), 2) for _ in range(rng.randint(0, 25)))
        parts = [[i] for i in range(len(x))]
        while fit := [(x[b[-1]] - x[a[0]], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if x[b[-1]] - x[a[0]] <= 0.1]:
            i = min(fit)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        want = [(k, n) for n, g in enumerate(p for p in parts if len(p) > 1) for k in g]
        got = matching.families(pd.DataFrame({"key": range(len(x)), "value": x}), 0.1)
        assert list(got.itertuples(index=False, name=None)) == want


def test_json_recovery_cases(spark):
    from drafthorse.functions.text import recover_json_array

    cases = {
        '[1, {"b": [2, "]"], "a": "x, y"}, "q\\"]"]': ["1", '{"a": "x, y", "b": [2, "]"]}', '"q\\"]"'],
        'well: ```json\n[{"a": 1}, {"a": 2}, {"a"': ['{"a": 1}', '{"a": 2}'],
        "[1, 2, 3\n```": ["1", "2", "3"], "no array": [], "[]": [], "[1, oops, 2]": ["1"], "[1,, 2] tail [3]": ["1", "2"], None: None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").select("i", recover_json_array("t").alias("found"))
    assert [r["found"] for r in df.orderBy("i").collect()] == list(cases.values())


def test_resolve_cases(spark):
    from drafthorse.operators import votes

    rows = [
        # grp, number, distance, gate, in_plan, kind, state, placement
        (1, 1, 5.0, False, True, "arrow", "bound", 0), (1, 1, 6.0, False, True, "arrow", "bound", 0), (1, 2, 4.0, False, True, "arrow", "bound", 0), (1, 4, 9.0, False, True, "arrow", "bound", 0),
        (2, 1, 5.0, True, True, "arrow", "bound", 0),
        (3, 1, 5.0, False, True, "legend", "bound", 0), (3, 2, 5.0, False, True, "legend", "bound", 0),
        (4, 1, 5.0, False, True, "arrow", "bound", 0), (4, 2, 5.0, False, True, "center", "bound", 0), (4, 2, 5.0, False, True, "center", "bound", 1),
        (5, 9, 5.0, False, True, "arrow", "bound", 0),
        (6, 1, 5.0, False, False, "arrow", "bound", 0),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id int, grp int, number int, distance double, gate boolean, in_plan boolean, kind string, state string, placement int")
    groups, ends = votes.resolve(df, 4)
    got = {r["grp"]: (r["winner"], r["missing"], r["conflict"]) for r in groups.collect()}
    assert got == {1: (1, None, False), 2: (None, None, False), 3: (None, None, True), 4: (2, None, False), 5: (None, 9, False), 6: (None, None, False)}
    state = {r["event_id"]: (r["final_state"], r["visible"]) for r in ends.collect()}
    assert state[0] == ("bound", True) and state[2] == ("reassigned", True) and state[3] == ("unresolved", False)
    assert state[4] == ("gate", False) and state[5] == ("hidden", False) and state[7] == ("reassigned", True) and state[10][0] == "hidden"


def test_shared_folder_is_asked_for_on_a_cluster():
    import pytest

    from drafthorse import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Spark:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Spark())
