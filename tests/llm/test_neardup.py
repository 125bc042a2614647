import random

from drafthorse.llm import neardup
from drafthorse.llm.neardup import near_duplicates


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {i: root(i) for i in sets}, sets


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component long")
    got = near_duplicates(docs).collect()
    want, sets = brute([r for r in rows if r[0] is not None])
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"] and r["n_links"] == 0
            continue
        assert r["component_id"] == want[r["doc_id"]]
        assert r["kept"] == (want[r["doc_id"]] == r["doc_id"])
        assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}


def test_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((n, " ".join(t)))
            n += 1
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    for _ in range(30):  # much in common, but under the threshold for most
        rows.append((n, passage + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 60)))))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One two"), (n + 4, "one TWO"), (n + 5, "É two"), (n + 6, "é two"), (3, rows[3][1]), (None, rows[0][1]), (5, "another text of the same id entirely")]
    check(spark, rows)


def test_a_passage_glues_no_cluster(spark):
    """Half of each text is one passage: tables put them together, prefixes do not; two that go further are linked."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = " ".join(word() for _ in range(80))
    rows = [(i, passage + " " + " ".join(word() for _ in range(70))) for i in range(60)]
    rows += [(60, rows[10][1] + " more"), (61, rows[20][1].replace("w1", "v1", 1))]
    check(spark, rows)
    docs = spark.createDataFrame([(i, t) for i, t in rows], "id long, text string")
    sets = docs.mapInArrow(neardup._sets, "id long, grams array<long>")
    assert {r["id"] for r in neardup.prefix_clusters(sets, 75).collect()} == {10, 20, 60, 61}


def test_long_text_and_its_copy(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(60_000))
    check(spark, [(1, long), (2, long + " end"), (3, long[:200_000]), (4, "short text")])


def test_copies_and_empty(spark):
    check(spark, [(i, "the same seven words in every text") for i in range(30)])
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
