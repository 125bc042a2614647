import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from test_neardup import brute
from test_others import brute_mix
from tokenizers import Tokenizer

import corpus_pipeline as P
from drafthorse.llm import queries as Q
from drafthorse.llm.packing import best_fit_plan, tokenizer_files
from drafthorse.llm.pseudonyms import pseudonymize
from drafthorse.llm.toxicity import train
from drafthorse.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    ids = [r[0] for r in first.select("doc_id").collect()]
    for name, stage in P.STAGES[:-1]:
        new = materialize(stage(spark, docs, SF))
        assert new.columns == P.COLUMNS and new.dtypes == first.dtypes, name
        left = [r[0] for r in new.select("doc_id").collect()]
        assert set(left) <= set(ids) and len(left) == len(set(left))
        if name in ("personal_data", "mixing"):
            assert sorted(left) == sorted(ids)
        if name == "near_dedup":
            judged = Q.near_duplicates(docs).filter("kept").select("doc_id").collect()
            assert set(left) == {r[0] for r in judged}
        docs, ids = new, left
    pieces = P.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == set(ids)


def test_repeated_and_null_rows_stay_whole(spark):
    rows = [(1, "one two three four five six", "en", "a", 5), (1, "one two three four five six", "en", "a", 5), (None, "one two three four five six", "en", None, None), (2, None, None, "b", None), (3, "", "en", "b", 0)]
    rows += [(1, "quite another text under the same id as above", "en", "a", 5), (None, "an own text without any id at all", "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r["doc_id"], r["text"]) for r in P.near_dedup(spark, docs, SF).collect()]
    want = [(1, "one two three four five six"), (2, None), (3, ""), (1, rows[5][1]), (None, rows[6][1])]
    assert Counter(out) == Counter(want)
    assert P.mixing(spark, docs, SF).count() == 7
    assert P.personal_data(spark, docs, SF).count() == 7


def test_empty_and_odd_tables(spark):
    types = "doc_id long, text string, lang string, source string, n_chars long, row long, file string, position long"
    odd = spark.createDataFrame([(None, None, None, None, None, 1, "x", 5), (1, "", "en", "a", 0, 1, "x", 5), (1, "word " * 200_000, "en", "a", 1_000_000, 2, "y", 5)], types)
    for docs, n in ((odd.limit(0), 0), (odd, 3)):
        for name, stage in P.STAGES[:-1]:
            assert stage(spark, docs, SF).count() == n, name
        assert P.packing(spark, docs, SF).select("doc_id").distinct().count() == (2 if n else 0)


def test_against_brute_force(spark, tmp_path):
    """run() on a small table, held against the stages worked out row by row."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        words = [rng.choice(vocab) for _ in range(rng.randint(6, 60))]
        if i % 6 == 0:
            words[2:4] = ["grimvash", "blortex"]
        rows.append((i, " ".join(words), "en", rng.choice(["src0", "src1", "b"]), 1))
    rows += [(200 + i, rows[i][1] + (" tail" if i % 2 else ""), "en", "b", 1) for i in range(20)]
    rows += [(300, None, None, None, None), (301, "", "en", "b", 0), (302, "mail me@x.org or 4111 1111 1111 1111 please now today", "en", "b", 1)]
    labels = [(i, 1, int(i % 6 == 0)) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, lab = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    model = train(docs, lab)
    clean = [r for r in rows if model.score(pa.array([r[1]], pa.string()))[0] < 0.5]
    assert {r[0] for r in rows if r[0] < 120} - {r[0] for r in clean} <= {i for i in range(120) if i % 6 == 0}
    component, _ = brute([(r[0], r[1]) for r in clean])
    kept = [r for r in clean if component[r[0]] == r[0]]
    masked = {r["doc_id"]: r["text"] for r in pseudonymize(docs, Q.DEMO_KEY).collect()}
    kept = [(r[0], masked[r[0]], r[3]) for r in kept]
    total = {s: sum(len((r[1] or "").encode()) + 1 for r in kept if (r[2] or "") == s) for s in {r[2] or "" for r in kept}}
    mixed = [r[0] for r in brute_mix(kept, {s: Q.TARGETS.get(s, 1.0) for s in total}, 1 << 16)]
    got = P.run(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(tokenizer_files()[0])
    for i, text, _ in kept:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        (r,) = [r for r in got if r["doc_id"] == i]
        assert (r["start"], r["length"], r["ids_crc32"]) == (0, len(ids), zlib.crc32(ids.tobytes()))
    assert len(got) == len(kept)
    # of one length the mixed order fills the plan's windows; windows are numbered along it by their leading pieces
    where, lengths, by_length = {}, {r["doc_id"]: r["length"] for r in got}, {}
    for i in mixed:
        by_length.setdefault(lengths[i], []).append(i)
    for length, rank, n, first, each, offset in best_fit_plan({k: len(v) for k, v in by_length.items()}):
        for k, i in enumerate(by_length[length][rank : rank + n]):
            where[i] = first + k // each, offset + k % each * length
    leads = sorted((mixed.index(i), w) for i, (w, o) in where.items() if not o)
    number = {w: k for k, (_, w) in enumerate(leads)}
    assert {r["doc_id"]: (r["sequence_id"], r["offset"]) for r in got} == {i: (number[w], o) for i, (w, o) in where.items()}


def test_sequences_follow_the_mixed_order(spark):
    """Nine parts of src0 to one of b are to weigh 4 to 1, until b runs out; without the stage src0 comes before b."""
    docs = spark.createDataFrame([(i, f"{i} word " * 1000, "en", "src0" if i < 1800 else "b", 1) for i in range(2000)], "doc_id long, text string, lang string, source string, n_chars long")
    source = {i: "src0" if i < 1800 else "b" for i in range(2000)}

    def early(rows):
        got = sorted((r["sequence_id"], r["offset"], r["length"], source[r["doc_id"]]) for r in P.packing(spark, materialize(rows), SF).collect())
        assert sorted({g[0] for g in got}) == list(range(got[-1][0] + 1))
        first = [g for g in got if g[0] < got[-1][0] / 5]
        return sum(g[2] for g in first if g[3] == "b") / sum(g[2] for g in first)

    assert 0.15 < early(P.mixing(spark, docs, SF)) < 0.25
    assert early(docs) < 0.05


def test_held_out_rule(spark):
    got = Q.op9_toxicity(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in got)
