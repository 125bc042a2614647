import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import numpy as np

from drafthorse.llm import queries as Q
from drafthorse.llm import repeats
from drafthorse.llm.repeats import remove_repeats


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        spans, start = [], None
        for i, h in enumerate([*hit, 0]):
            if h and start is None:
                start = i
            if not h and start is not None:
                spans.append((start, i))
                start = None
        out.append((len(t), spans, bytes(b for b, h in zip(t, hit) if not h)))
    return out


def run(spark, texts, length, **kw):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, range string")
    got = {r["doc_id"]: (r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in remove_repeats(docs, length=length, **kw).collect()}
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40) for _ in range(3)]
    texts = []
    for _ in range(40):
        t = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            a = rng.randint(0, 20)
            t += s[a : a + rng.randint(20, 150)] + text(rng.randint(0, 10))
        texts.append(t)
    texts += [texts[3], texts[5], "a" * 700, "ab" * 300, None, "", "short", "x" * 64, "x" * 65]
    edited = list(shared[0] * 3)
    edited[100] = "#"
    texts.append("".join(edited))
    want = brute([(t or "").encode() for t in texts], 64)
    assert run(spark, texts, 64) == want


def test_digest_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "q" * 500), (None, "r" * 10), (1, "other")], "doc_id long, text string")
    rows = remove_repeats(docs, keep=lambda k: [F.sha2(k, 256).alias("sha")]).collect()
    assert {(r["doc_id"], r["n_bytes"], r["sha"]) for r in rows} == {(1, 500, hashlib.sha256(b"").hexdigest()), (None, 10, hashlib.sha256(b"r" * 10).hexdigest()), (1, 5, hashlib.sha256(b"other").hexdigest())}
    assert remove_repeats(docs.limit(0)).count() == 0


def shared(texts, length):
    seen = {}
    grams = [{tuple(w[k : k + length]) for k in range(len(w) - length + 1)} for w in (re.findall(rb"[^\x20\x09-\x0d]+", t) for t in texts)]
    for i, g in enumerate(grams):
        for x in g:
            seen.setdefault(x, set()).add(i)
    return [any(len(seen[x]) > 1 for x in g) for g in grams]


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (51, 52, 60, 90, 200, 300)]
    texts = [f"{text(rng.randint(0, 80))} {rng.choice(passages)}\n{text(rng.randint(0, 200))}" for _ in range(60)]
    texts += [text(rng.randint(0, 300)) for _ in range(40)] + [texts[0], "", None, "b" * 399, "c" * 400, "c" * 400, "d " * 400, text(50) + " x", (text(60) + " ") * 3]
    texts.append(" ".join([*passages[0].split(" ")[:50], "other"]))
    ids = [*range(len(texts) - 2), None, 3]
    spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    raw = [(t or "").encode() for t in texts]
    want = Counter()
    for i, (n, spans, kept), s in zip(ids, brute(raw, 400), shared(raw, 51), strict=True):
        want[i, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest(), s] += 1
    assert Counter(map(tuple, Q.op1_repeats(spark, str(tmp_path)).collect())) == want


def test_multikey_order():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, 50, 40_000), rng.integers(-5, 5, 40_000), rng.integers(-(2**62), 2**62, 40_000)]
    keys[0][:20_000] = 7
    keys[2][:9_000] = 3
    order = repeats.multikey_order(keys)
    assert sorted(order) == list(range(40_000))
    rows = [tuple(k[i] for k in keys) for i in order]
    assert rows == sorted(rows)
    assert list(repeats.multikey_order([np.zeros(0)] * 3)) == []
