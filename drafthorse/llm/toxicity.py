"""Toxicity: bags of subword embeddings, averaged into a linear softmax and trained jointly in numpy.

A word is a run of ASCII letters, digits and bytes over 127, folded to lower case. Its vector is the mean of the
embeddings of its byte n-grams (3 to 7, marked at either end of the word) and of the word itself, hashed into
`buckets`; a text's vector is the mean over its words; a linear softmax gives the score. A misspelling that was never
seen shares most of its n-grams with the word.

Training runs on the driver on a bounded sample: `per_class` labelled documents of either class with at most
`most_bytes` each, those of least hash, whatever the table's size. Once trained, embedding times weight is one number a
bucket, so an executor scores a text with a table of `buckets` floats, over every word of the whole text.

Defined cases. Null or wordless texts score by the bias alone, which is trained to call them clean. Labels that are
null or whose document is absent teach nothing; of several labels of one document the highest stands, of several texts
the least. Very long texts are scored whole. An extra column named `score` cannot be kept beside the score: ValueError.
With no label of one class the score is the share of the other: 0 with no labels at all. Null ids are not held out.
Repeated rows are scored alike. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytekernel import FOLDED, U64, prefix, slices, span_hash, words

BUCKETS = 1 << 18
DIM = 4
#: A few words in a hundred decide: they have to move the mean.
SCALE = np.float32(100)
#: Weight of one more text, without words and not toxic: what has no evidence is clean.
EMPTY = 0.25
GRAMS = (3, 4, 5, 6, 7)
PER_CLASS = 800
#: Longer texts are not taken for training, so what comes to the driver has a bound in bytes; they are scored whole.
MOST_BYTES = 1 << 16
#: Parts of the sample for calibration.
FOLDS = 3
INNER = np.zeros(256, bool)
INNER[128:] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    INNER[ord(_a) : ord(_b) + 1] = True


@dataclass
class Model:
    bias: float
    weight: np.ndarray  # one for each bucket

    def score(self, column: pa.Array) -> np.ndarray:
        out = []
        for _, _, buf, offsets in slices(column):
            rows = len(offsets) - 1
            row, word, first, p, start, end = _words(buf, offsets)
            z = np.full(rows, self.bias)
            if len(row):
                bucket, of = _subwords(p, start[first], end[first], len(self.weight))
                n = len(first)
                each = np.bincount(of, self.weight[bucket], n) / np.bincount(of, minlength=n)
                z += np.bincount(row, each[word], rows) / np.maximum(1, np.bincount(row, minlength=rows))
            out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
        return np.concatenate([*out, np.zeros(0)])


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row of each word, its distinct word, first place of each distinct word, prefix sums, starts, ends)."""
    start, end, row = words(buf, offsets, INNER)
    p = prefix(buf, FOLDED)
    _, first, word = np.unique(span_hash(p, start, end), return_index=True, return_inverse=True)
    return row, word.ravel(), first, p, start, end


def _subwords(p: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of the n-grams of these spans and of the spans themselves."""
    found, of = [span_hash(p, start, end, 0, 99)], [np.arange(len(start))]
    for n in GRAMS:
        count = np.maximum(0, end - start - n + 1)
        w = np.repeat(np.arange(len(start)), count)
        i = start[w] + np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count)
        found.append(span_hash(p, i, i + n, 0, (i == start[w]) + 2 * (i + n == end[w])))
        of.append(w)
    return (np.concatenate(found) & U64(buckets - 1)).astype(np.int64), np.concatenate(of)


def fit(column: pa.Array, toxic: np.ndarray, prior: float, buckets: int = BUCKETS, dim: int = DIM, epochs: int = 120, rate: float = 0.02, decay: float = 1e-7, sparse: float = 2e-5, least: int = 4, seed: int = 5) -> Model:
    """Train on texts and 0/1 labels, classes weighted alike; models of all parts but one calibrate the scores to the classes' prior."""
    toxic = np.asarray(toxic, bool)
    if toxic.all() or not toxic.any():
        share = float(toxic.mean()) if len(toxic) else 0.0
        return Model(40.0 if share else -40.0, np.zeros(buckets))
    doc, word, share, feature, of, known = [], [], [], [], [], {}
    rows = 0
    for _, _, buf, offsets in slices(column):
        row, w, first, p, start, end = _words(buf, offsets)
        if len(row):
            before = len(known)
            ids = np.array([known.setdefault(h, len(known)) for h in span_hash(p, start[first], end[first]).tolist()], np.int32)
            pair, n = np.unique(row * np.int64(len(first)) + w, return_counts=True)
            total = np.bincount(row, minlength=len(offsets) - 1)
            r = pair // len(first)
            doc.append((r + rows).astype(np.int32)), word.append(ids[pair % len(first)]), share.append((n / total[r]).astype(np.float32))
            new = ids >= before
            b, o = _subwords(p, start[first[new]], end[first[new]], buckets)
            o = ids[new][o]
            order = np.argsort(o, kind="stable")  # new words have rising numbers, so all slices together are in order
            feature.append(b[order].astype(np.int32)), of.append(o[order])
        rows += len(offsets) - 1
    words_n = len(known)
    del known
    doc, word, feature, of = (np.concatenate([*x, np.zeros(0, np.int32)]) for x in (doc, word, feature, of))
    share = np.concatenate([*share, np.zeros(0, np.float32)])
    # a feature's count of texts, word by word, bounds how many texts have it: the rare ones go
    grams = np.bincount(of, minlength=words_n).astype(np.float32)
    texts = np.bincount(word, minlength=words_n).astype(np.float32)
    many = np.zeros(buckets, np.float32)
    for i in range(0, len(of), 1 << 20):
        many += np.bincount(feature[i : i + (1 << 20)], texts[of[i : i + (1 << 20)]], buckets).astype(np.float32)
    often = (many >= least)[feature]
    feature, of = feature[often], of[often]
    there = np.zeros(buckets, bool)
    there[feature] = True
    used = np.flatnonzero(there)
    feature = (np.cumsum(there) - 1).astype(np.int32)[feature]
    live = np.flatnonzero(np.bincount(of, minlength=words_n))
    place = np.full(words_n, -1, np.int32)
    place[live] = np.arange(len(live))
    of, grams = place[of], grams[live]
    known = place[word] >= 0
    doc, word, share = doc[known], place[word][known], share[known]
    by_word, back = (np.argsort(x, kind="stable").astype(np.int32) for x in (word, feature))
    cuts = lambda x: np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    word_cut, feature_cut, doc_cut, share_cut = cuts(of), cuts(feature[back]), cuts(doc), cuts(word[by_word])
    seen, of_back, doc_by_word, share_by_word = doc[doc_cut], of[back], doc[by_word], share[by_word]
    y = toxic.astype(np.float32)
    some = min(int(toxic.sum()), int((~toxic).sum())) >= 2 * FOLDS
    place = np.empty(rows, np.int64)
    for side in (toxic, ~toxic):
        place[side] = np.arange(side.sum()) % FOLDS

    def to_features(per_text: np.ndarray, power: int = 1) -> np.ndarray:
        per_word = np.add.reduceat(per_text[doc_by_word] * share_by_word**power, share_cut) / grams**power
        return np.add.reduceat(per_word[of_back], feature_cut)

    def trained(inside: np.ndarray) -> tuple[np.ndarray, np.float32]:
        """(weight of each feature, bias) from the texts inside."""
        cost = np.zeros(rows, np.float32)
        for side in (toxic & inside, ~toxic & inside):
            cost[side] = 0.5 / side.sum()
        # steps are scaled by each feature's curvature and `decay`: what is in most texts does not swing, and what is
        # in few texts moves little, so single texts are not learnt by heart
        curve = 0.25 * SCALE**2 * (to_features(cost, 2) + to_features(cost) ** 2) + decay
        rng = np.random.default_rng(seed)
        e = rng.uniform(-0.01, 0.01, (len(used), dim)).astype(np.float32)
        w, b = (rng.choice(np.array([-1, 1], np.float32), dim) / np.sqrt(dim)).astype(np.float32), np.float32(0)
        speed = [np.zeros_like(e), np.zeros_like(w), np.float32(0)]
        for _ in range(epochs):
            # the gradient of an embedding lies along w: sums over words and texts need only the product of the two
            theta = e @ w
            g = (1 / (1 + np.exp(-np.clip(sums_of(theta) + b, -60, 60))) - y) * cost
            gt = SCALE * to_features(g) + decay * theta
            for k, step in enumerate((rate * (gt / curve)[:, None] * w, 0.1 * rate * (gt @ e), rate * (g.sum() + EMPTY / (1 + np.exp(-b))))):
                speed[k] = np.float32(0.9) * speed[k] - np.float32(step) if k == 2 else np.float32(0.9) * speed[k] - step.astype(np.float32)
            e, w, b = e + speed[0], w + speed[1], np.float32(b + speed[2])
            # features without steady evidence go to zero as a whole
            norm = np.sqrt(np.square(e).sum(axis=1)) + np.float32(1e-12)
            e *= np.maximum(0, 1 - 10 * rate * sparse / curve / norm)[:, None].astype(np.float32)
        return e @ w, b

    def sums_of(theta: np.ndarray) -> np.ndarray:
        """SCALE times the mean over a text's words of the mean over the word's features."""
        z = np.zeros(rows, np.float32)
        z[seen] = SCALE * np.add.reduceat((np.add.reduceat(theta[feature], word_cut) / grams)[word] * share, doc_cut)
        return z

    theta, bias = trained(np.ones(rows, bool))
    # the scores are calibrated on sums of texts that their model has not seen
    z = sums_of(theta)
    if some:
        for k in range(FOLDS):
            z[place == k] = sums_of(trained(place != k)[0])[place == k]
    weight = np.zeros(buckets)
    weight[used] = SCALE * theta
    return _calibrated(Model(float(bias), weight), z, toxic, min(max(prior, 1e-6), 1 - 1e-6))


def _calibrated(model: Model, z: np.ndarray, toxic: np.ndarray, prior: float) -> Model:
    """The model with a * z + c for its sums z: shrunk weights are stretched again, and the bias fits the classes' prior."""
    cost = np.where(toxic, prior / max(1, toxic.sum()), (1 - prior) / max(1, (~toxic).sum()))
    z, toxic, cost = np.append(z, 0.0), np.append(toxic, False), np.append(cost, EMPTY * (1 - prior))
    a, c = 1.0, model.bias
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -60, 60)))
        g, h = cost * (p - toxic), cost * p * (1 - p)
        grad = np.array([(g * z).sum() + 1e-3 * (a - 1), g.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, c = a - step[0], c - step[1]
    a = max(a, 0.1)
    return Model(float(c), model.weight * a)


def held_out(id_: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES) -> Model:
    """A model of the labelled documents that are not held out; at most per_class of either class come to the driver."""
    x = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y is not null")
    x = x.groupBy("id").agg(F.max("y").alias("y")).filter(~held_out(F.col("id")))
    counts = {r["y"]: r["n"] for r in x.groupBy((F.col("y") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    some = [x.filter(F.col("y") > 0 if y else F.col("y") <= 0).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (False, True)]
    ids = docs.sparkSession.createDataFrame(some[0].unionByName(some[1]).collect(), "id long, y int")
    fits = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.octet_length("text") <= most_bytes)
    texts = fits.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    table = texts.toArrow().sort_by("id")
    total = sum(counts.values())
    model = fit(table.column("text").combine_chunks(), table.column("y").to_numpy() > 0, counts.get(True, 0) / total if total else 0.0)
    del table
    _give_back()
    return model


def _give_back() -> None:
    """Hand the memory that training has freed back to the system, where the C library can: the driver goes on for long."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, score) of every row's whole text; the model goes out with the plan: `buckets` floats."""
    if "score" in (id_col, *keep):
        raise ValueError("a column named score cannot be kept")
    bias, weight = model.bias, model.weight.astype(np.float32)
    own = docs.select(F.col(id_col), *keep, F.col(text_col).alias("__text"))
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(bias, weight.astype(np.float64))
        for b in batches:
            s = pa.array(m.score(b.column("__text")), pa.float64())
            yield pa.record_batch([*(b.column(n) for n in names), s], names=[*names, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*(own.schema[n] for n in names), StructField("score", DoubleType())])
    return own.mapInArrow(run, schema)
