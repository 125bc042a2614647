"""Near-duplicate documents: MinHash with tensored banding, links confirmed on whole shingle sets.

A text's words are the runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased; its set is the distinct
runs of five words (fewer words: the whole sequence as one). Two collections of twelve small hashes, each of two
MinHash values, are computed from 48 values; a table is keyed by one hash of either collection, so 24 hashes make
144 tables of four values each. A pair of similarity s is missed with probability about 2 * (1 - s * s) ** 12, under
1e-4 at 0.75.

Candidates are narrowed in steps that lose no table hit: documents with the same set are one, hashes that no other
set has are put aside, tables are keyed from the rest, and keys of one document are put aside. Then every document
is held against the first one of its tables. The members of tables that are not yet in one component stay open. Two sets
of similarity 0.75 share one of the rarest quarter of the shingles of either (their prefix, by how many open documents
have a shingle), so only open documents that share a prefix shingle are held against each other: they are joined to
clusters, and in a cluster the documents outside its largest component are held against all of it, in tiles of bounded
size, by posting lists of the whole sets; a tile hands on only links that join components. A passage that many
documents share is rare in none of them, so it glues no clusters. A group of N copies costs N comparisons, and
no list of pairs grows with the square of a group.

Defined cases. Null text, empty text and text of white space have an empty set, are linked with nothing and keep
their own id. Very long texts have their whole set. Rows with a null id are linked with nothing: their component_id is
null, and they are kept. Rows that repeat an id are judged row by row on their own text, but are one node: a link of
one is a link of all. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import discard, materialize
from .bytekernel import FOLDED, SPACE, U64, mix, prefix, slices, span_hash, words

SHINGLE = 5
SMALL = 12
ROWS = 2
VALUES = 2 * SMALL * ROWS
TILE = 1024
#: Parts that the copies of one set are dealt to.
COPY_PARTS = 64
_rng = np.random.default_rng(77003)
_MUL = _rng.integers(1, 2**63, VALUES, dtype=np.uint64) * U64(2) + U64(1)
_XOR = _rng.integers(1, 2**63, VALUES, dtype=np.uint64)
_STEP = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct shingle hashes of row r stand at bounds[r] : bounds[r + 1]."""
    rows = len(offsets) - 1
    start, end, row = words(buf, offsets, ~SPACE)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    h = span_hash(prefix(buf, FOLDED), start, end)
    n = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(n)])
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    of = np.repeat(np.arange(rows), count)
    at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    x = np.zeros(len(of), np.uint64)
    for k in range(SHINGLE):
        there = at + k < first[of + 1]
        x += np.where(there, mix((h[np.minimum(at + k, len(h) - 1)] + U64(k + 1)) * _STEP[k]), U64(0))
    x = mix(x)
    order = np.lexsort((x, of))
    x, of = x[order], of[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (of[1:] != of[:-1])
    return x[new], np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=rows))])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to (id, n, d1, d2, sig): size and digest of the set, and its MinHash values as 32-bit words."""
    types = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sig", pa.binary())])
    for b in batches:
        for at, end, buf, offsets in slices(b.column(1)):
            x, bounds = shingle_sets(buf, offsets)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            sig = np.zeros((end - at, VALUES), np.uint32)
            d1, d2 = np.zeros(end - at, np.uint64), np.zeros(end - at, np.uint64)
            if len(full):
                lead = bounds[:-1][full]
                for k in range(VALUES):
                    sig[full, k] = np.minimum.reduceat(((x ^ _XOR[k]) * _MUL[k]) >> U64(32), lead).astype(np.uint32)
                d1[full] = np.add.reduceat(mix(x + U64(1)), lead)
                d2[full] = np.add.reduceat(mix(x ^ U64(0x5851F42D4C957F2D)), lead)
            raw = sig.astype("<u4").tobytes()
            wide = 4 * VALUES
            yield pa.record_batch(
                [b.column(0).slice(at, end - at), n.astype(np.int64), d1.view(np.int64), d2.view(np.int64), pa.array([raw[i : i + wide] if c else None for i, c in zip(range(0, len(raw), wide), n, strict=True)], pa.binary())],
                schema=types,
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to (id, grams)."""
    types = pa.schema([("id", pa.int64()), ("grams", pa.list_(pa.int64()))])
    for b in batches:
        for at, end, buf, offsets in slices(b.column(1)):
            x, bounds = shingle_sets(buf, offsets)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x.view(np.int64)))
            yield pa.record_batch([b.column(0).slice(at, end - at), lists], schema=types)


def _tile_links(percent: int):
    """Links (a, b) that join components, between the left and the right rows (id, component, grams) of a tile."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        def columns(t: pa.Table) -> tuple[np.ndarray, ...]:
            grams = t.column("grams").combine_chunks()
            return t.column("id").to_numpy(), t.column("component").to_numpy(), grams.offsets.to_numpy().astype(np.int64), grams.values.to_numpy(zero_copy_only=False)

        one, two = [], []
        if left.num_rows and right.num_rows:
            (ids, comp, bounds, grams), (rid, rcomp, rbounds, rgrams) = columns(left), columns(right)
            rsize = np.diff(rbounds)
            owner = np.repeat(np.arange(len(rid)), rsize)
            order = np.argsort(rgrams[rbounds[0] : rbounds[-1]], kind="stable")
            posted, owner = rgrams[rbounds[0] : rbounds[-1]][order], owner[order]
            names, place = np.unique(np.concatenate([comp, rcomp]), return_inverse=True)
            root = np.arange(len(names))
            mine, theirs = place[: len(comp)], place[len(comp) :]
            for i in np.argsort(ids, kind="stable"):
                own = grams[bounds[i] : bounds[i + 1]]
                lo = np.searchsorted(posted, own, "left")
                n = np.searchsorted(posted, own, "right") - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(rid))
                linked = np.flatnonzero((100 * common >= percent * (len(own) + rsize - common)) & (root[theirs] != root[mine[i]]))
                for r in np.unique(root[theirs[linked]]):
                    j = linked[root[theirs[linked]] == r]
                    j = j[np.argmin(rid[j])]
                    one.append(min(ids[i], rid[j])), two.append(max(ids[i], rid[j]))
                    root[root == r] = root[mine[i]]
        return pa.table({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64())})

    return run


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * common shingles >= percent * shingles of either."""
    one = sets.select(F.col("id").alias("a"), F.col("grams").alias("ga"))
    two = sets.select(F.col("id").alias("b"), F.col("grams").alias("gb"))
    common = F.size(F.array_intersect("ga", "gb")).cast("long")
    both = pairs.join(one, "a").join(two, "b").withColumn("common", common)
    return both.filter(100 * F.col("common") >= percent * (F.size("ga") + F.size("gb") - F.col("common"))).select("a", "b").distinct()


def prefix_clusters(sets: DataFrame, percent: int) -> DataFrame:
    """(id, cluster) of the documents (id, grams) that share a shingle of their prefixes with another; pairs of
    similarity >= percent / 100 are always in one cluster.

    A prefix are the size - ceil(size * percent / 100) + 1 rarest shingles; those of one document alone count in it
    but link nothing.
    """
    n = F.size("grams")
    length = (n - F.ceil(n * percent / F.lit(100)) + 1).cast("int")
    sized = sets.select("id", F.xxhash64("grams").alias("k"), length.alias("length"), n.alias("n"), "grams")
    grams = sized.select("id", "k", "length", "n", F.explode("grams").alias("g"))  # apart, or k is worked out for each shingle
    common = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    own = Window.partitionBy("id", "k")
    place = F.row_number().over(own.orderBy("df", "g")) + F.col("n") - F.count(F.lit(1)).over(own)
    kept = materialize(grams.join(common, "g").withColumn("place", place).filter("place <= length").select("id", "g"))
    heads = kept.groupBy("g").agg(F.min("id").alias("head"), F.max("id").alias("tail")).filter("head < tail").select("g", "head")
    found = connected_components(kept.join(heads, "g").select(F.col("id").alias("a"), F.col("head").alias("b")), "a", "b")
    return found.select(F.col("node").alias("id"), F.col("component").alias("cluster"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(id_col, n_shingles, component_id, n_links, kept), a row for each row.

    Links join documents whose sets have similarity >= percent / 100; component_id is the smallest id that links
    reach, kept marks the one document of a component that has it. n_links counts the links that were confirmed on
    the way there (copies of one set are linked in a tree of two levels).
    """
    all_rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    x = all_rows.filter("id is not null")
    rows = materialize(all_rows.mapInArrow(_signatures, "id long, n long, d1 long, d2 long, sig binary"))
    full = rows.filter("n > 0 and id is not null")
    # a set's copies hang on the first of their part, the parts' firsts on the first of all: no key holds all copies
    digest = ["d1", "d2"]
    parted = full.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(COPY_PARTS)))
    near = materialize(parted.groupBy(*digest, "part").agg(F.min("id").alias("near")))
    first = near.groupBy(*digest).agg(F.min("near").alias("first"))
    same = parted.join(near, [*digest, "part"]).select(F.col("near").alias("a"), F.col("id").alias("b"))
    same = same.unionByName(near.join(first, digest).select(F.col("first").alias("a"), F.col("near").alias("b"))).filter("a <> b").distinct()
    sets_of = full.join(first.withColumnRenamed("first", "id"), ["id", *digest]).select("id", *digest, "sig").dropDuplicates(["id", *digest])

    hashes = sets_of.select("id", F.explode(F.expr(
        f"transform(sequence(0, {2 * SMALL - 1}), k -> struct(k < {SMALL} as one, xxhash64(k, substring(sig, {4 * ROWS} * k + 1, {4 * ROWS})) as v))"
    )).alias("s")).select("id", "s.one", "s.v")
    common = hashes.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("v")
    held = hashes.join(common, "v", "left_semi").groupBy("id").agg(
        F.collect_set(F.when(F.col("one"), F.col("v"))).alias("one"), F.collect_set(F.when(~F.col("one"), F.col("v"))).alias("two")
    )
    tables = held.filter("size(one) > 0 and size(two) > 0").select("id", F.explode(F.expr("flatten(transform(one, a -> transform(two, b -> xxhash64(a, b))))")).alias("t"))
    heads = tables.groupBy("t").agg(F.min("id").alias("head"), F.max("id").alias("tail")).filter("head < tail")
    members = materialize(tables.join(heads, "t").select("t", "id", "head"))

    named = members.select("id").distinct()
    texts = x.withColumn("h", F.xxhash64("text")).join(named, "id").dropDuplicates(["id", "h"])
    sets = materialize(texts.select("id", "text").mapInArrow(_sets, "id long, grams array<long>").filter("size(grams) > 0"))
    star = members.filter("id <> head").groupBy("id").agg(F.min("head").alias("a")).select("a", F.col("id").alias("b"))
    links = materialize(confirm(star, sets, percent).unionByName(same))
    found = connected_components(links, "a", "b")

    placed = members.join(found.withColumnRenamed("node", "id"), "id", "left").select("t", "id", F.coalesce("component", "id").alias("component"))
    split = placed.groupBy("t").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("n")).filter("c1 < c2")
    open_ = materialize(placed.join(split.select("t"), "t", "left_semi"))
    if not open_.isEmpty():
        loose = materialize(open_.select("id", "component").distinct())
        clusters = prefix_clusters(sets.join(loose.select("id"), "id", "left_semi"), percent)
        inside = clusters.join(loose, "id")
        mixed = inside.groupBy("cluster").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 < c2").select("cluster")
        inside = materialize(inside.join(mixed, "cluster", "left_semi").select("id", "cluster", "component"))
        sizes = inside.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
        sizes = sizes.groupBy("cluster").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most"))
        parts = lambda n: F.greatest(F.lit(1), F.ceil(n / TILE)).cast("int")
        sizes = sizes.select("cluster", F.col("most.component").alias("largest"), parts(F.col("n") - F.col("most.n")).alias("lefts"), parts(F.col("n")).alias("rights"))
        whole = inside.join(sizes, "cluster").join(sets, "id")
        hashed = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        keys = ["cluster", "lo", "hi"]
        cols = [F.col(c).alias(c) for c in (*keys, "id", "component", "grams")]
        left = whole.filter("component <> largest").withColumn("lo", hashed(F.col("lefts"))).withColumn("hi", every("rights")).select(cols)
        right = whole.withColumn("hi", hashed(F.col("rights"))).withColumn("lo", every("lefts")).select(cols)
        more = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile_links(percent), "a long, b long")
        more = materialize(more.distinct())
        if not more.isEmpty():
            links = materialize(links.unionByName(more))
            found = connected_components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    seen = found.join(degree, "node", "left")
    discard(members)
    out = rows.select("id", "n").join(seen, rows["id"] == seen["node"], "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
