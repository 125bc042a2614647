"""Removal of repeated passages: every byte under a string of `length` bytes that also starts elsewhere.

A suffix array over content-sampled suffixes. Winnowing picks, for each window of `length` bytes, the place of
its least k-gram hash; equal windows pick the same place, so the window starts of a text fall into short ranges
that are named by distances to a picked place. A range is split into cells; a cell's suffix is the text that all
its windows have in common. Suffixes are range-partitioned at sampled splitters by their leading bytes (then by
fingerprints and place, so a run of equal suffixes may span buckets). A bucket holds about a million suffixes,
whatever the input; it is sorted by multikey quicksort, one 64-bit token of the key after the other (leading bytes,
then fingerprints of the text that follows), suffixes are compared with their neighbours, and the first and last one
of a bucket across its boundaries. A cell whose common text is nowhere else is done (no repeat); a cell whose whole
span is found elsewhere is done (all repeats); the others are cut into smaller cells, at last of one start each, where
the two texts are the window itself, compared on 128 bits. So only places near the ends of repeats are looked at
again, and a passage that N documents share costs N rows, not N * N.

The same runs over words instead of bytes: shared_passages() marks the documents that have `length` words in a row
in common with another one, however few bytes these are.

Defined cases. Null text is the empty text. Texts under `length` bytes (words) have no spans. Very long texts stand
whole in one batch of their own. Repeated rows are documents of their own, so their texts repeat each other. A null
id is an id like any other. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize, shuffle_partitions
from .bytekernel import SPACE, TABLE, U64, prefix, slices, sliding_min, span_hash, sums, words

NO_ID = -(2**63)
#: Suffixes of a bucket, about: it is sorted in memory.
BUCKET = 1 << 20
#: Parts of a bucket that are sorted at once.
LEAF = 4096
CELL = "lead long, core long, whole long, id long, h long, range long"
_CELL_TYPES = pa.schema([(n, pa.int64()) for n in ("lead", "core", "whole", "id", "h", "range")])
_MARKED = f"{CELL}, core_seen boolean, whole_seen boolean, mixed boolean, bucket int, edge int"


@dataclass(frozen=True)
class Scheme:
    """What a token is, how many make a window, how many a gram, and the widths of cells from pass to pass.

    apart: only other documents count, so a document hands in equal cells once.
    """

    unit: str
    length: int
    gram: int
    widths: tuple[int, ...]
    apart: bool = False

    def tokens(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable]:
        """(a random number for each token, offsets of the rows in tokens, leading 64 bits at a token)."""
        if self.unit == "bytes":
            return TABLE[buf], offsets, lambda i: _lead_bytes(buf, i)
        start, end, row = words(buf, offsets, ~SPACE)
        values = span_hash(prefix(buf), start, end)
        return values, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(offsets) - 1))]), lambda i: values[i]


def _lead_bytes(buf: np.ndarray, i: np.ndarray) -> np.ndarray:
    lead = np.zeros(len(i), np.uint64)
    for k in range(8):
        lead |= buf[i + k].astype(np.uint64) << U64(56 - 8 * k)
    return lead


def _ranges(values: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, picked token, least and greatest distance of the window starts that pick it)."""
    n, none = len(values), np.zeros(0, np.int64)
    if n < length or not (np.diff(offsets) >= length).any():
        return none, none, none, none
    p = sums(values)
    at = np.arange(n - gram + 1)
    h = span_hash(p, at, at + gram)
    bits = int(len(h)).bit_length()
    low = U64((1 << bits) - 1)
    key = (h & ~low) | (len(h) - 1 - at).astype(np.uint64)  # of equal hashes the rightmost
    picked = len(h) - 1 - (sliding_min(key, length - gram + 1) & low).astype(np.int64)
    valid = np.zeros(n + 1, np.int32)
    rows = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(valid, offsets[rows], 1)
    np.add.at(valid, offsets[rows + 1] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[: len(picked)]))
    a = picked[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (a[1:] != a[:-1]) | (starts[1:] != starts[:-1] + 1)
    i = np.flatnonzero(new)
    one, two = starts[i], starts[np.append(i[1:], len(starts)) - 1]
    return np.searchsorted(offsets, one, side="right") - 1, a[i], a[i] - two, a[i] - one


def _split(place: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(index of the range, cell's first distance, least and greatest distance inside the cell)."""
    first = lo // width
    n = hi // width - first + 1
    of = np.repeat(np.arange(len(place)), n)
    cell = (first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * width
    return of, cell, np.maximum(lo[of], cell), np.minimum(hi[of], cell + width - 1)


def _cells(values: np.ndarray, lead: Callable, base: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int, s: Scheme) -> tuple[np.ndarray, ...]:
    """Keys of the cells of these ranges: (index of the range, lead, core, whole, packed range).

    base: where the range's text begins in values.
    """
    of, cell, lo, hi = _split(place, lo, hi, width)
    a = place[of]
    last = np.minimum(cell + width - 1, s.length - s.gram)
    one, two = sums(values), sums(values, base=1)
    i = a - cell
    core = span_hash(one, i, a - last + s.length, 0, cell * 1024 + width)
    whole = span_hash(two, a - hi, a - lo + s.length, 1, lo * 1024 + hi)
    first = (lead(i) ^ U64(1 << 63)).view(np.int64)
    packed = (a - base[of]) << 20 | lo << 10 | hi
    return of, first, core.view(np.int64), whole.view(np.int64), packed


def _batch(cells: tuple, rows: np.ndarray, ids: np.ndarray, hs: np.ndarray, apart: bool) -> pa.RecordBatch:
    of, first, core, whole, packed = cells
    r = rows[of]
    columns = [first, core, whole, ids[r], hs[r], packed]
    if apart:
        order = np.lexsort((whole, core, r))
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in (r, core, whole)])
        columns = [c[order[new]] for c in columns]
    return pa.record_batch(columns, schema=_CELL_TYPES)


def _first_cells(s: Scheme) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hs = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for at, _, buf, offsets in slices(b.column(2)):
                values, bounds, lead = s.tokens(buf, offsets)
                row, place, lo, hi = _ranges(values, bounds, s.length, s.gram)
                if len(row):
                    yield _batch(_cells(values, lead, bounds[row], place, lo, hi, s.widths[0], s), row + at, ids, hs, s.apart)

    return run


def _next_cells(s: Scheme, width: int) -> Callable:
    """As _first_cells, of rows (id, h, text, todo) where todo holds packed ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hs = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            todo = b.column(3)
            left = todo.offsets.to_numpy().astype(np.int64)
            ranges = todo.values.to_numpy(zero_copy_only=False)
            for at, end, buf, offsets in slices(b.column(2)):
                packed = ranges[left[at] : left[end]]
                if not len(packed):
                    continue
                values, bounds, lead = s.tokens(buf, offsets)
                row = np.repeat(np.arange(end - at), np.diff(left[at : end + 1]))
                cells = _cells(values, lead, bounds[row], (packed >> 20) + bounds[row], packed >> 10 & 1023, packed & 1023, width, s)
                yield _batch(cells, row + at, ids, hs, s.apart)

    return run


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order of the rows by keys[0], then keys[1] and so on, by multikey quicksort.

    A part is split in three at a pivot of one token; what equals the pivot goes on at the next token. Parts of at
    most LEAF rows are sorted at once on the tokens that are left.
    """
    order = np.arange(len(keys[0]))
    parts = [(0, len(order), 0)]
    while parts:
        lo, hi, d = parts.pop()
        if d == len(keys) or hi - lo < 2:
            continue
        part = order[lo:hi]
        if hi - lo <= LEAF:
            order[lo:hi] = part[np.lexsort([k[part] for k in reversed(keys[d:])])]
            continue
        v = keys[d][part]
        pivot = np.sort(v[:: max(1, len(v) // 9)])[4]
        less, more = v < pivot, v > pivot
        a, b = int(less.sum()), int(more.sum())
        order[lo:hi] = np.concatenate([part[less], part[~(less | more)], part[more]])
        parts += [(lo, lo + a, d), (lo + a, hi - b, d + 1), (hi - b, hi, d)]
    return order


def _sort_and_compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort a bucket; its rows whose core is seen at a neighbour, its first and last rows in any case (edge 1, 2 or 3).

    mixed: a neighbour has the same core in another whole.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    columns = [np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in held]) for n in _CELL_TYPES.names]
    del held
    order = multikey_order(columns[:3])
    columns = [c[order] for c in columns]
    n = len(order)
    core, whole, mixed, edge = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int32)
    same = (columns[0][1:] == columns[0][:-1]) & (columns[1][1:] == columns[1][:-1])
    full = same & (columns[2][1:] == columns[2][:-1])
    for flag, pair in ((core, same), (whole, full), (mixed, same & ~full)):
        flag[1:] |= pair
        flag[:-1] |= pair
    edge[0] += 1
    edge[-1] += 2
    keep = core | (edge > 0)
    types = pa.schema([*_CELL_TYPES, ("core_seen", pa.bool_()), ("whole_seen", pa.bool_()), ("mixed", pa.bool_()), ("bucket", pa.int32()), ("edge", pa.int32())])
    bucket = np.full(int(keep.sum()), TaskContext.get().partitionId(), np.int32)
    out = pa.Table.from_arrays([pa.array(c) for c in (*(c[keep] for c in columns), core[keep], whole[keep], mixed[keep], bucket, edge[keep])], schema=types)
    yield from out.to_batches(max_chunksize=1 << 16)


def sorted_suffixes(cells: DataFrame) -> DataFrame:
    """(id, h, range, whole_seen, again) of the cells whose core stands at another place as well; whole_seen: the whole span too.

    again: the cell has to be cut. That holds for those whose whole span is nowhere else, and for one or two of each
    set of equal spans that share their core with others, for those others to be compared with. What comes to the
    driver is the first and last row of each bucket. cells are a table of materialize(), which is deleted.
    """
    spark = cells.sparkSession
    buckets = max(shuffle_partitions(spark), -(-cells.count() // BUCKET))
    dealt = cells.repartitionByRange(buckets, "lead", "core", "whole", "id", "h", "range")
    marked = materialize(dealt.mapInArrow(_sort_and_compare, _MARKED))
    discard(cells)
    edges = sorted((r.asDict() for r in marked.filter("edge > 0").collect()), key=lambda r: (r["bucket"], r["edge"] == 2))
    for one, two in zip(edges, edges[1:], strict=False):
        if one["bucket"] != two["bucket"] and (one["lead"], one["core"]) == (two["lead"], two["core"]):
            one["core_seen"] = two["core_seen"] = True
            same = one["whole"] == two["whole"]
            for r in (one, two):
                r["whole_seen"], r["mixed"] = r["whole_seen"] or same, r["mixed"] or not same
    fixed = spark.createDataFrame([(r["id"], r["h"], r["range"], r["whole_seen"], r["mixed"] or not r["whole_seen"]) for r in edges if r["core_seen"]], "id long, h long, range long, whole_seen boolean, again boolean")
    return marked.filter("edge = 0").select("id", "h", "range", "whole_seen", F.expr("mixed or not whole_seen").alias("again")).unionByName(fixed)


def _merged(length: int) -> Callable:
    """Rows (id, h, text, ranges) to (id, h, n_bytes, spans, kept)."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    types = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hs, got = b.column(0), b.column(1), b.column(3)
            left, values = got.offsets.to_numpy(), got.values.to_numpy(zero_copy_only=False)
            for at, end, buf, offsets in slices(b.column(2)):
                spans, kept, sizes = [], [], np.diff(offsets)
                for r in range(at, end):
                    text = buf[offsets[r - at] : offsets[r - at + 1]]
                    x = values[left[r] : left[r + 1]]
                    one, two = (x >> 20) - (x & 1023), (x >> 20) - (x >> 10 & 1023) + length
                    order = np.argsort(one, kind="stable")
                    one, two = one[order], np.maximum.accumulate(two[order]) if len(x) else two
                    new = np.ones(len(one), bool)
                    new[1:] = one[1:] > two[:-1]
                    i = np.flatnonzero(new)
                    one, two = one[i], two[np.append(i[1:], len(new)) - 1] if len(i) else two
                    spans.append([{"start": int(s), "end": int(e)} for s, e in zip(one, two, strict=True)])
                    parts, last = [], 0
                    for s, e in zip(one, two, strict=True):
                        parts.append(text[last:s].tobytes())
                        last = e
                    kept.append(b"".join([*parts, text[last:].tobytes()]))
                yield pa.record_batch([ids.slice(at, end - at), hs.slice(at, end - at), sizes.astype(np.int64), pa.array(spans, types.field(3).type), pa.array(kept, pa.binary())], schema=types)

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 51) -> DataFrame:
    """(id, h), once each, of the rows that have `length` words in a row in common with another row; h: xxhash64 of the text.

    Words are runs of bytes other than space and \\x09-\\x0D; a null id is NO_ID.
    """
    s = Scheme("words", length, max(1, length // 3), (length, 1), apart=True)
    x = _rows(docs, id_col, text_col)
    seen = sorted_suffixes(materialize(x.mapInArrow(_first_cells(s), CELL)))
    todo = seen.filter("again").groupBy("id", "h").agg(F.collect_set("range").alias("todo"))
    open_ = x.join(todo, ["id", "h"]).select("id", "h", "text", "todo")
    more = sorted_suffixes(materialize(open_.mapInArrow(_next_cells(s, s.widths[1]), CELL)))
    return seen.filter("whole_seen").select("id", "h").unionByName(more.filter("whole_seen").select("id", "h")).distinct()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep: Callable[[Column], list[Column]] | None = None, words: int | None = None) -> DataFrame:
    """(id_col, n_bytes, spans, *keep): spans are the maximal removed byte runs (start, end), judged on the input.

    keep makes columns of the remaining bytes (default: `kept`, those bytes); they are made before any shuffle of
    documents that lose nothing, so that a digest does not move whole texts. words: adds `shares_passage`, whether
    that many words in a row stand in another document too.
    """
    gram = 32
    if not gram < length <= 1023:
        raise ValueError(f"length must be over {gram} and at most 1023")
    s = Scheme("bytes", length, gram, (192, 16, 1))
    keep = keep or (lambda kept: [kept.alias("kept")])
    x = _rows(docs, id_col, text_col)
    seen = sorted_suffixes(materialize(x.mapInArrow(_first_cells(s), CELL)))
    lists = seen.groupBy("id", "h").agg(
        F.collect_set(F.when(F.col("again"), F.col("range"))).alias("todo"),
        F.collect_set(F.when(F.col("whole_seen"), F.col("range"))).alias("ranges"),
    )
    held = materialize(x.join(lists, ["id", "h"]).select("id", "h", "text", "todo", "ranges"))
    found = [held.select("id", "h", F.explode("ranges").alias("range"))]
    open_ = held.filter(F.size("todo") > 0).select("id", "h", "text", "todo")
    for width in s.widths[1:]:
        got = sorted_suffixes(materialize(open_.mapInArrow(_next_cells(s, width), CELL)))
        found.append(got.filter("whole_seen").select("id", "h", "range"))
        if width > 1:
            left = got.filter("again").groupBy("id", "h").agg(F.collect_set("range").alias("todo"))
            open_ = held.select("id", "h", "text").join(left, ["id", "h"]).select("id", "h", "text", "todo")
    all_found = found[0].unionByName(found[1]).unionByName(found[2])
    ranges = materialize(all_found.groupBy("id", "h").agg(F.collect_set("range").alias("ranges")))
    types = "id long, h long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    cut = held.select("id", "h", "text").join(ranges, ["id", "h"]).select("id", "h", "text", "ranges").mapInArrow(_merged(length), types)
    changed = cut.select("id", "h", "n_bytes", "spans", *keep(F.col("kept")))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    whole = x.select("id", "h", F.octet_length(text).cast("long").alias("n_bytes"), F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"), *keep(text))
    out = changed.unionByName(whole.join(ranges.select("id", "h"), ["id", "h"], "left_anti").select(*changed.columns))
    names = [c for c in out.columns if c not in ("id", "h")]
    if words:
        marks = materialize(shared_passages(docs, id_col, text_col, words)).withColumn("shares_passage", F.lit(True))
        out = out.join(marks, ["id", "h"], "left").withColumn("shares_passage", F.coalesce("shares_passage", F.lit(False)))
        names.append("shares_passage")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), *names)
