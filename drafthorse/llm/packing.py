"""Packing of tokenized documents into windows, best fit decreasing.

A document's ids are cut into full windows and a rest. Rests are packed over the whole table, longest first, each
into the open window with the least room that holds it; a segment tree indexed by remaining capacity finds that
window. Equal lengths are placed in one step: a group of windows with the same room takes room // length rests each.
So the plan comes from the counts of the at most `window` lengths alone, has a bounded number of entries whatever the
input, and equals the one-by-one best fit. A piece then finds its window by its rank among the pieces of its length.

Ids come from the byte-level BPE file by the `tokenizers` library's rules; `tiktoken` runs the same ranks and pattern
several times faster and gives the same ids (held against each other over every code point). A text that holds the
special token's string goes through `tokenizers` itself.

Defined cases. Null text is empty; an empty document is its end id alone. Repeated rows are documents of their own.
Very long texts are encoded whole and cut into full windows. Null ids are ids like any other. Other columns are not read. An empty table gives an empty result.

With a column of positions, pieces of one length are taken in its order, and sequences are numbered in the order of
their leading (longest) pieces, so a mixed order reaches the sequences.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_along, number_within
from ..session import materialize

WINDOW = 2048
END_ID = 1
SPECIAL = "<|endoftext|>"
#: Pre-tokenizer pattern of the byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[tuple[str, str], list] = {}


def _encoder(json_file: str, rank_file: str):
    """encode(text) -> ids, kept for the life of the worker; the slower of the two is loaded when a text needs it."""
    if (json_file, rank_file) not in _encoders:
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[json_file, rank_file] = [tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})]
    pair = _encoders[json_file, rank_file]

    def encode(text: str):
        if SPECIAL not in text:
            return pair[0].encode_to_numpy(text, disallowed_special=())
        if len(pair) == 1:
            from tokenizers import Tokenizer

            pair.append(Tokenizer.from_file(json_file))
        return pair[1].encode(text, add_special_tokens=False).ids

    return encode


def tokenizer_files(names: tuple[str, str] = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")) -> tuple[str, str]:
    import public_tokenizers

    return tuple(str(public_tokenizers.path(n)) for n in names)


def _pieces(files: tuple[str, str] | None, window: int, end_id: int):
    """Rows (id, text, place) to a row for each piece; files None: the installed ones, found on the executor."""
    types = pa.schema([(c, pa.int64()) for c in ("id", "start", "length", "ids_crc32", "doc_tokens", "place")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(*(files or tokenizer_files()))
        for b in batches:
            row, start, length, crc, total = [], [], [], [], []
            for r, text in enumerate(b.column(1)):
                text = text.as_py()  # one text at a time: a batch's ids would be many times its size
                ids = np.append(encode(text), end_id).astype("<u4") if text else np.array([end_id], "<u4")
                for s in range(0, len(ids), window):
                    piece = ids[s : s + window]
                    row.append(r), start.append(s), length.append(len(piece)), crc.append(zlib.crc32(piece)), total.append(len(ids))
            at = pa.array(row, pa.int64())
            yield pa.record_batch([b.column(0).take(at), *(pa.array(c, pa.int64()) for c in (start, length, crc, total)), b.column(2).take(at)], schema=types)

    return run


class RoomTree:
    """Segment tree over the remaining capacities 0..window: which of them have open windows, and the least that fits."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += n
            at //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest room >= least with an open window."""
        at = least + self.leaves
        if self.count[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Entries (length, first rank, pieces, first window, pieces a window, offset), lengths from long to short.

    The piece with rank r in the entry's ranks goes to window first + (r - first rank) // each, at offset +
    (r - first rank) % each * length.
    """
    tree, groups, plan, opened = RoomTree(window), {}, [], 0  # groups: room -> [(first window, windows)]
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = window, window // length
                n = -(-left // each)
                first, opened = opened, opened + n
            else:
                first, n = groups[room].pop()
                tree.add(room, -n)
                each = room // length
            full = min(n, left // each)
            if full:
                plan.append((length, rank, full * each, first, each, window - room))
                groups.setdefault(room - each * length, []).append((first, full))
                tree.add(room - each * length, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if left and n:  # fewer than `each` are left: one window takes them
                plan.append((length, rank, left, first, each, window - room))
                groups.setdefault(room - left * length, []).append((first, 1))
                tree.add(room - left * length, 1)
                left, first, n = 0, first + 1, n - 1
            if n:
                groups.setdefault(room, []).append((first, n))
                tree.add(room, n)
    return plan


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, files: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", position_col: str | None = None) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece.

    files: the tokenizer's JSON and rank files, at paths that every executor can open; by default those installed
    with the `public_tokenizers` package. position_col: whole numbers from 0, not null, that the sequences follow.
    """
    spark = docs.sparkSession
    x = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(position_col).cast("long").alias("place") if position_col else F.lit(None).cast("long").alias("place"))
    pieces = materialize(x.mapInArrow(_pieces(files, window, end_id), "id long, start long, length long, ids_crc32 long, doc_tokens long, place long"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit_plan(counts, window)
    entries = spark.createDataFrame(plan, "length long, rank0 long, n long, window0 long, each long, offset0 long")
    key = ["id", "start", "ids_crc32"]
    ranked = number_along(pieces, ["length"], "place", key, "rank") if position_col else number_within(pieces, ["length"], key, "rank")
    # the plan has a few entries a length, at most about 4 * window in all, whatever the input
    near = (F.col("rank") >= F.col("rank0")) & (F.col("rank") < F.col("rank0") + F.col("n"))
    placed = ranked.join(F.broadcast(entries), "length").filter(near)
    i = F.col("rank") - F.col("rank0")
    out = placed.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("window0") + F.floor(i / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("offset0") + i % F.col("each") * F.col("length")).cast("long").alias("offset"), *(["place"] if position_col else []),
    )
    if not position_col:
        return out
    out = materialize(out)
    leading = materialize(out.filter("offset = 0").select("sequence_id", "place", "start", F.lit(0).alias("all")))
    numbered = number_along(leading, ["all"], "place", ["start", "sequence_id"], "new_id").select("sequence_id", "new_id")
    out = out.join(numbered, "sequence_id")
    return out.select(id_col, "start", "length", "ids_crc32", "doc_tokens", F.col("new_id").alias("sequence_id"), "offset")
