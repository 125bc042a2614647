"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form one run of bytes, cut into blocks. With weight w, block i of a source (from 0) is
released at slot floor(i / w) and due at ceil((i + 1) / w); of the released blocks the earliest deadline runs, so
that after any number of slots each source has had its share to within less than one block, as long as no source has
run out. Slots come from the exact rational weights, so no drift adds up. A document stands in the block in which it
begins; one that is longer than a block uses up the slots of all the blocks that it covers, so a source's bytes are
never ahead of or behind its share by more than a block and its longest document.

The schedule is drawn up on the driver, one step a block. Blocks hold `block_bytes`; by default 64 KB, or a 2^20th of
all text where that is more, so the schedule has about a million entries at most, whatever the input.

A source that has run out leaves its slots empty; they close up, and the others go on in their proportion. Nothing
is dropped or repeated: what a source has beyond the others comes last.

The order inside a source is by a hash of id and text: rows are dealt into chunks of about 64 blocks by it and sorted
inside a chunk; a chunk begins where the bytes of those before it end. So no source is sorted in one task, and the
windows over blocks are cut into spans of `period` slots.

Defined cases. Null source is a source of its own (as ''). A document counts its bytes and one more, so empty and null
texts (one byte) fill blocks too. Null ids and repeated rows are rows like any other. Very long texts: as above. Sources
without a given weight weigh `other`; without that, a missing weight is a ValueError, as are weights below 0 or
all 0. Without any given weight sources weigh the square root of their bytes. Sources of weight 0 come after all others,
in equal shares. The number of sources is bounded only by the driver's memory. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from heapq import heapify, heappop, heappush
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, materialize

PERIOD = 64
BLOCK_BYTES = 1 << 16
#: Blocks of the whole schedule, about, from where blocks grow.
MOST_BLOCKS = 1 << 20
CHUNK_BLOCKS = 64
#: Slots handed to Spark at a time.
SLICE = 1 << 18
#: Sources whose table is small enough to be broadcast for sure.
FEW_SOURCES = 10_000


def pfair(weights: dict[str, float], blocks: dict[str, int]) -> Iterator[tuple[str, int]]:
    """(source, index of its block) for each slot until every source has run out, from the exact weights.

    Earliest deadline first among the released, ties by name. Empty slots are skipped.
    """
    exact = {s: Fraction(w) for s, w in weights.items()}
    if min(exact.values()) < 0 or not sum(exact.values()) > 0:
        raise ValueError("weights must not be negative, and one must be positive")
    scale = lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * scale) for s, w in exact.items()}
    total = sum(whole.values())
    waiting = [(0, s, 0) for s, w in whole.items() if w and blocks[s]]
    heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, s, i = heappop(waiting)
            heappush(ready, (-(-(i + 1) * total // whole[s]), s, i))
        due, s, i = heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline was missed")
        yield s, i
        slot += 1
        if i + 1 < blocks[s]:
            heappush(waiting, ((i + 1) * total // whole[s], s, i + 1))
    rest = {s: 1 for s, w in whole.items() if not w and blocks[s]}
    if rest:
        yield from pfair(rest, blocks)


def _schedule(spark: SparkSession, weights: dict[str, float], blocks: dict[str, int]) -> DataFrame:
    """(src, block, slot) of the whole schedule."""
    slots, out, first = pfair(weights, blocks), None, 0
    while part := list(islice(slots, SLICE)):
        sources, turns = zip(*part, strict=True)
        table = pa.table({"src": pa.array(sources, pa.string()), "block": pa.array(turns, pa.int64()), "slot": pa.array(range(first, first + len(part)), pa.int64())})
        one = materialize(spark.createDataFrame(table))
        out, first = one if out is None else out.unionByName(one), first + len(part)
    return out


def _before(df: DataFrame, by: list[str], at: str, value: str, wide: int) -> DataFrame:
    """(by, at, base): sum of `value` over the rows of the group with a smaller `at`, by spans of `wide` values of `at`."""
    far = F.floor(F.col(at) / wide).alias("far")
    ahead = lambda keys, along: Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda keys, along: F.coalesce(F.sum(value).over(ahead(keys, along)), F.lit(0))
    spans = df.groupBy(*by, far).agg(F.sum(value).alias(value))
    spans = spans.select(*by, "far", total(by, "far").alias("more"))
    inside = df.withColumn("far", far).withColumn("lead", total([*by, "far"], at))
    return inside.join(spans, [*by, "far"]).select(*by, at, (F.col("lead") + F.col("more")).alias("base"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, other: float | None = None, period: int = PERIOD, block_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, source_col, block, slot, position): the mixed order of all rows.

    block counts from 0 in its source, slot is its place in the schedule, position numbers the rows in the order of
    (slot, place in the block) without gaps. other: weight of each source that `weights` does not name.
    """
    spark = docs.sparkSession
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")
    # md5, so that SQL elsewhere can say the same
    digest = F.md5(F.concat_ws("|", F.lit("mix"), F.col(id_col).cast("string"), F.col(text_col)))
    rows = materialize(docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("src"), F.col(source_col).alias("named"),
        size.alias("size"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("h"),
    ))
    sizes = {r["src"]: r["w"] for r in rows.groupBy("src").agg(F.sum("size").alias("w")).collect()}
    if not sizes:
        return spark.createDataFrame([], f"{id_col} long, {source_col} string, block long, slot long, position long")
    if weights is None:
        share = {s: float(w) ** 0.5 if other is None else other for s, w in sizes.items()}
    else:
        missing = sorted(s for s in sizes if s not in weights)
        if missing and other is None:
            raise ValueError(f"no weight for {missing[:5]}")
        share = {s: weights.get(s, other) for s in sizes}
    block_bytes = block_bytes or max(BLOCK_BYTES, -(-sum(sizes.values()) // MOST_BLOCKS))
    chunks = spark.createDataFrame([(s, max(1, -(-w // (block_bytes * CHUNK_BLOCKS)))) for s, w in sizes.items()], "src string, chunks long")
    chunks = F.broadcast(chunks) if len(sizes) <= FEW_SOURCES else chunks
    schedule = _schedule(spark, share, {s: -(-w // block_bytes) for s, w in sizes.items()})

    dealt = rows.join(chunks, "src").withColumn("chunk", F.pmod("h", "chunks"))
    order = Window.partitionBy("src", "chunk").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    bases = _before(dealt.groupBy("src", "chunk").agg(F.sum("size").alias("size")), ["src"], "chunk", "size", 1024)
    dealt = dealt.withColumn("lead", F.coalesce(F.sum("size").over(order), F.lit(0))).join(bases, ["src", "chunk"])
    dealt = dealt.withColumn("start", F.col("base") + F.col("lead"))
    dealt = materialize(dealt.select("id", "named", "src", "h", "start", F.floor(F.col("start") / block_bytes).cast("long").alias("block")))
    blocks = materialize(dealt.groupBy("src", "block").agg(F.count(F.lit(1)).alias("n")).join(schedule, ["src", "block"]))
    spans = blocks.withColumn("all", F.lit(0))
    first = _before(spans.groupBy("all", F.floor(F.col("slot") / period).alias("span")).agg(F.sum("n").alias("n")), ["all"], "span", "n", 1024)
    inside = Window.partitionBy("span").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("span", F.floor(F.col("slot") / period)).withColumn("lead", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(first, "span")
    placed = placed.select("src", "block", "slot", (F.col("base") + F.col("lead")).alias("first"))
    rank = Window.partitionBy("src", "block").orderBy("start")
    out = dealt.join(placed, ["src", "block"]).withColumn("position", (F.col("first") + F.row_number().over(rank) - 1).cast("long"))
    discard(rows)
    return out.select(F.col("id").alias(id_col), F.col("named").alias(source_col), "block", "slot", "position")
