"""Sharding by a k-d tree: nodes are cut at weighted medians along their widest metadata dimension.

All dimensions (size, shares of line ends, spaces and bytes past one a character) are read off the text, so equal texts
are one point and stay in one shard. Nodes are cut until leaves reach the target bytes; the nodes of a level are cut
together. The median of a node is found by histograms of the dimension's value, then, among rows with that
value, of a 64-bit hash of the text: each pass counts bytes in at most 2^levels * BINS bins, and only those bins come
to the driver. The tree has 2^levels - 1 nodes and is applied to the rows as one expression: no row is moved to be
placed. Slots are numbered by chunks, so a shard's rows need not meet in one task.

A group of equal texts heavier than a shard's share cannot be cut; its shard is larger by that.

Defined cases. Null text: size 1, as the empty text. A text longer than the target is a shard's alone, or nearly. Null ids are ids like any other. Repeated rows are rows of
their own with their own slots, in one shard. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_within
from ..session import materialize

BINS = 2048
DIMENSIONS = ("log_size", "line_share", "space_share", "wide_share")


def _metadata(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, size, crc, dimensions scaled to 0 .. 2^20, hash as 0 .. 2^31): all of the text alone."""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    x = docs.select(F.col(id_col).alias("id"), raw.alias("t"), (F.octet_length(raw) + 1).cast("long").alias("size"))
    scaled = lambda c: F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * (1 << 20)).cast("long")
    share = lambda c: F.col("size") - F.octet_length(F.replace("t", F.lit(c), F.lit("")))
    return x.select(
        "id", "size", F.crc32(F.col("t").cast("binary")).cast("long").alias("crc"),
        scaled(F.log2(F.col("size").cast("double")) / 40).alias("log_size"),
        scaled(share("\n") / F.col("size") * 8).alias("line_share"),
        scaled(share(" ") / F.col("size") * 2).alias("space_share"),
        scaled((F.col("size") - 1 - F.length("t")) / F.col("size")).alias("wide_share"), F.pmod(F.xxhash64("t"), F.lit(1 << 31)).alias("hash"),
    )


def _medians(rows: DataFrame, value: Column, share: Column, lows: dict[int, int], highs: dict[int, int], goals: dict[int, float], bins: int) -> dict[int, tuple[int, int]]:
    """For each node the value v at which the bytes of rows with value <= v first reach the goal, and the bytes below v."""
    below = dict.fromkeys(lows, 0)
    lows, highs = dict(lows), dict(highs)
    while any(lows[n] < highs[n] for n in lows):
        step = {n: max(1, -(-(highs[n] - lows[n] + 1) // bins)) for n in lows}
        pick = lambda d: F.create_map(*(F.lit(int(z)) for kv in d.items() for z in kv))[F.col("node")]
        inside = rows.withColumn("v", value).filter((F.col("v") >= pick(lows)) & (F.col("v") <= pick(highs)))
        bin_ = F.floor((F.col("v") - pick(lows)) / pick(step)).cast("int")
        got: dict[int, dict[int, int]] = {n: {} for n in lows}
        for r in inside.groupBy("node", bin_.alias("bin")).agg(F.sum(share).alias("w")).collect():
            got[r["node"]][r["bin"]] = int(r["w"])
        for n in lows:
            chosen = max(got[n], default=0)
            for b in sorted(got[n]):
                if below[n] + got[n][b] >= goals[n]:
                    chosen = b
                    break
                below[n] += got[n][b]
            first = lows[n] + chosen * step[n]
            lows[n], highs[n] = first, min(highs[n], first + step[n] - 1)
    return {n: (lows[n], below[n]) for n in lows}


def kd_tree(rows: DataFrame, levels: int, dimensions: tuple[str, ...] = DIMENSIONS, bins: int = BINS) -> dict[int, tuple[str, int, int]]:
    """Inner nodes, numbered as in a heap from 1: (dimension, value, hash): rows at most (value, hash) go left."""
    tree: dict[int, tuple[str, int, int]] = {}
    whole = rows.agg(*(F.min(d).alias(f"lo_{d}") for d in dimensions), *(F.max(d).alias(f"hi_{d}") for d in dimensions)).collect()[0]
    if whole[f"lo_{dimensions[0]}"] is None:
        return tree
    for level in range(levels):
        at = rows.withColumn("node", node_of(tree, level))
        stats = at.groupBy("node").agg(F.sum("size").alias("w"), *(F.min(d).alias(f"lo_{d}") for d in dimensions), *(F.max(d).alias(f"hi_{d}") for d in dimensions)).collect()
        wide, lows, highs, goals = {}, {}, {}, {}
        for s in stats:
            spread = lambda d, s=s: (s[f"hi_{d}"] - s[f"lo_{d}"]) / max(1, whole[f"hi_{d}"] - whole[f"lo_{d}"])
            n = s["node"]
            wide[n] = max(dimensions, key=spread)
            lows[n], highs[n], goals[n] = s[f"lo_{wide[n]}"], s[f"hi_{wide[n]}"], s["w"] / 2
        value = F.coalesce(*(F.when(F.col("node").isin([n for n in wide if wide[n] == d]), F.col(d)) for d in dimensions))
        cut = _medians(at, value, F.col("size"), lows, highs, goals, bins)
        ties = at.filter(value == F.create_map(*(F.lit(int(z)) for n in cut for z in (n, cut[n][0])))[F.col("node")])
        rest = {n: goals[n] - cut[n][1] for n in cut}
        fine = _medians(ties, F.col("hash"), F.col("size"), dict.fromkeys(cut, 0), dict.fromkeys(cut, (1 << 31) - 1), rest, bins)
        heavy = {(r["node"]): r["w"] for r in ties.filter(F.col("hash") == F.create_map(*(F.lit(int(z)) for n in fine for z in (n, fine[n][0])))[F.col("node")]).groupBy("node").agg(F.sum("size").alias("w")).collect()}
        for n in cut:
            # the point at the median goes to the side that comes nearer to the half
            left = fine[n][1] + heavy.get(n, 0) <= 2 * rest[n] - fine[n][1]
            tree[n] = (wide[n], cut[n][0], fine[n][0] if left else fine[n][0] - 1)
    return tree


def node_of(tree: dict[int, tuple[str, int, int]], level: int) -> Column:
    """The node of a row after `level` cuts, as one nested expression; a node that was never cut goes left."""

    def below(n: int, deep: int) -> Column:
        if not deep:
            return F.lit(n)
        if n not in tree:
            return below(2 * n, deep - 1)
        d, v, h = tree[n]
        left = (F.col(d) < v) | ((F.col(d) == v) & (F.col("hash") <= h))
        return F.when(left, below(2 * n, deep - 1)).otherwise(below(2 * n + 1, deep - 1))

    return below(1, level)


def kd_shards(docs: DataFrame, target_bytes: int | None = None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, shard, slot): shards of nearly equal bytes, at most about target_bytes each (or as
    many as `shards`, a power of two, which sets the target); slots count from 0 in each.
    """
    if (target_bytes is None) == (shards is None):
        raise ValueError("give target_bytes or shards")
    rows = materialize(_metadata(docs, id_col, text_col))
    total = rows.agg(F.sum("size")).collect()[0][0] or 0
    target = target_bytes or -(-total // shards)
    levels = 0
    while total > target << levels:
        levels += 1
    tree = kd_tree(rows, levels)
    placed = rows.select("id", "size", "crc", "hash", (node_of(tree, levels) - (1 << levels)).cast("int").alias("shard"))
    slots = number_within(placed, ["shard"], ["id", "hash", "size"], "slot")
    return slots.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")
