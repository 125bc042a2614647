"""Measures of operations given as points (op_index, k, x, y): turning, axes, resampling, gaps, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geom import point_segment_squared
from .linetypes import segments


def turning(points: DataFrame) -> DataFrame:
    """(op_index, turn): sum of the angles between consecutive segments, each from 0 to pi."""
    s = segments(points, ("op_index",)).withColumn("t", F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")))
    d = F.abs(F.col("t") - F.lag("t").over(Window.partitionBy("op_index").orderBy("k")))
    return s.withColumn("d", d).groupBy("op_index").agg(F.sum(F.least("d", 2 * F.pi() - F.col("d"))).alias("turn"))


def principal_axis(points: DataFrame) -> DataFrame:
    """(op_index, axis): direction of the greatest spread, from -pi/2 to pi/2."""
    axis = F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y")) / 2
    return points.groupBy("op_index").agg(axis.alias("axis"))


def resample(points: DataFrame, n: int) -> DataFrame:
    """(op_index, j, x, y): n points at equal steps along the polyline, its ends included; segments without length are passed over."""
    s = segments(points, ("op_index",))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    w = Window.partitionBy("op_index")
    s = s.withColumn("len", F.sqrt(dx * dx + dy * dy))
    s = s.withColumn("upto", F.sum("len").over(w.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) - F.col("len")).withColumn("total", F.sum("len").over(w))
    # an operation has a bounded number of segments: each step looks among its own
    t = s.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("at", F.col("total") * F.col("j") / (n - 1)).filter("upto <= at or k = 0")
    last = t.groupBy("op_index", "j").agg(F.max_by(F.struct("ax", "ay", "bx", "by", "upto", "len", "at"), "k").alias("s")).select("op_index", "j", "s.*")
    share = F.when(F.col("len") > 0, F.least(F.lit(1.0), (F.col("at") - F.col("upto")) / F.col("len"))).otherwise(0.0)
    return last.select("op_index", "j", (F.col("ax") + (F.col("bx") - F.col("ax")) * share).alias("x"), (F.col("ay") + (F.col("by") - F.col("ay")) * share).alias("y"))


def contour_gap(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """(op_index, other, gap, diagonal): least distance between the points of each pair, and the first one's diagonal."""
    p = points.select("op_index", F.col("x").alias("px"), F.col("y").alias("py"))
    q = points.select(F.col("op_index").alias("other"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    dx, dy = F.col("px") - F.col("qx"), F.col("py") - F.col("qy")
    gap = pairs.join(p, "op_index").join(q, "other").groupBy("op_index", "other").agg(F.min(F.sqrt(dx * dx + dy * dy)).alias("gap"))
    w, h = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    return gap.join(points.groupBy("op_index").agg(F.sqrt(w * w + h * h).alias("diagonal")), "op_index")


def segment_alignment(points: DataFrame) -> DataFrame:
    """(op_index, other, distance, dot): of each operation and the next of its group (grp) the closest segments, by their ends;
    dot: the cosine between these two. Ties go to the lower segments.
    """
    nxt = F.lead("op_index").over(Window.partitionBy("grp").orderBy("op_index"))
    pairs = points.select("grp", "op_index").distinct().withColumn("other", nxt).filter("other is not null").select("op_index", "other")
    s = segments(points, ("op_index",))
    named = lambda n, key: s.select(F.col("op_index").alias(key), F.col("k").alias(f"{n}k"), *(F.col(c).alias(n + c) for c in ("ax", "ay", "bx", "by")))
    x = pairs.join(named("a", "op_index"), "op_index").join(named("b", "other"), "other")
    ends = lambda n: [(F.col(f"{n}ax"), F.col(f"{n}ay")), (F.col(f"{n}bx"), F.col(f"{n}by"))]
    off = [point_segment_squared(*p, *to[0], *to[1]) for own, to in ((ends("a"), ends("b")), (ends("b"), ends("a"))) for p in own]
    (ux, uy), (vx, vy) = ((F.col(f"{n}bx") - F.col(f"{n}ax"), F.col(f"{n}by") - F.col(f"{n}ay")) for n in "ab")
    dot = F.abs((ux * vx + uy * vy) / (F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)))
    x = x.select("op_index", "other", F.least(*off).alias("d2"), dot.alias("dot"), "ak", "bk")
    return x.groupBy("op_index", "other").agg(F.sqrt(F.min("d2")).alias("distance"), F.min_by("dot", F.struct(F.round("d2", 12), "ak", "bk")).alias("dot"))
