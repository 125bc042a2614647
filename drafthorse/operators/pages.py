"""Operators on page text and symbols: judge, cover, union, snap, owners, duplicates, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom, text
from ..functions.geom import Box
from .spatial import argmin_join, box_join

COVER_GAP = 5.0
TWIN_GAP = 15.0
TWIN_IOU = 0.45
GROUP_TOL = 2.0
WORD_SHARE = 0.6
HIGH_OVERLAP = 0.5


def judge_candidates(lines: DataFrame, keyword: str = text.KEYWORD) -> DataFrame:
    """(norm, first, n): distinct normalized strings of 3 to 400 characters with a letter, not caught by the keyword."""
    norm = text.norm_text(F.col("line"))
    x = lines.select("page", "pos", "line", norm.alias("norm")).filter(F.length("norm").between(3, 400) & F.col("norm").rlike("[A-Z]") & ~F.col("line").rlike(keyword))
    return x.groupBy("norm").agg(F.min_by("line", F.struct("page", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))


def select_instances(lines: DataFrame, verdicts: DataFrame, keyword: str = text.KEYWORD) -> DataFrame:
    """Lines that the keyword catches or whose normalized text has a true verdict (norm, flagged)."""
    flagged = verdicts.filter("flagged").select("norm").distinct().withColumn("hit", F.lit(True))
    x = lines.withColumn("norm", text.norm_text(F.col("line"))).join(flagged, "norm", "left")
    return x.filter(F.col("line").rlike(keyword) | F.coalesce("hit", F.lit(False))).drop("hit", "norm")


def cover_split(lines: DataFrame, detections: DataFrame, key: str = "pos", tol: float = COVER_GAP) -> DataFrame:
    """Every line once, with covered: some valid detection of the page comes within tol."""
    valid = detections.filter(geom.valid(Box()))
    hit = box_join(lines.select("page", key, "y0", "x0", "y1", "x1"), valid, tol).select("page", F.col(f"l_{key}").alias(key)).distinct().withColumn("hit", F.lit(True))
    return lines.join(hit, ["page", key], "left").withColumn("covered", F.coalesce("hit", F.lit(False))).drop("hit")


def union_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """first and those rows of second that no row of first doubles: IoU over 0.45, or the same text within 15."""
    l, r = Box("l"), Box("r")
    same = (F.col("l_tok") == F.col("r_tok")) & (F.col("l_tok") != "")
    twin = (geom.iou(l, r) > TWIN_IOU) | same
    cols = ["page", "tok", "y0", "x0", "y1", "x1"]
    kept = box_join(second.select(cols), first.select(cols), TWIN_GAP, twin, how="left_anti")
    return first.select(*cols, F.lit("first").alias("run")).unionByName(kept.select(*cols, F.lit("second").alias("run")))


def snap_to_lines(items: DataFrame, lines: DataFrame, key: str = "idx", line_key: str = "pos") -> DataFrame:
    """Items' boxes as the union of the lines whose centre lies in them (2 around) and most of whose words they have.

    A line counts if at least 60 % of its word occurrences are among the item's words. An item without such a line,
    or whose union is not valid, keeps its box.
    """
    # boxes meet first; words are worked out once a text and go to the pairs that are left
    box = ["page", "y0", "x0", "y1", "x1"]
    pairs = box_join(items.select(*box, key), lines.select(*box, line_key), GROUP_TOL, geom.holds_center(Box("l"), Box("r"), GROUP_TOL))
    a = items.select("page", F.col(key).alias(f"l_{key}"), text.words(F.col("text")).alias("l_words"))
    b = lines.select("page", F.col(line_key).alias(f"r_{line_key}"), text.words(F.col("line")).alias("r_words")).filter(F.size("r_words") > 0)
    pairs = pairs.join(a, ["page", f"l_{key}"]).join(b, ["page", f"r_{line_key}"])
    # words that the item lacks, found by hashing: a line of its own has none, and is not gone through word by word
    pairs = pairs.withColumn("lacks", F.array_except("r_words", "l_words"))
    held = F.size("r_words") - F.size(F.filter("r_words", lambda w: F.array_contains("lacks", w)))
    pairs = pairs.filter((F.size("lacks") == 0) | (held >= WORD_SHARE * F.size("r_words")))
    union = pairs.groupBy("page", F.col(f"l_{key}").alias(key)).agg(F.min("r_y0").alias("ny0"), F.min("r_x0").alias("nx0"), F.max("r_y1").alias("ny1"), F.max("r_x1").alias("nx1"))
    x = items.join(union, ["page", key], "left")
    ok = F.col("ny0").isNotNull() & (F.col("ny0") < F.col("ny1")) & (F.col("nx0") < F.col("nx1")) & (F.col("ny0") >= 0) & (F.col("nx0") >= 0) & (F.col("ny1") <= 1000) & (F.col("nx1") <= 1000)
    pick = [F.when(ok, F.col(f"n{c}")).otherwise(F.col(c)).alias(c) for c in ("y0", "x0", "y1", "x1")]
    return x.select("page", key, *pick, ok.alias("snapped"))


def smallest_group(items: DataFrame, groups: DataFrame, key: str = "idx", tol: float = GROUP_TOL) -> DataFrame:
    """(page, key, group_index): the smallest group that holds the item's centre; equal areas: the lower index."""
    pairs = box_join(items.select("page", key, "y0", "x0", "y1", "x1"), groups, tol, geom.holds_center(Box("r"), Box("l"), tol), cell=250.0)
    best = argmin_join(pairs, ["page", f"l_{key}"], [geom.area(Box("r")), F.col("r_group_index")])
    return best.select("page", F.col(f"l_{key}").alias(key), F.col("r_group_index").alias("group_index"), F.col("r_kind").alias("kind"))


def containing_kinds(items: DataFrame, groups: DataFrame, key: str = "idx", tol: float = GROUP_TOL) -> DataFrame:
    """(page, key, kinds): kinds of all groups that hold the centre, in group order, each once."""
    pairs = box_join(items.select("page", key, "y0", "x0", "y1", "x1"), groups, tol, geom.holds_center(Box("r"), Box("l"), tol), cell=250.0)
    order = F.array_sort(F.collect_list(F.struct("r_group_index", "r_kind")))
    return pairs.groupBy("page", F.col(f"l_{key}").alias(key)).agg(F.array_distinct(F.transform(order, lambda s: s["r_kind"])).alias("kinds"))


def owners(symbols: DataFrame, items: DataFrame) -> DataFrame:
    """Symbols with the text and box of the item they name; a negative or unknown index has none."""
    own = items.select("page", F.col("idx").alias("owner"), F.col("text").alias("owner_text"), *(F.col(c).alias(f"o_{c}") for c in ("y0", "x0", "y1", "x1")))
    return symbols.withColumn("owner", F.when(F.col("text_index") >= 0, F.col("text_index"))).join(own, ["page", "owner"], "left")


def dedupe_symbols(symbols: DataFrame, items: DataFrame) -> DataFrame:
    """All symbols with kept and, for the others, a reason: one symbol of each rounded box stays.

    Best is one whose owner's text does not fill its box, then the longest owner text, the lower text index, order.
    """
    x = owners(symbols, items)
    share = geom.overlap_of_smaller(Box(), Box("o"))
    high = F.coalesce((share > HIGH_OVERLAP).cast("int"), F.lit(0))
    key = [F.bround(c, 0).cast("long") for c in Box().all]
    rank = Window.partitionBy("page", *key).orderBy(high, -F.length(F.coalesce("owner_text", F.lit(""))), F.coalesce("owner", F.lit(1 << 30)), "symbol_index")
    x = x.withColumn("rank", F.row_number().over(rank)).withColumn("winner", F.first("symbol_index").over(rank))
    reason = F.when(F.col("rank") > 1, F.concat(F.lit("same box as symbol "), F.col("winner").cast("string")))
    return x.select("page", "symbol_index", "text_index", (F.col("rank") == 1).alias("kept"), reason.alias("reason"))


def group_verdict(symbols: DataFrame, items: DataFrame, groups: DataFrame, allowed: tuple[str, ...] = ("legend", "schedule", "note_cluster")) -> DataFrame:
    """(page, symbol_index, ok, reason): the symbol's own group decides; without one, its owner's."""
    own = smallest_group(symbols, groups, "symbol_index").select("page", "symbol_index", F.col("kind").alias("own"))
    item = smallest_group(items, groups).select("page", F.col("idx").alias("text_index"), F.col("kind").alias("item"))
    x = symbols.join(own, ["page", "symbol_index"], "left").join(item, ["page", "text_index"], "left")
    kind = F.coalesce("own", "item")
    ok = F.coalesce(kind.isin(*allowed), F.lit(False))
    reason = F.when(ok, F.when(F.col("own").isNotNull(), "own group").otherwise("owner's group")).when(kind.isNull(), "no group").otherwise(F.concat(F.lit("in "), kind))
    return x.select("page", "symbol_index", ok.alias("ok"), reason.alias("reason"))


def in_any(points: DataFrame, boxes: DataFrame, tol: float, whole: bool = False, how: str = "left_semi") -> DataFrame:
    """Rows whose centre (whole: whose whole box) lies in a box of the page."""
    test = geom.contains(Box("r"), Box("l"), tol) if whole else geom.holds_center(Box("r"), Box("l"), tol)
    return box_join(points, boxes.select("page", "y0", "x0", "y1", "x1"), max(tol, 0.0), test, cell=250.0, how=how)


def table_columns(lines: DataFrame, need: int = 2, key: str = "pos") -> DataFrame:
    """(page, key) of boxes with at least `need` others whose left edges are within 4, on clearly other rows."""
    cols = lines.select("page", key, "y0", "x0", "y1", "x1")
    a = cols.select("page", *(F.col(c).alias(f"a_{c}") for c in (key, "y0", "x0", "y1", "x1")), F.floor(F.col("x0") / 4).alias("c"))
    a = a.withColumn("cell", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)))
    b = cols.select("page", *(F.col(c).alias(f"b_{c}") for c in (key, "y0", "x0", "y1", "x1")), F.floor(F.col("x0") / 4).alias("cell"))
    h = F.greatest(F.col("a_y1") - F.col("a_y0"), F.lit(2.0)) * 1.2
    apart = (F.col("b_y1") < F.col("a_y0") - h) | (F.col("b_y0") > F.col("a_y1") + h)
    pairs = a.join(b, ["page", "cell"]).filter((F.abs(F.col("a_x0") - F.col("b_x0")) <= 4.0) & apart)
    return pairs.groupBy("page", F.col(f"a_{key}").alias(key)).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= need).select("page", key)


def when_first(*cases: tuple[Column, str], otherwise: str) -> Column:
    out = None
    for test, name in cases:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(otherwise)
