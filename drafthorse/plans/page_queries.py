"""Filters and joins on pages: text lines, detections, groups, symbols."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geom, text
from ..functions.geom import Box
from ..operators import pages
from ..operators.spatial import argmin_join, box_join
from .registry import AREA, GAP, MEET, NORM, UPPER, VALID, holds, query

KEYWORD = "(?i)licen|apache[ -]?link"


@query("f01_box_valid", f"select page, src_pos, {VALID.format(a='d')} as ok from detections d", ("detections",))
def f01(v):
    return v.detections.select("page", "src_pos", geom.valid(Box()).alias("ok"))


@query("f02_coerce_int", f"""
with c as (select page, pos, cast(trunc(y0) as int) as y0, cast(trunc(x0) as int) as x0, cast(trunc(y1) as int) as y1, cast(trunc(x1) as int) as x1 from boxes)
select page, pos, y0, x0, y1, x1 from c where {VALID.format(a='c')}""", ("boxes",))
def f02(v):
    x = v.boxes.select("page", "pos", *(F.col(c).cast("int").alias(c) for c in ("y0", "x0", "y1", "x1")))
    return x.filter((F.col("y0") >= 0) & (F.col("x0") >= 0) & (F.col("y1") <= 1000) & (F.col("x1") <= 1000) & (F.col("y0") < F.col("y1")) & (F.col("x0") < F.col("x1")))


@query("f03_loose_box", "select page, count(*) as n, count(case when isfinite(y0) and isfinite(x0) and isfinite(y1) and isfinite(x1) then 1 end) as finite from detections group by page", ("detections",))
def f03(v):
    finite = None
    for c in ("y0", "x0", "y1", "x1"):
        ok = ~F.isnan(c) & (F.abs(c) < float("inf"))
        finite = ok if finite is None else finite & ok
    return v.detections.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(finite, 1)).alias("finite"))


@query("f04_px_to_page", "select page, pos, round_even(x1 / cast(2384 as double) * 1000, 1) as x1_pf from boxes", ("boxes",))
def f04(v):
    return v.boxes.select("page", "pos", geom.px_to_page(F.col("x1"), F.lit(2384.0)).alias("x1_pf"))


@query("f05_crop_frames", """
select d.page, d.src_pos, g.y0 + d.y0 / 1000 * (g.y1 - g.y0) as page_y0, least(1000, greatest(0, (d.y0 - g.y0) / (g.y1 - g.y0) * 1000)) as crop_y0
from detections d join groups g on d.page = g.page where g.kind = 'schedule'""", ("detections", "groups"))
def f05(v):
    g = v.groups.filter("kind = 'schedule'").select("page", F.col("y0").alias("lo"), F.col("y1").alias("hi"))
    x = v.detections.join(g, "page")
    return x.select("page", "src_pos", geom.crop_to_page(F.col("y0"), F.col("lo"), F.col("hi")).alias("page_y0"), geom.page_to_crop(F.col("y0"), F.col("lo"), F.col("hi")).alias("crop_y0"))


@query("f06_grow_degenerate", """
select page, pos, cast(round_even(y0, 0) as int) as y0, cast(case when round_even(y1, 0) > round_even(y0, 0) then round_even(y1, 0) else round_even(y0, 0) + 1 end as int) as y1 from boxes""", ("boxes",))
def f06(v):
    lo, hi = F.bround("y0", 0), F.bround("y1", 0)
    return v.boxes.select("page", "pos", lo.cast("int").alias("y0"), F.when(hi > lo, hi).otherwise(lo + 1).cast("int").alias("y1"))


@query("f07_keyword_floor", f"select page, pos, line from lines where regexp_matches(line, '{KEYWORD}')", ("lines",))
def f07(v):
    return v.lines.filter(F.col("line").rlike(KEYWORD)).select("page", "pos", "line")


@query("f08_judge_candidates", f"""
with c as (select page, pos, line, {NORM.format(c='line')} as norm from lines)
select norm, arg_min(line, page * 1000000 + pos) as first, count(*) as n from c
where length(norm) between 3 and 400 and regexp_matches(norm, '[A-Z]') and not regexp_matches(line, '{KEYWORD}') group by norm""", ("lines",))
def f08(v):
    return pages.judge_candidates(v.lines, KEYWORD)


@query("f09_select_instances", f"""
with c as (select page, pos, line, {NORM.format(c='line')} as norm from lines), verdicts as (select distinct norm from c where length(norm) % 7 = 0)
select page, pos, line from c where regexp_matches(line, '{KEYWORD}') or norm in (select norm from verdicts)""", ("lines",))
def f09(v):
    norm = text.norm_text(F.col("line"))
    verdicts = v.lines.select(norm.alias("norm")).distinct().select("norm", (F.length("norm") % 7 == 0).alias("flagged"))
    return pages.select_instances(v.lines, verdicts, KEYWORD).select("page", "pos", "line")


@query("f10_flagged_verdicts", f"""
with c as (select distinct {NORM.format(c='line')} as norm from lines) select norm from c where length(norm) % 7 = 0""", ("lines",))
def f10(v):
    norm = v.lines.select(text.norm_text(F.col("line")).alias("norm")).distinct()
    return norm.withColumn("flagged", F.length("norm") % 7 == 0).filter("flagged").select("norm")


@query("f12_marker_shapes", f"""
with w as (select page, unnest(regexp_extract_all({UPPER.format(c='text')}, '([A-Z0-9]+)', 1)) as w from items)
select w, count(*) as n, regexp_matches(w, '{text.CODE}') as code, regexp_matches(w, '{text.TOKEN}') as token, regexp_matches(w, '{text.MARKER_SHAPE}') as marker from w group by w""", ("items",))
def f12(v):
    w = v.items.select(F.explode(text.words(F.col("text"))).alias("w"))
    m = lambda p: F.col("w").rlike(p)
    return w.groupBy("w").agg(F.count(F.lit(1)).alias("n")).select("w", "n", m(text.CODE).alias("code"), m(text.TOKEN).alias("token"), m(text.MARKER_SHAPE).alias("marker"))


@query("f13_needs_scan", f"""
with t as (select doc_id as page, coalesce(length(text), 0) as size, n_chars from documents), i as (select distinct page from lines where regexp_matches(line, '{KEYWORD}')), known as (select distinct page from symbols)
select t.page, not (t.size = t.n_chars and t.n_chars % 2 = 0) and (t.page % 17 = 0 or t.size = 0 or i.page is not null or known.page is not null) as needs_scan
from t left join i using (page) left join known using (page)""", ("lines", "symbols"))
def f13(v):
    t = v.table("documents").select(F.col("doc_id").alias("page"), F.coalesce(F.length("text"), F.lit(0)).alias("size"), "n_chars")
    flag = lambda df, n: df.select("page").distinct().withColumn(n, F.lit(True))
    x = t.join(flag(v.lines.filter(F.col("line").rlike(KEYWORD)), "i"), "page", "left").join(flag(v.symbols, "known"), "page", "left")
    current = (F.col("size") == F.col("n_chars")) & (F.col("n_chars") % 2 == 0)
    return x.select("page", (~current & ((F.col("page") % 17 == 0) | (F.col("size") == 0) | F.coalesce("i", F.lit(False)) | F.coalesce("known", F.lit(False)))).alias("needs_scan"))


@query("f14_anchor_eligible", f"""
select page, idx, label from (select page, idx, text, case idx % 4 when 0 then 'note' when 1 then 'callout' when 2 then 'legend entry' else 'text' end as label from items)
where label not in ('view title', 'note', 'legend entry') and (label = 'callout' or not regexp_matches(text, '{text.TITLE}'))""", ("items",))
def f14(v):
    label = F.when(F.col("idx") % 4 == 0, "note").when(F.col("idx") % 4 == 1, "callout").when(F.col("idx") % 4 == 2, "legend entry").otherwise("text")
    x = v.items.withColumn("label", label).filter(~F.col("label").isin(*text.REJECTED_LABELS))
    return x.filter((F.col("label") == "callout") | ~F.col("text").rlike(text.TITLE)).select("page", "idx", "label")


@query("f15_gate_scope", f"""
with t as (select p_partkey, p_name || case p_partkey % 3 when 0 then ' gate' when 1 then ' fence & gates' else ' fencing' end as name from part)
select p_partkey, name, regexp_matches(name, '{text.GATE}') and not regexp_matches(name, '{text.FENCE}') as is_gate from t""")
def f15(v):
    tail = F.when(F.col("p_partkey") % 3 == 0, " gate").when(F.col("p_partkey") % 3 == 1, " fence & gates").otherwise(" fencing")
    return v.table("part").select("p_partkey", F.concat("p_name", tail).alias("name")).withColumn("is_gate", text.is_gate(F.col("name")))


_PLAN = "select g.page, g.y0, g.x0, g.y1, g.x1 from groups g join view_types t on g.page = t.page and g.group_index = t.group_index where t.view_type = 'plan'"


def plan_boxes(v):
    return v.groups.join(v.view_types.filter("view_type = 'plan'").select("page", "group_index"), ["page", "group_index"]).select("page", "y0", "x0", "y1", "x1")


@query("f16_plan_gate", f"with plan as ({_PLAN}) select s.page, s.symbol_index from symbols s where exists (select 1 from plan p where p.page = s.page and {holds('p', 's', 2)})", ("symbols", "groups", "view_types"))
def f16(v):
    return pages.in_any(v.symbols, plan_boxes(v), 2.0).select("page", "symbol_index")


@query("f17_inside_any", "select i.page, i.idx from items i where exists (select 1 from groups g where g.page = i.page and g.kind = 'legend' and i.y0 >= g.y0 and i.x0 >= g.x0 and i.y1 <= g.y1 and i.x1 <= g.x1)", ("items", "groups"))
def f17(v):
    return pages.in_any(v.items, v.groups.filter("kind = 'legend'"), 0.0, whole=True).select("page", "idx")


@query("f18_page_kind", """
with a as (select d.doc_id as page, count(x.src_pos) as paths, coalesce(max((x.y1 - x.y0) * (x.x1 - x.x0)), 0) / 1000000 as largest, least(1, coalesce(sum((x.y1 - x.y0) * (x.x1 - x.x0)), 0) / 1000000) as total
  from documents d left join detections x on d.doc_id = x.page group by d.doc_id)
select page, paths, case when paths < 3 and (largest >= 0.45 or total >= 0.002) then 'image-only' else 'vector' end as kind from a""", ("detections",))
def f18(v):
    size = geom.area(Box()) / 1e6
    a = v.detections.groupBy("page").agg(F.count(F.lit(1)).alias("paths"), F.max(size).alias("largest"), F.sum(size).alias("total"))
    x = v.table("documents").select(F.col("doc_id").alias("page")).join(a, "page", "left").fillna(0, ["paths", "largest", "total"])
    image = (F.col("paths") < 3) & ((F.col("largest") >= 0.45) | (F.least(F.lit(1.0), "total") >= 0.002))
    return x.select("page", "paths", F.when(image, "image-only").otherwise("vector").alias("kind"))


@query("f19_dropped_reasons", f"""
select page, src_pos, case when y0 < 0 or x0 < 0 then 'before the frame' when y1 > 1000 or x1 > 1000 then 'beyond the frame' else 'empty' end as reason from detections d where not {VALID.format(a='d')}""", ("detections",))
def f19(v):
    reason = pages.when_first(((F.col("y0") < 0) | (F.col("x0") < 0), "before the frame"), ((F.col("y1") > 1000) | (F.col("x1") > 1000), "beyond the frame"), otherwise="empty")
    return v.detections.select("page", "src_pos", F.when(~geom.valid(Box()), reason).alias("reason")).filter("reason is not null")


@query("f20_publish_rows", "select page, symbol_index, category, claimed_group_index as group_index, coalesce(nullif(case when category = 'line' then 'sweep' else '' end, ''), 'page') as source from symbols", ("symbols",))
def f20(v):
    source = F.coalesce(F.nullif(F.when(F.col("category") == "line", "sweep").otherwise(""), F.lit("")), F.lit("page"))
    return v.symbols.withColumnRenamed("claimed_group_index", "group_index").select("page", "symbol_index", "category", "group_index", source.alias("source"))


@query("j01_box_pairs", f"select a.page, a.pos, b.src_pos from boxes a join detections b on a.page = b.page and {GAP.format(a='a', b='b')} <= 5", ("boxes", "detections"))
def j01(v):
    return box_join(v.boxes.select("page", "pos", "y0", "x0", "y1", "x1"), v.detections, 5.0).select("page", F.col("l_pos").alias("pos"), F.col("r_src_pos").alias("src_pos"))


@query("j02_zero_miss_split", f"""
select b.page, b.pos, b.line, exists (select 1 from detections d where d.page = b.page and {VALID.format(a='d')} and {GAP.format(a='b', b='d')} <= 5) as covered from boxes b where length(b.line) % 2 = 0 or regexp_matches(b.line, '{KEYWORD}')""", ("boxes", "detections"))
def j02(v):
    flagged = v.boxes.filter((F.length("line") % 2 == 0) | F.col("line").rlike(KEYWORD))
    return pages.cover_split(flagged, v.detections).select("page", "pos", "line", "covered")


@query("j02_backed_detections", f"select d.page, d.src_pos from detections d where exists (select 1 from boxes b where d.page = b.page and {GAP.format(a='b', b='d')} <= 5)", ("boxes", "detections"))
def j02b(v):
    return box_join(v.detections, v.boxes.select("page", "y0", "x0", "y1", "x1"), 5.0, how="left_semi").select("page", "src_pos")


@query("j03_union_runs", f"""
with kept as (select b.* from run_b b where not exists (select 1 from run_a a where a.page = b.page and {GAP.format(a='a', b='b')} <= 15
  and (({MEET.format(a='a', b='b')}) / ({AREA.format(a='a')} + {AREA.format(a='b')} - {MEET.format(a='a', b='b')}) > 0.45 or (a.tok = b.tok and a.tok <> ''))))
select page, tok, y0, x0, y1, x1, 'first' as run from run_a union all select page, tok, y0, x0, y1, x1, 'second' as run from kept""", ("run_a", "run_b"))
def j03(v):
    return pages.union_runs(v.run_a, v.run_b)


@query("j04_snap_to_lines", f"""
with a as (select page, idx, y0, x0, y1, x1, regexp_extract_all({UPPER.format(c='text')}, '([A-Z0-9]+)', 1) as w from items),
b as (select page, pos, y0, x0, y1, x1, regexp_extract_all({UPPER.format(c='line')}, '([A-Z0-9]+)', 1) as w from boxes),
bw as (select page, pos, unnest(w) as w from b),
p as (select a.page, a.idx, b.pos, b.y0, b.x0, b.y1, b.x1, len(b.w) as n from a join b on a.page = b.page and len(b.w) > 0 and {holds('a', 'b', 2)}),
s as (select p.page, p.idx, p.pos, count(*) as hit from p join bw on p.page = bw.page and p.pos = bw.pos join a on a.page = p.page and a.idx = p.idx and list_contains(a.w, bw.w) group by 1, 2, 3),
u as (select p.page, p.idx, min(y0) as ny0, min(x0) as nx0, max(y1) as ny1, max(x1) as nx1 from p join s using (page, idx, pos) where s.hit >= 0.6 * p.n group by 1, 2),
j as (select i.*, u.ny0, u.nx0, u.ny1, u.nx1, u.ny0 is not null and u.ny0 < u.ny1 and u.nx0 < u.nx1 and u.ny0 >= 0 and u.nx0 >= 0 and u.ny1 <= 1000 and u.nx1 <= 1000 as ok from items i left join u using (page, idx))
select page, idx, case when ok then ny0 else y0 end as y0, case when ok then nx0 else x0 end as x0, case when ok then ny1 else y1 end as y1, case when ok then nx1 else x1 end as x1, ok as snapped from j""", ("items", "boxes"))
def j04(v):
    return pages.snap_to_lines(v.items, v.boxes)


_SMALLEST = f"""select page, {{k}}, group_index, kind from (select i.page, i.{{k}}, g.group_index, g.kind, row_number() over (partition by i.page, i.{{k}} order by {AREA.format(a='g')}, g.group_index) as rk
  from {{t}} i join groups g on i.page = g.page and {holds('g', 'i', 2)}) where rk = 1"""


@query("j05_smallest_group", _SMALLEST.format(k="idx", t="items"), ("items", "groups"))
def j05(v):
    return pages.smallest_group(v.items, v.groups)


@query("j06_containing_kinds", f"""
select page, idx, array_to_string(list(kind order by gi), ',') as kinds from (select i.page, i.idx, g.kind, min(g.group_index) as gi from items i join groups g on i.page = g.page and {holds('g', 'i', 2)} group by 1, 2, 3) group by 1, 2""", ("items", "groups"))
def j06(v):
    return pages.containing_kinds(v.items, v.groups).withColumn("kinds", F.array_join("kinds", ","))


@query("j07_owner_lookup", "select s.page, s.symbol_index, i.text as owner_text from (select *, case when symbol_index % 9 = 8 then -1 else text_index end as ti from symbols) s left join items i on s.page = i.page and s.ti = i.idx", ("symbols", "items"))
def j07(v):
    s = v.symbols.withColumn("text_index", F.when(F.col("symbol_index") % 9 == 8, -1).otherwise(F.col("text_index")))
    return pages.owners(s, v.items).select("page", "symbol_index", "owner_text")


@query("j08_view_types", "select g.page, g.group_index, g.kind, t.view_type from groups g left join view_types t on g.page = t.page and g.group_index = t.group_index and g.kind = 'view'", ("groups", "view_types"))
def j08(v):
    t = v.view_types.withColumn("kind", F.lit("view"))
    return v.groups.join(t, ["page", "group_index", "kind"], "left").select("page", "group_index", "kind", "view_type")


@query("j09_inherited_row_codes", """
with c as (select page, idx, y0, x0, y1, x1, idx // 4 + 1 as major, idx % 4 as minor from items),
near as (select ch.page, ch.idx as child, pa.idx as parent, ch.y0 - pa.y0 as d from c ch join c pa on ch.page = pa.page and ch.minor > 0 and pa.minor = 0 and ch.major = pa.major and ch.y0 > pa.y0 and ch.y0 - pa.y0 <= 300 and abs(ch.x0 - pa.x0) <= 60
  where not exists (select 1 from c h where h.page = pa.page and h.minor = 0 and h.y0 > pa.y0 and h.y0 <= ch.y0)),
best as (select page, child, parent, row_number() over (partition by page, child order by d, parent) as rk from near)
select page, child, parent from best where rk = 1""", ("items",))
def j09(v):
    c = v.items.select("page", "idx", "y0", "x0", (F.floor(F.col("idx") / 4) + 1).alias("major"), (F.col("idx") % 4).alias("minor"))
    heads = c.filter("minor = 0")
    last = F.max(F.when(F.col("minor") == 0, F.col("y0"))).over(Window.partitionBy("page").orderBy("y0").rangeBetween(Window.unboundedPreceding, 0))
    child = c.withColumn("last", last).filter("minor > 0").select("page", F.col("idx").alias("child"), "major", F.col("y0").alias("cy"), F.col("x0").alias("cx"), "last")
    p = heads.select("page", F.col("idx").alias("parent"), "major", F.col("y0").alias("py"), F.col("x0").alias("px"))
    x = child.join(p, ["page", "major"]).filter("cy > py and cy - py <= 300 and abs(cx - px) <= 60 and not (last > py)")
    return argmin_join(x, ["page", "child"], [F.col("cy") - F.col("py"), F.col("parent")]).select("page", "child", "parent")


@query("j10_marker_in_row", """
with m as (select i.page, i.idx, d.src_pos, row_number() over (partition by i.page, i.idx order by abs(i.x0 - d.x0), d.src_pos) as rk from items i join detections d on i.page = d.page and abs(i.y0 - d.y0) <= 12 and i.idx % 5 = d.src_pos % 5)
select page, idx, src_pos from m where rk = 1""", ("items", "detections"))
def j10(v):
    band = lambda y: F.floor(y / 12.0)
    a = v.items.select("page", "idx", "y0", "x0", (F.col("idx") % 5).alias("code"), F.explode(F.array(band(F.col("y0")) - 1, band(F.col("y0")), band(F.col("y0")) + 1)).alias("band"))
    b = v.detections.select("page", "src_pos", (F.col("src_pos") % 5).alias("code"), F.col("y0").alias("my"), F.col("x0").alias("mx"), band(F.col("y0")).alias("band"))
    x = a.join(b, ["page", "code", "band"]).filter("abs(y0 - my) <= 12")
    return argmin_join(x, ["page", "idx"], [F.abs(F.col("x0") - F.col("mx")), F.col("src_pos")]).select("page", "idx", "src_pos")


@query("j11_smallest_enclosing", f"""
with m as (select s.page, s.symbol_index, d.src_pos, row_number() over (partition by s.page, s.symbol_index order by {AREA.format(a='d')}, d.src_pos) as rk from symbols s join detections d on s.page = d.page and {holds('d', 's', 1)})
select page, symbol_index, src_pos from m where rk = 1""", ("symbols", "detections"))
def j11(v):
    x = box_join(v.symbols.select("page", "symbol_index", "y0", "x0", "y1", "x1"), v.detections, 1.0, geom.holds_center(Box("r"), Box("l"), 1.0))
    return argmin_join(x, ["page", "l_symbol_index"], [geom.area(Box("r")), F.col("r_src_pos")]).select("page", F.col("l_symbol_index").alias("symbol_index"), F.col("r_src_pos").alias("src_pos"))


@query("j12_column_fallback", f"""
with col as (select page, min(x0) as lo, max(x1) as hi from symbols where category = 'shape' group by page having count(*) >= 2),
m as (select s.page, s.symbol_index, d.src_pos, row_number() over (partition by s.page, s.symbol_index order by floor(abs(s.y0 - d.y0) * 10 + 0.5), {AREA.format(a='d')}, d.src_pos) as rk
  from symbols s join col using (page) join detections d on s.page = d.page and d.x0 >= col.lo - 2 and d.x1 <= col.hi + 2 and abs(s.y0 - d.y0) <= 12 where s.category = 'line')
select page, symbol_index, src_pos from m where rk = 1""", ("symbols", "detections"))
def j12(v):
    col = v.symbols.filter("category = 'shape'").groupBy("page").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"), F.count(F.lit(1)).alias("n")).filter("n >= 2").drop("n")
    band = lambda y: F.floor(y / 12.0)
    a = v.symbols.filter("category = 'line'").join(col, "page").select("page", "symbol_index", F.col("y0").alias("sy"), "lo", "hi", F.explode(F.array(band(F.col("y0")) - 1, band(F.col("y0")), band(F.col("y0")) + 1)).alias("band"))
    x = a.join(v.detections.withColumn("band", band(F.col("y0"))), ["page", "band"]).filter("x0 >= lo - 2 and x1 <= hi + 2 and abs(sy - y0) <= 12")
    return argmin_join(x, ["page", "symbol_index"], [F.floor(F.abs(F.col("sy") - F.col("y0")) * 10 + 0.5), geom.area(Box()), F.col("src_pos")]).select("page", "symbol_index", "src_pos")


@query("j13_text_trims", """
with m as (select page, symbol_index, text_index, y0, y1, x1, lag(y1) over (partition by page order by y0, symbol_index) as up, lead(y0) over (partition by page order by y0, symbol_index) as down from symbols)
select m.page, m.symbol_index, m.x1 + 0.5 as left_edge, case when up is null then m.y0 else (up + m.y0) / 2 end as band_lo, case when down is null then m.y1 else (down + m.y1) / 2 end as band_hi from m join items i on m.page = i.page and m.text_index = i.idx""", ("symbols", "items"))
def j13(v):
    w = Window.partitionBy("page").orderBy("y0", "symbol_index")
    m = v.symbols.withColumn("up", F.lag("y1").over(w)).withColumn("down", F.lead("y0").over(w))
    own = v.items.select("page", F.col("idx").alias("text_index"))
    lo = F.when(F.col("up").isNull(), F.col("y0")).otherwise((F.col("up") + F.col("y0")) / 2.0)
    hi = F.when(F.col("down").isNull(), F.col("y1")).otherwise((F.col("down") + F.col("y1")) / 2.0)
    return m.join(own, ["page", "text_index"], "left_semi").select("page", "symbol_index", (F.col("x1") + 0.5).alias("left_edge"), lo.alias("band_lo"), hi.alias("band_hi"))


@query("j14_marker_boxes", """
select d.page, d.src_pos from detections d where exists (select 1 from items i where i.page = d.page and abs((i.y0 + i.y1) / 2 - (d.y0 + d.y1) / 2) <= 0.45 * (d.y1 - d.y0) / 2 and abs((i.x0 + i.x1) / 2 - (d.x0 + d.x1) / 2) <= 0.45 * (d.x1 - d.x0) / 2)""", ("detections", "items"))
def j14(v):
    l, r = Box("l"), Box("r")
    (ly, lx), (ry, rx) = geom.center(l), geom.center(r)
    test = (F.abs(ry - ly) <= 0.45 * (l.y1 - l.y0) / 2.0) & (F.abs(rx - lx) <= 0.45 * (l.x1 - l.x0) / 2.0)
    return box_join(v.detections, v.items.select("page", "y0", "x0", "y1", "x1"), 0.0, test, how="left_semi").select("page", "src_pos")


@query("j16_nearest_head", f"""
with o as (select s.page, s.symbol_index, s.y0, s.x0, s.y1, s.x1, i.pos as own from symbols s join items i on s.page = i.page and s.text_index = i.idx),
m as (select s.page, s.symbol_index, d.src_pos, row_number() over (partition by s.page, s.symbol_index order by {GAP.format(a='s', b='d')}, d.src_pos) as rk from o s join detections d on s.page = d.page and d.src_pos <> s.own and {GAP.format(a='s', b='d')} <= 12 and least(d.y1 - d.y0, d.x1 - d.x0) > 1.2 and greatest(d.y1 - d.y0, d.x1 - d.x0) <= 24)
select page, symbol_index, src_pos from m where rk = 1""", ("symbols", "items", "detections"))
def j16(v):
    """The nearest filled unit over 1.2 and at most 24 wide within 12; not the stroke itself."""
    heads = v.detections.filter((F.least(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")) > 1.2) & (F.greatest(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")) <= 24.0))
    own = v.items.select("page", F.col("idx").alias("text_index"), F.col("pos").alias("own"))
    s = v.symbols.join(own, ["page", "text_index"]).select("page", "symbol_index", "own", "y0", "x0", "y1", "x1")
    x = box_join(s, heads, 12.0, F.col("l_own") != F.col("r_src_pos"))
    return argmin_join(x, ["page", "l_symbol_index"], [geom.gap(Box("l"), Box("r")), F.col("r_src_pos")]).select("page", F.col("l_symbol_index").alias("symbol_index"), F.col("r_src_pos").alias("src_pos"))


@query("j15_root_on_marker", """
with e as (select s.page, s.symbol_index, d.src_pos, sqrt((d.x0 - (s.x0 + s.x1) / 2) * (d.x0 - (s.x0 + s.x1) / 2) + (d.y0 - (s.y0 + s.y1) / 2) * (d.y0 - (s.y0 + s.y1) / 2)) as near,
  sqrt((d.x1 - (s.x0 + s.x1) / 2) * (d.x1 - (s.x0 + s.x1) / 2) + (d.y1 - (s.y0 + s.y1) / 2) * (d.y1 - (s.y0 + s.y1) / 2)) as far from symbols s join detections d on s.page = d.page where abs(s.y0 - d.y0) <= 400),
m as (select *, row_number() over (partition by page, symbol_index order by far desc, src_pos) as rk from e where near <= 9 and far >= near + 8)
select page, symbol_index, src_pos from m where rk = 1""", ("symbols", "detections"))
def j15(v):
    cy, cx = (F.col("l_y0") + F.col("l_y1")) / 2.0, (F.col("l_x0") + F.col("l_x1")) / 2.0
    away = lambda y, x: F.sqrt((F.col(x) - cx) * (F.col(x) - cx) + (F.col(y) - cy) * (F.col(y) - cy))
    near, far = away("r_y0", "r_x0"), away("r_y1", "r_x1")
    pairs = box_join(v.symbols.select("page", "symbol_index", "y0", "x0", "y1", "x1"), v.detections, 9.0, (near <= 9.0) & (far >= near + 8.0) & (F.abs(F.col("l_y0") - F.col("r_y0")) <= 400.0))
    return argmin_join(pairs, ["page", "l_symbol_index"], [far.desc(), F.col("r_src_pos")]).select("page", F.col("l_symbol_index").alias("symbol_index"), F.col("r_src_pos").alias("src_pos"))


@query("j22_enclosing_outline", f"""
with m as (select s.page, s.symbol_index, d.src_pos, row_number() over (partition by s.page, s.symbol_index order by {AREA.format(a='d')}, d.src_pos) as rk from symbols s join detections d on s.page = d.page
  and s.y0 >= d.y0 - 1 and s.x0 >= d.x0 - 1 and s.y1 <= d.y1 + 1 and s.x1 <= d.x1 + 1 and d.y1 - d.y0 <= 1.35 * (s.y1 - s.y0))
select page, symbol_index, src_pos from m where rk = 1""", ("symbols", "detections"))
def j22(v):
    l, r = Box("l"), Box("r")
    x = box_join(v.symbols.select("page", "symbol_index", "y0", "x0", "y1", "x1"), v.detections, 1.0, geom.contains(r, l, 1.0) & (r.y1 - r.y0 <= 1.35 * (l.y1 - l.y0)))
    return argmin_join(x, ["page", "l_symbol_index"], [geom.area(r), F.col("r_src_pos")]).select("page", F.col("l_symbol_index").alias("symbol_index"), F.col("r_src_pos").alias("src_pos"))


@query("w02_symbol_dedupe", f"""
with o as (select s.*, i.text as ot, {MEET.format(a='s', b='i')} / least({AREA.format(a='s')}, {AREA.format(a='i')}) as share from symbols s left join items i on s.page = i.page and s.text_index = i.idx),
r as (select *, row_number() over w as rk, first_value(symbol_index) over w as win from o window w as (partition by page, round_even(y0, 0), round_even(x0, 0), round_even(y1, 0), round_even(x1, 0)
  order by case when coalesce(share, 0) > 0.5 then 1 else 0 end, -length(coalesce(ot, '')), text_index, symbol_index))
select page, symbol_index, text_index, rk = 1 as kept, case when rk > 1 then 'same box as symbol ' || cast(win as varchar) end as reason from r""", ("symbols", "items"))
def w02(v):
    return pages.dedupe_symbols(v.symbols, v.items)


@query("w04_table_columns", """
select page, pos from (select a.page, a.pos, count(*) as n from boxes a join boxes b on a.page = b.page and abs(a.x0 - b.x0) <= 4
  and (b.y1 < a.y0 - 1.2 * greatest(a.y1 - a.y0, 2) or b.y0 > a.y1 + 1.2 * greatest(a.y1 - a.y0, 2)) group by 1, 2) where n >= 2""", ("boxes",))
def w04(v):
    return pages.table_columns(v.boxes)


@query("q04_group_verdict", f"""
with own as ({_SMALLEST.format(k='symbol_index', t='symbols')}), item as ({_SMALLEST.format(k='idx', t='items')}),
x as (select s.page, s.symbol_index, own.kind as own, coalesce(own.kind, item.kind) as kind from symbols s left join own on s.page = own.page and s.symbol_index = own.symbol_index left join item on s.page = item.page and s.text_index = item.idx)
select page, symbol_index, coalesce(kind in ('legend', 'schedule', 'note_cluster'), false) as ok,
  case when coalesce(kind in ('legend', 'schedule', 'note_cluster'), false) then case when own is not null then 'own group' else 'owner''s group' end when kind is null then 'no group' else 'in ' || kind end as reason from x""", ("symbols", "items", "groups"))
def q04(v):
    return pages.group_verdict(v.symbols, v.items, v.groups)


@query("q05_classify", f"""
with own as ({_SMALLEST.format(k='symbol_index', t='symbols')}), item as ({_SMALLEST.format(k='idx', t='items')}),
g as (select s.page, s.symbol_index, coalesce(coalesce(own.kind, item.kind) in ('legend', 'schedule', 'note_cluster'), false) as ok from symbols s left join own on s.page = own.page and s.symbol_index = own.symbol_index left join item on s.page = item.page and s.text_index = item.idx),
o as (select s.*, i.text as ot, {MEET.format(a='s', b='i')} / least({AREA.format(a='s')}, {AREA.format(a='i')}) as share from symbols s join items gate on gate.page = s.page and gate.idx = s.text_index and gate.text <> '' and not (regexp_matches(gate.text, '{text.GATE}') and not regexp_matches(gate.text, '{text.FENCE}')) join g on s.page = g.page and s.symbol_index = g.symbol_index and g.ok left join items i on s.page = i.page and s.text_index = i.idx),
r as (select page, symbol_index, row_number() over (partition by page, round_even(y0, 0), round_even(x0, 0), round_even(y1, 0), round_even(x1, 0) order by case when coalesce(share, 0) > 0.5 then 1 else 0 end, -length(coalesce(ot, '')), text_index, symbol_index) as rk from o)
select page, symbol_index from r where rk = 1""", ("symbols", "items", "groups"))
def q05(v):
    """Owner gate, then group gate, then one symbol of each box."""
    own = v.items.filter((F.col("text") != "") & ~text.is_gate(F.col("text"))).select("page", F.col("idx").alias("text_index"))
    ok = pages.group_verdict(v.symbols, v.items, v.groups).filter("ok").select("page", "symbol_index")
    return pages.dedupe_symbols(v.symbols.join(own, ["page", "text_index"], "left_semi").join(ok, ["page", "symbol_index"], "left_semi"), v.items).filter("kept").select("page", "symbol_index")


@query("q01_page_rejects", f"""
select page, count(*) as n, count(case when {VALID.format(a='d')} then 1 end) as valid, count(case when {VALID.format(a='d')} then 1 end) = 0 as page_error from detections d group by page""", ("detections",))
def q01(v):
    ok = F.count(F.when(geom.valid(Box()), 1))
    return v.detections.groupBy("page").agg(F.count(F.lit(1)).alias("n"), ok.alias("valid"), (ok == 0).alias("page_error"))


@query("r22_box_select", f"""
with u as (select g.page, g.group_index, count(*) as units from groups g join detections d on g.page = d.page
  and least(g.y1, d.y1) - greatest(g.y0, d.y0) >= 0.5 * (d.y1 - d.y0) and least(g.x1, d.x1) - greatest(g.x0, d.x0) >= 0.5 * (d.x1 - d.x0) group by 1, 2),
t as (select g.page, g.group_index, count(*) as texts from groups g join items i on g.page = i.page and {holds('g', 'i', 0)} group by 1, 2)
select g.page, g.group_index, coalesce(u.units, 0) as units, coalesce(t.texts, 0) as texts from groups g left join u on g.page = u.page and g.group_index = u.group_index left join t on g.page = t.page and g.group_index = t.group_index""", ("groups", "detections", "items"))
def r22(v):
    """Units of which half lies in the box on either axis, and texts whose centre does."""
    l, r = Box("l"), Box("r")
    share = (F.least(l.y1, r.y1) - F.greatest(l.y0, r.y0) >= 0.5 * (r.y1 - r.y0)) & (F.least(l.x1, r.x1) - F.greatest(l.x0, r.x0) >= 0.5 * (r.x1 - r.x0))
    count = lambda pairs, n: pairs.groupBy("page", F.col("l_group_index").alias("group_index")).agg(F.count(F.lit(1)).alias(n))
    u = count(box_join(v.groups, v.detections, 0.0, share, cell=250.0), "units")
    t = count(box_join(v.groups, v.items.select("page", "idx", "y0", "x0", "y1", "x1"), 0.0, geom.holds_center(l, r, 0.0), cell=250.0), "texts")
    x = v.groups.select("page", "group_index").join(u, ["page", "group_index"], "left").join(t, ["page", "group_index"], "left")
    return x.fillna(0)


@query("r24_outline_check", """
select s.page, s.symbol_index, (d.y1 - d.y0) >= 0.75 * (s.y1 - s.y0) and (d.x1 - d.x0) >= 0.75 * (s.x1 - s.x0) as ok from symbols s join items i on s.page = i.page and s.text_index = i.idx join detections d on d.page = i.page and d.src_pos = i.pos""", ("symbols", "items", "detections"))
def r24(v):
    s = v.symbols.select("page", "symbol_index", F.col("text_index").alias("idx"), (F.col("y1") - F.col("y0")).alias("h"), (F.col("x1") - F.col("x0")).alias("w"))
    d = v.detections.withColumnRenamed("src_pos", "pos")
    x = s.join(v.items.select("page", "idx", "pos"), ["page", "idx"]).join(d, ["page", "pos"])
    return x.select("page", "symbol_index", ((F.col("y1") - F.col("y0") >= 0.75 * F.col("h")) & (F.col("x1") - F.col("x0") >= 0.75 * F.col("w"))).alias("ok"))


@query("r39_pixel_reply_repair", """
with m as (select page, max(greatest(y0, x0, y1, x1)) as top from (select page, y0 * 2 as y0, x0 * 2 as x0, y1 * 2 as y1, x1 * 2 as x1 from boxes) group by page)
select b.page, b.pos, m.top > 1000 as rescaled, """ + ", ".join(f"case when m.top > 1000 then b.{c} * 2 / m.top * 1000 else b.{c} * 2 end as {c}" for c in ("y0", "x0", "y1", "x1")) + " from boxes b join m on b.page = m.page", ("boxes",))
def r39(v):
    """A reply with any coordinate out of the frame is rescaled as a whole."""
    twice = v.boxes.select("page", "pos", *((F.col(c) * 2).alias(c) for c in ("y0", "x0", "y1", "x1")))
    top = F.max(F.greatest("y0", "x0", "y1", "x1")).over(Window.partitionBy("page"))
    bad = F.col("top") > 1000
    return twice.withColumn("top", top).select("page", "pos", bad.alias("rescaled"), *(F.when(bad, F.col(c) / F.col("top") * 1000).otherwise(F.col(c)).alias(c) for c in ("y0", "x0", "y1", "x1")))
