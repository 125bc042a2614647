"""Sources, geometry, gates and merges in detail: alignment, records, resolve at read time, inherited row codes, audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geom, text
from ..functions.geom import Box
from ..operators import geometry, sequence, state, votes
from ..operators.numbering import number_along
from ..operators.spatial import argmin_join, box_join
from .registry import AREA, GAP, UPPER, holds, query


@query("s01_glyph_runs", r"""
with w as (select page, pos, unnest(string_split(line, ' ')) as word, generate_subscripts(string_split(line, ' '), 1) as k from boxes),
g as (select *, case when k > 1 and 1 + 2 * cast(regexp_matches(lag(word) over (partition by page, pos order by k), '[.,;:!?]$') as int) > 2.5 then 1 else 0 end as brk from w),
f as (select *, cast(sum(brk) over (partition by page, pos order by k) as int) as run from g)
select page, pos, run, string_agg(word, ' ' order by k) as text from f group by 1, 2, 3""", ("boxes",))
def s01(v):
    """Glyph runs of a line, cut where the gap is over 2.5 glyphs; a word after a stop stands three glyphs off, others one."""
    x = v.boxes.select("page", "pos", F.posexplode(F.split("line", " ", -1)).alias("k", "word"))
    w = Window.partitionBy("page", "pos").orderBy("k")
    gap = 1 + 2 * F.coalesce(F.lag("word").over(w).rlike("[.,;:!?]$"), F.lit(False)).cast("int")
    x = sequence.islands(x, ["page", "pos"], ["k"], (F.col("k") > 0) & (gap > 2.5), "run")
    x = x.groupBy("page", "pos", "run").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("w"))
    return x.select("page", "pos", "run", F.array_join(F.transform("w", lambda p: p["word"]), " ").alias("text"))


@query("s02_page_scan", r"""
select doc_id as page, case when text is null then 'no text layer' when n_chars <> length(text) then 'length differs' when doc_id % 29 = 0 then 'worker lost' end as error,
  case when text is not null and n_chars = length(text) and doc_id % 29 > 0 then len(string_split(text, chr(10))) end as lines from documents""")
def s02(v):
    """A page that fails is a row with its error; the others go on."""
    bad = F.when(F.col("text").isNull(), "no text layer").when(F.col("n_chars") != F.length("text"), "length differs").when(F.col("doc_id") % 29 == 0, "worker lost")
    x = v.table("documents").select(F.col("doc_id").alias("page"), bad.alias("error"), F.size(F.split("text", "\n", -1)).cast("long").alias("n"))
    return x.select("page", "error", F.when(F.col("error").isNull(), F.col("n")).alias("lines"))


@query("s07_source_alignment", """
with a as (select page, idx % 3 as kind, idx, length(text) as size, row_number() over (partition by page, idx % 3 order by idx) as rn from items),
b as (select page, src_pos % 3 as kind, src_pos, row_number() over (partition by page, src_pos % 3 order by src_pos) as rn from detections),
na as (select page, kind, count(*) as n from a group by 1, 2), nb as (select page, kind, count(*) as n from b group by 1, 2)
select coalesce(a.page, b.page) as page, coalesce(a.kind, b.kind) as kind, a.idx, b.src_pos, coalesce(na.n = nb.n, false) as aligned
from a full join b on a.page = b.page and a.kind = b.kind and a.rn = b.rn left join na on na.page = coalesce(a.page, b.page) and na.kind = coalesce(a.kind, b.kind) left join nb on nb.page = coalesce(a.page, b.page) and nb.kind = coalesce(a.kind, b.kind)""", ("items", "detections"))
def s07(v):
    """The k-th event of a kind in one order belongs to the k-th in the other; a kind is aligned if both have as many."""
    rn = lambda at: F.row_number().over(Window.partitionBy("page", "kind").orderBy(at))
    n = F.count(F.lit(1)).over(Window.partitionBy("page", "kind"))
    a = v.items.select("page", (F.col("idx") % 3).alias("kind"), "idx").withColumn("rn", rn("idx")).withColumn("na", n)
    b = v.detections.select("page", (F.col("src_pos") % 3).alias("kind"), "src_pos").withColumn("rn", rn("src_pos")).withColumn("nb", n)
    x = a.join(b, ["page", "kind", "rn"], "full")
    w = Window.partitionBy("page", "kind")
    return x.select("page", "kind", "idx", "src_pos", F.coalesce(F.max("na").over(w) == F.max("nb").over(w), F.lit(False)).alias("aligned"))


@query("s13_canonical_json", """
select page, pos, sha256(printf('{"box":[%.9f,%.9f,%.9f,%.9f],"len":%d,"pos":%d}', y0, x0, y1, x1, length(line), pos)) as digest from boxes""", ("boxes",))
def s13(v):
    """Keys in order, numbers with nine digits, no blanks: the same record has the same digest everywhere."""
    doc = F.format_string('{"box":[%.9f,%.9f,%.9f,%.9f],"len":%d,"pos":%d}', "y0", "x0", "y1", "x1", F.length("line"), "pos")
    return v.boxes.select("page", "pos", F.sha2(doc, 256).alias("digest"))


@query("s15_ndjson_rows", """
with p as (select page, count(*) as n, page % 31 = 0 as bad from items group by page)
select page, 0 as kind, case when bad then '{"page":' || page || ',"ok":false,"code":"render_failed"}' else '{"page":' || page || ',"ok":true,"items":' || n || '}' end as line from p
union all select null as page, 1 as kind, '{"done":' || count(*) || ',"failed":' || count(case when bad then 1 end) || '}' as line from p""", ("items",))
def s15(v):
    """One JSON row a page, then one row that says how it went."""
    p = v.items.groupBy("page").agg(F.count(F.lit(1)).alias("n")).withColumn("bad", F.col("page") % 31 == 0)
    page = F.col("page").cast("string")
    row = F.when(F.col("bad"), F.concat(F.lit('{"page":'), page, F.lit(',"ok":false,"code":"render_failed"}'))).otherwise(F.concat(F.lit('{"page":'), page, F.lit(',"ok":true,"items":'), F.col("n").cast("string"), F.lit("}")))
    done = p.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("f"))
    last = done.select(F.lit(None).cast("long").alias("page"), F.lit(1).alias("kind"), F.concat(F.lit('{"done":'), F.col("n").cast("string"), F.lit(',"failed":'), F.col("f").cast("string"), F.lit("}")).alias("line"))
    return p.select("page", F.lit(0).alias("kind"), row.alias("line")).unionByName(last)


@query("s17_resign_dry_run", """
with p as (select page, max(n) as n from lines group by page), s as (select page, substr(sha1('old|' || page || '|' || n), 1, 12) as old_sig, substr(sha1(case when page % 3 = 0 then 'old' else 'new' end || '|' || page || '|' || n), 1, 12) as new_sig from p)
select page, old_sig, new_sig, old_sig <> new_sig as would_change from s""", ("lines",))
def s17(v):
    """What a new signature would rewrite, without rewriting it."""
    p = v.lines.groupBy("page").agg(F.max("n").alias("n"))
    sig = lambda version: state.signature(version, F.col("page"), F.col("n"))
    s = p.select("page", sig(F.lit("old")).alias("old_sig"), sig(F.when(F.col("page") % 3 == 0, "old").otherwise("new")).alias("new_sig"))
    return s.withColumn("would_change", F.col("old_sig") != F.col("new_sig"))


@query("s21_plan_fingerprint", """
with s as (select doc_id, stage, lang, cast(floor((row_number() over (partition by lang, stage order by doc_id) - 1) / 64) as int) as shard from documents cross join (values ('text'), ('symbols'), ('arrows')) as s(stage))
select lang, stage, shard, count(*) as pages, min(doc_id) as first_page, max(doc_id) as last_page, substr(sha256(lang || '|' || stage || '|' || shard || '|' || count(*) || '|' || min(doc_id) || '|' || max(doc_id)), 1, 16) as fingerprint from s group by lang, stage, shard""")
def s21(v):
    """Shards of 64 pages with a fingerprint of what they hold; numbered by chunks, so no language is one task."""
    x = v.table("documents").select("doc_id", "lang", F.explode(F.array(*map(F.lit, ("text", "symbols", "arrows")))).alias("stage"))
    x = number_along(x, ["lang", "stage"], "doc_id", [], "n").withColumn("shard", F.floor(F.col("n") / 64).cast("int"))
    s = x.groupBy("lang", "stage", "shard").agg(F.count(F.lit(1)).alias("pages"), F.min("doc_id").alias("first_page"), F.max("doc_id").alias("last_page"))
    key = F.concat_ws("|", "lang", "stage", *(F.col(c).cast("string") for c in ("shard", "pages", "first_page", "last_page")))
    return s.withColumn("fingerprint", F.left(F.sha2(key, 256), F.lit(16)))


@query("f11_model_boxes", """
with r as (select page, src_pos, case when src_pos % 7 = 0 then 'text' else 'box' end as shape, y0, x0, y1, x1 from detections)
select page, src_pos, shape = 'box' and y0 >= 0 and x0 >= 0 and y1 <= 1000 and x1 <= 1000 and y0 < y1 and x0 < x1 as kept from r""", ("detections",))
def f11(v):
    """Of a reply's rows those that are records with a valid box."""
    return v.detections.select("page", "src_pos", ((F.col("src_pos") % 7 != 0) & geom.valid(Box())).alias("kept"))


_PLAN = "select g.page, g.y0, g.x0, g.y1, g.x1 from groups g join view_types t on g.page = t.page and g.group_index = t.group_index where t.view_type = 'plan'"


@query("f16_tip_gate", f"""
with plan as ({_PLAN}), t as (select page, symbol_index, x0 + 4 as tx, y0 as ty from symbols)
select t.page, t.symbol_index, exists (select 1 from plan p where p.page = t.page and t.ty between p.y0 and p.y1 and t.tx between p.x0 and p.x1) as in_plan from t""", ("symbols", "groups", "view_types"))
def f16_tips(v):
    """Tips have to lie in a plan box itself: no tolerance."""
    plan = v.groups.join(v.view_types.filter("view_type = 'plan'").select("page", "group_index"), ["page", "group_index"]).select("page", "y0", "x0", "y1", "x1")
    tips = v.symbols.select("page", "symbol_index", F.col("y0"), F.col("y0").alias("y1"), (F.col("x0") + 4).alias("x0"), (F.col("x0") + 4).alias("x1"))
    hit = box_join(tips, plan, 0.0, geom.holds_center(Box("r"), Box("l"), 0.0), cell=250.0, how="left_semi").select("page", "symbol_index", F.lit(True).alias("hit"))
    return tips.join(hit, ["page", "symbol_index"], "left").select("page", "symbol_index", F.coalesce("hit", F.lit(False)).alias("in_plan"))


_ALLOWED = "('legend', 'schedule', 'note_cluster')"


@query("j09_inherited_rows", f"""
with i as (select page, idx, y0, x0, y1, x1, idx // 4 + 1 as section, idx % 4 as r from items),
g as (select i.page, i.idx, list(g.group_index) as gs from i join groups g on g.page = i.page and g.kind in {_ALLOWED} and {holds('g', 'i', 2)} group by 1, 2),
c as (select i.*, i.x0 - 30 as cx0, i.x0 - 4 as cx1, g.gs from i join g on i.page = g.page and i.idx = g.idx),
pairs as (select o.page, o.idx as owner, c.idx as code, c.section, c.cx0, c.cx1, c.y0, c.y1, list_intersect(o.gs, c.gs) as common from c o join c on o.page = c.page and c.r > 0
  and o.x0 - c.cx1 between -12 and 40 and (c.cx0 + c.cx1) / 2 < (o.x0 + o.x1) / 2 and least(o.y1, c.y1) - greatest(o.y0, c.y0) >= cast(0.45 as double) * least(o.y1 - o.y0, c.y1 - c.y0) where len(list_intersect(o.gs, c.gs)) > 0),
p as (select page, idx as parent, section, cx0, cx1, y0, y1, gs from c where r = 0),
e as (select q.page, q.owner, q.code, p.parent, (q.y0 + q.y1) / 2 - (p.y0 + p.y1) / 2 as d from pairs q join p on p.page = q.page and p.section = q.section and len(list_intersect(q.common, p.gs)) > 0
  and (p.y0 + p.y1) / 2 < (q.y0 + q.y1) / 2 and (q.y0 + q.y1) / 2 - (p.y0 + p.y1) / 2 <= 300 and abs((q.cx0 + q.cx1) / 2 - (p.cx0 + p.cx1) / 2) <= 60
  where not exists (select 1 from p h where h.page = q.page and h.section <> p.section and len(list_intersect(list_intersect(q.common, p.gs), h.gs)) > 0 and (h.y0 + h.y1) / 2 > (p.y0 + p.y1) / 2 and (h.y0 + h.y1) / 2 < (q.y0 + q.y1) / 2)),
b as (select page, owner, code, arg_min(parent, (d, parent)) as parent from e group by 1, 2, 3)
select page, owner, code, parent from (select *, count(*) over (partition by page, owner) as no, count(*) over (partition by page, code) as nc from b) where no = 1 and nc = 1""", ("items", "groups"))
def j09(v):
    """Row codes `section.row` left of an owner, under their section's header, if the pair is the only one on both sides.

    Gap from -12 to 40, rows that overlap by 0.45, one common legend group; the header at most 300 above and 60 aside,
    with no other section's header between. A code's token stands before the item of its row.
    """
    allowed = v.groups.filter(F.col("kind").isin("legend", "schedule", "note_cluster"))
    i = v.items.select("page", "idx", "y0", "x0", "y1", "x1")
    hit = box_join(i, allowed, 2.0, geom.holds_center(Box("r"), Box("l"), 2.0), cell=250.0)
    g = hit.groupBy("page", F.col("l_idx").alias("idx")).agg(F.sort_array(F.collect_set("r_group_index")).alias("gs"))
    c = i.join(g, ["page", "idx"]).select("*", (F.floor(F.col("idx") / 4) + 1).alias("section"), (F.col("idx") % 4).alias("r"), (F.col("x0") - 30).alias("cx0"), (F.col("x0") - 4).alias("cx1"))
    code = c.filter("r > 0").select("page", F.col("idx").alias("code"), "section", "gs", "y0", F.col("cx0").alias("x0"), "y1", F.col("cx1").alias("x1"))
    l, r = Box("l"), Box("r")
    left = (l.x0 - r.x1).between(-12, 40) & ((r.x0 + r.x1) / 2 < (l.x0 + l.x1) / 2)
    row = F.least(l.y1, r.y1) - F.greatest(l.y0, r.y0) >= 0.45 * F.least(l.y1 - l.y0, r.y1 - r.y0)
    pairs = box_join(c.select("page", "idx", "gs", "y0", "x0", "y1", "x1"), code, 40.0, left & row & F.arrays_overlap("l_gs", "r_gs"))
    q = pairs.select("page", F.col("l_idx").alias("owner"), F.col("r_code").alias("code"), F.col("r_section").alias("section"), F.array_intersect("l_gs", "r_gs").alias("common"), ((r.y0 + r.y1) / 2).alias("cy"), ((r.x0 + r.x1) / 2).alias("cx"))
    p = c.filter("r = 0").select("page", "section", F.col("idx").alias("parent"), F.col("gs").alias("pg"), ((F.col("y0") + F.col("y1")) / 2).alias("py"), ((F.col("cx0") + F.col("cx1")) / 2).alias("px"))
    e = q.join(p, ["page", "section"]).filter(F.arrays_overlap("common", "pg") & (F.col("py") < F.col("cy")) & (F.col("cy") - F.col("py") <= 300) & (F.abs(F.col("cx") - F.col("px")) <= 60))
    h = p.select("page", F.col("section").alias("hs"), F.col("pg").alias("hg"), F.col("py").alias("hy"))
    blocked = F.expr("a.page = b.page and hs <> section and hy > py and hy < cy and arrays_overlap(array_intersect(common, pg), hg)")
    e = e.alias("a").join(h.alias("b"), blocked, "left_anti")
    b = argmin_join(e, ["page", "owner", "code"], [F.col("cy") - F.col("py"), F.col("parent")])
    n = lambda c: F.count(F.lit(1)).over(Window.partitionBy("page", c))
    return b.withColumn("no", n("owner")).withColumn("nc", n("code")).filter("no = 1 and nc = 1").select("page", "owner", "code", "parent")


@query("j23_legend_errors", """
with base as (select c_custkey as number, c_nationkey % 3 as source from customer where c_custkey % 6 > 0), sup as (select c_custkey as number, c_custkey as base_number, case when c_custkey % 10 = 0 then (c_nationkey + 1) % 3 else c_nationkey % 3 end as source, c_custkey % 14 = 0 as no_audit from customer where c_custkey % 2 = 0),
j as (select coalesce(b.number, s.number) as number, b.source as engine, s.source as legend, s.number is not null as supervised, b.number is not null as known, coalesce(s.no_audit, false) as no_audit from base b full join sup s on b.number = s.number)
select number, supervised, case when supervised then legend else engine end as source, case when supervised and no_audit then 'no matched-cluster audit' when supervised and not known then 'missing engine type' when supervised and known and engine <> legend then 'source differs' end as error from j""")
def j23(v):
    """Supervised rows take the place of the engine's; one that does not agree with the engine's audit is an error row."""
    c = v.table("customer").select(F.col("c_custkey").alias("number"), "c_nationkey")
    base = c.filter("number % 6 > 0").select("number", (F.col("c_nationkey") % 3).alias("engine"), F.lit(True).alias("known"))
    legend = F.when(F.col("number") % 10 == 0, (F.col("c_nationkey") + 1) % 3).otherwise(F.col("c_nationkey") % 3)
    sup = c.filter("number % 2 = 0").select("number", legend.alias("legend"), (F.col("number") % 14 == 0).alias("no_audit"), F.lit(True).alias("supervised"))
    x = base.join(sup, "number", "full").withColumn("supervised", F.coalesce("supervised", F.lit(False)))
    s = F.col("supervised")
    error = F.when(s & F.col("no_audit"), "no matched-cluster audit").when(s & F.col("known").isNull(), "missing engine type").when(s & (F.col("engine") != F.col("legend")), "source differs")
    return x.select("number", "supervised", F.when(s, F.col("legend")).otherwise(F.col("engine")).alias("source"), error.alias("error"))


_RESOLVE = """x as (select event_id, grp, line_type_number as number, distance, grp % 13 = 0 as gate, event_id % 4 > 0 as in_plan, case when event_id % 17 = 0 then 'legend' when event_id % 5 = 0 then 'center' else 'arrow' end as kind,
  case when residual then 'residual' when distance > 60 then 'too-far' else 'bound' end as state from bindings),
i as (select * from x where in_plan and state = 'bound'),
ord as (select grp, number, votes, row_number() over (partition by grp order by votes desc, weight, number) as rk from (select grp, number, count(*) as votes, sum(distance) as weight from i where kind = 'arrow' group by 1, 2)),
ow as (select grp, number from ord where rk = 1),
leg as (select grp, case when count(distinct number) = 1 then min(number) end as number, count(distinct number) > 1 as conflict from i where kind = 'legend' group by grp),
cc as (select grp, event_id % 3 as placement, number, min(cast(round(distance * 100) as bigint)) as d from i where kind = 'center' group by 1, 2, 3),
cf as (select *, row_number() over (partition by grp, placement order by d, number) = 1 as first from cc),
ct as (select grp, number, count(*) as coverage, count(case when first then 1 end) as first_votes, cast(sum(d) as bigint) as d from cf group by 1, 2),
cb as (select *, row_number() over (partition by grp order by coverage desc, first_votes desc, d, number) as rk from ct),
cw as (select grp, number, coverage >= 2 as confirmed from cb where rk = 1),
cx as (select o.grp, sum(o.votes) as others from ord o join cw on o.grp = cw.grp and o.number <> cw.number group by o.grp),
g as (select distinct grp, gate from x),
w as (select g.grp, g.gate, leg.grp is not null as has_legend, coalesce(leg.conflict, false) as conflict,
  case when g.gate or coalesce(leg.conflict, false) then null when leg.number is not null then leg.number when cw.number is null then ow.number when ow.number = cw.number then cw.number
    when not cw.confirmed then coalesce(ow.number, cw.number) when ow.number is null or coalesce(cx.others, 0) <= 1 then cw.number else ow.number end as picked
  from g left join leg on g.grp = leg.grp left join ow on g.grp = ow.grp left join cw on g.grp = cw.grp left join cx on g.grp = cx.grp),
r as (select *, case when picked <= 4 then picked end as winner, case when picked > 4 then picked end as missing from w)"""


def _resolved(v):
    b = v.bindings
    kind = F.when(F.col("event_id") % 17 == 0, "legend").when(F.col("event_id") % 5 == 0, "center").otherwise("arrow")
    st = F.when(F.col("residual"), "residual").when(F.col("distance") > 60, "too-far").otherwise("bound")
    x = b.select("event_id", "grp", F.col("line_type_number").alias("number"), "distance", (F.col("grp") % 13 == 0).alias("gate"), (F.col("event_id") % 4 > 0).alias("in_plan"), kind.alias("kind"), st.alias("state"), (F.col("event_id") % 3).alias("placement"))
    return votes.resolve(x, geometry_up_to=4)


@query("a07_resolved_groups", f"with {_RESOLVE} select grp, gate, has_legend, conflict, winner, missing from r", ("bindings",))
def a07_groups(v):
    return _resolved(v)[0]


@query("a07_resolved_terminals", f"""with {_RESOLVE}
select x.event_id, case when x.gate then 'gate' when x.state <> 'bound' then x.state when r.winner is null then 'hidden' when x.number = r.winner then 'bound' when abs(x.number - r.winner) <= 1 and x.distance <= 36 then 'reassigned' else 'unresolved' end as state,
  x.in_plan and not x.gate and x.state = 'bound' and r.winner is not null and (x.number = r.winner or (abs(x.number - r.winner) <= 1 and x.distance <= 36)) as visible from x join r on x.grp = r.grp""", ("bindings",))
def a07_terminals(v):
    return _resolved(v)[1].select("event_id", F.col("final_state").alias("state"), "visible")


@query("a07_visible_types", f"with {_RESOLVE} select winner as number, count(*) as groups from r where winner is not null group by winner", ("bindings",))
def a07_visible(v):
    return _resolved(v)[0].filter("winner is not null").groupBy(F.col("winner").alias("number")).agg(F.count(F.lit(1)).alias("groups"))


@query("q07_flanked_codes", f"""
with c as (select page, idx, y0, x0, y1, x1 from items where regexp_matches(split_part({UPPER.format(c='text')}, ' ', 1), '{text.MARKER_SHAPE}')),
m as (select distinct c.page, c.idx from c join detections d on d.page = c.page and {AREA.format(a='d')} <= 40000 and {holds('d', 'c', 1)}),
e as (select c.page, c.idx, d.src_pos, (d.x0 + d.x1) / 2 - (c.x0 + c.x1) / 2 as dx, (d.y0 + d.y1) / 2 - (c.y0 + c.y1) / 2 as dy from c join detections d on d.page = c.page and {GAP.format(a='c', b='d')} <= 30),
u as (select * from (select *, row_number() over (partition by page, idx order by dx * dx + dy * dy, src_pos) as rk from e where dx <> 0 or dy <> 0) where rk <= 16),
f as (select distinct a.page, a.idx from u a join u b on a.page = b.page and a.idx = b.idx and a.rk < b.rk where a.dx * b.dx + a.dy * b.dy < cast(-0.75 as double) * sqrt(a.dx * a.dx + a.dy * a.dy) * sqrt(b.dx * b.dx + b.dy * b.dy))
select c.page, c.idx, case when m.idx is not null then 'marker' when f.idx is not null then 'flanked' else 'kept' end as verdict from c left join m on c.page = m.page and c.idx = m.idx left join f on c.page = f.page and c.idx = f.idx""", ("items", "detections"))
def q07(v):
    """A code-shaped text goes only with evidence: a small closed marker around it, or lines from two opposite sides."""
    c = v.items.filter(F.split_part(text.upper(F.col("text")), F.lit(" "), F.lit(1)).rlike(text.MARKER_SHAPE)).select("page", "idx", "y0", "x0", "y1", "x1")
    small = v.detections.filter(geom.area(Box()) <= 40000)
    m = box_join(c, small.select("page", "y0", "x0", "y1", "x1"), 1.0, geom.holds_center(Box("r"), Box("l"), 1.0), how="left_semi").select("page", "idx", F.lit(True).alias("m"))
    (ly, lx), (ry, rx) = geom.center(Box("l")), geom.center(Box("r"))
    e = box_join(c, v.detections, 30.0).select("page", F.col("l_idx").alias("idx"), F.col("r_src_pos").alias("src_pos"), (rx - lx).alias("dx"), (ry - ly).alias("dy"))
    d2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    rk = F.row_number().over(Window.partitionBy("page", "idx").orderBy(d2, "src_pos"))
    u = e.filter("dx <> 0 or dy <> 0").withColumn("rk", rk).filter("rk <= 16").groupBy("page", "idx").agg(F.collect_list(F.struct("dx", "dy", F.sqrt(d2).alias("len"))).alias("u"))
    f = u.filter(F.exists("u", lambda p: F.exists("u", lambda q: p["dx"] * q["dx"] + p["dy"] * q["dy"] < F.lit(-0.75) * p["len"] * q["len"]))).select("page", "idx", F.lit(True).alias("f"))
    x = c.join(m, ["page", "idx"], "left").join(f, ["page", "idx"], "left")
    return x.select("page", "idx", F.when(F.col("m"), "marker").when(F.col("f"), "flanked").otherwise("kept").alias("verdict"))


@query("r18_recovered_digest", """
with m1 as (select l_partkey as type, l_orderkey * 8 + l_linenumber as op from lineitem where l_discount < 0.03), m2 as (select distinct l_orderkey * 8 + l_linenumber as op from lineitem where l_tax < 0.02),
lost as (select distinct type from m1 join m2 using (op)), rec as (select type, op from m1 where type in (select type from lost) and op not in (select op from m2))
select type, count(*) as ops, min(op) as first_op, substr(sha256(string_agg(cast(op as varchar), ',' order by op)), 1, 16) as digest from rec group by type""")
def r18(v):
    """Operations that fusion took from a first-method type and gave to no other, with a digest of them."""
    from ..operators.linetypes import fuse

    x = v.table("lineitem").withColumn("op", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    rec = fuse(x.filter("l_discount < 0.03").select(F.col("l_partkey").alias("type"), "op"), x.filter("l_tax < 0.02").select(F.lit(0).alias("type"), "op"))[1]
    ops = F.sort_array(F.collect_list("op"))
    return rec.groupBy("type").agg(F.count(F.lit(1)).alias("ops"), F.min("op").alias("first_op"), F.left(F.sha2(F.array_join(F.transform(ops, lambda o: o.cast("string")), ","), 256), F.lit(16)).alias("digest"))


@query("r44_input_gate", """
with a as (select page, count(*) as n, substr(sha1(string_agg(pos || ':' || length(line), ',' order by pos || ':' || length(line))), 1, 12) as sig from lines group by page),
b as (select page, count(*) as n, substr(sha1(string_agg(pos || ':' || length(line), ',' order by pos || ':' || length(line))), 1, 12) as sig from lines where page % 9 > 0 or pos > 0 group by page)
select a.page, b.page is not null and a.n = b.n and a.sig = b.sig as comparable from a left join b on a.page = b.page""", ("lines",))
def r44(v):
    """Operation numbers of two runs may be compared only where both read the same input."""
    key = F.concat("pos", F.lit(":"), F.length("line"))
    sign = lambda df, n: state.group_signature(df, ["page"], key).withColumnRenamed("sig", n)
    a, b = sign(v.lines, "a"), sign(v.lines.filter("page % 9 > 0 or pos > 0"), "b")
    return a.join(b, "page", "left").select("page", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("comparable"))


@query("r46_composed_violations", """
with m as (select 1 as method, l_partkey as type, l_orderkey * 8 + l_linenumber as op from lineitem where l_linenumber % 2 = 1 union all select 2, l_suppkey + 1000000, l_orderkey * 8 + l_linenumber from lineitem where l_linenumber % 2 = 0 or l_discount < 0.01),
o as (select op, count(distinct type) as types from m group by op), t as (select type, count(*) as members, count(distinct op) as ops, count(distinct method) as methods from m group by type)
select 'op in two types' as rule, count(*) as n from o where types > 1 union all select 'repeated member', count(*) from t where members > ops union all select 'two methods', count(*) from t where methods > 1 union all select 'types', count(*) from t""")
def r46(v):
    """Composed results, and how often they break what must hold."""
    x = v.table("lineitem").withColumn("op", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    one = x.filter("l_linenumber % 2 = 1").select(F.lit(1).alias("method"), F.col("l_partkey").alias("type"), "op")
    two = x.filter("l_linenumber % 2 = 0 or l_discount < 0.01").select(F.lit(2).alias("method"), (F.col("l_suppkey") + 1000000).alias("type"), "op")
    m = one.unionByName(two)
    o = m.groupBy("op").agg(F.countDistinct("type").alias("types"))
    t = m.groupBy("type").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("op").alias("ops"), F.countDistinct("method").alias("methods"))
    rule = lambda df, name, test: df.agg(F.count_if(F.expr(test)).alias("n")).select(F.lit(name).alias("rule"), "n")
    return rule(o, "op in two types", "types > 1").unionByName(rule(t, "repeated member", "members > ops")).unionByName(rule(t, "two methods", "methods > 1")).unionByName(rule(t, "types", "true"))


@query("r48_partitions_without_ids", """
with a as (select grp, substr(sha1(string_agg(cast(op_index as varchar), ',' order by cast(op_index as varchar))), 1, 12) as sig, count(*) as n from (select distinct grp, op_index from ops) group by grp),
b as (select 100 - grp as grp, substr(sha1(string_agg(cast(op_index as varchar), ',' order by cast(op_index as varchar))), 1, 12) as sig, count(*) as n from (select distinct case when op_index % 50 = 49 and grp > 5 then 0 else grp end as grp, op_index from ops) group by 1)
select coalesce(a.n, b.n) as n, a.grp as first_id, b.grp as second_id, a.grp is not null and b.grp is not null as same from a full join b on a.sig = b.sig""", ("ops",))
def r48(v):
    """Two partitions of operations matched by their members, whatever the parts are called."""
    p = v.ops.select("grp", "op_index").distinct()
    other = p.withColumn("grp", F.when((F.col("op_index") % 50 == 49) & (F.col("grp") > 5), 0).otherwise(F.col("grp")))
    sign = lambda df: state.group_signature(df, ["grp"], F.col("op_index").cast("string")).join(df.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "grp")
    a = sign(p).select("sig", F.col("grp").alias("first_id"), F.col("n").alias("n1"))
    b = sign(other).select("sig", (F.lit(100) - F.col("grp")).alias("second_id"), F.col("n").alias("n2"))
    x = a.join(b, "sig", "full")
    return x.select(F.coalesce("n1", "n2").alias("n"), "first_id", "second_id", (F.col("first_id").isNotNull() & F.col("second_id").isNotNull()).alias("same"))


_SEG = """s as (select grp, op_index, k, x as ax, y as ay, lead(x) over (partition by op_index order by k) as bx, lead(y) over (partition by op_index order by k) as "by" from ops)"""


@query("x11_angles_and_frame", f"""
with {_SEG}, a as (select op_index, k, atan2("by" - ay, bx - ax) as t from s where bx is not null),
u as (select op_index, abs(t - lag(t) over (partition by op_index order by k)) as d from a),
turn as (select op_index, sum(least(d, 2 * pi() - d)) as turn from u group by op_index),
f as (select op_index, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 as axis from ops group by op_index)
select f.op_index, round(turn.turn, 6) as turn, round(f.axis, 6) as axis from f join turn on f.op_index = turn.op_index""", ("ops",))
def x11(v):
    """Total turning along an operation, and the direction of its principal axis."""
    return geometry.turning(v.ops).join(geometry.principal_axis(v.ops), "op_index").select("op_index", F.round("turn", 6).alias("turn"), F.round("axis", 6).alias("axis"))


@query("x12_resampled", f"""
with {_SEG}, l as (select op_index, k, ax, ay, bx, "by", sqrt((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)) as len from s where bx is not null),
c as (select *, sum(len) over (partition by op_index order by k) - len as upto, sum(len) over (partition by op_index) as total from l),
t as (select op_index, j, total * j / 7 as at_ from (select distinct op_index, total from c) cross join (select unnest(range(0, 8)) as j)),
h as (select t.op_index, t.j, t.at_, c.*, row_number() over (partition by t.op_index, t.j order by c.k desc) as rk from t join c on c.op_index = t.op_index and (c.upto <= t.at_ or c.k = 0))
select op_index, j, round(ax + (bx - ax) * least(1, (at_ - upto) / len), 6) as x, round(ay + ("by" - ay) * least(1, (at_ - upto) / len), 6) as y from h where rk = 1""", ("ops",))
def x12(v):
    """Eight points at equal steps along an operation."""
    return geometry.resample(v.ops, 8).select("op_index", "j", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("x13_bezier", """
with c as (select op_index, k // 4 as curve, max(case when k % 4 = 0 then x end) as x0, max(case when k % 4 = 1 then x end) as x1, max(case when k % 4 = 2 then x end) as x2, max(case when k % 4 = 3 then x end) as x3,
  max(case when k % 4 = 0 then y end) as y0, max(case when k % 4 = 1 then y end) as y1, max(case when k % 4 = 2 then y end) as y2, max(case when k % 4 = 3 then y end) as y3 from ops group by 1, 2),
t as (select *, unnest([0.25, 0.5, 0.75])::double as t from c)
select op_index, curve, t, round((1 - t) * (1 - t) * (1 - t) * x0 + 3 * (1 - t) * (1 - t) * t * x1 + 3 * (1 - t) * t * t * x2 + t * t * t * x3, 9) as x,
  round((1 - t) * (1 - t) * (1 - t) * y0 + 3 * (1 - t) * (1 - t) * t * y1 + 3 * (1 - t) * t * t * y2 + t * t * t * y3, 9) as y from t""", ("ops",))
def x13(v):
    """Points of the cubic curves that four points each define."""
    at = lambda c: [F.max(F.when(F.col("k") % 4 == i, F.col(c))).alias(f"{c}{i}") for i in range(4)]
    c = v.ops.groupBy("op_index", F.floor(F.col("k") / 4).cast("int").alias("curve")).agg(*at("x"), *at("y"))
    c = c.withColumn("t", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    point = lambda c: F.round(geom.bezier(*(F.col(f"{c}{i}") for i in range(4)), F.col("t")), 9).alias(c)
    return c.select("op_index", "curve", "t", point("x"), point("y"))


@query("x14_matrix", """
select op_index, k, round((0.8 * x - 0.6 * y + 0.1) * 2 + 1, 9) as x, round((0.6 * x + 0.8 * y - 0.2) * 3 - 1, 9) as y from (select op_index, k, cast(x as double) as x, cast(y as double) as y from ops)""", ("ops",))
def x14(v):
    """A turn and a shift, then a scaling: two matrices (a, b, c, d, e, f) as one."""
    m = geom.compose((0.8, 0.6, -0.6, 0.8, 0.1, -0.2), (2.0, 0.0, 0.0, 3.0, 1.0, -1.0))
    x, y = geom.apply_matrix(m, F.col("x"), F.col("y"))
    return v.ops.select("op_index", "k", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"))


@query("x15_contour_gap", """
with n as (select grp, op_index, lead(op_index) over (partition by grp order by op_index) as other from (select distinct grp, op_index from ops)),
b as (select op_index, max(x) - min(x) as w, max(y) - min(y) as h from ops group by op_index)
select n.op_index, n.other, round(min(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))), 9) as gap, round(max(sqrt(b.w * b.w + b.h * b.h)), 9) as diagonal
from n join ops p on p.op_index = n.op_index join ops q on q.op_index = n.other join b on b.op_index = n.op_index group by 1, 2""", ("ops",))
def x15(v):
    """Least distance between the points of an operation and of the next of its group, and the diagonal of its box."""
    nxt = F.lead("op_index").over(Window.partitionBy("grp").orderBy("op_index"))
    n = v.ops.select("grp", "op_index").distinct().withColumn("other", nxt).filter("other is not null").select("op_index", "other")
    return geometry.contour_gap(v.ops, n).select("op_index", "other", F.round("gap", 9).alias("gap"), F.round("diagonal", 9).alias("diagonal"))


@query("r14_segment_alignment", f"""
with {_SEG}, g as (select grp, op_index, k, ax, ay, bx, "by", sqrt((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)) as len from s where bx is not null),
n as (select grp, op_index, lead(op_index) over (partition by grp order by op_index) as other from (select distinct grp, op_index from ops)),
p as (select n.op_index, n.other, a.k as i, b.k as j, {{d}} as d2, abs(((a.bx - a.ax) * (b.bx - b.ax) + (a."by" - a.ay) * (b."by" - b.ay)) / (a.len * b.len)) as dot_ from n join g a on a.op_index = n.op_index join g b on b.op_index = n.other)
select op_index, other, round(sqrt(min(d2)), 6) as distance, round(arg_min(dot_, (round(d2, 12), i, j)), 6) as dot from p group by 1, 2""".replace("{d}", "least(" + ", ".join(
    "((({p}x - {s}.ax) - {t} * ({s}.bx - {s}.ax)) * (({p}x - {s}.ax) - {t} * ({s}.bx - {s}.ax)) + (({p}y - {s}.ay) - {t} * ({s}.\"by\" - {s}.ay)) * (({p}y - {s}.ay) - {t} * ({s}.\"by\" - {s}.ay)))".replace(
        "{t}", "least(1, greatest(0, (({p}x - {s}.ax) * ({s}.bx - {s}.ax) + ({p}y - {s}.ay) * ({s}.\"by\" - {s}.ay)) / ({s}.len * {s}.len)))").replace("{p}x", px).replace("{p}y", py).replace("{s}", s)
    for px, py, s in (("a.ax", "a.ay", "b"), ("a.bx", 'a."by"', "b"), ("b.ax", "b.ay", "a"), ("b.bx", 'b."by"', "a"))) + ")"), ("ops",))
def r14(v):
    """The closest segments of an operation and the next of its group: their distance, and how parallel they are."""
    return geometry.segment_alignment(v.ops).select("op_index", "other", F.round("distance", 6).alias("distance"), F.round("dot", 6).alias("dot"))


@query("x16_shape_kind", """
with f as (select op_index, count(*) as n, sqrt((arg_min(x, k) - arg_max(x, k)) * (arg_min(x, k) - arg_max(x, k)) + (arg_min(y, k) - arg_max(y, k)) * (arg_min(y, k) - arg_max(y, k))) as ends, max(x) - min(x) as w, max(y) - min(y) as h from ops group by op_index)
select op_index, ends <= 0.25 * sqrt(w * w + h * h) as closed, case when least(w, h) <= 0 then 'line' when greatest(w, h) / least(w, h) <= 1.1 then 'round' when greatest(w, h) / least(w, h) <= 1.3 then 'box' else 'slim' end as kind from f""", ("ops",))
def x16(v):
    d = lambda c: F.min_by(c, "k") - F.max_by(c, "k")
    f = v.ops.groupBy("op_index").agg(F.sqrt(d("x") * d("x") + d("y") * d("y")).alias("ends"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    low, ratio = F.least("w", "h"), F.greatest("w", "h") / F.least("w", "h")
    kind = F.when(low <= 0, "line").when(ratio <= 1.1, "round").when(ratio <= 1.3, "box").otherwise("slim")
    return f.select("op_index", (F.col("ends") <= 0.25 * F.sqrt(F.col("w") * F.col("w") + F.col("h") * F.col("h"))).alias("closed"), kind.alias("kind"))


@query("x17_fnv1a", """
select p_partkey, list_reduce(list_prepend(cast(2166136261 as bigint), list_transform(string_split(p_type, ''), lambda c: cast(ord(c) as bigint))), lambda h, b: (xor(h, b) * 16777619) % 4294967296) as h from part""")
def x17(v):
    return v.table("part").select("p_partkey", text.fnv1a(F.col("p_type")).alias("h"))


@query("x18_strict_and_lenient_rows", """
with r as (select page, idx, try_cast(regexp_extract(text, '[0-9]+', 0) as bigint) as n from items)
select page, case when count(n) = count(*) then cast(sum(n) as varchar) end as strict, count(n) as lenient, count(*) - count(n) as dropped from r group by page""", ("items",))
def x18(v):
    """Strict: one bad row refuses the page; lenient: bad rows are dropped and counted."""
    n = F.expr("try_cast(nullif(regexp_extract(text, '[0-9]+', 0), '') as bigint)")
    x = v.items.select("page", n.alias("n")).groupBy("page").agg(F.count("n").alias("lenient"), F.count(F.lit(1)).alias("all"), F.try_sum(F.col("n").cast("decimal(38,0)")).alias("sum"))
    return x.select("page", F.when(F.col("lenient") == F.col("all"), F.col("sum").cast("string")).alias("strict"), "lenient", (F.col("all") - F.col("lenient")).alias("dropped"))
