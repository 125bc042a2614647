"""Aggregates, windows and sequences: votes, islands, roll-ups, peaks, geometry of operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geom import Box
from ..operators import linetypes, sequence, votes
from ..operators.spatial import box_join
from .registry import GAP, holds, query

@query("a01_vote_tally", "select grp, line_type_number, count(*) as votes, round(sum(distance), 4) as weight from bindings where not residual group by 1, 2", ("bindings",))
def a01(v):
    return votes.tally(v.bindings.filter("not residual"), ["grp"]).withColumn("weight", F.round("weight", 4))


_WIN = """t as (select grp, line_type_number, count(*) as votes, sum(distance) as weight from bindings where not residual group by 1, 2),
r as (select grp, line_type_number, votes, row_number() over (partition by grp order by votes desc, weight, line_type_number) as rk, max(votes) over (partition by grp) as most from t)"""


@query("a02_winner", f"with {_WIN} select grp, line_type_number, votes from r where rk = 1", ("bindings",))
def a02(v):
    return votes.winners(votes.tally(v.bindings.filter("not residual"), ["grp"]), ["grp"]).select("grp", "line_type_number", "votes")


@query("a04_tie_flag", f"with {_WIN} select grp, count(case when votes = most then 1 end) > 1 as tied from r group by grp", ("bindings",))
def a04(v):
    return votes.winners(votes.tally(v.bindings.filter("not residual"), ["grp"]), ["grp"]).select("grp", "tied")


_TERMINALS = """x as (select event_id, grp, distance / 10 as distance, case when residual then null else line_type_number end as owner, distance / 20 as owned_distance, line_type_number as owned_owner, event_id % 13 = 0 as is_center from bindings),
s as (select *, case when is_center and owned_distance <= 48 then 'bound' when is_center then 'too-far' when distance > 36 then 'too-far' when owner is not null then 'bound' when owned_distance <= 12 then 'bound' else 'residual' end as state from x),
n as (select *, case when state = 'bound' then case when is_center then owned_owner else coalesce(owner, owned_owner) end end as number from s)"""


def terminals(v):
    d = F.col("distance")
    return votes.verdicts(v.bindings.select(
        "event_id", "grp", (d / 10.0).alias("distance"), F.when(~F.col("residual"), F.col("line_type_number")).alias("owner"),
        (d / 20.0).alias("owned_distance"), F.col("line_type_number").alias("owned_owner"), (F.col("event_id") % 13 == 0).alias("is_center"),
    ))


@query("a03_terminal_verdicts", f"with {_TERMINALS} select event_id, state, number from n", ("bindings",))
def a03(v):
    return terminals(v).select("event_id", "state", "number")


@query("a03_group_binding", f"""with {_TERMINALS}, t as (select grp, number, count(*) as votes, sum(distance) as weight from n where state = 'bound' group by 1, 2),
w as (select grp, number as winner from (select *, row_number() over (partition by grp order by votes desc, weight, number) as rk from t) where rk = 1)
select n.event_id, w.winner, case when n.state = 'bound' and n.number <> w.winner then 'reassigned' else n.state end as final_state from n left join w on n.grp = w.grp""", ("bindings",))
def a03b(v):
    return votes.group_binding(terminals(v), ["grp"]).select("event_id", "winner", "final_state")


@query("a05_legend_summary", """
with d as (select grp, event_id % 7 as symbol, line_type_number as number, min(distance) as distance from bindings where not residual group by 1, 2, 3),
s as (select grp, symbol, count(*) as numbers, min(number) as number from d group by 1, 2), g as (select grp, count(distinct number) as kinds, min(number) as only from d group by grp)
select g.grp, g.kinds > 1 as conflict, case when g.kinds = 1 then g.only end as winner, count(case when s.numbers > 1 then 1 end) as ambiguous_symbols, count(case when s.numbers = 1 then 1 end) as votes from g join s on g.grp = s.grp group by 1, 2, 3""", ("bindings",))
def a05(v):
    d = v.bindings.filter("not residual").groupBy("grp", (F.col("event_id") % 7).alias("symbol")).agg(F.collect_set("line_type_number").alias("numbers"))
    x = d.groupBy("grp").agg(F.array_distinct(F.flatten(F.collect_list("numbers"))).alias("all"), F.count_if(F.size("numbers") > 1).alias("ambiguous_symbols"), F.count_if(F.size("numbers") == 1).alias("votes"))
    return x.select("grp", (F.size("all") > 1).alias("conflict"), F.when(F.size("all") == 1, F.get("all", F.lit(0))).alias("winner"), "ambiguous_symbols", "votes")


@query("a06_center_consensus", """
with c as (select grp, event_id % 5 as placement, line_type_number as number, min(cast(round(distance * 100) as bigint)) as d from bindings where not residual and event_id % 3 > 0 group by 1, 2, 3),
f as (select *, row_number() over (partition by grp, placement order by d, number) = 1 as first from c),
n as (select grp, count(distinct placement) as placements from c group by grp),
t as (select grp, number, count(*) as coverage, count(case when first then 1 end) as first_votes, cast(sum(d) as bigint) as d from f group by 1, 2),
r as (select t.*, n.placements, max(coverage) over (partition by t.grp) as best from t join n on t.grp = n.grp),
k as (select *, rank() over (partition by grp order by first_votes desc, d) as rk from r where coverage = best and best >= 2 and best * 2 > placements)
select grp, min(number) as winner from k where rk = 1 group by grp having count(*) = 1""", ("bindings",))
def a06(v):
    c = v.bindings.filter("not residual and event_id % 3 > 0").groupBy("grp", (F.col("event_id") % 5).alias("placement"), F.col("line_type_number").alias("number")).agg(F.min(F.round(F.col("distance") * 100).cast("long")).alias("d"))
    first = F.row_number().over(Window.partitionBy("grp", "placement").orderBy("d", "number")) == 1
    n = c.groupBy("grp").agg(F.countDistinct("placement").alias("placements"))
    t = c.withColumn("first", first).groupBy("grp", "number").agg(F.count(F.lit(1)).alias("coverage"), F.count_if("first").alias("first_votes"), F.sum("d").alias("d")).join(n, "grp")
    best = F.max("coverage").over(Window.partitionBy("grp"))
    k = t.withColumn("best", best).filter("coverage = best and best >= 2 and best * 2 > placements")
    k = k.withColumn("rk", F.rank().over(Window.partitionBy("grp").orderBy(F.desc("first_votes"), "d"))).filter("rk = 1")
    return k.groupBy("grp").agg(F.min("number").alias("winner"), F.count(F.lit(1)).alias("n")).filter("n = 1").select("grp", "winner")


@query("a07_visible_numbers", f"""with {_TERMINALS} select number, count(distinct grp) as groups, count(*) as terminals from n where state = 'bound' group by number""", ("bindings",))
def a07(v):
    return terminals(v).filter("state = 'bound'").groupBy("number").agg(F.countDistinct("grp").alias("groups"), F.count(F.lit(1)).alias("terminals"))


@query("a08_gallery_rollup", """
with s as (select page, count(*) as symbols from symbols group by page), d as (select page, count(*) as detections from detections group by page), p as (select doc_id as page, source from documents),
x as (select p.source, p.page, coalesce(s.symbols, 0) as symbols, coalesce(d.detections, 0) as detections from p left join s using (page) left join d using (page))
select source, page, cast(sum(symbols) as bigint) as symbols, cast(sum(detections) as bigint) as detections from x group by rollup(source, page)""", ("symbols", "detections"))
def a08(v):
    n = lambda df, name: df.groupBy("page").agg(F.count(F.lit(1)).alias(name))
    p = v.table("documents").select("source", F.col("doc_id").alias("page"))
    x = p.join(n(v.symbols, "symbols"), "page", "left").join(n(v.detections, "detections"), "page", "left").fillna(0)
    return x.rollup("source", "page").agg(F.sum("symbols").alias("symbols"), F.sum("detections").alias("detections"))


@query("a09_overview", """
with r as (select source as slug, count(*) as pages from documents group by source), running as (select 'run-' || n_name as slug from nation)
select slug, pages from r union all select slug, 0 as pages from running order by slug""")
def a09(v):
    r = v.table("documents").groupBy(F.col("source").alias("slug")).agg(F.count(F.lit(1)).alias("pages"))
    return r.unionByName(v.table("nation").select(F.concat(F.lit("run-"), "n_name").alias("slug"), F.lit(0).cast("long").alias("pages"))).orderBy("slug")


@query("a10_page_health", """
with s as (select user_id as page, event_type as stage, max(case when value > 95 then 2 when value > 80 then 1 else 0 end) as bad from events group by 1, 2)
select stage, case bad when 2 then 'failed' else 'pending' end as state, count(*) as pages, min(page) as first_page, max(page) as last_page from s where bad > 0 group by 1, 2""")
def a10(v):
    bad = F.when(F.col("value") > 95, 2).when(F.col("value") > 80, 1).otherwise(0)
    s = v.table("events").groupBy(F.col("user_id").alias("page"), F.col("event_type").alias("stage")).agg(F.max(bad).alias("bad")).filter("bad > 0")
    return s.groupBy("stage", F.when(F.col("bad") == 2, "failed").otherwise("pending").alias("state")).agg(F.count(F.lit(1)).alias("pages"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


@query("a10_health_pivot", """
select user_id as page, count(case when event_type = 'click' then 1 end) as click, count(case when event_type = 'view' then 1 end) as view, count(case when event_type = 'purchase' then 1 end) as purchase from events where value > 80 group by user_id""")
def a10b(v):
    x = v.table("events").filter("value > 80").groupBy(F.col("user_id").alias("page"))
    return x.pivot("event_type", ["click", "view", "purchase"]).agg(F.count(F.lit(1))).fillna(0)


@query("a11_symbol_metrics", f"""
with o as (select distinct s.page, s.symbol_index from symbols s join groups g on s.page = g.page and {holds('g', 's', 2)}),
f as (select distinct s.page, s.symbol_index from symbols s join detections d on s.page = d.page and least(s.y1, d.y1) - greatest(s.y0, d.y0) >= 0.5 * (s.y1 - s.y0) and least(s.x1, d.x1) - greatest(s.x0, d.x0) >= 0.5 * (s.x1 - s.x0) and {GAP.format(a='s', b='d')} <= 0)
select s.page, count(*) as symbols, count(i.idx) as paired, count(*) - count(i.idx) as unpaired, count(*) - count(distinct (s.y0, s.x0, s.y1, s.x1)) as dup_boxes, count(case when s.y0 >= i.y0 and s.y1 <= i.y1 and s.x0 >= i.x0 and s.x1 <= i.x1 then 1 end) as in_text,
  count(*) - count(o.symbol_index) as outside, count(f.symbol_index) as fits
from symbols s left join items i on s.page = i.page and s.text_index = i.idx left join o on o.page = s.page and o.symbol_index = s.symbol_index left join f on f.page = s.page and f.symbol_index = s.symbol_index group by s.page""", ("symbols", "items", "groups", "detections"))
def a11(v):
    from ..functions.geom import holds_center

    box = ["y0", "x0", "y1", "x1"]
    l, r = Box("l"), Box("r")
    s = v.symbols.select("page", "symbol_index", *box)
    o = box_join(s, v.groups.select("page", *box), 2.0, holds_center(r, l, 2.0), cell=250.0, how="left_semi").select("page", "symbol_index", F.lit(1).alias("o"))
    half = (F.least(l.y1, r.y1) - F.greatest(l.y0, r.y0) >= 0.5 * (l.y1 - l.y0)) & (F.least(l.x1, r.x1) - F.greatest(l.x0, r.x0) >= 0.5 * (l.x1 - l.x0))
    f = box_join(s, v.detections.select("page", *box), 0.0, half, how="left_semi").select("page", "symbol_index", F.lit(1).alias("f"))
    i = v.items.select("page", F.col("idx").alias("text_index"), *(F.col(c).alias(f"i_{c}") for c in box))
    x = v.symbols.join(i, ["page", "text_index"], "left").join(o, ["page", "symbol_index"], "left").join(f, ["page", "symbol_index"], "left")
    inside = (F.col("y0") >= F.col("i_y0")) & (F.col("y1") <= F.col("i_y1")) & (F.col("x0") >= F.col("i_x0")) & (F.col("x1") <= F.col("i_x1"))
    n, paired = F.count(F.lit(1)), F.count("i_y0")
    return x.groupBy("page").agg(
        n.alias("symbols"), paired.alias("paired"), (n - paired).alias("unpaired"), (n - F.countDistinct("y0", "x0", "y1", "x1")).alias("dup_boxes"), F.count_if(inside).alias("in_text"),
        (n - F.count("o")).alias("outside"), F.count("f").alias("fits"),
    )


@query("a12_pooled_median", "select page % 10 as project, round(median(x1 - x0), 4) as width from boxes group by 1", ("boxes",))
def a12(v):
    return v.boxes.groupBy((F.col("page") % 10).alias("project")).agg(F.round(F.median(F.col("x1") - F.col("x0")), 4).alias("width"))


@query("a13_totals_merge", "select coalesce(source, '') as project, count(*) as pages, cast(sum(n_chars) as bigint) as chars, median(n_chars) as middle from documents group by rollup(source)")
def a13(v):
    x = v.table("documents").rollup("source").agg(F.count(F.lit(1)).alias("pages"), F.sum("n_chars").alias("chars"), F.median("n_chars").alias("middle"))
    return x.select(F.coalesce("source", F.lit("")).alias("project"), "pages", "chars", "middle")


_IOU = "(greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) * greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)))"


@query("a14_run_comparison", f"""
with p as (select a.page, {_IOU} / ((a.y1 - a.y0) * (a.x1 - a.x0) + (b.y1 - b.y0) * (b.x1 - b.x0) - {_IOU}) as iou, abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) as ey, abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) as ex from run_a a join run_b b on a.page = b.page and a.tok = b.tok)
select page, count(*) as paired, count(case when iou >= 0.5 then 1 end) as tight, count(case when iou < 0.5 and iou > 0 then 1 end) as partial, count(case when iou <= 0 then 1 end) as disjoint_, round(avg(iou), 6) as mean_iou,
  round(avg(sqrt(ex * ex + ey * ey)), 6) as center_error, round(100 * cast(count(case when iou >= 0.5 then 1 end) as double) / count(*), 3) as tight_percent from p group by page""", ("run_a", "run_b"))
def a14(v):
    from ..functions.geom import center, iou

    b = v.run_b.select("page", "tok", *(F.col(c).alias(f"b_{c}") for c in ("y0", "x0", "y1", "x1")))
    (ay, ax), (by, bx) = center(Box()), center(Box("b"))
    p = v.run_a.join(b, ["page", "tok"]).select("page", iou(Box(), Box("b")).alias("iou"), F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)).alias("off"))
    i, n = F.col("iou"), F.count(F.lit(1))
    tight = F.count_if(i >= 0.5)
    return p.groupBy("page").agg(
        n.alias("paired"), tight.alias("tight"), F.count_if((i < 0.5) & (i > 0)).alias("partial"), F.count_if(i <= 0).alias("disjoint_"), F.round(F.avg(i), 6).alias("mean_iou"),
        F.round(F.avg("off"), 6).alias("center_error"), F.round(100 * tight.cast("double") / n, 3).alias("tight_percent"),
    )


@query("a15_cost_ledger", """
select model, count(*) as calls, round(sum((end_us - start_us) / cast(1000000 as double)), 3) as seconds, cast(sum(tokens) as bigint) as tokens, round(sum(case when tokens <= 50 then tokens * cast(1.25 as double) else tokens * cast(2.5 as double) end / 1000000), 6) as usd from calls group by model""", ("calls",))
def a15(v):
    t = F.col("tokens")
    usd = F.when(t <= 50, t * F.lit(1.25)).otherwise(t * F.lit(2.5)) / 1e6
    return v.calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum((F.col("end_us") - F.col("start_us")) / 1e6), 3).alias("seconds"), F.sum("tokens").alias("tokens"), F.round(F.sum(usd), 6).alias("usd"))


@query("a16_peak_concurrency", """
with s as (select model, start_us as t, 1 as d from calls union all select model, end_us as t, -1 as d from calls), m as (select model, t, d, sum(d) as n from s group by 1, 2, 3),
o as (select model, sum(n) over (partition by model order by t, d rows unbounded preceding) as open from m) select model, cast(max(open) as bigint) as peak from o group by model""", ("calls",))
def a16(v):
    return sequence.peak_concurrency(v.calls, ["model"], "start_us", "end_us")


@query("a17_resume_merge", """
with a as (select model, event_id % 4 as attempt, count(*) as calls, max(end_us - start_us) as longest from calls group by 1, 2) select model, count(*) as attempts, cast(sum(calls) as bigint) as calls, max(longest) as longest from a group by model""", ("calls",))
def a17(v):
    a = v.calls.groupBy("model", (F.col("event_id") % 4).alias("attempt")).agg(F.count(F.lit(1)).alias("calls"), F.max(F.col("end_us") - F.col("start_us")).alias("longest"))
    return a.groupBy("model").agg(F.count(F.lit(1)).alias("attempts"), F.sum("calls").alias("calls"), F.max("longest").alias("longest"))


@query("a18_attribute_counter", "select p_brand as version, count(*) as n from part group by p_brand")
def a18(v):
    return v.table("part").groupBy(F.col("p_brand").alias("version")).agg(F.count(F.lit(1)).alias("n"))


@query("a19_stale_inventory", "select source, count(case when lang = 'en' then 1 end) as en, count(case when lang = 'de' then 1 end) as de, string_agg(cast(doc_id as varchar), ',' order by doc_id) as pages from documents where n_chars > 500 group by source")
def a19(v):
    x = v.table("documents").filter("n_chars > 500").groupBy("source")
    return x.agg(F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") == "de").alias("de"), F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda d: d.cast("string")), ",").alias("pages"))


@query("a20_nearest_spacing", """
with g as (select page, least(y0 - lag(y0) over w, lead(y0) over w - y0) as near from boxes window w as (partition by page order by y0)) select page, round(median(near), 6) as period from g where near is not null group by page""", ("boxes",))
def a20(v):
    w = Window.partitionBy("page").orderBy("y0")
    near = F.least(F.col("y0") - F.lag("y0").over(w), F.lead("y0").over(w) - F.col("y0"))
    return v.boxes.select("page", near.alias("near")).filter("near is not null").groupBy("page").agg(F.round(F.median("near"), 6).alias("period"))


@query("a21_box_union", "select page, min(y0) as y0, min(x0) as x0, max(y1) as y1, max(x1) as x1 from boxes group by page", ("boxes",))
def a21(v):
    return v.boxes.groupBy("page").agg(F.min("y0").alias("y0"), F.min("x0").alias("x0"), F.max("y1").alias("y1"), F.max("x1").alias("x1"))


@query("a22_interval_union", """
with x as (select page, x0, x1, max(x1) over (partition by page order by x0, x1 rows between unbounded preceding and 1 preceding) as m from boxes) select page, round(sum(greatest(0, x1 - greatest(x0, coalesce(m, x0)))), 4) as covered from x group by page""", ("boxes",))
def a22(v):
    return sequence.covered_length(v.boxes, ["page"], "x0", "x1").withColumn("covered", F.round("covered", 4))


_NINTHS = range(1, 10)


@query("a23_radial_quantiles", "select grp, " + ", ".join(f"round(quantile_cont(sqrt(x * x + y * y), 0.{i}), 8) as q{i}" for i in _NINTHS) + " from ops group by grp", ("ops",))
def a23(v):
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    q = F.percentile(r, F.array(*(F.lit(i / 10) for i in _NINTHS)))
    return v.ops.groupBy("grp").agg(q.alias("q")).select("grp", *(F.round(F.get("q", F.lit(i - 1)), 8).alias(f"q{i}") for i in _NINTHS))


@query("a24_spread", "select grp, round(stddev_pop(x), 8) as sx, round(avg(y), 8) as my, round(median(x), 8) as mx from ops group by grp", ("ops",))
def a24(v):
    return v.ops.groupBy("grp").agg(F.round(F.stddev_pop("x"), 8).alias("sx"), F.round(F.avg("y"), 8).alias("my"), F.round(F.median("x"), 8).alias("mx"))


@query("a25_class_multiset", """
with s as (select page, string_agg(category || ':' || n, ',' order by category) as sig from (select page, category, count(*) as n from symbols group by 1, 2) group by page) select sig, count(*) as pages, min(page) as first_page from s group by sig""", ("symbols",))
def a25(v):
    c = v.symbols.groupBy("page", "category").agg(F.count(F.lit(1)).alias("n"))
    s = c.groupBy("page").agg(F.array_join(F.sort_array(F.collect_list(F.concat("category", F.lit(":"), F.col("n").cast("string")))), ",").alias("sig"))
    return s.groupBy("sig").agg(F.count(F.lit(1)).alias("pages"), F.min("page").alias("first_page"))


@query("a26_unique_pairs", """
with p as (select a.page, a.idx, b.src_pos from items a join detections b on a.page = b.page and greatest(a.y0 - b.y1, b.y0 - a.y1, a.x0 - b.x1, b.x0 - a.x1) <= 5), c as (select *, count(*) over (partition by page, idx) as na, count(*) over (partition by page, src_pos) as nb from p)
select page, idx, src_pos from c where na = 1 and nb = 1""", ("items", "detections"))
def a26(v):
    p = box_join(v.items.select("page", "idx", "y0", "x0", "y1", "x1"), v.detections, 5.0).select("page", F.col("l_idx").alias("idx"), F.col("r_src_pos").alias("src_pos"))
    n = lambda c: F.count(F.lit(1)).over(Window.partitionBy("page", c))
    return p.withColumn("na", n("idx")).withColumn("nb", n("src_pos")).filter("na = 1 and nb = 1").select("page", "idx", "src_pos")


@query("a27_variants", "select split_part(source || '__' || lang, '__', 1) as base, count(distinct lang) as variants from documents group by 1")
def a27(v):
    slug = F.concat("source", F.lit("__"), "lang")
    return v.table("documents").groupBy(F.substring_index(slug, "__", 1).alias("base")).agg(F.countDistinct("lang").alias("variants"))


@query("w01_union_ordinal", """
with u as (select page, 0 as bucket, src_pos as ord from detections union all select page, 1 as bucket, pos as ord from boxes) select page, bucket, ord, cast(row_number() over (partition by page order by bucket, ord) - 1 as int) as idx from u""", ("detections", "boxes"))
def w01(v):
    u = v.detections.select("page", F.lit(0).alias("bucket"), F.col("src_pos").alias("ord")).unionByName(v.boxes.select("page", F.lit(1).alias("bucket"), F.col("pos").alias("ord")))
    return u.withColumn("idx", (F.row_number().over(Window.partitionBy("page").orderBy("bucket", "ord")) - 1).cast("int"))


@query("w03_line_fragments", """
with b as (select page, pos, x0, case when x0 - lag(x0) over (partition by page order by pos) > 25 then 1 else 0 end as brk from boxes) select page, pos, cast(sum(brk) over (partition by page order by pos rows unbounded preceding) as int) as fragment from b""", ("boxes",))
def w03(v):
    w = Window.partitionBy("page").orderBy("pos")
    return sequence.islands(v.boxes, ["page"], ["pos"], F.col("x0") - F.lag("x0").over(w) > 25, "fragment").select("page", "pos", "fragment")


@query("w05_sequential_groups", """
with f as (select op_index, max(case when k = 0 then x end) as sx, max(case when k = 0 then y end) as sy, max(case when k = 31 then x end) as ex, max(case when k = 31 then y end) as ey, max(grp) as grp from ops group by op_index),
b as (select *, case when (sx - lag(ex) over o) * (sx - lag(ex) over o) + (sy - lag(ey) over o) * (sy - lag(ey) over o) > 0.04 or op_index // 100 <> lag(op_index // 100) over o or op_index % 3 <> lag(op_index % 3) over o then 1 else 0 end as brk from f window o as (partition by grp order by op_index))
select op_index, cast(sum(brk) over (partition by grp order by op_index rows unbounded preceding) as int) as group_id from b""", ("ops",))
def w05(v):
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    f = v.ops.groupBy("op_index").agg(at(0, "x").alias("sx"), at(0, "y").alias("sy"), at(31, "x").alias("ex"), at(31, "y").alias("ey"), F.max("grp").alias("grp"))
    o = Window.partitionBy("grp").orderBy("op_index")
    dx, dy = F.col("sx") - F.lag("ex").over(o), F.col("sy") - F.lag("ey").over(o)
    # a new form (here: hundred) or style (number modulo 3) begins a group wherever its first point lies
    form, style = F.floor(F.col("op_index") / 100), F.col("op_index") % 3
    x = f.withColumn("brk", (dx * dx + dy * dy > 0.04) | (form != F.lag(form).over(o)) | (style != F.lag(style).over(o)))
    return sequence.islands(x, ["grp"], ["op_index"], F.col("brk"), "group_id").select("op_index", "group_id")


@query("w06_paint_batches", "select op_index, cast(dense_rank() over (partition by grp order by op_index // 4) as int) as batch from (select distinct grp, op_index from ops)", ("ops",))
def w06(v):
    x = v.ops.select("grp", "op_index").distinct()
    return x.select("op_index", F.dense_rank().over(Window.partitionBy("grp").orderBy(F.floor(F.col("op_index") / 4))).alias("batch"))


@query("w07_command_ranges", """
with d as (select distinct l_orderkey as grp, l_linenumber as n from lineitem), i as (select grp, n, n - row_number() over (partition by grp order by n) as k from d) select grp, min(n) as start, cast(max(n) + 1 as int) as stop from i group by grp, k""")
def w07(v):
    return sequence.ranges(v.table("lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("n")), ["grp"], "n")


_TIP = """t as (select grp, op_index as tip, x as px, y as py from ops where k = 0),
s as (select grp, op_index, k, x as ax, y as ay, lead(x) over (partition by grp, op_index order by k) as bx, lead(y) over (partition by grp, op_index order by k) as "by" from ops),
g as (select t.grp, t.tip, s.op_index, t.px, t.py, s.ax, s.ay, s.bx - s.ax as dx, s."by" - s.ay as dy from t join s on t.grp = s.grp and s.bx is not null and s.op_index <> t.tip),
c as (select *, case when dx * dx + dy * dy <= 1e-12 then 0 else least(1, greatest(0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) end as q from g),
m as (select grp, tip, op_index, min((px - (ax + q * dx)) * (px - (ax + q * dx)) + (py - (ay + q * dy)) * (py - (ay + q * dy))) as d2 from c group by 1, 2, 3),
r as (select *, row_number() over (partition by grp, tip order by round(d2, 12), op_index) as rank from m)"""


def _tips(v):
    return v.ops.filter("k = 0").select("grp", F.col("op_index").alias("tip"), F.col("op_index").alias("own"), F.col("x").alias("px"), F.col("y").alias("py"))


@query("j18_nearest_op", f"with {_TIP} select grp, tip, op_index, round(d2, 9) as d2 from r where rank = 1", ("ops",))
def j18(v):
    return linetypes.nearest_ops(_tips(v), linetypes.segments(v.ops), 1, near=0.002, cell=0.02).select("grp", "tip", "op_index", F.round("d2", 9).alias("d2"))


_OWNED = _TIP.replace("t.grp = s.grp and s.bx", "t.grp = s.grp and s.op_index % 3 = 0 and s.bx")


@query("j18_nearest_owned_op", f"with {_OWNED} select grp, tip, op_index, round(d2, 9) as d2 from r where rank = 1", ("ops",))
def j18_owned(v):
    """The nearest operation that a line type owns (here: number modulo 3 is 0)."""
    return linetypes.nearest_ops(_tips(v), linetypes.segments(v.ops.filter("op_index % 3 = 0")), 1, near=0.002, cell=0.02).select("grp", "tip", "op_index", linetypes.rounded(F.col("d2"), 9).alias("d2"))


@query("w08_top_candidates", f"with {_TIP} select grp, tip, op_index, cast(rank as int) as rank from r where rank <= 3", ("ops",))
def w08(v):
    return linetypes.nearest_ops(_tips(v), linetypes.segments(v.ops), 3, near=(0.0005, 0.002), cell=0.02).select("grp", "tip", "op_index", "rank")


@query("w08_center_candidates", f"with {_TIP}, n as (select op_index, cast(count(*) as int) as points from ops group by op_index), b as (select m.*, floor(sqrt(d2) / 0.001) as bucket, n.points from m join n on m.op_index = n.op_index), z as (select *, row_number() over (partition by grp, tip order by bucket, op_index % 3, op_index) as place from b) select grp, tip, op_index, cast(place as int) as place from z where place <= 3", ("ops",))
def w08_centers(v):
    """Centres take distances in steps of 0.001; of equal ones the type with fewer operations (here: number modulo 3) first."""
    best = linetypes.nearest_ops(
        _tips(v), linetypes.segments(v.ops), 3, near=0.002, cell=0.02,
        first=lambda d2: F.floor(F.sqrt(d2) / 0.001), ties=(F.col("op_index") % 3, "op_index"),
    )
    return best.select("grp", "tip", "op_index", F.col("rank").alias("place"))


@query("w09_block_selection", """
with b as (select page, group_index, case when cast(row_number() over (partition by page order by (group_index * 7 + page) % 3 desc, group_index) as int) <= 4 then 'run' else 'skipped' end as status from groups) select page, group_index, status from b""", ("groups",))
def w09(v):
    w = Window.partitionBy("page").orderBy(((F.col("group_index") * 7 + F.col("page")) % 3).desc(), "group_index")
    return v.groups.select("page", "group_index", F.when(F.row_number().over(w) <= 4, "run").otherwise("skipped").alias("status"))


@query("w10_row_bands", """
with m as (select page, symbol_index, y0, y1, lag(y1) over (partition by page order by y0, symbol_index) as up, lead(y0) over (partition by page order by y0, symbol_index) as down from symbols where category = 'shape')
select page, symbol_index, case when up is null then 0 else (up + y0) / 2 end as above, case when down is null then 1000 else (y1 + down) / 2 end as below from m""", ("symbols",))
def w10(v):
    """A marker's row reaches half-way to the markers above and below."""
    w = Window.partitionBy("page").orderBy("y0", "symbol_index")
    m = v.symbols.filter("category = 'shape'").withColumn("up", F.lag("y1").over(w)).withColumn("down", F.lead("y0").over(w))
    return m.select("page", "symbol_index", F.coalesce((F.col("up") + F.col("y0")) / 2.0, F.lit(0.0)).alias("above"), F.coalesce((F.col("y1") + F.col("down")) / 2.0, F.lit(1000.0)).alias("below"))


@query("w12_connected_runs", """
with recursive t as (select distinct l_suppkey as a, l_partkey + 1000000 as b from lineitem), e as (select a, b from t union all select b, a from t),
lab(node, l, step) as (select distinct a, a, 0 from e
  union all select node, min(l), step + 1 from (select node, l, step from lab where step < 24 union all select e.a, lab.l, lab.step from lab join e on e.b = lab.node where lab.step < 24) group by node, step)
select node as op_index, l as least from lab where step = 24""")
def w12(v):
    from ..operators.graph import connected_components

    e = v.table("lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1000000).alias("b"))
    return connected_components(e, "a", "b").select(F.col("node").alias("op_index"), F.col("component").alias("least"))


@query("w12_run_numbers", """
with s as (select p_partkey as op_index, p_size as page from part), b as (select *, case when op_index - lag(op_index) over (partition by page order by op_index) <= 40 then 0 else 1 end as brk from s),
c as (select *, sum(brk) over (partition by page order by op_index) as c from b), z as (select page, c, min(op_index) as least, count(*) as n from c group by 1, 2),
k as (select *, cast(row_number() over (partition by page order by n desc, least) - 1 as int) as run from z)
select c.page, c.op_index, k.run, k.n from c join k on k.page = c.page and k.c = c.c""")
def w12b(v):
    """Parts of a page at most 40 apart touch."""
    s = v.table("part").select(F.col("p_partkey").alias("op_index"), F.col("p_size").alias("page"))
    w = Window.partitionBy("page").orderBy("op_index")
    t = s.select(F.col("op_index").alias("b"), F.lag("op_index").over(w).alias("a")).filter("b - a <= 40")
    return linetypes.runs(t, s)


@query("w19_stable_order", "select page, idx, cast(row_number() over (partition by page order by y0, x0, idx) as int) as place from items", ("items",))
def w19(v):
    return v.items.select("page", "idx", F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0", "idx")).alias("place"))


@query("w20_hide_weak_twins", """
with x as (select page, idx, upper(replace(text, 'ß', 'ss')) as tok, idx % 3 = 0 as verified from items), f as (select *, max(case when verified then 1 else 0 end) over (partition by page, tok) as any_v, count(*) over (partition by page, tok) as n from x)
select page, idx, not verified and any_v = 1 and n > 1 as hidden from f""", ("items",))
def w20(v):
    from ..functions.text import upper

    w = Window.partitionBy("page", "tok")
    x = v.items.select("page", "idx", upper(F.col("text")).alias("tok"), (F.col("idx") % 3 == 0).alias("verified"))
    return x.select("page", "idx", (~F.col("verified") & F.bool_or("verified").over(w) & (F.count(F.lit(1)).over(w) > 1)).alias("hidden"))


@query("w21_parallel_repeats", f"""
with e as (select *, degrees(atan2(y1 - y0, x1 - x0)) as angle from boxes)
select a.page, a.pos from e a where exists (select 1 from e b where a.page = b.page and a.pos <> b.pos and {GAP.format(a='a', b='b')} <= 8 and abs(a.angle - b.angle) <= 8 and least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.5 * (a.x1 - a.x0))""", ("boxes",))
def w21(v):
    """Edges (a box's diagonal) with another one within 8, at most 8 degrees apart, along half of their length."""
    l, r = Box("l"), Box("r")
    e = v.boxes.select("page", "pos", "y0", "x0", "y1", "x1").withColumn("angle", F.degrees(F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))))
    test = (F.col("l_pos") != F.col("r_pos")) & (F.abs(F.col("l_angle") - F.col("r_angle")) <= 8) & (F.least(l.x1, r.x1) - F.greatest(l.x0, r.x0) >= 0.5 * (l.x1 - l.x0))
    return box_join(e, e, 8.0, test, how="left_semi").select("page", "pos")


@query("w22_opposite_neighbours", """
with n as (select a.page, a.idx, b.x0 - a.x0 as dx, b.y0 - a.y0 as dy, row_number() over (partition by a.page, a.idx order by (b.x0 - a.x0) * (b.x0 - a.x0) + (b.y0 - a.y0) * (b.y0 - a.y0), b.idx) as rk from items a join items b on a.page = b.page and a.idx <> b.idx and abs(a.y0 - b.y0) <= 40 and (a.x0 <> b.x0 or a.y0 <> b.y0)),
k as (select *, sqrt(dx * dx + dy * dy) as len from n where rk <= 16)
select distinct p.page, p.idx from k p join k q on p.page = q.page and p.idx = q.idx and p.rk < q.rk where (p.dx * q.dx + p.dy * q.dy) < cast(-0.75 as double) * p.len * q.len""", ("items",))
def w22(v):
    c = v.items.select("page", "idx", "y0", "x0")
    band = lambda y: F.floor(y / 40.0)
    a = c.withColumn("band", F.explode(F.array(band(F.col("y0")) - 1, band(F.col("y0")), band(F.col("y0")) + 1)))
    b = c.select("page", F.col("idx").alias("j"), F.col("y0").alias("by"), F.col("x0").alias("bx"), band(F.col("y0")).alias("band"))
    n = a.join(b, ["page", "band"]).filter("idx <> j and abs(y0 - by) <= 40 and (x0 <> bx or y0 <> by)").withColumn("dx", F.col("bx") - F.col("x0")).withColumn("dy", F.col("by") - F.col("y0"))
    size = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    k = n.withColumn("rk", F.row_number().over(Window.partitionBy("page", "idx").orderBy(size, "j"))).filter("rk <= 16").groupBy("page", "idx").agg(F.collect_list(F.struct("dx", "dy", F.sqrt(size).alias("len"))).alias("v"))
    opposite = F.exists("v", lambda p: F.exists("v", lambda q: p["dx"] * q["dx"] + p["dy"] * q["dy"] < F.lit(-0.75) * p["len"] * q["len"]))
    return k.filter(opposite).select("page", "idx")
