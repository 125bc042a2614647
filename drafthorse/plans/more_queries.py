"""The remaining rows of the inventory: templates, supplements, audits, records, imports, comparisons."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geom, text
from ..functions.geom import Box
from ..operators import matching, pages, state
from ..operators.spatial import box_join
from .registry import GAP, holds, query


@query("j21_template_assignment")
def j21(v):
    """Symbols of a page to detections, one to one: candidates within 12, nearest first."""
    cost = geom.gap(Box("l"), Box("r"))
    p = box_join(v.symbols.select("page", "symbol_index", "y0", "x0", "y1", "x1"), v.detections, 12.0)
    p = p.select("page", F.col("l_symbol_index").alias("a"), F.col("r_src_pos").alias("b"), F.round(cost, 6).alias("cost"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return matching.assign(g[["a", "b", "cost"]]).assign(page=g["page"].iloc[0])[["page", "a", "b"]]

    return p.groupBy("page").applyInPandas(run, "page long, a int, b int")


@query("w15_edge_families", """
with recursive r as (select grp, op_index as key, round(sqrt(avg(x * x + y * y)), 9) as value from ops group by grp, op_index),
s as (select grp, list(value order by value, key) as v from r group by grp),
w(grp, lo, hi, step) as (select grp, v, v, 0 from s
  union all select grp, list_concat(lo[:at_], lo[at_ + 2:]), list_concat(hi[:at_ - 1], hi[at_ + 1:]), step + 1 from (
    select *, list_position(gaps, list_min(gaps)) as at_ from (select grp, lo, hi, step, list_transform(range(1, len(lo)), lambda i: hi[i + 1] - lo[i]) as gaps from w))
  where list_min(gaps) <= cast(0.002 as double)),
f as (select grp, arg_max(lo, step) as lo from w group by grp),
m as (select r.grp, r.key, len(list_filter(f.lo, lambda x: x <= r.value)) as part from r join f on r.grp = f.grp),
z as (select grp, part, cast(row_number() over (partition by grp order by min(key)) - 1 as int) as family from m group by grp, part having count(*) > 1)
select m.grp, m.key, z.family from m join z on m.grp = z.grp and m.part = z.part""", ("ops",))
def w15(v):
    size = F.round(F.sqrt(F.avg(F.col("x") * F.col("x") + F.col("y") * F.col("y"))), 9)
    rows = v.ops.groupBy("grp", F.col("op_index").alias("key")).agg(size.alias("value"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return matching.families(g[["key", "value"]], 0.002).assign(grp=g["grp"].iloc[0])[["grp", "key", "family"]]

    return rows.groupBy("grp").applyInPandas(run, "grp int, key long, family int")


@query("w18_discovery", """
with recursive a as (select l_orderkey % 20 as grp, l_partkey as atom, list(distinct l_suppkey % 10) as motifs from lineitem group by 1, 2),
t(grp, turn, taken) as (select distinct grp, 0, cast([] as bigint[]) from a
  union all select t.grp, t.turn + 1, list_append(t.taken, b.motif) from t, lateral (
    select motif from (select unnest(a.motifs) as motif from a where a.grp = t.grp and not list_has_any(a.motifs, t.taken)) group by motif having count(*) >= 3 order by count(*) desc, motif limit 1) b),
w as (select grp, arg_max(taken, turn) as taken from t group by grp),
h as (select a.grp, a.atom, list_filter(w.taken, lambda m: list_contains(a.motifs, m)) as hit, w.taken from a join w on a.grp = w.grp)
select grp, atom, hit[1] as motif, cast(list_position(taken, hit[1]) - 1 as int) as turn from h where len(hit) > 0""")
def w18(v):
    a = v.table("lineitem").groupBy((F.col("l_orderkey") % 20).alias("grp"), F.col("l_partkey").alias("atom")).agg(F.sort_array(F.collect_set(F.col("l_suppkey") % 10)).alias("motifs"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return matching.discover(g[["atom", "motifs"]], 3).assign(grp=g["grp"].iloc[0])[["grp", "atom", "motif", "turn"]]

    return a.groupBy("grp").applyInPandas(run, "grp long, atom long, motif long, turn int")


@query("j27_legend_priority", """
with s as (select page, symbol_index, text_index, y0, x0, y1, x1 from symbols), byt as (select s.page, s.symbol_index, min(i.idx) as k from s join items o on s.page = o.page and s.text_index = o.idx join items i on i.page = o.page and i.text = o.text and i.idx > o.idx group by 1, 2),
byo as (select s.page, s.symbol_index, min(d.src_pos) as k from s join detections d on s.page = d.page and greatest(s.y0 - d.y1, d.y0 - s.y1, s.x0 - d.x1, d.x0 - s.x1) <= 0 group by 1, 2)
select s.page, s.symbol_index, coalesce(byt.k, byo.k, s.symbol_index % 3) as cluster, case when byt.k is not null then 'text' when byo.k is not null then 'owner' else 'motif' end as by_ from s left join byt on s.page = byt.page and s.symbol_index = byt.symbol_index left join byo on s.page = byo.page and s.symbol_index = byo.symbol_index""", ("symbols", "items", "detections"))
def j27(v):
    i = v.items.select("page", "idx", "text")
    nxt = i.withColumn("k", F.lead("idx").over(Window.partitionBy("page", "text").orderBy("idx"))).filter("k is not null").select("page", F.col("idx").alias("text_index"), "k")
    byo = box_join(v.symbols.select("page", "symbol_index", "y0", "x0", "y1", "x1"), v.detections, 0.0).groupBy("page", F.col("l_symbol_index").alias("symbol_index")).agg(F.min("r_src_pos").alias("o"))
    x = v.symbols.join(nxt, ["page", "text_index"], "left").join(byo, ["page", "symbol_index"], "left")
    return x.select("page", "symbol_index", F.coalesce("k", "o", F.col("symbol_index") % 3).alias("cluster"), F.when(F.col("k").isNotNull(), "text").when(F.col("o").isNotNull(), "owner").otherwise("motif").alias("by_"))


@query("j33_supplement_merge", f"""
with base as (select * from detections where src_pos % 2 = 0), extra as (select * from detections where src_pos % 2 = 1), heads as (select * from base where greatest(y1 - y0, x1 - x0) <= 24),
ok as (select e.*, exists (select 1 from base b where b.page = e.page and {GAP.format(a='e', b='b')} <= 3) as same from extra e where exists (select 1 from base b where b.page = e.page and {GAP.format(a='e', b='b')} <= 60) and not exists (select 1 from heads h where h.page = e.page and {GAP.format(a='e', b='h')} <= 4 and {GAP.format(a='e', b='h')} > 3))
select page, src_pos, 'base' as origin from base union all select page, src_pos, case when same then 'upgrade' else 'supplement' end as origin from ok""", ("detections",))
def j33(v):
    """Extra strokes that touch the base and cross no head: within 3 of a known one they upgrade it, else they are new."""
    base, extra = v.detections.filter("src_pos % 2 = 0"), v.detections.filter("src_pos % 2 = 1")
    box = base.select("page", "y0", "x0", "y1", "x1")
    heads = box.filter(F.greatest(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")) <= 24)
    ok = box_join(extra, box, 60.0, how="left_semi")
    ok = box_join(ok, heads, 4.0, geom.gap(Box("l"), Box("r")) > 3, how="left_anti")
    same = box_join(ok, box, 3.0, how="left_semi").select("page", "src_pos", F.lit(True).alias("same"))
    ok = ok.join(same, ["page", "src_pos"], "left")
    return base.select("page", "src_pos", F.lit("base").alias("origin")).unionByName(ok.select("page", "src_pos", F.when(F.col("same"), "upgrade").otherwise("supplement").alias("origin")))


@query("q02_record_identity", "select o_orderkey, o_orderstatus in ('O', 'F') and o_totalprice > 0 as valid, o_orderpriority = '1-URGENT' and o_custkey % 2 = 0 as current from orders")
def q02(v):
    return v.table("orders").select("o_orderkey", (F.col("o_orderstatus").isin("O", "F") & (F.col("o_totalprice") > 0)).alias("valid"), ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_custkey") % 2 == 0)).alias("current"))


@query("q07_strip_codes", f"""
select i.page, i.idx, case when regexp_matches(split_part(i.text, ' ', 1), '{text.MARKER_SHAPE}') and exists (select 1 from detections d where d.page = i.page and {holds('d', 'i', 0)}) then trim(substr(i.text, length(split_part(i.text, ' ', 1)) + 1)) else i.text end as text from items i""", ("items", "detections"))
def q07(v):
    near = pages.in_any(v.items.select("page", "idx", "y0", "x0", "y1", "x1"), v.detections, 0.0).select("page", "idx", F.lit(True).alias("marked"))
    first = F.split_part("text", F.lit(" "), F.lit(1))
    x = v.items.join(near, ["page", "idx"], "left")
    cut = F.trim(F.substring(F.col("text"), F.length(first) + 1, F.length("text")))
    return x.select("page", "idx", F.when(first.rlike(text.MARKER_SHAPE) & F.coalesce("marked", F.lit(False)), cut).otherwise(F.col("text")).alias("text"))


@query("r03_owner_map", "select page, string_agg(symbol_index || '=' || text_index, ',' order by symbol_index) as owners from symbols group by page", ("symbols",))
def r03(v):
    s = F.array_sort(F.collect_list(F.struct("symbol_index", "text_index")))
    return v.symbols.groupBy("page").agg(F.array_join(F.transform(s, lambda p: F.concat(p["symbol_index"].cast("string"), F.lit("="), p["text_index"].cast("string"))), ",").alias("owners"))


@query("r07_terminal_run", "select event_id, coalesce(case when distance <= 36 then event_id // 100 end, event_id // 1000, -1) as run from bindings", ("bindings",))
def r07(v):
    near = F.when(F.col("distance") <= 36, F.floor(F.col("event_id") / 100))
    return v.bindings.select("event_id", F.coalesce(near, F.floor(F.col("event_id") / 1000), F.lit(-1).cast("long")).alias("run"))


@query("r09_legend_tally", """
with d as (select grp, event_id % 7 as symbol, line_type_number, min(distance) as distance from bindings group by 1, 2, 3), o as (select grp, symbol, arg_min(line_type_number, distance * 10 + line_type_number / 1000000) as number from d group by 1, 2)
select grp, number, count(*) as votes from o group by 1, 2""", ("bindings",))
def r09(v):
    o = v.bindings.groupBy("grp", (F.col("event_id") % 7).alias("symbol")).agg(F.min_by("line_type_number", F.struct("distance", "line_type_number")).alias("number"))
    return o.groupBy("grp", "number").agg(F.count(F.lit(1)).alias("votes"))


@query("r10_supervised_samples", "select page, symbol_index, substr(sha1(page || '|' || symbol_index || '|' || text_index), 1, 16) as sig from symbols where category = 'line'", ("symbols",))
def r10(v):
    return v.symbols.filter("category = 'line'").select("page", "symbol_index", state.signature(F.col("page"), F.col("symbol_index"), F.col("text_index"), size=16).alias("sig"))


@query("r11_audit_complete", "select page, count(*) = max(n) and min(pos) = 0 as complete, count(*) as seen from lines group by page", ("lines",))
def r11(v):
    n = F.count(F.lit(1))
    return v.lines.groupBy("page").agg(((n == F.max("n")) & (F.min("pos") == 0)).alias("complete"), n.alias("seen"))


@query("r12_flatten_types", "select l_suppkey as type, l_orderkey as anchor, c.c as bound from lineitem join (select l_suppkey as s, count(*) as c from lineitem where l_linenumber > 1 group by 1) c on l_suppkey = c.s where l_linenumber = 1")
def r12(v):
    x = v.table("lineitem")
    t = x.groupBy(F.col("l_suppkey").alias("type")).agg(F.collect_list(F.when(F.col("l_linenumber") == 1, F.col("l_orderkey"))).alias("anchors"), F.count_if(F.col("l_linenumber") > 1).alias("bound"))
    return t.filter("bound > 0").select("type", F.explode("anchors").alias("anchor"), "bound")


@query("r13_run_tips", "select op_index, arg_min(x, k) as x0, arg_min(y, k) as y0, arg_max(x, k) as x1, arg_max(y, k) as y1 from ops group by op_index", ("ops",))
def r13(v):
    return v.ops.groupBy("op_index").agg(F.min_by("x", "k").alias("x0"), F.min_by("y", "k").alias("y0"), F.max_by("x", "k").alias("x1"), F.max_by("y", "k").alias("y1"))


@query("r15_outside_samples", f"select d.page, d.src_pos from detections d where not exists (select 1 from groups g where g.page = d.page and g.kind = 'legend' and {holds('g', 'd', 0)})", ("detections", "groups"))
def r15(v):
    return pages.in_any(v.detections, v.groups.filter("kind = 'legend'"), 0.0, how="left_anti").select("page", "src_pos")


@query("r16_pattern_projection", """
with o as (select l_partkey as region, l_suppkey as type, l_orderkey * 8 + l_linenumber as op from lineitem)
select a.region, count(distinct b.type) as types, string_agg(distinct cast(b.type as varchar), ',' order by cast(b.type as varchar)) as numbers, count(*) as ops from o a join o b on a.op = b.op group by a.region""")
def r16(v):
    """Regions of one method to the types of the other that own their operations."""
    x = v.table("lineitem").withColumn("op", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    m = x.select("op", F.col("l_partkey").alias("region")).join(x.select("op", F.col("l_suppkey").alias("type")), "op")
    numbers = F.array_join(F.sort_array(F.collect_set(F.col("type").cast("string"))), ",")
    return m.groupBy("region").agg(F.countDistinct("type").alias("types"), numbers.alias("numbers"), F.count(F.lit(1)).alias("ops"))


@query("r21_line_identity", "select claimed_group_index, string_agg(category || n, ',' order by category) as classes from (select claimed_group_index, category, count(*) as n from symbols group by 1, 2) group by 1", ("symbols",))
def r21(v):
    c = v.symbols.groupBy("claimed_group_index", "category").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("claimed_group_index").agg(F.array_join(F.sort_array(F.collect_list(F.concat("category", F.col("n").cast("string")))), ",").alias("classes"))


@query("r26_cache_upgrade", "select user_id as k, count(case when coalesce(nullif(event_id % 3, 0), 1) = 2 then 1 end) as kept, count(*) as stored from events group by user_id")
def r26(v):
    version = F.coalesce(F.nullif(F.col("event_id") % 3, F.lit(0).cast("long")), F.lit(1).cast("long"))
    return v.table("events").groupBy(F.col("user_id").alias("k")).agg(F.count_if(version == 2).alias("kept"), F.count(F.lit(1)).alias("stored"))


@query("r27_debug_view", "select page, idx, case when length(text) < 3 then 'short' when length(text) > 400 then 'long' when not regexp_matches(text, '[A-Za-z]') then 'no letter' else 'candidate' end as reason from items", ("items",))
def r27(v):
    n = F.length("text")
    return v.items.select("page", "idx", pages.when_first((n < 3, "short"), (n > 400, "long"), (~F.col("text").rlike("[A-Za-z]"), "no letter"), otherwise="candidate").alias("reason"))


@query("r28_record_shapes", "select event_id, case when value > 90 then 'error' else 'ok' end as state, case when value > 90 then event_type end as message, case when value <= 90 then round(value, 2) end as result from events")
def r28(v):
    bad = F.col("value") > 90
    return v.table("events").select("event_id", F.when(bad, "error").otherwise("ok").alias("state"), F.when(bad, F.col("event_type")).alias("message"), F.when(~bad, F.round("value", 2)).alias("result"))


@query("r30_new_targets", f"""
select b.page, b.src_pos from detections b where b.src_pos % 2 = 1 and not exists (select 1 from detections a where a.page = b.page and a.src_pos % 2 = 0 and {GAP.format(a='a', b='b')} <= 3)""", ("detections",))
def r30(v):
    known = v.detections.filter("src_pos % 2 = 0").select("page", "y0", "x0", "y1", "x1")
    return box_join(v.detections.filter("src_pos % 2 = 1"), known, 3.0, how="left_anti").select("page", "src_pos")


@query("r33_import_verification", """
with want as (select c_custkey as k, substr(sha1(c_name || '|' || c_nationkey), 1, 12) as sig from customer), have as (select c_custkey as k, substr(sha1(c_name || '|' || (c_nationkey + case when c_custkey % 17 = 0 then 1 else 0 end)), 1, 12) as sig from customer where c_custkey % 19 > 0)
select case when h.k is null then 'missing' when w.sig = h.sig then 'equal' else 'differing' end as outcome, count(*) as n from want w left join have h on w.k = h.k group by 1""")
def r33(v):
    c = v.table("customer").select(F.col("c_custkey").alias("k"), "c_name", "c_nationkey")
    want = c.select("k", state.signature(F.col("c_name"), F.col("c_nationkey")).alias("sig"))
    have = c.filter("k % 19 > 0").select("k", state.signature(F.col("c_name"), F.col("c_nationkey") + F.when(F.col("k") % 17 == 0, 1).otherwise(0)).alias("sig"))
    return state.compare_rows(want, have, ["k"], ["sig"]).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("r34_refresh_candidates", "select doc_id as page, case when n_chars % 5 = 0 then 'missing' when n_chars % 7 = 0 then 'failed' else 'stale' end as why from documents where n_chars % 5 = 0 or n_chars % 7 = 0 or n_chars % 11 = 0")
def r34(v):
    n = F.col("n_chars")
    why = F.when(n % 5 == 0, "missing").when(n % 7 == 0, "failed").when(n % 11 == 0, "stale")
    return v.table("documents").select(F.col("doc_id").alias("page"), why.alias("why")).filter("why is not null")


@query("r36_producer_digest", "select substr(sha256(string_agg(p_brand || p_type, ',' order by p_brand || p_type)), 1, 16) as engine_version from (select distinct p_brand, p_type from part)")
def r36(v):
    x = v.table("part").select(F.concat("p_brand", "p_type").alias("s")).distinct()
    return x.agg(F.left(F.sha2(F.array_join(F.sort_array(F.collect_list("s")), ","), 256), F.lit(16)).alias("engine_version"))


@query("r38_usage_mapping", "select event_id, coalesce(tokens, 0) as input_tokens, coalesce(tokens, 0) % 10 as output_tokens, round((end_us - start_us) / cast(1000000 as double), 3) as seconds from calls", ("calls",))
def r38(v):
    t = F.coalesce("tokens", F.lit(0))
    return v.calls.select("event_id", t.alias("input_tokens"), (t % 10).alias("output_tokens"), F.round((F.col("end_us") - F.col("start_us")) / 1e6, 3).alias("seconds"))


@query("r41_carry_over", "select model, cast(sum(case when attempt = 0 then tokens else 0 end) as bigint) as baseline, cast(sum(tokens) as bigint) as total from (select model, event_id % 3 as attempt, tokens from calls) group by model", ("calls",))
def r41(v):
    return v.calls.groupBy("model").agg(F.sum(F.when(F.col("event_id") % 3 == 0, F.col("tokens")).otherwise(0)).alias("baseline"), F.sum("tokens").alias("total"))


@query("r45_corpus_comparison", """
with a as (select doc_id as k, lang as g from documents), b as (select doc_id as k, case when doc_id % 23 = 0 then 'xx' else lang end as g from documents where doc_id % 29 > 0)
select case when b.k is null then 'missing' when a.g = b.g then 'equal' else 'differing' end as class, count(*) as pages from a left join b on a.k = b.k group by 1""")
def r45(v):
    a = v.table("documents").select(F.col("doc_id").alias("k"), F.col("lang").alias("g"))
    b = a.filter("k % 29 > 0").withColumn("g", F.when(F.col("k") % 23 == 0, "xx").otherwise(F.col("g")))
    return state.compare_rows(a, b, ["k"], ["g"]).groupBy(F.col("outcome").alias("class")).agg(F.count(F.lit(1)).alias("pages"))


@query("r51_command_clusters", """
with d as (select distinct l_suppkey as type, l_partkey as op from lineitem), i as (select type, op, op - row_number() over (partition by type order by op) as k from d) select type, min(op) as start, max(op) + 1 as stop, count(*) as n from i group by type, k""")
def r51(v):
    d = v.table("lineitem").select(F.col("l_suppkey").alias("type"), F.col("l_partkey").alias("op")).distinct()
    x = d.withColumn("k", F.col("op") - F.row_number().over(Window.partitionBy("type").orderBy("op")))
    return x.groupBy("type", "k").agg(F.min("op").alias("start"), (F.max("op") + 1).alias("stop"), F.count(F.lit(1)).alias("n")).drop("k")


@query("r52_operation_index", "select o.op_index, max(o.grp) as grp, count(*) as points, max(e.label) as label from ops o join embeddings e on o.op_index = e.vec_id group by o.op_index", ("ops",))
def r52(v):
    e = v.table("embeddings").select(F.col("vec_id").alias("op_index"), "label")
    return v.ops.join(e, "op_index").groupBy("op_index").agg(F.max("grp").alias("grp"), F.count(F.lit(1)).alias("points"), F.max("label").alias("label"))
