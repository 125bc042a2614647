"""Stores, signatures, planners, set operations, scalar families, protocol checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geom, text
from ..functions.geom import Box
from ..functions.pages_spec import pages_of
from ..operators import linetypes, state
from .registry import NORM, UPPER, holds, query

_STORE = "case when page % 5 > 0 then 'v' || (page % 3) end"


@query("s09_json_default", "select event_id, case when event_id % 10 = 0 then -1 else coalesce(try_cast(json_extract_string(props, '$.k') as int), -1) end as k from events")
def s09(v):
    raw = F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.col("props"))
    return v.table("events").select("event_id", F.coalesce(F.from_json(raw, "k int", {"mode": "PERMISSIVE"})["k"], F.lit(-1)).alias("k"))


@query("s11_prefer_new", """
with b as (select page, symbol_index, 'new' as layer, category from symbols where category = 'shape' union all select page, symbol_index, 'old' as layer, 'legacy' as category from symbols),
r as (select *, row_number() over (partition by page, symbol_index order by layer) as rk from b) select page, symbol_index, layer, category from r where rk = 1""", ("symbols",))
def s11(v):
    new = v.symbols.filter("category = 'shape'").select("page", "symbol_index", "category")
    return state.prefer_new(new, v.symbols.select("page", "symbol_index", F.lit("legacy").alias("category")), ["page", "symbol_index"])


@query("s12_legacy_split", """
with o as (select o_orderkey as k, o_orderstatus as payload from orders), n as (select o_orderkey as k, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as payload from orders where o_orderkey % 3 > 0)
select case when n.k is null then 'written' when n.payload = o.payload then 'skipped' else 'kept' end as action, count(*) as n from o left join n on o.k = n.k group by 1""")
def s12(v):
    o = v.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("payload"))
    n = o.filter("k % 3 > 0").withColumn("payload", F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("payload")))
    return state.split_legacy(o, n, ["k"], "payload").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("s13_canonical_digest", "select page, substr(sha1(string_agg(idx || ':' || length(text), ',' order by idx || ':' || length(text))), 1, 12) as sig from items group by page", ("items",))
def s13(v):
    return state.group_signature(v.items, ["page"], F.concat("idx", F.lit(":"), F.length("text")))


@query("s14_cache_admission", "select page, count(*) as ops, count(*) <= 10000 and sum(length(line)) <= 16777216 as admitted from lines group by page", ("lines",))
def s14(v):
    return v.lines.groupBy("page").agg(F.count(F.lit(1)).alias("ops"), ((F.count(F.lit(1)) <= 10000) & (F.sum(F.length("line")) <= 16777216)).alias("admitted"))


@query("s16_resign", f"select page, substr(sha1({_STORE} || '|' || page), 1, 12) as sig from (select distinct page from lines) where page % 5 > 0", ("lines",))
def s16(v):
    p = v.lines.select("page").distinct().filter("page % 5 > 0")
    return p.select("page", state.signature(F.concat(F.lit("v"), (F.col("page") % 3).cast("string")), F.col("page")).alias("sig"))


@query("s18_overview", """
select d.source as slug, count(*) as pages, cast(sum(coalesce(s.n, 0)) as bigint) as symbols, max(d.n_chars) as largest from documents d left join (select page, count(*) as n from symbols group by page) s on d.doc_id = s.page group by d.source""", ("symbols",))
def s18(v):
    n = v.symbols.groupBy(F.col("page").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    x = v.table("documents").join(n, "doc_id", "left")
    return x.groupBy(F.col("source").alias("slug")).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.coalesce("n", F.lit(0))).alias("symbols"), F.max("n_chars").alias("largest"))


@query("s18_page_payload", """
select i.page, i.idx, i.text, s.symbol_index, s.category from items i left join symbols s on i.page = s.page and i.idx = s.text_index""", ("items", "symbols"))
def s18b(v):
    s = v.symbols.select("page", F.col("text_index").alias("idx"), "symbol_index", "category")
    return v.items.join(s, ["page", "idx"], "left").select("page", "idx", "text", "symbol_index", "category")


@query("s18_jobs", "select user_id as job, count(*) as steps, count(case when event_type = 'error' then 1 end) as errors, max(event_id) as last_step from events group by user_id")
def s18_jobs(v):
    return v.table("events").groupBy(F.col("user_id").alias("job")).agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("event_id").alias("last_step"))


@query("s18_models", "select model, count(*) as calls, min(event_id) as first_call from calls group by model", ("calls",))
def s18_models(v):
    return v.calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.min("event_id").alias("first_call"))


@query("s18_linetypes_all", """
select b.line_type_number as number, count(*) as terminals, count(case when residual then 1 end) as residual, count(distinct grp) as groups, round(min(distance), 4) as nearest from bindings b group by 1""", ("bindings",))
def s18_linetypes(v):
    return v.bindings.groupBy(F.col("line_type_number").alias("number")).agg(
        F.count(F.lit(1)).alias("terminals"), F.count_if("residual").alias("residual"), F.countDistinct("grp").alias("groups"), F.round(F.min("distance"), 4).alias("nearest"))


@query("s18_preset_target", "select source as slug, arg_min(doc_id, (n_chars = 0, doc_id)) as page from documents group by source")
def s18_preset(v):
    return v.table("documents").groupBy(F.col("source").alias("slug")).agg(F.min_by("doc_id", F.struct(F.col("n_chars") == 0, "doc_id")).alias("page"))


@query("s19_upload_tokens", "select user_id as token, min(event_id) as first_event, count(*) as uploads from events where event_type = 'signup' group by user_id")
def s19(v):
    return v.table("events").filter("event_type = 'signup'").groupBy(F.col("user_id").alias("token")).agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("uploads"))


@query("s20_pages_spec", """
with c as (select c_custkey as k, c_custkey % 9 + 1 as a, c_custkey % 5 + 1 as b from customer), p as (select k, unnest(range(least(a, b), greatest(a, b) + 1)) as page from c union all select k, 30 as page from c union all select k, 12 as page from c)
select k, string_agg(cast(page as varchar), ',' order by page) as pages from (select distinct k, page from p where page between 1 and 20) group by k""")
def s20(v):
    k = F.col("c_custkey")
    spec = F.concat((k % 9 + 1).cast("string"), F.lit("-"), (k % 5 + 1).cast("string"), F.lit(", 30 12"))
    return v.table("customer").select(k.alias("k"), F.array_join(F.transform(pages_of(spec, F.lit(20)), lambda p: p.cast("string")), ",").alias("pages"))


@query("s21_manifest_shards", """
select doc_id, stage, cast(floor((row_number() over (partition by lang, stage order by doc_id) - 1) / 64) as int) as shard from documents cross join (values ('text'), ('symbols'), ('arrows')) as s(stage)""")
def s21(v):
    x = v.table("documents").select("doc_id", "lang", F.explode(F.array(*map(F.lit, ("text", "symbols", "arrows")))).alias("stage"))
    w = Window.partitionBy("lang", "stage").orderBy("doc_id")
    return x.select("doc_id", "stage", F.floor((F.row_number().over(w) - 1) / 64).cast("int").alias("shard"))


_CUR = f"""w as (select distinct page, page % 3 as v, 'sig' || (page % 11) as sig from lines), st as (select page, case when page % 4 = 0 then v + 1 else v end as v, case when page % 7 = 0 then null else sig end as sig from w where page % 5 > 0),
own as (select w.page, case when st.page is null then 'missing' when w.v = st.v and st.sig is not null and w.sig = st.sig then 'current' else 'stale' end as state from w left join st on w.page = st.page)"""


def _own(v):
    w = v.lines.select("page").distinct().select("page", (F.col("page") % 3).alias("v"), F.concat(F.lit("sig"), (F.col("page") % 11).cast("string")).alias("sig"))
    st = w.filter("page % 5 > 0").select("page", F.when(F.col("page") % 4 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("v"), F.when(F.col("page") % 7 != 0, F.col("sig")).alias("sig"))
    return state.currency(w, st, ["page"], ["v", "sig"])


@query("j28_currency", f"with {_CUR} select page, state from own", ("lines",))
def j28(v):
    return _own(v).select("page", "state")


@query("j29_work_plan", f"with {_CUR} select page from own where page % 2 = 0 and state <> 'current'", ("lines",))
def j29(v):
    up = v.lines.select("page").distinct().withColumn("state", F.when(F.col("page") % 2 == 0, "current").otherwise("stale"))
    return state.work_list(up, _own(v), ["page"])


@query("r32_cost_precheck", f"with {_CUR} select state, count(*) as pages from own group by state", ("lines",))
def r32(v):
    return _own(v).groupBy("state").agg(F.count(F.lit(1)).alias("pages"))


@query("q09_prerequisite_chain", f"with {_CUR} select page, case when page % 6 = 0 then 'symbols-stale' when page % 10 = 1 then 'views-pending' when state <> 'current' then 'placements-stale' else 'ok' end as chain from own", ("lines",))
def q09(v):
    chain = F.when(F.col("page") % 6 == 0, "symbols-stale").when(F.col("page") % 10 == 1, "views-pending").when(F.col("state") != "current", "placements-stale").otherwise("ok")
    return _own(v).select("page", chain.alias("chain"))


@query("j23_legend_merge", """
with base as (select c_custkey as number, c_mktsegment as label from customer), sup as (select c_custkey as number, 'supervised' as label from customer where c_custkey % 4 = 0 union all select c_custkey + 100000000 as number, 'new' as label from customer where c_custkey % 50 = 0)
select coalesce(b.number, s.number) as number, coalesce(s.label, b.label) as label, s.number is not null as supervised from base b full join sup s on b.number = s.number""")
def j23(v):
    c = v.table("customer").select(F.col("c_custkey").alias("number"), F.col("c_mktsegment").alias("label"))
    sup = c.filter("number % 4 = 0").select("number", F.lit("supervised").alias("label")).unionByName(c.filter("number % 50 = 0").select((F.col("number") + 100000000).alias("number"), F.lit("new").alias("label")))
    return state.merge_rows(c.withColumn("supervised", F.lit(False)), sup.withColumn("supervised", F.lit(True)), ["number"], ["label", "supervised"])


@query("j24_full_verification", """
with a as (select o_orderkey as k, o_orderstatus as s, o_orderpriority as p from orders where o_orderkey % 11 > 0), b as (select o_orderkey as k, case when o_orderkey % 13 = 0 then null else o_orderstatus end as s, o_orderpriority as p from orders where o_orderkey % 9 > 0)
select coalesce(a.k, b.k) as k, case when b.k is null then 'missing' when a.k is null then 'extra' when a.s is not distinct from b.s and a.p is not distinct from b.p then 'equal' else 'differing' end as outcome from a full join b on a.k = b.k""")
def j24(v):
    o = v.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    b = o.filter("k % 9 > 0").withColumn("s", F.when(F.col("k") % 13 != 0, F.col("s")))
    return state.compare_rows(o.filter("k % 11 > 0"), b, ["k"], ["s", "p"])


_FUSE = """m1 as (select l_partkey as type, l_orderkey * 8 + l_linenumber as op from lineitem where l_quantity < 20), m2 as (select l_suppkey as type, l_orderkey * 8 + l_linenumber as op from lineitem where l_quantity between 19 and 20),
owned as (select distinct op from m2), lost as (select distinct type from m1 where op in (select op from owned))"""


def _methods(v):
    x = v.table("lineitem").withColumn("op", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return x.filter("l_quantity < 20").select(F.col("l_partkey").alias("type"), "op"), x.filter("l_quantity between 19 and 20").select(F.col("l_suppkey").alias("type"), "op")


@query("j25_fusion", f"with {_FUSE} select 1 as method, type, op from m1 where type not in (select type from lost) union all select 2 as method, type, op from m2")
def j25(v):
    return linetypes.fuse(*_methods(v))[0]


@query("j26_recovery", f"with {_FUSE} select type, op from m1 where type in (select type from lost) and op not in (select op from owned)")
def j26(v):
    return linetypes.fuse(*_methods(v))[1]


@query("j30_run_pairs", "select coalesce(a.page, b.page) as page, coalesce(a.tok, b.tok) as tok, a.page is not null as in_a, b.page is not null as in_b from run_a a full join run_b b on a.page = b.page and a.tok = b.tok", ("run_a", "run_b"))
def j30(v):
    b = v.run_b.select("page", "tok", F.lit(True).alias("b"))
    x = v.run_a.select("page", "tok", F.lit(True).alias("a")).join(b, ["page", "tok"], "full")
    return x.select("page", "tok", F.coalesce("a", F.lit(False)).alias("in_a"), F.coalesce("b", F.lit(False)).alias("in_b"))


@query("j31_report_diff", """
with a as (select page, count(*) as m from run_a group by page), b as (select page, count(*) as m from run_b group by page)
select coalesce(a.page, b.page) as page, a.m as before, b.m as after, case when a.m is null or b.m is null then 'info' when a.m = b.m then 'same' when b.m > a.m then 'better' else 'worse' end as outcome from a full join b on a.page = b.page""", ("run_a", "run_b"))
def j31(v):
    n = lambda df: df.groupBy("page").agg(F.count(F.lit(1)).alias("m"))
    return state.metric_diff(n(v.run_a), n(v.run_b), ["page"], "m")


@query("j32_stroke_regression", """
with b as (select least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b from lineitem where l_linenumber <= 3), n as (select least(l_suppkey, l_partkey) as a, greatest(l_suppkey, l_partkey) as b from lineitem where l_linenumber >= 2)
select a, b from b except all select a, b from n""")
def j32(v):
    x = v.table("lineitem").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"), "l_linenumber")
    return x.filter("l_linenumber <= 3").select("a", "b").exceptAll(x.filter("l_linenumber >= 2").select("a", "b"))


@query("u03_todo", f"with c as (select distinct {NORM.format(c='line')} as norm from lines) select norm from c where norm <> '' and length(norm) % 7 <> 0", ("lines",))
def u03(v):
    c = v.lines.select(text.norm_text(F.col("line")).alias("norm")).distinct()
    return c.filter("norm <> ''").exceptAll(c.filter(F.length("norm") % 7 == 0))


@query("u04_common_texts", "select tok from run_a intersect select tok from run_b", ("run_a", "run_b"))
def u04(v):
    return v.run_a.select("tok").intersect(v.run_b.select("tok"))


@query("u05_multiset_minus", "select category, claimed_group_index from symbols except all select category, claimed_group_index from symbols where symbol_index > 0", ("symbols",))
def u05(v):
    c = ["category", "claimed_group_index"]
    return v.symbols.select(c).exceptAll(v.symbols.filter("symbol_index > 0").select(c))


@query("u06_symmetric_pages", "(select page, 'a' as side from (select distinct page from symbols) where page not in (select page from run_b)) union all (select page, 'b' as side from (select distinct page from run_b) where page not in (select page from symbols))", ("symbols", "run_b"))
def u06(v):
    a, b = v.symbols.select("page").distinct(), v.run_b.select("page").distinct()
    return a.join(b, "page", "left_anti").withColumn("side", F.lit("a")).unionByName(b.join(a, "page", "left_anti").withColumn("side", F.lit("b")))


@query("u07_sweep_merge", """
with base as (select page, symbol_index, category, text_index from symbols), ch as (select page, symbol_index + 2 as symbol_index, 'sweep' as category, text_index from symbols where category = 'line')
select coalesce(b.page, c.page) as page, coalesce(b.symbol_index, c.symbol_index) as symbol_index, coalesce(c.category, b.category) as category, coalesce(c.text_index, b.text_index) as text_index from base b full join ch c on b.page = c.page and b.symbol_index = c.symbol_index""", ("symbols",))
def u07(v):
    base = v.symbols.select("page", "symbol_index", "category", "text_index")
    ch = base.filter("category = 'line'").select("page", (F.col("symbol_index") + 2).alias("symbol_index"), F.lit("sweep").alias("category"), "text_index")
    return state.merge_rows(base, ch, ["page", "symbol_index"], ["category", "text_index"])


@query("x01_string_family", f"""
select page, idx, {NORM.format(c='text')} as norm, {UPPER.format(c="regexp_replace(text, '\\s+', '', 'g')")} as code, left(text, 60) as preview, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from items""", ("items",))
def x01(v):
    t = F.col("text")
    return v.items.select("page", "idx", text.norm_text(t).alias("norm"), text.norm_code(t).alias("code"), text.preview(t).alias("preview"), text.slugify(t).alias("slug"))


@query("x02_codes", """
with c as (select o_orderkey as k, (o_custkey % 200) || '.' || (o_orderkey % 1100) as code, 's' || (o_custkey % 50) || ':' || (o_orderkey % 7) as key from orders)
select k, case when regexp_matches(code, '^\\d{1,3}\\.\\d{1,3}$') then cast(split_part(code, '.', 1) as int) end as major, case when regexp_matches(code, '^\\d{1,3}\\.\\d{1,3}$') then cast(split_part(code, '.', 2) as int) end as minor, cast(regexp_extract(key, '^s(\\d+):(\\d+)$', 1) as int) as symbol, cast(regexp_extract(key, '^s(\\d+):(\\d+)$', 2) as int) as placement from c""")
def x02(v):
    code = F.concat((F.col("o_custkey") % 200).cast("string"), F.lit("."), (F.col("o_orderkey") % 1100).cast("string"))
    key = F.concat(F.lit("s"), (F.col("o_custkey") % 50).cast("string"), F.lit(":"), (F.col("o_orderkey") % 7).cast("string"))
    x = v.table("orders").select(F.col("o_orderkey").alias("k"), code.alias("code"), key.alias("key"))
    (major, minor), (symbol, placement) = text.row_code(F.col("code")), text.placement_key(F.col("key"))
    return x.select("k", major.alias("major"), minor.alias("minor"), symbol.alias("symbol"), placement.alias("placement"))


@query("x03_geometry_family", """
select d.page, d.src_pos, round((d.y1 - d.y0) * (d.x1 - d.x0), 6) as area, round((d.y0 + d.y1) / 2, 6) as cy,
  round(greatest(0, least(d.y1, b.y1) - greatest(d.y0, b.y0)) * greatest(0, least(d.x1, b.x1) - greatest(d.x0, b.x0)) / least((d.y1 - d.y0) * (d.x1 - d.x0), (b.y1 - b.y0) * (b.x1 - b.x0)), 6) as share from detections d join boxes b on d.page = b.page and d.src_pos = b.pos""", ("detections", "boxes"))
def x03(v):
    b = v.boxes.select("page", F.col("pos").alias("src_pos"), *(F.col(c).alias(f"b_{c}") for c in ("y0", "x0", "y1", "x1")))
    x = v.detections.join(b, ["page", "src_pos"])
    r = lambda c: F.round(c, 6)
    return x.select("page", "src_pos", r(geom.area(Box())).alias("area"), r(geom.center(Box())[0]).alias("cy"), r(geom.overlap_of_smaller(Box(), Box("b"))).alias("share"))


@query("x04_time_family", "select event_id, floor(epoch_us(ts) / 1000000)::bigint % 86400 as second_of_day, date_diff('second', ts, (select max(ts) from events)) > 45 as stale from events")
def x04(v):
    e = v.table("events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    last = e.agg(F.max("us")).scalar()
    sec = lambda c: F.floor(c / 1000000)
    return e.select("event_id", (sec(F.col("us")) % 86400).alias("second_of_day"), (sec(last) - sec(F.col("us")) > 45).alias("stale"))


@query("x05_array_family", "select op_index, min(x) as lo, max(x) as hi, arg_min(x, k) as first, arg_max(x, k) as last, round(sum(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 8) as length from (select *, lag(x) over w as px, lag(y) over w as py from ops window w as (partition by op_index order by k)) group by op_index", ("ops",))
def x05(v):
    p = v.ops.groupBy("op_index").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("p"))
    xs = F.transform("p", lambda s: s["x"])
    step = lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
    n = F.size("p")
    length = F.aggregate(F.zip_with(F.slice("p", F.lit(1), n - 1), F.slice("p", F.lit(2), n - 1), step), F.lit(0.0), lambda s, d: s + d)
    return p.select("op_index", F.array_min(xs).alias("lo"), F.array_max(xs).alias("hi"), F.get(xs, F.lit(0)).alias("first"), F.get(xs, n - 1).alias("last"), F.round(length, 8).alias("length"))


@query("x06_map_family", "select grp, cast(coalesce(sum(case when line_type_number = 1 then 1 end), 0) as bigint) as clicks, count(distinct line_type_number) as kinds from bindings group by grp", ("bindings",))
def x06(v):
    n = v.bindings.groupBy("grp", "line_type_number").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("line_type_number", "n"))).alias("m"))
    return m.select("grp", F.coalesce(F.try_element_at("m", F.lit(1)), F.lit(0)).alias("clicks"), F.size("m").cast("long").alias("kinds"))


@query("x07_hash_family", "select o_orderkey, substr(sha1(o_orderstatus || '|' || o_orderkey), 1, 12) as short, sha256(o_orderpriority) as long_, substr(sha1(o_orderpriority), 1, 16) as middle from orders")
def x07(v):
    return v.table("orders").select("o_orderkey", state.signature(F.col("o_orderstatus"), F.col("o_orderkey")).alias("short"), F.sha2("o_orderpriority", 256).alias("long_"), F.left(F.sha1("o_orderpriority"), F.lit(16)).alias("middle"))


@query("x08_json_recovery")
def x08(v):
    """Replies: fenced, wrapped in words, cut off; how many complete elements each gives."""
    j = F.concat(F.lit("["), F.to_json(F.struct(F.col("idx"), F.length("text").alias("n"))), F.lit(", "), F.to_json(F.struct("pos")), F.lit("]"))
    cut = F.when(F.col("idx") % 3 == 0, F.concat(F.lit("```json\n"), j, F.lit("\n```"))).when(F.col("idx") % 3 == 1, F.left(j, F.length(j) - 3)).otherwise(F.concat(F.lit("Here: "), j))
    return v.items.select("page", "idx", text.recover_json_array(cut).alias("rows"))


@query("x09_text_token")
def x09(v):
    return v.items.select("page", "idx", text.text_token(F.col("text")).alias("token"))


@query("q03_view_completeness", """
with got as (select page, group_index, case when page % 5 = 0 then '' else 'seen' end as reason from view_types where page % 6 > 0 union all select page, group_index, 'seen' as reason from view_types where page % 8 = 0),
g as (select page, group_index, count(*) as times, min(length(reason)) as shortest from got group by 1, 2), want as (select page, group_index from groups where kind = 'view')
select coalesce(w.page, g.page) as page, count(w.page) as expected, count(g.page) as got, bool_and(w.page is not null and g.page is not null and g.times = 1 and g.shortest > 0) as complete
from want w full join g on w.page = g.page and w.group_index = g.group_index group by 1""", ("groups", "view_types"))
def q03(v):
    """Exactly the expected indices, each once, with a reason that is not empty."""
    t = v.view_types.select("page", "group_index")
    got = t.filter("page % 6 > 0").withColumn("reason", F.when(F.col("page") % 5 == 0, "").otherwise("seen")).unionByName(t.filter("page % 8 = 0").withColumn("reason", F.lit("seen")))
    g = got.groupBy("page", "group_index").agg(F.count(F.lit(1)).alias("times"), F.min(F.length("reason")).alias("shortest"))
    x = v.groups.filter("kind = 'view'").select("page", "group_index", F.lit(1).alias("want")).join(g, ["page", "group_index"], "full")
    ok = F.coalesce((F.col("want") == 1) & (F.col("times") == 1) & (F.col("shortest") > 0), F.lit(False))
    return x.groupBy("page").agg(F.count("want").alias("expected"), F.count("times").alias("got"), F.bool_and(ok).alias("complete"))


@query("q06_marker_codes", f"""
with w as (select page, idx, y0, x0, y1, x1, {UPPER.format(c="split_part(text, ' ', 1)")} as first from items),
codes as (select w.page, w.first from w join symbols s on s.page = w.page and s.text_index = w.idx where s.category = 'shape' union select w.page, w.first from w join groups g on g.page = w.page and g.kind = 'legend' and {holds('g', 'w', 2)})
select w.page, w.idx, c.first is not null as is_code from w left join (select distinct page, first from codes where regexp_matches(first, '{text.MARKER_SHAPE}')) c on w.page = c.page and w.first = c.first""", ("items", "symbols", "groups"))
def q06(v):
    """Codes come from the shape symbols' texts and from the first words of legend rows."""
    from ..operators import pages

    w = v.items.select("page", "idx", "y0", "x0", "y1", "x1", text.upper(F.split_part("text", F.lit(" "), F.lit(1))).alias("first"))
    one = w.join(v.symbols.filter("category = 'shape'").select("page", F.col("text_index").alias("idx")), ["page", "idx"]).select("page", "first")
    two = pages.in_any(w, v.groups.filter("kind = 'legend'"), 2.0).select("page", "first")
    codes = one.unionByName(two).filter(F.col("first").rlike(text.MARKER_SHAPE)).distinct().withColumn("hit", F.lit(True))
    return w.join(codes, ["page", "first"], "left").select("page", "idx", F.coalesce("hit", F.lit(False)).alias("is_code"))


@query("q08_scope_signature", "select page, case when page % 9 = 0 then null else sig end as sig from (select page, substr(sha1(string_agg(group_index || '=' || kind, ',' order by group_index || '=' || kind)), 1, 12) as sig from groups group by page)", ("groups",))
def q08(v):
    s = state.group_signature(v.groups, ["page"], F.concat("group_index", F.lit("="), "kind"))
    return s.select("page", F.when(F.col("page") % 9 != 0, F.col("sig")).alias("sig"))


@query("q10_latest_tranche", """
with x as (select o_custkey as c, o_orderkey as t from orders), b as (select c, t, case when t - lag(t) over (partition by c order by t) > 64 then 1 else 0 end as brk from x), i as (select c, t, sum(brk) over (partition by c order by t rows unbounded preceding) as tr from b),
k as (select c, t, tr, max(tr) over (partition by c) as last, count(*) over (partition by c) as total, max(t) over (partition by c) - min(t) over (partition by c) as whole from i)
select c, count(*) as n, min(t) as first, count(*) >= cast(0.2 as double) * max(total) and max(t) - min(t) >= cast(0.005 as double) * max(whole) as usable from k where tr = last group by c""")
def q10(v):
    """The latest run of paints without a gap over 64, and whether it covers a fifth of them and enough of their span."""
    from ..operators.sequence import islands

    w, whole = Window.partitionBy("c").orderBy("t"), Window.partitionBy("c")
    x = v.table("orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("t"))
    i = islands(x, ["c"], ["t"], F.col("t") - F.lag("t").over(w) > 64, "tr").withColumn("last", F.max("tr").over(whole))
    i = i.withColumn("total", F.count(F.lit(1)).over(whole)).withColumn("whole", F.max("t").over(whole) - F.min("t").over(whole))
    n = F.count(F.lit(1))
    usable = (n >= F.lit(0.2) * F.max("total")) & (F.max("t") - F.min("t") >= F.lit(0.005) * F.max("whole"))
    return i.filter("tr = last").groupBy("c").agg(n.alias("n"), F.min("t").alias("first"), usable.alias("usable"))


@query("q11_style_tolerance", "select a.n_nationkey as a, b.n_nationkey as b from (select n_nationkey, n_regionkey, length(n_name) as p from nation) a join (select n_nationkey, n_regionkey, length(n_name) as p from nation) b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey and abs(a.p - b.p) <= 0.2 * greatest(a.p, b.p)")
def q11(v):
    n = v.table("nation").select("n_nationkey", "n_regionkey", F.length("n_name").alias("p"))
    a, b = n.select(F.col("n_nationkey").alias("a"), "n_regionkey", F.col("p").alias("pa")), n.select(F.col("n_nationkey").alias("b"), "n_regionkey", F.col("p").alias("pb"))
    return a.join(b, "n_regionkey").filter("a < b and abs(pa - pb) <= 0.2 * greatest(pa, pb)").select("a", "b")


@query("q12_result_invariants", """
with t as (select l_orderkey as type, count(*) as members, count(distinct l_linenumber) as distinct_members, max(l_linenumber) as claimed, min(l_linenumber) as first, min(l_quantity) as least from lineitem group by 1),
v as (select type, unnest([case when members <> claimed then 'count' end, case when distinct_members < members then 'repeated' end, case when first <> 1 then 'start' end, case when least <= 0 then 'empty member' end]) as rule from t)
select type, rule from v where rule is not null""")
def q12(v):
    """A row for each invariant that a result breaks."""
    t = v.table("lineitem").groupBy(F.col("l_orderkey").alias("type")).agg(
        F.count(F.lit(1)).alias("members"), F.countDistinct("l_linenumber").alias("own"), F.max("l_linenumber").alias("claimed"), F.min("l_linenumber").alias("first"), F.min("l_quantity").alias("least")
    )
    rules = {"count": "members <> claimed", "repeated": "own < members", "start": "first <> 1", "empty member": "least <= 0"}
    broken = F.array_compact(F.array(*(F.when(F.expr(test), name) for name, test in rules.items())))
    return t.select("type", F.explode(broken).alias("rule"))


@query("q14_partition_equality", """
with a as (select grp, string_agg(cast(event_id as varchar), ',' order by event_id) as members from bindings where residual group by grp), b as (select grp + 7 as grp, string_agg(cast(event_id as varchar), ',' order by event_id) as members from bindings where residual and grp % 17 > 0 group by grp)
select members from a except select members from b""", ("bindings",))
def q14(v):
    members = F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda e: e.cast("string")), ",").alias("members")
    a = v.bindings.filter("residual").groupBy("grp").agg(members).select("members")
    b = v.bindings.filter("residual and grp % 17 > 0").groupBy((F.col("grp") + 7).alias("grp")).agg(members).select("members")
    return a.subtract(b)


@query("q15_type_uid", "select l_suppkey as type, 'lt2_' || substr(sha256(string_agg(cast(l_orderkey as varchar), ',' order by cast(l_orderkey as varchar))), 1, 16) as uid from lineitem group by l_suppkey")
def q15(v):
    x = v.table("lineitem").groupBy(F.col("l_suppkey").alias("type"))
    keys = F.array_join(F.sort_array(F.collect_list(F.col("l_orderkey").cast("string"))), ",")
    return x.agg(F.concat(F.lit("lt2_"), F.left(F.sha2(keys, 256), F.lit(16))).alias("uid"))


@query("r01_anchor_rows", "select s.page, s.symbol_index, cast(t.ti as int) as ti, s.x0 + 4 * t.ti as tip_x, s.y0 as tip_y from symbols s join (values (0), (1), (2)) as t(ti) on t.ti <= s.symbol_index % 3", ("symbols",))
def r01(v):
    x = v.symbols.withColumn("ti", F.explode(F.sequence(F.lit(0), F.col("symbol_index") % 3)))
    return x.select("page", "symbol_index", "ti", (F.col("x0") + 4 * F.col("ti")).alias("tip_x"), F.col("y0").alias("tip_y"))


@query("r02_center_anchors", f"""
select s.page, s.symbol_index, (s.y0 + s.y1) / 2 as y, (s.x0 + s.x1) / 2 as x, -1 as ti from symbols s join items i on s.page = i.page and s.text_index = i.idx where not (regexp_matches(i.text, '{text.GATE}') and not regexp_matches(i.text, '{text.FENCE}'))""", ("symbols", "items"))
def r02(v):
    own = v.items.select("page", F.col("idx").alias("text_index"), "text")
    y, x = geom.center(Box())
    return v.symbols.join(own, ["page", "text_index"]).filter(~text.is_gate(F.col("text"))).select("page", "symbol_index", y.alias("y"), x.alias("x"), F.lit(-1).alias("ti"))


@query("r04_page_status", "select d.doc_id as page, case when s.n is null then 'no-anchors' else 'ready' end as status from documents d left join (select page, count(*) as n from symbols group by page) s on d.doc_id = s.page", ("symbols",))
def r04(v):
    n = v.symbols.groupBy("page").agg(F.count(F.lit(1)).alias("n"))
    x = v.table("documents").select(F.col("doc_id").alias("page")).join(n, "page", "left")
    return x.select("page", F.when(F.col("n").isNull(), "no-anchors").otherwise("ready").alias("status"))


@query("r05_types_payload", "select line_type_number, count(*) as bound, string_agg(cast(grp as varchar), ',' order by grp) as groups from (select distinct line_type_number, grp from bindings where not residual) group by 1", ("bindings",))
def r05(v):
    x = v.bindings.filter("not residual").select("line_type_number", "grp").distinct()
    return x.groupBy("line_type_number").agg(F.count(F.lit(1)).alias("bound"), F.array_join(F.transform(F.sort_array(F.collect_list("grp")), lambda g: g.cast("string")), ",").alias("groups"))


@query("r06_group_of_anchor", f"select s.page, s.symbol_index, coalesce(nullif({UPPER.format(c='i.text')}, ''), 's' || s.symbol_index) as grp from symbols s left join (select * from items where idx % 2 = 0) i on s.page = i.page and s.text_index = i.idx", ("symbols", "items"))
def r06(v):
    own = v.items.filter("idx % 2 = 0").select("page", F.col("idx").alias("text_index"), text.upper(F.col("text")).alias("tok"))
    x = v.symbols.join(own, ["page", "text_index"], "left")
    return x.select("page", "symbol_index", F.coalesce(F.nullif("tok", F.lit("")), F.concat(F.lit("s"), F.col("symbol_index").cast("string"))).alias("grp"))


@query("r08_reassignable", """
with t as (select grp, line_type_number, count(*) as votes, sum(distance) as w from bindings where not residual group by 1, 2), k as (select grp, line_type_number as winner from (select *, row_number() over (partition by grp order by votes desc, w, line_type_number) as rk from t) where rk = 1),
r as (select event_id, line_type_number as number, distance, event_id % 13 = 0 as center from bindings union all select event_id, line_type_number % 5 + 1, distance * 2, event_id % 13 = 0 from bindings union all select event_id, (line_type_number + 1) % 5 + 1, distance * 3, event_id % 13 = 0 from bindings)
select b.event_id, coalesce(bool_or(r.distance <= case when r.center then 48 else 36 end), false) as reassignable from bindings b join k on b.grp = k.grp left join r on r.event_id = b.event_id and r.number = k.winner group by b.event_id""", ("bindings",))
def r08(v):
    """The winner has to stand in the terminal's own ranked list, within 36 (centres: 48)."""
    from ..operators import votes

    k = votes.winners(votes.tally(v.bindings.filter("not residual"), ["grp"]), ["grp"]).select("grp", F.col("line_type_number").alias("winner"))
    n, d = F.col("line_type_number"), F.col("distance")
    ranked = F.array(*(F.struct(a.cast("int").alias("number"), b.alias("distance")) for a, b in ((n, d), (n % 5 + 1, d * 2), ((n + 1) % 5 + 1, d * 3))))
    limit = F.when(F.col("event_id") % 13 == 0, votes.MAX_CENTER).otherwise(votes.MAX_BIND)
    x = v.bindings.withColumn("ranked", ranked).join(k, "grp")
    return x.select("event_id", F.exists("ranked", lambda r: (r["number"] == F.col("winner")) & (r["distance"] <= limit)).alias("reassignable"))


@query("r23_marker_column", "select page, min(x0) as lo, max(x1) as hi from symbols where category = 'shape' group by page having count(*) >= 2", ("symbols",))
def r23(v):
    x = v.symbols.filter("category = 'shape'").groupBy("page").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"), F.count(F.lit(1)).alias("n"))
    return x.filter("n >= 2").drop("n")


@query("r25_gate_groups", "select page, group_index, kind from groups union all select page, group_index + 100 as group_index, 'legend' as kind from groups where kind = 'legend'", ("groups",))
def r25(v):
    g = v.groups.select("page", "group_index", "kind")
    return g.unionByName(g.filter("kind = 'legend'").withColumn("group_index", F.col("group_index") + 100))


@query("r29_departure_ratio", """
with e as (select d.page, d.src_pos, d.x1 - d.x0 as dx, d.y1 - d.y0 as dy, least(abs(d.x0 - b.x0), abs(d.x0 - b.x1)) as ex, least(abs(d.y0 - b.y0), abs(d.y0 - b.y1)) as ey from detections d join boxes b on d.page = b.page and d.src_pos = b.pos)
select page, src_pos, round(greatest(0, case when ex <= ey then dx else dy end) / sqrt(dx * dx + dy * dy), 6) as ratio from e""", ("detections", "boxes"))
def r29(v):
    b = v.boxes.select("page", F.col("pos").alias("src_pos"), *(F.col(c).alias(f"b_{c}") for c in ("y0", "x0", "y1", "x1")))
    e = v.detections.join(b, ["page", "src_pos"])
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    near = lambda c: F.least(F.abs(F.col(f"{c}0") - F.col(f"b_{c}0")), F.abs(F.col(f"{c}0") - F.col(f"b_{c}1")))
    return e.select("page", "src_pos", F.round(F.greatest(F.lit(0.0), F.when(near("x") <= near("y"), dx).otherwise(dy)) / F.sqrt(dx * dx + dy * dy), 6).alias("ratio"))


@query("r31_fit_metrics", "select page, round(max(y1) - min(y0), 6) as span, round(sum(y1 - y0) / (max(y1) - min(y0)), 6) as cover from boxes group by page", ("boxes",))
def r31(v):
    span = F.max("y1") - F.min("y0")
    return v.boxes.groupBy("page").agg(F.round(span, 6).alias("span"), F.round(F.sum(F.col("y1") - F.col("y0")) / span, 6).alias("cover"))


@query("r35_refresh_status", "select user_id as page, case when max(event_id) % 4 = 0 then 'running' when count(case when event_type = 'error' then 1 end) > 15 then 'waiting' else 'queued' end as status from events group by user_id")
def r35(v):
    status = F.when(F.max("event_id") % 4 == 0, "running").when(F.count_if(F.col("event_type") == "error") > 15, "waiting").otherwise("queued")
    return v.table("events").groupBy(F.col("user_id").alias("page")).agg(status.alias("status"))


@query("r37_retry_class", """
with m as (select event_id, case event_type when 'click' then 'TimeoutError: deadline 600 s' when 'view' then 'malformed JSON at 12' when 'purchase' then 'NameError: x' else 'quota exceeded' end as msg from events)
select event_id, case when regexp_matches(msg, '(?i)timeout|deadline') then 'timeout' when regexp_matches(msg, '(?i)malformed|json') then 'malformed' else 'final' end as class, try_cast(nullif(regexp_extract(msg, 'deadline (\\d+) s', 1), '') as int) as budget from m""")
def r37(v):
    t = F.col("event_type")
    msg = F.when(t == "click", "TimeoutError: deadline 600 s").when(t == "view", "malformed JSON at 12").when(t == "purchase", "NameError: x").otherwise("quota exceeded")
    m = v.table("events").select("event_id", msg.alias("msg"))
    kind = F.when(F.col("msg").rlike("(?i)timeout|deadline"), "timeout").when(F.col("msg").rlike("(?i)malformed|json"), "malformed").otherwise("final")
    return m.select("event_id", kind.alias("class"), F.nullif(F.regexp_extract("msg", r"deadline (\d+) s", 1), F.lit("")).cast("int").alias("budget"))


@query("r46_boundary_rows", """
with a as (select op_index, op_index // 16 as g from (select distinct op_index from ops)), b as (select op_index, op_index // 20 as g from (select distinct op_index from ops)),
ba as (select op_index from (select op_index, g <> lag(g) over (order by op_index) as brk from a) where brk), bb as (select op_index from (select op_index, g <> lag(g) over (order by op_index) as brk from b) where brk)
select op_index, 'only first' as side from (select op_index from ba except select op_index from bb) union all select op_index, 'only second' as side from (select op_index from bb except select op_index from ba)""", ("ops",))
def r46(v):
    ops = v.table("embeddings").select(F.col("vec_id").alias("op_index"))
    cut = lambda n: ops.filter(f"op_index > 0 and op_index % {n} = 0")
    a, b = cut(16), cut(20)
    return a.subtract(b).withColumn("side", F.lit("only first")).unionByName(b.subtract(a).withColumn("side", F.lit("only second")))
