"""The sequential parts of line-type recognition: one task a page or group, order fixed by keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import linetypes
from ..session import materialize
from .registry import query


def _points(g: pd.DataFrame) -> np.ndarray:
    return g.sort_values("k")[["x", "y"]].to_numpy()


@query("w11_greedy_disjoint", """
with recursive m as (select page, symbol_index as match, list_transform(range(0, symbol_index % 4 + 1), lambda i: text_index + i) as members from symbols),
o as (select *, row_number() over (partition by page order by len(members) desc, match) as rn from m),
w(page, match, rn, kept, used) as (select page, match, rn, true, members from o where rn = 1
  union all select o.page, o.match, o.rn, not list_has_any(o.members, w.used), case when list_has_any(o.members, w.used) then w.used else list_concat(w.used, o.members) end from w join o on o.page = w.page and o.rn = w.rn + 1)
select page, match, kept from w""", ("symbols",))
def w11(v):
    """Matches are symbols, their members the items within four indices; larger matches first."""
    m = v.symbols.select("page", F.col("symbol_index").alias("match"), F.sequence(F.col("text_index"), F.col("text_index") + F.col("symbol_index") % 4).alias("members"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return linetypes.greedy_disjoint(g[["match", "members"]]).assign(page=g["page"].iloc[0])[["page", "match", "kept"]]

    return m.groupBy("page").applyInPandas(run, "page long, match int, kept boolean")


@query("w14_complete_link", """
with recursive r as (select grp, op_index as key, round(sqrt(avg(x * x + y * y)), 9) as value, row_number() over (partition by grp order by op_index) as rn from ops group by grp, op_index),
w(grp, key, rn, family, lo, hi) as (select grp, key, rn, cast(0 as int), [value], [value] from r where rn = 1
  union all select p.grp, p.key, p.rn, cast(p.at_ - 1 as int),
    case when p.at_ > len(p.lo) then list_append(p.lo, p.value) else list_transform(p.lo, lambda x, i: case when i = p.at_ then least(x, p.value) else x end) end,
    case when p.at_ > len(p.hi) then list_append(p.hi, p.value) else list_transform(p.hi, lambda x, i: case when i = p.at_ then greatest(x, p.value) else x end) end
  from (select q.*, case when coalesce(list_min(q.spread), 1) <= cast(0.05 as double) then list_position(q.spread, list_min(q.spread)) else len(q.lo) + 1 end as at_
    from (select r.grp, r.key, r.rn, r.value, w.lo, w.hi, list_transform(range(1, len(w.lo) + 1), lambda i: greatest(w.hi[i], r.value) - least(w.lo[i], r.value)) as spread from w join r on r.grp = w.grp and r.rn = w.rn + 1) q) p)
select grp, key, family from w""", ("ops",))
def w14(v):
    """Operations of a group by their radius: families of a spread of 0.05 at most."""
    size = F.sqrt(F.avg(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    rows = v.ops.groupBy("grp", F.col("op_index").alias("key")).agg(F.round(size, 9).alias("value"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return linetypes.complete_link(g, 0.05)[["grp", "key", "family"]]

    return rows.groupBy("grp").applyInPandas(run, "grp int, key long, family int")


@query("w16_spine", """
with recursive p as (select op_index, k as i, x, y from ops),
e as (select a.op_index, a.i, b.i as j, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as d from p a join p b on a.op_index = b.op_index and a.i <> b.i),
prim(op_index, step, tree, link) as (select distinct op_index, 0, [0], cast([] as struct(a int, b int)[]) from p
  union all select op_index, step + 1, list_append(tree, j), list_append(link, {'a': i, 'b': j}) from (
    select t.op_index, t.step, t.tree, t.link, arg_min(e.i, (e.d, e.j, list_position(t.tree, e.i))) as i, arg_min(e.j, (e.d, e.j, list_position(t.tree, e.i))) as j
    from prim t join e on e.op_index = t.op_index and list_contains(t.tree, e.i) and not list_contains(t.tree, e.j) where t.step < 31 group by 1, 2, 3, 4)),
mst as (select op_index, unnest(link, recursive := true) from prim where step = 31),
both_ as (select op_index, a, b from mst union all select op_index, b, a from mst),
way(op_index, one, two, via, n, len) as (select op_index, i, i, -1, 1, cast(0 as double) from p
  union all select w.op_index, w.one, m.b, w.two, w.n + 1, w.len + sqrt((s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y))
  from way w join both_ m on m.op_index = w.op_index and m.a = w.two and m.b <> w.via join p s on s.op_index = w.op_index and s.i = m.a join p t on t.op_index = w.op_index and t.i = m.b),
far as (select op_index, arg_max(n, (round(len, 9), -least(one, two))) as points, arg_max(least(one, two), (round(len, 9), -least(one, two))) as first, arg_max(greatest(one, two), (round(len, 9), -least(one, two))) as last from way group by op_index)
select op_index, points, cast(first as int) as first, cast(last as int) as last from far""", ("ops",))
def w16(v):
    """The longest path of the spanning tree of an operation's points: how many points, and its ends."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        p = _points(g)
        path = linetypes.tree_diameter(len(p), linetypes.spanning_tree(p), p)
        return pd.DataFrame([(g["op_index"].iloc[0], len(path), path[0], path[-1])], columns=["op_index", "points", "first", "last"])

    return v.ops.groupBy("op_index").applyInPandas(run, "op_index long, points int, first int, last int")


@query("w17_carrier_paths", """
with recursive p as (select op_index, k as i, x, y from ops),
e as (select a.op_index, a.i, b.i as j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as w from p a join p b on a.op_index = b.op_index and a.i <> b.i where sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= cast(0.3 as double)),
best(op_index, at_, d, n, step) as (select distinct op_index, 0, cast(0 as double), 1, 0 from p
  union all select op_index, at_, min(d), arg_min(n, d), step + 1 from (select op_index, at_, d, n, step from best where step < 31 union all select b.op_index, e.j, b.d + e.w, b.n + 1, b.step from best b join e on e.op_index = b.op_index and e.i = b.at_ where b.step < 31) group by op_index, at_, step)
select o.op_index, round(b.d, 9) as length, coalesce(b.n, 0) as nodes from (select distinct op_index from p) o left join best b on b.op_index = o.op_index and b.at_ = 31 and b.step = 31""", ("ops",))
def w17(v):
    """Shortest path from the first to the last point over links of points at most 0.3 apart."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        p = _points(g)
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
        edges = [(int(i), int(j), float(d[i, j])) for i, j in zip(*np.nonzero(np.triu(d <= 0.3, 1)), strict=True)]
        found = linetypes.shortest_path(edges, 0, len(p) - 1)
        return pd.DataFrame([(g["op_index"].iloc[0], None if found is None else round(found[0], 9), 0 if found is None else len(found[1]))], columns=["op_index", "length", "nodes"])

    return v.ops.groupBy("op_index").applyInPandas(run, "op_index long, length double, nodes int")


@query("x10_simplify", """
with recursive p as (select op_index, k, x, y from ops),
cut(op_index, lo, hi) as (select op_index, 0, 31 from (select distinct op_index from p)
  union all select op_index, unnest([lo, at_]), unnest([at_, hi]) from (
    select op_index, lo, hi, arg_max(k, (off, -k)) as at_, max(off) as most from (
      select op_index, lo, hi, k, (rx - t * dx) * (rx - t * dx) + (ry - t * dy) * (ry - t * dy) as off from (
        select c.op_index, c.lo, c.hi, m.k, m.x - a.x as rx, m.y - a.y as ry, b.x - a.x as dx, b.y - a.y as dy,
          case when (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) > 1e-12 then least(1, greatest(0, ((m.x - a.x) * (b.x - a.x) + (m.y - a.y) * (b.y - a.y)) / ((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)))) else 0 end as t
        from cut c join p a on a.op_index = c.op_index and a.k = c.lo join p b on b.op_index = c.op_index and b.k = c.hi join p m on m.op_index = c.op_index and m.k > c.lo and m.k < c.hi))
    group by op_index, lo, hi having max(off) > cast(0.01 as double)))
select op_index, cast(count(distinct lo) + 1 as int) as kept from cut group by op_index""", ("ops",))
def x10(v):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        keep = linetypes.simplify(_points(g), 0.1)
        return pd.DataFrame([(g["op_index"].iloc[0], len(keep))], columns=["op_index", "kept"])

    return v.ops.groupBy("op_index").applyInPandas(run, "op_index long, kept int")


@query("w13_motif_clusters", """
with recursive f as (select op_index, ln(sqrt(avg(x * x + y * y))) / ln(cast(1.3 as double)) as u, (max(x) - min(x)) / nullif(max(y) - min(y), 0) / cast(0.2 as double) as v from ops group by op_index),
e as (select a.op_index as a, b.op_index as b from f a join f b on a.op_index <> b.op_index and abs(a.u - b.u) <= 1 and abs(a.v - b.v) <= 1),
lab(node, l, step) as (select op_index, op_index, 0 from f
  union all select node, min(l), step + 1 from (select node, l, step from lab where step < 40 union all select e.a, lab.l, lab.step from lab join e on e.b = lab.node where lab.step < 40) group by node, step)
select l as first, count(*) as support from lab where step = 40 group by l having count(*) >= 3""", ("ops",))
def w13(v):
    """Union-find over matching fingerprints."""
    f = v.ops.groupBy("op_index").agg(F.sqrt(F.avg(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("scale"), ((F.max("x") - F.min("x")) / F.nullif(F.max("y") - F.min("y"), F.lit(0.0))).alias("aspect"))
    return linetypes.motif_clusters(f)


@query("j19_own_geometry", """
with p as (select grp, op_index, k, x, y from ops), o as (select grp, op_index as own, k as ok, x as ox, y as oy from ops where op_index % 10 = 0),
h as (select p.grp, p.op_index, p.k, max(case when (p.x - o.ox) * (p.x - o.ox) + (p.y - o.oy) * (p.y - o.oy) <= 0.01 then 1 else 0 end) as hit from p join o on p.grp = o.grp and p.op_index <> o.own group by 1, 2, 3)
select op_index, avg(hit) >= 0.75 as own from h group by op_index""", ("ops",))
def j19(v):
    cell = lambda c: F.floor(F.col(c) / 0.1).cast("int")
    around = lambda c: F.explode(F.array(cell(c) - 1, cell(c), cell(c) + 1))
    own = v.ops.filter("op_index % 10 = 0").select("grp", F.col("op_index").alias("own"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    o = own.withColumn("cx", around("ox")).withColumn("cy", around("oy"))
    near = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")) <= 0.01
    hits = v.ops.withColumn("cx", cell("x")).withColumn("cy", cell("y")).join(o, ["grp", "cx", "cy"]).filter((F.col("op_index") != F.col("own")) & near).select("grp", "op_index", "k").distinct().withColumn("hit", F.lit(1))
    x = v.ops.join(hits, ["grp", "op_index", "k"], "left")
    return x.groupBy("op_index").agg((F.avg(F.coalesce("hit", F.lit(0))) >= 0.75).alias("own"))


@query("j20_neighbourhood", """
with b as (select grp, op_index, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from ops group by 1, 2), s as (select * from b where op_index % 10 = 0)
select b.grp, b.op_index from b where not exists (select 1 from s where s.grp = b.grp and s.op_index <> b.op_index and b.x0 >= s.x0 - cast(0.05 as double) and b.x1 <= s.x1 + cast(0.05 as double) and b.y0 >= s.y0 - cast(0.05 as double) and b.y1 <= s.y1 + cast(0.05 as double))""", ("ops",))
def j20(v):
    """Operations that do not lie as a whole, with every point, in the padded box of another one that is a symbol."""
    b = v.ops.groupBy("grp", "op_index").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    s = b.filter("op_index % 10 = 0").select(F.col("grp").alias("g"), F.col("op_index").alias("own"), *((F.col(c) + d).alias(f"s{c}") for c, d in (("x0", -0.05), ("x1", 0.05), ("y0", -0.05), ("y1", 0.05))))
    inside = F.expr("grp = g and op_index <> own and x0 >= sx0 and x1 <= sx1 and y0 >= sy0 and y1 <= sy1")
    return b.join(s, inside, "left_anti").select("grp", "op_index")


@query("j17_endpoint_walk", """
with recursive e as (select distinct l_suppkey as a, l_partkey % 100 + 1 as b from lineitem),
walk(start, at_, depth) as (select distinct a, a, 0 from e union select w.start, e.b, w.depth + 1 from walk w join e on w.at_ = e.a where w.depth < 7)
select start, at_ as at, cast(min(depth) as int) as depth from walk group by 1, 2""")
def j17(v):
    """Seven steps from every start over all rows."""
    e = materialize(v.table("lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100 + 1).alias("b")).distinct())
    return linetypes.endpoint_walk(e, e.select(F.col("a").alias("start")), 7)


@query("r20_contour_signature", """
with s as (select op_index, list(cast(floor(x * 4) as int) || ' ' || cast(floor(y * 4) as int) order by k) as t from ops group by op_index),
b as (select op_index, t from s union all select op_index, list_reverse(t) from s),
r as (select op_index, array_to_string(list_concat(t[o + 1:], t[:o]), ',') as sig from (select op_index, t, unnest(range(0, len(t))) as o from b))
select op_index, min(sig) as sig from r group by op_index""", ("ops",))
def r20(v):
    """All points with both coordinates, drawn either way: the same wherever a contour begins."""
    return linetypes.contour_signatures(v.ops)


@query("r50_slot_overlap", """
with a as (select c_nationkey as n, c_mktsegment as s from customer group by 1, 2), z as (select n, count(*) as k from a group by n), i as (select x.n as a, y.n as b, count(*) as both_ from a x join a y on x.s = y.s and x.n < y.n group by 1, 2)
select i.a, i.b, round(both_ / cast(p.k + q.k - both_ as double), 6) as jaccard from i join z p on i.a = p.n join z q on i.b = q.n""")
def r50(v):
    a = v.table("customer").groupBy(F.col("c_nationkey").alias("n")).agg(F.collect_set("c_mktsegment").alias("s"))
    x, y = a.select(F.col("n").alias("a"), F.explode("s").alias("s"), F.size("s").alias("p")), a.select(F.col("n").alias("b"), F.explode("s").alias("s"), F.size("s").alias("q"))
    i = x.join(y, "s").filter("a < b").groupBy("a", "b", "p", "q").agg(F.count(F.lit(1)).alias("n"))
    return i.select("a", "b", F.round(F.col("n") / (F.col("p") + F.col("q") - F.col("n")).cast("double"), 6).alias("jaccard"))


@query("e01_shape_features", """
with f as (select op_index, count(*) as n, max(x) - min(x) as w, max(y) - min(y) as h, regr_slope(y, x) as slope from ops group by op_index)
select op_index, case when w >= 3 * h then 'flat' when h >= 3 * w then 'tall' when abs(slope) > 0.1 then 'slanted' else 'compact' end as shape from f""", ("ops",))
def e01(v):
    f = v.ops.groupBy("op_index").agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"), F.regr_slope("y", "x").alias("slope"))
    shape = F.when(F.col("w") >= 3 * F.col("h"), "flat").when(F.col("h") >= 3 * F.col("w"), "tall").when(F.abs("slope") > 0.1, "slanted").otherwise("compact")
    return f.select("op_index", shape.alias("shape"))


@query("e02_stage_audit", """
with a as (select op_index, count(*) as n, sqrt(avg(x * x + y * y)) as r, max(abs(x)) as m from ops group by op_index),
s as (select 1 as stage, count(*) as kept from a union all select 2, count(*) from a where r > 0.1 union all select 3, count(*) from a where r > 0.1 and m < 0.45 union all select 4, count(*) from a where r > 0.1 and m < 0.45 and op_index % 3 > 0)
select stage, kept, kept - lag(kept) over (order by stage) as delta from s""", ("ops",))
def e02(v):
    """A chain of filters with the rows that each leaves, counted in one pass."""
    a = v.ops.groupBy("op_index").agg(F.sqrt(F.avg(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("r"), F.max(F.abs("x")).alias("m"))
    steps, test, cols = ("r > 0.1", "m < 0.45", "op_index % 3 > 0"), F.lit(True), [F.count(F.lit(1)).alias("s1")]
    for i, s in enumerate(steps, 2):
        test = test & F.expr(s)
        cols.append(F.count_if(test).alias(f"s{i}"))
    one = a.agg(*cols)
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("stage"), F.col(f"s{i}").alias("kept"), (F.col(f"s{i}") - (F.col(f"s{i - 1}") if i > 1 else F.lit(None))).alias("delta")) for i in range(1, len(steps) + 2))))
    return one.select(rows.alias("r")).select("r.*")
