"""One query for each operator, over its whole table with the production parameters, and SQL for those that SQL can say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import urlrules
from .ann import nearest
from .kdshard import kd_shards
from .mixing import mix_sources
from .neardup import near_duplicates
from .packing import pack
from .pseudonyms import pseudonymize
from .repeats import remove_repeats
from .topk import top_k
from .toxicity import held_out, score, train

#: Stands for a key that a deployment reads from its secret store.
DEMO_KEY = "drafthorse demonstration key"
#: Target weights of the mixture; a source that is not named weighs 1.
TARGETS = {"src0": 4.0, "src1": 2.5, "src2": 2.0, "src3": 1.5}


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = remove_repeats(docs, length=400, keep=lambda kept: [F.sha2(kept, 256).alias("kept_sha256")], words=51)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "shares_passage")


OP1_SQL = r"""
with d as (
  select row_number() over () as rn, doc_id, coalesce(text, '') as t, encode(coalesce(text, '')) as b, hex(encode(coalesce(text, ''))) as hx,
         octet_length(encode(coalesce(text, ''))) as n from documents
), blocks as (
  select rn, n, k, substr(hx, 400 * k + 1, 1198) as part from (select rn, n, hx, unnest(range(0, (n + 199) // 200)) as k from d where n >= 400)
), windows as (
  select rn, 200 * k + i as pos, md5(substr(part, 2 * i + 1, 800)) as h
  from (select rn, n, k, part, unnest(range(0, 200)) as i from blocks) where 200 * k + i + 400 <= n
), hits as (
  select rn, pos from (select rn, pos, count(*) over (partition by h) as c from windows) where c > 1
), marked as (
  select rn, pos, case when pos > 400 + lag(pos) over (partition by rn order by pos) then 1 else 0 end as new from hits
), runs as (
  select rn, pos, sum(new) over (partition by rn order by pos) as run from marked
), spans as (
  select rn, min(pos) as one, max(pos) + 400 as two from runs group by rn, run
), gaps as (
  select rn, coalesce(lag(two) over (partition by rn order by one), 0) as one, one as two from spans
  union all select d.rn, max(s.two), max(d.n) from spans s join d on s.rn = d.rn group by d.rn
), kept as (
  select g.rn, string_agg(substr(d.hx, 2 * g.one + 1, 2 * (g.two - g.one)), '' order by g.one) as hx from gaps g join d on g.rn = d.rn group by g.rn
), removed as (
  select rn, sum(two - one) as n_removed, count(*) as n_spans from spans group by rn
), w as (
  select rn, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d
), grams as (
  select rn, md5(array_to_string(list_slice(w, k, k + 50), ' ')) as h from (select rn, w, unnest(range(1, len(w) - 49)) as k from w where len(w) >= 51)
), shared as (
  select distinct rn from grams where h in (select h from grams group by h having count(distinct rn) > 1)
)
select d.doc_id, cast(d.n as bigint) as n_bytes, cast(coalesce(r.n_removed, 0) as bigint) as n_removed, cast(coalesce(r.n_spans, 0) as bigint) as n_spans,
       sha256(case when k.rn is null then d.b else unhex(k.hx) end) as kept_sha256, s.rn is not null as shares_passage
from d left join removed r on d.rn = r.rn left join kept k on d.rn = k.rn left join shared s on d.rn = s.rn
"""


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


OP2_SQL = """
with raw as (
  select vec_id, i, floor(64 * cast(c as double)) as x from (
    select vec_id, unnest(embedding) as c, unnest(range(1, len(embedding) + 1)) as i
    from embeddings where vec_id is not null and len(embedding) > 0
  )
), ok as (
  select vec_id from raw group by vec_id having count(*) = count(x) and max(abs(x)) < 1e300
), v as (
  select raw.vec_id, list(x order by i) as q from raw join ok using (vec_id) group by raw.vec_id
), pairs as (
  select a.vec_id as query_id, b.vec_id as vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score
  from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id
), ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from pairs
)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), percent=75).select("doc_id", "n_shingles", "component_id", "kept")


OP3_SQL = r"""
with recursive w as (
  select row_number() over () as rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct rn, md5(array_to_string(list_slice(w, k, k + 4), ' ')) as g from (select rn, w, unnest(range(1, greatest(len(w) - 3, 2))) as k from w where len(w) > 0)
), n as (
  select rn, count(*) as n from s group by rn
), common as (
  select a.rn as a, b.rn as b, count(*) as c from s a join s b on a.g = b.g and a.rn < b.rn group by 1, 2
), links as (
  select x.doc_id as a, y.doc_id as b from common join n p on common.a = p.rn join n q on common.b = q.rn join w x on common.a = x.rn join w y on common.b = y.rn
  where 100 * c >= 75 * (p.n + q.n - c) and x.doc_id <> y.doc_id
), e as (
  select a, b from links union select b, a from links
), reach(node, other) as (
  select a, a from e union select r.node, e.b from reach r join e on r.other = e.a
), found as (
  select node, min(other) as least from reach group by node
)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(f.least, w.doc_id) as component_id, coalesce(coalesce(f.least, w.doc_id) = w.doc_id, true) as kept
from w left join n on w.rn = n.rn left join found f on w.doc_id = f.node
"""


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(read_table(spark, sf_dir, "documents"), DEMO_KEY)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"), TARGETS, other=1.0)


#: Weights are doubled, for whole numbers; blocks are 64 KB, as for any table under 64 GB.
OP6_SQL = f"""
with recursive d as (
  select row_number() over () as rn, doc_id, source, coalesce(source, '') as src, octet_length(encode(coalesce(text, ''))) + 1 as size,
         cast('0x' || substr(md5(concat_ws('|', 'mix', cast(doc_id as varchar), text)), 1, 15) as bigint) as h from documents
), t as (
  select src, cast(sum(size) as bigint) as bytes, cast(case src {" ".join(f"when '{s}' then {int(2 * w)}" for s, w in TARGETS.items())} else 2 end as bigint) as w from d group by src
), placed as (
  select d.*, sum(size) over (partition by d.src order by h % greatest(1, (bytes + 64 * 65536 - 1) // (64 * 65536)), h, doc_id nulls first, rn) - size as start from d join t on d.src = t.src
), s as (
  select row_number() over (order by src) as k, src, w, sum(w) over () as total, (bytes + 65535) // 65536 as blocks from t
), run(slot, src, block, done) as (
  select cast(-1 as bigint), cast(null as varchar), cast(null as bigint), list_transform(range(0, (select count(*) from s)), lambda i: cast(0 as bigint))
  union all
  select slot, src, block, list_transform(done, lambda x, i: case when i = k then x + 1 else x end) from (
    select slot, src, block, done, k, row_number() over (partition by slot0 order by slot, due, src) as best from (
      select r.slot as slot0, greatest(r.slot + 1, r.done[s.k] * s.total // s.w) as slot, s.src, s.k, r.done[s.k] as block, r.done,
             ((r.done[s.k] + 1) * s.total + s.w - 1) // s.w as due
      from run r join s on r.done[s.k] < s.blocks)) where best = 1
), slots as (
  select src, block, row_number() over (order by slot) - 1 as slot from run where src is not null
)
select p.doc_id, p.source, x.block, x.slot, row_number() over (order by x.slot, p.start) - 1 as position
from placed p join slots x on p.src = x.src and cast(p.start as bigint) // 65536 = x.block
"""


def op7_kdshards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(read_table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge_urls(read_table(spark, sf_dir, "pages"), urlrules.RULES)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_repeats, op2_topk, op3_neardup, op4_pseudonyms, op5_ann, op6_mixing, op7_kdshards, op8_urlrules, op9_toxicity, op10_packing)}
ORACLE_SQL: dict[str, str] = {"op1_repeats": OP1_SQL, "op2_topk": OP2_SQL, "op3_neardup": OP3_SQL, "op6_mixing": OP6_SQL, "op8_urlrules": urlrules.oracle_sql(urlrules.RULES)}
