"""Page tables that stand for what a drawing reader hands over: lines, boxes, detections, groups, symbols, operations.

They are derived from the base tables by fixed rules (DataFrame side and SQL side say the same). The rules thin some
tables on purpose (a detector does not find every line); no rule is there to save work.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import read_table


def _d(c) -> F.Column:
    return (F.lit(c) if not hasattr(c, "cast") else c).cast("double")


class Views:
    """The tables of one data folder, each built when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def lines(self) -> DataFrame:
        parts = F.split("text", "\n", -1)
        x = self.table("documents").select(F.col("doc_id").alias("page"), F.size(parts).alias("n"), F.posexplode(parts).alias("pos", "line"))
        return x.select("page", "pos", "line", "n")

    @cached_property
    def boxes(self) -> DataFrame:
        p, x = F.col("pos"), _d(10) * ((F.col("page") + F.col("pos")) % 7)
        return self.lines.filter(F.length("line") > 0).select(
            "page", "pos", "line", (_d(1000) * p / F.col("n")).alias("y0"), (_d(1000) * (p + _d(0.75)) / F.col("n")).alias("y1"),
            x.alias("x0"), (x + _d(1) + F.length("line") % 900).alias("x1"),
        )

    @cached_property
    def detections(self) -> DataFrame:
        page, pos = F.col("page"), F.col("pos")
        dy, dx = _d(1.5) * ((page + pos * 3) % 5 - 2), _d(3) * ((page * 5 + pos) % 9 - 4)
        return self.boxes.filter((page * 7 + pos * 13) % 5 < 2).select(
            "page", pos.alias("src_pos"), *((F.col(c) + (dy if c[0] == "y" else dx)).alias(c) for c in ("y0", "y1", "x0", "x1"))
        )

    @cached_property
    def groups(self) -> DataFrame:
        kinds = F.array(*(F.lit(k) for k in ("view", "legend", "schedule", "note_cluster", "legend")))
        x = self.table("documents").select(F.col("doc_id").alias("page"), F.posexplode(kinds).alias("group_index", "kind"))
        gi, nested = F.col("group_index"), F.col("group_index") == 4
        shift = 20 * (F.col("page") % 5)
        return x.select(
            "page", "group_index", "kind", _d(F.when(nested, 100).otherwise(250 * gi)).alias("y0"), _d(F.when(nested, 180).otherwise(250 * gi + 230)).alias("y1"),
            _d(F.when(nested, 30).otherwise(shift)).alias("x0"), _d(F.when(nested, 400).otherwise(700 + shift)).alias("x1"),
        )

    @cached_property
    def view_types(self) -> DataFrame:
        kind = F.when(F.col("page") % 3 == 0, "plan").when(F.col("page") % 3 == 1, "elevation").otherwise("section")
        return self.groups.filter("kind = 'view'").select("page", "group_index", kind.alias("view_type"))

    def _placed(self, page, pos, line, n) -> list:
        """Box of a line, as in `boxes`."""
        x = _d(10) * ((page + pos) % 7)
        return [(_d(1000) * pos / n).alias("y0"), x.alias("x0"), (_d(1000) * (pos + _d(0.75)) / n).alias("y1"), (x + _d(1) + F.length(line) % 900).alias("x1")]

    def _items(self) -> tuple[DataFrame, F.Column]:
        """(documents with parts, their lines that are not empty, in order): numbered inside the row, without a shuffle."""
        x = self.table("documents").select(F.col("doc_id").alias("page"), F.split("text", "\n", -1).alias("parts"))
        full = F.filter(F.transform("parts", lambda line, i: F.struct(i.alias("pos"), line.alias("line"))), lambda s: F.length(s["line"]) > 0)
        return x.withColumn("n", F.size("parts")), full

    @cached_property
    def items(self) -> DataFrame:
        x, full = self._items()
        x = x.select("page", "n", F.posexplode(full).alias("idx", "s")).select("page", "n", "idx", "s.pos", "s.line")
        return x.select("page", "idx", "pos", F.col("line").alias("text"), *self._placed(F.col("page"), F.col("pos"), F.col("line"), F.col("n")))

    @cached_property
    def symbols(self) -> DataFrame:
        x, full = self._items()
        some = F.filter(F.transform(full, lambda s, i: F.struct(i.alias("idx"), s["pos"].alias("pos"), s["line"].alias("line"))), lambda s: (F.col("page") * 3 + s["idx"] * 5) % 11 < 2)
        x = x.select("page", "n", F.posexplode(some).alias("symbol_index", "s")).select("page", "n", "symbol_index", "s.idx", "s.pos", "s.line")
        x = x.select("page", "symbol_index", "idx", *self._placed(F.col("page"), F.col("pos"), F.col("line"), F.col("n")))
        page, idx = F.col("page"), F.col("idx")
        return x.select(
            "page", "symbol_index", idx.alias("text_index"), F.when(idx % 2 == 0, "shape").otherwise("line").alias("category"),
            ((page + idx) % 5).cast("int").alias("claimed_group_index"), "y0", "y1", "x0", (F.col("x0") + _d(12)).alias("x1"),
        )

    @cached_property
    def bindings(self) -> DataFrame:
        kind = F.col("event_type")
        number = F.when(kind == "click", 1).when(kind == "view", 2).when(kind == "purchase", 3).when(kind == "signup", 4).otherwise(5)
        return self.table("events").select("event_id", F.col("user_id").alias("grp"), number.alias("line_type_number"), F.col("value").alias("distance"), (F.col("event_id") % 10 < 3).alias("residual"))

    @cached_property
    def ops(self) -> DataFrame:
        points = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(k.alias("k"), F.get("embedding", 2 * k).cast("double").alias("x"), F.get("embedding", 2 * k + 1).cast("double").alias("y")))
        return self.table("embeddings").select(F.col("vec_id").alias("op_index"), F.col("label").alias("grp"), F.inline(points))

    @cached_property
    def calls(self) -> DataFrame:
        start = F.unix_micros(F.col("ts").cast("timestamp"))
        return self.table("events").select(
            "event_id", F.col("event_type").alias("model"), start.alias("start_us"), (start + F.floor(F.col("value") * 1000000).cast("bigint")).alias("end_us"),
            F.get_json_object("props", "$.k").cast("int").alias("tokens"),
        )

    def _first(self, df: DataFrame, *cols) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("page", "tok").orderBy("idx"))
        return df.withColumn("rk", rank).filter("rk = 1").select("page", "tok", "y0", "x0", "y1", "x1")

    @cached_property
    def run_a(self) -> DataFrame:
        return self._first(self.items.withColumn("tok", F.upper(F.replace("text", F.lit("ß"), F.lit("ss")))))

    @cached_property
    def run_b(self) -> DataFrame:
        i = self.items.select(F.col("page").alias("p"), F.col("pos").alias("src"), "idx", F.upper(F.replace("text", F.lit("ß"), F.lit("ss"))).alias("tok"))
        d = self.detections
        return self._first(d.join(i, (d["page"] == i["p"]) & (d["src_pos"] == i["src"])))


#: The same views for DuckDB; each may use the ones before it.
SQL: dict[str, str] = {
    "lines": "select doc_id as page, cast(p - 1 as int) as pos, line, cast(n as int) as n from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as p, len(string_split(text, chr(10))) as n from documents)",
    "boxes": "select page, pos, line, cast(1000 as double) * pos / n as y0, cast(1000 as double) * (pos + cast(0.75 as double)) / n as y1, cast(10 as double) * ((page + pos) % 7) as x0, cast(10 as double) * ((page + pos) % 7) + cast(1 as double) + (length(line) % 900) as x1 from lines where length(line) > 0",
    "detections": "select page, pos as src_pos, y0 + cast(1.5 as double) * ((page + pos * 3) % 5 - 2) as y0, y1 + cast(1.5 as double) * ((page + pos * 3) % 5 - 2) as y1, x0 + cast(3 as double) * ((page * 5 + pos) % 9 - 4) as x0, x1 + cast(3 as double) * ((page * 5 + pos) % 9 - 4) as x1 from boxes where (page * 7 + pos * 13) % 5 < 2",
    "groups": "select doc_id as page, gi as group_index, case gi when 0 then 'view' when 1 then 'legend' when 2 then 'schedule' when 3 then 'note_cluster' else 'legend' end as kind, cast(case when gi = 4 then 100 else 250 * gi end as double) as y0, cast(case when gi = 4 then 180 else 250 * gi + 230 end as double) as y1, cast(case when gi = 4 then 30 else 20 * (doc_id % 5) end as double) as x0, cast(case when gi = 4 then 400 else 700 + 20 * (doc_id % 5) end as double) as x1 from documents cross join (values (0), (1), (2), (3), (4)) as g(gi)",
    "view_types": "select page, group_index, case page % 3 when 0 then 'plan' when 1 then 'elevation' else 'section' end as view_type from groups where kind = 'view'",
    "items": "select page, cast(row_number() over (partition by page order by pos) - 1 as int) as idx, pos, line as text, y0, x0, y1, x1 from boxes",
    "symbols": "select page, cast(row_number() over (partition by page order by idx) - 1 as int) as symbol_index, idx as text_index, case when idx % 2 = 0 then 'shape' else 'line' end as category, cast((page + idx) % 5 as int) as claimed_group_index, y0, y1, x0 as x0, x0 + cast(12 as double) as x1 from items where (page * 3 + idx * 5) % 11 < 2",
    "bindings": "select event_id, user_id as grp, case event_type when 'click' then 1 when 'view' then 2 when 'purchase' then 3 when 'signup' then 4 else 5 end as line_type_number, value as distance, event_id % 10 < 3 as residual from events",
    "ops": "select vec_id as op_index, label as grp, cast(p as int) as k, cast(embedding[2 * p + 1] as double) as x, cast(embedding[2 * p + 2] as double) as y from (select vec_id, label, embedding, unnest(range(0, 32)) as p from embeddings)",
    "calls": "select event_id, event_type as model, epoch_us(ts) as start_us, epoch_us(ts) + cast(floor(value * 1000000) as bigint) as end_us, cast(json_extract_string(props, '$.k') as int) as tokens from events",
    "run_a": "select page, tok, y0, x0, y1, x1 from (select page, upper(replace(text, 'ß', 'ss')) as tok, y0, x0, y1, x1, row_number() over (partition by page, upper(replace(text, 'ß', 'ss')) order by idx) as rk from items) as r where rk = 1",
    "run_b": "select page, tok, y0, x0, y1, x1 from (select d.page, upper(replace(i.text, 'ß', 'ss')) as tok, d.y0, d.x0, d.y1, d.x1, row_number() over (partition by d.page, upper(replace(i.text, 'ß', 'ss')) order by i.idx) as rk from detections as d join items as i on d.page = i.page and d.src_pos = i.pos) as r where rk = 1",
}
NEEDS: dict[str, tuple[str, ...]] = {
    "boxes": ("lines",), "detections": ("boxes",), "view_types": ("groups",), "items": ("boxes",), "symbols": ("items",), "run_a": ("items",), "run_b": ("detections", "items"),
}


def with_views(sql: str, uses: tuple[str, ...]) -> str:
    """sql (a select, or `with` and a select) after the views it uses."""
    wanted: set[str] = set()
    queue = list(uses)
    while queue:
        name = queue.pop()
        wanted.add(name)
        queue += NEEDS.get(name, ())
    views = [f"{n} as ({SQL[n]})" for n in SQL if n in wanted]
    own = sql.strip()
    if not views:
        return own
    if own.lower().startswith("with recursive "):
        return f"with recursive {', '.join(views)}, {own[15:]}"
    return f"with {', '.join(views)}{',' if own.lower().startswith('with ') else ''} {own[5:] if own.lower().startswith('with ') else own}"
