"""Allow and block rules on URLs, by hashed host-suffix and path-prefix expressions.

A URL's expressions are the suffixes of its host at label borders, each with the prefixes of its path that are as
long as some rule's path. Distinct (host, path) pairs are expanded once, joined to the rules on the first four bytes
of the expression's SHA-256, confirmed on the whole digest, and the longest rule of a pair decides. The rules side
is broadcast only while it has at most `broadcast_rules` rows; beyond that Spark shuffles it. A pair is dealt over
`salts` keys by its rows' ids, so one very common URL is many tasks; rows without host or path join nothing.

Defined cases. Null url or one without `://`: host and path are empty, no rule fits, the default verdict holds. A
host's upper-case A-Z is lower-cased, nothing else is changed: a port or a user name is part of the host. Rows that
repeat an id are judged row by row; a null id stays null. Of two rules with the same host and path a block stands.
Very long urls are expanded whole: as many suffixes as their host has labels. Other columns are not read. No rules: every verdict is the default. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path), both empty where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    there = F.coalesce(at, F.lit(0)) > 0
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = 100_000, salts: int = 16) -> DataFrame:
    """(id_col, host, path, rule, verdict) for each row; rules are (verdict, host, path that begins with /)."""
    spark = pages.sparkSession
    if any(v not in ("allow", "block") or not h or not p.startswith("/") for v, h, p in rules):
        raise ValueError("a rule is (allow or block, host, path from /)")
    host, path = url_parts(F.col(url_col))
    judged = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if not rules:
        return judged.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    table = spark.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")
    digest = F.sha2(F.concat("rule_host", F.lit("\n"), "rule_path"), 256)
    table = (
        table.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, 8))
        .withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("size", F.length("rule"))
        .select("short", "digest", "rule", "size", "verdict")
    )
    if len(rules) <= broadcast_rules:
        table = F.broadcast(table)
    lengths = F.array(*(F.lit(n) for n in sorted({len(p) for _, _, p in rules})))
    salted = judged.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int"))
    open_ = F.expr("host <> '' and path <> ''")
    pairs = salted.filter(open_).select("host", "path", "salt").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    expanded = (
        pairs.withColumn("suffix", F.explode(suffixes)).withColumn("n", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))))
        .withColumn("seen", F.sha2(F.concat("suffix", F.lit("\n"), F.substring(F.col("path"), F.lit(1), F.col("n"))), 256))
        .withColumn("short", F.substring("seen", 1, 8))
    )
    hits = expanded.join(table, "short").filter("seen = digest")
    block = F.col("verdict") == "block"
    won = hits.groupBy("host", "path", "salt").agg(F.max(F.struct("size", block.alias("block"), "rule", "verdict")).alias("w")).select("host", "path", "salt", "w.rule", "w.verdict")
    out = [id_col, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")]
    some = salted.filter(open_).join(won, ["host", "path", "salt"], "left").select(out)
    none = judged.filter(~open_).select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return some.unionByName(none)


def oracle_sql(rules: list[tuple[str, str, str]], default: str = "allow") -> str:
    """The same in DuckDB SQL over `pages`, by comparing each URL with each rule."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""
with parts as (
  select page_id, case when coalesce(instr(url, '://'), 0) > 0 then substr(url, instr(url, '://') + 3) end as rest from pages
), split as (
  select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path, row_number() over () as rn from parts
), rules(rverdict, rhost, rpath) as (values {values}
), fits as (
  select rn, rhost || rpath as rule, rverdict, row_number() over (partition by rn order by length(rhost || rpath) desc, rverdict desc) as k
  from split join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
)
select s.page_id, s.host, s.path, f.rule, coalesce(f.rverdict, '{default}') as verdict
from split s left join fits f on s.rn = f.rn and f.k = 1
"""
