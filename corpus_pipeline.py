"""The corpus pipeline: toxicity, near duplicates, personal data, mixing, packing.

Defined cases, for every stage: an empty table gives an empty result; null and empty texts, null ids and repeated rows go
through as its operator says; very long texts are taken whole; columns other than those of documents are left out.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drafthorse.llm.mixing import mix_sources
from drafthorse.llm.neardup import near_duplicates
from drafthorse.llm.packing import pack
from drafthorse.llm.pseudonyms import pseudonymize
from drafthorse.llm.queries import DEMO_KEY, TARGETS
from drafthorse.llm.toxicity import score, train
from drafthorse.session import materialize, read_table

FEW_KEYS = 1 << 21
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go; null and wordless texts count as clean."""
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model, keep=tuple(COLUMNS[1:])).filter("score < 0.5").select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with `file` and `row`: where each row stands in the Parquet that it was read from."""
    place = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        return docs.select(*docs.columns, *place)
    except AnalysisException:  # not from files: written as it stands
        return materialize(docs).select(*docs.columns, *place)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least id, of equal ids that
    with the least hash of its text.

    Rows are judged one by one, so rows that repeat an id are a group only if their texts are alike; a row with a
    null id goes where another of its group has an id. Documents without words (null and empty ones) stay.
    """
    rows = numbered(docs.select(*COLUMNS)).withColumn("key", F.xxhash64("file", "row"))
    judged = materialize(near_duplicates(rows, id_col="key").filter("n_links > 0").select("key", "component_id"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("h"), "key")
    members = materialize(rows.select("key", order.alias("order")).join(judged, "key"))
    first = members.groupBy("component_id").agg(F.min("order").alias("first")).select("first.key")
    gone = materialize(members.select("key").join(first, "key", "left_anti"))
    # keys of eight bytes: up to FEW_KEYS they go to the texts, beyond that the texts are dealt by key
    gone = F.broadcast(gone) if gone.count() <= FEW_KEYS else gone
    return rows.join(gone, "key", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; n_chars follows a changed text. Null and empty texts stay as they are."""
    out = pseudonymize(docs, DEMO_KEY, keep=("lang", "source", "n_chars"))
    chars = F.when(F.col("n_values") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return out.withColumn("n_chars", chars).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the mixed order: the files follow one another, and each is in order inside.

    Null and empty texts and null ids are mixed like others; rows that repeat an id stand side by side.
    """
    order = materialize(mix_sources(docs, TARGETS, other=1.0).select("doc_id", "position"))
    place = order.groupBy("doc_id").agg(F.min("position").alias("position"))
    placed = docs.select(*COLUMNS).join(place, docs["doc_id"].eqNullSafe(place["doc_id"]), "left").drop(place["doc_id"])
    return placed.orderBy("position").select(*COLUMNS)


def written_order(docs: DataFrame) -> DataFrame:
    """docs with `position`: its row's number, in the order in which the rows were written, whatever order Spark reads in."""
    placed = numbered(docs.select("doc_id", "text"))
    files = materialize(placed.groupBy("file").agg((F.max("row") + 1).alias("rows")))
    part = F.regexp_extract("file", "part-([0-9]+)", 1).try_cast("long")
    before = Window.orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    return placed.join(starts, "file").select("doc_id", "text", (F.col("first") + F.col("row")).alias("position"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences follow the order in which the mixing stage has written its rows."""
    return pack(written_order(docs), position_col="position")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]
#: SQL cannot train the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = materialize(docs) if k < len(STAGES) - 1 else docs
    return docs
