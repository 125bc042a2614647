"""What the two vector searches share: usable rows, blocks of rows, and tiles of queries against blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vector_col: str, zero: bool = True) -> DataFrame:
    """(id, x array<double>): one row for each id, without null ids and vectors that are null, empty or hold null or
    non-finite components (zero=False: nor vectors of zeros). Of rows that repeat an id the least vector stands.
    """
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).filter("id is not null and size(x) > 0")
    x = x.filter("forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    x = x if zero else x.filter("exists(x, c -> c <> 0)")
    return x.groupBy("id").agg(F.min("x").alias("x"))


def best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of (row, id, score) the k best of each row, without repeats: highest score first, ties to the smaller id."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
    rows, ids, scores = rows[new], ids[new], scores[new]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    keep = rank < k
    return rows[keep], ids[keep], scores[keep]


def above(scores: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the scores that can be among the k best of their row and are at least its floor."""
    if scores.shape[1] > k:
        floor = np.maximum(floor, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
    return np.nonzero(scores >= floor[:, None])


def ranked(found: DataFrame, k: int, score: str) -> DataFrame:
    """(query_id, rank, id, score): the k best of each query over all tiles."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def renewed(df: DataFrame) -> DataFrame:
    """df with columns of its own, so that two tables of one origin can be cogrouped."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))
