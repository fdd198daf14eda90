"""Nearest-neighbour search: per-version top-k, merge, first per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vectors as V


def knn(df: DataFrame, query: list[float], k: int, vector: str = "embedding", tie: str = "chunk_id") -> DataFrame:
    """The k rows nearest to `query` by cosine, with `score`; unusable vectors
    take no part, ties go to the lower `tie`.  The plan is a scan, one Arrow
    stage and TakeOrderedAndProject: no shuffle of the table."""
    scored = df.withColumn("_cos", V.cosine_to(F.col(vector), query)).where("_cos is not null")
    return scored.orderBy(F.desc("_cos"), F.asc(tie)).limit(k).withColumn("score", V.similarity(F.col("_cos"))).drop("_cos", vector)


def fanout(df: DataFrame, query: list[float], k: int, vector: str = "embedding", by: str = "version", tie: str = "chunk_id") -> DataFrame:
    """The k nearest rows of every version in one scan; columns `cosine`,
    `rank`.  row_number with a bound becomes WindowGroupLimit, which cuts each
    partition to k rows per version before the shuffle, so that a version with
    a third of all rows is no hot partition."""
    scored = df.withColumn("cosine", V.cosine_to(F.col(vector), query)).where("cosine is not null").drop(vector)
    w = Window.partitionBy(by).orderBy(F.desc("cosine"), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merge(hits: DataFrame, keys: list[str], order: list[Column], k: int, score: str = "score") -> DataFrame:
    """Results of all versions as one list: sorted by the rounded score and
    then `order`, first row per `keys` kept, k rows.  The cut per version came
    before, so fewer than k rows may remain; that order is kept on purpose."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *order)
    first = hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.orderBy(F.desc(score), *order).limit(k)


def with_payload(vectors: DataFrame, rows: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Vector rows joined to the rows they belong to (inner, on equal keys)."""
    cond = None
    for a, b in zip(left, right):
        c = vectors[a] == rows[b]
        cond = c if cond is None else cond & c
    return vectors.join(rows, cond, "inner")
