"""Counts, shares and summaries per version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X


def count_by(df: DataFrame, column: str, default: str, name: str, *, by: list[str] = []) -> DataFrame:
    """Rows per value; null and '' count as `default`."""
    return df.groupBy(*by, X.nonempty(F.col(column), default).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def share(counts: DataFrame, by: list[str], n: str = "n", name: str = "pct") -> DataFrame:
    """Percent of the total of each `by` group; the total is a second
    aggregate joined back, so no group is sorted into one task."""
    if not by:
        return counts.crossJoin(F.broadcast(counts.agg(F.sum(n).alias("_t")))).withColumn(name, F.lit(100.0) * F.col(n) / F.col("_t")).drop("_t")
    total = counts.groupBy(*by).agg(F.sum(n).alias("_t"))
    return counts.join(total, by).withColumn(name, F.lit(100.0) * F.col(n) / F.col("_t")).drop("_t")


def top_per(counts: DataFrame, by: list[str], value: str, k: int, n: str = "n") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(n), F.asc(value))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def version_stats(chunks: DataFrame, symbols: DataFrame, sections: DataFrame) -> DataFrame:
    """One row per version: chunks, symbols, sections, documents, words."""
    c = chunks.groupBy("version").agg(F.count(F.lit(1)).alias("chunks"))
    s = symbols.groupBy("version").agg(F.count(F.lit(1)).alias("symbols"))
    d = sections.groupBy("version").agg(
        F.count(F.lit(1)).alias("sections"), F.countDistinct("source_path").alias("docs"), F.coalesce(F.sum(F.col("word_count").cast("bigint")), F.lit(0)).alias("total_words")
    )
    out = c.join(s, "version", "full_outer").join(d, "version", "full_outer")
    return out.select("version", *[F.coalesce(F.col(x), F.lit(0)).cast("bigint").alias(x) for x in ("chunks", "symbols", "sections", "docs", "total_words")])
