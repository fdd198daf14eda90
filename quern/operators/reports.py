"""Build telemetry: reports, rolling rates, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_language(files: DataFrame) -> DataFrame:
    """Files, chunks, seconds and chunks per file of each language."""
    return files.groupBy("language").agg(
        F.count(F.lit(1)).alias("files"), F.sum("chunks").cast("bigint").alias("chunks"), F.round(F.sum("elapsed"), 4).alias("elapsed"), F.round(F.avg("chunks"), 6).alias("avg_chunks")
    )


def totals(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(~F.col("skipped")).alias("done"), F.count_if(F.col("skipped")).alias("skipped"),
        F.coalesce(F.sum(F.when(~F.col("skipped"), F.col("chunks"))), F.lit(0)).cast("bigint").alias("chunks"),
    )


def skipped(files: DataFrame, errors: DataFrame) -> DataFrame:
    """Skipped files and parse errors as (path, reason)."""
    return files.where("skipped").select("path", F.col("skip_reason").alias("reason")).unionByName(errors.select("path", "reason"))


def rolling_rate(batches: DataFrame, by: str, order: list[str], n: str, seconds: str, width: int = 20) -> DataFrame:
    """Sum of n over sum of seconds of the last `width` batches of each
    producer; null on its first batch."""
    w = Window.partitionBy(by).orderBy(*order)
    f = w.rowsBetween(1 - width, 0)
    rate = F.when(F.row_number().over(w) >= 2, F.sum(n).over(f) / F.sum(seconds).over(f))
    return batches.select(by, *order, F.round(rate, 6).alias("rate"))


def complete_files(chunks_per_file: DataFrame, by: str, order: list[str], n: str, flushed: int) -> DataFrame:
    """Files whose chunks lie wholly below the flushed count of their
    producer: running sum <= flushed."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = chunks_per_file.withColumn("boundary", F.sum(n).over(w).cast("bigint"))
    return run.withColumn("complete", F.col("boundary") <= flushed)


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """sorted[n // 2] of each group, nulls left out.  The rank comes from
    counts per distinct value, so a hot value is one row."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by).orderBy(value)
    r = c.withColumn("_end", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    at = F.floor(F.col("_n") / 2)
    return r.where((F.col("_end") > at) & (F.col("_end") - F.col("_c") <= at)).select(*by, F.col(value).alias("median"))


def progress(done: Column, total: Column) -> Column:
    return F.floor(F.lit(100) * done / F.greatest(F.lit(1), total)).cast("bigint")


def estimated_total(done: int, average: float, files: int, shown: int | None = None) -> int:
    """Chunks expected in all; a shown estimate stays until it is off by 10 %."""
    new = max(done, int(average * files))
    return shown if shown and shown >= done and abs(new - shown) <= 0.1 * shown else new
