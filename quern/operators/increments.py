"""Processing only new or changed records.

Inputs are cut into partitions (version, bucket).  Each partition has a
fingerprint: its row count and additive sums of row hashes, which do not depend
on order and come from one partial aggregation.  A run recomputes only the
partitions whose fingerprint differs from the stored one, replaces each of them
by dynamic partition overwrite, and stores the new fingerprints last, all of
them as one table.  A run that fails in between leaves old fingerprints, so the
next one does the same partitions again and replaces, never repeats, their rows.

Nulls: a null hash differs from every other; null keys are keys.  Repeated
rows of an input count once in the result.  Empty inputs give empty results; a
partition that vanished is emptied.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.delta import KEY

PART = ["version", "bucket"]
ROWS_PER_BUCKET = 1_000_000


def bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("input_root", "rel_path"), F.lit(n)).cast("int").alias("bucket")


def fingerprints(df: DataFrame, source: str) -> DataFrame:
    """(version, bucket, source, n, lo, hi).  The 64-bit row hash is summed in
    two halves, which cannot overflow below 2^31 rows a partition."""
    cols = [c for c in sorted(df.columns) if c not in PART]
    h = F.xxhash64(*cols)
    rows = df.select(*PART, h.alias("h"))
    return rows.groupBy(*PART).agg(
        F.lit(source).alias("source"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"), F.sum(F.shiftright("h", 32)).alias("hi"),
    )


def pending(walk: DataFrame, log: DataFrame, ok_runs: DataFrame) -> DataFrame:
    """Walk files that the last successful run of their file has not stored
    with the same content; keeps version and bucket."""
    k = [*PART, "input_root", "rel_path"]
    last = log.join(ok_runs, "run_id", "left_semi").groupBy(*k).agg(F.max(F.struct("run_id", "written_at", F.lower("sha256").alias("sha"))).alias("r"))
    last = last.select(*[F.col(c).alias("_" + c) for c in k], F.col("r.sha").alias("_sha"))
    same = reduce(lambda a, b: a & b, [walk[c].eqNullSafe(last["_" + c]) for c in k]) & (F.lower(walk["sha256"]) == last["_sha"])
    return walk.join(last, same, "left_anti").select(*PART, "input_root", "rel_path").distinct()


class IncrementalRun:
    """One named job with its state below `path`: out/, partitioned by version
    and bucket, and fingerprints/<number>, a table of all partitions per
    finished run, of which the highest complete one counts.

    Buckets per version follow the size of the largest version (a million rows
    each).  When it outgrows them their number doubles, every partition is new,
    and the result moves to a folder of that number of buckets."""

    def __init__(self, spark: SparkSession, path: str, rows_per_bucket: int = ROWS_PER_BUCKET):
        self.spark, self.path, self.rows_per_bucket = spark, path.rstrip("/"), rows_per_bucket
        self._p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _runs(self) -> list[int]:
        """Numbers of the finished runs: those whose table is complete."""
        at = self._p(f"{self.path}/fingerprints")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit() and self._fs.exists(self._p(f"{self.path}/fingerprints/{n}/_SUCCESS")))

    def _buckets(self, walk: DataFrame, log: DataFrame, before: int) -> int:
        both = walk.select("version").unionByName(log.select("version")).groupBy("version").agg(F.count(F.lit(1)).alias("n"))
        want = -(-(both.agg(F.max("n")).first()[0] or 1) // self.rows_per_bucket)
        n = max(1, before)
        while n < want:
            n *= 2
        return n

    def run(self, walk: DataFrame, log: DataFrame, runs: DataFrame, fail_before_commit: bool = False) -> DataFrame:
        """Bring the result up to date and return it (all partitions)."""
        from quern.session import written

        done = self._runs()
        stored = self.spark.read.parquet(f"{self.path}/fingerprints/{done[-1]}") if done else None
        before = stored.agg(F.max("buckets")).first()[0] if stored is not None else None
        n = self._buckets(walk, log, before or 1)
        w = walk.select(*KEY, "sha256", bucket(n))
        ok = runs.where("run_status = 'ok'").select("run_id").distinct()
        m = log.join(ok, "run_id", "left_semi").select(*KEY, "sha256", "run_id", "written_at", bucket(n))
        sums = [F.max(F.when(F.col("source") == t, F.col(c))).alias(f"{t}_{c}") for t in ("walk", "log") for c in ("n", "lo", "hi")]
        now = fingerprints(w, "walk").unionByName(fingerprints(m, "log")).groupBy(*PART).agg(*sums).withColumn("buckets", F.lit(n))
        now = written(now, "fingerprints")  # read three times; frozen against later arrivals
        cols = [c for c in now.columns if c not in PART]
        old = stored if stored is not None and before == n else self.spark.createDataFrame([], now.schema)
        a, b = now.select(*PART, F.struct(*cols).alias("a")), old.select(*[F.col(c).alias("_" + c) for c in PART], F.struct(*cols).alias("b"))
        changed = a.join(b, a["version"].eqNullSafe(b["_version"]) & (a["bucket"] == b["_bucket"]), "full_outer").where("not (a <=> b)")
        changed = written(changed.select(F.when(F.col("bucket").isNull(), F.col("_version")).otherwise(F.col("version")).alias("_v"), F.coalesce("bucket", "_bucket").alias("_b")), "changed")
        only = lambda d: d.join(changed, d["version"].eqNullSafe(F.col("_v")) & (d["bucket"] == F.col("_b")), "left_semi")
        fresh = pending(only(w), only(m), ok)
        # a row without a file marks each recomputed partition, so that one that has become empty is replaced as well
        mark = changed.select(F.col("_v").alias("version"), F.col("_b").alias("bucket"), F.lit(None).cast("string").alias("input_root"), F.lit(None).cast("string").alias("rel_path"), F.lit(True).alias("mark"))
        rows = fresh.withColumn("mark", F.lit(False)).unionByName(mark).select("input_root", "rel_path", "mark", *PART)
        # dynamic overwrite: only partitions present in the rows are replaced
        rows.repartition(*PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PART).parquet(f"{self.path}/out-{n}")
        if fail_before_commit:
            raise RuntimeError("stopped before the fingerprints were stored")
        now.write.mode("overwrite").parquet(f"{self.path}/fingerprints/{(done[-1] if done else 0) + 1}")
        return self.result()

    def result(self) -> DataFrame:
        schema = "input_root string, rel_path string, mark boolean, version string, bucket int"
        done = self._runs()
        n = self.spark.read.parquet(f"{self.path}/fingerprints/{done[-1]}").agg(F.max("buckets")).first()[0] if done else None
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/out-{n}") if n else self.spark.createDataFrame([], schema)
        return rows.where("not mark").select(*KEY)
