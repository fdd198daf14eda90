"""References to records that do not exist.

Signed counts per key are kept from change deltas: every child row adds to the
reference count of its key, every parent row to its existence count, a deletion
subtracts again.  A key with positive references and no existence is an orphan;
a parent that arrives later cancels it, whatever the order of arrival.

Nulls: a child without a key refers to nothing and takes no part; a null
version is a version of its own.  Repeated rows count again in the counts and
once in the report.  Empty tables give empty results.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["version", "key"]


def existence_deltas(parents: DataFrame, key: str = "id", deleted: str | None = "deleted_at") -> DataFrame:
    """(version, key, refs, exist): +1 for an arrival, -1 for its deletion,
    pre-summed by Spark's partial aggregation before any shuffle."""
    gone = F.when(F.col(deleted).isNotNull(), 1).otherwise(0) if deleted else F.lit(0)
    rows = parents.where(F.col(key).isNotNull()).select("version", F.col(key).alias("key"), (F.lit(1) - gone).cast("bigint").alias("e"))
    return rows.groupBy(*KEY).agg(F.lit(0).cast("bigint").alias("refs"), F.sum("e").alias("exist"))


def reference_deltas(children: DataFrame, key: str = "chunk_id", sign: int = 1) -> DataFrame:
    rows = children.where(F.col(key).isNotNull()).select("version", F.col(key).alias("key"))
    return rows.groupBy(*KEY).agg((F.count(F.lit(1)) * sign).alias("refs"), F.lit(0).cast("bigint").alias("exist"))


def merge_counts(*deltas: DataFrame) -> DataFrame:
    """Counts after all deltas; keys whose counts are both zero are dropped."""
    rows = reduce(DataFrame.unionByName, [d.select(*KEY, "refs", "exist") for d in deltas])
    return rows.groupBy(*KEY).agg(F.sum("refs").alias("refs"), F.sum("exist").alias("exist")).where("refs <> 0 or exist <> 0")


def orphan_keys(counts: DataFrame) -> DataFrame:
    return counts.where("refs > 0 and exist <= 0").select(*KEY, "refs")


def child_rows(children: DataFrame, table: str, child: str, key: str = "chunk_id", loaded: str = "loaded_at") -> DataFrame:
    """Distinct (child_table, child_id, load_month, version, key)."""
    return children.where(F.col(key).isNotNull()).select(
        F.lit(table).alias("child_table"), F.col(child).cast("bigint").alias("child_id"), F.date_format(loaded, "yyyy-MM").alias("load_month"), "version", F.col(key).alias("key")
    )


def orphans(children: DataFrame, keys: DataFrame) -> DataFrame:
    """Child rows of the orphan keys.  The key side is unique, so AQE may
    split a hot key of the child side into any number of tasks."""
    k = keys.select(F.col("version").alias("_v"), F.col("key").alias("_k"))
    return children.join(k, children["version"].eqNullSafe(k["_v"]) & (children["key"] == k["_k"]), "left_semi")


class ReferenceLedger:
    """The counts, kept as Parquet between runs, one generation per applied
    batch.  A generation is current once its pointer `commits/<number>` stands,
    and the highest number wins: pointers are written whole under another name
    and renamed to a name that did not exist, never replaced, so that a run
    that fails anywhere leaves the former generation in force.  Two writers at
    once cannot both take a number; the second fails and may apply again.

    Batches are known by stream and number (`stream-number`; a name without a
    number is a stream of its own).  Numbers of a stream come in order, as
    those of Structured Streaming do, so the highest one of each is all that is
    kept: a batch not above it had been applied."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _commits(self) -> list[int]:
        at = self._p(f"{self.path}/commits")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _state(self) -> tuple[int, str | None, dict[str, int]]:
        """(number of the last commit, its generation, highest batch of each stream)"""
        done = self._commits()
        if not done:
            return 0, None, {}
        rows = self.spark.read.parquet(f"{self.path}/commits/{done[-1]}").collect()  # a row per stream
        return done[-1], rows[0]["generation"], {r["stream"]: r["batch"] for r in rows}

    def counts(self) -> DataFrame | None:
        _, gen, _ = self._state()
        return self.spark.read.parquet(f"{self.path}/{gen}") if gen else None

    def _publish(self, tmp: str, number: int) -> None:
        self._fs.mkdirs(self._p(f"{self.path}/commits"))
        to = self._p(f"{self.path}/commits/{number}")
        if self._fs.exists(to) or not self._fs.rename(self._p(tmp), to):
            raise OSError(f"could not publish commit {number}")

    def apply(self, batch_id: str, *deltas: DataFrame) -> bool:
        """Fold deltas in; False if this batch had been applied already."""
        stream, _, n = batch_id.rpartition("-")
        stream, batch = (stream, int(n)) if stream and n.isdigit() else (batch_id, 0)
        number, gen, seen = self._state()
        if seen.get(stream, -1) >= batch:
            return False
        new = f"gen-{uuid.uuid4().hex}"
        old = [self.spark.read.parquet(f"{self.path}/{gen}")] if gen else []
        merge_counts(*old, *deltas).write.parquet(f"{self.path}/{new}")
        tmp = f"{self.path}/.next-{new}"
        rows = [(new, k, v) for k, v in ({**seen, stream: batch}).items()]
        self.spark.createDataFrame(rows, "generation string, stream string, batch long").coalesce(1).write.parquet(tmp)
        self._publish(tmp, number + 1)
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Remove what only commits older than the last `keep` refer to, and
        generations of runs that failed; how many were removed."""
        done = self._commits()
        live = {self.spark.read.parquet(f"{self.path}/commits/{n}").first()["generation"] for n in done[-keep:]}
        for n in done[:-keep]:
            self._fs.delete(self._p(f"{self.path}/commits/{n}"), True)
        dead = [f.getPath() for f in self._fs.listStatus(self._p(self.path)) if f.getPath().getName().startswith(("gen-", ".next-")) and f.getPath().getName() not in live]
        for d in dead:
            self._fs.delete(d, True)
        return len(dead)
