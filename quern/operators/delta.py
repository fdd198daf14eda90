"""Manifest against disk, and version against version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.symbols import last_per_key

KEY = ["version", "input_root", "rel_path"]


def latest_manifest(log: DataFrame, runs: DataFrame) -> DataFrame:
    """The manifest as of the last successful run of each file: rows of 'ok'
    runs, highest run_id per (version, input_root, rel_path).  Among repeated
    rows of a run the last written one counts."""
    ok = runs.where("run_status = 'ok'").select("run_id").distinct()
    rows = log.join(ok, "run_id", "left_semi").select(*KEY, F.struct("run_id", "written_at", F.lower("sha256").alias("sha256"), "mtime").alias("r"))
    return rows.groupBy(*KEY).agg(F.max("r").alias("r")).select(*KEY, "r.run_id", "r.mtime", "r.sha256")


def file_delta(manifest: DataFrame, walk: DataFrame, *, always_hash: bool = False) -> DataFrame:
    """What an incremental build does with each file: 'add', 'delete',
    'replace', 'touch' (new mtime, same content) or 'unchanged'.  Equal mtimes
    are not hashed unless `always_hash`; null mtimes never equal."""
    m = manifest.select(*KEY, F.col("mtime").alias("m_mtime"), F.lower("sha256").alias("m_sha"), F.lit(True).alias("in_m"))
    w = walk.groupBy(*KEY).agg(F.max("mtime").alias("w_mtime"), F.max(F.lower("sha256")).alias("w_sha")).withColumn("in_w", F.lit(True))
    same_time = F.lit(False) if always_hash else F.coalesce(F.col("m_mtime") == F.col("w_mtime"), F.lit(False))
    same_sha = F.col("m_sha").eqNullSafe(F.col("w_sha"))
    action = (
        F.when(F.col("in_m").isNull(), "add").when(F.col("in_w").isNull(), "delete").when(same_time, "unchanged")
        .when(same_sha, F.when(F.col("m_mtime").eqNullSafe(F.col("w_mtime")), "unchanged").otherwise("touch")).otherwise("replace")
    )
    return m.join(w, KEY, "full_outer").select(*KEY, action.alias("action"))


def dropped_roots(manifest: DataFrame, walk: DataFrame) -> DataFrame:
    """Roots that the manifest has and the walk has not, with their files."""
    gone = manifest.join(walk.select("version", "input_root").distinct(), ["version", "input_root"], "left_anti")
    return gone.groupBy("version", "input_root").agg(F.count(F.lit(1)).alias("files"))


def apply_delta(rows: DataFrame, delta: DataFrame, fresh: DataFrame, path: str = "file_path") -> DataFrame:
    """Rows after an incremental build: those of deleted or replaced files
    leave (left-anti), those of the new parse come in."""
    gone = delta.where("action in ('delete', 'replace')").select("version", F.concat_ws("/", "input_root", "rel_path").alias(path))
    return rows.join(gone, ["version", path], "left_anti").unionByName(fresh, allowMissingColumns=True)


def upsert(rows: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace by key."""
    return rows.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def file_diff(manifest: DataFrame, v1: str, v2: str) -> DataFrame:
    """Files added, removed or changed between two versions, by path under
    its root.  Compared by content hash."""
    side = lambda v, n: manifest.where(F.col("version") == v).select("rel_path", F.col("sha256").alias(n), F.lit(True).alias("in_" + n))
    both = side(v1, "a").join(side(v2, "b"), "rel_path", "full_outer")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select("rel_path", change.alias("change")).where("change is not null")


def symbol_diff(symbols: DataFrame, chunks: DataFrame, v1: str, v2: str) -> DataFrame:
    """Names added or removed, with type, file and (by left join) parent."""
    last = last_per_key(symbols.where(F.col("version").isin(v1, v2)), ["version", "name"], [F.desc("loaded_at"), F.desc("id"), F.desc("file_path")])
    parent = chunks.where(F.col("version").isin(v1, v2) & (F.col("parent_name") != "")).groupBy("version", F.col("symbol_name").alias("name")).agg(F.max("parent_name").alias("parent"))
    one = lambda v, w, c: last.where(F.col("version") == v).join(last.where(F.col("version") == w).select("name"), "name", "left_anti").withColumn("change", F.lit(c))
    rows = one(v2, v1, "added").unionByName(one(v1, v2, "removed"))
    return rows.join(parent, ["version", "name"], "left").select("name", "change", "type", "file_path", "parent")


def lang_shift(pct: DataFrame, v1: str, v2: str) -> DataFrame:
    """Percent per language in either version; a missing one counts 0."""
    side = lambda v, n: pct.where(F.col("version") == v).select("language", F.col("pct").alias(n))
    z = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 1).alias(c)
    return side(v1, "before").join(side(v2, "after"), "language", "full_outer").select("language", z("before"), z("after"))


def checksum_mismatches(stated: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Files of a manifest whose content is missing or has another hash."""
    a = actual.select(*keys, F.lower("sha256").alias("_actual"))
    return stated.join(a, keys, "left").where(~F.lower("sha256").eqNullSafe(F.col("_actual"))).select(*keys, F.col("_actual").isNull().alias("missing"))
