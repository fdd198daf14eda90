"""Directory scans, hashes and manifests of files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import registry as R


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else "file://" + root)


def scan(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """Files below root as (input_root, rel_path, path, mtime, length, kind,
    language[, content]); other files are left out.

    Spark's own file sources skip names with a leading dot or underscore, which
    belong to a source tree, so the listing is done here: the topmost folders on
    the driver, as many as make work for all tasks, each of the others by a task.  Contents are read by
    tasks, a row per file; without `content` no file is opened."""
    from pyarrow import fs

    base = root.rstrip("/")
    system, top = _open(base)
    folders, loose, want = [top], [], spark.sparkContext.defaultParallelism * 4
    while folders and len(folders) < want:  # from the top, until there is a folder for every task
        for e in system.get_file_info(fs.FileSelector(folders.pop(0))):
            (folders if e.type == fs.FileType.Directory else loose).append(e.path)
    pairs = [(p, False) for p in loose] + [(p, True) for p in folders]

    def listed(batches):
        system, top = _open(base)
        for pdf in batches:
            out = []
            for p, folder in zip(pdf["path"], pdf["folder"]):
                infos = system.get_file_info(fs.FileSelector(p, recursive=True)) if folder else [system.get_file_info(p)]
                out += [(i.path[len(top) :].lstrip("/"), i.path, i.mtime_ns / 1e9, i.size) for i in infos if i.type == fs.FileType.File]
            yield pd.DataFrame(out, columns=["rel_path", "path", "mtime", "length"])

    n = max(1, min(len(pairs), want))
    rows = spark.createDataFrame(pairs, "path string, folder boolean").repartition(n).mapInPandas(listed, "rel_path string, path string, mtime double, length bigint")
    rows = rows.select(F.lit(base).alias("input_root"), "*", R.kind(F.col("path")).alias("kind"), R.language(F.col("path")).alias("language")).where("kind is not null")
    return read_content(rows) if content else rows


def read_content(rows: DataFrame) -> DataFrame:
    """Adds the bytes of the files (input_root, path), one file in memory at a
    time."""

    def read(batches):
        for pdf in batches:
            for at in range(len(pdf)):
                one = pdf.iloc[at : at + 1].copy()
                system, _ = _open(one["input_root"].iloc[0])
                with system.open_input_stream(one["path"].iloc[0]) as f:
                    one["content"] = [f.read()]
                yield one

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition("path").mapInPandas(read, schema + ", content binary")


def manifest(files: DataFrame) -> DataFrame:
    return files.select("kind", "rel_path", "input_root", "mtime", F.sha2("content", 256).alias("sha256"))


def distribution_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(file, sha256, size) of every file of a snapshot, by its path below the
    folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    top = folder.rstrip("/").split("://", 1)[-1].removeprefix("file:")
    return df.select(F.ltrim(F.substring_index("path", top, -1), F.lit("/")).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def roots_hash(paths: Column) -> Column:
    """Hash of a set of roots, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(paths), "\n"), 256)
