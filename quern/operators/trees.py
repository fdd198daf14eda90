"""Path and symbol trees as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X


def path_nodes(paths: DataFrame, path: str = "path") -> DataFrame:
    """Every folder and file on the way to a path, once, with its depth,
    parent and the number of files at or below it."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    p = paths.select(path).where(F.col(path).isNotNull()).distinct().select(parts.alias("p")).where(F.size("p") > 0)
    rows = p.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice("p", 1, n), "/").alias("node"), F.array_join(F.slice("p", 1, n - 1), "/").alias("parent")))).alias("x"))
    return rows.groupBy("x.node", "x.parent", "x.depth").agg(F.count(F.lit(1)).alias("files"))


def filter_tree(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes that match by subsequence in their own name, and all ancestors."""
    hit = nodes.where(X.subsequence(X.base_name(F.col("node")), query)).select("node")
    parts = F.split("node", "/")
    keep = hit.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("node")).distinct()
    return nodes.join(keep, "node", "left_semi")


def symbol_tree(symbols: DataFrame) -> DataFrame:
    """(version, name, parent) with parent kept only if it is itself among the
    names of the version and is not the name; else the row is a root."""
    names = symbols.select(F.col("version").alias("_v"), F.col("name").alias("_p")).distinct()
    j = symbols.join(names, F.col("version").eqNullSafe(F.col("_v")) & (F.col("parent") == F.col("_p")) & (F.col("parent") != F.col("name")), "left")
    return j.select("version", "name", F.col("_p").alias("parent"))
