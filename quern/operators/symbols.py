"""Symbol table operators: last writer wins, lookups, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key under `order`.  max_by would need one struct;
    row_number = 1 gets a WindowGroupLimit, so a hot key is cut to one row per
    partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def lookup(symbols: DataFrame, name: str) -> DataFrame:
    """Exact, case-sensitive; the filter reaches the Parquet scan."""
    return symbols.where(F.col("name") == F.lit(name))


def like(symbols: DataFrame, pattern: str) -> DataFrame:
    return symbols.where(X.ascii_like(F.col("name"), pattern)) if pattern else symbols


def listing(symbols: DataFrame, scope: DataFrame, pattern: str, limit: int) -> DataFrame:
    """Distinct names over the versions in scope (`pos`, `version`): the row of
    the first version that has the name, by name, at most `limit`."""
    rows = like(symbols, pattern).join(scope, "version")
    first = last_per_key(rows, ["name"], [F.asc("pos"), F.asc("id")])
    return first.orderBy("name").limit(limit)


def first_version(symbols: DataFrame, scope: DataFrame) -> DataFrame:
    """For each name, its row in the first version of the scope."""
    return last_per_key(symbols.join(scope, "version"), ["name"], [F.asc("pos"), F.desc("loaded_at"), F.asc("id")])
