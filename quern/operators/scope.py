"""Active versions, session scope and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ScopeError(ValueError):
    pass


def ordered_distinct(names: list[str]) -> list[str]:
    return list(dict.fromkeys(names))


def effective(active: DataFrame, session: DataFrame | None) -> DataFrame:
    """Versions searched: the session's in its own order as far as they are
    active, or all active ones without a session."""
    return active if session is None else session.join(active.select("version"), "version", "left_semi").select("pos", "version")


def excluded(active: DataFrame, session: DataFrame) -> DataFrame:
    """Active versions outside the session, in active order."""
    return active.join(session.select("version"), "version", "left_anti").select("pos", "version")


def merge_listing(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local and remote versions by name with where they are."""
    j = local.select("name", F.lit(True).alias("l")).join(remote.select("name", F.lit(True).alias("r")), "name", "full_outer")
    return j.select("name", F.when(F.col("l") & F.col("r"), "local+remote").when(F.col("l"), "local").otherwise("remote").alias("location"))


class Session:
    """The scope of one client; nothing is changed by a rejected request."""

    def __init__(self, active: list[str]):
        self.active, self.chosen = ordered_distinct(active), None

    def choose(self, versions: list[str]) -> list[str]:
        wanted = ordered_distinct(versions)
        unknown = [v for v in wanted if v not in self.active]
        if not wanted or unknown:
            raise ScopeError("no versions given" if not wanted else f"unknown versions: {', '.join(unknown)}")
        self.chosen = wanted
        return wanted

    def reset(self) -> None:
        self.chosen = None

    def versions(self) -> list[str]:
        return self.active if self.chosen is None else [v for v in self.chosen if v in self.active]

    def meta(self) -> dict:
        out = [v for v in self.active if v not in self.versions()]
        if out:
            return {"excluded_active_dbs": out}
        return {"scope_hint": f"searched all {len(self.active)} active versions"} if self.chosen is None and len(self.active) > 1 else {}
