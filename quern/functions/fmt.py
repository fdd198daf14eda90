"""Display formats as column expressions (ties round to even)."""

from __future__ import annotations

from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def human_size(n: Column) -> Column:
    """Bytes with unit, steps of 1024: whole for B, one decimal above."""
    out = F.format_string("%.1f TB", F.bround(n / F.lit(1024.0**4), 1))
    for i, unit in reversed(list(enumerate(("KB", "MB", "GB"), 1))):
        out = F.when(n < 1024 ** (i + 1), F.format_string(f"%.1f {unit}", F.bround(n / F.lit(1024.0**i), 1))).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("bigint"))).otherwise(F.when(n.isNotNull(), out))


def parse_time(text: Column) -> Column:
    """ISO 8601 date-times, with a Z or an offset or taken for UTC, as
    timestamps; null for anything else."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d"), F.try_to_timestamp(zoned))


def human_age(then: Column, now: Column) -> Column:
    """Time since `then` in its largest unit; a dash for null."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    day = F.floor(s / 86400)
    rest = s - day * 86400
    ago = lambda n, u: F.concat(n.cast("string"), F.lit(f"{u} ago"))
    return (
        F.when(then.isNull(), F.lit("—")).when(day >= 1, ago(day, "d")).when(rest >= 3600, ago(F.floor(rest / 3600), "h"))
        .when(rest >= 60, ago(F.floor(rest / 60), "m")).otherwise(F.lit("just now"))
    )


def fmt_eta(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    txt = lambda c: c.cast("string")
    m, h = F.floor(s / 60), F.floor(s / 3600)
    return (
        F.when(s < 60, F.concat(txt(s), F.lit("s")))
        .when(s < 3600, F.concat(txt(m), F.lit("m "), txt(s % 60), F.lit("s")))
        .otherwise(F.concat(txt(h), F.lit("h "), txt(F.floor((s % 3600) / 60)), F.lit("m")))
    )


def fmt_elapsed(seconds: Column) -> Column:
    m = F.floor(seconds / 60)
    return F.when(seconds < 60, F.format_string("%.2fs", F.bround(seconds, 2))).otherwise(F.concat(m.cast("string"), F.format_string("m %.0fs", F.bround(seconds - m * 60, 0))))


def shorten(path: str, root: str, width: int) -> str:
    """A path relative to root in at most `width` characters: middle parts give
    way to an ellipsis first, leading ones next, then the name is cut."""
    p = PurePosixPath(path)
    parts = list(p.relative_to(root).parts if p.is_relative_to(root) else p.parts)
    if not parts:
        return path[:width]
    tries = ["/".join(parts)]
    if len(parts) >= 3:
        tries += ["/".join([*parts[:k], "…", *parts[-2:]]) for k in range(len(parts) - 2, 0, -1)]
    if len(parts) >= 2:
        tries.append("/".join(["…", *parts[-2:]]))
    tries.append("…/" + parts[-1])
    return next((t for t in tries if len(t) <= width), parts[-1][:width])


def fmt_path(path: Column, root: Column, width: int) -> Column:
    @F.pandas_udf("string")
    def run(paths: pd.Series, roots: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or r is None else shorten(p, r, width) for p, r in zip(paths, roots)], dtype=object)

    return run(path, root)
