"""Splitting oversized items at natural boundaries.

Work goes by byte ranges.  (1) Each range counts the tokens that start in it,
looking one character to the left.  (2) Counts are stitched by a prefix sum, so
that every range knows the number of its first token in the whole item.  (3)
The k-th cut lies in a fixed window of token numbers, so a range finds the cuts
of its own windows alone, with a halo on either side: the strongest boundary
wins (blank line, line, sentence, any token), the later one on ties.  (4) Cuts
are stitched to pieces by number and emitted by offset.  No step reads an item
as a whole or goes through it in sequence.  Tokens are found in bytes, by the
encodings of the whitespace characters, so that offsets are exact whatever the
bytes are; bytes that are no UTF-8 belong to tokens and are replaced in texts.

A window of 64 numbers every 384 keeps two neighbouring cuts at most 447 tokens
apart, so a piece with its 64 repeated tokens has at most 511.

Nulls and empty texts give no piece; items up to the limit give none either.
Repeated rows give one set of pieces; two contents under one id give both.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP, SLACK = 512, 64, 64
RANGE, HALO = 1 << 20, 1 << 14
FILE_RANGE = 16 << 20
Read = Callable[[int, int], bytes]

# Whitespace of one byte, and UTF-8 encodings of the other whitespace characters.
PLAIN = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21)])
WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", *(b"\xe2\x80" + bytes([x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\xe2\x81\x9f", b"\xe3\x80\x80")

PIECES = "item_table string, item_id bigint, chunk_index int, core_start bigint, byte_start bigint, byte_end bigint, tokens int, text string, content_hash bigint"


class Grid:
    """The windows of the cuts for a limit, an overlap and a slack."""

    def __init__(self, limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK):
        if not 0 <= overlap < limit - 2 * slack or slack < 1:
            raise ValueError("the limit must exceed the overlap and two slacks")
        self.limit, self.overlap, self.slack = limit, overlap, slack
        self.step = limit - overlap - slack

    def cuts(self, total: int) -> int:
        """Number of cuts of an item of `total` tokens."""
        return 0 if total <= self.limit else max(1, -(-(total - self.limit + self.overlap - 1 + self.slack - (self.limit - self.step)) // self.step))

    def window(self, k: int, total: int) -> tuple[int, int]:
        """Token numbers [a, b] before which cut k (from 1) may lie."""
        b = self.limit + (k - 1) * self.step
        return b - self.slack + 1, min(b, total - 1)


def strength(gap: bytes, last: int) -> int:
    lines = gap.count(b"\n")
    return min(3, 1 + lines) if lines else int(last in b".!?;:})]")


def char_start(read: Read, at: int, size: int) -> int:
    """The first byte at or after `at` that starts a character; after three
    that do not there is none, and no whitespace reaches as far."""
    if not 0 < at < size:
        return min(at, size)
    few = read(at, min(at + 3, size))
    return at + next((i for i, x in enumerate(few) if x & 0xC0 != 0x80), len(few))


def spaces(b: np.ndarray) -> np.ndarray:
    """Which bytes belong to whitespace characters."""
    m = PLAIN[b]
    if len(b) and b.max() >= 0x80:
        for code in WIDE:
            at = np.flatnonzero(b[: max(0, len(b) - len(code) + 1)] == code[0])
            for i in range(1, len(code)):
                at = at[b[at + i] == code[i]]
            for i in range(len(code)):
                m[at + i] = True
    return m


def _tokens(read: Read, a: int, b: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Bytes [a, b), and the starts and ends of its tokens within them; a token
    cut by `a` is left out, one cut by `b` is kept."""
    data = read(a, b)
    inside = np.concatenate(([False], ~spaces(np.frombuffer(data, dtype=np.uint8)), [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if a > 0 and len(starts) and starts[0] == 0 and not spaces(np.frombuffer(read(max(0, a - 3), a), dtype=np.uint8))[-1]:
        starts, ends = starts[1:], ends[1:]
    return data, starts, ends


def count(read: Read, s: int, e: int, size: int) -> int:
    """Step 1: tokens that start in the range [s, e)."""
    s, e = char_start(read, s, size), char_start(read, e, size)
    return len(_tokens(read, s, e)[1]) if s < e else 0


def cuts(read: Read, s: int, e: int, size: int, first: int, total: int, grid: Grid) -> list[tuple[int, int, int, int, int]]:
    """Step 3: (k, cut byte, repeat byte, cut token, repeat token) of the cuts
    whose window starts with a token of the range; `first` is the number of
    its first token."""
    s, e = char_start(read, s, size), char_start(read, e, size)
    n = count(read, s, e, size)
    k = max(1, (first - (grid.limit - grid.slack + 1)) // grid.step)
    want = []
    while k <= grid.cuts(total) and grid.window(k, total)[0] < first + n:
        if grid.window(k, total)[0] >= first:
            want.append(k)
        k += 1
    if not want:
        return []
    lo, hi = grid.window(want[0], total)[0] - grid.overlap, grid.window(want[-1], total)[1]
    halo = HALO
    while True:  # widen the halo until it holds every token that is asked for
        a, b = char_start(read, max(0, s - halo), size), char_start(read, min(size, e + halo), size)
        data, starts, ends = _tokens(read, a, b)
        base = first - int(np.searchsorted(starts + a, s)) if a else 0
        if (a == 0 or base <= lo) and (b == size or base + len(starts) > hi + 1):
            break
        halo *= 4
    out = []
    for k in want:
        x, y = grid.window(k, total)
        best = max(range(x, y + 1), key=lambda t: (strength(data[ends[t - base - 1] : starts[t - base]], data[ends[t - base - 1] - 1]), t))
        r = max(0, best - grid.overlap)
        out.append((k, a + int(starts[best - base]), a + int(starts[r - base]), best, r))
    return out


def pieces_of(data: bytes, grid: Grid, size_of_range: int = RANGE) -> list[tuple[int, int, int, int, int]]:
    """(index, core start, start, end, tokens) of one item; [] up to the limit."""
    size = len(data)
    read = lambda a, b: data[a:b]
    ranges = [(s, min(size, s + size_of_range)) for s in range(0, size, size_of_range)]
    n = [count(read, s, e, size) for s, e in ranges]
    total = sum(n)
    if total <= grid.limit:
        return []
    found, first = [], 0
    for (s, e), m in zip(ranges, n):
        found += cuts(read, s, e, size, first, total, grid)
        first += m
    starts = [(0, 0, 0), *[(c, r, rt) for _, c, r, _, rt in found]]
    ends = [*[(c, ct) for _, c, _, ct, _ in found], (size, total)]
    return [(i, c, r, e, et - rt) for i, ((c, r, rt), (e, et)) in enumerate(zip(starts, ends))]


def split_table(df: DataFrame, name: str, ident: str, text: str, grid: Grid | None = None, with_text: bool = True) -> DataFrame:
    """Pieces of the texts of a table.  A text that cannot hold more than the
    limit (each token but the last needs two characters) never leaves the JVM."""
    grid = grid or Grid()
    rows = df.select(F.lit(name).alias("item_table"), F.col(ident).cast("bigint").alias("item_id"), F.col(text).alias("text")).where(F.col("item_id").isNotNull() & (F.length("text") >= 2 * grid.limit + 1))
    rows = rows.withColumn("content_hash", F.xxhash64("text"))

    def run(batches):
        for pdf in batches:
            out = []
            for i, t, h in zip(pdf["item_id"], pdf["text"], pdf["content_hash"]):
                data = t.encode("utf-8", errors="replace")
                for k, c, s, e, n in pieces_of(data, grid):
                    out.append((name, i, k, c, s, e, n, data[s:e].decode("utf-8", errors="replace") if with_text else None, h))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in PIECES.split(", ")])

    made = rows.mapInPandas(run, PIECES)
    return made.dropDuplicates(["item_table", "item_id", "content_hash", "chunk_index"])


# ---- files, each range by whatever task gets it


def _reader(path: str) -> Read:
    from pyarrow import fs

    system, p = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
    f = system.open_input_file(p)

    def read(a: int, b: int) -> bytes:
        f.seek(a)
        return f.read(b - a)

    return read


class _Files:
    """Readers that keep one file open and the last stretch read from it."""

    def __init__(self, ahead: int = 4 << 20):
        self.path, self.ahead = None, ahead

    def of(self, path: str) -> Read:
        if path != self.path:
            self.path, self.raw, self.lo, self.data = path, _reader(path), 0, b""
        return self.read

    def read(self, a: int, b: int) -> bytes:
        if not self.lo <= a <= b <= self.lo + len(self.data):
            if b - a > self.ahead:
                return self.raw(a, b)
            self.lo, self.data = a, self.raw(a, a + self.ahead)
        return self.data[a - self.lo : b - self.lo]


def write_files(texts: DataFrame, folder: str) -> DataFrame:
    """Write each (name, text) as a file of the folder; returns the names.  A
    repeated task writes the same files again."""
    uri = folder if "://" in folder or folder.startswith("file:") else "file://" + folder

    def run(batches):
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(uri)
        system.create_dir(top, recursive=True)
        for pdf in batches:
            for name, text in zip(pdf["name"], pdf["text"]):
                with system.open_output_stream(f"{top}/{name}") as f:
                    f.write(text.encode("utf-8", errors="replace"))
            yield pdf[["name"]]

    return texts.select("name", "text").mapInPandas(run, "name string")


def split_files(spark: SparkSession, folder: str, grid: Grid | None = None, size_of_range: int = FILE_RANGE, with_text: bool = True) -> DataFrame:
    """(path, chunk_index, core_start, byte_start, byte_end, tokens, text) of
    the files below a folder.  Only ranges with halos are ever read; the one
    ordered step is the prefix sum over one row per range."""
    grid = grid or Grid()
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size")).where("size > 0")
    ranges = listed.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(size_of_range).cast("bigint"))).alias("s")).withColumn("e", F.least(F.col("size"), F.col("s") + size_of_range))
    ranges = ranges.repartition("path", "s")

    def step1(batches):
        for pdf in batches:
            files = _Files()
            pdf["n"] = [count(files.of(p), s, e, z) for p, s, e, z in zip(pdf["path"], pdf["s"], pdf["e"], pdf["size"])]
            yield pdf

    counted = ranges.mapInPandas(step1, "path string, size bigint, s bigint, e bigint, n bigint")
    w = Window.partitionBy("path")
    counted = counted.withColumn("first", F.sum("n").over(w.orderBy("s")) - F.col("n")).withColumn("total", F.sum("n").over(w)).where(F.col("total") > grid.limit)

    def step3(batches):
        for pdf in batches:
            out, files = [], _Files()
            for p, z, s, e, f, t in zip(pdf["path"], pdf["size"], pdf["s"], pdf["e"], pdf["first"], pdf["total"]):
                for k, c, r, ct, rt in cuts(files.of(p), s, e, z, f, t, grid):
                    out += [(p, k - 1, None, None, c, None, ct), (p, k, c, r, None, rt, None)]
                if s == 0:
                    out.append((p, 0, 0, 0, None, 0, None))
                if e == z:
                    out.append((p, grid.cuts(t), None, None, z, None, t))
            yield pd.DataFrame(out, columns=["path", "k", "core", "a", "b", "ta", "tb"]).astype({c: "Int64" for c in ("core", "a", "b", "ta", "tb")})

    half = counted.repartition("path", "s").mapInPandas(step3, "path string, k int, core bigint, a bigint, b bigint, ta bigint, tb bigint")
    whole = half.groupBy("path", F.col("k").alias("chunk_index")).agg(F.max("core").alias("core_start"), F.max("a").alias("byte_start"), F.max("b").alias("byte_end"), (F.max("tb") - F.max("ta")).cast("int").alias("tokens"))
    if not with_text:
        return whole

    def emit(batches):
        for pdf in batches:
            files = _Files()
            pdf["text"] = [files.of(p)(a, b).decode("utf-8", errors="replace") for p, a, b in zip(pdf["path"], pdf["byte_start"], pdf["byte_end"])]
            yield pdf

    # neighbouring pieces together and in order: a stretch of a file is read once
    near = whole.withColumn("_at", F.floor(F.col("byte_start") / size_of_range)).repartition("path", "_at").sortWithinPartitions("path", "byte_start").drop("_at")
    return near.mapInPandas(emit, "path string, chunk_index int, core_start bigint, byte_start bigint, byte_end bigint, tokens int, text string")
