"""Filling fixed-capacity containers with items.

Planning works on the histogram of lengths, not on documents: best fit in
order of decreasing length over counts.  Containers with the same room are one
class, and placing a length moves whole runs of containers from class to class,
so a plan has a size that depends on the capacity only.  Documents then take the
planned slots by their rank among the documents of their length.

The rank is two-level: within (length, salt), plus the counts of lower salts.  A
length that a third of all documents share is thus ranked by many tasks.

Items above the capacity fill whole containers of their own and their rest is
an item like others.  Nulls and empty texts have length 0: they are assigned to
container 0 without taking room.  Repeated ids are separate items with rows of
their own.  Empty tables give empty results.
"""

from __future__ import annotations

import base64
import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SALTS = 64

_encoding: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of this worker process."""
    if path not in _encoding:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoding[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoding[path]


def token_lengths(docs: DataFrame, ident: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of whole texts."""

    @F.pandas_udf("bigint")
    def run(col: pd.Series) -> pd.Series:
        enc = encoding(vocabulary)
        return pd.Series([len(x) for x in enc.encode_ordinary_batch([t or "" for t in col], num_threads=1)])

    return docs.select(F.col(ident).cast("bigint").alias("doc_id"), run(F.col(text)).alias("tokens"))


class Plan:
    """Slots for lengths 1..capacity: intervals of ranks of a length, each a
    run of containers that take `per` of it one after the other."""

    def __init__(self, capacity: int, counts: dict[int, int]):
        self.capacity, self.containers, self.used = capacity, 0, 0
        rooms: list[int] = []  # sorted free room of open classes
        runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first container, how many)
        slots: list[tuple[int, int, int, int]] = []  # length, first rank, first container, per

        def put(room: int, first: int, n: int) -> None:
            if room and n:
                if room not in runs:
                    bisect.insort(rooms, room)
                    runs[room] = []
                runs[room].append((first, n))

        for length in sorted((x for x in counts if x > 0), reverse=True):
            left, rank = counts[length], 0
            self.used += length * left
            while left:
                at = bisect.bisect_left(rooms, length)
                if at < len(rooms):
                    room = rooms[at]
                    first, n = runs[room].pop()
                    if not runs[room]:
                        del runs[room], rooms[at]
                else:
                    room, first = capacity, self.containers
                    n = -(-left // (capacity // length))
                    self.containers += n
                per = room // length
                full, rest = min(n, left // per), 0
                if full < n:
                    rest = left - full * per  # fewer than `per`: the last of them goes into one more container
                if full:
                    slots.append((length, rank, first, per))
                    put(room - per * length, first, full)
                    rank, left = rank + full * per, left - full * per
                if full < n:
                    if rest:
                        slots.append((length, rank, first + full, rest))
                        put(room - rest * length, first + full, 1)
                        rank, left = rank + rest, left - rest
                    put(room, first + full + bool(rest), n - full - bool(rest))
        a = np.array(sorted(slots), dtype=np.int64).reshape(-1, 4)
        self.length, self.rank, self.first, self.per = a[:, 0], a[:, 1], a[:, 2], a[:, 3]

    def place(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Containers of items by length and rank (from 0)."""
        top = np.int64(1) << 40
        i = np.searchsorted(self.length * top + self.rank, length * top + rank, side="right") - 1
        return self.first[i] + (rank - self.rank[i]) // self.per[i]


def ranked(lengths: DataFrame) -> DataFrame:
    """Adds `rank` from 0 among the items of a length, by (salt, id, copy)."""
    x = lengths.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    c = x.groupBy("tokens", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("tokens").orderBy("_salt")
    c = c.withColumn("_off", F.sum("_n").over(w) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy("tokens", "_salt").orderBy("doc_id")) - 1
    return x.withColumn("_r", own).join(c, ["tokens", "_salt"]).withColumn("rank", F.col("_r") + F.col("_off")).drop("_r", "_off", "_salt")


def histogram(lengths: DataFrame) -> dict[int, int]:
    """Counts by length: one row per distinct length on the driver."""
    return {r[0]: r[1] for r in lengths.groupBy("tokens").count().collect()}


def assign(lengths: DataFrame, limits: list[tuple[str, int]]) -> DataFrame:
    """(limit_name, doc_id, part, container_id, tokens): each item in one
    container, items above the capacity in several parts.  `lengths` is read
    twice per call; write it first if it is costly."""
    counts = histogram(lengths)  # bounded below by the split: lengths above a capacity are folded to rests
    plans, wide = {}, {}
    for name, cap in limits:
        if cap < 1:
            raise ValueError(f"capacity of {name}")
        h: dict[int, int] = {}
        whole: dict[int, tuple[int, int]] = {}  # length above the capacity: containers before it, rank offset of its rest
        before = 0
        for n in sorted(counts):
            rest = n % cap if n > cap else n
            if n > cap:
                whole[n] = (before, h.get(rest, 0))
                before += counts[n] * (n // cap)
            if rest:
                h[rest] = h.get(rest, 0) + counts[n]
        plans[name], wide[name] = (cap, before, Plan(cap, h)), whole
    schema = "limit_name string, doc_id bigint, part int, container_id bigint, tokens bigint"

    def run(batches):
        for pdf in batches:
            n, r, d = (pdf[c].to_numpy(dtype=np.int64) for c in ("tokens", "rank", "doc_id"))
            for name, (cap, before, plan) in plans.items():
                big = n > cap
                rest = np.where(big, n % cap, n)
                shift = np.zeros(len(n), dtype=np.int64)
                if big.any():
                    shift[big] = [wide[name][x][1] for x in n[big]]
                    k = n[big] // cap
                    base = np.array([wide[name][x][0] for x in n[big]], dtype=np.int64) + r[big] * k
                    ids, part = np.repeat(d[big], k), np.concatenate([np.arange(x) for x in k])
                    yield pd.DataFrame({"limit_name": name, "doc_id": ids, "part": part, "container_id": np.repeat(base, k) + part, "tokens": cap})
                some = rest > 0
                if some.any():
                    at = before + plan.place(rest[some], r[some] + shift[some])
                    yield pd.DataFrame({"limit_name": name, "doc_id": d[some], "part": np.where(big, n // cap, 0)[some], "container_id": at, "tokens": rest[some]})
                none = n == 0
                if none.any():
                    yield pd.DataFrame({"limit_name": name, "doc_id": d[none], "part": 0, "container_id": 0, "tokens": 0})

    return ranked(lengths).select("doc_id", "tokens", "rank").mapInPandas(run, schema)


def utilisation(placed: DataFrame, limits: DataFrame) -> DataFrame:
    """Containers, tokens and the share of their room in use per limit."""
    c = placed.groupBy("limit_name").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    return c.join(F.broadcast(limits), "limit_name").withColumn("used", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


def limits_of(spark: SparkSession, df: DataFrame, most: int = 1000) -> list[tuple[str, int]]:
    """The capacities, checked to be few."""
    rows = df.select("limit_name", "capacity_tokens").distinct().orderBy("limit_name").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} limits")
    return [(r[0], r[1]) for r in rows]
