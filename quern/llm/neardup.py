"""Near-duplicate records with small edits.

MinHash LSH forest.  Every text has a signature of lanes; every tree reads a
string of `DEPTH` labels from it, and the strings of a tree, sorted, are its
prefix trie laid flat: texts below one node stand next to each other.  Pairs
come from texts that share a prefix in some tree.

How long a prefix must match is found from the data.  All matches of whole
strings show how similar the pairs of the collection are: a pair that agrees in a share p of its lanes matches all labels
of a tree with chance p^DEPTH, so each match stands for the inverse of that many
pairs.  The matched prefix is then shortened label by label until the pairs so
estimated are met, in some tree, with the target recall; where nothing matches,
until a pair right at the threshold would be.  Pairs are compared by their
signatures and verified exactly on their sets of word sequences.

Identical word sequences form a class first; only its representative (lowest
id) goes through the trees, so a text that a third of all rows repeat is one
row.  Nodes of many texts (found by counting all, or met on the way) are cut
into blocks by a hash, every pair of blocks is a task of its own, and only
pairs that their signatures do not rule out leave it: nothing is capped, what
is written grows with the likely pairs, and no task holds more than two blocks.

Nulls: a null id or text takes no part, nor a text below `least` words.
Repeated ids count once (with the text of the lower hash).  Empty tables give
empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import written

WORDS, SIMILARITY, LEAST = 5, 0.8, 50
LANES, TREES, DEPTH = 128, 32, 8  # tree t reads its string from lane 4t on
TARGET = 0.99  # recall aimed at
CROWD, BLOCK = 512, 2048  # texts of a node compared in one go; texts in a block of a larger one
HOT = 4096  # nodes of so many texts never enter one task
SLACK = 5.0  # standard deviations below the threshold at which a signature rules a pair out
BROADCAST_ROWS = 500_000  # ids of at most 16 MB; beyond, a shuffled join

WORD = re.compile(r"[a-z0-9_]+")
_cache: dict[str, int] = {}


def met(p: np.ndarray, k: int, trees: int = TREES) -> np.ndarray:
    """Chance that a pair agreeing in a share p of its lanes shares the first k
    labels in some tree."""
    return 1 - (1 - p**k) ** trees


def at_threshold(threshold: float) -> float:
    """Share of lanes in which pairs of the threshold agree (lanes of 8 bits
    also agree by chance)."""
    return threshold + (1 - threshold) / 256


def shortened(agreeing: dict[int, int], threshold: float, target: float = TARGET, deepest: int = DEPTH) -> int:
    """The longest prefix with the target recall, for matches of whole strings
    counted by how many lanes agree."""
    p = at_threshold(threshold)
    seen = {a / LANES: n for a, n in agreeing.items() if a >= LANES * p}
    share = np.array(list(seen) or [p])
    pairs = np.array(list(seen.values()) or [1.0]) / share**deepest
    k = deepest
    while k > 1 and (pairs * met(share, k)).sum() < target * pairs.sum():
        k -= 1
    return k


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_numbers(words: list[str]) -> list[int]:
    import xxhash

    if len(_cache) > 1_000_000:
        _cache.clear()
    get, out = _cache.get, []
    for w in words:
        n = get(w)
        if n is None:
            n = _cache[w] = xxhash.xxh3_64_intdigest(w)
        out.append(n)
    return out


def sequences(numbers: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n consecutive words."""
    m = len(numbers) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = numbers[:m]
    for i in range(1, n):
        h = _mix(h + np.uint64(0x9E3779B97F4A7C15)) ^ numbers[i : i + m]
    return _mix(h)


def _family() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return (r.integers(0, 1 << 32, LANES, dtype=np.uint32) | np.uint32(1)), r.integers(0, 1 << 32, LANES, dtype=np.uint32)


def signatures(shingles: list[np.ndarray], tile: int = 1 << 15) -> np.ndarray:
    """Lanes (one byte each) of non-empty sets, in tiles that fit the cache."""
    a, b = _family()
    out = np.empty((len(shingles), LANES), dtype=np.uint32)
    at = 0
    while at < len(shingles):
        end, size = at, 0
        while end < len(shingles) and (size == 0 or size + len(shingles[end]) <= tile):
            size += len(shingles[end])
            end += 1
        x = (np.concatenate(shingles[at:end]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *[len(s) for s in shingles[at : end - 1]]])
        for i in range(LANES):
            out[at:end, i] = np.minimum.reduceat(x * a[i] + b[i], starts)
        at = end
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def signed(texts: DataFrame, words: int, least: int) -> DataFrame:
    """(tab, id, h1, h2, sig) of the texts (tab, id, text) long enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for whole in batches:
            for at in range(0, len(whole), 2000):
                pdf = whole.iloc[at : at + 2000]
                keep, sets, hashes = [], [], []
                for i, t in enumerate(pdf["text"]):
                    w = WORD.findall(t.lower())
                    if len(w) >= max(least, words):
                        keep.append(i)
                        hashes.append(xxhash.xxh3_128_digest(" ".join(w)))
                        sets.append(sequences(np.array(word_numbers(w), dtype=np.uint64), words))
                if keep:
                    h = np.frombuffer(b"".join(hashes), dtype=np.int64).reshape(-1, 2)
                    sig = signatures(sets)
                    part = pdf.iloc[keep]
                    yield pd.DataFrame({"tab": part["tab"].to_numpy(), "id": part["id"].to_numpy(), "h1": h[:, 0], "h2": h[:, 1], "sig": [s.tobytes() for s in sig]})

    return texts.mapInPandas(run, "tab int, id bigint, h1 bigint, h2 bigint, sig binary")


def classes(sig: DataFrame) -> DataFrame:
    """(tab, id, rep, h1, h2): each id once, with the lowest id of its class
    and the hash of its text."""
    one = sig.groupBy("tab", "id").agg(F.min(F.struct("h1", "h2")).alias("h"))
    rep = one.groupBy("tab", "h").agg(F.min("id").alias("rep"))
    return one.join(rep, ["tab", "h"]).select("tab", "id", "rep", "h.h1", "h.h2")


def strings(reps: DataFrame, trees: int = TREES) -> DataFrame:
    """(tree, labels, id): a row per tree; tables have trees of their own.  The
    first label is the highest byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            ids, tab = b.column("id").to_numpy(zero_copy_only=False), b.column("tab").to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype=np.uint8).reshape(n, LANES)
            for t in range(trees):
                lanes = (LANES // trees * t + np.arange(DEPTH)) % LANES
                labels = np.ascontiguousarray(sig[:, lanes]).view(">i8").ravel().astype(np.int64)
                yield pa.record_batch([pa.array((tab * trees + t).astype(np.int32)), pa.array(labels), pa.array(ids)], names=["tree", "labels", "id"])

    return reps.select("tab", "id", "sig").mapInArrow(run, "tree int, labels bigint, id bigint")


def keyed(trees: DataFrame, k: int) -> DataFrame:
    """(key, id): nodes at depth k."""
    return trees.select(F.xxhash64("tree", F.shiftright("labels", 8 * (DEPTH - k))).alias("key"), "id")


def _within(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within groups, a group size at a time."""
    for n in np.unique(sizes):
        if n > 1:
            g = ids[starts[sizes == n][:, None] + np.arange(n)]
            i, j = np.triu_indices(n, 1)
            rows = max(1, 2_000_000 // len(i))
            for at in range(0, len(g), rows):
                x, y = g[at : at + rows][:, i].ravel(), g[at : at + rows][:, j].ravel()
                yield np.minimum(x, y), np.maximum(x, y)


def walk_trees(keys: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One pass over the sorted trees.  Rows with `b` are pairs a < b of ids
    under one prefix; rows without are members of crowded prefixes, with the
    number of their block."""
    names = ["key", "a", "b", "block"]

    def rows(key, a, b, block):
        n = len(a)
        some = lambda v, kind: pa.nulls(n, kind) if v is None else pa.array(v, kind)
        return pa.record_batch([some(key, pa.int64()), pa.array(a, pa.int64()), some(b, pa.int64()), some(block, pa.int32())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, seen = None, np.zeros(0, dtype=np.int64), 0  # the open group; seen: rows of it already sent as a crowd

        def flush():
            if held_key is None:
                return
            if seen:
                if len(held):
                    yield rows(np.full(len(held), held_key), held, None, (seen + np.arange(len(held))) // BLOCK)
            elif len(held) > 1:
                for a, b in _within(held, np.array([0]), np.array([len(held)])):
                    yield rows(None, a, b, None)

        for batch in batches:
            key, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id"))
            if not len(key):
                continue
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.concatenate((edge, [len(key)])))
            first = 0
            if key[0] == held_key:
                held, first = np.concatenate((held, ids[: size[0]])), 1
            if first == 0 or len(edge) > 1:
                yield from flush()
                mid = slice(first, len(edge) - 1)
                e, s = edge[mid], size[mid]
                for a, b in _within(ids, e[s <= crowd], s[s <= crowd]):
                    yield rows(None, a, b, None)
                for x, n in zip(e[s > crowd], s[s > crowd]):
                    yield rows(np.full(n, key[x]), ids[x : x + n], None, np.arange(n) // BLOCK)
                held_key, held, seen = key[edge[-1]], ids[edge[-1] :], 0
            while len(held) > crowd:
                yield rows(np.full(crowd, held_key), held[:crowd], None, (seen + np.arange(crowd)) // BLOCK)
                held, seen = held[crowd:], seen + crowd
        yield from flush()

    spark = keys.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "key bigint, a bigint, b bigint, block int")


def hot_nodes(keys: DataFrame) -> DataFrame:
    """(key, blocks) of large nodes."""
    c = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT)
    return c.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))


def crowded_pairs(members: DataFrame, sig: DataFrame, threshold: float) -> DataFrame:
    """Likely pairs below crowded nodes (key, a, block, last): every member
    goes with its signature to the tasks of the block pairs its block is in."""
    s = sig.select(F.col("id").alias("a"), "sig").dropDuplicates(["a"])
    x = members.join(s, "a").select("key", "a", "sig", "block", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    x = x.select("key", "a", "sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    least = least_agreement(threshold)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, left = pdf["a"].to_numpy(), (pdf["block"] == pdf["i"]).to_numpy()
        lanes = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint8).reshape(-1, LANES)
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        x, y = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        a, b = [], []
        for n, i in enumerate(x):
            to = y[n + 1 :] if same else y
            near = to[(lanes[to] == lanes[i]).sum(axis=1) >= least]
            a.append(np.full(len(near), ids[i]))
            b.append(ids[near])
        a, b = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (a, b))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return x.groupBy("key", "i", "j").applyInPandas(pairs, "a bigint, b bigint")


def least_agreement(threshold: float) -> float:
    """Lanes in which a pair of the threshold agrees, `SLACK` deviations less."""
    p = at_threshold(threshold)
    return LANES * p - SLACK * (LANES * p * (1 - p)) ** 0.5


def agreement(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with lanes: in how many the signatures agree."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(-1, LANES) for s in (a, b))
        return pd.Series((x == y).sum(axis=1), dtype="int32")

    s = sig.select("id", "sig")
    j = pairs.join(s.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    return j.select(*pairs.columns, run("sa", "sb").alias("lanes"))


def below(keys: DataFrame, lone: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), once for every node they are below: all pairs of small
    nodes, likely pairs of crowded ones."""
    hot = written(hot_nodes(keys), "hot")
    some = not hot.isEmpty()
    walked = written(walk_trees(keys.join(hot, "key", "left_anti") if some else keys), "walked")
    small = walked.where("b is not null").select("a", "b")
    crowds = []
    if some:
        crowds.append(keys.join(hot, "key").select("key", F.col("id").alias("a"), F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), (F.col("blocks") - 1).alias("last")))
    rest = walked.where("b is null").select("key", "a", "block")
    if not rest.isEmpty():
        crowds.append(rest.join(rest.groupBy("key").agg(F.max("block").alias("last")), "key"))
    crowded = [crowded_pairs(c, lone, threshold) for c in crowds]
    return small, reduce(DataFrame.unionByName, crowded) if crowded else small.limit(0)


def candidates(lone: DataFrame, threshold: float, target: float = TARGET) -> DataFrame:
    """(a, b) of texts (tab, id, sig) that meet in the forest and whose
    signatures do not rule the threshold out."""
    trees = strings(lone)
    small, crowded = below(keyed(trees, DEPTH), lone, threshold)
    deep = small.unionByName(crowded).groupBy("a", "b").agg(F.count(F.lit(1)).alias("nodes"))
    seen = agreement(deep, lone).groupBy("lanes").agg(F.sum("nodes").alias("nodes")).collect()  # at most a row per number of lanes
    k = shortened({r["lanes"]: r["nodes"] for r in seen}, threshold, target)
    if k < DEPTH:
        small, crowded = below(keyed(trees, k), lone, threshold)
    near = agreement(small.distinct(), lone).where(F.col("lanes") >= least_agreement(threshold)).select("a", "b")
    return near.unionByName(crowded).distinct()


def verified(pairs: DataFrame, texts: DataFrame, words: int, threshold: float, least: int = 0) -> DataFrame:
    """(a, b, similarity) of pairs of enough Jaccard similarity of their sets
    of word sequences.  Only texts in some pair are read into sets."""

    ids = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    if pairs.count() <= BROADCAST_ROWS // 2:
        ids = F.broadcast(ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            found = [WORD.findall(t.lower()) for t in pdf["text"]]
            long = [len(w) >= max(least, words) for w in found]
            pdf, found = pdf[long], [w for w, x in zip(found, long) if x]
            h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(" ".join(w)) for w in found), dtype=np.int64).reshape(-1, 2)
            sets = [np.unique(sequences(np.array(word_numbers(w), dtype=np.uint64), words)).tobytes() for w in found]
            yield pd.DataFrame({"uid": pdf["uid"], "h1": h[:, 0], "h2": h[:, 1], "set": sets})

    # of repeated ids with different texts, the one of the lower hash
    chosen = texts.join(ids, "uid", "left_semi").select("uid", "text").mapInPandas(run, "uid bigint, h1 bigint, h2 bigint, set binary")
    kept = chosen.groupBy("uid").agg(F.min(F.struct("h1", "h2", "set")).alias("x"))
    sets = written(kept.select("uid", F.col("x.set").alias("set")), "sets")

    @F.pandas_udf("double")
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both / (len(x) + len(y) - both)

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)

    j = pairs.join(sets.select(F.col("uid").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("uid").alias("b"), F.col("set").alias("y")), "b")
    return j.select("a", "b", jaccard("x", "y").alias("similarity")).where(F.col("similarity") >= threshold)


class NearDuplicates:
    """members: (item_table, id, rep) of every text that takes part; links:
    (item_table, id_a, id_b, similarity) between representatives."""

    def __init__(self, tables: list[tuple[DataFrame, str, str, str]], words: int = WORDS, threshold: float = SIMILARITY, least: int = LEAST, target: float = TARGET):
        """tables: (rows, name, id column, text column) each compared within
        itself.  Ids of table i are kept apart as id * n + i; ids beyond
        2^63 / n would overflow and fail."""
        n = len(tables)
        self.names = [t[1] for t in tables]
        uid = lambda c, i: c * n + i
        rows = [df.select(F.lit(i).alias("tab"), uid(F.col(key).cast("bigint"), i).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null") for i, (df, _, key, text) in enumerate(tables)]
        # a text of `least` words has 2 * least - 1 characters at least
        texts = reduce(DataFrame.unionByName, rows).where(F.length("text") >= 2 * max(least, words) - 1)
        sig = written(signed(texts, words, least), "signatures")
        cls = written(classes(sig), "classes")
        lone = written(sig.join(cls.where("id = rep").select("id", "h1", "h2"), ["id", "h1", "h2"], "left_semi").dropDuplicates(["id"]), "lone")
        near = written(candidates(lone, threshold, target), "likely")
        links = written(verified(near, texts.withColumnRenamed("id", "uid"), words, threshold, least), "links")
        name = F.element_at(F.array(*[F.lit(x) for x in self.names]), (F.pmod("a", F.lit(n)) + 1).cast("int"))
        plain = lambda c: F.floor((F.col(c) - F.pmod(F.col(c), F.lit(n))) / n).cast("bigint") if n > 1 else F.col(c)
        self.links = links.select(name.alias("item_table"), plain("a").alias("id_a"), plain("b").alias("id_b"), "similarity")
        by_tab = F.element_at(F.array(*[F.lit(x) for x in self.names]), F.col("tab") + 1)
        self.members = cls.select(by_tab.alias("item_table"), plain("id").alias("id"), plain("rep").alias("rep"))

    def pairs(self) -> DataFrame:
        """All pairs of different ids, copies included: (item_table, id_a,
        id_b) with id_a < id_b.  Its size is that of the answer."""
        m = self.members
        a, b = m.select("item_table", F.col("rep").alias("ra"), F.col("id").alias("x")), m.select("item_table", F.col("rep").alias("rb"), F.col("id").alias("y"))
        links = self.links.select("item_table", F.col("id_a").alias("ra"), F.col("id_b").alias("rb"))
        across = links.join(a, ["item_table", "ra"]).join(b, ["item_table", "rb"]).select("item_table", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        more = m.groupBy("item_table", "rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("item_table", F.col("rep").alias("ra"))
        copies = a.join(more, ["item_table", "ra"], "left_semi")
        same = copies.join(copies.select("item_table", "ra", F.col("x").alias("y")), ["item_table", "ra"]).where("x < y").select("item_table", F.col("x").alias("id_a"), F.col("y").alias("id_b"))
        return across.unionByName(same)

    def groups(self) -> DataFrame:
        """(item_table, id, group_id, links): one row per text; group_id is the
        lowest id that links lead to, links counts those of its class."""
        label = components(self.links.select("item_table", F.col("id_a").alias("u"), F.col("id_b").alias("v")))
        ends = self.links.select("item_table", F.explode(F.array("id_a", "id_b")).alias("rep")).groupBy("item_table", "rep").agg(F.count(F.lit(1)).alias("links"))
        m = self.members.join(label.withColumnRenamed("u", "rep"), ["item_table", "rep"], "left").join(ends, ["item_table", "rep"], "left")
        return m.select("item_table", "id", F.coalesce("root", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """(item_table, u, root) by alternating large-star and small-star steps;
    each round is written, so lineage does not grow, and stars at a hub are
    relinked by a grouped minimum instead of being collected."""
    key = ["item_table"]
    e = written(edges.distinct(), "edges")
    while True:
        both = e.unionByName(e.select(*key, F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v")
        low = both.groupBy(*key, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, [*key, "u"]).where("v > u").select(*key, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(*key, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        least = down.groupBy(*key, "u").agg(F.min("v").alias("m"))
        small = down.join(least, [*key, "u"]).select(*key, "m", F.explode(F.array("u", "v")).alias("u")).select(*key, "u", F.col("m").alias("v")).where("u <> v").distinct()
        new = written(small, "edges")
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            break
        e = new
    return e.select(*key, "u", F.col("v").alias("root"))
