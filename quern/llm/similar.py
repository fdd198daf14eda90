"""Most similar vectors for every vector, by additive quantisation.

Sums of an entry of either book of an additive quantiser are the cells of the
collection; tables of inner products with both books score all of them.  Cells
are packed into parts, and every vector is sent once to its own part (as a row
to be found) and to the further parts whose cells it probes (as a query).  A
part reads its rows first and then streams its queries: all rows of a probed
cell are compared, and the top k of all parts are merged.

A vector probes every cell whose score is within a margin of the best, however
many these are: the margin is in deviations of a random direction's score, so
it does not depend on the size of the collection.  A comparison counts for both
sides: a row takes a query for its own list too, so a pair is missed only if
neither of the two probes the other's cell.

Cells larger than a part become several parts, told apart by the vector's hash;
queries of such a cell go to all of them.  Equal vectors are one row (by a
64-bit hash of their values) and are expanded to ids at the end, at most k + 1
of a class being of use to anyone.

The quantiser is fitted on a sample of about `PER_CELL` vectors a cell, `SAMPLE`
at least; every vector is indexed and every vector is a query.  One rule gives
the number of cells at every size, and a vector that finds fewer than k others
in the cells it probes is compared exactly with the whole collection, in blocks
of such vectors.

Unusable vectors (null, other length, not finite, all zero) and null ids take
no part.  Repeated ids count once; if their vectors differ, the one of the
lower hash counts.  Ties go to the lower hash.  Empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.quantiser import Quantiser
from quern.session import written

SAMPLE, PER_CELL = 8192, 32
PART, PARTS, WIDE = 8192, 64, 65536  # vectors of a part: the first, and beyond PARTS parts of it as many more, up to the last
CELLS, OCCUPANCY = 4096, 128  # bounds of `cells_for`
BLOCK = 4096  # vectors compared with the whole collection at once
SECOND = 4  # entries of the second book; the first has half of `cells_for`
MARGIN = 0.4  # cells within so many deviations (1 / sqrt(dim)) of the best are probed,
ENOUGH = 48  # and further ones until so many vectors are expected in them
AT_ONCE = 4_000_000  # products held at a time


_made: dict[str, Cells] = {}


def cells_for(n: int) -> int:
    """About the square root of the collection, a power of two, and at most
    one for `OCCUPANCY` vectors."""
    most = min(CELLS, n**0.5, n / OCCUPANCY)
    return 1 << int(np.log2(most)) if most >= 1 else 1


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True, initial=0)  # squares of tiny or huge values stay in range
    x = x / scale if len(x) else x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the usable rows of a batch (id, embedding)."""
    ids, x = given(batch, dim)
    return ids, unit(x)


def given(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, as they are, of the usable rows."""
    col, ids = batch.column(1), batch.column(0)
    off = col.offsets.to_numpy()
    ok = (np.diff(off) == dim) & col.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    values = col.values.to_numpy(zero_copy_only=False)  # null elements become NaN
    x = values[(off[:-1][ok][:, None] + np.arange(dim)).ravel()].reshape(-1, dim).astype(np.float32)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    rows = np.flatnonzero(ok)[good]
    return ids.take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64), x[good]


def packed(x: np.ndarray) -> list[bytes]:
    """The vectors byte by byte in planes, compressed: short values stay short."""
    codec = pa.Codec("zstd", 1)
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.shape[1], 4).transpose(0, 2, 1))
    return [codec.compress(v, asbytes=True) for v in planes.reshape(len(x), -1)]


def unpacked(v: list[bytes], dim: int) -> np.ndarray:
    codec = pa.Codec("zstd", 1)
    planes = np.frombuffer(b"".join(codec.decompress(b, 4 * dim, asbytes=True) for b in v), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(-1, 4, dim).transpose(0, 2, 1)).view(np.float32)[:, :, 0]


def hashes(x: np.ndarray) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(v) for v in np.ascontiguousarray(x)], dtype=np.uint64).view(np.int64)


class Cells:
    """Sums of one entry of either book; cell i * n + j is that of entries i
    and j, n being the length of the second book."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        self.centres = (a[:, None] + b[None]).reshape(-1, a.shape[1])
        self.half = 0.5 * (self.centres * self.centres).sum(axis=1)

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, seed: int) -> Cells:
        q = Quantiser.train(x, max(1, cells // 2), 1, refits=3, seed=seed, size=SECOND)
        return cls(q.coarse, q.c[q.cells :])

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x @ self.a.T)[:, :, None] + (x @ self.b.T)[:, None, :]).reshape(len(x), -1) - self.half

    def own(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.score(x[at : at + 1024]).argmax(axis=1) for at in range(0, len(x), 1024)])

    def probed(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The own cell of every vector; (who, cell) of all that are probed."""
        own, who, cell = [], [], []
        for at in range(0, len(x), 1024):
            s = self.score(x[at : at + 1024])
            use = s >= s.max(axis=1, keepdims=True) - MARGIN / x.shape[1] ** 0.5
            few = np.flatnonzero(use @ sizes < ENOUGH)
            order = np.argsort(-s[few], axis=1, kind="stable")
            i, j = np.nonzero(np.cumsum(sizes[order], axis=1) - sizes[order] < ENOUGH)
            use[few[i], order[i, j]] = True
            i, j = np.nonzero(use)
            own.append(s.argmax(axis=1))
            who.append(at + i)
            cell.append(j)
        return np.concatenate(own), np.concatenate(who), np.concatenate(cell)


class Layout:
    """Parts of cells: cells near each other share a part, by bisection along
    the widest direction of their centres; sizes are estimates."""

    def __init__(self, coarse: np.ndarray, sizes: np.ndarray, part: float = PART):
        self.first, self.blocks = np.zeros(len(coarse), dtype=np.int64), np.ones(len(coarse), dtype=np.int64)
        self.parts = 0

        def cut(cells: np.ndarray) -> None:
            total = sizes[cells].sum()
            if total <= part or len(cells) == 1:
                n = max(1, int(-(-total // part)))
                self.first[cells], self.blocks[cells] = self.parts, n
                self.parts += n
                return
            c = coarse[cells] - coarse[cells].mean(axis=0)
            order = cells[np.argsort(c @ np.linalg.svd(c, full_matrices=False)[2][0], kind="stable")]
            at = int(np.clip(np.searchsorted(np.cumsum(sizes[order]), total / 2) + 1, 1, len(order) - 1))
            cut(order[:at])
            cut(order[at:])

        cut(np.arange(len(coarse)))


def top(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of every row; ties to the lower column."""
    m = s.shape[1]
    if m > k:
        at = np.argpartition(s, m - k, axis=1)[:, m - k :]
        least = np.take_along_axis(s, at, 1).min(axis=1, keepdims=True)
        tied = np.flatnonzero((s >= least).sum(axis=1) > k)
        at[tied] = np.argsort(-s[tied], axis=1, kind="stable")[:, :k]
        i, j = np.repeat(np.arange(len(s)), k), at.ravel()
    else:
        i, j = (v.ravel() for v in np.indices(s.shape))
    ok = np.isfinite(s[i, j])
    return i[ok], j[ok]


class Lists:
    """The best k so far (hash, cosine) of every vector, the best first."""

    def __init__(self, n: int, k: int):
        self.h, self.e = np.zeros((n, k), dtype=np.int64), np.full((n, k), -np.inf, dtype=np.float32)

    def merge(self, i: np.ndarray, h: np.ndarray, e: np.ndarray) -> None:
        if not len(i):
            return
        k = self.e.shape[1]
        rows, at = np.unique(i, return_inverse=True)
        r, h, e = np.concatenate((np.repeat(np.arange(len(rows)), k), at)), np.concatenate((self.h[rows].ravel(), h)), np.concatenate((self.e[rows].ravel(), e))
        o = np.lexsort((-e, h, r))
        o = o[np.isfinite(e[o])]
        o = o[np.concatenate(([True], (r[o][1:] != r[o][:-1]) | (h[o][1:] != h[o][:-1])))]  # met from both sides
        o = o[np.lexsort((h[o], -e[o], r[o]))]
        r, h, e = r[o], h[o], e[o]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep = place < k
        self.e[rows] = -np.inf
        self.h[rows[r[keep]], place[keep]], self.e[rows[r[keep]], place[keep]] = h[keep], e[keep]

    def rows(self, of: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(of), BLOCK):
            e = self.e[at : at + BLOCK]
            i, j = np.nonzero(np.isfinite(e))
            yield pa.record_batch([pa.array(of[at + i]), pa.array(self.h[at + i, j]), pa.array(e[i, j], pa.float32())], names=["q", "c", "cosine"])


class Part:
    """Rows of a part by cell, within a cell by hash, each hash once."""

    def __init__(self, h: np.ndarray, cell: np.ndarray, x: np.ndarray, k: int):
        _, once = np.unique(h, return_index=True)
        once = once[np.argsort(cell[once], kind="stable")]
        self.h, self.cell, self.x, self.k = h[once], cell[once], x[once], k
        starts = np.flatnonzero(np.concatenate(([True], self.cell[1:] != self.cell[:-1])))
        self.at = dict(zip(self.cell[starts].tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(self.h)])))
        self.lists = Lists(len(self.h), k)

    def compare(self, q: np.ndarray, qh: np.ndarray, lists: Lists, who: np.ndarray, cell: np.ndarray, back: bool) -> None:
        """Queries with all rows of their cells; back: for the rows' lists too."""
        order = np.lexsort((qh[who], cell))
        who, cell = who[order], cell[order]
        for c in np.unique(cell).tolist():
            if c not in self.at:
                continue
            (lo, hi), w = self.at[c], who[np.searchsorted(cell, c) : np.searchsorted(cell, c, "right")]
            h, step = self.h[lo:hi], max(1, AT_ONCE // (hi - lo))
            for i in (w[at : at + step] for at in range(0, len(w), step)):
                s = q[i] @ self.x[lo:hi].T
                j = np.minimum(np.searchsorted(h, qh[i]), hi - lo - 1)
                same = np.flatnonzero(h[j] == qh[i])
                s[same, j[same]] = -np.inf
                gain = np.flatnonzero(s.max(axis=1) >= lists.e[i, -1])
                r, j = top(s[gain], self.k)
                found = [(lists, i[gain[r]], h[j], s[gain[r], j])]
                if back:
                    gain = np.flatnonzero(s.max(axis=0) >= self.lists.e[lo:hi, -1])
                    j, r = top(np.ascontiguousarray(s[:, gain].T), self.k)
                    found.append((self.lists, lo + gain[j], qh[i[r]], s[r, gain[j]]))
                for to, a, b, e in found:
                    to.merge(a, b, e)

    def within(self, cells: Cells, sizes: np.ndarray) -> None:
        """The rows among themselves: first each with its own cell."""
        n = np.arange(len(self.h))
        self.compare(self.x, self.h, self.lists, n, self.cell, False)
        _, who, cell = cells.probed(self.x, sizes)
        far = cell != self.cell[who]
        self.compare(self.x, self.h, self.lists, who[far], cell[far], True)


class Neighbours:
    """links: (q, c, cosine), the k nearest classes of every class; members:
    (chunk_id, h), the class of every id."""

    def __init__(self, vectors: DataFrame, ident: str, vector: str, dim: int, k: int = 5, seed: int = 7, sample: int = SAMPLE, part: int = PART):
        self.k, self.incomplete = k, 0
        spark = vectors.sparkSession
        rows = vectors.select(F.col(ident).cast("bigint").alias("chunk_id"), F.col(vector).cast("array<float>").alias("e"))
        n = rows.count()
        share = min(1.0, max(sample, PER_CELL * cells_for(n)) / max(1, n))
        limit = np.uint64(min(2**64 - 1, int(share * 2**64)))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Ids with hashes, and the vectors of the sample (once a task)."""
            seen: set[int] = set()
            for b in batches:
                ids, x = usable(b, dim)
                h = hashes(x)
                chosen = (h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) < limit if share < 1 else np.ones(len(h), dtype=bool)
                send = [None] * len(h)
                for i in np.flatnonzero(chosen):
                    if h[i] not in seen:
                        seen.add(h[i])
                        send[i] = x[i].tobytes()
                yield pa.record_batch([pa.array(ids), pa.array(h), pa.array(send, pa.binary())], names=["chunk_id", "h", "v"])

        met = written(rows.mapInArrow(look, "chunk_id bigint, h bigint, v binary"), "vectors")
        pairs = met.select("chunk_id", "h").distinct()
        self.members = written(pairs.groupBy("chunk_id").agg(F.min("h").alias("h")), "members")
        dead = pairs.select("h").distinct().join(self.members.select("h"), "h", "left_anti")
        conflicts = not dead.isEmpty()
        fitted = met.where("v is not null").groupBy("h").agg(F.first("v").alias("v")).orderBy("h").collect()  # about `sample` rows
        if not fitted:
            self.links = spark.createDataFrame([], "q bigint, c bigint, cosine float")
            return
        x = np.frombuffer(b"".join(r["v"] for r in fitted), dtype=np.float32).reshape(-1, dim)
        n = self.members.select("h").distinct().count()
        cells = Cells.fit(x, cells_for(n), seed)
        sizes = np.bincount(cells.own(x), minlength=len(cells.centres)) * (n / len(x))
        plan = Layout(cells.centres, sizes, max(part, min(WIDE, n // PARTS)))
        sent = spark.sparkContext.broadcast((cells.a, cells.b, plan.first, plan.blocks, sizes))  # bounded by the parameters
        key = uuid.uuid4().hex

        def made() -> Cells:
            if key not in _made:
                _made.clear()
                _made[key] = Cells(*sent.value[:2])
            return _made[key]

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, (first, blocks, sizes) = made(), sent.value[2:]
            seen: set[int] = set()
            for b in batches:
                _, raw = given(b, dim)
                x = unit(raw)
                h = hashes(x)
                new = np.array([i for i, v in enumerate(h.tolist()) if not (v in seen or seen.add(v))], dtype=np.int64)
                raw, x, h = raw[new], x[new], h[new]
                if not len(x):
                    continue
                own, who, cell = cells.probed(x, sizes)
                home = first[own] + (h.view(np.uint64) % blocks[own].astype(np.uint64)).astype(np.int64)
                many = blocks[cell]
                to = np.repeat(first[cell] + many - np.cumsum(many), many) + np.arange(many.sum())
                to, who = np.divmod(np.unique(to * len(x) + np.repeat(who, many)), len(x))  # one message a part
                far = to != home[who]  # a query for its own part is its row there
                to, who = to[far], who[far]
                halves = [v.tobytes() for v in x.astype(np.float16)]  # rows as they are, queries in half precision
                part, role, of = np.concatenate((home, to)), np.repeat(np.array([0, 1], dtype=np.int8), (len(x), len(who))), np.concatenate((np.arange(len(x)), who))
                v = [*packed(raw), *(halves[i] for i in who)]
                for at in range(0, len(of), 10_000):
                    z = slice(at, at + 10_000)
                    yield pa.record_batch([pa.array(part[z]), pa.array(role[z]), pa.array(h[of[z]]), pa.array(own[of[z]], pa.int32()), pa.array(v[z], pa.binary())], names=["part", "role", "h", "cell", "v"])

        messages = rows.mapInArrow(route, "part bigint, role tinyint, h bigint, cell int, v binary")
        if conflicts:
            messages = messages.join(dead, "h", "left_anti").select("part", "role", "h", "cell", "v")

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, sizes = made(), sent.value[4]
            now, pending, base = None, [], None

            def close() -> Part:
                whole = Part(*(np.concatenate(z) for z in zip(*pending)), k)
                pending.clear()
                whole.within(cells, sizes)
                return whole

            for b in batches:
                part = b.column("part").to_numpy(zero_copy_only=False)
                role = b.column("role").to_numpy(zero_copy_only=False)
                edge = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (role[1:] != role[:-1]))))
                for a, z in zip(edge, [*edge[1:], len(part)]):
                    cut = b.slice(a, z - a)
                    h, v = cut.column("h").to_numpy(zero_copy_only=False), cut.column("v").to_pylist()
                    if part[a] != now:
                        base = close() if pending else base
                        if base is not None:
                            yield from base.lists.rows(base.h)
                        now, base = part[a], None
                    if role[a] == 0:
                        pending.append((h, cut.column("cell").to_numpy(zero_copy_only=False), unit(unpacked(v, dim))))
                        continue
                    base = close() if pending else base
                    if base is None:
                        continue
                    q = np.frombuffer(b"".join(v), dtype=np.float16).reshape(-1, dim).astype(np.float32)
                    lists, (_, who, cell) = Lists(len(q), k), cells.probed(q, sizes)
                    base.compare(q, h, lists, who, cell, True)
                    yield from lists.rows(h)
            base = close() if pending else base
            if base is not None:
                yield from base.lists.rows(base.h)

        met_in = messages.repartitionById(max(plan.parts, 1), F.col("part").cast("int")).sortWithinPartitions("part", "role").mapInArrow(search, "q bigint, c bigint, cosine float")
        found = met_in.groupBy("q", "c").agg(F.max("cosine").alias("cosine"))  # a pair met from both sides, once of them in half precision
        w = Window.partitionBy("q").orderBy(F.desc("cosine"), F.asc("c"))
        self.links = written(found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n"), "neighbours")
        if n > 1:
            self._complete(rows, dim, min(k, n - 1), dead if conflicts else None)

    def _complete(self, rows: DataFrame, dim: int, k: int, dead: DataFrame | None) -> None:
        """Exact neighbours of the vectors that have fewer than k so far."""
        counts = self.links.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
        few = self.members.select(F.col("h").alias("q")).distinct().join(counts.where(F.col("n") >= k), "q", "left_anti")
        few = written(few, "few")
        self.incomplete = few.count()
        if not self.incomplete:
            return
        spark, w = rows.sparkSession, Window.partitionBy("q").orderBy(F.desc("cosine"), F.asc("c"))

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, x = usable(b, dim)
                yield pa.record_batch([pa.array(hashes(x)), pa.array([v.tobytes() for v in x], pa.binary())], names=["q", "v"])

        wanted = written(rows.mapInArrow(hashed, "q bigint, v binary").join(few, "q", "left_semi").dropDuplicates(["q"]), "wanted")
        parts, block = [self.links.join(few, "q", "left_anti")], []

        def against_all(block: list) -> DataFrame:
            sent = spark.sparkContext.broadcast((np.array([r["q"] for r in block]), np.frombuffer(b"".join(r["v"] for r in block), dtype=np.float32).reshape(-1, dim)))  # at most BLOCK vectors

            def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                qh, q = sent.value
                for b in batches:
                    _, x = usable(b, dim)
                    if not len(x):
                        continue
                    h, once = np.unique(hashes(x), return_index=True)
                    x = x[once]
                    s = q @ x.T
                    s[qh[:, None] == h[None, :]] = -np.inf
                    top = np.argpartition(-s, min(k, len(h)) - 1, axis=1)[:, :k]
                    e = np.take_along_axis(s, top, 1)
                    i, j = np.nonzero(np.isfinite(e))
                    yield pa.record_batch([pa.array(qh[i]), pa.array(h[top[i, j]]), pa.array(e[i, j], pa.float32())], names=["q", "c", "cosine"])

            hits = rows.mapInArrow(scan, "q bigint, c bigint, cosine float").distinct()
            hits = hits.join(dead.withColumnRenamed("h", "c"), "c", "left_anti").select("q", "c", "cosine") if dead is not None else hits
            return written(hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= self.k).drop("_n"), "exact")

        for r in wanted.toLocalIterator():
            block.append(r)
            if len(block) == BLOCK:
                parts.append(against_all(block))
                block = []
        if block:
            parts.append(against_all(block))
        self.links = reduce(DataFrame.unionByName, parts)

    def lists(self) -> DataFrame:
        """(chunk_id, neighbour, rank) for ranks 1..k, copies expanded."""
        k = self.k
        w = Window.partitionBy("h").orderBy("chunk_id")
        heads = written(self.members.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1).drop("_n"), "heads")
        near = self.links.join(heads.select(F.col("h").alias("c"), F.col("chunk_id").alias("id")), "c").select("q", F.struct((-F.col("cosine")).alias("far"), F.col("c").alias("h"), "id").alias("x"))
        own = heads.select(F.col("h").alias("q"), F.struct(F.lit(-2.0).cast("float").alias("far"), "h", F.col("chunk_id").alias("id")).alias("x"))
        lists = near.unionByName(own).groupBy("q").agg(F.sort_array(F.collect_list("x")).alias("l"))  # at most (k + 1) * (k + 1) entries
        m = self.members.join(lists, self.members["h"] == lists["q"])
        best = F.slice(F.filter(F.col("l"), lambda x: x["id"] != F.col("chunk_id")), 1, k)
        return m.select("chunk_id", F.posexplode(best).alias("rank", "x")).select("chunk_id", F.col("x.id").alias("neighbour"), (F.col("rank") + 1).alias("rank"))

    def pairs(self) -> DataFrame:
        x = self.lists()
        return x.select(F.least("chunk_id", "neighbour").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour").alias("chunk_id_b")).distinct()
