"""Additive quantisation in numpy: full-dimensional codebooks whose entries
are summed, encoding by beam search, scores from lookup tables."""

from __future__ import annotations

import numpy as np


def nearest(x: np.ndarray, c: np.ndarray, n: int = 1) -> np.ndarray:
    """Indices of the n nearest rows of c, the nearest first."""
    score = x @ c.T - 0.5 * (c * c).sum(axis=1)
    if n == 1:
        return score.argmax(axis=1)[:, None]
    n = min(n, len(c))
    top = np.argpartition(-score, n - 1, axis=1)[:, :n]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = nearest(x, c)[:, 0]
        order = np.argsort(own, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(own[order]) > 0)))
        sums, counts = np.add.reduceat(x[order], starts, axis=0), np.diff(np.concatenate((starts, [len(x)])))
        c[own[order][starts]] = sums / counts[:, None]
        empty = np.setdiff1d(np.arange(k), own)
        c[empty] = x[rng.choice(len(x), len(empty))]
    return c


class Quantiser:
    """Book 0 has `cells` entries and doubles as the coarse partition; the
    `books` others have `size`."""

    SIZE = 256

    def __init__(self, c: np.ndarray, cells: int, books: int, size: int = SIZE):
        self.c, self.cells, self.books = np.ascontiguousarray(c, dtype=np.float32), cells, books
        self.at = [0, *[cells + i * size for i in range(books + 1)]]  # block bounds
        self.norm = (self.c * self.c).sum(axis=1)
        self.cross = self.c @ self.c[cells:].T  # all entries x entries of the books after the first

    @property
    def coarse(self) -> np.ndarray:
        return self.c[: self.cells]

    @classmethod
    def train(cls, x: np.ndarray, cells: int, books: int, rounds: int = 8, refits: int = 1, seed: int = 7, size: int = SIZE) -> Quantiser:
        """Residual k-means book by book, then rounds of beam encoding and a
        joint least-squares fit of all entries to the codes."""
        rng = np.random.default_rng(seed)
        x = x.astype(np.float32)
        parts, rest = [kmeans(x, cells, rounds, rng)], x
        for i in range(books + 1):
            if i:
                parts.append(kmeans(rest, size, rounds // 2, rng))
            rest = rest - parts[-1][nearest(rest, parts[-1])[:, 0]]
        q = cls(np.concatenate(parts), cells, books, size)
        for _ in range(refits):
            code = q.encode(x)
            flat = code + np.array(q.at[:-1])
            n = len(q.c)
            gram = np.zeros((n, n), dtype=np.float64)
            right = np.zeros((n, x.shape[1]), dtype=np.float64)
            for a in range(books + 1):
                np.add.at(right, flat[:, a], x)
                for b in range(books + 1):
                    np.add.at(gram, (flat[:, a], flat[:, b]), 1.0)
            gram[np.diag_indices(n)] += 1.0  # entries without rows stay where they are
            q = cls(np.linalg.solve(gram, right + q.c), cells, books, size)
        return q

    def encode(self, x: np.ndarray, beam: int = 4, batch: int = 1024) -> np.ndarray:
        """Codes (n, 1 + books), by beam search for the least squared error."""
        out = np.empty((len(x), self.books + 1), dtype=np.int32)
        for s in range(0, len(x), batch):
            y = x[s : s + batch]
            n = len(y)
            cost = self.norm - 2.0 * (y @ self.c.T)
            first = cost[:, : self.cells]
            b = min(beam, self.cells)
            code = np.argpartition(first, b - 1, axis=1)[:, :b].astype(np.int32)[:, :, None]
            score = np.take_along_axis(first, code[:, :, 0], 1)
            for m in range(1, self.books + 1):
                lo, hi = self.at[m], self.at[m + 1]
                inter = np.zeros((n * b, hi - lo), dtype=np.float32)
                for j in range(m):
                    inter += self.cross[:, lo - self.cells : hi - self.cells][code[:, :, j].ravel() + self.at[j]]
                total = score[:, :, None] + cost[:, None, lo:hi] + 2.0 * inter.reshape(n, b, -1)
                flat = total.reshape(n, -1)
                keep = min(beam, flat.shape[1])
                top = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                score = np.take_along_axis(flat, top, 1)
                which, entry = np.divmod(top, hi - lo)
                code = np.concatenate((np.take_along_axis(code, which[:, :, None], 1), entry[:, :, None].astype(np.int32)), axis=2)
                b = keep
            out[s : s + n] = np.take_along_axis(code, score.argmin(axis=1)[:, None, None], 1)[:, 0]
        return out

    def decode(self, code: np.ndarray) -> np.ndarray:
        return self.c[code + np.array(self.at[:-1])].sum(axis=1)
