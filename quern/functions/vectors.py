"""Vector functions: one matrix product per Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(col, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part (of `dim` values, all finite, not all zero) of an
    Arrow list array, and their values, from its flat buffer."""
    off = col.offsets.to_numpy()
    ok = (np.diff(off) == dim) & col.is_valid().to_numpy(zero_copy_only=False)
    values = col.values.to_numpy(zero_copy_only=False)  # null elements become NaN
    rows = np.flatnonzero(ok)
    if len(rows) == len(off) - 1 and len(rows):
        m = values[off[0] : off[-1]].reshape(-1, dim)
    else:
        m = values[(off[:-1][ok][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)
    m = m.astype(np.float64)
    good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
    return (rows, m) if good.all() else (rows[good], m[good])


def cosine_to(vector: Column, query: list[float]) -> Column:
    """Cosine similarity (double) to a fixed query; null where a vector is
    null, of another length, not finite or all zero."""
    q = np.asarray(query, dtype=np.float64)
    q = q / np.linalg.norm(q)

    @F.arrow_udf("double")
    def run(col: pa.Array) -> pa.Array:
        rows, m = matrix(col, len(q))
        out = np.full(len(col), np.nan)
        out[rows] = (m @ q) / np.sqrt(np.einsum("ij,ij->i", m, m))
        return pa.array(out, from_pandas=True)

    return run(vector)


def l2_normalize(vector: Column) -> Column:
    """Unit-length copy (array<double>); the norm counts as 1e-9 at least."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-9))
    return F.transform(v, lambda x: x / norm)


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mask-weighted mean over the token axis."""
    w = mask[..., None].astype(states.dtype)
    return (states * w).sum(axis=1) / np.clip(w.sum(axis=1), 1e-9, None)


def similarity(cosine: Column) -> Column:
    """Similarity as shown: not below 0, four decimals."""
    return F.round(F.greatest(F.lit(0.0), cosine), 4)


def to_blob(v) -> bytes:
    return np.asarray(v, dtype="<f4").tobytes()


def from_blob(b: bytes) -> list[float]:
    return np.frombuffer(b, dtype="<f4").tolist()
