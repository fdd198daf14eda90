"""Embedders behind one interface: an ONNX model where its files are given,
feature hashing as a stand-in that needs none (and has other neighbours)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM, MAX_PIECES = 384, 128


def hash_vectors(texts: list[str | None], dim: int = DIM) -> np.ndarray:
    """Unit vectors of signed word counts; an empty text gives zeros."""
    import re
    import zlib

    out = np.zeros((len(texts), dim), dtype=np.float32)
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", (t or "").lower()):
            h = zlib.crc32(w.encode())
            out[i, h % dim] += 1.0 if h >> 31 else -1.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def threads(limit: int | None = None) -> int:
    """Threads of one model session: one a task where Spark runs tasks side by
    side, up to `limit` of the processors otherwise."""
    import os

    from pyspark import TaskContext

    return 1 if TaskContext.get() else max(1, min(limit or os.cpu_count() or 1, os.cpu_count() or 1))


def resolve_device(wanted: str = "auto") -> str:
    """'cuda' or 'cpu': what is asked for, or for 'auto' whether ONNX offers it."""
    if wanted not in ("auto", "cpu", "cuda"):
        raise ValueError(f"no such device: {wanted}")
    if wanted != "auto":
        return wanted
    try:
        import onnxruntime
    except ImportError:
        return "cpu"
    return "cuda" if "CUDAExecutionProvider" in onnxruntime.get_available_providers() else "cpu"


def batch_size(device: str) -> int:
    """Texts in one run of the model."""
    return 1024 if device == "cuda" else 256


def find_model(name: str | None = None, home: str | None = None) -> str | None:
    """The folder of a model: `name` as a path, then below `home`/models."""
    import os

    for d in ([name] if name else []) + ([os.path.join(home, "models", name or "default")] if home else []):
        if all(os.path.exists(os.path.join(d, f)) for f in ("model.onnx", "tokenizer.json")):
            return d
    return None


_loaded: dict[str, tuple] = {}


def loaded(folder: str) -> tuple:
    """Tokenizer and session of this process."""
    if folder not in _loaded:
        import onnxruntime
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(f"{folder}/tokenizer.json")
        tok.enable_truncation(MAX_PIECES)
        tok.enable_padding(length=MAX_PIECES)
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = threads()
        _loaded[folder] = tok, onnxruntime.InferenceSession(f"{folder}/model.onnx", options, providers=onnxruntime.get_available_providers())
    return _loaded[folder]


def onnx_vectors(folder: str, texts: list[str], batch: int | None = None) -> np.ndarray:
    """Mean-pooled unit vectors of the model in `folder` (model.onnx,
    tokenizer.json), the first 128 pieces of each text."""
    from quern.functions.vectors import mean_pool

    tok, run = loaded(folder)
    batch = batch or batch_size(resolve_device())
    names, out = {i.name for i in run.get_inputs()}, []
    for at in range(0, len(texts), batch):
        enc = tok.encode_batch([t or "" for t in texts[at : at + batch]])
        ids, att = (np.array([getattr(e, k) for e in enc], dtype=np.int64) for k in ("ids", "attention_mask"))
        feed = {k: v for k, v in (("input_ids", ids), ("attention_mask", att), ("token_type_ids", np.zeros_like(ids))) if k in names}
        y = run.run(None, feed)[0]
        y = mean_pool(y, att) if y.ndim == 3 else y
        out.append(y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9))
    return np.concatenate(out).astype(np.float32) if out else np.zeros((0, DIM), dtype=np.float32)


def embed(text: Column, model: str | None = None, dim: int = DIM) -> Column:
    """array<float> per text; the model is loaded once per Python worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            v = onnx_vectors(model, list(s)) if model else hash_vectors(list(s), dim)
            yield pd.Series(list(v))

    return run(text)
