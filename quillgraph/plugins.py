"""Deterministic defaults for what would be external models."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Rewriter = Callable[[str, int], list[str]]


def embed_text(text: str, dim: int = 64) -> list[float]:
    """Unit vector of hashed, signed character bigrams of the lower-cased text; all zero for a blank one."""
    v = np.zeros(dim)
    low = f" {text.strip().lower()} " if text and text.strip() else ""
    for a, b in zip(low, low[1:]):
        h = zlib.crc32((a + b).encode())
        v[h % dim] += 1 if h >> 16 & 1 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def embedder(dim: int = 64) -> Callable[[Column], Column]:
    """Column function text to vector, in Arrow batches."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else embed_text(x, dim))

    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))


def batched_embedder(embed_many: Callable[[list[str]], list[list[float]]], batch: int = 10) -> Callable[[Column], Column]:
    """Column function from an injected embedder of lists, asked for at most ``batch`` texts at once, in order; null and
    blank texts ask nobody and have no vector."""

    def run(s: pd.Series) -> pd.Series:
        out: list[list[float] | None] = [None] * len(s)
        spots = [i for i, t in enumerate(s) if isinstance(t, str) and t.strip()]
        for at in range(0, len(spots), batch):
            part = spots[at : at + batch]
            for i, v in zip(part, embed_many([s.iloc[i] for i in part]), strict=True):
                out[i] = [float(x) for x in v]
        return pd.Series(out)

    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))


class WakeUp:
    """Best-effort hints that work has come in, by a mark in the store's folder; the task table alone decides. A lost
    hint costs a worker one poll."""

    def __init__(self, spark, root: str):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/_wake")
        self._path, self._fs = path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def send(self) -> None:
        try:
            self._fs.create(self._path, True).close()
        except Exception:
            return

    def wait(self, seconds: float, *, step: float = 0.2) -> bool:
        """Whether a hint came within the time; it is used up."""
        end = time.monotonic() + seconds
        while True:
            try:
                if self._fs.exists(self._path):
                    self._fs.delete(self._path, False)
                    return True
            except Exception:
                return False
            if time.monotonic() >= end:
                return False
            time.sleep(min(step, max(end - time.monotonic(), 0)))


def expand_query(question: str, rewriter: Rewriter | None, count: int) -> tuple[list[str], str | None]:
    """(wordings, warning): the question first, then at most ``count`` - 1 other wordings of an injected rewriter, stripped
    and each once; one wording asks nobody, and a failing rewriter leaves the question alone with a warning."""
    if count <= 1 or rewriter is None:
        return [question], None
    try:
        said = rewriter(question, count)
    except Exception as e:
        return [question], f"query expansion failed: {type(e).__name__}: {e}"
    out = [question]
    for s in said:
        s = (s or "").strip()
        if s and s not in out:
            out.append(s)
    return out[:count], None
