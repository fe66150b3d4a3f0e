"""Oversized texts cut at natural boundaries, by pointer doubling over successor tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points worked on at once; a longer item is still taken whole, alone.
BATCH_CHARS = 1_000_000

PIECES = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("piece_no", T.IntegerType()),
    T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType()),
    T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()),
])
#: Code points that ``str.isspace`` counts as blank.
_SPACE = np.array([c for c in range(0x3001) if chr(c).isspace()], dtype=np.uint32)


def greedy_cuts(codes: np.ndarray, begin: np.ndarray, length: np.ndarray, size: np.ndarray, overlap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, start, end) of all pieces, as flat positions, of items laid end to end in ``codes``.

    Every position of every item is joined to its farthest legal successor, then the successor table is squared: after
    k squarings the starts reached are those of the first 2**k pieces of every item at once.
    """
    n = len(codes)
    item = np.repeat(np.arange(len(length)), length)
    here = np.arange(n, dtype=np.int64)
    stop = (begin + length)[item]
    s = size[item]
    newline = np.maximum.accumulate(np.where(codes == 10, here, -1))
    end = np.minimum(here + s, stop)
    last = newline[end - 1]
    end = np.where((end < stop) & (last - here > s // 2), last, end)
    back = end - overlap[item]
    # position n is the common sink: the piece that reaches its item's end has no successor
    succ = np.append(np.where(end == stop, n, np.where(back > here, back, end)), n)
    starts = begin[length > 0].astype(np.int64)
    while True:
        more = succ[starts]
        more = more[more < n]
        grown = np.union1d(starts, more)
        if len(grown) == len(starts):
            break
        starts = grown
        succ = succ[succ]
    return item[starts], starts, end[starts]


def _pieces(ids: list, texts: list[str], sizes: list[int], overlaps: list[int], lines: list) -> pd.DataFrame:
    length = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = np.maximum(np.array(sizes, dtype=np.int64), 1)
    overlap = np.clip(np.array(overlaps, dtype=np.int64), 0, size - 1)
    item, start, end = greedy_cuts(codes, begin, length, size, overlap)
    solid = np.concatenate([[0], np.cumsum(~np.isin(codes, _SPACE))])
    keep = solid[end] > solid[start]
    item, start, end = item[keep], start[keep], end[keep]
    newlines = np.concatenate([[0], np.cumsum(codes == 10)])
    first = np.array([0 if pd.isna(x) else int(x) for x in lines], dtype=np.int64)
    known = np.array([not pd.isna(x) for x in lines])
    base = newlines[begin[item]]
    number = np.arange(len(item)) - np.searchsorted(item, item, "left")
    out = pd.DataFrame({
        "id": np.array(ids, dtype=np.int64)[item], "piece_no": number.astype(np.int32),
        "char_start": (start - begin[item]).astype(np.int32), "char_end": (end - begin[item]).astype(np.int32),
        "line_start": pd.array(first[item] + newlines[start] - base, dtype="Int32"),
        "line_end": pd.array(first[item] + newlines[end - 1] - base, dtype="Int32"),
    })
    out.loc[~known[item], ["line_start", "line_end"]] = pd.NA
    return out


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        at, chars, n = 0, 0, len(rows)
        lengths = rows["content"].str.len().to_numpy()
        for i in range(n):
            chars += int(lengths[i])
            if chars >= BATCH_CHARS or i == n - 1:
                part = rows.iloc[at : i + 1]
                yield _pieces(part["id"].tolist(), part["content"].tolist(), part["chunk_size"].tolist(), part["overlap"].tolist(), part["line_start"].tolist())
                at, chars = i + 1, 0


def split_oversized(chunks: DataFrame, settings: DataFrame) -> DataFrame:
    """Pieces of every chunk row whose non-blank content has more code points than the chunk_size of its settings.

    A null chunk_overlap means that of settings_no ``default`` (0 if that is missing too); overlaps are clamped to
    [0, chunk_size - 1]. Rows without known settings, with null or blank content, or within the limit give nothing;
    duplicate rows each give their pieces; identical duplicates give the same rows and are kept once. A null
    line_start gives null lines. Only the light rows of the pieces are shuffled; settings has one row a setting and joins by broadcast when Spark's own
    size check allows it.
    """
    fallback = settings.filter("settings_no = 'default'").agg(F.max("chunk_overlap").alias("default_overlap"), F.lit(1).alias("one"))
    known = (
        settings.groupBy("settings_no").agg(F.max("chunk_size").alias("chunk_size"), F.max("chunk_overlap").alias("chunk_overlap"))
        .withColumn("one", F.lit(1)).join(fallback, "one")
        .select("settings_no", F.col("chunk_size").cast("int").alias("chunk_size"), F.coalesce("chunk_overlap", "default_overlap", F.lit(0)).cast("int").alias("overlap"))
        .filter("chunk_size > 0")
    )
    rows = (
        chunks.select("id", "content", F.col("line_start").cast("int").alias("line_start"), "settings_no")
        .join(known, "settings_no")
        .filter(F.length("content") > F.col("chunk_size"))
        .filter("id is not null")
        .select("id", "content", "line_start", "chunk_size", "overlap")
    )
    return rows.mapInPandas(_split, PIECES).distinct()
