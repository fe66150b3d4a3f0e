"""Ranked lists: rows (list_id, object_no, rank), best first. The rank is always a column, never the row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Damping of reciprocal ranks.
RRF_K = 60


def ranked(scored: DataFrame, *, by: list[str], score: str = "score", tie: str = "object_no", limit: int | Column | None = None) -> DataFrame:
    """1-based rank within ``by``, higher scores first, ties by ``tie``; at most ``limit`` rows a list.

    With a limit, Spark applies it before the exchange as well, so that a partition sends at most ``limit`` rows a list.
    """
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))))
    return out if limit is None else out.filter(F.col("rank") <= limit)


def reciprocal_rank_fusion(lists: DataFrame, *, by: list[str], k: int = RRF_K, list_order: str = "list_no", top_k: int | None = None) -> DataFrame:
    """Fused list of each group ``by`` from rows (by, list_no, object_no, rank): sum of 1 / (k + rank), ties by first
    appearance over the lists in order. An object that one list names twice gains twice."""
    fused = lists.groupBy(*by, "object_no").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct(F.col(list_order).alias("l"), F.col("rank").alias("r"))).alias("first"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("score", 12)), F.asc("first"), F.asc("object_no")))
    out = fused.withColumn("rank", place)
    if top_k is not None:
        out = out.filter(F.col("rank") <= top_k)
    return out.select(*by, "object_no", "score", "rank")


def fuse_objects(lists: DataFrame, *, by: list[str], better: Column, keep: list[str], k: int = RRF_K, top_k: int | None = None) -> DataFrame:
    """As above, keeping of each object's copies the columns ``keep`` of the one with the greatest ``better``."""
    fused = reciprocal_rank_fusion(lists, by=by, k=k, top_k=top_k)
    best = lists.groupBy(*by, "object_no").agg(*[F.max_by(c, F.struct(better, -F.col("list_no"), -F.col("rank"))).alias(c) for c in keep])
    return fused.join(best, [*by, "object_no"])


def ordered_union(first: DataFrame, second: DataFrame, *, by: list[str]) -> DataFrame:
    """(by, object_no, rank): rows (by, object_no, rank) of ``first``, then those of ``second`` not yet named, each kept
    at its first place."""
    both = first.select(*by, "object_no", F.struct(F.lit(0).alias("l"), F.col("rank").alias("r")).alias("at")).unionByName(second.select(*by, "object_no", F.struct(F.lit(1).alias("l"), F.col("rank").alias("r")).alias("at")))
    once = both.groupBy(*by, "object_no").agg(F.min("at").alias("at"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("at", "object_no"))).select(*by, "object_no", "rank")


def restrict(rows: DataFrame, allowed: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows named by ``allowed``; None is no restriction, an empty frame lets nothing through."""
    return rows if allowed is None else rows.join(allowed.select(*keys).distinct(), keys, "left_semi")


def without(rows: DataFrame, excluded: DataFrame | None, keys: list[str]) -> DataFrame:
    return rows if excluded is None else rows.join(excluded.select(*keys).distinct(), keys, "left_anti")
