"""Explored state: which nodes a conversation has been shown, as a keyed table with time to live and capacity.

State rows are (state_key, node_no, last_access); the capacity is global, so it is enforced over the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch  # noqa: F401  (the table is kept in the shared folder by its owner)


def key_of(graph_no: Column, version: Column, state_id: Column) -> Column:
    return F.concat_ws(":", graph_no, version.cast("string"), state_id)


def unexpired(state: DataFrame, now: Column, *, ttl_seconds: float) -> DataFrame:
    """Rows of keys whose last access is at most the time to live ago."""
    keys = state.groupBy("state_key").agg(F.max("last_access").alias("seen")).filter(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("seen").cast("timestamp")) <= int(ttl_seconds * 1e6))
    return state.join(keys.select("state_key"), "state_key", "left_semi")


def add(state: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """State after adding (state_key, node_no); blank nodes are left out, adding touches the key."""
    fresh = rows.filter(F.coalesce("node_no", F.lit("")) != "").select("state_key", "node_no", now.alias("last_access"))
    return state.unionByName(fresh).groupBy("state_key", "node_no").agg(F.max("last_access").alias("last_access"))


def evict(state: DataFrame, *, capacity: int) -> DataFrame:
    """The ``capacity`` keys used last; one row a key is ranked, not the nodes."""
    seen = state.groupBy("state_key").agg(F.max("last_access").alias("seen"))
    kept = seen.orderBy(F.desc("seen"), "state_key").limit(capacity)
    return state.join(kept.select("state_key"), "state_key", "left_semi")


def clear(state: DataFrame, keys: DataFrame) -> DataFrame:
    return state.join(keys.select("state_key").distinct(), "state_key", "left_anti")


def totals(state: DataFrame) -> DataFrame:
    return state.groupBy("state_key").agg(F.count_distinct("node_no").alias("nodes"), F.max("last_access").alias("last_access"))


def running_totals(events: DataFrame) -> DataFrame:
    """Distinct nodes a key had seen after each of its additions (state_key, node_no, at): the answer of every call."""
    first = events.filter(F.coalesce("node_no", F.lit("")) != "").groupBy("state_key", "node_no").agg(F.min("at").alias("at"))
    return first.groupBy("state_key", "at").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("state_key").orderBy("at"))).select("state_key", "at", "total")
