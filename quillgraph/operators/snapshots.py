"""Row changes between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch

_SIDE = "__side"
#: Snapshots whose list is broadcast; a longer list is joined by a shuffle.
BROADCAST_VERSIONS = 200_000


def row_hash(columns: list[Column]) -> Column:
    """64-bit hash of a row's compared values; null differs from every value and equals null.

    It is only ever compared with the hash of the same key in the next snapshot, so a change goes unseen with
    probability 2**-64.
    """
    return F.xxhash64(*[x for c in columns for x in (c, c.isNull())])


def _recency(rows: DataFrame, time: Column, tie: str) -> Column:
    """Time, then ``tie``, as one number of fixed width, so that the aggregation keeps it in place; null is oldest."""
    kind = rows.select(time.alias("t")).schema["t"].dataType
    if isinstance(kind, T.TimestampNTZType):
        micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time)
    elif isinstance(kind, T.TimestampType):
        micros = F.unix_micros(time)
    else:
        micros = time.cast("bigint")
    # older than the year 1, with which timestamps begin
    number = F.coalesce(micros, F.lit(-(10**17))).cast("decimal(19,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)")
    return (number + F.coalesce(F.col(tie).cast("bigint"), F.lit(0)).cast("decimal(19,0)")).cast("decimal(38,0)")


def snapshot_changes(
    rows: DataFrame,
    *,
    scope: str = "graph_no",
    version: str = "graph_version",
    key: str = "doc_no",
    compared: list[Column],
    time: Column,
    tie: str = "id",
) -> DataFrame:
    """Added, removed and changed keys of every snapshot against the one before it.

    Each delivered row is tagged twice, as the new side of its own version and as the old side of the next version
    that exists for its scope; one aggregation by (scope, newer version, key) then keeps the hash of the latest row of
    either side and classifies. That aggregation is the only shuffle of the rows: its buffers are numbers, so it hashes
    instead of sorting, and its partial step keeps one hash a side, so a key delivered any number of times costs one row
    a partition. The list of snapshots is written first and broadcast once its length is known to be small.

    Defined cases: rows with a null scope, version or key belong to no snapshot and are left out; among rows of one
    key the latest ``time`` counts (null is oldest), then the greatest ``tie``; a null compared value equals only null;
    the first snapshot of a scope gives no rows; an empty table gives an empty result; repeated rows change nothing;
    columns that are not named are ignored. Returns (scope, version, key, change).
    """
    base = rows.select(
        F.col(scope).alias("s"), F.col(version).alias("v"), F.col(key).alias("k"), row_hash(compared).alias("h"), _recency(rows, time, tie).alias("at_time"),
    ).filter(F.col("s").isNotNull() & F.col("v").isNotNull() & F.col("k").isNotNull())
    order = Window.partitionBy("vs").orderBy("vv")
    # One row a snapshot: a table of versions, whose size does not grow with the documents.
    versions = base.select(F.col("s").alias("vs"), F.col("v").alias("vv")).distinct()
    versions = Scratch(rows.sparkSession, "snapshots").write(versions.select("vs", "vv", F.lag("vv").over(order).alias("prev"), F.lead("vv").over(order).alias("next")))
    if versions.count() <= BROADCAST_VERSIONS:
        versions = F.broadcast(versions)
    tagged = base.join(versions, (F.col("s") == F.col("vs")) & (F.col("v") == F.col("vv")), "inner").select(
        "s", "k", "h", "at_time",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.when(F.col("prev").isNotNull(), F.col("v")).alias("at"), F.lit(True).alias("new")),
                    F.struct(F.col("next").alias("at"), F.lit(False).alias("new")),
                ),
                lambda x: x["at"].isNotNull(),
            )
        ).alias(_SIDE),
    )
    new = F.col(f"{_SIDE}.new")
    latest = lambda side: F.max_by(F.when(side, F.col("h")), F.when(side, F.col("at_time")))
    sides = tagged.groupBy("s", F.col(f"{_SIDE}.at").alias("at"), "k").agg(latest(new).alias("new"), latest(~new).alias("old"))
    change = (
        F.when(F.col("old").isNull(), F.lit("added"))
        .when(F.col("new").isNull(), F.lit("removed"))
        .when(F.col("old") != F.col("new"), F.lit("changed"))
    )
    return sides.select(
        F.col("s").alias(scope), F.col("at").alias(version), F.col("k").alias(key), change.alias("change")
    ).filter(F.col("change").isNotNull())
