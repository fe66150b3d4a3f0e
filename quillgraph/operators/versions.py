"""Versions of a graph: classification by content hash, projection of what is unchanged, the build of the next one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ACTIVE, BUILDING, DOC_CHUNK, EDGE, FROZEN, NODE, live
from .store import copy_version


def classify(manifest: DataFrame, base: DataFrame, *, by: list[str] | None = None, force: bool = False) -> DataFrame:
    """(by, doc_no, change) of a manifest (doc_no, sha256) against a base version: new, changed, unchanged or removed;
    ``force`` treats unchanged as changed."""
    keys = [*(by or []), "doc_no"]
    joined = manifest.select(*keys, F.lower("sha256").alias("now"), F.lit(True).alias("here")).join(base.select(*keys, F.lower("sha256").alias("was"), F.lit(True).alias("there")), keys, "full_outer")
    change = (
        F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "removed")
        .when(F.col("now").eqNullSafe(F.col("was")), F.lit("changed" if force else "unchanged")).otherwise("changed")
    )
    return joined.select(*keys, change.alias("change"))


def to_extract(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("change").isin("new", "changed"))


def has_changes(changes: DataFrame) -> bool:
    return not changes.filter(F.col("change") != "unchanged").isEmpty()


def project_docs(rows: DataFrame, unchanged: DataFrame, *, base: int, target: int) -> DataFrame:
    """Documents, lines or chunks of unchanged documents (graph_no, doc_no), under the target version."""
    return rows.filter(F.col("graph_version") == base).join(unchanged.select("graph_no", "doc_no").distinct(), ["graph_no", "doc_no"], "left_semi").withColumn("graph_version", F.lit(target).cast("bigint"))


def surviving_refs(rows: DataFrame, unchanged: DataFrame, key: str) -> DataFrame:
    """(graph_no, key, ref) with the entries of unchanged documents; rows left without any drop out."""
    entries = rows.select("graph_no", key, F.explode("ref").alias("doc_no", "tokens"))
    kept = entries.join(unchanged.select("graph_no", "doc_no").distinct(), ["graph_no", "doc_no"], "left_semi")
    return kept.groupBy("graph_no", key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_no", "tokens")))).alias("ref"))


@dataclass
class Projection:
    nodes: DataFrame
    edges: DataFrame
    domain: DataFrame
    aliases: DataFrame
    index: DataFrame


def project(nodes: DataFrame, edges: DataFrame, domain: DataFrame, aliases: DataFrame, chunks: DataFrame, index: DataFrame, unchanged: DataFrame, *, base: int, target: int) -> Projection:
    """The slice of a version that unchanged documents support, under the target version.

    A node survives if its references to unchanged documents are not empty, an edge if so do its own and both its ends;
    domain rows, aliases and index rows follow, embeddings as they are. Everything is a semi-join on keys.
    """
    at = lambda df: df.filter(F.col("graph_version") == base)
    move = lambda df: df.withColumn("graph_version", F.lit(target).cast("bigint"))
    n = live(at(nodes))
    n = n.drop("ref").join(surviving_refs(n, unchanged, "graph_node_no"), ["graph_no", "graph_node_no"])
    keys = n.select("graph_no", "graph_node_no").distinct()
    e = live(at(edges))
    for end in ("source_node_no", "target_node_no"):
        e = e.join(keys.withColumnRenamed("graph_node_no", end), ["graph_no", end], "left_semi")
    e = e.drop("ref").join(surviving_refs(e, unchanged, "graph_edge_no"), ["graph_no", "graph_edge_no"])
    d = live(at(domain)).join(keys, ["graph_no", "graph_node_no"], "left_semi")
    a = at(aliases).join(keys.withColumnRenamed("graph_node_no", "canonical_node_no"), ["graph_no", "canonical_node_no"], "left_semi")
    c = at(chunks).join(unchanged.select("graph_no", "doc_no").distinct(), ["graph_no", "doc_no"], "left_semi")
    wanted = keys.select("graph_no", F.lit(NODE).alias("object_type"), F.col("graph_node_no").alias("object_no"))
    wanted = wanted.unionByName(e.select("graph_no", F.lit(EDGE).alias("object_type"), F.col("graph_edge_no").alias("object_no")))
    wanted = wanted.unionByName(c.select("graph_no", F.lit(DOC_CHUNK).alias("object_type"), F.col("chunk_no").alias("object_no")))
    return Projection(move(n), move(e), move(d), move(a), copy_version(index, wanted, source=base, target=target))


def resolve_versions(graphs: DataFrame, docs: DataFrame, graph_no: str) -> tuple[int | None, int]:
    """(base, target): a version being built is resumed; without any, target 1; a latest version without documents is
    filled in place; else the next one. More than one version being built is an error."""
    g = graphs.filter(F.col("graph_no") == graph_no).select("graph_version", "status").collect()
    building = [r[0] for r in g if r[1] == BUILDING]
    if len(building) > 1:
        raise ValueError(f"{graph_no}: several versions are being built: {sorted(building)}")
    done = sorted(r[0] for r in g if r[1] != BUILDING)
    if building:
        return (max((v for v in done if v < building[0]), default=None), building[0])
    if not done:
        return None, 1
    last = done[-1]
    if docs.filter((F.col("graph_no") == graph_no) & (F.col("graph_version") == last)).isEmpty():
        return (done[-2] if len(done) > 1 else None), last
    return last, last + 1


@dataclass
class Observer:
    """Hooks of a build, one call a document."""

    started: Callable[[str], None] = lambda doc_no: None
    succeeded: Callable[[str], None] = lambda doc_no: None
    skipped: Callable[[str], None] = lambda doc_no: None
    failed: Callable[[str, str], None] = lambda doc_no, error: None
    events: list = field(default_factory=list)


def activate(graphs: DataFrame, graph_no: str, version: int) -> DataFrame:
    """Registry with the version ACTIVE and the graph's former active ones FROZEN."""
    own = F.col("graph_no") == graph_no
    status = F.when(own & (F.col("graph_version") == version), ACTIVE).when(own & (F.col("status") == ACTIVE), FROZEN).otherwise(F.col("status"))
    return graphs.withColumn("status", status)
