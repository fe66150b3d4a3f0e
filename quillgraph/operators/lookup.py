"""Lookups over the graph: typed nodes, entities by name, one-hop relations, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import SCOPE, live


def with_domain(nodes: DataFrame, domain: DataFrame) -> DataFrame:
    """Nodes with class and archetype of their live domain row; without one, the node's own type and none."""
    d = live(domain).select(*SCOPE, "graph_node_no", F.col("type").alias("domain_type"), "entity_spec")
    return nodes.join(d, [*SCOPE, "graph_node_no"], "left").withColumn("class", F.coalesce("domain_type", "type")).drop("domain_type")


def nodes_of_type(nodes: DataFrame, domain: DataFrame, type_: str) -> DataFrame:
    """Live nodes whose domain row, deleted or not, is of a class."""
    d = domain.filter(F.col("type") == type_).select(*SCOPE, "graph_node_no", "entity_spec")
    return live(nodes).join(d, [*SCOPE, "graph_node_no"])


def name_contains(column: str, wanted: str | Column) -> Column:
    """Substring match without regard to case and accents; ``%`` and ``_`` are ordinary characters."""
    wanted = F.lit(wanted) if isinstance(wanted, str) else wanted
    return F.contains(F.collate(F.col(column), "UNICODE_CI_AI"), F.collate(wanted, "UNICODE_CI_AI"))


def find_entities(nodes: DataFrame, domain: DataFrame, wanted: str, *, limit: int = 20) -> DataFrame:
    """First ``limit`` live nodes a scope, by key, whose name contains the text."""
    hit = live(nodes).filter(name_contains("name", wanted))
    cut = hit.withColumn("n", F.row_number().over(Window.partitionBy(*SCOPE).orderBy("graph_node_no"))).filter(F.col("n") <= limit).drop("n")
    return with_domain(cut, domain)


def relations_of(edges: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(scope, node_no, direction, label, other_no, other_name, other_type) of the live edges of wanted (scope, node_no).

    Either direction is an equi-join; a loop reports ``out`` only; a missing other end is named ``(missing)``.
    """
    e = live(edges)
    names = live(nodes).select(*SCOPE, F.col("graph_node_no").alias("other_no"), F.col("name").alias("other_name"), F.col("type").alias("other_type"))
    w = wanted.select(*SCOPE, "node_no").distinct()
    out = e.join(w.withColumnRenamed("node_no", "source_node_no"), [*SCOPE, "source_node_no"]).select(*SCOPE, F.col("source_node_no").alias("node_no"), F.lit("out").alias("direction"), F.col("name").alias("label"), F.col("target_node_no").alias("other_no"))
    into = e.filter(F.col("source_node_no") != F.col("target_node_no")).join(w.withColumnRenamed("node_no", "target_node_no"), [*SCOPE, "target_node_no"])
    into = into.select(*SCOPE, F.col("target_node_no").alias("node_no"), F.lit("in").alias("direction"), F.col("name").alias("label"), F.col("source_node_no").alias("other_no"))
    both = out.unionByName(into).join(names, [*SCOPE, "other_no"], "left")
    return both.select(*SCOPE, "node_no", "direction", "label", "other_no", F.coalesce("other_name", F.lit("(missing)")).alias("other_name"), F.coalesce("other_type", F.lit("?")).alias("other_type"))


def snapshot_nodes(nodes: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Live nodes, at most ``limit`` a scope in key order."""
    if limit is None:
        return live(nodes)
    return live(nodes).withColumn("n", F.row_number().over(Window.partitionBy(*SCOPE).orderBy("graph_node_no"))).filter(F.col("n") <= limit).drop("n")


def edges_within(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Live edges with both ends among the members (scope, graph_node_no)."""
    out = live(edges)
    for end in ("source_node_no", "target_node_no"):
        out = out.join(members.select(*SCOPE, F.col("graph_node_no").alias(end)).distinct(), [*SCOPE, end], "left_semi")
    return out


def unreferenced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Live nodes no live edge touches."""
    e = live(edges)
    touched = e.select(*SCOPE, F.explode(F.array("source_node_no", "target_node_no")).alias("graph_node_no")).distinct()
    return live(nodes).join(touched, [*SCOPE, "graph_node_no"], "left_anti")


def latest_version(graphs: DataFrame, *, status: str | None = "ACTIVE", below: int | None = None) -> DataFrame:
    """(graph_no, graph_version): the greatest version a graph, of a status and at most ``below`` if given."""
    g = graphs if status is None else graphs.filter(F.col("status") == status)
    g = g if below is None else g.filter(F.col("graph_version") <= below)
    return g.groupBy("graph_no").agg(F.max("graph_version").alias("graph_version"))


def list_graphs(graphs: DataFrame) -> DataFrame:
    """Each graph's row of the greatest version, whatever its status, under the name its first version bears."""
    last = graphs.groupBy("graph_no").agg(F.max_by(F.struct("graph_version", "status", "projection_done"), "graph_version").alias("x"), F.min_by("name", "graph_version").alias("name"))
    return last.select("graph_no", "x.graph_version", "name", "x.status", "x.projection_done")
