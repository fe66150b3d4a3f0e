"""The model's tables from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import edge_no
from ..model import METATYPES, SCOPE
from ..session import table


def latest(rows: DataFrame, keys: list[str], time: str = "update_time") -> DataFrame:
    """The row of the greatest time, then id, of every key."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc_nulls_last(), F.col("id").desc())
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = latest(table(spark, sf_dir, "kg_graph_node"), [*SCOPE, "graph_node_no"])
    return n.withColumn("class", F.split_part("graph_node_no", F.lit(":"), F.lit(1))).drop("id", "create_time", "update_time")


def domain(nodes_: DataFrame) -> DataFrame:
    """Domain rows of the nodes whose key names a class of the ontology."""
    d = nodes_.filter(F.col("class").isin(*METATYPES))
    return d.select(*SCOPE, "graph_node_no", "name", F.col("class").alias("type"), F.when(F.col("class") == "Asset", F.split_part("graph_node_no", F.lit(":"), F.lit(2))).alias("entity_spec"), "properties", F.lit(False).alias("deleted"))


def merge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, a, b): winner and loser of every merge in force."""
    m = latest(table(spark, sf_dir, "kg_merge_log"), [*SCOPE, "merge_id"]).filter("status = 'MERGED'")
    ends = m.select(*SCOPE, F.col("winner_node_no").alias("a"), F.col("loser_node_no").alias("b"))
    return ends.filter("trim(a) <> '' and trim(b) <> ''").distinct()


def edges(spark: SparkSession, sf_dir: str, nodes_: DataFrame) -> DataFrame:
    """Edges ``same_as`` from winner to loser, with the loser's references."""
    ref = nodes_.select(*SCOPE, F.col("graph_node_no").alias("b"), "ref")
    e = merge_pairs(spark, sf_dir).join(ref, [*SCOPE, "b"], "left")
    return e.select(
        *SCOPE, edge_no(F.col("a"), F.lit("same_as"), F.col("b")).alias("graph_edge_no"), F.col("a").alias("source_node_no"), F.col("b").alias("target_node_no"), F.lit("same_as").alias("name"),
        F.lit(None).cast("string").alias("description"), F.lit('{"confidence":"INFERRED"}').alias("properties"), F.coalesce("ref", F.create_map().cast("map<string,array<string>>")).alias("ref"), F.lit(False).alias("deleted"),
    )


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "kg_search_index"), [*SCOPE, "object_type", "object_no"], "updated_at")


def questions(index_: DataFrame, per_scope: int = 1) -> DataFrame:
    """One question a scope (or more): its first nodes that have a vector, by name and vector."""
    usable = index_.filter("object_type = 'NODE' and size(embedding) = 64")
    w = Window.partitionBy(*SCOPE).orderBy("id")
    q = usable.withColumn("variant_no", F.row_number().over(w)).filter(F.col("variant_no") <= per_scope)
    return q.select(*SCOPE, F.concat_ws("@", "graph_no", F.col("graph_version").cast("string")).alias("query_no"), "variant_no", F.split_part("searchable_text", F.lit("\n"), F.lit(1)).alias("text"), "embedding")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "kg_doc"), [*SCOPE, "doc_no"])


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, name, target): the trade tables as a graph."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    edge = lambda df, a, name, b: df.select(a.alias("source"), F.lit(name).alias("name"), b.alias("target"))
    out = edge(t("nation"), key("nation", "n_nationkey"), "located_in", key("region", "n_regionkey"))
    out = out.unionByName(edge(t("customer"), key("customer", "c_custkey"), "based_in", key("nation", "c_nationkey")))
    out = out.unionByName(edge(t("supplier"), key("supplier", "s_suppkey"), "based_in", key("nation", "s_nationkey")))
    out = out.unionByName(edge(t("orders"), key("order", "o_orderkey"), "placed_by", key("customer", "o_custkey")))
    items = t("lineitem")
    out = out.unionByName(edge(items.select("l_orderkey", "l_partkey").distinct(), key("order", "l_orderkey"), "contains", key("part", "l_partkey")))
    return out.unionByName(edge(items.select("l_suppkey", "l_partkey").distinct(), key("supplier", "l_suppkey"), "supplies", key("part", "l_partkey")))
