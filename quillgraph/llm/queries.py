"""Registered queries of the training-data operators, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from .boilerplate import furniture_lines
from .components import merge_groups
from .leakage import leaked_items
from .names import same_entity_pairs
from .neighbours import similar_pairs
from .splitting import split_oversized
from .subjects import document_subjects
from .survivors import surviving_values
from .tokenize import encode_corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group identifier of every node tied by the merge log."""
    return merge_groups(table(spark, sf_dir, "kg_merge_log"))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of web pages that are not main body."""
    return furniture_lines(table(spark, sf_dir, "documents"))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows that name the same person or organisation."""
    return same_entity_pairs(table(spark, sf_dir, "kg_graph_node"))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every oversized chunk."""
    return split_oversized(table(spark, sf_dir, "kg_doc_chunk"), table(spark, sf_dir, "kg_settings"))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that hold the surviving value of every field of every duplicate group."""
    return surviving_values(table(spark, sf_dir, "kg_graph_node"))


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of index rows of which one is among the five most similar of the other."""
    return similar_pairs(table(spark, sf_dir, "kg_search_index"))


@query
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"))


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry a held-out passage, with the items they leak."""
    found = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))
    return found.select("doc_id", "item_id")


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject areas of every document."""
    found = document_subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_label"), table(spark, sf_dir, "subject"))
    return found.select("doc_id", "subject_no")
