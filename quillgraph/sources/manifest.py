"""The manifest of a graph: which files belong to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import content_hash
from .files import load_documents

_KEY = ["graph_no", "doc_no"]


def add_files(manifest: DataFrame, added: DataFrame) -> DataFrame:
    """Manifest with files (graph_no, doc_no, path, source_type, origin_url) added; one that was removed comes back, the
    path is that given last."""
    return manifest.join(added.select(*_KEY).distinct(), _KEY, "left_anti").unionByName(added.dropDuplicates(_KEY).withColumn("deleted", F.lit(False)), allowMissingColumns=True)


def remove_files(manifest: DataFrame, removed: DataFrame) -> DataFrame:
    marks = removed.select(*_KEY, F.lit(True).alias("hit")).distinct()
    return manifest.join(marks, _KEY, "left").withColumn("deleted", F.coalesce("hit", "deleted")).drop("hit")


def list_files(manifest: DataFrame) -> DataFrame:
    return manifest.filter(~F.coalesce("deleted", F.lit(False))).orderBy(*_KEY)


def load_manifest(manifest: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with text and hash, warnings) of the live manifest over files (path, content); what cannot be read or is
    blank is warned of and left out, and so counts as removed."""
    live = manifest.filter(~F.coalesce("deleted", F.lit(False)))
    texts = load_documents(files.join(live.select("path").distinct(), "path", "left_semi"))
    joined = live.join(texts, "path", "left")
    good = F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))
    warnings = joined.filter(~good).select(*_KEY, F.when(F.col("text").isNull(), "unreadable").otherwise("blank").alias("warning"))
    return joined.filter(good).withColumn("sha256", content_hash(F.col("text"))), warnings
