"""Index backends behind one port: what upserts, deletes, copies and searches index entries.

Both keep entries and their postings (bigram, frequency) as tables partitioned by scope under a root all executors share.
A write replaces the partitions it concerns and no others; a search reads the partitions of its scopes and, of the
postings, the terms asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import SCHEMAS, SCOPE
from ..session import Scratch
from .search import bigram_index, hybrid_search
from .store import copy_version, delete_by_key, upsert_index

KEY = [*SCOPE, "object_type", "object_no"]
# Signs that have a meaning in a tag query.
_SPECIAL = ",.<>{}[]\"':;!@#$%^&*()-+=~/ \\"


def escape_tag(value: Column) -> Column:
    """A value with a backslash before every sign that has a meaning in a tag query."""
    signs = "".join("\\" + c for c in _SPECIAL)
    return F.regexp_replace(value, f"([{signs}])", r"\\$1")


@F.pandas_udf(T.BinaryType())
def pack_vector(v: pd.Series) -> pd.Series:
    """Vector as little-endian float32; null stays null."""
    return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def unpack_vector(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4").astype(float).tolist())


class HybridIndex(Protocol):
    def upsert(self, entries: DataFrame) -> int: ...
    def delete_objects(self, keys: DataFrame) -> None: ...
    def delete_by_filter(self, where: Column) -> None: ...
    def copy_version(self, keys: DataFrame, *, source: int, target: int) -> int: ...
    def search(self, queries: DataFrame, **how) -> DataFrame: ...


class TableIndex:
    """Entries as they are; the backend of choice."""

    def __init__(self, spark: SparkSession, root: str, *, dim: int | None = None, embed: Callable[[Column], Column] | None = None):
        self.spark, self.root, self.dim, self.embed = spark, root.rstrip("/"), dim, embed

    def _read(self, name: str, schema: str | T.StructType) -> DataFrame:
        path = f"{self.root}/{name}"
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def entries(self) -> DataFrame:
        return self._read("entries", self._schema())

    def postings(self) -> DataFrame:
        return self._read("postings", "graph_no string, graph_version bigint, object_type string, object_no string, term string, tf bigint")

    def _schema(self) -> T.StructType:
        return SCHEMAS["search_index"]

    def _stored(self, entries: DataFrame) -> DataFrame:
        return entries.select(*[f.name for f in self._schema().fields])

    def _plain(self, entries: DataFrame) -> DataFrame:
        return entries

    def _replace(self, rows: DataFrame, scopes: DataFrame) -> None:
        """The scopes' partitions hold these rows from now on."""
        scratch = Scratch(self.spark, "index")
        kept, scopes = scratch.write(rows), scratch.write(scopes.select(*SCOPE).distinct())
        put = lambda df, name: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SCOPE).parquet(f"{self.root}/{name}")
        put(self._stored(kept), "entries")
        put(bigram_index(self._plain(kept)), "postings")
        # a scope that has lost its last row is not written, so its folder goes
        for row in scopes.join(kept.select(*SCOPE).distinct(), SCOPE, "left_anti").toLocalIterator():
            for name in ("entries", "postings"):
                p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/graph_no={row['graph_no']}/graph_version={row['graph_version']}")
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        scratch.drop(kept, scopes)

    def _of(self, scopes: DataFrame) -> DataFrame:
        return self.entries().join(scopes.select(*SCOPE).distinct(), SCOPE, "left_semi")

    def upsert(self, entries: DataFrame) -> int:
        """Entries by key; missing embeddings are computed. Returns how many came; an empty batch changes nothing."""
        if self.dim is not None:
            bad = entries.filter(f"embedding is not null and size(embedding) <> {self.dim}")
            if not bad.isEmpty():
                raise ValueError(f"embeddings must have {self.dim} numbers")
        count = entries.count()
        if count:
            self._replace(upsert_index(self._of(entries), self._stored(entries), embed=self.embed), entries)
        return count

    def delete_objects(self, keys: DataFrame) -> None:
        self._replace(delete_by_key(self._of(keys), keys, KEY), keys)

    def delete_by_filter(self, where: Column) -> None:
        doomed = self.entries().filter(where)
        self._replace(self._of(doomed).filter(~F.coalesce(where, F.lit(False))), doomed)

    def copy_version(self, keys: DataFrame, *, source: int, target: int) -> int:
        """Rows of the keys (graph_no, object_type, object_no) copied to another version; missing ones are skipped."""
        rows = Scratch(self.spark, "copied").write(copy_version(self.entries(), keys, source=source, target=target))
        return self.upsert(rows)

    def search(self, queries: DataFrame, *, workspace: str | None = None, **how) -> DataFrame:
        """(query_no, object_type, object_no, score, rank); scopes of the queries only, unless ``scoped=False``. A workspace
        is taken by backends that have one."""
        entries, postings = self._plain(self.entries()), self.postings()
        if how.get("scoped", True):
            scopes = F.broadcast(queries.select(*SCOPE).distinct())
            entries, postings = entries.join(scopes, SCOPE, "left_semi"), postings.join(scopes, SCOPE, "left_semi")
        if workspace is not None and "workspace" in entries.columns:
            entries = entries.filter(F.col("workspace") == workspace)
            postings = postings.join(entries.select(*KEY), KEY, "left_semi")
        return hybrid_search(postings, entries, queries, **how)


class PackedIndex(TableIndex):
    """Vectors as float32 bytes under one key an object, with an optional workspace; for collections bound by memory. The
    dimension is checked, or taken from the first entry that has a vector."""

    prefix = "idx"

    def _schema(self) -> T.StructType:
        of = {f.name: f for f in SCHEMAS["search_index"].fields}
        return T.StructType([*[of[c] for c in KEY], of["searchable_text"], T.StructField("packed", T.BinaryType()), T.StructField("entry_key", T.StringType()), T.StructField("workspace", T.StringType())])

    def entries(self) -> DataFrame:
        return self._plain(super().entries())

    def _plain(self, entries: DataFrame) -> DataFrame:
        return entries.withColumn("embedding", unpack_vector("packed")).drop("packed") if "packed" in entries.columns else entries

    def _stored(self, entries: DataFrame) -> DataFrame:
        if "packed" in entries.columns:
            return entries
        if "workspace" not in entries.columns:
            entries = entries.withColumn("workspace", F.lit(None).cast("string"))
        key = F.concat_ws(":", F.lit(self.prefix), *[escape_tag(F.col(c).cast("string")) for c in KEY])
        return entries.withColumn("entry_key", key).select(*KEY, "searchable_text", "embedding", "entry_key", "workspace")

    def _replace(self, rows: DataFrame, scopes: DataFrame) -> None:
        super()._replace(rows.withColumn("packed", pack_vector("embedding")).select(*[f.name for f in self._schema().fields]), scopes)

    def upsert(self, entries: DataFrame) -> int:
        if self.dim is None:
            first = entries.filter("size(embedding) > 0").select(F.size("embedding")).first()
            self.dim = first[0] if first else None
        return super().upsert(entries)


BACKENDS: dict[str, type[TableIndex]] = {"table": TableIndex, "packed": PackedIndex}


@lru_cache(maxsize=16)
def index_backend(name: str, spark: SparkSession, root: str, dim: int | None = None) -> TableIndex:
    """The backend of a name, made once; an unknown name is an error."""
    if name.lower() not in BACKENDS:
        raise ValueError(f"unknown index backend: {name}")
    return BACKENDS[name.lower()](spark, root, dim=dim)
