"""Upserts by business key, index rows and reindexing. Tables are values: every function returns the new table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import chunk_no, content_hash, edge_no
from ..functions.refs import fold_properties, fold_refs, merge_props, ref_union
from ..functions.text import cut_pieces, searchable_text, split_lines, typed_entries
from ..model import DOC_CHUNK, EDGE, NODE, SCOPE, live

_NODE_KEY = [*SCOPE, "graph_node_no"]
_EDGE_KEY = [*SCOPE, "graph_edge_no"]


def _either(new: str, old: str) -> Column:
    return F.coalesce(F.col(new), F.col(old))


def upsert_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same key, all others kept."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_by_key(rows: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(doomed.select(*keys).distinct(), keys, "left_anti")


def fold_batch(rows: DataFrame, keys: list[str], *, seq: str = "seq") -> DataFrame:
    """One row a key from a batch, as if its rows were written one after the other in the order of ``seq``: the name is
    the first, the last description that says something counts, references unite, later properties win."""
    folded = rows.groupBy(*keys).agg(
        F.min_by("name", seq).alias("name"), F.min_by("type", seq).alias("type"),
        F.max_by("description", F.when(F.coalesce("description", F.lit("")) != "", F.col(seq))).alias("description"),
    )
    out = folded.join(fold_properties(rows, keys, F.col(seq), last=True), keys, "left").join(fold_refs(rows, keys), keys, "left")
    return out.withColumns({"properties": F.coalesce("properties", F.lit("{}")), "ref": F.coalesce("ref", F.create_map().cast("map<string,array<string>>"))})


def upsert_nodes(old: DataFrame, batch: DataFrame) -> DataFrame:
    """New node table after a folded batch: properties old ∪ new with the new winning, a description replaced if the new
    one says something, references united, the name kept. A soft-deleted match is left as it is."""
    n = batch.select(*_NODE_KEY, *[F.col(c).alias(f"new_{c}") for c in ("name", "type", "description", "properties", "ref")], F.lit(True).alias("arrived"))
    joined = old.withColumn("known", F.lit(True)).join(n, _NODE_KEY, "full_outer")
    gone = F.coalesce("deleted", F.lit(False))
    both = F.coalesce("known", F.lit(False)) & F.coalesce("arrived", F.lit(False)) & ~gone
    new_only = F.col("known").isNull()
    return joined.select(
        *_NODE_KEY,
        _either("name", "new_name").alias("name"), _either("type", "new_type").alias("type"),
        F.when(new_only, F.col("new_description")).when(both & (F.coalesce("new_description", F.lit("")) != ""), F.col("new_description")).otherwise(F.col("description")).alias("description"),
        F.when(new_only, F.col("new_properties")).when(both, merge_props(F.col("new_properties"), F.col("properties"))).otherwise(F.col("properties")).alias("properties"),
        F.when(new_only, F.col("new_ref")).when(both, ref_union(F.col("ref"), F.col("new_ref"))).otherwise(F.col("ref")).alias("ref"),
        gone.alias("deleted"),
    )


def upsert_domain(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Domain rows overwritten by key and brought back to life."""
    return upsert_by_key(old, batch.withColumn("deleted", F.lit(False)), _NODE_KEY)


def bind_edges(extracted: DataFrame, names: DataFrame) -> DataFrame:
    """Edges (doc_id, source_name, label, target_name, ...) with the keys their names bear in the same document; an edge
    with an unknown end is dropped. Of several nodes of one name in a document the last counts."""
    last = names.groupBy("doc_id", "name").agg(F.max_by("graph_node_no", "seq").alias("no"))
    out = extracted
    for end in ("source", "target"):
        out = out.join(last.select("doc_id", F.col("name").alias(f"{end}_name"), F.col("no").alias(f"{end}_node_no")), ["doc_id", f"{end}_name"])
    return out.withColumn("graph_edge_no", edge_no(F.col("source_node_no"), F.col("label"), F.col("target_node_no")))


def upsert_edges(old: DataFrame, batch: DataFrame) -> DataFrame:
    """New edge table after a batch folded by edge key: old properties keep, the new confidence counts, references
    unite. A soft-deleted edge is updated but stays deleted, and so out of the index."""
    n = batch.select(*_EDGE_KEY, *[F.col(c).alias(f"new_{c}") for c in ("source_node_no", "target_node_no", "name", "description", "properties", "ref")])
    joined = old.withColumn("known", F.lit(True)).join(n, _EDGE_KEY, "full_outer")
    new_only = F.col("known").isNull()
    confidence = F.to_json(F.map_filter(F.try_variant_get(F.try_parse_json("new_properties"), "$", "map<string,variant>"), lambda k, _: k == "confidence"))
    return joined.select(
        *_EDGE_KEY, *[_either(c, f"new_{c}").alias(c) for c in ("source_node_no", "target_node_no", "name", "description")],
        F.when(new_only, F.col("new_properties")).when(F.col("new_name").isNotNull(), merge_props(confidence, F.col("properties"))).otherwise(F.col("properties")).alias("properties"),
        F.when(new_only, F.col("new_ref")).when(F.col("new_name").isNotNull(), ref_union(F.col("ref"), F.col("new_ref"))).otherwise(F.col("ref")).alias("ref"),
        F.coalesce("deleted", F.lit(False)).alias("deleted"),
    )


def document_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(scope, doc_no, line_no from 1, content) of documents."""
    return docs.select(*SCOPE, "doc_no", F.posexplode(split_lines(F.col(text))).alias("i", "content")).select(*SCOPE, "doc_no", (F.col("i") + 1).alias("line_no"), "content")


def rewrite_lines(old: DataFrame, docs: DataFrame) -> DataFrame:
    """Line table with all lines of the given documents written anew."""
    return upsert_by_key(old, document_lines(docs), [*SCOPE, "doc_no"]) if docs is not None else old


def document_chunks(docs: DataFrame, *, size: int, overlap: int, keep: tuple[str, ...] = ("origin_url", "file_path")) -> DataFrame:
    """Chunk rows of documents (scope, doc_no, text, ...): one Arrow pass over batches of documents, no shuffle."""
    docs = docs.withColumn("sha256", content_hash(F.col("text"))) if "sha256" not in docs.columns else docs
    kept = [*SCOPE, "doc_no", *[c for c in keep if c in docs.columns], "sha256"]
    rows = docs.select(*kept, "text").filter("text is not null")
    schema = T.StructType([*[rows.schema[c] for c in kept], *T.StructType.fromDDL("chunk_index int, content string, line_start int, line_end int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = cut_pieces(batch.column(len(kept)).to_pylist(), size, overlap)
            if found:
                text, *columns = zip(*found)
                own = batch.select(range(len(kept))).take(pa.array(text, pa.int64()))
                cut = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*own.columns, *cut], names=schema.names)

    parts = rows.mapInArrow(run, schema)
    return parts.select(*SCOPE, "doc_no", chunk_no(F.col("doc_no"), F.col("chunk_index")).alias("chunk_no"), "chunk_index", "content", *[c for c in keep if c in docs.columns], "line_start", "line_end", "sha256")


def persist_chunks(old: DataFrame, docs: DataFrame, *, size: int, overlap: int) -> DataFrame:
    """Chunk table after (re)chunking the documents whose hash differs from that of their stored chunks."""
    docs = docs if "sha256" in docs.columns else docs.withColumn("sha256", content_hash(F.col("text")))
    stored = old.select(*SCOPE, "doc_no", "sha256").distinct()
    stale = docs.join(stored, [*SCOPE, "doc_no", "sha256"], "left_anti")
    return old.join(stale.select(*SCOPE, "doc_no"), [*SCOPE, "doc_no"], "left_anti").unionByName(document_chunks(stale, size=size, overlap=overlap), allowMissingColumns=True)


def index_rows(nodes: DataFrame | None, edges: DataFrame | None, chunks: DataFrame | None, aliases: DataFrame | None, *, embed=None) -> DataFrame:
    """Search index of live nodes (with their aliases), live edges and chunks; ``embed`` maps the text column to a
    vector column, without it embeddings are null and search is by text alone."""
    none = F.array().cast("array<string>")
    parts = []
    if nodes is not None:
        n = live(nodes)
        if aliases is not None:
            a = aliases.groupBy(*SCOPE, F.col("canonical_node_no").alias("graph_node_no")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
            n = n.join(a, _NODE_KEY, "left")
        else:
            n = n.withColumn("aliases", none)
        parts.append(n.select(*SCOPE, F.lit(NODE).alias("object_type"), F.col("graph_node_no").alias("object_no"), searchable_text(F.col("name"), F.col("description"), typed_entries(F.col("properties")), F.col("aliases")).alias("searchable_text")))
    if edges is not None:
        parts.append(live(edges).select(*SCOPE, F.lit(EDGE).alias("object_type"), F.col("graph_edge_no").alias("object_no"), searchable_text(F.col("name"), F.col("description"), typed_entries(F.col("properties")), none).alias("searchable_text")))
    if chunks is not None:
        parts.append(chunks.select(*SCOPE, F.lit(DOC_CHUNK).alias("object_type"), F.col("chunk_no").alias("object_no"), F.col("content").alias("searchable_text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("embedding", embed(F.col("searchable_text")) if embed else F.lit(None).cast("array<double>"))


def upsert_index(old: DataFrame, new: DataFrame, *, embed=None) -> DataFrame:
    """Index with the new entries by key; missing embeddings are computed, given ones kept."""
    if embed is not None:
        new = new.withColumn("embedding", F.coalesce("embedding", embed(F.col("searchable_text"))))
    return upsert_by_key(old, new, [*SCOPE, "object_type", "object_no"])


def reindexed(index: DataFrame, keys: DataFrame, *, nodes: DataFrame, edges: DataFrame, aliases: DataFrame | None, embed=None) -> DataFrame:
    """Index with the rows of single nodes (with their aliases) and edges, given as (object_type, object_no), written
    anew; what is no longer live leaves it. All other rows stay as they are."""
    key = ["object_type", "object_no"]
    wanted = keys.select(*key).distinct()
    of = lambda rows, kind, no: rows.join(wanted.filter(F.col("object_type") == kind).select(F.col("object_no").alias(no)), no, "left_semi")
    fresh = index_rows(of(nodes, NODE, "graph_node_no"), of(edges, EDGE, "graph_edge_no"), None, aliases, embed=embed)
    return upsert_index(delete_by_key(index, wanted, key), fresh)


def copy_version(index: DataFrame, keys: DataFrame, *, source: int, target: int) -> DataFrame:
    """Index rows of the keys (graph_no, object_type, object_no) copied from one version to another, embeddings as they
    are; keys without a source row are skipped."""
    rows = index.filter(F.col("graph_version") == source).join(keys, ["graph_no", "object_type", "object_no"], "left_semi")
    return rows.withColumn("graph_version", F.lit(target).cast("bigint"))


def reindex_counts(index: DataFrame) -> DataFrame:
    return index.groupBy(*SCOPE).agg(*[F.count_if(F.col("object_type") == t).alias(t.lower() + "s") for t in (NODE, EDGE, DOC_CHUNK)])
