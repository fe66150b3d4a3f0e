"""Data model: table schemas, closed vocabularies, scope and settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METATYPES = ("Asset", "Relation", "Event", "Behavior")
ARCHETYPES = ("Solution", "Mission", "Implementation", "ServiceInstance", "Artifact")
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
NODE, EDGE, DOC_CHUNK = "NODE", "EDGE", "DOC_CHUNK"
BUILDING, ACTIVE, FROZEN = "BUILDING", "ACTIVE", "FROZEN"
MERGED, PRUNED, ROLLED_BACK = "MERGED", "PRUNED", "ROLLED_BACK"
SCOPE = ["graph_no", "graph_version"]

_S, _L, _I, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampNTZType()
_REF = T.MapType(_S, T.ArrayType(_S))


def _schema(spec: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in spec.items()])


_GV = {"graph_no": _S, "graph_version": _L}
SCHEMAS: dict[str, T.StructType] = {
    "graph_node": _schema({**_GV, "graph_node_no": _S, "name": _S, "type": _S, "description": _S, "properties": _S, "ref": _REF, "deleted": _B}),
    "domain_entity": _schema({**_GV, "graph_node_no": _S, "name": _S, "type": _S, "entity_spec": _S, "properties": _S, "deleted": _B}),
    "graph_edge": _schema({**_GV, "graph_edge_no": _S, "source_node_no": _S, "target_node_no": _S, "name": _S, "description": _S, "properties": _S, "ref": _REF, "deleted": _B}),
    "doc": _schema({**_GV, "doc_no": _S, "path": _S, "title": _S, "sha256": _S, "source_type": _S, "origin_url": _S}),
    "doc_line": _schema({**_GV, "doc_no": _S, "line_no": _I, "content": _S}),
    "doc_chunk": _schema({**_GV, "doc_no": _S, "chunk_no": _S, "chunk_index": _I, "content": _S, "origin_url": _S, "file_path": _S, "line_start": _I, "line_end": _I, "sha256": _S}),
    "search_index": _schema({**_GV, "object_type": _S, "object_no": _S, "searchable_text": _S, "embedding": T.ArrayType(T.DoubleType())}),
    "entity_alias": _schema({**_GV, "canonical_node_no": _S, "alias": _S, "source": _S}),
    "merge_edge": _schema({**_GV, "batch": _S, "graph_edge_no": _S, "source_node_no": _S, "target_node_no": _S, "name": _S, "description": _S, "properties": _S, "ref": _REF, "deleted": _B}),
    "merge_log": _schema({**_GV, "merge_id": _S, "winner_node_no": _S, "loser_node_no": _S, "snapshot": _S, "status": _S}),
    "graph": _schema({**_GV, "name": _S, "status": _S, "projection_done": _B}),
    "graph_file": _schema({"graph_no": _S, "doc_no": _S, "path": _S, "source_type": _S, "origin_url": _S, "deleted": _B}),
    "task": _schema({"task_no": _S, "task_type": _S, "graph_no": _S, "status": _S, "payload": _S, "progress_current": _I, "progress_total": _I, "attempts": _I, "max_attempts": _I, "available_at": _TS, "create_time": _TS, "lease_expires_at": _TS, "worker_id": _S, "error": _S, "active_key": _S}),
    "pipeline_run": _schema({"run_no": _S, "task_no": _S, "graph_no": _S, "base_version": _L, "target_version": _L, "status": _S, "total_steps": _I, "completed_steps": _I, "failed_steps": _I, "error": _S, "started_at": _TS, "finished_at": _TS}),
    "pipeline_step": _schema({"step_no": _S, "run_no": _S, "step_key": _S, "status": _S, "attempts": _I, "max_attempts": _I, "error": _S, "started_at": _TS, "finished_at": _TS}),
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def init_store(spark: SparkSession, root: str) -> list[str]:
    """Create the tables that do not exist yet under ``root``; doing it again changes nothing."""
    jvm = spark.sparkContext._jvm
    made = []
    for name in SCHEMAS:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            empty(spark, name).write.parquet(f"{root}/{name}/{0:012d}-000000")
            made.append(name)
    return made


@dataclass(frozen=True)
class GraphScope:
    """One version of one graph; passed on explicitly instead of through a context variable."""

    graph_no: str
    graph_version: int

    def where(self) -> Column:
        return (F.col("graph_no") == self.graph_no) & (F.col("graph_version") == self.graph_version)

    def of(self, df: DataFrame) -> DataFrame:
        return df.filter(self.where())


@dataclass(frozen=True)
class Settings:
    """Knobs that affect results, with their defaults; ``from_env`` overlays environment variables of these names."""

    topk: int = 5
    neighbor_topk: int = 3
    min_text_score: float = 0.0
    min_vector_score: float = 0.0
    chunk_size: int = 800
    chunk_overlap: int = 200
    max_queries: int = 1
    max_hops: int = 1
    chunk_topk: int = 10
    min_results: int = 0
    strict_score: float = 0.8
    candidate_topk: int = 10
    prune_min_support: int = 2
    state_ttl_seconds: float = 1800.0
    state_capacity: int = 1000
    lease_seconds: int = 900
    retry_delay_seconds: int = 5
    embedding_batch: int = 10
    evidence_window: int = 0
    graph_no: str = "default"
    graph_version: int = 1
    source_dir: str = "./data"
    embed_dim: int = 64
    index_backend: str = "table"
    prune_enabled: bool = False
    poll_seconds: float = 2.0
    code_langs: str = "python,go"
    code_cache_dir: str = ""

    @classmethod
    def from_env(cls, prefix: str = "QUILLGRAPH_") -> Settings:
        given = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is not None:
                given[f.name] = raw.strip().lower() in ("1", "true", "yes") if isinstance(f.default, bool) else type(f.default)(raw)
        return replace(cls(), **given)


#: What each class and archetype means, for prompts.
_MEANINGS = {
    "Asset": "a thing; it needs an archetype", "Relation": "a relation that stands as a node of its own, not an edge", "Event": "something that happened once, with its trigger or outcome", "Behavior": "a rule of the form when, if, do",
    "Mission": "why it is done: aim, intent", "Solution": "how it is done: plan, design", "Implementation": "what was made: code, document, configuration", "ServiceInstance": "what runs: a deployed service or endpoint", "Artifact": "any other product",
}


def ontology_block() -> str:
    """The closed vocabularies as a part of an extraction prompt."""
    line = lambda n: f"- {n}: {_MEANINGS[n]}"
    return "\n".join(["## Classes (type is one of these)", *map(line, METATYPES), "", "## Archetypes (entity_spec, of an Asset only)", *map(line, ARCHETYPES), "", f"## Confidence of an edge: {', '.join(CONFIDENCES)}", "Other classes have no entity_spec."])


def live(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.filter(~F.coalesce("deleted", F.lit(False)))
