"""Extraction by an injected model, and validation of what it returns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fill_template
from ..model import ARCHETYPES, CONFIDENCES, METATYPES, ontology_block

Extractor = Callable[[str], str]
_RAW = "doc_id string, nodes string, edges string, dropped array<string>"
_NODES = "array<struct<name:string,type:string,entity_spec:string,description:string,lines:array<string>>>"
_EDGES = "array<struct<source:string,label:string,target:string,confidence:string,description:string,lines:array<string>>>"


def rule_extractor(numbered: str) -> str:
    """Deterministic stand-in for a model: capitalised words of a line become artifacts, neighbours in a line edges."""
    nodes, edges = {}, []
    for line in numbered.split("\n"):
        m = re.match(r"\[(\d+)\] (.*)", line)
        if not m:
            continue
        found = list(dict.fromkeys(re.findall(r"\b[A-Z][\w'-]{2,}", m.group(2))))
        for name in found:
            nodes.setdefault(name, {"name": name, "type": "Asset", "entity_spec": "Artifact", "lines": []})["lines"].append(m.group(1))
        edges += [{"source": a, "label": "near", "target": b, "confidence": "INFERRED", "lines": [m.group(1)]} for a, b in zip(found, found[1:])]
    return json.dumps({"nodes": list(nodes.values()), "edges": edges})


#: What an extraction asks of each class of source.
TEMPLATES = {
    "DOC": "Name the entities of this document and how they relate.\n{{ontology}}\n\nLines carry their numbers; give those each item rests on.\n\n{{text}}",
    "PLAN": "Name the aims, decisions and tasks of this plan, who answers for them, and how they depend on each other.\n{{ontology}}\n\nLines carry their numbers; give those each item rests on.\n\n{{text}}",
    "CODE": "Name what this source implements and what it uses.\n{{ontology}}\n\nLines carry their numbers; give those each item rests on.\n\n{{text}}",
}
Model = Callable[[str], Iterator[str] | str]


def prompted(model: Model, kind: str = "DOC") -> Extractor:
    """Extractor that asks a model, given as a function from prompt to reply or to parts of it, with the template of a
    source class; parts without text are skipped."""
    template = TEMPLATES[kind]

    def ask(numbered: str) -> str:
        reply = model(fill_template(template, {"ontology": ontology_block(), "text": numbered}))
        return reply if isinstance(reply, str) else "".join(p for p in reply if p)

    return ask


def _objects(reply: str) -> dict:
    """The first JSON object of a chatty reply: decoding is tried from every opening brace until one holds."""
    decode = json.JSONDecoder().raw_decode
    at = reply.find("{")
    while at >= 0:
        try:
            found, _ = decode(reply, at)
            if isinstance(found, dict) and ("nodes" in found or "edges" in found or not found):
                return found
        except ValueError:
            pass
        at = reply.find("{", at + 1)
    raise ValueError("no JSON object")


def extract_span(lines: list[str], first: int, extractor: Extractor) -> tuple[list, list, list[str]]:
    """Nodes, edges and notes of a span of numbered lines, in line order. Spans are taken from a stack: one whose reply
    does not parse is replaced by its halves, down to single lines, which leave a note."""
    nodes: list = []
    edges: list = []
    notes: list[str] = []
    open_ = [(0, len(lines))]
    while open_:
        start, end = open_.pop()
        numbered = "\n".join(f"[{first + i}] {lines[i]}" for i in range(start, end))
        try:
            found = _objects(extractor(numbered))
        except (ValueError, TypeError) as e:
            middle = (start + end) // 2
            if end - start > 1:
                open_ += [(middle, end), (start, middle)]
            else:
                notes.append(f"line {first + start}: {type(e).__name__}")
            continue
        nodes += found.get("nodes") or []
        edges += found.get("edges") or []
    return nodes, edges, notes


def extract(docs: DataFrame, extractor: Extractor = rule_extractor) -> DataFrame:
    """(doc_id, nodes, edges, dropped) of documents (doc_id, text), nodes and edges as arrays of structs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(d, *extract_span((t or "").splitlines(), 1, extractor)) for d, t in zip(b["doc_id"], b["text"])]
            yield pd.DataFrame([(d, json.dumps(n), json.dumps(e), x) for d, n, e, x in out], columns=["doc_id", "nodes", "edges", "dropped"])

    raw = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, _RAW)
    return raw.select("doc_id", F.from_json("nodes", _NODES).alias("nodes"), F.from_json("edges", _EDGES).alias("edges"), "dropped")


def validate_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reason) of nodes (doc_id, name, type, entity_spec, ...): a name, a known class, an archetype
    if and only if an Asset; others lose theirs."""
    reason = (
        F.when(F.col("name").isNull() | ~F.col("name").rlike(r"(?U)\S"), "node: empty name")
        .when(F.col("type").isNull() | ~F.col("type").isin(*METATYPES), "node: unknown type")
        .when((F.col("type") == "Asset") & ~F.coalesce(F.col("entity_spec").isin(*ARCHETYPES), F.lit(False)), "node: unknown archetype")
    )
    judged = nodes.withColumn("reason", reason)
    kept = judged.filter("reason is null").drop("reason").withColumn("entity_spec", F.when(F.col("type") == "Asset", F.col("entity_spec")))
    return kept, judged.filter("reason is not null")


def validate_edges(edges: DataFrame, valid_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reason) of edges (doc_id, source, label, target, confidence, ...): a known confidence,
    INFERRED if none is given, and both ends among the valid nodes of the document."""
    e = edges.withColumn("confidence", F.coalesce("confidence", F.lit("INFERRED")))
    names = valid_nodes.select("doc_id", "name").distinct()
    for end in ("source", "target"):
        e = e.join(names.select("doc_id", F.col("name").alias(end), F.lit(True).alias(f"has_{end}")), ["doc_id", end], "left")
    reason = (
        F.when(~F.col("confidence").isin(*CONFIDENCES), "edge: unknown confidence")
        .when(F.col("has_source").isNull(), "edge: unknown source")
        .when(F.col("has_target").isNull(), "edge: unknown target")
    )
    judged = e.withColumn("reason", reason).drop("has_source", "has_target")
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")
