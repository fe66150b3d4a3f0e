"""Recall: candidate pools, fusion over queries, retry tiers, graph expansion, evidence lines, chunk hits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.refs import token_lines
from ..model import DOC_CHUNK, EDGE, NODE, SCOPE, Settings
from ..session import Scratch
from .rank import ordered_union, reciprocal_rank_fusion, without
from .search import hybrid_search


def candidate_pool(node_hits: DataFrame, edge_hits: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_no, object_no, rank): node hits in order, then source and target of every edge hit in order; each once.

    Edge hits that no edge of the query's scope matches and blank ends are left out.
    """
    ends = edge_hits.select("query_no", *SCOPE, F.col("object_no").alias("graph_edge_no"), "rank").join(edges.select(*SCOPE, "graph_edge_no", "source_node_no", "target_node_no"), [*SCOPE, "graph_edge_no"])
    ends = ends.select("query_no", F.posexplode(F.array("source_node_no", "target_node_no")).alias("side", "object_no"), F.col("rank").alias("r"))
    ends = ends.filter(F.coalesce("object_no", F.lit("")) != "").select("query_no", "object_no", (F.col("r") * 2 + F.col("side")).alias("rank"))
    return ordered_union(node_hits.select("query_no", "object_no", "rank"), ends, by=["query_no"])


def rerank(pool: DataFrame, ranking: DataFrame) -> DataFrame:
    """(query_no, object_no, rank): pool members the ranking names, in its order, then the others in pool order."""
    named = ranking.join(pool.select("query_no", "object_no"), ["query_no", "object_no"], "left_semi")
    return ordered_union(named.select("query_no", "object_no", "rank"), pool, by=["query_no"])


def fuse_queries(pools: DataFrame) -> DataFrame:
    """(question_no, object_no, score, rank) from the pools (question_no, variant_no, object_no, rank) of all wordings
    of a question; a single wording keeps its order."""
    return reciprocal_rank_fusion(pools.withColumn("list_no", F.col("variant_no")), by=["question_no"])


def retry_tiers(tiers: DataFrame, *, min_results: int) -> DataFrame:
    """Of the pools (query_no, tier, object_no, rank), tier 0 strictest, each query's first with at least
    ``min_results`` members, else the last tier; without a minimum the configured tier 1. The pool's size decides, not
    what is left of it later."""
    if min_results <= 0:
        return tiers.filter("tier = 1")
    sizes = tiers.groupBy("query_no", "tier").agg(F.count(F.lit(1)).alias("n"))
    chosen = sizes.groupBy("query_no").agg(F.coalesce(F.min(F.when(F.col("n") >= min_results, F.col("tier"))), F.lit(2)).alias("tier"))
    return tiers.join(chosen, ["query_no", "tier"], "left_semi")


def seeds(pool: DataFrame, nodes: DataFrame, *, topk: int, explored: DataFrame | None = None) -> DataFrame:
    """First ``topk`` pool members that were not explored; deleted and missing nodes drop out after that."""
    fresh = without(pool, explored, ["query_no", "object_no"])
    cut = fresh.withColumn("rank", F.row_number().over(Window.partitionBy("query_no").orderBy("rank", "object_no"))).filter(F.col("rank") <= topk)
    return cut.join(nodes.select(F.col("graph_node_no").alias("object_no"), *SCOPE).distinct(), [*SCOPE, "object_no"], "left_semi")


def edges_of(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end in the frontier (query_no, scope, node_no): two equi-joins, each edge once a query."""
    sides = [
        edges.join(frontier.select("query_no", *SCOPE, F.col("node_no").alias(end)), [*SCOPE, end]).select("query_no", *SCOPE, "graph_edge_no", "source_node_no", "target_node_no", "name")
        for end in ("source_node_no", "target_node_no")
    ]
    return sides[0].unionByName(sides[1]).distinct()


@dataclass
class Expansion:
    """Neighbours (query_no, object_no, rank), edges walked and a trace row a hop."""

    neighbours: DataFrame
    edges: DataFrame
    trace: list[dict]


Ranker = Callable[[DataFrame], DataFrame]


def expand(start: DataFrame, edges: DataFrame, ranking: DataFrame | Ranker, *, neighbour_k: int, max_hops: int, exclude: DataFrame | None = None) -> Expansion:
    """Bounded breadth-first expansion of all queries at once.

    ``start`` is (query_no, scope, node_no, rank); ``ranking`` (query_no, object_no, rank) of possible neighbours, or a
    function that ranks the candidates (query_no, object_no) of a hop. Every hop takes all ends of the frontier's edges
    that were not seen, ranked ones first, the others in order of their edge; a query that has ``neighbour_k``
    neighbours stops, and its list is cut to that at the end. Excluded nodes are walked to but not kept. The driver
    loops at most ``max_hops`` times; each hop is two shuffles on node keys, written to the shared folder. The frontier
    goes on unranked; of a hop only the first ``neighbour_k`` a query are ranked, and as many a partition are sent.
    """
    scratch = Scratch(start.sparkSession, "expand")
    visited = start.select("query_no", "node_no")
    if exclude is not None:
        visited = visited.unionByName(exclude.select("query_no", F.col("object_no").alias("node_no")))
    visited = visited.distinct()
    frontier = start.select("query_no", *SCOPE, "node_no")
    picked = walked = counts = None
    trace = []
    for hop in range(max(1, max_hops)):
        hop_edges = scratch.write(edges_of(frontier, edges))
        walked = hop_edges if walked is None else walked.unionByName(hop_edges).distinct()
        ends = hop_edges.select("query_no", *SCOPE, F.posexplode(F.array("source_node_no", "target_node_no")).alias("side", "node_no"), "graph_edge_no")
        fresh = scratch.write(ends.groupBy("query_no", *SCOPE, "node_no").agg(F.min(F.struct("graph_edge_no", "side")).alias("at")).join(visited, ["query_no", "node_no"], "left_anti"))
        count = fresh.count()
        trace.append({"hop": hop + 1, "candidates": count})
        named = ranking(fresh.select("query_no", F.col("node_no").alias("object_no"))) if callable(ranking) else ranking
        order = fresh.join(named.select("query_no", F.col("object_no").alias("node_no"), F.col("rank").alias("r")), ["query_no", "node_no"], "left")
        first = order.withColumn("place", F.row_number().over(Window.partitionBy("query_no").orderBy(F.col("r").asc_nulls_last(), "at", "node_no"))).filter(F.col("place") <= neighbour_k)
        first = scratch.write(first.select("query_no", *SCOPE, "node_no", F.lit(hop).alias("hop"), "place"))
        picked = first if picked is None else picked.unionByName(first)
        if not count:
            break
        visited = visited.unionByName(fresh.select("query_no", "node_no"))
        here = fresh.groupBy("query_no").agg(F.count(F.lit(1)).alias("n"))
        counts = here if counts is None else counts.unionByName(here).groupBy("query_no").agg(F.sum("n").alias("n"))
        frontier = fresh.join(counts.filter(F.col("n") >= neighbour_k), "query_no", "left_anti").select("query_no", *SCOPE, "node_no")
    kept = picked.withColumn("rank", F.row_number().over(Window.partitionBy("query_no").orderBy("hop", "place"))).filter(F.col("rank") <= neighbour_k)
    return Expansion(kept.select("query_no", *SCOPE, F.col("node_no").alias("object_no"), "rank"), walked, trace)


def connecting_edges(walked: DataFrame, members: DataFrame) -> DataFrame:
    """Walked edges with both ends among the members (query_no, node_no), each once."""
    out = walked
    for end in ("source_node_no", "target_node_no"):
        out = out.join(members.select("query_no", F.col("node_no").alias(end)).distinct(), ["query_no", end], "left_semi")
    return out.dropDuplicates(["query_no", "graph_edge_no"])


def evidence_spans(refs: DataFrame, *, by: list[str], window: int = 0, gap: int = 3) -> DataFrame:
    """(by, doc_no, line_no) from rows with a map ``ref``: the lines of all tokens, ``window`` lines around them, and
    the lines of gaps where neighbours differ by at most ``gap``; lines count from 1.

    Works on whole runs of lines: a gap is filled by one sequence between neighbours found with one window.
    """
    lines = refs.select(*by, F.explode("ref").alias("doc_no", "tokens")).select(*by, "doc_no", F.explode("tokens").alias("token")).select(*by, "doc_no", F.explode(token_lines(F.col("token"))).alias("n"))
    around = lines.select(*by, "doc_no", F.explode(F.sequence(F.greatest(F.col("n") - window, F.lit(1)), F.greatest(F.col("n") + window, F.lit(0)))).alias("line_no")) if window else lines.select(*by, "doc_no", F.col("n").alias("line_no"))
    around = around.filter("line_no >= 1").distinct()
    before = F.lag("line_no").over(Window.partitionBy(*by, "doc_no").orderBy("line_no"))
    first = F.when((F.col("line_no") - F.col("prev") <= gap) & (F.col("line_no") - F.col("prev") > 1), F.col("prev") + 1).otherwise(F.col("line_no"))
    return around.withColumn("prev", before).select(*by, "doc_no", F.explode(F.sequence(first, F.col("line_no")).cast("array<int>")).alias("line_no"))


def evidence_lines(spans: DataFrame, doc_lines: DataFrame) -> DataFrame:
    """Spans (scope, doc_no, line_no, ...) with the content of the lines that exist."""
    return spans.join(doc_lines.select(*SCOPE, "doc_no", "line_no", "content"), [*SCOPE, "doc_no", "line_no"])


def chunk_hits(ranking: DataFrame, chunks: DataFrame, *, limit: int = 10) -> DataFrame:
    """Details of ranked chunks (query_no, object_no, score): one a chunk number at its best score, from the highest
    version that holds it; missing ones are skipped, order kept. Chunks are looked up across graphs and versions."""
    best = ranking.groupBy("query_no", "object_no").agg(F.max("score").alias("score"))
    cut = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_no").orderBy(F.desc("score"), "object_no"))).filter(F.col("rank") <= limit)
    newest = chunks.groupBy("chunk_no").agg(F.max(F.struct("graph_version", "graph_no", "id", "doc_no", "content", "line_start", "line_end")).alias("x"))
    return cut.join(newest, F.col("object_no") == F.col("chunk_no")).select("query_no", "rank", "score", "chunk_no", "x.graph_no", "x.graph_version", "x.doc_no", "x.content", "x.line_start", "x.line_end")


@dataclass
class Recall:
    """What a recall returns: seeds, neighbours, the edges between them, evidence lines, chunks, and what each stage held."""

    seeds: DataFrame
    neighbours: DataFrame
    edges: DataFrame
    evidence: DataFrame
    chunks: DataFrame
    trace: list[dict]


def question_pools(queries: DataFrame, *, index: DataFrame, entries: DataFrame, edges: DataFrame, wide: int, min_text: float, min_vector: float) -> DataFrame:
    """(query_no, object_no, rank): the candidate pool of every question, over all its wordings.

    ``queries`` is (query_no, variant_no, scope, text, embedding). Each wording has a pool of its own, of node hits and
    the ends of edge hits, reranked by a search restricted to it; the pools of a question are fused.
    """
    scratch = Scratch(queries.sparkSession, "pools")
    own = F.to_json(F.struct("query_no", "variant_no"))
    asked = scratch.write(queries.withColumn("question_no", F.col("query_no")).withColumn("query_no", own))
    hits = scratch.write(hybrid_search(index, entries.filter(F.col("object_type").isin(NODE, EDGE)), asked, min_text=min_text, min_vector=min_vector, limit=wide))
    edge_hits = hits.filter(F.col("object_type") == EDGE).join(asked.select("query_no", *SCOPE), "query_no")
    pool = scratch.write(candidate_pool(hits.filter(F.col("object_type") == NODE), edge_hits, edges))
    again = hybrid_search(index.filter(F.col("object_type") == NODE), entries.filter(F.col("object_type") == NODE), asked, min_text=min_text, min_vector=min_vector, limit=wide, allowed=pool)
    ordered = rerank(pool, again).join(asked.select("query_no", "question_no", "variant_no"), "query_no")
    fused = fuse_queries(ordered.select("question_no", "variant_no", "object_no", "rank"))
    return scratch.write(fused.select(F.col("question_no").alias("query_no"), "object_no", "rank"))


def laddered_pools(queries: DataFrame, *, settings: Settings, **tables: DataFrame) -> tuple[DataFrame, list[dict]]:
    """(pools, trace) with retries: questions whose strict pool has fewer than ``min_results`` members are asked again
    with the configured scores, and what is still short without any; without a minimum only the configured ones."""
    wide = max(4 * settings.topk, 20)
    configured = (settings.min_text_score, settings.min_vector_score)
    tiers = [(settings.strict_score, settings.strict_score), configured, (0.0, 0.0)] if settings.min_results > 0 else [configured]
    asked, found, trace = queries, None, []
    for number, (text, vector) in enumerate(tiers):
        pool = question_pools(asked, wide=wide, min_text=text, min_vector=vector, **tables)
        enough = pool.groupBy("query_no").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= settings.min_results).select("query_no")
        last = number == len(tiers) - 1
        kept = pool if last else pool.join(enough, "query_no", "left_semi")
        found = kept if found is None else found.unionByName(kept)
        trace.append({"tier": number, "pool": kept.count()})
        if last:
            break
        asked = asked.join(enough, "query_no", "left_anti")
        if asked.isEmpty():
            break
    return found, trace


def recall(queries: DataFrame, *, entries: DataFrame, index: DataFrame, nodes: DataFrame, edges: DataFrame, doc_lines: DataFrame, chunks: DataFrame, settings: Settings, explored: DataFrame | None = None, all_entries: DataFrame | None = None, all_index: DataFrame | None = None) -> Recall:
    """The whole recall of any number of questions (query_no, variant_no, scope, text, embedding); variant 0, or the least,
    is the question as asked.

    Pools over all wordings with retries, seeds, expansion with a search restricted to each hop's candidates at the
    configured scores, edges between what is found, evidence of nodes and edges, and chunks of all graphs and versions
    (``all_entries``, ``all_index``; the scope's own if they are not given).
    """
    scratch = Scratch(queries.sparkSession, "recall")
    queries = queries if "variant_no" in queries.columns else queries.withColumn("variant_no", F.lit(0))
    queries = scratch.write(queries)
    first = queries.groupBy("query_no").agg(F.min("variant_no").alias("variant_no"))
    plain = scratch.write(queries.join(first, ["query_no", "variant_no"]).drop("variant_no"))
    pool, ladder = laddered_pools(queries, settings=settings, index=index, entries=entries, edges=edges)
    start = scratch.write(seeds(pool.join(plain.select("query_no", *SCOPE), "query_no"), nodes, topk=settings.topk, explored=explored))

    node_entries, node_index = entries.filter(F.col("object_type") == NODE), index.filter(F.col("object_type") == NODE)
    near = max(4 * settings.neighbor_topk, 12)

    def rank_candidates(found: DataFrame) -> DataFrame:
        return hybrid_search(node_index, node_entries, plain, min_text=settings.min_text_score, min_vector=settings.min_vector_score, limit=near, allowed=found)

    exp = expand(
        start.select("query_no", *SCOPE, F.col("object_no").alias("node_no"), "rank"), edges, rank_candidates,
        neighbour_k=settings.neighbor_topk, max_hops=settings.max_hops, exclude=explored,
    )
    alive = exp.neighbours.join(nodes.select(*SCOPE, F.col("graph_node_no").alias("object_no")), [*SCOPE, "object_no"], "left_semi")
    neighbours = scratch.write(alive.select("query_no", *SCOPE, "object_no", "rank"))
    members = scratch.write(start.unionByName(neighbours, allowMissingColumns=True).select("query_no", *SCOPE, F.col("object_no").alias("node_no")))
    links = scratch.write(connecting_edges(exp.edges, members.select("query_no", "node_no")))
    refs = members.join(nodes.select(*SCOPE, F.col("graph_node_no").alias("node_no"), "ref"), [*SCOPE, "node_no"]).select("query_no", *SCOPE, "ref")
    refs = refs.unionByName(links.join(edges.select(*SCOPE, "graph_edge_no", "ref"), [*SCOPE, "graph_edge_no"]).select("query_no", *SCOPE, "ref"))
    lines = evidence_lines(evidence_spans(refs, by=["query_no", *SCOPE], window=settings.evidence_window), doc_lines)
    of_chunks = lambda df: df.filter(F.col("object_type") == DOC_CHUNK)
    everywhere = all_entries is not None
    ranking = hybrid_search(of_chunks(all_index if everywhere else index), of_chunks(all_entries if everywhere else entries), plain, min_text=settings.min_text_score, min_vector=settings.min_vector_score, limit=settings.chunk_topk, scoped=not everywhere)
    trace = [*ladder, {"seeds": start.count()}, *exp.trace, {"neighbours": neighbours.count(), "edges": links.count()}]
    return Recall(start, neighbours, links, lines, chunk_hits(ranking, chunks, limit=settings.chunk_topk), trace)
