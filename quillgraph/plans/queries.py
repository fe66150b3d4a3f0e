"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import refs as R
from ..functions import text as X
from ..functions.vectors import cosine, dot
from ..model import DOC_CHUNK, METATYPES, NODE, SCHEMAS, SCOPE, Settings, live
from ..operators import codegraph as C
from ..operators import extract as E
from ..operators import fusion as U
from ..operators import lookup as L
from ..operators import rank as A
from ..operators import recall as Y
from ..operators import search as S
from ..operators import store as W
from ..operators import versions as V
from ..operators.index import escape_tag
from ..operators.snapshots import snapshot_changes
from ..session import Scratch, table
from ..sources.files import source_class, suffix_of
from ..streaming import events as N
from ..streaming import state as B
from ..streaming import tasks as T
from . import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# --- what changed between snapshots -------------------------------------------------------------------------------


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents added, removed or changed between consecutive snapshots of a graph."""
    rows = table(spark, sf_dir, "kg_doc")
    return snapshot_changes(rows, compared=[F.lower("sha256")], time=F.col("update_time"))


# --- scans, filters, joins ----------------------------------------------------------------------------------------


@query
def scan_scope_filter(spark, sf_dir):
    """Live nodes by scope and class."""
    return live(views.nodes(spark, sf_dir)).groupBy(*SCOPE, "class").agg(F.count(F.lit(1)).alias("nodes"))


@query
def find_entities_like(spark, sf_dir):
    n = views.nodes(spark, sf_dir)
    return L.find_entities(n.drop("class"), views.domain(n), "ledger", limit=20).select(*SCOPE, "graph_node_no", "name", "class", "entity_spec")


@query
def node_domain_join(spark, sf_dir):
    n = views.nodes(spark, sf_dir)
    return L.with_domain(n.drop("class"), views.domain(n)).select(*SCOPE, "graph_node_no", "class", "entity_spec", "deleted")


@query
def typed_nodes(spark, sf_dir):
    """Nodes of each class in turn."""
    n = views.nodes(spark, sf_dir)
    of = [L.nodes_of_type(n.drop("class"), views.domain(n), t).select(*SCOPE, "graph_node_no", "entity_spec", F.lit(t).alias("type")) for t in METATYPES]
    return reduce(DataFrame.unionByName, of)


@query
def relations_one_hop(spark, sf_dir):
    n = views.nodes(spark, sf_dir)
    return L.relations_of(views.edges(spark, sf_dir, n), n, n.select(*SCOPE, F.col("graph_node_no").alias("node_no")))


@query
def graph_snapshot_closed(spark, sf_dir):
    n = views.nodes(spark, sf_dir)
    return L.edges_within(views.edges(spark, sf_dir, n), L.snapshot_nodes(n, limit=200)).select(*SCOPE, "graph_edge_no", "source_node_no", "target_node_no", "name")


@query
def unreferenced_nodes(spark, sf_dir):
    n = views.nodes(spark, sf_dir)
    return L.unreferenced(n, views.edges(spark, sf_dir, n)).select(*SCOPE, "graph_node_no")


# --- retrieval ----------------------------------------------------------------------------------------------------


@query
def vector_topk(spark, sf_dir):
    i = views.index(spark, sf_dir)
    return S.vector_channel(i, views.questions(i), limit=20).select("query_no", "object_type", "object_no", "score", "rank")


@query
def text_bigram_topk(spark, sf_dir):
    i = views.index(spark, sf_dir)
    return S.text_channel(S.bigram_index(i), i, views.questions(i), limit=20).select("query_no", "object_type", "object_no", "score", "rank")


def _hits(spark, sf_dir):
    i = views.index(spark, sf_dir)
    return S.hybrid_search(S.bigram_index(i), i, views.questions(i), limit=20)


@query
def hybrid_search(spark, sf_dir):
    return _hits(spark, sf_dir).select("query_no", "object_type", "object_no", F.round("score", 6).alias("score"), "rank")


def _two_lists(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").cast("string").alias("object_no"), F.col("embedding").cast("array<double>").alias("v"))
    first = e.groupBy("label").agg(F.min_by("v", F.col("object_no").cast("bigint")).alias("q"))
    e = e.join(first, "label")
    cos = A.ranked(e.withColumn("score", F.round(cosine(F.col("v"), F.col("q")), 6)), by=["label"]).withColumn("list_no", F.lit(0))
    inner = A.ranked(e.withColumn("score", F.round(dot(F.col("v"), F.col("q")), 6)), by=["label"]).withColumn("list_no", F.lit(1))
    keep = ["label", "list_no", "object_no", "rank", "score"]
    return cos.select(*keep).unionByName(inner.select(*keep))


@query
def rrf_two_lists(spark, sf_dir):
    return A.reciprocal_rank_fusion(_two_lists(spark, sf_dir), by=["label"], top_k=10).select("label", "object_no", F.round("score", 6).alias("score"), "rank")


@query
def rrf_representative(spark, sf_dir):
    return A.fuse_objects(_two_lists(spark, sf_dir).withColumnRenamed("score", "value"), by=["label"], better=F.col("value"), keep=["value"], top_k=10).select("label", "object_no", F.round("value", 6).alias("value"), "rank")


def _pool(spark, sf_dir):
    n = views.nodes(spark, sf_dir)
    e = views.edges(spark, sf_dir, n)
    hits = _hits(spark, sf_dir).filter(F.col("object_type") == NODE)
    q = F.concat_ws("@", "graph_no", F.col("graph_version").cast("string")).alias("query_no")
    edge_hits = e.withColumn("rank", F.row_number().over(Window.partitionBy(*SCOPE).orderBy("graph_edge_no"))).filter("rank <= 20").select(q, *SCOPE, F.col("graph_edge_no").alias("object_no"), "rank")
    return n, e, hits, Y.candidate_pool(hits, edge_hits, e)


@query
def candidate_pool(spark, sf_dir):
    return _pool(spark, sf_dir)[3]


@query
def restricted_rerank(spark, sf_dir):
    """The pool in the order of a vector search restricted to it, the others behind."""
    _, _, _, pool = _pool(spark, sf_dir)
    i = views.index(spark, sf_dir)
    again = S.vector_channel(i.filter("object_type = 'NODE'"), views.questions(i), limit=20, allowed=pool)
    return Y.rerank(pool, again)


def _variant_pools(spark, sf_dir):
    i = views.index(spark, sf_dir)
    q = views.questions(i, per_scope=3).withColumn("query_no", F.concat_ws("#", "query_no", F.col("variant_no").cast("string")))
    hits = S.vector_channel(i.filter("object_type = 'NODE'"), q, limit=20)
    return hits.select(F.split_part("query_no", F.lit("#"), F.lit(1)).alias("question_no"), F.split_part("query_no", F.lit("#"), F.lit(2)).cast("int").alias("variant_no"), "object_no", "rank")


@query
def multi_query_fusion(spark, sf_dir):
    return Y.fuse_queries(_variant_pools(spark, sf_dir)).select("question_no", "object_no", F.round("score", 6).alias("score"), "rank")


@query
def retry_ladder(spark, sf_dir):
    """Vector pools at three thresholds; each query keeps the strictest with at least five members."""
    i = views.index(spark, sf_dir).filter("object_type = 'NODE'")
    q = views.questions(views.index(spark, sf_dir))
    hits = S.vector_channel(i, q, min_score=0.0, limit=20)
    tiers = hits.select("query_no", "object_no", "score", "rank", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("tier")).filter("score > case tier when 0 then 0.8 when 1 then 0.4 else 0.0 end")
    return Y.retry_tiers(tiers.drop("score"), min_results=5).select("query_no", "tier", "object_no", "rank")


def _start(spark, sf_dir):
    n = views.nodes(spark, sf_dir)
    e = views.edges(spark, sf_dir, n)
    q = F.concat_ws("@", "graph_no", F.col("graph_version").cast("string")).alias("query_no")
    start = e.groupBy(*SCOPE).agg(F.min("source_node_no").alias("node_no")).select(q, *SCOPE, "node_no", F.lit(1).alias("rank"))
    i = views.index(spark, sf_dir).filter("object_type = 'NODE'")
    ranking = S.vector_channel(i, views.questions(i), limit=20).select("query_no", "object_no", "rank")
    return start, e, ranking


@query
def expand_one_hop(spark, sf_dir):
    start, e, ranking = _start(spark, sf_dir)
    return Y.expand(start, e, ranking, neighbour_k=3, max_hops=1).neighbours.select("query_no", "object_no", "rank")


@query
def expand_two_hops(spark, sf_dir):
    start, e, ranking = _start(spark, sf_dir)
    return Y.expand(start, e, ranking, neighbour_k=5, max_hops=2).neighbours.select("query_no", "object_no", "rank")


@query
def connecting_edges(spark, sf_dir):
    start, e, ranking = _start(spark, sf_dir)
    out = Y.expand(start, e, ranking, neighbour_k=3, max_hops=1)
    members = start.select("query_no", "node_no").unionByName(out.neighbours.select("query_no", F.col("object_no").alias("node_no")))
    return Y.connecting_edges(out.edges, members).select("query_no", "graph_edge_no", "source_node_no", "target_node_no")


@query
def explored_exclusion(spark, sf_dir):
    """Seeds of every pool once its first three members count as explored."""
    n, _, hits, pool = _pool(spark, sf_dir)
    q = views.questions(views.index(spark, sf_dir)).select("query_no", *SCOPE)
    return Y.seeds(pool.join(q, "query_no"), live(n), topk=5, explored=pool.filter("rank <= 3")).select("query_no", "object_no", "rank")


@query
def ref_expand(spark, sf_dir):
    n = live(views.nodes(spark, sf_dir))
    t = n.select(*SCOPE, "graph_node_no", F.explode("ref").alias("doc_no", "tokens")).select(*SCOPE, "graph_node_no", "doc_no", F.explode("tokens").alias("token"))
    return t.select(*SCOPE, "graph_node_no", "doc_no", "token", F.explode(R.token_lines(F.col("token"))).alias("line_no")).distinct()


@query
def ref_gap_merge(spark, sf_dir):
    n = live(views.nodes(spark, sf_dir)).select(*SCOPE, "graph_node_no", "ref")
    return Y.evidence_spans(n, by=[*SCOPE, "graph_node_no"], window=1)


def _doc_lines(spark, sf_dir, n):
    version = n.groupBy("graph_no").agg(F.max("graph_version").alias("graph_version"))
    d = table(spark, sf_dir, "documents").join(version, "graph_no")
    return W.document_lines(d.filter("text is not null"))


@query
def evidence_lines(spark, sf_dir):
    n = live(views.nodes(spark, sf_dir)).select(*SCOPE, "graph_node_no", "ref")
    spans = Y.evidence_spans(n, by=[*SCOPE, "graph_node_no"])
    return Y.evidence_lines(spans, _doc_lines(spark, sf_dir, n)).select(*SCOPE, "graph_node_no", "doc_no", "line_no", F.sha2("content", 256).alias("line_hash"))


@query
def chunk_channel(spark, sf_dir):
    hits = _hits(spark, sf_dir).filter(F.col("object_type") == DOC_CHUNK)
    return Y.chunk_hits(hits, table(spark, sf_dir, "kg_doc_chunk"), limit=10).select("query_no", "chunk_no", "graph_version", "doc_no", "line_start", "line_end", "rank")


def _recalled(spark, sf_dir):
    """The whole recall of one question a scope, chunks looked up in all graphs."""
    scratch = Scratch(spark, "recalled")
    n = scratch.write(views.nodes(spark, sf_dir))
    i = scratch.write(views.index(spark, sf_dir))
    postings = scratch.write(S.bigram_index(i))
    lines = _doc_lines(spark, sf_dir, n)
    return Y.recall(
        views.questions(i), entries=i, index=postings, nodes=live(n), edges=_near_edges(spark, sf_dir, n), doc_lines=lines, chunks=table(spark, sf_dir, "kg_doc_chunk"), settings=Settings(),
        all_entries=i, all_index=postings,
    )


@query
def recall_full(spark, sf_dir):
    """Seeds, neighbours, edges and chunks of every question's recall."""
    r = _recalled(spark, sf_dir)
    part = lambda df, name, no, rank: df.select("query_no", F.lit(name).alias("part"), F.col(no).alias("object_no"), rank.cast("int").alias("rank"))
    out = part(r.seeds, "seed", "object_no", F.col("rank")).unionByName(part(r.neighbours, "neighbour", "object_no", F.col("rank")))
    return out.unionByName(part(r.edges, "edge", "graph_edge_no", F.lit(0))).unionByName(part(r.chunks, "chunk", "chunk_no", F.col("rank")))


@query
def recall_evidence(spark, sf_dir):
    """Lines that nodes and edges of every question's recall rest on."""
    return _recalled(spark, sf_dir).evidence.select("query_no", "doc_no", "line_no", F.sha2("content", 256).alias("line_hash"))


# --- text, keys, documents ----------------------------------------------------------------------------------------


@query
def doc_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", F.posexplode(X.split_lines(F.col("text"))).alias("i", "line")).select("doc_id", (F.col("i") + 1).alias("line_no"), F.length("line").alias("n_chars"), F.sha2("line", 256).alias("line_hash"))


@query
def doc_titles(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", X.title(F.col("text"), F.col("doc_no")).alias("title"))


@query
def numbered_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", F.sha2(X.numbered_text(F.col("text")), 256).alias("numbered_hash"))


@query
def chunk_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null").withColumn("graph_version", F.lit(1).cast("bigint"))
    out = W.document_chunks(d.select(*SCOPE, "doc_no", "text"), size=Settings.chunk_size, overlap=Settings.chunk_overlap)
    return out.select("graph_no", "doc_no", "chunk_no", "chunk_index", "line_start", "line_end", F.sha2("content", 256).alias("content_hash"))


@query
def source_classes(spark, sf_dir):
    d = views.docs(spark, sf_dir)
    return d.select(*SCOPE, "doc_no", source_class(F.col("doc_no"), F.col("title")).alias("source_class"))


@query
def content_hashes(spark, sf_dir):
    """Documents whose stored newest hash is not that of their text."""
    newest = views.docs(spark, sf_dir).groupBy("graph_no", "doc_no").agg(F.max_by(F.lower("sha256"), "graph_version").alias("stored"))
    d = table(spark, sf_dir, "documents").select("graph_no", "doc_no", K.content_hash(F.col("text")).alias("sha256"))
    return d.join(newest, ["graph_no", "doc_no"]).select("graph_no", "doc_no", "sha256", F.coalesce(F.col("sha256") == F.col("stored"), F.lit(False)).alias("agrees"))


@query
def slug_keys(spark, sf_dir):
    n = views.nodes(spark, sf_dir).filter("name is not null")
    spec = F.when(F.col("class") == "Asset", F.split_part("graph_node_no", F.lit(":"), F.lit(2)))
    return n.select(*SCOPE, "graph_node_no", K.slug(F.col("name")).alias("slug"), K.node_no(F.col("class"), spec, F.col("name")).alias("node_no"))


@query
def slug_plain(spark, sf_dir):
    """Slugs and keys of all names without Unicode normalisation."""
    n = views.nodes(spark, sf_dir).filter("name is not null")
    return n.select(*SCOPE, "graph_node_no", K.slug(F.col("name"), normalize=False).alias("slug"), K.node_no(F.col("class"), None, F.col("name"), normalize=False).alias("node_no"))


@query
def tag_escape(spark, sf_dir):
    return views.nodes(spark, sf_dir).filter("name is not null").select(*SCOPE, "graph_node_no", escape_tag(F.col("name")).alias("tag"))


@query
def source_types(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.regexp_replace(suffix_of(F.col("doc_no")), r"^\.", "").alias("source_type"))


@query
def url_keys(spark, sf_dir):
    d = views.docs(spark, sf_dir).filter("trim(origin_url) <> ''")
    return d.select(*SCOPE, "doc_no", K.url_doc_no(F.col("origin_url")).alias("url_no"))


@query
def edge_keys(spark, sf_dir):
    return views.trade_edges(spark, sf_dir).select("source", "name", "target", K.edge_no(F.col("source"), F.col("name"), F.col("target")).alias("edge_no"))


@query
def searchable_text(spark, sf_dir):
    n = views.nodes(spark, sf_dir)
    a = _aliases(spark, sf_dir)
    out = W.index_rows(n, views.edges(spark, sf_dir, n), table(spark, sf_dir, "kg_doc_chunk").select(*SCOPE, "chunk_no", "content").distinct(), a)
    return out.select(*SCOPE, "object_type", "object_no", F.sha2("searchable_text", 256).alias("text_hash"))


# --- extraction and upserts ---------------------------------------------------------------------------------------


def _extracted(spark, sf_dir):
    """Nodes as an extraction would return them: one a stored row, some without a class or an archetype."""
    r = table(spark, sf_dir, "kg_graph_node")
    part = lambda i: F.split_part("graph_node_no", F.lit(":"), F.lit(i))
    return r.select(F.col("graph_no").alias("doc_id"), "name", part(1).alias("type"), F.when(F.split("graph_node_no", ":")[2].isNotNull(), part(2)).alias("entity_spec"), "graph_node_no", F.col("id").alias("seq"))


@query
def validate_nodes(spark, sf_dir):
    kept, dropped = E.validate_nodes(_extracted(spark, sf_dir))
    out = kept.withColumn("reason", F.lit("")).select("seq", "entity_spec", "reason")
    return out.unionByName(dropped.select("seq", F.lit(None).cast("string").alias("entity_spec"), "reason"))


@query
def validate_edges(spark, sf_dir):
    kept, _ = E.validate_nodes(_extracted(spark, sf_dir))
    m = table(spark, sf_dir, "kg_merge_log")
    e = m.select(F.col("id").alias("seq"), F.col("graph_no").alias("doc_id"), F.element_at(F.split("winner_node_no", ":"), -1).alias("source"), F.element_at(F.split("loser_node_no", ":"), -1).alias("target"), F.lit("same_as").alias("label"), F.when(F.col("status") == "MERGED", "EXTRACTED").when(F.col("status") == "PRUNED", "MAYBE").alias("confidence"))
    names = kept.select("doc_id", F.element_at(F.split("graph_node_no", ":"), -1).alias("name"))
    good, bad = E.validate_edges(e, names)
    return good.select("seq", "confidence", F.lit("").alias("reason")).unionByName(bad.select("seq", "confidence", "reason"))


@query
def extract_rules(spark, sf_dir):
    """The rule extractor over all documents: nodes, edges and notes of each."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    return E.extract(d).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"), F.size("dropped").alias("n_dropped"))


@query
def node_upsert(spark, sf_dir):
    """The oldest row of every key as the table, all later ones folded into it as one batch."""
    r = table(spark, sf_dir, "kg_graph_node").withColumn("n", F.row_number().over(Window.partitionBy(*SCOPE, "graph_node_no").orderBy("id")))
    old = r.filter("n = 1").select(*SCOPE, "graph_node_no", "name", "type", "description", "properties", "ref", "deleted")
    batch = W.fold_batch(r.filter("n > 1"), [*SCOPE, "graph_node_no"], seq="n")
    out = W.upsert_nodes(old, batch)
    return out.select(*SCOPE, "graph_node_no", "name", "description", R.support(F.col("ref")).alias("support"), F.size(F.array_distinct(F.flatten(F.map_values("ref")))).alias("tokens"), "deleted")


@query
def edge_upsert(spark, sf_dir):
    """The merges of even ids as stored edges, all merges as the batch."""
    n = views.nodes(spark, sf_dir)
    e = views.edges(spark, sf_dir, n)
    old = e.filter(F.col("graph_edge_no") < "8")
    out = W.upsert_edges(old, e.withColumn("properties", F.lit('{"confidence":"EXTRACTED"}')))
    return out.select(*SCOPE, "graph_edge_no", "source_node_no", "target_node_no", "name", "properties", R.support(F.col("ref")).alias("support"))


@query
def index_copy_version(spark, sf_dir):
    i = views.index(spark, sf_dir)
    top = i.agg(F.max("graph_version").alias("graph_version"))
    base = top.first()[0] if not top.isEmpty() else 0
    return W.copy_version(i, i.select("graph_no", "object_type", "object_no").distinct(), source=base, target=base + 1).select("graph_no", "graph_version", "object_type", "object_no", F.size("embedding").alias("dim"))


@query
def reindex_counts(spark, sf_dir):
    n = views.nodes(spark, sf_dir)
    out = W.index_rows(n, views.edges(spark, sf_dir, n), table(spark, sf_dir, "kg_doc_chunk").select(*SCOPE, "chunk_no", "content").dropDuplicates([*SCOPE, "chunk_no"]), None)
    return W.reindex_counts(out)


# --- fusion -------------------------------------------------------------------------------------------------------


@query
def fusion_candidates(spark, sf_dir):
    return U.fusion_candidates(views.nodes(spark, sf_dir), limit=Settings.candidate_topk).select(*SCOPE, "graph_node_no", "candidate_no", "score", "rank")


@query
def fusion_components(spark, sf_dir):
    return U.fusion_components(views.merge_pairs(spark, sf_dir))


@query
def fusion_clusters(spark, sf_dir):
    """Pairs a clusterer that goes by the first word of names makes of the candidates."""

    def by_first_word(_kind, names):
        groups = {}
        for name in names:
            groups.setdefault((name.split() or [""])[0].lower(), []).append(name)
        return [g for g in groups.values() if len(g) > 1]

    n = views.nodes(spark, sf_dir)
    return U.candidate_clusters(n, by_first_word, limit=Settings.candidate_topk)


def _groups(spark, sf_dir, n):
    g = U.fusion_components(views.merge_pairs(spark, sf_dir))
    alive = live(n).select(*SCOPE, "graph_node_no")
    g = g.join(alive, [*SCOPE, "graph_node_no"], "left_semi")
    # the winner is the smallest live key of its group
    best = g.groupBy(*SCOPE, "winner_node_no").agg(F.min("graph_node_no").alias("best"))
    return Scratch(spark, "groups").write(g.join(best, [*SCOPE, "winner_node_no"]).select(*SCOPE, "graph_node_no", F.col("best").alias("winner_node_no")))


@query
def merge_nodes(spark, sf_dir):
    n = views.nodes(spark, sf_dir)
    out = U.merged_nodes(n, _groups(spark, sf_dir, n))
    return out.select(*SCOPE, "graph_node_no", "name", F.length("description").alias("description_length"), R.support(F.col("ref")).alias("support"), "deleted")


def _near_edges(spark, sf_dir, n):
    """Edges ``cites`` between nodes whose references name one document: from each node to the next by key."""
    d = live(n).select(*SCOPE, "graph_node_no", "ref", F.explode(F.map_keys("ref")).alias("doc_no"))
    after = d.withColumn("next", F.lead("graph_node_no").over(Window.partitionBy(*SCOPE, "doc_no").orderBy("graph_node_no"))).filter("next is not null and next <> graph_node_no")
    one = after.groupBy(*SCOPE, "graph_node_no", "next").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_set("doc_no")), lambda x: F.struct(x, F.array(F.lit("1"))))).alias("ref"))
    return Scratch(spark, "near").write(one.select(
        *SCOPE, K.edge_no(F.col("graph_node_no"), F.lit("cites"), F.col("next")).alias("graph_edge_no"), F.col("graph_node_no").alias("source_node_no"), F.col("next").alias("target_node_no"), F.lit("cites").alias("name"),
        F.concat(F.lit("from "), "graph_node_no").alias("description"), F.lit('{"confidence":"INFERRED"}').alias("properties"), "ref", F.lit(False).alias("deleted"),
    ))


@query
def merge_edges_remap(spark, sf_dir):
    """Live edges between nodes of one document once all merges are in force."""
    n = views.nodes(spark, sf_dir)
    out = U.remapped_edges(_near_edges(spark, sf_dir, n), _groups(spark, sf_dir, n))
    return live(out).select(*SCOPE, "graph_edge_no", "source_node_no", "target_node_no", R.support(F.col("ref")).alias("support"), "folded")


@query
def merge_edges_dropped(spark, sf_dir):
    """Edges that merges soft-delete: loops and those that fold into another."""
    n = views.nodes(spark, sf_dir)
    out = U.remapped_edges(_near_edges(spark, sf_dir, n), _groups(spark, sf_dir, n))
    return out.filter("deleted").select(*SCOPE, "graph_edge_no", "source_node_no", "target_node_no", "description")


def _aliases(spark, sf_dir):
    """Names of losers as aliases of their winners."""
    n = views.nodes(spark, sf_dir).select(*SCOPE, F.col("graph_node_no").alias("b"), "name").filter("name is not null")
    wanted = views.merge_pairs(spark, sf_dir).join(n, [*SCOPE, "b"]).select(*SCOPE, F.col("a").alias("canonical_node_no"), F.col("name").alias("alias"), F.lit("merge").alias("source"))
    return U.added_aliases(wanted.limit(0), wanted)


@query
def alias_owner(spark, sf_dir):
    return _aliases(spark, sf_dir)


@query
def alias_lookup(spark, sf_dir):
    n = views.nodes(spark, sf_dir)
    wanted = live(n).select(F.col("graph_node_no").alias("wanted")).distinct()
    out = U.alias_of(n, _aliases(spark, sf_dir), wanted)
    return out.select("wanted", *SCOPE, "graph_node_no", F.array_join("aliases", "|").alias("aliases"))


@query
def low_support_prune(spark, sf_dir):
    n = views.nodes(spark, sf_dir)
    return U.low_support(n, views.edges(spark, sf_dir, n), min_support=Settings.prune_min_support).select(*SCOPE, "graph_node_no", R.support(F.col("ref")).alias("support"))


def _undone(spark, sf_dir):
    """(tables before, tables after merging all groups and undoing every merge)."""
    scratch = Scratch(spark, "undone")
    n = scratch.write(views.nodes(spark, sf_dir))
    d = views.domain(n)
    typed = L.with_domain(n.drop("class"), d)
    e = _near_edges(spark, sf_dir, n)
    own = live(n).filter("name is not null").groupBy(*SCOPE, F.concat(F.lit("~"), "name").alias("alias")).agg(F.min("graph_node_no").alias("canonical_node_no"))
    a = own.select(*SCOPE, "canonical_node_no", "alias", F.lit("import").alias("source"))
    m = U.apply_merges(typed, e, d, a, _groups(spark, sf_dir, n), batch="b")
    log, nodes, edges = scratch.write(m.log), scratch.write(m.nodes), scratch.write(m.edges)
    return m, U.undo_merges(nodes, edges, m.domain, m.aliases, log, scratch.write(m.images), log.select("merge_id"))


def _ref_text(ref):
    """References as text, documents and tokens in order."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(ref), lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.array_sort(e["value"]), ",")))), ";")


@query
def rollback_nodes(spark, sf_dir):
    """Node rows once all merges are made and undone: as they were."""
    out = _undone(spark, sf_dir)[1].nodes
    return out.select(*SCOPE, "graph_node_no", "name", "description", "properties", _ref_text(F.col("ref")).alias("refs"), F.coalesce("deleted", F.lit(False)).alias("deleted"))


@query
def rollback_edges(spark, sf_dir):
    """Edge rows once all merges are made and undone: as they were."""
    out = _undone(spark, sf_dir)[1].edges
    return out.select(*SCOPE, "graph_edge_no", "source_node_no", "target_node_no", "name", "description", "properties", _ref_text(F.col("ref")).alias("refs"), "deleted")


@query
def rollback_aliases(spark, sf_dir):
    """Aliases once all merges are made and undone: those there were before."""
    return _undone(spark, sf_dir)[1].aliases.select(*SCOPE, "canonical_node_no", "alias", "source")


@query
def rollback_domain(spark, sf_dir):
    """Domain rows once all merges are made and undone, with how many were soft-deleted in between, a scope."""
    m, back = _undone(spark, sf_dir)
    lost = m.domain.filter("deleted").groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("lost"))
    return back.domain.groupBy(*SCOPE, "type").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("deleted").alias("deleted")).join(lost, SCOPE, "left").withColumn("lost", F.coalesce("lost", F.lit(0)))


# --- versions -----------------------------------------------------------------------------------------------------


def _changes(spark, sf_dir):
    """Newest against second newest snapshot of every graph."""
    d = views.docs(spark, sf_dir)
    place = d.select(*SCOPE).distinct().withColumn("place", F.row_number().over(Window.partitionBy("graph_no").orderBy(F.desc("graph_version"))))
    d = d.join(place, SCOPE)
    return V.classify(d.filter("place = 1").select("graph_no", "doc_no", "sha256"), d.filter("place = 2").select("graph_no", "doc_no", "sha256"), by=["graph_no"])


@query
def classify_versions(spark, sf_dir):
    return _changes(spark, sf_dir)


@query
def project_nodes(spark, sf_dir):
    unchanged = _changes(spark, sf_dir).filter("change = 'unchanged'")
    n = live(views.nodes(spark, sf_dir))
    return V.surviving_refs(n, unchanged, "graph_node_no").select("graph_no", "graph_node_no", F.array_join(F.array_sort(F.map_keys("ref")), "|").alias("docs"))


@query
def project_edges(spark, sf_dir):
    unchanged = _changes(spark, sf_dir).filter("change = 'unchanged'")
    n = views.nodes(spark, sf_dir)
    e = views.edges(spark, sf_dir, n)
    kept = V.surviving_refs(live(n), unchanged, "graph_node_no").select("graph_no", "graph_node_no")
    for end in ("source_node_no", "target_node_no"):
        e = e.join(kept.withColumnRenamed("graph_node_no", end), ["graph_no", end], "left_semi")
    return V.surviving_refs(e, unchanged, "graph_edge_no").select("graph_no", "graph_edge_no", R.support(F.col("ref")).alias("support"))


@query
def project_index(spark, sf_dir):
    """Chunk entries of the index that unchanged documents keep."""
    unchanged = _changes(spark, sf_dir).filter("change = 'unchanged'").select("graph_no", "doc_no")
    chunks = table(spark, sf_dir, "kg_doc_chunk").join(unchanged, ["graph_no", "doc_no"], "left_semi").select("graph_no", F.col("chunk_no").alias("object_no")).distinct()
    i = views.index(spark, sf_dir).filter("object_type = 'DOC_CHUNK'")
    return i.join(chunks, ["graph_no", "object_no"], "left_semi").select("graph_no", (F.col("graph_version") + 1).alias("graph_version"), "object_no", F.size("embedding").alias("dim"))


def _registry(spark, sf_dir):
    v = table(spark, sf_dir, "kg_doc").select(*SCOPE).distinct()
    last = F.max("graph_version").over(Window.partitionBy("graph_no"))
    status = F.when(F.col("graph_version") == last, F.when(F.col("graph_version") % 2 == 0, "BUILDING").otherwise("ACTIVE")).when(F.col("graph_version") == last - 1, "ACTIVE").otherwise("FROZEN")
    return v.select(*SCOPE, F.concat(F.lit("graph at "), F.col("graph_version").cast("string")).alias("name"), status.alias("status"), F.lit(True).alias("projection_done"))


@query
def latest_active(spark, sf_dir):
    return L.latest_version(_registry(spark, sf_dir))


@query
def list_graphs(spark, sf_dir):
    return L.list_graphs(_registry(spark, sf_dir)).select("graph_no", "graph_version", "name", "status")


# --- tasks and state over events ----------------------------------------------------------------------------------


def _tasks(spark, sf_dir):
    """Tasks from events: one an event, the user as graph, the type as status."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp_ntz"))
    kinds = F.row_number().over(Window.orderBy("event_type"))
    names = e.select("event_type").distinct().withColumn("k", kinds)
    e = e.join(names, "event_type")
    status = F.element_at(F.array(*[F.lit(s) for s in ("QUEUED", "RUNNING", "FAILED", "SUCCEEDED", "QUEUED")]), (F.col("k") - 1).cast("int") % 5 + 1)
    return e.select(
        F.col("event_id").cast("string").alias("task_no"), F.lit("INGEST").alias("task_type"), F.col("user_id").cast("string").alias("graph_no"), status.alias("status"), "props", F.col("at").alias("available_at"), F.col("at").alias("create_time"),
        F.when(F.col("event_id") % 3 != 0, F.col("at") + F.expr("interval 900 seconds")).alias("lease_expires_at"), (F.col("event_id") % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), F.lit("w").alias("worker_id"), F.lit(None).cast("string").alias("error"),
        F.when(status.isin("QUEUED", "RUNNING"), F.col("user_id").cast("string")).alias("active_key"),
    )


@query
def task_progress(spark, sf_dir):
    s = _tasks(spark, sf_dir).select(F.col("graph_no").alias("run_no"), F.when(F.col("status") == "QUEUED", "SKIPPED").otherwise(F.col("status")).alias("status"))
    return T.progress(s)


@query
def task_claim(spark, sf_dir):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    out = T.claim(_tasks(spark, sf_dir), now, "worker-1", count=25)
    return out.filter("worker_id = 'worker-1'").select("task_no", "status", "attempts", "lease_expires_at")


@query
def lease_recovery(spark, sf_dir):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return T.recover_expired(_tasks(spark, sf_dir), now).groupBy("graph_no", "status").agg(F.count(F.lit(1)).alias("tasks"), F.count("active_key").alias("active"), F.count("error").alias("errors"))


@query
def task_queue_order(spark, sf_dir):
    return T.due_order(_tasks(spark, sf_dir)).select("graph_no", "task_no", "place")


@query
def task_retry(spark, sf_dir):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    t = _tasks(spark, sf_dir).withColumn("active_key", F.when(F.col("graph_no").cast("bigint") % 2 == 0, F.col("active_key")))
    return T.retry(t, t.select("task_no"), now).groupBy("graph_no", "status").agg(F.count(F.lit(1)).alias("tasks"))


NOW = "2024-01-20 00:00:00"


@query
def task_enqueue(spark, sf_dir):
    """Every graph asks for a task; one that has an active one gets that named."""
    t = _tasks(spark, sf_dir)
    first = F.row_number().over(Window.partitionBy("active_key").orderBy(F.col("task_no").cast("bigint")))
    t = t.withColumn("active_key", F.when(F.col("active_key").isNotNull() & (first == 1), F.col("active_key")))
    t = t.withColumns({"payload": F.col("props"), "progress_current": F.lit(0), "progress_total": F.lit(0)}).select(*SCHEMAS["task"].fieldNames())
    asked = t.select("graph_no").distinct().select("graph_no", F.concat(F.lit("new-"), "graph_no").alias("task_no"), F.lit("{}").alias("payload"))
    return T.enqueue(t, asked, F.lit(NOW).cast("timestamp_ntz"))[1]


@query
def task_finish(spark, sf_dir):
    """Running tasks end, those without a lease with an error."""
    t = _tasks(spark, sf_dir)
    outcome = t.filter("status = 'RUNNING'").select("task_no", F.when(F.col("lease_expires_at").isNull(), "boom").alias("error"))
    out = T.finish(t, outcome, F.lit(NOW).cast("timestamp_ntz"))
    return out.select("task_no", "status", "error", F.col("active_key").isNotNull().alias("active"), F.col("lease_expires_at").isNotNull().alias("leased"))


def _steps(spark, sf_dir):
    t = _tasks(spark, sf_dir)
    status = F.when(F.col("status") == "QUEUED", T.PENDING).otherwise(F.col("status"))
    none = F.lit(None).cast("timestamp_ntz")
    return t.select(F.col("task_no").alias("step_no"), F.col("graph_no").alias("run_no"), F.col("task_no").alias("step_key"), status.alias("status"), "attempts", "max_attempts", "error", none.alias("started_at"), none.alias("finished_at"))


@query
def step_plan(spark, sf_dir):
    """Each run wants its steps that are done or run, and a new one."""
    s = _steps(spark, sf_dir)
    wanted = s.filter("status in ('SUCCEEDED', 'RUNNING')").select("run_no", "step_key")
    wanted = wanted.unionByName(s.select("run_no", F.lit("new").alias("step_key")).distinct())
    return T.plan_steps(s, wanted).select("run_no", "step_key", "status", "attempts")


@query
def step_checkpoint(spark, sf_dir):
    """Pending steps start, running ones succeed, failed ones fail again, what is done is skipped and stays done."""
    s = _steps(spark, sf_dir)
    event = F.when(F.col("status") == "PENDING", "started").when(F.col("status") == "RUNNING", "succeeded").when(F.col("status") == "FAILED", "failed").otherwise("skipped")
    out = T.checkpoint(s, s.select("run_no", "step_key", event.alias("event"), F.lit("again").alias("error")), F.lit(NOW).cast("timestamp_ntz"))
    return out.select("run_no", "step_key", "status", "attempts", "error", F.col("finished_at").isNotNull().alias("finished"))


def _state(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp_ntz"))
    key = B.key_of(F.lit("g"), F.lit(1), F.col("user_id").cast("string"))
    return e.select(key.alias("state_key"), F.get_json_object("props", "$.k").alias("node_no"), F.col("at"))


@query
def state_ttl(spark, sf_dir):
    s = _state(spark, sf_dir).groupBy("state_key", "node_no").agg(F.max("at").alias("last_access"))
    now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return B.totals(B.unexpired(s, now, ttl_seconds=4 * 3600.0))


@query
def state_lru(spark, sf_dir):
    s = _state(spark, sf_dir).groupBy("state_key", "node_no").agg(F.max("at").alias("last_access"))
    return B.totals(B.evict(s, capacity=20))


@query
def state_running(spark, sf_dir):
    return B.running_totals(_state(spark, sf_dir))


@query
def stream_windows(spark, sf_dir):
    return N.windowed(table(spark, sf_dir, "events"))


@query
def stream_sessions(spark, sf_dir):
    return N.sessions(table(spark, sf_dir, "events"), gap="6 hours")


# --- code graphs --------------------------------------------------------------------------------------------------


def _packages(spark, sf_dir):
    folder = F.regexp_extract(F.col("doc_no"), r"^(.*)/[^/]+$", 1)
    return table(spark, sf_dir, "documents").filter("doc_no not like 'url:%'").select(F.when(folder == "", ".").otherwise(folder).alias("package")).distinct()


@query
def code_hierarchy(spark, sf_dir):
    return C.package_hierarchy(_packages(spark, sf_dir))[1]


@query
def code_topo_levels(spark, sf_dir):
    packages, edges = C.package_hierarchy(_packages(spark, sf_dir))
    return C.dependency_levels(packages, edges)


@query
def code_degree(spark, sf_dir):
    """Degrees of all nodes of the trade graph."""
    e = views.trade_edges(spark, sf_dir)
    nodes = e.select(F.explode(F.array("source", "target")).alias("id"))
    return C.degrees(nodes, e)


# --- the trade graph at size --------------------------------------------------------------------------------------


@query
def trade_two_hops(spark, sf_dir):
    """Parts by nation of their suppliers: two hops over the trade graph, aggregated before the second join."""
    e = views.trade_edges(spark, sf_dir)
    supplies = e.filter("name = 'supplies'").select("source", F.col("target").alias("part"))
    based = e.filter("name = 'based_in' and source like 'supplier:%'").select("source", F.col("target").alias("nation"))
    return supplies.join(based, "source").groupBy("nation").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("part").alias("parts"))
