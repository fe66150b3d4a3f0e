"""Service over a store of tables: the operations a user of the graph calls.

The store keeps every table as Parquet under a root all executors share. A write makes a new generation and then moves
the pointer, so readers see the old table or the new one; one writer a store.
"""

from __future__ import annotations

import json
import os
import re
import threading
import uuid
from dataclasses import replace
from datetime import datetime, timezone
from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import content_hash, new_graph_no, new_id, node_no, state_key
from .functions.text import title
from .model import BUILDING, DOC_CHUNK, EDGE, MERGED, NODE, PRUNED, SCHEMAS, SCOPE, GraphScope, Settings, live
from .operators import codegraph as C
from .operators import extract as E
from .operators import fusion as U
from .operators import lookup as L
from .operators import recall as Y
from .operators import search as S
from .operators import store as W
from .operators import versions as V
from .plugins import WakeUp, embed_text, embedder, expand_query
from .session import Scratch, ship
from .sources import files as SF
from .sources import manifest as M
from .streaming import state as B
from .streaming import tasks as T

#: Tables kept scope by scope.
SCOPED = {n for n, t in SCHEMAS.items() if n != "graph" and set(SCOPE) <= set(t.fieldNames())}
_STATE = "state_key string, node_no string, last_access timestamp_ntz"


class Store:
    """Generations of tables under a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _generations(self, name: str) -> list[str]:
        folder = self._path(name)
        if not self._fs.exists(folder):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(n for n in found if self._fs.exists(self._path(f"{name}/{n}/_SUCCESS")))

    def _current(self, name: str) -> str | None:
        return (self._generations(name) or [None])[-1]

    def _scopes(self, name: str) -> list[str]:
        folder = self._path(f"{name}/scopes")
        return sorted(f"{name}/scopes/{x.getPath().getName()}" for x in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    @staticmethod
    def _scope(name: str, graph_no: str, version: int) -> str:
        return f"{name}/scopes/{quote(graph_no, safe='')}@{version}"

    def read(self, name: str, scope: GraphScope | None = None) -> DataFrame:
        """A table, or what it has of one scope, which reads that scope's files only."""
        schema = SCHEMAS.get(name) or _STATE
        if name in SCOPED:
            folders = self._scopes(name) if scope is None else [self._scope(name, scope.graph_no, scope.graph_version)]
        else:
            folders = [name]
        paths = [f"{self.root}/{f}/{at}" for f in folders if (at := self._current(f))]
        df = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return df.filter(scope.where()) if scope is not None and name not in SCOPED else df

    def swap(self, name: str, rows: DataFrame, graph_no: str, version: int) -> None:
        """Rows of one scope replaced; other scopes' files are left alone."""
        self.write(self._scope(name, graph_no, version), rows)

    def write(self, name: str, df: DataFrame) -> None:
        """The generation completed last is the table; two more stay for plans that were made over them."""
        before = self._generations(name)
        old = before[-1] if before else None
        serial = f"{int(old.split('-')[0]) + 1 if old else 1:012d}-{uuid.uuid4().hex[:6]}"
        df.write.parquet(f"{self.root}/{name}/{serial}")
        for stale in before[:-2]:
            self._fs.delete(self._path(f"{name}/{stale}"), True)

    def put(self, name: str, rows: list[dict]) -> None:
        names = SCHEMAS[name].fieldNames()
        self.write(name, self.read(name).unionByName(self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMAS[name])))


class Service:
    """Graph service; a named graph means its latest ACTIVE version unless a version is given."""

    def __init__(self, spark: SparkSession, root: str, *, settings: Settings | None = None, extractor: E.Extractor = E.rule_extractor, clusterer: U.Clusterer = U.slug_clusterer, rewriter=None, fetcher=None, embed_query=None, embed_column=None, dim: int | None = None):
        ship(spark)
        self.spark, self.store, self.settings = spark, Store(spark, root), settings or Settings()
        self.dim = dim or self.settings.embed_dim
        self.extractor, self.clusterer, self.rewriter, self.fetcher = extractor, clusterer, rewriter, fetcher
        self.embed_query, self.embed_column = embed_query or (lambda t: embed_text(t, self.dim)), embed_column or embedder(self.dim)
        self.hints = WakeUp(spark, root)
        self._lock = threading.Lock()
        self.warnings: list[str] = []

    # --- graphs and files

    def create_graph(self, name: str) -> str:
        graph_no = new_graph_no()
        self.store.put("graph", [{"graph_no": graph_no, "graph_version": 0, "name": name, "status": "FROZEN", "projection_done": False}])
        return graph_no

    def list_graphs(self) -> DataFrame:
        return L.list_graphs(self.store.read("graph"))

    def scope(self, graph_no: str, version: int | None = None) -> GraphScope:
        if version is None:
            row = L.latest_version(self.store.read("graph").filter(F.col("graph_no") == graph_no)).first()
            version = row["graph_version"] if row else 1
        return GraphScope(graph_no, version)

    def add_file(self, graph_no: str, path: str) -> int:
        """Register a file or all supported files of a folder; returns how many."""
        paths = [os.path.join(d, f) for d, _, names in os.walk(path) for f in sorted(names)] if os.path.isdir(path) else [path]
        paths = [p for p in paths if p.lower().endswith(SF.SUFFIXES)]
        if not paths:
            raise ValueError(f"no supported file: {path}")
        base = path if os.path.isdir(path) else os.path.dirname(path)
        rows = [(graph_no, os.path.relpath(p, base), os.path.abspath(p), p.rsplit(".", 1)[-1].lower(), "", False) for p in paths]
        self.store.write("graph_file", M.add_files(self.store.read("graph_file"), self.spark.createDataFrame(rows, SCHEMAS["graph_file"]).drop("deleted")))
        return len(rows)

    def remove_file(self, graph_no: str, doc_no: str) -> None:
        gone = self.spark.createDataFrame([(graph_no, doc_no)], "graph_no string, doc_no string")
        self.store.write("graph_file", M.remove_files(self.store.read("graph_file"), gone))

    def list_files(self, graph_no: str) -> DataFrame:
        return M.list_files(self.store.read("graph_file").filter(F.col("graph_no") == graph_no))

    def upload_files(self, graph_no: str, files: dict[str, bytes], folder: str) -> int:
        """Write uploads into a folder and register them; names are reduced to their last part and must stay inside."""
        os.makedirs(folder, exist_ok=True)
        for name, data in files.items():
            base = re.split(r"[\\/]", name)[-1]
            if not base.lower().endswith(SF.SUFFIXES) or base.startswith("."):
                raise ValueError(f"unsupported file: {name}")
            with open(os.path.join(folder, base), "wb") as f:
                f.write(data)
        return self.add_file(graph_no, folder)

    # --- ingest

    def _texts(self, graph_no: str) -> DataFrame:
        manifest = self.list_files(graph_no)
        paths = [r["path"] for r in manifest.select("path").distinct().collect()]
        there = [p for p in paths if os.path.exists(p)]
        files = self.spark.createDataFrame([], "path string, content binary")
        if there:
            files = self.spark.read.format("binaryFile").load(there).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
        docs, warnings = M.load_manifest(manifest, files)
        self.warnings += [f"{r['doc_no']}: {r['warning']}" for r in warnings.collect()]
        return docs

    def build(self, graph_no: str, *, force: bool = False, allow_empty: bool = False, dry_run: bool = False, observer: V.Observer | None = None) -> dict:
        """Derive the next version: unchanged documents are projected, new and changed ones extracted, then it is ACTIVE."""
        scratch, st = Scratch(self.spark, "build"), self.store
        docs = scratch.write(self._texts(graph_no))
        graphs, stored = st.read("graph"), st.read("doc")
        base, target = V.resolve_versions(graphs.filter("graph_version > 0"), stored, graph_no)
        known = stored.filter((F.col("graph_no") == graph_no) & (F.col("graph_version") == (base or 0)))
        changes = scratch.write(V.classify(docs, known, force=force))
        counts = {r[0]: r[1] for r in changes.groupBy("change").count().collect()}
        answer = {"graph_no": graph_no, "base": base, "target": target, **{c: counts.get(c, 0) for c in ("new", "changed", "unchanged", "removed")}}
        if dry_run or (base is not None and not allow_empty and set(counts) <= {"unchanged"}):
            return answer | {"skipped": True}
        name = graphs.filter(F.col("graph_no") == graph_no).agg(F.min_by("name", "graph_version")).first()[0] or graph_no
        if graphs.filter((F.col("graph_no") == graph_no) & (F.col("graph_version") == target)).isEmpty():
            st.put("graph", [{"graph_no": graph_no, "graph_version": target, "name": name, "status": BUILDING, "projection_done": False}])
        unchanged = changes.filter("change = 'unchanged'").select(F.lit(graph_no).alias("graph_no"), "doc_no")
        mine = lambda n: st.read(n, GraphScope(graph_no, base or 0))
        p = V.project(mine("graph_node"), mine("graph_edge"), mine("domain_entity"), mine("entity_alias"), mine("doc_chunk"), mine("search_index"), unchanged, base=base or 0, target=target)
        kept = {n: V.project_docs(mine(n), unchanged, base=base or 0, target=target) for n in ("doc", "doc_line", "doc_chunk")}
        todo = scratch.write(docs.join(V.to_extract(changes).select("doc_no"), "doc_no", "left_semi").withColumn("graph_version", F.lit(target).cast("bigint")))
        observer = observer or V.Observer()
        names = [r["doc_no"] for r in todo.select("doc_no").collect()]
        for n in names:
            observer.started(n)
        found = scratch.write(E.extract(todo.select(F.col("doc_no").alias("doc_id"), "text"), self.extractor))
        nodes, domain, edges, rejected = self._graph_rows(found, graph_no, target)
        all_nodes = scratch.write(W.upsert_nodes(p.nodes, W.fold_batch(nodes, [*SCOPE, "graph_node_no"])))
        all_edges = scratch.write(W.upsert_edges(p.edges, edges))
        new_docs = todo.select(*SCOPE, "doc_no", "path", title(F.col("text"), F.col("doc_no")).alias("title"), "sha256", "source_type", "origin_url")
        new_chunks = W.document_chunks(todo.withColumn("file_path", F.col("path")), size=self.settings.chunk_size, overlap=self.settings.chunk_overlap)
        chunks = scratch.write(kept["doc_chunk"].unionByName(new_chunks, allowMissingColumns=True))
        index = W.index_rows(all_nodes, all_edges, chunks, p.aliases, embed=self.embed_column)
        # the hash of a document is written last, so that a failed build extracts it again
        self._swap("graph_node", all_nodes, graph_no, target)
        self._swap("domain_entity", W.upsert_domain(p.domain, domain), graph_no, target)
        self._swap("graph_edge", all_edges, graph_no, target)
        self._swap("entity_alias", p.aliases, graph_no, target)
        self._swap("doc_line", kept["doc_line"].unionByName(W.document_lines(todo)), graph_no, target)
        self._swap("doc_chunk", chunks, graph_no, target)
        self._swap("search_index", index, graph_no, target)
        self._swap("doc", kept["doc"].unionByName(new_docs), graph_no, target)
        st.write("graph", V.activate(st.read("graph"), graph_no, target))
        for n in names:
            observer.succeeded(n)
        return answer | {"skipped": False, "dropped": (found.agg(F.sum(F.size("dropped"))).first()[0] or 0) + rejected.count()}

    def _graph_rows(self, found: DataFrame, graph_no: str, target: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        scope = [F.lit(graph_no).alias("graph_no"), F.lit(target).cast("bigint").alias("graph_version")]
        raw = found.select("doc_id", F.posexplode("nodes").alias("seq", "n")).select("doc_id", "seq", "n.*")
        valid, bad_nodes = E.validate_nodes(raw)
        valid = valid.withColumn("graph_node_no", node_no(F.col("type"), F.col("entity_spec"), F.col("name")))
        ref = lambda: F.create_map(F.col("doc_id"), F.coalesce("lines", F.array().cast("array<string>")))
        seq = F.struct("doc_id", "seq")
        nodes = valid.select(*scope, "graph_node_no", "name", F.lit("ENTITY").alias("type"), "description", F.lit("{}").alias("properties"), ref().alias("ref"), seq.alias("seq"))
        domain = valid.groupBy("graph_node_no").agg(*[F.min_by(c, seq).alias(c) for c in ("name", "type", "entity_spec")]).select(*scope, "graph_node_no", "name", "type", "entity_spec", F.lit("{}").alias("properties"))
        e = found.select("doc_id", F.explode("edges").alias("e")).select("doc_id", "e.*")
        good, bad_edges = E.validate_edges(e, valid.select("doc_id", "name"))
        bound = W.bind_edges(good.withColumnsRenamed({"source": "source_name", "target": "target_name"}), valid.select("doc_id", "name", "graph_node_no", "seq"))
        bound = bound.select(*scope, "graph_edge_no", "source_node_no", "target_node_no", F.col("label").alias("name"), "description", F.to_json(F.struct("confidence")).alias("properties"), ref().alias("ref"))
        key = [*SCOPE, "graph_edge_no"]
        from .functions.refs import fold_refs

        one = bound.groupBy(*key).agg(*[F.min(c).alias(c) for c in ("source_node_no", "target_node_no", "name", "description", "properties")])
        return nodes, domain, one.join(fold_refs(bound, key), key), bad_nodes.select("reason").unionByName(bad_edges.select("reason"))

    def _swap(self, name: str, rows: DataFrame, graph_no: str, version: int) -> None:
        """Table with the rows of one scope replaced."""
        have = rows.columns
        self.store.swap(name, rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields]), graph_no, version)

    def ingest_urls(self, graph_no: str, urls: list[str], folder: str) -> dict:
        """Pages of addresses by the injected fetcher, their main content written as files and registered; a page that
        fails or is empty is a warning, and if none is left an error."""
        if self.fetcher is None:
            raise ValueError("fetching addresses needs a fetcher")
        asked = self.spark.createDataFrame([(u.strip(),) for u in dict.fromkeys(urls) if u.strip() and not u.strip().startswith("#")], "url string")
        pages = Scratch(self.spark, "pages").write(SF.fetch(asked, self.fetcher))
        os.makedirs(folder, exist_ok=True)
        added = 0
        for r in pages.toLocalIterator():
            if not (r["text"] or "").strip():
                self.warnings.append(f"{r['origin_url']}: {r['error']}")
                continue
            path = os.path.join(folder, content_name(r["doc_no"]))
            with open(path, "w", encoding="utf-8") as f:
                f.write(r["text"])
            row = self.spark.createDataFrame([(graph_no, r["doc_no"], os.path.abspath(path), "url", r["origin_url"], False)], SCHEMAS["graph_file"])
            self.store.write("graph_file", M.add_files(self.store.read("graph_file"), row.drop("deleted")))
            added += 1
        if not added:
            raise ValueError("no page with content")
        return {"added": added, "failed": asked.count() - added}

    def ingest_code(self, graph_no: str, repo: str, *, languages: list[str] | None = None, version: int | None = None, dry_run: bool = False) -> dict:
        """Symbols, packages and imports of a repository projected onto the graph; the code graph itself is kept as JSON
        tables below the store. A dry run only counts. A repository without files of a known language is an error."""
        s, scratch = self.scope(graph_no, version), Scratch(self.spark, "code")
        languages = languages or [x.strip() for x in self.settings.code_langs.split(",") if x.strip()]
        unknown = set(languages) - set(C.SUFFIXES)
        if unknown:
            raise ValueError(f"unknown language: {sorted(unknown)}")
        files = {n: scratch.write(C.scan_repo(self.spark, repo, suffix=C.SUFFIXES[n])) for n in languages}
        files = {n: f for n, f in files.items() if not f.isEmpty()}
        if not files:
            raise ValueError(f"no source files below {repo}")
        union = lambda dfs: reduce(DataFrame.unionByName, dfs)
        symbols = scratch.write(union([C.symbols(f, n) for n, f in files.items()]))
        packages = union([f.select("package") for f in files.values()]).distinct()
        imports = scratch.write(union([C.import_edges(C.raw_imports(f, n), f) for n, f in files.items()]))
        packages, hierarchy = (scratch.write(x) for x in C.package_hierarchy(packages))
        nodes, edges = C.project_symbols(symbols, imports, hierarchy)
        nodes, edges = scratch.write(nodes), scratch.write(edges)
        repo_id = os.path.basename(os.path.normpath(repo))
        report = {"repo_id": repo_id, "files": sum(f.count() for f in files.values()), "symbols": symbols.count(), "packages": packages.count(), "edges": edges.count()}
        if dry_run:
            return report
        root = self.settings.code_cache_dir or f"{self.store.root}/code"
        C.write_code_graph(f"{root}/{graph_no}/{repo_id}", symbols, packages, imports.unionByName(hierarchy))
        scope = [F.lit(s.graph_no).alias("graph_no"), F.lit(s.graph_version).cast("bigint").alias("graph_version")]
        empty_ref = F.create_map().cast("map<string,array<string>>")
        own = nodes.select(*scope, "graph_node_no", "name", F.lit("ENTITY").alias("type"), "description", F.to_json("properties").alias("properties"), empty_ref.alias("ref")).dropDuplicates(["graph_node_no"])
        key = [*SCOPE, "graph_node_no"]
        mine = lambda n: self._mine(n, graph_no, s.graph_version)
        # a node of code that was deleted comes back to life
        old = mine("graph_node").join(own.select(*key, F.lit(True).alias("again")), key, "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)) & F.col("again").isNull()).drop("again")
        all_nodes = scratch.write(W.upsert_nodes(old, own))
        links = edges.select(*scope, "graph_edge_no", "source_node_no", "target_node_no", "name", F.lit(None).cast("string").alias("description"), F.to_json(F.struct("confidence")).alias("properties"), empty_ref.alias("ref"))
        all_edges = scratch.write(W.upsert_edges(mine("graph_edge"), links))
        domain = own.select(*key, "name", F.lit("Asset").alias("type"), F.lit("Implementation").alias("entity_spec"), F.lit("{}").alias("properties"))
        all_domain = scratch.write(W.upsert_domain(mine("domain_entity"), domain))
        index = scratch.write(W.reindexed(mine("search_index"), own.select(F.lit(NODE).alias("object_type"), F.col("graph_node_no").alias("object_no")), nodes=all_nodes, edges=all_edges, aliases=mine("entity_alias"), embed=self.embed_column))
        for name, df in (("graph_node", all_nodes), ("graph_edge", all_edges), ("domain_entity", all_domain), ("search_index", index)):
            self._swap(name, df, s.graph_no, s.graph_version)
        return report

    # --- retrieval

    def _explored(self, key: str | None) -> DataFrame | None:
        if key is None:
            return None
        alive = B.unexpired(self.store.read("state").filter(F.col("state_key") == key), self._now(), ttl_seconds=self.settings.state_ttl_seconds)
        return alive.select(F.lit("q").alias("query_no"), F.col("node_no").alias("object_no"))

    @staticmethod
    def _now():
        return F.lit(datetime.now(timezone.utc).replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")

    def search(self, question: str, graph_no: str, *, version: int | None = None, state_id: str | None = None, window: int | None = None) -> Y.Recall:
        """Recall for one question; with a state id, what it was shown before is left out and what it is shown now kept."""
        scope = self.scope(graph_no, version)
        wordings, warning = expand_query(question, self.rewriter, self.settings.max_queries)
        self.warnings += [warning] if warning else []
        mine = lambda n: self.store.read(n, scope)
        entries, everything = mine("search_index"), self.store.read("search_index")
        rows = [("q", i, scope.graph_no, scope.graph_version, w, self._query_vector(w)) for i, w in enumerate(wordings)]
        q = self.spark.createDataFrame(rows, "query_no string, variant_no int, graph_no string, graph_version bigint, text string, embedding array<double>")
        key = state_key(scope.graph_no, scope.graph_version, state_id) if state_id else None
        out = Y.recall(
            q, entries=entries, index=S.bigram_index(entries), nodes=live(mine("graph_node")), edges=live(mine("graph_edge")), doc_lines=mine("doc_line"), chunks=self.store.read("doc_chunk").withColumn("id", F.lit(0).cast("bigint")),
            settings=self.settings if window is None else replace(self.settings, evidence_window=window), explored=self._explored(key), all_entries=everything, all_index=S.bigram_index(everything.filter(F.col("object_type") == DOC_CHUNK)),
        )
        if key:
            shown = out.seeds.select("object_no").unionByName(out.neighbours.select("object_no")).select(F.lit(key).alias("state_key"), F.col("object_no").alias("node_no"))
            self.store.write("state", B.evict(B.add(self.store.read("state"), shown, self._now()), capacity=self.settings.state_capacity))
        return out

    def _query_vector(self, text: str) -> list[float] | None:
        """Vector of a query; without one, or if the embedder fails, search is by text alone and a warning is kept."""
        try:
            return self.embed_query(text)
        except Exception as e:
            self.warnings.append(f"query embedding: {type(e).__name__}: {e}")
            return None

    def clear_recall_state(self, graph_no: str, state_id: str, version: int | None = None) -> bool:
        s = self.scope(graph_no, version)
        keys = self.spark.createDataFrame([(state_key(s.graph_no, s.graph_version, state_id),)], "state_key string")
        old = self.store.read("state")
        known = not old.join(keys, "state_key", "left_semi").isEmpty()
        if known:
            self.store.write("state", B.clear(old, keys))
        return known

    def _mine(self, name: str, graph_no: str, version: int | None) -> DataFrame:
        return self.store.read(name, self.scope(graph_no, version))

    def find_entities(self, text: str, graph_no: str, version: int | None = None, limit: int = 20) -> DataFrame:
        return L.find_entities(self._mine("graph_node", graph_no, version), self._mine("domain_entity", graph_no, version), text, limit=limit)

    def relations_of(self, node: str, graph_no: str, version: int | None = None) -> DataFrame:
        s = self.scope(graph_no, version)
        wanted = self.spark.createDataFrame([(s.graph_no, s.graph_version, node)], "graph_no string, graph_version bigint, node_no string")
        return L.relations_of(self._mine("graph_edge", graph_no, version), self._mine("graph_node", graph_no, version), wanted)

    def graph_snapshot(self, graph_no: str, version: int | None = None, limit: int = 200) -> tuple[DataFrame, DataFrame]:
        n = L.snapshot_nodes(self._mine("graph_node", graph_no, version), limit=limit)
        return L.with_domain(n, self._mine("domain_entity", graph_no, version)), L.edges_within(self._mine("graph_edge", graph_no, version), n)

    def reindex(self, graph_no: str, version: int | None = None) -> dict:
        s = self.scope(graph_no, version)
        index = W.index_rows(*(self._mine(n, graph_no, s.graph_version) for n in ("graph_node", "graph_edge", "doc_chunk", "entity_alias")), embed=self.embed_column)
        self._swap("search_index", index, s.graph_no, s.graph_version)
        row = W.reindex_counts(self._mine("search_index", graph_no, s.graph_version)).first()
        return row.asDict() if row else {}

    # --- fusion

    def resolve_all(self, graph_no: str, version: int | None = None, *, dry_run: bool = False, prune: bool = False) -> dict:
        """Merge what the clusterer ties together, with an undo log; optionally prune nodes of low support."""
        s, scratch = self.scope(graph_no, version), Scratch(self.spark, "resolve")
        mine = lambda n: self._mine(n, graph_no, s.graph_version)
        domain = scratch.write(mine("domain_entity"))
        nodes = scratch.write(L.with_domain(mine("graph_node"), domain))
        pairs = scratch.write(U.cluster(U.fusion_candidates(nodes, limit=self.settings.candidate_topk, min_shared=1), nodes, self.clusterer))
        groups = scratch.write(U.fusion_components(pairs))
        lost = groups.filter(F.col("graph_node_no") != F.col("winner_node_no")).count()
        if dry_run:
            return {"merged": 0, "pending": lost}
        m = U.apply_merges(nodes, scratch.write(mine("graph_edge")), domain, mine("entity_alias"), groups, batch=new_id("batch"))
        merged, log, doomed = scratch.write(m.nodes), m.log, None
        edges, domain = scratch.write(m.edges), scratch.write(m.domain)
        if prune:
            doomed = scratch.write(L.with_domain(U.low_support(merged, edges, min_support=self.settings.prune_min_support), domain))
            merged, rows = U.pruned(merged, doomed)
            log, domain = log.unionByName(rows), U.domain_deleted(domain, doomed, True)
        new_log = scratch.write(mine("merge_log").unionByName(log.withColumn("snapshot", F.to_json("snapshot"))))
        tables = {"graph_node": merged, "graph_edge": edges, "domain_entity": domain, "entity_alias": m.aliases, "merge_log": new_log, "merge_edge": mine("merge_edge").unionByName(m.images, allowMissingColumns=True)}
        written = {n: scratch.write(df) for n, df in tables.items()}
        for name, df in written.items():
            self._swap(name, df, s.graph_no, s.graph_version)
        self.reindex(graph_no, s.graph_version)
        return {"merged": lost, "pending": 0, "pruned": doomed.count() if doomed is not None else 0}

    def rollback_merge(self, merge_id: str, graph_no: str, version: int | None = None) -> None:
        """Undo one merge or pruning: nodes, edges, aliases and domain rows as they were, and their index rows; an absent
        or undone one, or one whose winner is itself merged, is an error."""
        s, scratch = self.scope(graph_no, version), Scratch(self.spark, "rollback")
        mine = lambda n: self._mine(n, graph_no, s.graph_version)
        log, nodes, edges = mine("merge_log"), mine("graph_node"), mine("graph_edge")
        asked = self.spark.createDataFrame([(merge_id,)], "merge_id string")
        if not U.not_reversible(log, asked, nodes).isEmpty():
            raise ValueError(f"no merge to undo: {merge_id}")
        typed = scratch.write(log.withColumn("snapshot", F.from_json("snapshot", U.SNAPSHOT)))
        u = U.undo_merges(nodes, edges, mine("domain_entity"), mine("entity_alias"), typed, mine("merge_edge"), asked)
        tables = {"graph_node": u.nodes, "graph_edge": u.edges, "domain_entity": u.domain, "entity_alias": u.aliases, "merge_log": u.log.withColumn("snapshot", F.to_json("snapshot"))}
        written = {n: scratch.write(df) for n, df in tables.items()}
        # what differs from before is indexed anew
        row = typed.filter(F.col("merge_id") == merge_id)
        ends = row.select(F.explode(F.array("winner_node_no", "loser_node_no")).alias("object_no")).withColumn("object_type", F.lit(NODE))
        look = lambda df: df.select(*SCOPE, "graph_edge_no", F.to_json(F.struct("source_node_no", "target_node_no", "properties", "ref", F.coalesce("deleted", F.lit(False)).alias("deleted"))).alias("look"))
        a, b = look(edges), look(written["graph_edge"])
        moved = a.join(b, [*SCOPE, "graph_edge_no", "look"], "left_anti").unionByName(b.join(a, [*SCOPE, "graph_edge_no", "look"], "left_anti"))
        keys = scratch.write(ends.unionByName(moved.select(F.col("graph_edge_no").alias("object_no"), F.lit(EDGE).alias("object_type"))).distinct())
        for name, df in written.items():
            self._swap(name, df, s.graph_no, s.graph_version)
        self.reindex_objects(keys, graph_no, s.graph_version)

    def reindex_objects(self, keys: DataFrame, graph_no: str, version: int | None = None) -> None:
        """Index rows of single nodes and edges (object_type, object_no) written anew; dead ones are removed."""
        s = self.scope(graph_no, version)
        mine = lambda n: self._mine(n, graph_no, s.graph_version)
        new = W.reindexed(mine("search_index"), keys, nodes=mine("graph_node"), edges=mine("graph_edge"), aliases=mine("entity_alias"), embed=self.embed_column)
        self._swap("search_index", Scratch(self.spark, "reindex").write(new), s.graph_no, s.graph_version)

    def alias_of(self, entity: str, graph_no: str, version: int | None = None) -> list[str]:
        wanted = self.spark.createDataFrame([(entity,)], "wanted string")
        row = U.alias_of(self._mine("graph_node", graph_no, version), self._mine("entity_alias", graph_no, version), wanted).first()
        if row is None:
            raise ValueError(f"no such entity: {entity}")
        return list(row["aliases"])

    # --- tasks

    def enqueue_ingest(self, graph_no: str, *, max_attempts: int = 3, force: bool = False, allow_empty: bool = False) -> dict:
        """(task_no, created) of the graph's one active task, made if there is none; workers get a hint."""
        payload = json.dumps({"force": force, "allow_empty": allow_empty})
        asked = self.spark.createDataFrame([(graph_no, new_id("task"), payload)], "graph_no string, task_no string, payload string")
        tasks, answer = T.enqueue(self.store.read("task"), asked, self._now(), max_attempts=max_attempts)
        row = answer.first().asDict()
        if row["created"]:
            self._put_tasks(lambda _: tasks)
            self.hints.send()
        return row

    def _put_tasks(self, change) -> None:
        """The task table after a transition; heartbeats and the worker take turns."""
        with self._lock:
            self.store.write("task", change(self.store.read("task")))

    def task_status(self, task_no: str) -> dict | None:
        """A task with its run and the run's steps."""
        row = self._task_rows(self.store.read("task").filter(F.col("task_no") == task_no)).first()
        return row.asDict(recursive=True) if row else None

    def _task_rows(self, tasks: DataFrame) -> DataFrame:
        return T.task_list(tasks, self.store.read("pipeline_run"), self.store.read("pipeline_step"))

    def list_tasks(self, limit: int = 20, graph_no: str | None = None) -> DataFrame:
        tasks = self.store.read("task")
        tasks = tasks if graph_no is None else tasks.filter(F.col("graph_no") == graph_no)
        return self._task_rows(tasks.orderBy(F.desc("create_time"), "task_no").limit(limit))

    def retry_task(self, task_no: str, max_attempts: int | None = None) -> bool:
        asked = self.spark.createDataFrame([(task_no,)], "task_no string")
        before = self.store.read("task").filter((F.col("task_no") == task_no) & (F.col("status") == T.FAILED))
        if before.isEmpty():
            return False
        self._put_tasks(lambda t: T.retry(t, asked, self._now(), max_attempts=max_attempts))
        done = self.store.read("task").filter((F.col("task_no") == task_no) & (F.col("status") == T.QUEUED)).first() is not None
        if done:
            steps, runs = self.store.read("pipeline_step"), self.store.read("pipeline_run").filter(F.col("task_no") == task_no)
            self.store.write("pipeline_step", T.reopen(steps, runs))
            self.hints.send()
        return done

    def _checkpoint(self, run_no: str, events: DataFrame) -> None:
        self.store.write("pipeline_step", T.checkpoint(self.store.read("pipeline_step"), events.withColumn("run_no", F.lit(run_no)), self._now()))

    def _plan(self, task: dict, force: bool) -> tuple[str, DataFrame]:
        """(run, its documents' changes): the task's run, made on its first attempt, with a step a document to extract."""
        graph_no = task["graph_no"]
        base, target = V.resolve_versions(self.store.read("graph").filter("graph_version > 0"), self.store.read("doc"), graph_no)
        known = self.store.read("doc").filter((F.col("graph_no") == graph_no) & (F.col("graph_version") == (base or 0)))
        changes = Scratch(self.spark, "plan").write(V.classify(self._texts(graph_no), known, force=force))
        runs = self.store.read("pipeline_run")
        row = runs.filter(F.col("task_no") == task["task_no"]).first()
        run_no = row["run_no"] if row else new_id("run")
        steps = T.plan_steps(self.store.read("pipeline_step"), changes.filter("change <> 'removed'").select(F.lit(run_no).alias("run_no"), F.col("doc_no").alias("step_key")), max_attempts=task["max_attempts"])
        self.store.write("pipeline_step", steps)
        mine = self.spark.createDataFrame([(run_no, task["task_no"], graph_no, base, target)], "run_no string, task_no string, graph_no string, base_version bigint, target_version bigint")
        self.store.write("pipeline_run", T.upsert_run(runs, mine, self.store.read("pipeline_step"), T.RUNNING, None, self._now()))
        return run_no, changes

    def _close_run(self, run_no: str, status: str, error: str | None) -> None:
        runs = self.store.read("pipeline_run")
        mine = runs.filter(F.col("run_no") == run_no).select("run_no", "task_no", "graph_no", "base_version", "target_version")
        self.store.write("pipeline_run", T.upsert_run(runs, mine, self.store.read("pipeline_step"), status, error, self._now()))

    def _execute(self, task: dict, worker: str) -> str | None:
        """Run a claimed task; returns its error, if any. While it runs its lease is renewed at a third of its time; each
        document is a step: unchanged ones are skipped, extracted ones succeed or fail with the build."""
        if task["status"] != T.RUNNING or task["task_type"] != "INGEST":
            return f"ValueError: not a running ingest task: {task['task_no']}"
        stop = threading.Event()

        def beat() -> None:
            while not stop.wait(max(1.0, self.settings.lease_seconds / 3)):
                self._put_tasks(lambda t: T.heartbeat(t, self._now(), worker, lease_seconds=self.settings.lease_seconds))

        thread = threading.Thread(target=beat, daemon=True)
        thread.start()
        run_no, error, events = None, None, None
        try:
            options = json.loads(task["payload"] or "{}")
            run_no, changes = self._plan(task, bool(options.get("force")))
            events = Scratch(self.spark, "steps").write(changes.filter("change <> 'removed'").select(F.col("doc_no").alias("step_key"), F.col("change") == "unchanged"))
            same = events.columns[1]
            busy = events.filter(~F.col(same)).select("step_key")
            note = lambda df, event, why=None: df.select("step_key", F.lit(event).alias("event"), F.lit(why).cast("string").alias("error"))
            self._checkpoint(run_no, note(busy, "started").unionByName(note(events.filter(F.col(same)).select("step_key"), "skipped")))
            self.build(task["graph_no"], force=bool(options.get("force")), allow_empty=bool(options.get("allow_empty")))
            self._checkpoint(run_no, note(busy, "succeeded"))
        except Exception as e:
            error = f"{type(e).__name__}: {e}"[:8000]
            if events is not None:
                self._checkpoint(run_no, note(busy, "failed", error))
        finally:
            stop.set()
            thread.join()
        if run_no:
            left = task["attempts"] < task["max_attempts"]
            self._close_run(run_no, T.SUCCEEDED if error is None else T.RETRYING if left else T.FAILED, error)
        return error

    def run_worker(self, worker: str = "worker", max_tasks: int | None = None, *, wait_seconds: float = 0.0) -> int:
        """Recover expired leases, then claim and run due tasks one by one until none is left, after waiting
        ``wait_seconds`` for a hint; returns how many ran."""
        done = 0
        while max_tasks is None or done < max_tasks:
            now = self._now()
            due = self.store.read("task").filter((F.col("status") == T.RUNNING) | ((F.col("status") == T.QUEUED) & (F.col("available_at") <= now)))
            if not due.isEmpty():
                self._put_tasks(lambda t: T.claim(T.recover_expired(t, now), now, worker, lease_seconds=self.settings.lease_seconds))
            row = self.store.read("task").filter((F.col("status") == T.RUNNING) & (F.col("worker_id") == worker)).first()
            if row is None:
                if wait_seconds > 0 and self.hints.wait(wait_seconds):
                    continue
                break
            error = self._execute(row.asDict(), worker)
            outcome = self.spark.createDataFrame([(row["task_no"], error)], "task_no string, error string")
            self._put_tasks(lambda t: T.finish(t, outcome, self._now(), retry_delay=self.settings.retry_delay_seconds))
            done += 1
        return done


def content_name(doc_no: str) -> str:
    """File name of a page's text."""
    return re.sub(r"[^\w.-]+", "_", doc_no)[-80:] + "-" + uuid.uuid5(uuid.NAMESPACE_URL, doc_no).hex[:8] + ".md"


__all__ = ["MERGED", "PRUNED", "Service", "Store", "content_hash"]
