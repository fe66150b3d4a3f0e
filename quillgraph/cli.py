"""Command line: ``python -m quillgraph.cli --root FOLDER COMMAND ...``."""

from __future__ import annotations

import argparse
import json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillgraph")
    p.add_argument("--root", required=True, help="folder of the store, shared by all executors")
    p.add_argument("--graph-no")
    p.add_argument("--graph-version", type=int)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, **options) -> None:
        c = sub.add_parser(name)
        for a in positional:
            c.add_argument(a)
        for a, kind in options.items():
            flag = "--" + a.replace("_", "-")
            c.add_argument(flag, action="store_true") if kind is bool else c.add_argument(flag, type=kind)

    command("init-db")
    command("create-graph", "name")
    command("list-graphs")
    command("add-file", "path")
    command("remove-file", "doc_no")
    command("list-files")
    command("ingest", force=bool, allow_empty=bool, dry_run=bool)
    command("enqueue-ingest", force=bool, max_attempts=int)
    command("worker", max_tasks=int)
    command("task-status", "task_no")
    command("list-tasks", limit=int)
    command("retry-task", "task_no", max_attempts=int)
    command("query", "name", relations=bool)
    command("ingest-code", "repo", languages=str, dry_run=bool)
    command("ingest-url", "url", folder=str)
    command("serve", host=str, port=int)
    command("search", "question", state_id=str, window=int)
    command("snapshot")
    command("reindex")
    command("node-no", "type", "name", spec=str)
    command("resolve", dry_run=bool, prune=bool)
    command("rollback-merge", "merge_id")
    command("alias-of", "entity")
    return p


def main(argv: list[str] | None = None, spark=None) -> object:
    """Run one command; prints and returns its answer."""
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .functions.keys import node_no
    from .model import Settings, init_store
    from .rest import serve
    from .service import Service
    from .sources.files import download

    spark = spark or SparkSession.builder.appName("quillgraph").getOrCreate()
    s = Service(spark, a.root, settings=Settings.from_env(), fetcher=download)
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    g, v = a.graph_no, a.graph_version
    run = {
        "init-db": lambda: init_store(spark, a.root), "create-graph": lambda: s.create_graph(a.name), "list-graphs": lambda: rows(s.list_graphs()),
        "add-file": lambda: s.add_file(g, a.path), "remove-file": lambda: s.remove_file(g, a.doc_no), "list-files": lambda: rows(s.list_files(g)),
        "ingest-code": lambda: s.ingest_code(g, a.repo, languages=a.languages.split(",") if a.languages else None, version=v, dry_run=a.dry_run), "ingest-url": lambda: s.ingest_urls(g, [a.url], a.folder or s.settings.source_dir),
        "serve": lambda: serve(s, a.host or "127.0.0.1", a.port or 8000), "ingest": lambda: s.build(g, force=a.force, allow_empty=a.allow_empty, dry_run=a.dry_run), "enqueue-ingest": lambda: s.enqueue_ingest(g, force=a.force, max_attempts=a.max_attempts or 3), "worker": lambda: s.run_worker(max_tasks=a.max_tasks),
        "task-status": lambda: s.task_status(a.task_no), "list-tasks": lambda: rows(s.list_tasks(a.limit or 20)), "retry-task": lambda: s.retry_task(a.task_no, a.max_attempts),
        "query": lambda: rows(s.relations_of(a.name, g, v)) if a.relations else rows(s.find_entities(a.name, g, v)),
        "search": lambda: (lambda r: {"seeds": rows(r.seeds), "neighbours": rows(r.neighbours), "edges": rows(r.edges), "evidence": rows(r.evidence), "chunks": rows(r.chunks), "trace": r.trace})(s.search(a.question, g, version=v, state_id=a.state_id, window=a.window)),
        "snapshot": lambda: [rows(x) for x in s.graph_snapshot(g, v)], "reindex": lambda: s.reindex(g, v),
        "node-no": lambda: spark.range(1).select(node_no(F.lit(a.type), F.lit(a.spec) if a.spec else None, F.lit(a.name))).first()[0],
        "resolve": lambda: s.resolve_all(g, v, dry_run=a.dry_run, prune=a.prune), "rollback-merge": lambda: s.rollback_merge(a.merge_id, g, v), "alias-of": lambda: s.alias_of(a.entity, g, v),
    }
    answer = run[a.command]()
    print(json.dumps(answer, ensure_ascii=False, default=str))
    return answer


if __name__ == "__main__":
    main()
