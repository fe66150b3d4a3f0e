"""Requests mapped to the service: a table of routes, usable from any web server.

``handle`` takes method, path, query parameters and a JSON body and returns status and answer; ``serve`` puts it behind
the standard library's server.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, HTTPServer
from typing import Any
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame

from .service import Service

Route = Callable[[Service, dict[str, str], dict[str, str], dict[str, Any]], tuple[int, Any]]
ROUTES: list[tuple[str, re.Pattern, Route]] = []


def route(method: str, path: str) -> Callable[[Route], Route]:
    """Register a handler of (service, path parts, query parameters, body)."""
    pattern = re.compile("^" + re.sub(r"\{(\w+)\}", r"(?P<\1>[^/]+)", path) + "/?$")

    def add(f: Route) -> Route:
        ROUTES.append((method, pattern, f))
        return f

    return add


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _version(q: dict) -> int | None:
    return int(q["graph_version"]) if q.get("graph_version") is not None else None


@route("POST", "/search")
def _search(s, path, q, body):
    r = s.search(body["query"], body.get("graph_no") or s.settings.graph_no, version=_version(body), state_id=body.get("state_id"), window=body.get("window"))
    answer = {"seeds": _rows(r.seeds), "neighbours": _rows(r.neighbours), "edges": _rows(r.edges), "evidence": _rows(r.evidence), "chunks": _rows(r.chunks)}
    return 200, answer | ({"trace": r.trace} if body.get("trace") else {})


@route("DELETE", "/search/state/{state_id}")
def _forget(s, path, q, body):
    return 200, {"state_id": path["state_id"], "cleared": s.clear_recall_state(q.get("graph_no") or s.settings.graph_no, path["state_id"], _version(q))}


@route("GET", "/graphs/{graph_no}/entities")
def _entities(s, path, q, body):
    return 200, _rows(s.find_entities(q["name"], path["graph_no"], _version(q), int(q.get("limit", 20))))


@route("GET", "/graphs/{graph_no}/entities/{node_no}/relations")
def _relations(s, path, q, body):
    return 200, _rows(s.relations_of(path["node_no"], path["graph_no"], _version(q)))


@route("GET", "/graphs/{graph_no}/snapshot")
def _snapshot(s, path, q, body):
    nodes, edges = s.graph_snapshot(path["graph_no"], _version(q), int(q.get("limit", 2000)))
    return 200, {"nodes": _rows(nodes), "edges": _rows(edges)}


@route("GET", "/graphs")
def _graphs(s, path, q, body):
    return 200, _rows(s.list_graphs())


@route("POST", "/graphs")
def _create(s, path, q, body):
    return 201, {"graph_no": s.create_graph(body["name"])}


@route("GET", "/graphs/{graph_no}/files")
def _files(s, path, q, body):
    return 200, _rows(s.list_files(path["graph_no"]))


@route("POST", "/graphs/{graph_no}/upload")
def _upload(s, path, q, body):
    """Files as {name: text}."""
    return 201, {"added": s.upload_files(path["graph_no"], {n: t.encode() for n, t in body["files"].items()})}


@route("POST", "/graphs/{graph_no}/ingest")
def _ingest(s, path, q, body):
    return 202, s.enqueue_ingest(path["graph_no"], force=bool(body.get("force")), allow_empty=bool(body.get("allow_empty")), max_attempts=int(body.get("max_attempts", 3)))


@route("GET", "/tasks")
def _tasks(s, path, q, body):
    return 200, _rows(s.list_tasks(int(q.get("limit", 20)), q.get("graph_no")))


@route("GET", "/tasks/{task_no}")
def _task(s, path, q, body):
    found = s.task_status(path["task_no"])
    return (200, found) if found else (404, {"detail": f"no such task: {path['task_no']}"})


@route("POST", "/tasks/{task_no}/retry")
def _retry(s, path, q, body):
    if not s.retry_task(path["task_no"], body.get("max_attempts")):
        return 400, {"detail": "only a failed task of a graph without an active one can be retried"}
    return 200, {"task_no": path["task_no"], "status": "QUEUED"}


def handle(service: Service, method: str, path: str, query: dict[str, str] | None = None, body: dict | None = None) -> tuple[int, Any]:
    """(status, answer) of one request: 404 for an unknown path, 405 for another method's, 400 for what the service or a
    missing parameter refuses."""
    known = False
    for m, pattern, f in ROUTES:
        hit = pattern.match(path)
        if not hit:
            continue
        known = True
        if m == method.upper():
            try:
                return f(service, {k: unquote(v) for k, v in hit.groupdict().items()}, query or {}, body or {})
            except KeyError as e:
                return 400, {"detail": f"missing: {e.args[0]}"}
            except ValueError as e:
                return 400, {"detail": str(e)}
    return (405, {"detail": "method not allowed"}) if known else (404, {"detail": "not found"})


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000, *, requests: int | None = None) -> None:
    """Answer requests one by one, at most ``requests`` of them if given."""

    class Handler(BaseHTTPRequestHandler):
        def _run(self) -> None:
            url = urlsplit(self.path)
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size)) if size else {}
                status, answer = handle(service, self.command, url.path, dict(parse_qsl(url.query)), body)
            except json.JSONDecodeError:
                status, answer = 400, {"detail": "the body is no JSON"}
            data = json.dumps(answer, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _run

        def log_message(self, *args) -> None:
            pass

    server = HTTPServer((host, port), Handler)
    if requests is None:
        server.serve_forever()
    for _ in range(requests or 0):
        server.handle_request()
    server.server_close()
