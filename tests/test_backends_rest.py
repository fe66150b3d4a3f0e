import json
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from quillgraph import rest
from quillgraph.model import SCHEMAS, Settings, ontology_block
from quillgraph.operators import codegraph as C
from quillgraph.operators import extract as E
from quillgraph.operators.index import escape_tag, index_backend
from quillgraph.plugins import WakeUp, batched_embedder, embed_text
from quillgraph.service import Service

ENTRY = SCHEMAS["search_index"]


def entries(spark, *rows):
    return spark.createDataFrame([(g, v, kind, no, text, embed_text(text, 8) if vector else None) for g, v, kind, no, text, vector in rows], ENTRY)


@pytest.mark.parametrize("name", ["table", "packed"])
def test_index_backends(spark, tmp_path, name):
    index = index_backend(name, spark, str(tmp_path))
    assert index is index_backend(name, spark, str(tmp_path))
    assert index.upsert(entries(spark)) == 0
    rows = [("g", 1, "NODE", "a:1", "Ada Lovelace", True), ("g", 1, "NODE", "b", "Grace Hopper", True), ("g", 2, "NODE", "c", "Ada Byron", True), ("h", 1, "DOC_CHUNK", "d", "Ada elsewhere", False)]
    assert index.upsert(entries(spark, *rows)) == 4
    assert index.upsert(entries(spark, ("g", 1, "NODE", "b", "Grace Murray", True))) == 1
    assert {(r["object_no"], r["searchable_text"]) for r in index.entries().collect()} == {("a:1", "Ada Lovelace"), ("b", "Grace Murray"), ("c", "Ada Byron"), ("d", "Ada elsewhere")}
    q = spark.createDataFrame([("q", "g", 1, "Ada", embed_text("Ada", 8))], "query_no string, graph_no string, graph_version bigint, text string, embedding array<double>")
    assert index.search(q, limit=5).orderBy("rank").first()["object_no"] == "a:1"
    assert {r["object_no"] for r in index.search(q, limit=5, scoped=False).collect()} >= {"a:1", "c", "d"}
    assert index.copy_version(spark.createDataFrame([("g", "NODE", "a:1"), ("g", "NODE", "none")], "graph_no string, object_type string, object_no string"), source=1, target=2) == 1
    index.delete_objects(entries(spark, ("g", 1, "NODE", "a:1", "", False)))
    assert index.entries().filter("object_no = 'a:1'").select("graph_version").collect() == [(2,)]
    index.delete_by_filter(F.col("graph_no") == "h")
    assert index.entries().filter("graph_no = 'h'").count() == 0 and index.postings().filter("graph_no = 'h'").count() == 0 and index.entries().count() == 3
    if name == "packed":
        with pytest.raises(ValueError):
            index.upsert(spark.createDataFrame([("g", 1, "NODE", "x", "t", [1.0])], ENTRY))


def test_unknown_backend_and_tags(spark, tmp_path):
    with pytest.raises(ValueError):
        index_backend("none", spark, str(tmp_path))
    df = spark.createDataFrame([("a:b-c d_é\\",), (None,)], "t string")
    assert [r[0] for r in df.select(escape_tag(F.col("t"))).collect()] == ["a\\:b\\-c\\ d_é\\\\", None]


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("served")
    s = Service(spark, str(root / "store"), fetcher=lambda url: "" if "empty" in url else "<html><body><nav>menu</nav><p>Ada met Grace.</p></body></html>")
    return s, root


def test_requests(served):
    s, root = served
    status, made = rest.handle(s, "POST", "/graphs", body={"name": "x"})
    g = made["graph_no"]
    assert status == 201 and [r["graph_no"] for r in rest.handle(s, "GET", "/graphs")[1]] == [g]
    assert rest.handle(s, "POST", "/graphs") == (400, {"detail": "missing: name"})
    assert rest.handle(s, "GET", "/nowhere")[0] == 404 and rest.handle(s, "PUT", "/graphs")[0] == 405 and rest.handle(s, "GET", "/tasks/none")[0] == 404
    with pytest.raises(ValueError):
        s.ingest_urls(g, ["https://a.example/empty"], str(root / "pages"))
    assert s.ingest_urls(g, ["https://a.example/p?q=1", "# no", "https://a.example/empty"], str(root / "pages")) == {"added": 1, "failed": 1}
    assert rest.handle(s, "GET", f"/graphs/{g}/files")[1][0]["doc_no"] == "url:a.example/p"
    status, task = rest.handle(s, "POST", f"/graphs/{g}/ingest", body={"max_attempts": 2})
    assert status == 202 and s.hints.wait(0)
    assert s.run_worker() == 1
    status, seen = rest.handle(s, "GET", f"/tasks/{task['task_no']}")
    assert (status, seen["status"], seen["run_status"], [(x["step_key"], x["status"]) for x in seen["steps"]]) == (200, "SUCCEEDED", "SUCCEEDED", [("url:a.example/p", "SUCCEEDED")])
    assert rest.handle(s, "POST", f"/tasks/{task['task_no']}/retry")[0] == 400
    assert rest.handle(s, "GET", f"/graphs/{g}/entities", {"name": "ada"})[1][0]["name"] == "Ada"
    server = threading.Thread(target=rest.serve, args=(s, "127.0.0.1", 18765), kwargs={"requests": 1})
    server.start()
    for _ in range(50):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:18765/graphs/{g}/snapshot?limit=5", timeout=120) as r:
                assert {n["name"] for n in json.load(r)["nodes"]} == {"Ada", "Grace"}
            break
        except ConnectionRefusedError:
            threading.Event().wait(0.1)
    server.join()


def test_failed_builds_leave_failed_steps(spark, tmp_path):
    def broken(_):
        raise RuntimeError("no model")

    (tmp_path / "a.md").write_text("Ada met Grace.\n")
    s = Service(spark, str(tmp_path / "s"), extractor=broken, settings=Settings(retry_delay_seconds=0))
    g = s.create_graph("x")
    s.add_file(g, str(tmp_path / "a.md"))
    task = s.enqueue_ingest(g, max_attempts=1)["task_no"]
    assert s.run_worker(max_tasks=1) == 1
    seen = s.task_status(task)
    assert (seen["status"], seen["run_status"], seen["steps"][0]["status"]) == ("FAILED", "FAILED", "FAILED") and "no model" in seen["error"]
    assert s.retry_task(task) and s.task_status(task)["steps"][0]["status"] == "PENDING"


def test_code_ingest(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "core").mkdir(parents=True)
    (repo / "core" / "a.py").write_text('def run(x):\n    """Does it."""\n    return x\n')
    (repo / "main.py").write_text("from core import a\n\n\nclass Main:\n    def go(self):\n        pass\n")
    s = Service(spark, str(tmp_path / "s"))
    g = s.create_graph("code")
    report = s.ingest_code(g, str(repo), version=1, dry_run=True)
    assert report["repo_id"] == "repo" and report["symbols"] == 3 and s.store.read("graph_node").count() == 0
    assert s.ingest_code(g, str(repo), version=1, languages=["python"]) == report
    names = {r["name"] for r in s.store.read("graph_node").collect()}
    assert {"run", "Main", "Main.go"} <= names and s.store.read("search_index").filter("object_type = 'NODE'").count() == len(names)
    symbols, packages, edges = C.read_code_graph(spark, f"{tmp_path}/s/code/{g}/repo")
    assert symbols.count() == 3 and {r[0] for r in packages.collect()} == {".", "core"} and edges.filter("kind = 'IMPORT'").count() == 1
    with pytest.raises(ValueError):
        s.ingest_code(g, str(repo), languages=["cobol"])


def test_prompts_embedders_and_hints(spark, tmp_path):
    asked = []

    def model(prompt):
        asked.append(prompt)
        return iter(['{"nodes": [', None, '{"name": "A"}]}'])

    assert E.extract_span(["A"], 1, E.prompted(model, "PLAN")) == ([{"name": "A"}], [], [])
    assert ontology_block() in asked[0] and "[1] A" in asked[0]
    sizes = []

    def many(texts):
        assert len(texts) <= 2
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(i, "x" * i if i else None) for i in range(5)], "i int, t string").coalesce(1)
    got = {r["i"]: r["v"] for r in df.select("i", batched_embedder(many, 2)(F.col("t")).alias("v")).collect()}
    assert got == {0: None, 1: [1.0], 2: [2.0], 3: [3.0], 4: [4.0]} and sizes == []
    hints = WakeUp(spark, str(tmp_path))
    assert not hints.wait(0)
    hints.send()
    assert hints.wait(5) and not hints.wait(0)
