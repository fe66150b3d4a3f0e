from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillgraph.model import SCHEMAS, Settings, init_store
from quillgraph.operators import codegraph as C
from quillgraph.sources import files as S
from quillgraph.sources import manifest as M
from quillgraph.streaming import events as N
from quillgraph.streaming import state as B
from quillgraph.streaming import tasks as T

NOW = datetime(2024, 1, 1, 12)
now = None


@pytest.fixture(autouse=True)
def _now(spark):
    global now
    now = F.lit(NOW.isoformat(sep=" ")).cast("timestamp_ntz")


def tasks(spark, *rows):
    base = {"task_type": "INGEST", "payload": "{}", "progress_current": 0, "progress_total": 0, "attempts": 0, "max_attempts": 3, "available_at": NOW, "create_time": NOW, "lease_expires_at": None, "worker_id": "", "error": None, "active_key": None}
    names = SCHEMAS["task"].fieldNames()
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], SCHEMAS["task"])


def test_one_active_task_a_graph(spark):
    asked = spark.createDataFrame([("g", "t1", "{}")], "graph_no string, task_no string, payload string")
    t, answer = T.enqueue(tasks(spark), asked, now)
    assert answer.first()["created"]
    t2, again = T.enqueue(t, asked.withColumn("task_no", F.lit("t2")), now)
    r = again.first()
    assert not r["created"] and r["task_no"] == "t1" and t2.count() == 1


def test_claim_finish_retry_and_recover(spark):
    t = tasks(spark, {"task_no": "a", "graph_no": "g", "status": "QUEUED", "active_key": "g", "max_attempts": 2})
    t = T.claim(t, now, "w")
    r = t.first()
    assert (r["status"], r["attempts"], r["lease_expires_at"]) == ("RUNNING", 1, NOW + timedelta(seconds=900))
    failed = spark.createDataFrame([("a", "boom")], "task_no string, error string")
    once = T.finish(t, failed, now)
    r = once.first()
    assert (r["status"], r["active_key"], r["available_at"]) == ("QUEUED", "g", NOW + timedelta(seconds=5))
    twice = T.finish(T.claim(once, now + F.expr("interval 6 seconds"), "w"), failed, now)
    r = twice.first()
    assert (r["status"], r["active_key"]) == ("FAILED", None)
    r = T.retry(twice, failed, now, max_attempts=2).first()
    assert (r["status"], r["attempts"], r["active_key"]) == ("QUEUED", 0, "g")
    ok = T.finish(t, spark.createDataFrame([("a", None)], "task_no string, error string"), now).first()
    assert (ok["status"], ok["active_key"]) == ("SUCCEEDED", None)
    lost = tasks(spark, {"task_no": "a", "graph_no": "g", "status": "RUNNING", "attempts": 1, "lease_expires_at": NOW - timedelta(seconds=1)}, {"task_no": "b", "graph_no": "h", "status": "RUNNING", "attempts": 3}, {"task_no": "c", "graph_no": "i", "status": "RUNNING", "attempts": 3, "lease_expires_at": NOW + timedelta(seconds=1)})
    assert {r["task_no"]: (r["status"], r["active_key"]) for r in T.recover_expired(lost, now).collect()} == {"a": ("QUEUED", "g"), "b": ("FAILED", None), "c": ("RUNNING", None)}


def test_steps(spark):
    steps = T.plan_steps(spark.createDataFrame([], SCHEMAS["pipeline_step"]), spark.createDataFrame([("r", "d1"), ("r", "d2")], "run_no string, step_key string"))
    e = lambda *x: spark.createDataFrame([("r", *y, None) for y in x], "run_no string, step_key string, event string, error string")
    steps = T.checkpoint(steps, e(("d1", "started"), ("d1", "succeeded"), ("d2", "started"), ("d2", "failed")), now)
    assert {r["step_key"]: (r["status"], r["attempts"]) for r in steps.collect()} == {"d1": ("SUCCEEDED", 1), "d2": ("FAILED", 1)}
    steps = T.checkpoint(steps, e(("d1", "skipped"), ("d2", "succeeded")), now)
    r = T.progress(steps).first()
    assert (r["total"], r["completed"], r["failed"]) == (2, 2, 0)
    replanned = T.plan_steps(steps, spark.createDataFrame([("r", "d3")], "run_no string, step_key string"))
    assert {r["step_key"]: r["status"] for r in replanned.collect()} == {"d1": "SUCCEEDED", "d2": "SUCCEEDED", "d3": "PENDING"}


def test_explored_state(spark):
    empty = spark.createDataFrame([], "state_key string, node_no string, last_access timestamp_ntz")
    s = B.add(empty, spark.createDataFrame([("g:1:s", "a"), ("g:1:s", "b")], "state_key string, node_no string"), now)
    s = B.add(s, spark.createDataFrame([("g:1:s", "b"), ("g:1:s", "c"), ("g:1:s", ""), ("g:2:s", "x")], "state_key string, node_no string"), now + F.expr("interval 1 second"))
    assert {r["state_key"]: r["nodes"] for r in B.totals(s).collect()} == {"g:1:s": 3, "g:2:s": 1}
    assert B.unexpired(s, now + F.expr("interval 1 hour"), ttl_seconds=1800).count() == 0 and B.unexpired(s, now + F.expr("interval 1801 seconds"), ttl_seconds=1800).count() == 4
    more = B.add(s, spark.createDataFrame([("g:3:s", "y")], "state_key string, node_no string"), now + F.expr("interval 9 seconds"))
    assert {r["state_key"] for r in B.evict(more, capacity=1).collect()} == {"g:3:s"}
    assert B.clear(s, s.select("state_key").filter("state_key = 'g:1:s'")).count() == 1


def test_windows_run_as_batch_and_as_stream(spark, tmp_path):
    rows = [(1, NOW, "a", 1.0), (1, NOW + timedelta(minutes=5), "a", 2.0), (2, NOW + timedelta(days=2), "b", 3.0)]
    df = spark.createDataFrame(rows, "user_id bigint, ts timestamp_ntz, event_type string, value double")
    df.write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in N.windowed(df).collect()}
    stream = N.windowed(N.event_stream(spark, str(tmp_path / "in"), df.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("windows").collect()} == batch
    assert {(r["user_id"], r["events"]) for r in N.sessions(df).collect()} == {(1, 2), (2, 1)}


PY = '"""Doc."""\nimport os\n\n\ndef top(a, b=1):\n    """Adds."""\n    return a\n\n\nclass Widget:\n    """W."""\n\n    def render(self):\n        def inner():\n            pass\n        return 1\n'
GO = 'package svc\n\nimport (\n\t"fmt"\n\t"example/m/store"\n)\n\n// Server serves.\ntype Server struct {\n\tx int\n}\n\ntype Runner interface {\n\tRun()\n}\n\ntype Name string\n\n// Start begins.\nfunc (s *Server) Start() error {\n\treturn nil\n}\n\nfunc Free() {}\n'


def test_symbols(spark):
    files = spark.createDataFrame([("p/m.py", "p", PY), ("p/bad.py", "p", "def (:")], "path string, package string, content string")
    got = {r["name"]: r for r in C.symbols(files, "python").collect()}
    assert {n: r["kind"] for n, r in got.items()} == {"top": "FUNCTION", "Widget": "STRUCT", "Widget.render": "METHOD", "inner": "FUNCTION"}
    assert got["top"]["line"] == 5 and got["top"]["signature"] == "def top(a, b=1)" and got["top"]["doc"] == "Adds."
    go = spark.createDataFrame([("svc/h.go", "svc", GO)], "path string, package string, content string")
    got = {r["name"]: r for r in C.symbols(go, "go").collect()}
    assert {n: r["kind"] for n, r in got.items()} == {"Server": "STRUCT", "Runner": "INTERFACE", "Name": "TYPE_ALIAS", "Server.Start": "METHOD", "Free": "FUNCTION"}
    assert got["Server.Start"]["doc"] == "// Start begins." and got["Server.Start"]["signature"] == "func (s *Server) Start() error"
    packages = spark.createDataFrame([("svc",), ("store",)], "package string")
    assert [tuple(r) for r in C.import_edges(C.raw_imports(go, "go"), packages, module_prefix="example/m").collect()] == [("svc", "IMPORT", "store")]


def test_hierarchy_order_and_degrees(spark):
    packages = spark.createDataFrame([("app/a",), ("app/b",), (".",)], "package string")
    full, hier = C.package_hierarchy(packages)
    assert {r[0] for r in full.collect()} == {"app/a", "app/b", ".", "app"}
    assert {tuple(r) for r in hier.collect()} == {("repo", "SUBPACKAGE", "."), ("app", "SUBPACKAGE", "app/a"), ("app", "SUBPACKAGE", "app/b"), ("repo", "CONTAINS", "app"), ("repo", "SUBPACKAGE", "app")}
    imports = spark.createDataFrame([("app/b", "IMPORT", "app/a")], "source string, kind string, target string")
    level = {r["package"]: r["level"] for r in C.dependency_levels(full, hier.unionByName(imports)).collect()}
    assert level["app/a"] < level["app/b"] < level["app"]
    cyclic = spark.createDataFrame([("x", "IMPORT", "y"), ("y", "IMPORT", "x")], "source string, kind string, target string")
    assert {r["level"] for r in C.dependency_levels(spark.createDataFrame([("x",), ("y",)], "package string"), cyclic).collect()} == {None}
    d = {r["id"]: (r["in_degree"], r["out_degree"]) for r in C.degrees(spark.createDataFrame([("x",), ("y",), ("z",)], "id string"), cyclic).collect()}
    assert d == {"x": (1, 1), "y": (1, 1), "z": (0, 0)}


def test_code_projection(spark):
    go = spark.createDataFrame([("svc/h.go", "svc", GO)], "path string, package string, content string")
    packages = spark.createDataFrame([("svc",), ("store",)], "package string")
    imports = C.import_edges(C.raw_imports(go, "go"), packages, module_prefix="example/m")
    n, e = C.project_symbols(C.symbols(go, "go"), imports, C.package_hierarchy(packages)[1])
    assert all(r["graph_node_no"].startswith("Asset:Implementation:") for r in n.collect())
    assert {r["name"] for r in e.collect()} == {"imports", "contains"} and {r["confidence"] for r in e.collect()} == {"EXTRACTED"}


def test_repo_and_directory_scans(spark, tmp_path):
    for path, text in {"p/a.go": "package p", "p/a_test.go": "package p", ".git/x.go": "x", "vendor/v.go": "x", "m.go": "package m", "docs/a.md": "# T\nx", "docs/b.txt": "  ", "docs/c.html": "<p>hi</p>", "docs/d.bin": "x"}.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    got = {(r["path"], r["package"]) for r in C.scan_repo(spark, str(tmp_path), suffix=".go").collect()}
    assert got == {("p/a.go", "p"), ("m.go", ".")}
    docs = {r["doc_no"]: (r["title"], r["text"]) for r in S.scan_directory(spark, str(tmp_path / "docs")).collect()}
    assert docs == {"a.md": ("T", "# T\nx"), "c.html": ("hi", "hi")}
    with pytest.raises(Exception, match="unsupported"):
        S.load_documents(spark.createDataFrame([("a.exe", bytearray(b"x"))], "path string, content binary")).collect()
    bad = S.load_documents(spark.createDataFrame([("a.txt", bytearray(b"a\xffb"))], "path string, content binary")).first()
    assert bad["text"] == "a�b"


def test_manifest_and_fetch(spark):
    m = spark.createDataFrame([], SCHEMAS["graph_file"])
    f = spark.createDataFrame([("g", "a.md", "/r/a.md", "md", ""), ("g", "b.md", "/r/b.md", "md", "")], "graph_no string, doc_no string, path string, source_type string, origin_url string")
    m = M.add_files(m, f)
    m = M.remove_files(m, f.filter("doc_no = 'a.md'"))
    assert [r["doc_no"] for r in M.list_files(m).collect()] == ["b.md"]
    m = M.add_files(m, f.filter("doc_no = 'a.md'").withColumn("path", F.lit("/s/a.md")))
    assert {r["path"] for r in M.list_files(m).collect()} == {"/s/a.md", "/r/b.md"}
    docs, warnings = M.load_manifest(m, spark.createDataFrame([("/s/a.md", bytearray(b"x"))], "path string, content binary"))
    assert [r["doc_no"] for r in docs.collect()] == ["a.md"] and [(r["doc_no"], r["warning"]) for r in warnings.collect()] == [("b.md", "unreadable")]
    urls = spark.createDataFrame([("https://e.example/a?x",), ("https://e.example/b",)], "url string")
    got = {r["doc_no"]: (r["text"], r["error"]) for r in S.fetch(urls, lambda u: "<p>hi</p>" if "a" in u.rsplit("/", 1)[1] else "").collect()}
    assert got == {"url:e.example/a": ("hi", None), "url:e.example/b": (None, "no content")}


def test_store_and_settings(spark, tmp_path, monkeypatch):
    assert len(init_store(spark, str(tmp_path))) == len(SCHEMAS) and init_store(spark, str(tmp_path)) == []
    monkeypatch.setenv("QUILLGRAPH_TOPK", "9")
    assert Settings.from_env().topk == 9 and Settings().topk == 5
