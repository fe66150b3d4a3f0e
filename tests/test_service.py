import pytest

from quillgraph.cli import main
from quillgraph.plugins import embed_text, expand_query
from quillgraph.service import Service


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    docs = tmp_path_factory.mktemp("docs")
    (docs / "a.md").write_text("# Engines\nAda met Babbage near London.\nBabbage built Engine.\n")
    (docs / "b.txt").write_text("Grace wrote Cobol for Univac.\nAda and Grace never met.\n")
    (docs / "blank.txt").write_text(" \n")
    s = Service(spark, str(root))
    g = s.create_graph("history")
    assert s.add_file(g, str(docs)) == 3
    return s, g, docs


def test_build_search_and_next_version(service):
    s, g, docs = service
    first = s.build(g)
    assert (first["target"], first["new"], first["skipped"]) == (1, 2, False)
    assert any("blank" in w for w in s.warnings)
    assert s.build(g)["skipped"]
    names = {r["name"] for r in s.find_entities("ada", g).collect()}
    assert "Ada" in names
    node = s.find_entities("Babbage", g).first()["graph_node_no"]
    assert {r["other_name"] for r in s.relations_of(node, g).collect()} >= {"Ada", "London"}
    r = s.search("Ada Babbage", g, state_id="talk")
    shown = {x["object_no"] for x in r.seeds.collect()}
    assert shown and r.evidence.count() and r.chunks.count() and r.trace
    again = {x["object_no"] for x in s.search("Ada Babbage", g, state_id="talk").seeds.collect()}
    assert not shown & again
    s.clear_recall_state(g, "talk")
    (docs / "b.txt").write_text("Grace wrote Cobol.\n")
    second = s.build(g)
    assert (second["base"], second["target"], second["changed"], second["unchanged"]) == (1, 2, 1, 1)
    status = {(x["graph_version"], x["status"]) for x in s.store.read("graph").filter("graph_version > 0").collect()}
    assert status == {(1, "FROZEN"), (2, "ACTIVE")}
    assert "Univac" not in {x["name"] for x in s.graph_snapshot(g)[0].collect()}


def test_tasks_run_builds(service):
    s, g, docs = service
    (docs / "c.md").write_text("Turing read Hilbert.\n")
    s.add_file(g, str(docs))
    a = s.enqueue_ingest(g)
    assert a["created"] and not s.enqueue_ingest(g)["created"]
    assert s.run_worker() == 1 and s.task_status(a["task_no"])["status"] == "SUCCEEDED"
    assert s.list_tasks().count() == 1 and not s.retry_task(a["task_no"])


def test_resolve_and_rollback(spark, tmp_path):
    docs = tmp_path / "d"
    docs.mkdir()
    (docs / "a.md").write_text("Jean-Luc met Ada.\n")
    (docs / "b.md").write_text("Jeanluc met Grace.\n")
    s = Service(spark, str(tmp_path / "s"))
    g = s.create_graph("x")
    s.add_file(g, str(docs))
    s.build(g)
    assert s.resolve_all(g, dry_run=True) == {"merged": 0, "pending": 1}
    look = lambda: {n: sorted(map(str, s.store.read(n).drop("embedding").collect())) for n in ("graph_node", "graph_edge", "domain_entity", "entity_alias", "search_index")}
    before = look()
    assert s.resolve_all(g)["merged"] == 1
    winner = s.store.read("merge_log").first()
    assert winner["status"] == "MERGED" and s.alias_of(winner["winner_node_no"], g)
    s.rollback_merge(winner["merge_id"], g)
    after = look()
    assert {n: after[n] == before[n] for n in before} == dict.fromkeys(before, True)
    with pytest.raises(ValueError):
        s.rollback_merge(winner["merge_id"], g)


def test_command_line(spark, tmp_path, capsys):
    root = str(tmp_path / "store")
    g = main(["--root", root, "create-graph", "cli"], spark)
    (tmp_path / "x.md").write_text("Ada met Babbage.\n")
    assert main(["--root", root, "--graph-no", g, "add-file", str(tmp_path / "x.md")], spark) == 1
    assert main(["--root", root, "--graph-no", g, "ingest"], spark)["new"] == 1
    assert main(["--root", root, "--graph-no", g, "query", "ada"], spark)[0]["name"] == "Ada"
    assert main(["--root", root, "node-no", "Asset", "Ada Lovelace", "--spec", "Artifact"], spark) == "Asset:Artifact:ada-lovelace"
    assert capsys.readouterr().out.count("\n") == 5


def test_plugins():
    v = embed_text("Grace")
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and not any(embed_text(" "))
    assert expand_query("q", lambda q, n: [" a ", "q", "a", "b", "c"], 3) == (["q", "a", "b"], None)
    assert expand_query("q", lambda q, n: 1 / 0, 3)[0] == ["q"] and expand_query("q", None, 3) == (["q"], None)
