import json
from dataclasses import fields

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.keys import edge_no
from quillgraph.model import SCHEMAS
from quillgraph.operators import extract as E
from quillgraph.operators import fusion as U
from quillgraph.operators import lookup as L
from quillgraph.operators import store as W
from quillgraph.operators import versions as V
from quillgraph.session import Scratch

G = ("g", 1)
GROUPS = "graph_no string, graph_version bigint, graph_node_no string, winner_node_no string"


def nodes(spark, *rows):
    return spark.createDataFrame([(*G, no, name, "ENTITY", desc, props, ref, deleted) for no, name, desc, props, ref, deleted in rows], SCHEMAS["graph_node"])


def edges(spark, *rows):
    out = spark.createDataFrame([(*G, "", a, b, label, None, props, ref, False) for a, label, b, props, ref in rows], SCHEMAS["graph_edge"])
    return out.withColumn("graph_edge_no", edge_no(F.col("source_node_no"), F.col("name"), F.col("target_node_no")))


@pytest.fixture()
def people(spark):
    return nodes(
        spark, ("Person:ada", "Ada", "mathematician", '{"office": "o"}', {"d1": ["1"]}, False), ("Person:ada-lovelace", "Ada Lovelace", "the first programmer, a mathematician", '{"born": 1815, "office": "z"}', {"d2": ["3"]}, False),
        ("Document:notes", "Notes", None, "{}", {"d1": ["2"]}, False),
    )


def test_merge_and_rollback(spark, people):
    groups = spark.createDataFrame([(*G, "Person:ada", "Person:ada"), (*G, "Person:ada-lovelace", "Person:ada")], GROUPS)
    names = spark.createDataFrame([(*G, "Person:ada", "Ada Lovelace")], "graph_no string, graph_version bigint, winner_node_no string, canonical_name string")
    typed = L.with_domain(people, spark.createDataFrame([], SCHEMAS["domain_entity"]))
    log = U.merge_log_rows(typed, groups)
    merged = U.merged_nodes(people, groups, names=names)
    w = {r["graph_node_no"]: r for r in merged.collect()}
    assert w["Person:ada"]["name"] == "Ada Lovelace" and w["Person:ada"]["description"].startswith("the first")
    assert json.loads(w["Person:ada"]["properties"]) == {"office": "o", "born": 1815}
    assert w["Person:ada"]["ref"] == {"d1": ["1"], "d2": ["3"]} and w["Person:ada-lovelace"]["deleted"] and not w["Document:notes"]["deleted"]
    none = [spark.createDataFrame([], SCHEMAS[n]) for n in ("graph_edge", "domain_entity", "entity_alias", "merge_edge")]
    u = U.undo_merges(merged, *none[:3], log, none[3], log.select("merge_id"))
    assert sorted(map(str, u.nodes.collect())) == sorted(map(str, people.collect()))
    assert [r["status"] for r in u.log.collect()] == ["ROLLED_BACK"]
    assert U.not_reversible(u.log, log.select("merge_id")).count() == 1 and U.not_reversible(log, log.select("merge_id")).count() == 0
    assert U.not_reversible(log, log.select("merge_id"), people.filter("graph_node_no <> 'Person:ada'")).count() == 1


def _cut(spark, m):
    """The tables written, so that plans over them stay short."""
    scratch = Scratch(spark, "cut")
    return U.Fused(*[scratch.write(getattr(m, f.name)) for f in fields(m)])


def _rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_merges_keep_what_they_do_not_touch_and_come_undone_one_by_one(spark):
    n = nodes(spark, *[(k, k.upper(), f"the {k}", f'{{"{k}":1}}', {f"d{k}": ["1"]}, False) for k in "abcxyz"])
    e = edges(
        spark, ("a", "owns", "x", '{"p":1}', {"d": ["1"]}), ("b", "owns", "x", '{"p":2,"q":3}', {"d": ["2"]}), ("c", "owns", "x", "{}", {"e": ["5"]}), ("c", "near", "y", "{}", {}), ("a", "knows", "b", "{}", {}),
        ("b", "knows", "c", "{}", {"k": ["1"]}), ("x", "near", "y", "{}", {}), ("a", "near", "z", "{}", {}),
    ).withColumn("description", F.concat(F.lit("says "), "source_node_no"))
    dead = e.filter("source_node_no = 'a' and name = 'near'").withColumns({"deleted": F.lit(True), "target_node_no": F.lit("y"), "graph_edge_no": edge_no(F.lit("a"), F.lit("near"), F.lit("y"))})
    e = e.unionByName(dead)
    d = spark.createDataFrame([(*G, k, k, "Asset", "Artifact", "{}", False) for k in "abc"], SCHEMAS["domain_entity"])
    a = spark.createDataFrame([(*G, "a", "Old", "import"), (*G, "z", "C", "import")], SCHEMAS["entity_alias"])
    groups = spark.createDataFrame([(*G, k, "a") for k in "abc"], GROUPS)
    m = U.apply_merges(L.with_domain(n, d), e, d, a, groups, batch="b1")
    m = _cut(spark, m)
    now = {(r["source_node_no"], r["name"], r["target_node_no"]): r for r in live_rows(m.edges)}
    assert set(now) == {("a", "owns", "x"), ("a", "near", "y"), ("x", "near", "y"), ("a", "near", "z")}
    assert now["a", "owns", "x"]["description"] == "says a" and now["x", "near", "y"]["description"] == "says x" and now["a", "near", "y"]["description"] == "says c"
    assert json.loads(now["a", "owns", "x"]["properties"]) == {"p": 1, "q": 3} and now["a", "owns", "x"]["ref"] == {"d": ["1", "2"], "e": ["5"]}
    assert m.edges.count() == e.count() - 1  # the dead edge gave way to the one that took its key
    assert {r["graph_node_no"] for r in m.domain.filter("deleted").collect()} == {"b", "c"}
    assert {(r["canonical_node_no"], r["alias"]) for r in m.aliases.collect()} == {("a", "Old"), ("z", "C"), ("a", "B")}
    # undo one of the two: the other stays in force
    first = m.log.filter("loser_node_no = 'c'").select("merge_id")
    u = _cut(spark, U.undo_merges(m.nodes, m.edges, m.domain, m.aliases, m.log, m.images, first))
    only = U.apply_merges(L.with_domain(n, d), e, d, a, groups.filter("graph_node_no <> 'c'"), batch="b1")
    assert _rows(u.nodes) == _rows(only.nodes) and _rows(u.edges) == _rows(only.edges) and _rows(u.domain) == _rows(only.domain) and _rows(u.aliases) == _rows(only.aliases)
    # and the other one, too: everything as it was
    v = _cut(spark, U.undo_merges(u.nodes, u.edges, u.domain, u.aliases, u.log, u.images, m.log.filter("loser_node_no = 'b'").select("merge_id")))
    assert _rows(v.nodes) == _rows(n) and _rows(v.edges) == _rows(e) and _rows(v.domain) == _rows(d) and _rows(v.aliases) == _rows(a)
    assert {r["status"] for r in v.log.collect()} == {"ROLLED_BACK"}


def test_what_was_written_to_a_moved_edge_since_the_merge_stays(spark):
    n = nodes(spark, *[(k, k, None, "{}", {}, False) for k in "abx"])
    e = edges(spark, ("b", "owns", "x", "{}", {"d": ["1"]}))
    none = [spark.createDataFrame([], SCHEMAS[t]) for t in ("domain_entity", "entity_alias")]
    m = U.apply_merges(L.with_domain(n, none[0]), e, *none, spark.createDataFrame([(*G, "a", "a"), (*G, "b", "a")], GROUPS), batch="b")
    later = m.edges.withColumn("properties", F.lit('{"new":1}'))
    u = U.undo_merges(m.nodes, later, m.domain, m.aliases, m.log, m.images, m.log.select("merge_id"))
    (row,) = u.edges.collect()
    assert (row["source_node_no"], row["properties"], row["graph_edge_no"]) == ("b", '{"new":1}', e.first()["graph_edge_no"])


def test_edges_under_adaptive_execution_and_code_generation(shipped):
    test_edges_move_fold_and_lose_loops(shipped)
    test_components_of_chains(shipped)


def test_pruning_comes_undone(spark):
    n = nodes(spark, ("orphan", "o", "text", '{"p":1}', {"d1": ["1"]}, False), ("kept", "p", None, "{}", {"d1": ["1"], "d2": ["1"]}, False))
    none = {t: spark.createDataFrame([], SCHEMAS[t]) for t in ("graph_edge", "domain_entity", "entity_alias", "merge_edge")}
    d = spark.createDataFrame([(*G, "orphan", "o", "Event", None, "{}", True)], SCHEMAS["domain_entity"])
    after, log = U.pruned(n, U.low_support(n, none["graph_edge"]))
    u = U.undo_merges(after, none["graph_edge"], d, none["entity_alias"], log, none["merge_edge"], log.select("merge_id"))
    assert _rows(u.nodes) == _rows(n) and not u.domain.first()["deleted"]


def live_rows(df):
    return df.filter("not deleted").collect()


def test_edges_move_fold_and_lose_loops(spark):
    e = edges(spark, ("a", "authored", "n", '{"confidence":"EXTRACTED"}', {"d": ["1"]}), ("b", "authored", "n", "{}", {"d": ["9"]}), ("a", "knows", "b", "{}", {}), ("b", "cites", "m", "{}", {"x": ["1"]}))
    groups = spark.createDataFrame([(*G, "a", "a"), (*G, "b", "a")], GROUPS)
    got = {(r["source_node_no"], r["name"], r["target_node_no"]): r for r in live_rows(U.remapped_edges(e, groups))}
    assert set(got) == {("a", "authored", "n"), ("a", "cites", "m")}
    assert got["a", "authored", "n"]["ref"] == {"d": ["1", "9"]} and got["a", "authored", "n"]["folded"] == 1
    assert json.loads(got["a", "authored", "n"]["properties"]) == {"confidence": "EXTRACTED"}


def test_prune_spares_linked_and_supported(spark):
    n = nodes(spark, ("orphan", "o", None, "{}", {"d1": ["1"]}, False), ("popular", "p", None, "{}", {"d1": ["1"], "d2": ["1"]}, False), ("linked", "l", None, "{}", {"d1": ["1"]}, False), ("target", "t", None, "{}", {"d1": ["1"], "d2": ["2"]}, False))
    doomed = U.low_support(n, edges(spark, ("linked", "x", "target", "{}", {})))
    after, log = U.pruned(n, doomed)
    assert {r["graph_node_no"] for r in after.filter("deleted").collect()} == {"orphan"}
    assert [(r["loser_node_no"], r["status"]) for r in log.collect()] == [("orphan", "PRUNED")]
    assert n.filter("deleted").count() == 0


def test_aliases_have_one_owner(spark):
    schema = SCHEMAS["entity_alias"]
    old = spark.createDataFrame([(*G, "x", "Ada", "merge")], schema)
    new = spark.createDataFrame([(*G, "y", "Ada", "merge"), (*G, "z", "Al", "merge"), (*G, "y", "Al", "merge"), (*G, "y", " ", "merge")], schema)
    assert [(r["canonical_node_no"], r["alias"]) for r in U.added_aliases(old, new).collect()] == [("y", "Al")]


def test_components_of_chains(spark):
    n = 23
    pairs = spark.createDataFrame([(*G, f"k{i:02d}", f"k{i + 1:02d}") for i in range(n)] + [(*G, "z1", "z0")], "graph_no string, graph_version bigint, a string, b string")
    got = {r["graph_node_no"]: r["winner_node_no"] for r in U.fusion_components(pairs).collect()}
    assert set(got.values()) == {"k00", "z0"} and len(got) == n + 3


def test_candidates_over_common_bigrams_are_those_of_all_pairs(spark):
    names = [f"{a} {b}" for a in ("Anna", "Hanna", "Joanna", "Annabel") for b in ("Berg", "Berger", "Sandberg", "Iceberg")]
    n = nodes(spark, *[(f"P:{i:02d}", name, None, "{}", {}, False) for i, name in enumerate(names)]).withColumn("class", F.lit("P"))
    grams = [{x.lower()[i : i + 2] for i in range(len(x) - 1)} for x in names]
    for limit, common in ((3, 3), (10, 5), (20, 1)):
        want = {}
        for i, a in enumerate(grams):
            scores = sorted((-round(len(a & b) / len(a | b), 6), f"P:{j:02d}") for j, b in enumerate(grams) if j != i and len(a & b) >= 2)
            want[f"P:{i:02d}"] = [(k, -x) for x, k in scores[:limit]]
        got = {}
        for r in U.fusion_candidates(n, limit=limit, common=common).orderBy("graph_node_no", "rank").collect():
            got.setdefault(r["graph_node_no"], []).append((r["candidate_no"], r["score"]))
        assert got == want


def test_candidates_send_names_and_no_pairs(spark, monkeypatch):
    def by_last_word(_kind, names):
        groups = {}
        for name in names:
            groups.setdefault(name.split()[-1], []).append(name)
        return [g for g in groups.values() if len(g) > 1]

    names = [f"{a} {b}" for a in ("Anna", "Hanna", "Joanna", "Annabel") for b in ("Berg", "Berger", "Sandberg", "Iceberg")] + ["", "x", "Åsa 李小龙", "x" * 300 + " Berg"]
    n = nodes(spark, *[(f"P:{i:02d}", name, None, "{}", {}, False) for i, name in enumerate(names)]).withColumn("class", F.lit("P"))
    grams = [{x.lower()[i : i + 2] for i in range(len(x) - 1)} for x in names]
    pairs = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(grams) for j, b in enumerate(grams) if j != i and len(a & b) >= 2}
    want = {(f"P:{i:02d}", f"P:{j:02d}") for i in range(len(names)) for j in sorted((j for k, j in pairs if k == i), key=lambda j: (-round(pairs[i, j], 6), j))[:4]}
    tied = {tuple(r) for r in U.candidate_clusters(n, by_last_word, limit=4).select("a", "b").collect()}
    for ask, offer in ((8192, 131_072), (5, 7)):  # in one cell, and in parts
        monkeypatch.setattr(U, "ASK_ROWS", ask)
        monkeypatch.setattr(U, "OFFER_ROWS", offer)
        found = U.fusion_candidates(n, limit=4)
        assert {(r["graph_node_no"], r["candidate_no"]) for r in found.collect()} == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "gram" not in plan and "Join" not in plan.split("FlatMapGroupsInPandas")[0]
        assert {tuple(r) for r in U.candidate_clusters(n, by_last_word, limit=4).select("a", "b").collect()} == tied
        assert {tuple(r) for r in U.cluster(found, n, by_last_word).select("a", "b").collect()} == tied


def test_clusters_use_given_names_only(spark):
    n = nodes(spark, *[(f"P:{i}", name, None, "{}", {}, False) for i, name in enumerate(["Ada Lovelace", "ada-lovelace", "Grace Hopper"])]).withColumn("class", F.lit("P"))
    c = U.fusion_candidates(n, min_shared=1)
    assert [(r["a"], r["b"]) for r in U.cluster(c, n).collect()] == [("P:0", "P:1")]
    assert U.cluster(c, n, lambda kind, names: [["Ada Lovelace", "invented"]]).count() == 0
    assert U.cluster(c, n, lambda kind, names: 1 / 0).count() == 0


def test_node_upsert_folds_the_batch_and_leaves_deleted_rows(spark):
    old = nodes(spark, ("a", "A", "old", '{"x":"1"}', {"d": ["1"]}, False), ("gone", "G", "g", "{}", {}, True))
    batch = spark.createDataFrame([(*G, "a", "A2", "ENTITY", "", '{"x":"2","y":3}', {"d": ["2"]}, 1), (*G, "a", "A3", "ENTITY", "newer", '{"y":4}', {"e": ["1"]}, 2), (*G, "gone", "G", "ENTITY", "z", "{}", {}, 3), (*G, "n", "N", "ENTITY", None, "{}", {}, 4)], "graph_no string, graph_version bigint, graph_node_no string, name string, type string, description string, properties string, ref map<string,array<string>>, seq int")
    got = {r["graph_node_no"]: r for r in W.upsert_nodes(old, W.fold_batch(batch, ["graph_no", "graph_version", "graph_node_no"])).collect()}
    a = got["a"]
    assert a["name"] == "A" and a["description"] == "newer" and json.loads(a["properties"]) == {"x": "2", "y": 4} and a["ref"] == {"d": ["1", "2"], "e": ["1"]}
    assert got["gone"]["deleted"] and got["gone"]["description"] == "g" and got["n"]["name"] == "N"


def test_edges_bind_to_the_last_node_of_a_name(spark):
    names = spark.createDataFrame([("d", "A", "k1", 1), ("d", "A", "k2", 2), ("d", "B", "k3", 1)], "doc_id string, name string, graph_node_no string, seq int")
    e = spark.createDataFrame([("d", "A", "x", "B"), ("d", "A", "x", "missing")], "doc_id string, source_name string, label string, target_name string")
    assert [(r["source_node_no"], r["target_node_no"]) for r in W.bind_edges(e, names).collect()] == [("k2", "k3")]


def test_validation(spark):
    n = spark.createDataFrame([("d", "A", "Asset", "Solution"), ("d", "B", "Event", "Solution"), ("d", "C", "Nope", None), ("d", "D", "Asset", None), ("d", " ", "Event", None)], "doc_id string, name string, type string, entity_spec string")
    kept, dropped = E.validate_nodes(n)
    assert {(r["name"], r["entity_spec"]) for r in kept.collect()} == {("A", "Solution"), ("B", None)} and dropped.count() == 3
    e = spark.createDataFrame([("d", "A", "x", "B", None), ("d", "A", "x", "Z", None), ("d", "A", "x", "B", "MAYBE")], "doc_id string, source string, label string, target string, confidence string")
    good, bad = E.validate_edges(e, kept)
    assert [r["confidence"] for r in good.collect()] == ["INFERRED"] and {r["reason"] for r in bad.collect()} == {"edge: unknown target", "edge: unknown confidence"}


def test_extraction_halves_spans_that_do_not_parse(spark):
    def moody(numbered):
        if "bad" in numbered and "\n" in numbered:
            return "no json"
        if "bad" in numbered:
            return "still none"
        return E.rule_extractor(numbered)

    d = spark.createDataFrame([("d", "Alpha Beta\nbad\nGamma")], "doc_id string, text string")
    r = E.extract(d, moody).first()
    assert [n["name"] for n in r["nodes"]] == ["Alpha", "Beta", "Gamma"] and r["dropped"] == ["line 2: ValueError"]


def test_classification_and_force(spark):
    m = spark.createDataFrame([("a", "h1"), ("b", "h2n"), ("c", "h3")], "doc_no string, sha256 string")
    b = spark.createDataFrame([("a", "H1"), ("b", "h2o"), ("d", "h4")], "doc_no string, sha256 string")
    assert dict(V.classify(m, b).collect()) == {"a": "unchanged", "b": "changed", "c": "new", "d": "removed"}
    assert dict(V.classify(m, b, force=True).collect())["a"] == "changed" and V.has_changes(V.classify(m, b)) and not V.has_changes(V.classify(m, m))


def test_projection_keeps_what_unchanged_documents_support(spark):
    n = nodes(spark, ("shared", "s", None, "{}", {"d1": ["1"], "d2": ["1"]}, False), ("only1", "o", None, "{}", {"d1": ["1"]}, False), ("only2", "p", None, "{}", {"d2": ["1"]}, False))
    e = edges(spark, ("only1", "x", "shared", "{}", {"d1": ["1"]}), ("only2", "x", "shared", "{}", {"d2": ["1"]}))
    d = spark.createDataFrame([(*G, "only1", "o", "Asset", "Solution", "{}", False)], SCHEMAS["domain_entity"])
    a = spark.createDataFrame([(*G, "shared", "共享", "merge")], SCHEMAS["entity_alias"])
    c = spark.createDataFrame([(*G, x, f"c-{x}", 0, "t", "", "", 1, 1, "h") for x in ("d1", "d2")], SCHEMAS["doc_chunk"])
    i = spark.createDataFrame([(*G, "NODE", "shared", "t", [0.1, 0.2]), (*G, "NODE", "only2", "t", [0.3]), (*G, "DOC_CHUNK", "c-d1", "t", [0.4])], SCHEMAS["search_index"])
    p = V.project(n, e, d, a, c, i, spark.createDataFrame([("g", "d1")], "graph_no string, doc_no string"), base=1, target=2)
    assert {r["graph_node_no"]: r["ref"] for r in p.nodes.collect()} == {"shared": {"d1": ["1"]}, "only1": {"d1": ["1"]}}
    assert p.edges.count() == 1 and p.domain.count() == 1 and p.aliases.count() == 1 and {r["graph_version"] for r in p.nodes.collect()} == {2}
    assert {(r["object_no"], tuple(r["embedding"])) for r in p.index.collect()} == {("shared", (0.1, 0.2)), ("c-d1", (0.4,))}


def test_versions_are_resolved(spark):
    def resolve(*registry, docs=()):
        g = spark.createDataFrame([("g", v, "n", s, True) for v, s in registry], SCHEMAS["graph"])
        d = spark.createDataFrame([("g", v) for v in docs], "graph_no string, graph_version bigint")
        return V.resolve_versions(g, d, "g")

    assert resolve() == (None, 1)
    assert resolve((1, "ACTIVE"), docs=[1]) == (1, 2) and resolve((1, "ACTIVE")) == (None, 1)
    assert resolve((1, "ACTIVE"), (2, "BUILDING"), docs=[1]) == (1, 2)
    with pytest.raises(ValueError):
        resolve((1, "BUILDING"), (2, "BUILDING"))
    g = spark.createDataFrame([("g", 1, "first", "ACTIVE", True), ("g", 2, "n", "BUILDING", True)], SCHEMAS["graph"])
    assert L.latest_version(g).first()["graph_version"] == 1
    assert {(r[1], r[3]) for r in V.activate(g, "g", 2).collect()} == {(1, "FROZEN"), (2, "ACTIVE")}
    assert L.list_graphs(g).first()["name"] == "first"
