import random

import pytest

from quillgraph.model import SCOPE
from quillgraph.operators import rank as A
from quillgraph.operators import recall as Y
from quillgraph.operators import search as S

LISTS = "q string, list_no int, object_no string, rank int, value double"


def lists(spark, *orders, values=None):
    return spark.createDataFrame([("q", i, o, r, float((values or {}).get((i, o), 0))) for i, order in enumerate(orders) for r, o in enumerate(order, 1)], LISTS)


def order(df, key="object_no"):
    return [r[key] for r in sorted(df.collect(), key=lambda r: r["rank"])]


def test_fusion_of_lists(spark):
    assert order(A.reciprocal_rank_fusion(lists(spark, "abc", "bca"), by=["q"]))[0] == "b"
    assert order(A.reciprocal_rank_fusion(lists(spark, "cab"), by=["q"])) == ["c", "a", "b"]
    twice = A.reciprocal_rank_fusion(lists(spark, "aba"), by=["q"]).collect()
    assert {r["object_no"]: round(r["score"], 9) for r in twice}["a"] == round(1 / 61 + 1 / 63, 9)
    assert order(A.reciprocal_rank_fusion(lists(spark, "abcd"), by=["q"], top_k=2)) == ["a", "b"]


def test_representative_is_the_better_copy(spark):
    from pyspark.sql import functions as F

    df = lists(spark, "xy", "yz", values={(0, "y"): 0.2, (1, "y"): 0.9})
    got = {r["object_no"]: r["value"] for r in A.fuse_objects(df, by=["q"], better=F.col("value"), keep=["value"]).collect()}
    assert got["y"] == 0.9


def test_pool_of_nodes_and_edge_ends(spark):
    nodes = spark.createDataFrame([("q", "n1", 1), ("q", "n2", 2)], "query_no string, object_no string, rank int")
    hits = spark.createDataFrame([("q", "g", 1, "e1", 1), ("q", "g", 1, "e2", 2), ("q", "g", 1, "gone", 3)], "query_no string, graph_no string, graph_version bigint, object_no string, rank int")
    edges = spark.createDataFrame([("g", 1, "e1", "n2", "n3"), ("g", 1, "e2", "n4", "n1"), ("g", 1, "e9", "", "n1")], "graph_no string, graph_version bigint, graph_edge_no string, source_node_no string, target_node_no string")
    assert order(Y.candidate_pool(nodes, hits, edges)) == ["n1", "n2", "n3", "n4"]


def test_restriction_none_and_empty(spark):
    df = lists(spark, "ab")
    assert A.restrict(df, None, ["object_no"]).count() == 2
    assert A.restrict(df, df.limit(0), ["object_no"]).count() == 0


def test_evidence_spans(spark):
    def lines(ref, window):
        df = spark.createDataFrame([("q", ref)], "q string, ref map<string,array<string>>")
        return sorted(r["line_no"] for r in Y.evidence_spans(df, by=["q"], window=window).collect())

    assert lines({"d": ["3", "5-7"]}, 0) == [3, 4, 5, 6, 7]
    assert lines({"d": ["5"]}, 1) == [4, 5, 6] and lines({"d": ["1"]}, 1) == [1, 2]
    assert lines({"d": ["10", "12"]}, 0) == [10, 11, 12] and lines({"d": ["1", "5"]}, 0) == [1, 5]


def model(edges, start, ranking, k, hops, exclude=()):
    """Expansion restated over plain sets."""
    visited, frontier, picked = set(start) | set(exclude), list(start), []
    for _ in range(max(1, hops)):
        found = {}
        for no, a, b in sorted(e for e in edges if e[1] in frontier or e[2] in frontier):
            for side, n in ((0, a), (1, b)):
                if n not in visited:
                    found.setdefault(n, (no, side))
        if not found:
            break
        ordered = sorted(found, key=lambda n: (ranking.index(n) if n in ranking else 10**6, found[n], n))
        picked += ordered
        visited |= set(ordered)
        if len(picked) >= k:
            break
        frontier = ordered
    return picked[:k]


def expanded(spark, edges, start, ranking, k, hops, exclude=()):
    e = spark.createDataFrame([("g", 1, no, a, b, "x", False) for no, a, b in edges], "graph_no string, graph_version bigint, graph_edge_no string, source_node_no string, target_node_no string, name string, deleted boolean")
    s = spark.createDataFrame([("q", "g", 1, n, i) for i, n in enumerate(start, 1)], "query_no string, graph_no string, graph_version bigint, node_no string, rank int")
    r = spark.createDataFrame([("q", n, i) for i, n in enumerate(ranking, 1)], "query_no string, object_no string, rank int")
    x = spark.createDataFrame([("q", n) for n in exclude], "query_no string, object_no string") if exclude else None
    return order(Y.expand(s, e, r, neighbour_k=k, max_hops=hops, exclude=x).neighbours)


CASES = [
    ([("1", "s", "a"), ("2", "s", "b"), ("3", "a", "c"), ("4", "b", "d")], "abcd", 5, 1, (), ["a", "b"]),
    ([("1", "s", "a"), ("2", "a", "b"), ("3", "b", "c")], "abc", 5, 2, (), ["a", "b"]),
    ([("1", "s", "a"), ("2", "s", "b"), ("3", "a", "b")], "ab", 5, 3, (), ["a", "b"]),
    ([("1", "s", "a"), ("2", "s", "b"), ("3", "s", "c"), ("4", "a", "deep")], "abc", 2, 3, (), ["a", "b"]),
    ([("1", "s", "a"), ("2", "s", "b"), ("3", "s", "c")], "abc", 5, 1, ("a",), ["b", "c"]),
]


@pytest.mark.parametrize("edges,ranking,k,hops,exclude,want", CASES)
def test_expansion_cases(spark, edges, ranking, k, hops, exclude, want):
    assert expanded(spark, edges, ["s"], list(ranking), k, hops, exclude) == want == model(edges, ["s"], list(ranking), k, hops, exclude)


def test_expansion_matches_the_model_on_random_graphs(spark):
    for seed in range(3):
        rng = random.Random(seed)
        names = [f"n{i}" for i in range(14)]
        edges = [(f"e{i:02d}", *rng.sample(names, 2)) for i in range(20)]
        ranking = rng.sample(names, 6)
        assert expanded(spark, edges, ["n0", "n1"], ranking, 6, 3) == model(edges, ["n0", "n1"], ranking, 6, 3)


def test_retry_takes_the_strictest_tier_that_suffices(spark):
    rows = [("a", 0, "x", 1), ("a", 1, "x", 1), ("a", 1, "y", 2), ("a", 2, "x", 1), ("b", 2, "z", 1)]
    df = spark.createDataFrame(rows, "query_no string, tier int, object_no string, rank int")
    assert {(r[0], r[1]) for r in Y.retry_tiers(df, min_results=2).select("query_no", "tier").collect()} == {("a", 1), ("b", 2)}
    assert {r["tier"] for r in Y.retry_tiers(df, min_results=0).collect()} == {1}


def test_scope_columns():
    assert SCOPE == ["graph_no", "graph_version"]


def test_questions_meet_all_scopes_without_a_join_of_pairs(spark):
    rows = [(f"g{i % 3}", i % 2, "DOC_CHUNK", f"c{i % 17:02d}", f"text {i % 5} of chunk {i % 7}", [float(i % 4), 1.0, float(i % 3)]) for i in range(60)]
    rows += [("g0", 9, "DOC_CHUNK", "zero", "text", [0.0, 0.0, 0.0]), ("g0", 9, "DOC_CHUNK", "short", "other", [1.0]), ("g0", 9, "DOC_CHUNK", "none", "", None)]
    e = spark.createDataFrame(rows, "graph_no string, graph_version bigint, object_type string, object_no string, searchable_text string, embedding array<double>").dropDuplicates(["graph_no", "graph_version", "object_no"])
    q = spark.createDataFrame([("a", "g0", 0, "text 1", [1.0, 1.0, 0.0]), ("b", "g1", 1, "chunk 3", [0.0, 2.0, 5.0])], "query_no string, graph_no string, graph_version bigint, text string, embedding array<double>")
    index = S.bigram_index(e)
    vector, text = S.vector_channel(e, q, limit=4, scoped=False), S.text_channel(index, e, q, limit=4, scoped=False)
    assert "Join" not in vector._jdf.queryExecution().executedPlan().toString()
    # scores of at least -1 take the way that joins every pair
    pairs = S.vector_channel(e, q, min_score=-1.0, limit=99, scoped=False).filter("score > 0 and rank <= 4")
    assert sorted(map(tuple, vector.collect())) == sorted(map(tuple, pairs.select(vector.columns).collect()))
    pairs = S.text_channel(index, e, q, min_score=-1.0, limit=99, scoped=False).filter("score > 0 and rank <= 4")
    assert sorted(map(tuple, text.collect())) == sorted(map(tuple, pairs.select(text.columns).collect()))
