"""Groups from pairwise matches, by contraction of the match graph.

Leaves are stripped, chains of degree-two vertices are compressed by list ranking (pointer doubling over directed
arcs), the reduced core is solved by star hooking, and the removed vertices take their labels back along the parent
pointers kept while contracting.

Skew: edges leave the graph by anti-joins on the edge itself, never on a vertex, so a hub holding a third of all
pairs stays spread over all partitions; degrees come from aggregations with a partial step. The joins that meet a hub
(relabelling in the core and at the end) are ordinary equi-joins that adaptive execution splits when skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch

#: A round that removes a smaller part of the edges than this hands the rest to the core solver.
MIN_SHRINK = 0.1


def _degrees(edges: DataFrame) -> DataFrame:
    arcs = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x"))
    return arcs.groupBy(F.col("x.u").alias("u")).agg(F.count(F.lit(1)).alias("d"), F.min("x.v").alias("lo"), F.max("x.v").alias("hi"))


def _edge(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _strip_leaves(edges: DataFrame, scratch: Scratch, spent: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One pass over degree-one vertices: (remaining edges, parent pointers of the removed)."""
    leaves = _degrees(edges).filter("d = 1").select(*_edge("u", "lo"), "u")
    # A lone edge has two leaves; only its larger end goes.
    gone = scratch.write(leaves.groupBy("a", "b").agg(F.max("u").alias("child")))
    spent.append(gone)
    parents = gone.select("child", F.when(F.col("child") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("parent"))
    return edges.join(gone.select("a", "b"), ["a", "b"], "left_anti"), parents


def _compress_chains(edges: DataFrame, scratch: Scratch, spent: list[DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """Replace every maximal chain of degree-two vertices by one edge between its ends."""
    inner = scratch.write(_degrees(edges).filter("d = 2").select("u", "lo", "hi"))
    spent.append(inner)
    if inner.isEmpty():
        return edges, None
    # Arc (p, c): standing on inner vertex c, come from p. It points at the arc (c, other neighbour).
    arcs = scratch.write(
        inner.select("lo", "hi", "u", F.explode(F.array(F.struct(F.col("lo").alias("p"), F.col("hi").alias("n")), F.struct(F.col("hi").alias("p"), F.col("lo").alias("n")))).alias("x"))
        .select(F.col("x.p").alias("p"), F.col("u").alias("c"), F.col("u").alias("q"), F.col("x.n").alias("n"))
        .join(inner.select(F.col("u").alias("n"), F.lit(True).alias("open")), "n", "left")
        .select("p", "c", "q", "n", F.coalesce("open", F.lit(False)).alias("open"))
    )
    unfinished = arcs.filter("open").count()
    while unfinished:
        ahead = arcs.select(F.col("p").alias("q"), F.col("c").alias("n"), F.col("q").alias("q2"), F.col("n").alias("n2"), F.col("open").alias("open2"))
        done = arcs.filter("not open")
        step = arcs.filter("open").join(ahead, ["q", "n"], "inner").select("p", "c", F.col("q2").alias("q"), F.col("n2").alias("n"), F.col("open2").alias("open"))
        old, arcs = arcs, scratch.write(done.unionByName(step))
        scratch.drop(old)
        left = arcs.filter("open").count()
        if left == unfinished:  # a doubling that ends no arc leaves only closed cycles, which the core solver takes
            break
        unfinished = left
    ends = arcs.filter("not open").groupBy("c").agg(F.min("n").alias("e1"), F.max("n").alias("e2"))
    ends = scratch.write(ends)
    spent.append(ends)
    scratch.drop(arcs)
    removed = inner.join(ends.select(F.col("c").alias("u")), "u", "left_semi")
    cut = removed.select(*_edge("u", "lo")).unionByName(removed.select(*_edge("u", "hi"))).distinct()
    bridges = ends.filter("e1 < e2").select(F.col("e1").alias("a"), F.col("e2").alias("b"))
    rest = edges.join(cut, ["a", "b"], "left_anti").unionByName(bridges).distinct()
    return rest, ends.select(F.col("c").alias("child"), F.col("e1").alias("parent"))


def _solve_core(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(child, parent) stars of the core: alternate large-star and small-star until nothing moves."""
    current, before = edges, None
    while True:
        arcs = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = arcs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = arcs.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # small-star: every vertex and its smaller neighbours hang on the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select("m", F.explode(F.array("a", "b")).alias("x")).filter("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()
        following = scratch.write(small)
        mark = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return following.select(F.col("b").alias("child"), F.col("a").alias("parent"))
        if current is not edges:
            scratch.drop(current)
        current, before = following, mark


def connected_groups(pairs: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """(id, root) for every id of the pairs (a, b) of bigint; all ids of a component share the smallest id as root.

    Nulls on either side drop the pair; loops give a group of one; repeated and reversed pairs count once; an empty
    table gives an empty result.
    """
    spark = spark or pairs.sparkSession
    scratch = Scratch(spark, "components")
    pairs = scratch.write(pairs.select(*_edge("a", "b")).filter("a is not null and b is not null").distinct())
    edges = pairs.filter("a <> b")
    pointers: list[DataFrame] = []
    #: tables the pointers are read from, done with once the forest is written
    spent: list[DataFrame] = []
    total = edges.count()
    while total:
        stripped, leaves = _strip_leaves(edges, scratch, spent)
        stripped = scratch.write(stripped)
        rest, chains = _compress_chains(stripped, scratch, spent)
        pointers += [p for p in (leaves, chains) if p is not None]
        former, edges = edges, scratch.write(rest)
        scratch.drop(stripped, former)
        left = edges.count()
        if left > total * (1 - MIN_SHRINK):
            pointers.append(_solve_core(edges, scratch))
            break
        total = left
    if not pointers:
        return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("root"))
    forest = pointers[0]
    for p in pointers[1:]:
        forest = forest.unionByName(p)
    forest = scratch.write(forest)
    scratch.drop(*spent, edges)
    # Restore: every removed vertex walks to its root, the walks doubling in length.
    while True:
        above = forest.select(F.col("child").alias("parent"), F.col("parent").alias("up"))
        stepped = forest.join(above, "parent", "left").select("child", F.coalesce("up", "parent").alias("parent"), F.col("up").isNotNull().alias("moved"))
        stepped = scratch.write(stepped)
        moved = not stepped.filter("moved").isEmpty()
        old, forest = forest, stepped.select("child", "parent")
        scratch.drop(old)
        if not moved:
            break
    least = forest.groupBy("parent").agg(F.least(F.min("child"), F.col("parent")).alias("root"))
    members = forest.join(least, "parent").select(F.col("child").alias("id"), "root")
    roots = least.select(F.col("parent").alias("id"), "root")
    single = pairs.filter("a = b").select(F.col("a").alias("id")).distinct()
    found = members.unionByName(roots)
    return found.unionByName(single.join(found, "id", "left_anti").select("id", F.col("id").alias("root")))


def merge_groups(log: DataFrame) -> DataFrame:
    """(graph_no, graph_version, node_no, group_no) from a merge log.

    Of rows with one (graph_no, graph_version, merge_id) the latest update_time counts (null is oldest, then the
    greatest id); only status MERGED ties. A row whose merge_id is null stands for itself. Blank or null nodes tie
    nothing; a MERGED row with one usable node still names that node, as a group of its own. Null graph_no or
    graph_version are scopes like any other. group_no is the smallest node by code point.
    """
    spark = log.sparkSession
    scratch = Scratch(spark, "merge-groups")
    scope = ["graph_no", "graph_version"]
    latest = (
        log.select(*scope, F.coalesce(F.concat(F.lit("m"), "merge_id"), F.concat(F.lit("r"), F.col("id").cast("string"))).alias("m"), "winner_node_no", "loser_node_no", F.struct("update_time", "id", "status", "winner_node_no", "loser_node_no").alias("row"))
        .groupBy(*scope, "m").agg(F.max("row").alias("row"))
        .filter(F.col("row.status") == "MERGED")
    )
    blank = lambda c: F.when(F.col(c).rlike(r"(?U)\S"), F.col(c))
    ties = scratch.write(latest.select(*scope, blank("row.winner_node_no").alias("x"), blank("row.loser_node_no").alias("y")).filter("x is not null or y is not null").distinct())
    nodes = ties.select(*scope, F.explode(F.array("x", "y")).alias("node_no")).filter("node_no is not null").distinct()
    # Dense enough ids in code-point order: partitions of a global sort are in order, so the ids are too.
    ids = scratch.write(nodes.orderBy(*scope, "node_no").withColumn("id", F.monotonically_increasing_id()))
    named = lambda n: ids.select(F.col("graph_no").alias("g"), F.col("graph_version").alias("v"), F.col("node_no").alias("n"), F.col("id").alias(n))
    on = lambda c: F.col("graph_no").eqNullSafe(F.col("g")) & F.col("graph_version").eqNullSafe(F.col("v")) & (F.col(c) == F.col("n"))
    pairs = ties.withColumns({"x": F.coalesce("x", "y"), "y": F.coalesce("y", "x")})
    pairs = pairs.join(named("a"), on("x")).drop("g", "v", "n").join(named("b"), on("y")).select("a", "b")
    groups = scratch.write(connected_groups(pairs, spark))
    back = ids.join(groups, "id")
    names = ids.select(F.col("id").alias("root"), F.col("node_no").alias("group_no"))
    return back.join(names, "root").select(*scope, "node_no", "group_no")
