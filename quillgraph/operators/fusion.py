"""Entity fusion: candidates, clusters, batch merges with an undo log, aliases, rollback, pruning."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import edge_no
from ..functions.refs import fold_properties, fold_refs, support
from ..model import MERGED, PRUNED, ROLLED_BACK, SCOPE, live
from ..session import Scratch
from .lookup import unreferenced

_NODE_KEY = [*SCOPE, "graph_node_no"]
Clusterer = Callable[[str, list[str]], list[list[str]]]


def slug_clusterer(_type: str, names: list[str]) -> list[list[str]]:
    """Deterministic stand-in for a model: names equal but for case, blanks and hyphens belong together."""
    groups: dict[str, list[str]] = {}
    for n in names:
        groups.setdefault("".join(c for c in n.casefold() if c.isalnum()), []).append(n)
    return [g for g in groups.values() if len(g) > 1]


#: Names of a class that ask together and at most so many of these parts, names they are compared with at once, and names of small classes bundled.
ASK_ROWS, ASK_PARTS, OFFER_ROWS, BUNDLE_ROWS = 8192, 32, 131_072, 32_768
#: Askers counted together, and the first columns ranked; each further stretch is four times as wide.
ASK_BLOCK, FIRST_COLUMNS = 256, 64


def name_grams(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, name, size of every name) of the distinct pairs of characters, in order of the grams; a single character stands for itself."""
    length = np.array([len(x) for x in names], np.int64)
    text = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(names)), length)
    last = np.zeros(len(text), bool)
    last[np.cumsum(length)[length > 0] - 1] = True
    after = np.where(last, 0x1FFFFF, np.append(text[1:], 0))
    used = ~last | (length[owner] == 1)
    _, gram = np.unique((text << 21 | after)[used], return_inverse=True)
    code = np.unique(gram * len(names) + owner[used])
    gram, name = np.divmod(code, max(len(names), 1))
    return gram, name, np.bincount(name, minlength=len(names))


def most_alike(names: list[str], asks: np.ndarray, offered: np.ndarray, *, limit: int, min_shared: int, common: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(asker, other, shared, united), an asker's best first, of the ``limit`` offered names most alike to every asking one; ``names`` are in
    the order that decides between equal scores, and the first are kept.

    Counts what all pairs share: bigrams of many names as bits, the others along their posting lists. What a list ends with bounds what can
    still enter it, so that few pairs are ranked.
    """
    gram, name, size = name_grams(names)
    ask, offer = np.flatnonzero(asks), np.flatnonzero(offered)
    place = np.full(len(names), -1)
    place[offer] = np.arange(len(offer))
    df = np.bincount(gram)
    # bits cost every pair the same, lists the square of their length
    often = df > max(common, len(names) // 16)
    bit = np.cumsum(often) - 1
    words = -(-int(often.sum()) // 64)
    bits = np.zeros((words, len(names)), np.uint64)
    dense = often[gram]
    np.bitwise_or.at(bits, (bit[gram[dense]] // 64, name[dense]), np.uint64(1) << (bit[gram[dense]] % 64).astype(np.uint64))
    theirs = bits[:, offer]
    rare = ~dense & (df[gram] > 1)
    gram, name = gram[rare], name[rare]
    to = place[name]
    listed_gram, listed = gram[to >= 0], to[to >= 0]
    by_name = np.argsort(name, kind="stable")
    own, own_gram = name[by_name], gram[by_name]
    short = len(size) == 0 or size.max() <= 250
    size_to = size[offer].astype(np.float32)
    kind = np.uint8 if short else np.uint32
    done = [(np.zeros(0, np.int64),) * 4]
    for at in range(0, len(ask) if len(offer) else 0, ASK_BLOCK):
        rows = ask[at : at + ASK_BLOCK]
        shared = np.zeros((len(rows), len(offer)), kind)
        for w in range(words):
            mine = bits[w, rows]
            for r in np.flatnonzero(mine):
                shared[r] += np.bitwise_count(theirs[w] & mine[r])
        start, end = np.searchsorted(own, rows, "left"), np.searchsorted(own, rows, "right")
        for r in range(len(rows)):
            g = own_gram[start[r] : end[r]]
            for x, y in zip(np.searchsorted(listed_gram, g, "left"), np.searchsorted(listed_gram, g, "right")):
                shared[r, listed[x:y]] += 1
        self_at = place[rows]
        shared[np.flatnonzero(self_at >= 0), self_at[self_at >= 0]] = 0
        r = c = o = u = score = np.zeros(0, np.int64)
        bound = np.zeros(len(rows), np.float32)
        size_of = size[rows].astype(np.float32)
        left, width = 0, FIRST_COLUMNS
        while left < len(offer):
            part = shared[:, left : left + width]
            # shared / united > t is shared > t / (1 + t) * (both sizes); equal scores go to the earlier column. United numbers up to 500 leave
            # 1 / 1000 between different scores here, longer names' scores may be equal once rounded
            least = (bound * size_of)[:, None] + bound[:, None] * size_to[None, left : left + width]
            hit = part > least + np.float32(2e-4) if short else part > least * np.float32(1 - 1e-4) - np.float32(1e-3)
            i, j = np.nonzero(hit & (part >= min_shared))
            more = part[i, j].astype(np.int64)
            j = j + left
            all_ = size[rows[i]] + size[offer[j]] - more
            r, c, o, u = np.concatenate([r, i]), np.concatenate([c, j]), np.concatenate([o, more]), np.concatenate([u, all_])
            score = np.floor(o / u * 1e6 + 0.5)
            order = np.lexsort((c, -score, r))
            r, c, o, u = r[order], c[order], o[order], u[order]
            number = np.arange(len(r)) - np.searchsorted(r, r, "left")
            kept = number < limit
            r, c, o, u, number = r[kept], c[kept], o[kept], u[kept], number[kept]
            full = number == limit - 1
            t = o[full] / u[full]
            bound[r[full]] = t / (1 + t)
            left, width = left + width, width * 4
        done.append((rows[r], offer[c], o, u))
    return tuple(np.concatenate(x) for x in zip(*done))  # type: ignore[return-value]


_PAIR = "graph_no string, graph_version bigint, graph_node_no string, candidate_no string, shared bigint, united bigint, rank int"


def _asked(nodes: DataFrame) -> tuple[DataFrame, bool]:
    """(named nodes dealt to cells of names that are compared, whether each list comes from a single cell). A cell has whole small classes, or a part
    of a large class's names that ask (role 2) and a part of those that are offered (role 1)."""
    scratch = Scratch(nodes.sparkSession, "names")
    named = live(nodes).select(*_NODE_KEY, "class", "name", F.lower(F.regexp_replace("name", r"(?U)^\s+|\s+$", "")).alias("low")).filter(F.length("low") > 0)
    named = scratch.write(named)
    kinds = scratch.write(named.groupBy(*SCOPE, "class").agg(F.count(F.lit(1)).alias("n")))
    total, most = kinds.agg(F.sum("n"), F.max("n")).first()
    bundles = max(1, -(-(total or 0) // BUNDLE_ROWS))
    kinds = kinds.withColumns({"asking": F.least(F.ceil(F.col("n") / ASK_ROWS), F.lit(ASK_PARTS)).cast("int"), "offering": F.ceil(F.col("n") / OFFER_ROWS).cast("int")})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*SCOPE, "class"]]
    dealt = named.join(kinds.withColumnsRenamed({c: f"_{c}" for c in [*SCOPE, "class"]}), same).drop(*[f"_{c}" for c in [*SCOPE, "class"]])
    mine = lambda parts, seed: F.pmod(F.xxhash64("graph_node_no", F.lit(seed)), F.col(parts)).cast("int")
    cells = F.expr("flatten(transform(sequence(0, asking - 1), a -> transform(sequence(0, offering - 1), o -> struct(a, o, IF(a = ask, 2, 0) + IF(o = offer, 1, 0) AS role))))")
    dealt = dealt.withColumns({"ask": mine("asking", 1), "offer": mine("offering", 2)}).withColumn("x", F.explode(F.filter(cells, lambda x: x["role"] > 0)))
    whole = (F.col("asking") == 1) & (F.col("offering") == 1)
    group = F.xxhash64(*SCOPE, "class")
    cell = F.when(whole, F.concat(F.lit("b"), F.pmod(group, F.lit(bundles)))).otherwise(F.concat_ws("-", group, "x.a", "x.o"))
    return dealt.select(cell.alias("cell"), F.col("x.role").alias("role"), *_NODE_KEY, "class", "name", "low"), (most or 0) <= OFFER_ROWS


def _classes(table: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """(names in order of their keys, who asks, who is offered) of every class in a cell."""
    table = table.sort_values("graph_node_no", kind="stable")
    for _, own in table.groupby([*SCOPE, "class"], sort=False, dropna=False):
        role = own["role"].to_numpy()
        yield own, role & 2 > 0, role & 1 > 0


def fusion_candidates(nodes: DataFrame, *, limit: int = 10, min_shared: int = 2, common: int = 200) -> DataFrame:
    """(scope, graph_node_no, candidate_no, score, rank): the ``limit`` nodes of the same class most alike by the share
    of common name bigrams (Jaccard), itself left out.

    A pair must share ``min_shared`` bigrams. All pairs of a class are counted where its names lie together in memory, so that
    what goes through an exchange are names, never pairs; bigrams in at most ``common`` names are counted along their lists.
    """

    def run(table: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: [] for c in [*_NODE_KEY, "candidate_no", "shared", "united", "rank"]})]
        for own, asks, offered in _classes(table):
            a, b, o, u = most_alike(own["low"].tolist(), asks, offered, limit=limit, min_shared=min_shared, common=common)
            key = own["graph_node_no"].to_numpy()
            place = np.arange(len(a)) - np.searchsorted(a, a, "left") + 1
            out.append(pd.DataFrame({"graph_no": own["graph_no"].to_numpy()[a], "graph_version": own["graph_version"].to_numpy()[a], "graph_node_no": key[a], "candidate_no": key[b], "shared": o, "united": u, "rank": place}))
        return pd.concat(out[1:] or out)

    cells, single = _asked(nodes)
    found = cells.groupBy("cell").applyInPandas(run, _PAIR).withColumn("score", F.round(F.col("shared") / F.col("united"), 6))
    if not single:
        rank = F.row_number().over(Window.partitionBy(*_NODE_KEY).orderBy(F.desc("score"), "candidate_no"))
        found = found.withColumn("rank", rank).filter(F.col("rank") <= limit)
    return found.select(*_NODE_KEY, "candidate_no", "score", "rank")


def _ties(kind: str, members: list[tuple[str, str]], clusterer: Clusterer) -> set[tuple[str, str]]:
    """Pairs of keys, smaller first, from the groups of a seed and its candidates (name, key)."""
    keys: dict[str, list[str]] = {}
    for n, k in members:
        keys.setdefault(n, []).append(k)
    try:
        groups = clusterer(kind, list(keys))
    except Exception:
        groups = []
    out = set()
    for group in groups:
        known = [n for n in dict.fromkeys(group) if n in keys]
        ids = [k for n in known for k in keys[n]]
        out |= {(min(ids[0], k), max(ids[0], k)) for k in ids[1:] if k != ids[0]}
    return out


def candidate_clusters(nodes: DataFrame, clusterer: Clusterer = slug_clusterer, *, limit: int = 10, min_shared: int = 2, common: int = 200) -> DataFrame:
    """``cluster`` of the ``fusion_candidates``, asked where these are found: lists of candidates go through no exchange unless
    a class is so large that they come from several."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        out = []
        for own, asks, offered in _classes(table):
            a, b, *_ = most_alike(own["low"].tolist(), asks, offered, limit=limit, min_shared=min_shared, common=common)
            said = list(zip(own["name"], own["graph_node_no"]))
            g, v, kind = own["graph_no"].iat[0], own["graph_version"].iat[0], own["class"].iat[0]
            edge = np.flatnonzero(np.diff(a, prepend=-1, append=-1)) if len(a) else np.zeros(1, int)
            tied: set[tuple[str, str]] = set()
            for start, end in zip(edge[:-1], edge[1:]):
                tied |= _ties(kind, [said[a[start]], *(said[i] for i in b[start:end])], clusterer)
            out += [(g, v, *pair) for pair in sorted(tied)]
        return pd.DataFrame(out, columns=["graph_no", "graph_version", "a", "b"])

    cells, single = _asked(nodes)
    if not single:
        return cluster(fusion_candidates(nodes, limit=limit, min_shared=min_shared, common=common), nodes, clusterer)
    return cells.groupBy("cell").applyInPandas(run, "graph_no string, graph_version bigint, a string, b string").distinct()


def cluster(candidates: DataFrame, nodes: DataFrame, clusterer: Clusterer = slug_clusterer) -> DataFrame:
    """Pairs (scope, a, b) from an injected clusterer asked once a seed: it sees the names of seed and candidates and may
    only group names it was given; groups of one and failures tie nothing."""
    names = nodes.select(*_NODE_KEY, "name", "class")
    seeds = candidates.join(names, _NODE_KEY).withColumnsRenamed({"name": "seed_name"})
    asked = seeds.join(names.select(*SCOPE, F.col("graph_node_no").alias("candidate_no"), F.col("name").alias("candidate_name")), [*SCOPE, "candidate_no"])
    asked = asked.groupBy(*_NODE_KEY, "class", "seed_name").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate_no", "candidate_name"))).alias("c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for g, v, no, kind, name, c in b[[*_NODE_KEY, "class", "seed_name", "c"]].itertuples(index=False):
                members = [(name, no), *((x["candidate_name"], x["candidate_no"]) for x in c)]
                out += [(g, v, *pair) for pair in _ties(kind, members, clusterer)]
            yield pd.DataFrame(out, columns=["graph_no", "graph_version", "a", "b"])

    return asked.mapInPandas(run, "graph_no string, graph_version bigint, a string, b string").distinct()


def fusion_components(pairs: DataFrame) -> DataFrame:
    """(scope, graph_node_no, winner_node_no): the smallest key of all nodes tied directly or through others.

    Minimum labels spread along the pairs and along the labels themselves, so the rounds grow with the logarithm of the
    longest chain; each round is written to the shared folder.
    """
    scratch = Scratch(pairs.sparkSession, "fusion")
    arcs = scratch.write(pairs.select(*SCOPE, "a", "b").unionByName(pairs.select(*SCOPE, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.write(arcs.groupBy(*SCOPE, "a").agg(F.min("b").alias("m")).select(*SCOPE, "a", F.least("a", "m").alias("label")))
    while True:
        near = arcs.join(labels.select(*SCOPE, F.col("a").alias("b"), F.col("label").alias("other")), [*SCOPE, "b"]).groupBy(*SCOPE, "a").agg(F.min("other").alias("other"))
        step = labels.join(near, [*SCOPE, "a"], "left").select(*SCOPE, "a", F.least("label", F.coalesce("other", "label")).alias("label"), F.col("label").alias("old"))
        # what a label's own node has learnt is passed on at once
        up = step.select(*SCOPE, F.col("a").alias("label"), F.col("label").alias("up"))
        jumped = scratch.write(step.join(up, [*SCOPE, "label"], "left").select(*SCOPE, "a", F.least("label", F.coalesce("up", "label")).alias("label"), "old"))
        moved = not jumped.filter("label <> old").isEmpty()
        scratch.drop(labels)
        labels = jumped.select(*SCOPE, "a", "label")
        labels._scratch_path = jumped._scratch_path
        if not moved:
            break
    return labels.select(*SCOPE, F.col("a").alias("graph_node_no"), F.col("label").alias("winner_node_no"))


def merged_nodes(nodes: DataFrame, groups: DataFrame, *, names: DataFrame | None = None) -> DataFrame:
    """Node table after merging every group into its winner.

    The winner's properties win, references unite, the longest description of the group counts if it is longer than the
    winner's, a canonical name (scope, winner_node_no, canonical_name) is adopted; losers are soft-deleted.
    """
    g = groups.select(*_NODE_KEY, "winner_node_no")
    joined = live(nodes).join(g, _NODE_KEY)
    own = F.col("graph_node_no") == F.col("winner_node_no")
    by = [*SCOPE, "winner_node_no"]
    long = joined.groupBy(*by).agg(
        F.max(F.when(~own & F.col("description").isNotNull(), F.struct(F.length("description").alias("n"), F.col("description").alias("d")))).alias("long"), F.count_if(~own).alias("losers"),
    ).filter("losers > 0")
    folded = long.join(fold_properties(joined, by, F.struct(~own, F.col("graph_node_no"))).withColumnRenamed("properties", "all_properties"), by, "left").join(fold_refs(joined, by).withColumnRenamed("ref", "all_refs"), by, "left")
    members = folded.withColumnRenamed("winner_node_no", "graph_node_no")
    if names is not None:
        members = members.join(names.select(*SCOPE, F.col("winner_node_no").alias("graph_node_no"), "canonical_name"), _NODE_KEY, "left")
    else:
        members = members.withColumn("canonical_name", F.lit(None).cast("string"))
    lost = g.filter(~own).select(*_NODE_KEY, F.lit(True).alias("lost"))
    out = nodes.join(members, _NODE_KEY, "left").join(lost, _NODE_KEY, "left")
    wins = F.col("losers").isNotNull()
    return out.withColumns({
        "properties": F.when(wins, F.coalesce("all_properties", "properties")).otherwise(F.col("properties")), "ref": F.when(wins, F.coalesce("all_refs", "ref")).otherwise(F.col("ref")),
        "description": F.when(wins & (F.coalesce(F.col("long.n"), F.lit(0)) > F.coalesce(F.length("description"), F.lit(0))), F.col("long.d")).otherwise(F.col("description")),
        "name": F.coalesce(F.when(wins & (F.coalesce("canonical_name", F.lit("")) != ""), F.col("canonical_name")), F.col("name")),
        "deleted": F.coalesce("lost", F.coalesce("deleted", F.lit(False))),
    }).drop("losers", "long", "all_properties", "all_refs", "canonical_name", "lost")


_EDGE = [*SCOPE, "graph_edge_no", "source_node_no", "target_node_no", "name", "description", "properties", "ref", "deleted"]


def _moved(edges: DataFrame, losers: DataFrame) -> DataFrame:
    """Edges with the ends and the key they have once losers (scope, graph_node_no, winner_node_no) are replaced:
    new_source_node_no, new_target_node_no, new_no, touched."""
    e = edges
    for end in ("source_node_no", "target_node_no"):
        w = losers.select(*SCOPE, F.col("graph_node_no").alias(end), F.col("winner_node_no").alias(f"to_{end}"))
        e = e.join(w, [*SCOPE, end], "left").withColumn(f"new_{end}", F.coalesce(f"to_{end}", end)).drop(f"to_{end}")
    touched = (F.col("new_source_node_no") != F.col("source_node_no")) | (F.col("new_target_node_no") != F.col("target_node_no"))
    return e.withColumn("touched", touched).withColumn("new_no", F.when(F.col("touched"), edge_no(F.col("new_source_node_no"), F.col("name"), F.col("new_target_node_no"))).otherwise(F.col("graph_edge_no")))


def edge_images(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of the edge table that merges touch, as they are: live edges with an end among the losers, and what bears
    the keys these come to bear, dead rows included. Everything else is left where it is."""
    scratch = Scratch(edges.sparkSession, "images")
    losers = groups.filter(F.col("graph_node_no") != F.col("winner_node_no"))
    gone = losers.select(*SCOPE, "graph_node_no")
    sides = [live(edges).join(gone.withColumnRenamed("graph_node_no", end), [*SCOPE, end], "left_semi").select(*SCOPE, "graph_edge_no") for end in ("source_node_no", "target_node_no")]
    hit = scratch.write(live(edges).join(sides[0].unionByName(sides[1]).distinct(), [*SCOPE, "graph_edge_no"], "left_semi").select(*_EDGE))
    taken = _moved(hit, losers).select(*SCOPE, F.col("new_no").alias("graph_edge_no")).distinct()
    there = edges.join(taken, [*SCOPE, "graph_edge_no"], "left_semi")
    return hit.unionByName(there.select(*_EDGE)).withColumn("deleted", F.coalesce("deleted", F.lit(False))).dropDuplicates([*SCOPE, "graph_edge_no", "deleted"])


def folded_edges(images: DataFrame, groups: DataFrame) -> DataFrame:
    """What images become under merges: (edge columns, folded).

    Ends move to their winners and a loop made by that is soft-deleted. Edges that come to bear the same key fold into the
    one that bore it before, else into the smallest former key: its properties and its description win, references
    unite, the others are soft-deleted under their former key. ``folded`` counts them. A dead row gives way to a live
    one of its key.
    """
    losers = groups.filter(F.col("graph_node_no") != F.col("winner_node_no"))
    e = Scratch(images.sparkSession, "folded").write(_moved(live(images), losers))
    loop = F.col("touched") & (F.col("new_source_node_no") == F.col("new_target_node_no"))
    by = [*SCOPE, "new_no"]
    order = F.struct(F.col("graph_edge_no") != F.col("new_no"), F.col("graph_edge_no"))
    kept = e.filter(~loop)
    lead = kept.groupBy(*by).agg(F.min(order).alias("first"), (F.count(F.lit(1)) - 1).cast("int").alias("folded")).select(*by, F.col("first.graph_edge_no").alias("lead_no"), "folded")
    several = lead.filter("folded > 0")
    many = kept.join(several.select(*by), by, "left_semi")
    content = several.join(fold_properties(many, by, order).withColumnRenamed("properties", "all_properties"), by, "left").join(fold_refs(many, by).withColumnRenamed("ref", "all_refs"), by, "left").select(*by, "all_properties", "all_refs")
    marked = kept.join(lead, by).join(content, by, "left")
    leads = marked.filter("graph_edge_no = lead_no").select(
        *SCOPE, F.col("new_no").alias("graph_edge_no"), F.col("new_source_node_no").alias("source_node_no"), F.col("new_target_node_no").alias("target_node_no"), "name", "description",
        F.coalesce("all_properties", "properties", F.lit("{}")).alias("properties"), F.coalesce("all_refs", "ref", F.create_map().cast("map<string,array<string>>")).alias("ref"), F.lit(False).alias("deleted"), "folded",
    )
    dead = marked.filter("graph_edge_no <> lead_no").select(*_EDGE).unionByName(e.filter(loop).select(*_EDGE)).withColumn("deleted", F.lit(True))
    twins = images.filter(F.coalesce("deleted", F.lit(False))).select(*_EDGE).unionByName(dead)
    twins = twins.join(leads.select(*SCOPE, "graph_edge_no"), [*SCOPE, "graph_edge_no"], "left_anti")
    return leads.unionByName(twins.withColumn("folded", F.lit(0)))


def remapped_edges(edges: DataFrame, groups: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Edge table after merges, all columns and rows: see ``folded_edges``; rows no merge touches are untouched."""
    images = Scratch(edges.sparkSession, "remapped").write(edge_images(edges, groups)) if images is None else images
    rest = edges.join(images.select(*SCOPE, "graph_edge_no"), [*SCOPE, "graph_edge_no"], "left_anti")
    return rest.select(*_EDGE).withColumn("folded", F.lit(0)).unionByName(folded_edges(images, groups))


def added_aliases(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Aliases (scope, canonical_node_no, alias, source) of ``wanted`` that are new: an alias has one owner in a scope, the
    one it has already, else the smallest key that asks for it; blank ones are left out."""
    asked = wanted.filter(F.col("alias").rlike(r"(?U)\S")).withColumn("n", F.row_number().over(Window.partitionBy(*SCOPE, "alias").orderBy("canonical_node_no", "source"))).filter("n = 1").drop("n")
    return asked.join(existing.select(*SCOPE, "alias"), [*SCOPE, "alias"], "left_anti")


def node_snapshot() -> Column:
    """What an audit row keeps of a node."""
    return F.struct("graph_node_no", "name", "type", "description", "properties", "ref", "class", "entity_spec")


NODE_SNAPSHOT = "struct<graph_node_no:string,name:string,type:string,description:string,properties:string,ref:map<string,array<string>>,class:string,entity_spec:string>"
SNAPSHOT = f"struct<batch:string,winner:{NODE_SNAPSHOT},loser:{NODE_SNAPSHOT},aliases:array<string>>"


def _digest(*parts: Column | str) -> Column:
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(32))


def merge_log_rows(nodes: DataFrame, groups: DataFrame, *, batch: str = "", aliases: DataFrame | None = None) -> DataFrame:
    """One MERGED row a loser with a typed snapshot of both nodes and the aliases (scope, canonical_node_no, alias) the
    merge adds for it; merge_id is a digest of scope, batch and pair, so writing the same merge again gives the same row."""
    lost = groups.filter(F.col("graph_node_no") != F.col("winner_node_no"))
    snap = nodes.select(*_NODE_KEY, node_snapshot().alias("s"))
    rows = lost.join(snap.withColumnRenamed("s", "loser"), _NODE_KEY).join(snap.select(*SCOPE, F.col("graph_node_no").alias("winner_node_no"), F.col("s").alias("winner")), [*SCOPE, "winner_node_no"])
    none = F.array().cast("array<string>")
    if aliases is not None:
        own = aliases.select(*SCOPE, F.col("canonical_node_no").alias("winner_node_no"), F.col("alias").alias("said")).distinct()
        rows = rows.withColumn("said", F.col("loser.name")).join(own.withColumn("new", F.lit(True)), [*SCOPE, "winner_node_no", "said"], "left").withColumn("aliases", F.when(F.col("new"), F.array("said")).otherwise(none))
    else:
        rows = rows.withColumn("aliases", none)
    number = _digest(F.col("graph_no"), F.col("graph_version").cast("string"), F.lit(batch), F.col("winner_node_no"), F.col("graph_node_no"))
    snapshot = F.struct(F.lit(batch).alias("batch"), "winner", "loser", "aliases")
    return rows.select(*SCOPE, number.alias("merge_id"), "winner_node_no", F.col("graph_node_no").alias("loser_node_no"), snapshot.alias("snapshot"), F.lit(MERGED).alias("status"))


def domain_deleted(domain: DataFrame, keys: DataFrame, deleted: bool) -> DataFrame:
    """Domain table with the rows of the keys (scope, graph_node_no) soft-deleted or brought back."""
    marks = keys.select(*_NODE_KEY).distinct().withColumn("hit", F.lit(True))
    out = domain.join(marks, _NODE_KEY, "left").withColumn("deleted", F.when(F.col("hit"), F.lit(deleted)).otherwise(F.col("deleted")))
    return out.select(*domain.columns)


@dataclass
class Fused:
    """Tables after merging or undoing; ``images`` are the edge rows as they were before a merge."""

    nodes: DataFrame
    edges: DataFrame
    domain: DataFrame
    aliases: DataFrame
    log: DataFrame
    images: DataFrame


def apply_merges(nodes: DataFrame, edges: DataFrame, domain: DataFrame, aliases: DataFrame, groups: DataFrame, *, batch: str, names: DataFrame | None = None) -> Fused:
    """All tables of a scope after merging groups (scope, graph_node_no, winner_node_no): nodes and edges merged, losers
    and their domain rows soft-deleted, their names aliases of the winners; ``log`` has the new rows only. ``nodes`` have
    class and entity_spec."""
    lost = groups.filter(F.col("graph_node_no") != F.col("winner_node_no"))
    wanted = nodes.join(lost, _NODE_KEY).select(*SCOPE, F.col("winner_node_no").alias("canonical_node_no"), F.col("name").alias("alias"), F.lit("merge").alias("source"))
    added = added_aliases(aliases, wanted)
    images = Scratch(edges.sparkSession, "merged").write(edge_images(edges, groups))
    return Fused(
        merged_nodes(nodes.drop("class", "entity_spec"), groups, names=names), remapped_edges(edges, groups, images).drop("folded"), domain_deleted(domain, lost, True),
        aliases.unionByName(added, allowMissingColumns=True), merge_log_rows(nodes, groups, batch=batch, aliases=added), images.withColumn("batch", F.lit(batch)),
    )


def undo_merges(nodes: DataFrame, edges: DataFrame, domain: DataFrame, aliases: DataFrame, log: DataFrame, images: DataFrame, merge_ids: DataFrame) -> Fused:
    """All tables of a scope after undoing merges and prunings; ``log`` (typed snapshots) comes back whole.

    What the merges of the same batch that stay in force make of nodes and edges is worked out again from the rows before
    the batch, so a merge can be undone by itself: losers come back to life with their edges, the winner keeps what the
    others brought. An edge nothing folded into keeps what was written to it since. Aliases go that no merge in force has
    added. Merges that cannot be undone are the caller's error, see ``not_reversible``.
    """
    hit = merge_ids.select("merge_id").distinct().withColumn("undo", F.lit(True))
    rows = log.join(hit, "merge_id", "left").withColumn("undo", F.coalesce("undo", F.lit(False)))
    undone = rows.filter(F.col("undo") & F.col("status").isin(MERGED, PRUNED))
    back = undone.select(*SCOPE, F.col("loser_node_no").alias("graph_node_no")).distinct()
    scope_batch = [*SCOPE, "batch"]
    batches = undone.filter(F.col("status") == MERGED).select(*SCOPE, F.col("snapshot.batch").alias("batch")).distinct()
    batch_log = rows.filter(F.col("status") == MERGED).withColumn("batch", F.col("snapshot.batch")).join(batches, scope_batch, "left_semi")
    pairs = batch_log.select(*SCOPE, "batch", F.col("loser_node_no").alias("graph_node_no"), "winner_node_no", "undo")
    stay = pairs.filter(~F.col("undo"))

    # nodes: winners from the rows before the batch and the merges that stay, losers as they were
    touched = pairs.filter("undo").select(*SCOPE, "winner_node_no").distinct()
    sides = batch_log.join(touched, [*SCOPE, "winner_node_no"], "left_semi").select(*SCOPE, F.explode(F.array("snapshot.winner", "snapshot.loser")).alias("s"))
    lone = undone.filter(F.col("status") == PRUNED).select(*SCOPE, F.col("snapshot.loser").alias("s"))
    was = sides.unionByName(lone).filter("s.graph_node_no is not null").select(*SCOPE, *[f"s.{c}" for c in ("graph_node_no", "name", "type", "description", "properties", "ref")]).dropDuplicates(_NODE_KEY).withColumn("deleted", F.lit(False))
    own = touched.select(*SCOPE, F.col("winner_node_no").alias("graph_node_no"), "winner_node_no")
    again = merged_nodes(was, stay.select(*_NODE_KEY, "winner_node_no").join(touched, [*SCOPE, "winner_node_no"], "left_semi").unionByName(own))
    changed = again.filter(~F.col("deleted")).select(*_NODE_KEY, *[F.col(c).alias(f"was_{c}") for c in ("name", "type", "description", "properties", "ref")], F.lit(True).alias("back"))
    joined = nodes.join(changed, _NODE_KEY, "left")
    new_nodes = joined.withColumns({c: F.when(F.col("back"), F.col(f"was_{c}")).otherwise(F.col(c)) for c in ("name", "type", "description", "properties", "ref")} | {"deleted": F.when(F.col("back"), F.lit(False)).otherwise(F.col("deleted"))})

    # edges: the images that share a key with one of an undone loser, under the merges that stay
    img = images.join(batches, scope_batch, "left_semi").select(*_EDGE).dropDuplicates([*SCOPE, "graph_edge_no", "deleted"])
    keyed = _moved(live(img), pairs)
    ends = [keyed.join(back.withColumnRenamed("graph_node_no", end), [*SCOPE, end], "left_semi").select(*SCOPE, "new_no") for end in ("source_node_no", "target_node_no")]
    keys = ends[0].unionByName(ends[1]).distinct()
    scratch = Scratch(nodes.sparkSession, "undone")
    keys = scratch.write(keys)
    mine = scratch.write(keyed.join(keys, [*SCOPE, "new_no"], "left_semi"))
    single = mine.groupBy(*SCOPE, "new_no").agg(F.count(F.lit(1)).alias("n"), F.min("graph_edge_no").alias("graph_edge_no")).filter("n = 1")
    now = single.join(live(edges).select(*SCOPE, F.col("graph_edge_no").alias("new_no"), *[F.col(c).alias(f"now_{c}") for c in ("description", "properties", "ref")]), [*SCOPE, "new_no"]).drop("n", "new_no")
    fresh = mine.join(now.withColumn("fresh", F.lit(True)), [*SCOPE, "graph_edge_no"], "left").withColumns({c: F.when(F.col("fresh"), F.col(f"now_{c}")).otherwise(F.col(c)) for c in ("description", "properties", "ref")})
    twins = img.filter("deleted").join(keys.withColumnRenamed("new_no", "graph_edge_no"), [*SCOPE, "graph_edge_no"], "left_semi")
    stay = scratch.write(stay)
    restored = folded_edges(fresh.select(*_EDGE).unionByName(twins), stay).drop("folded")
    replaced = mine.select(*SCOPE, "graph_edge_no").unionByName(keys.withColumnRenamed("new_no", "graph_edge_no")).distinct()
    new_edges = edges.join(replaced, [*SCOPE, "graph_edge_no"], "left_anti").select(*_EDGE).unionByName(restored)

    said = lambda df: df.select(*SCOPE, F.col("winner_node_no").alias("canonical_node_no"), F.explode("snapshot.aliases").alias("alias")).distinct()
    alias_key = [*SCOPE, "canonical_node_no", "alias"]
    drop = said(undone.filter(F.col("status") == MERGED)).join(said(rows.filter(~F.col("undo") & (F.col("status") == MERGED))), alias_key, "left_anti")
    marked = rows.withColumn("status", F.when(F.col("undo") & F.col("status").isin(MERGED, PRUNED), F.lit(ROLLED_BACK)).otherwise(F.col("status")))
    return Fused(new_nodes.select(*nodes.columns), new_edges, domain_deleted(domain, back, False), aliases.join(drop, alias_key, "left_anti").select(*aliases.columns), marked.select(*log.columns), images)


def not_reversible(log: DataFrame, merge_ids: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Asked merge ids that cannot be undone: absent, rolled back already, or of a winner that is itself merged by now."""
    good = log.filter(F.col("status").isin(MERGED, PRUNED))
    if nodes is not None:
        alive = live(nodes).select(*SCOPE, F.col("graph_node_no").alias("winner_node_no"))
        good = good.filter(F.col("status") == PRUNED).unionByName(good.filter(F.col("status") == MERGED).join(alive, [*SCOPE, "winner_node_no"], "left_semi").select(*good.columns))
    return merge_ids.select("merge_id").distinct().join(good.select("merge_id"), "merge_id", "left_anti")


def alias_of(nodes: DataFrame, aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, graph_node_no, aliases) by key, else by exact live name."""
    n = live(nodes).select(*_NODE_KEY, "name")
    by_key = wanted.join(n, F.col("wanted") == F.col("graph_node_no")).select("wanted", *_NODE_KEY)
    by_name = wanted.join(by_key.select("wanted"), "wanted", "left_anti").join(n, F.col("wanted") == F.col("name")).select("wanted", *_NODE_KEY)
    a = aliases.groupBy(*SCOPE, F.col("canonical_node_no").alias("graph_node_no")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return by_key.unionByName(by_name).join(a, _NODE_KEY, "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def low_support(nodes: DataFrame, edges: DataFrame, *, min_support: int = 2) -> DataFrame:
    """Live nodes seen in fewer than ``min_support`` documents and touched by no live edge."""
    return unreferenced(nodes, edges).filter(support(F.col("ref")) < min_support)


def pruned(nodes: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, log rows): the doomed nodes soft-deleted, each with a PRUNED row without a winner and a snapshot of it;
    ``doomed`` has class and entity_spec or is given none."""
    marks = doomed.select(*_NODE_KEY, F.lit(True).alias("hit"))
    out = nodes.join(marks, _NODE_KEY, "left").withColumn("deleted", F.coalesce("hit", F.coalesce("deleted", F.lit(False)))).drop("hit")
    for c in ("class", "entity_spec"):
        doomed = doomed if c in doomed.columns else doomed.withColumn(c, F.lit(None).cast("string"))
    snapshot = F.struct(F.lit("").alias("batch"), F.lit(None).cast(NODE_SNAPSHOT).alias("winner"), node_snapshot().alias("loser"), F.array().cast("array<string>").alias("aliases"))
    number = _digest(F.col("graph_no"), F.col("graph_version").cast("string"), F.lit("prune"), F.col("graph_node_no"))
    return out, doomed.select(*SCOPE, number.alias("merge_id"), F.lit("").alias("winner_node_no"), F.col("graph_node_no").alias("loser_node_no"), snapshot.alias("snapshot"), F.lit(PRUNED).alias("status"))
