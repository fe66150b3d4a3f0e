"""Text and vector channels over the search index, and their fusion.

Queries are a DataFrame (query_no, graph_no, graph_version, text, embedding), so any number of them runs in one plan:
each is matched to its scope by an equi-join, never by a cross product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..model import SCOPE
from .rank import ranked, reciprocal_rank_fusion, restrict


def bigrams(text: Column) -> Column:
    """Overlapping pairs of characters of the lower-cased text; a single character stands for itself."""
    low = F.lower(text)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(2)))
    return F.when(F.length(low) > 0, pairs).otherwise(F.array().cast("array<string>"))


def bigram_index(entries: DataFrame) -> DataFrame:
    """Inverted index (scope, object_type, object_no, term, tf) of searchable_text."""
    keys = [*SCOPE, "object_type", "object_no"]
    return entries.select(*keys, F.explode(bigrams(F.col("searchable_text"))).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


#: Questions that may be sent to every task; more are joined to the index by an exchange on the scope.
BROADCAST_QUERIES = 20_000


def _few(queries: DataFrame) -> DataFrame:
    """Queries with a broadcast hint if they are known to be few."""
    return F.broadcast(queries) if queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES else queries


#: Questions compared with a batch of entries at once.
ASKED_TOGETHER = 128


def _best(scores: np.ndarray, objects: np.ndarray, *, min_score: float, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(question, row) of all rows that can be among the first ``limit`` objects of a question; ``objects`` numbers the rows' objects
    in their order, which decides between scores equal to six digits, and an object counts once."""
    s = np.floor(np.where(np.isnan(scores), np.inf, scores) * 1e6 + 0.5)
    most = min(s.shape[1], limit * int(np.bincount(objects).max()))
    last = np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most]
    # less one, should the last digit be rounded otherwise elsewhere
    q, row = np.nonzero((s >= last[:, None] - 1) & (scores > min_score - 1e-6 if not np.isnan(scores).any() else ~(scores <= min_score - 1e-6)))
    order = np.lexsort((objects[row], -s[q, row], q))
    q, row = q[order], row[order]
    place = np.arange(len(q)) - np.searchsorted(q, q, "left")
    # what may tie with the last one after rounding stays
    edge = np.full(len(scores), -np.inf)
    at = np.flatnonzero(place == most - 1)
    edge[q[at]] = s[q[at], row[at]]
    keep = (place < most) | (np.abs(s[q, row] - edge[q]) == 1)
    return q[keep], row[keep]


def _answers(batch: pa.RecordBatch, names: pa.Array, blocks: Iterator[tuple[int, np.ndarray]], *, min_score: float, limit: int) -> Iterator[pa.RecordBatch]:
    """Candidates (query_no, object_type, object_no, score) of a batch (object_type, object_no, ...), by type; blocks are (first question, scores)."""
    kinds, numbers = batch.column(0), batch.column(1)
    kind = np.unique(np.array(kinds.to_pylist(), dtype=object).astype(str), return_inverse=True)[1]
    number = np.unique(np.array(numbers.to_pylist(), dtype=object).astype(str), return_inverse=True)[1]
    for at, scores in blocks:
        for each in range(kind.max() + 1):
            own = np.flatnonzero(kind == each)
            part = scores[:, own]
            q, row = _best(part, number[own], min_score=min_score, limit=limit)
            there = pa.array(own[row])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q + at)), kinds.take(there), numbers.take(there), pa.array(part[q, row])], names=["query_no", "object_type", "object_no", "score"])


def _in_turn(queries: DataFrame) -> list[DataFrame]:
    """Queries in as many parts as keep each within the number that is sent to every task."""
    parts = -(-queries.select("query_no").distinct().count() // BROADCAST_QUERIES)
    return [queries] if parts < 2 else [queries.filter(F.pmod(F.xxhash64("query_no"), F.lit(parts)) == i) for i in range(parts)]


def _everywhere(rows: DataFrame, queries: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *, min_score: float, limit: int) -> DataFrame:
    """Ranked answers of what ``run`` finds in every batch of rows."""
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema, *rows.schema]}
    found = rows.mapInArrow(run, f"query_no {kinds['query_no']}, object_type string, object_no string, score double")
    found = found.withColumn("score", F.round("score", 6)).filter(F.col("score") > min_score)
    found = found.groupBy("query_no", "object_type", "object_no").agg(F.max("score").alias("score"))
    return ranked(found, by=["query_no", "object_type"], limit=limit)


def _text_everywhere(weighed: DataFrame, terms: DataFrame, *, min_score: float, limit: int) -> DataFrame:
    """The text channel over all scopes: (object, its terms' weights) meet the questions in memory, never posting by posting."""
    words = sorted(r[0] for r in terms.select("term").distinct().collect())
    number = {w: i for i, w in enumerate(words)}
    asked = terms.groupBy("query_no").agg(F.collect_list("term").alias("terms")).collect()
    names = pa.array([r["query_no"] for r in asked])
    shared = terms.sparkSession.sparkContext.broadcast((names, [np.array([number[t] for t in r["terms"]], np.int64) for r in asked], number))
    rows = weighed.groupBy("object_type", "object_no", *SCOPE).agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("ws")).select("object_type", "object_no", "terms", "ws")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, number = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            term = np.array([number.get(t, len(number)) for t in batch.column(2).flatten().to_pylist()], np.int64)
            w = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(2).offsets.to_numpy()))
            order = np.argsort(term, kind="stable")
            row, w = row[order], w[order]
            edge = np.searchsorted(term[order], np.arange(len(number) + 1))

            def blocks() -> Iterator[tuple[int, np.ndarray]]:
                for at in range(0, len(asked), ASKED_TOGETHER):
                    s = np.zeros((min(ASKED_TOGETHER, len(asked) - at), batch.num_rows))
                    for line, own in zip(s, asked[at : at + ASKED_TOGETHER]):
                        for t in own:
                            line[row[edge[t] : edge[t + 1]]] += w[edge[t] : edge[t + 1]]
                    yield at, s

            yield from _answers(batch, names, blocks(), min_score=min_score, limit=limit)

    return _everywhere(rows, terms, run, min_score=min_score, limit=limit)


def _vector_everywhere(usable: DataFrame, asked: DataFrame, *, min_score: float, limit: int) -> DataFrame:
    """The vector channel over all scopes: every batch of entries is compared with the questions by one product."""
    sizes: dict[int, list] = {}
    for r in asked.select("query_no", "q").collect():
        if None not in r["q"]:
            sizes.setdefault(len(r["q"]), []).append(r)
    plain = {d: (pa.array([r["query_no"] for r in own]), np.array([r["q"] for r in own], np.float64)) for d, own in sizes.items()}
    shared = asked.sparkSession.sparkContext.broadcast(plain)
    rows = usable.filter("not exists(embedding, x -> x is null)").select("object_type", "object_no", F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(2).offsets.to_numpy()) if batch.num_rows else np.zeros(0, np.int64)
            for d, (names, q) in shared.value.items():
                own = batch.filter(pa.array(size == d))
                if not own.num_rows:
                    continue
                e = own.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)

                def blocks() -> Iterator[tuple[int, np.ndarray]]:
                    with np.errstate(all="ignore"):
                        of_e, of_q = np.sqrt((e * e).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
                        for at in range(0, len(q), ASKED_TOGETHER):
                            norms = of_q[at : at + ASKED_TOGETHER, None] * of_e[None]
                            zero = (of_q[at : at + ASKED_TOGETHER, None] == 0) | (of_e[None] == 0)
                            yield at, np.where(zero, 0.0, (q[at : at + ASKED_TOGETHER] @ e.T) / norms)

                yield from _answers(own, names, blocks(), min_score=min_score, limit=limit)

    return _everywhere(rows, asked, run, min_score=min_score, limit=limit)


def text_channel(index: DataFrame, entries: DataFrame, queries: DataFrame, *, min_score: float = 0.0, limit: int = 20, allowed: DataFrame | None = None, scoped: bool = True) -> DataFrame:
    """(query_no, object_type, object_no, score, rank) by the sum over distinct query bigrams of
    (1 + ln tf) ln(1 + N / df), N and df within scope and object type; strictly above ``min_score``.

    ``scoped=False`` looks in all graphs and versions; N and df are then those of the object type, and an object stored
    in several versions counts once, at its best.
    """
    at = SCOPE if scoped else []
    group = [*at, "object_type"]
    terms = queries.select("query_no", *at, F.explode(F.array_distinct(bigrams(F.col("text")))).alias("term"))
    sizes = entries.groupBy(*group).agg(F.count_distinct("object_no").alias("n"))
    wanted = _few(terms.select(*at, "term").distinct())
    # Postings are cut to the terms asked for before anything else is done with them.
    hits = index.join(wanted, [*at, "term"], "left_semi")
    # an index names a term once an object and scope, so that only counts go through the exchange
    df = hits.groupBy(*group, "term").agg((F.count(F.lit(1)) if scoped else F.count_distinct("object_no")).alias("df"))
    # what cannot count for any question is not weighed
    some = hits.join(_few(allowed.select("object_no").distinct()), "object_no", "left_semi") if allowed is not None and "query_no" in allowed.columns else hits
    weighed = some.join(df, [*group, "term"]).join(sizes, group).withColumn("w", (1 + F.ln("tf")) * F.ln(1 + F.col("n") / F.col("df")))
    weighed = restrict(weighed, allowed, [*at, "object_no"]) if allowed is not None and "query_no" not in allowed.columns else weighed
    if not scoped and min_score >= 0 and (allowed is None or "query_no" not in allowed.columns):
        return reduce(DataFrame.unionByName, [_text_everywhere(weighed, part, min_score=min_score, limit=limit) for part in _in_turn(terms)])
    scored = weighed.join(terms, [*at, "term"]).groupBy("query_no", *SCOPE, "object_type", "object_no") if scoped else weighed.join(terms, "term").groupBy("query_no", *SCOPE, "object_type", "object_no")
    scored = scored.agg(F.round(F.sum("w"), 6).alias("score"))
    if not scoped:
        scored = scored.groupBy("query_no", "object_type", "object_no").agg(F.max("score").alias("score"))
    if allowed is not None and "query_no" in allowed.columns:
        scored = restrict(scored, allowed, ["query_no", "object_no"])
    return ranked(scored.filter(F.col("score") > min_score), by=["query_no", "object_type"], limit=limit)


def vector_channel(entries: DataFrame, queries: DataFrame, *, min_score: float = 0.0, limit: int = 20, allowed: DataFrame | None = None, scoped: bool = True) -> DataFrame:
    """(query_no, object_type, object_no, score, rank) by cosine, strictly above ``min_score``; rows and queries without
    an embedding take no part. ``scoped=False`` compares the queries with the entries of all graphs and versions."""
    usable = entries.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select(*SCOPE, "object_type", "object_no", "embedding")
    asked = queries.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("query_no", *SCOPE, F.col("embedding").alias("q"))
    if allowed is not None and "query_no" in allowed.columns:
        # only the pairs that may count are scored
        pairs = allowed.select("query_no", "object_no").distinct().join(asked, "query_no")
        met = usable.join(pairs, [*SCOPE, "object_no"]) if scoped else usable.join(pairs.drop(*SCOPE), "object_no")
    elif not scoped and min_score >= 0:
        few = restrict(usable, allowed, [*SCOPE, "object_no"])
        return reduce(DataFrame.unionByName, [_vector_everywhere(few, part, min_score=min_score, limit=limit) for part in _in_turn(asked)])
    elif scoped:
        met = restrict(usable, allowed, [*SCOPE, "object_no"]).join(_few(asked), SCOPE)
    else:
        # the stated questions against every entry, through one key that all share
        met = restrict(usable, allowed, [*SCOPE, "object_no"]).withColumn("all", F.lit(1)).join(_few(asked.drop(*SCOPE)).withColumn("all", F.lit(1)), "all")
    scored = met.select("query_no", "object_type", "object_no", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    if not scoped:
        scored = scored.groupBy("query_no", "object_type", "object_no").agg(F.max("score").alias("score"))
    return ranked(scored.filter(F.col("score") > min_score), by=["query_no", "object_type"], limit=limit)


def hybrid_search(
    index: DataFrame, entries: DataFrame, queries: DataFrame, *, min_text: float = 0.0, min_vector: float = 0.0, limit: int = 20, allowed: DataFrame | None = None, scoped: bool = True
) -> DataFrame:
    """(query_no, object_type, object_no, score, rank): both channels cut to ``limit`` and fused; a query without an
    embedding is answered by text alone."""
    how = {"limit": limit, "allowed": allowed, "scoped": scoped}
    text = text_channel(index, entries, queries, min_score=min_text, **how).withColumn("list_no", F.lit(0))
    vector = vector_channel(entries, queries, min_score=min_vector, **how).withColumn("list_no", F.lit(1))
    keep = ["query_no", "object_type", "list_no", "object_no", "rank"]
    return reciprocal_rank_fusion(text.select(*keep).unionByName(vector.select(*keep)), by=["query_no", "object_type"], top_k=limit)
