"""The k most similar vectors of every vector, from few long lists that are searched through cells in memory.

Centroids are fitted on a bounded sample and heavy clusters split by further centroids. Every vector goes to the list of its
nearest centroid and to those nearly as near. The longer the lists, the fewer the borders between a vector and its
neighbours, so lists are as long as a task can hold; within one, each vector enters several of many overlapping cells, and
only the vectors of a cell are compared. Lists that the sample says are longer are dealt to parts and read part by part;
large tables go through the exchange some lists at a time. Equal directions are searched once and share the answer.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

#: Vectors the centroids are fitted on: so many a list within these bounds, taken by a hash of the id; every vector is indexed.
FIT_A_LIST, FIT_LEAST, FIT_MOST = 16, 20_000, 65_536
#: Vectors a list aims at, vectors and lists that are worth having several lists for small tables, and the greatest number of lists
#: (bounds what is broadcast: 32,768 x dim x 4 bytes and the links).
LIST_ROWS, SPREAD_ROWS, SPREAD_LISTS, MAX_LISTS = 65_536, 4096, 24, 32_768
#: Clusters of more than this many times the mean are split by further centroids.
HEAVY = 2.0
#: Postings and queries worked on together.
MAX_LIST = 1 << 19
#: Lists of a vector: those whose centroid's cosine is at most so much below the nearest one's, and their greatest number.
MARGIN, LISTS = 0.10, 5
#: Centroids that are all compared with a vector; more are searched through the graph.
SCANNED = 8192
#: Rows of a list up to which all pairs are compared; beyond, the cells of a row, the rows a cell aims at and those compared together.
PLAIN, CELLS, CELL_ROWS, BLOCK = 4096, 10, 512, 1024
#: Answers held before the repeats among them are dropped.
HELD = 4 << 20
#: Copies of vectors that one exchange may hold anyway, and those for each vector beyond which the lists are taken in turns.
TURN_ROWS, TURN_COPIES = 4_000_000, 1.5
#: Ids that are broadcast; more are joined by an exchange.
BROADCAST_IDS = 1_000_000
#: Beam and degree of the centroid graph.
BEAM, DEGREE = 16, 16
#: Vectors that search the graph together, and cosines held at once when its links are made or it is scanned: both bound memory, not results.
TOGETHER, COSINES = 2048, 1 << 22


class CentroidGraph:
    """Centroids with links to near and to a few far ones; searched by a beam for many queries at once."""

    def __init__(self, centroids: np.ndarray, seed: int = 5):
        self.c = centroids
        k = len(centroids)
        rng = np.random.default_rng(seed)
        near = min(DEGREE, k - 1)
        self.links = np.zeros((k, near + 4), np.int32)
        step = min(1024, max(1, COSINES // k))
        for at in range(0, k if near else 0, step):
            s = centroids[at : at + step] @ centroids.T
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -9
            # copied out, as a slice would keep the whole block of k numbers a row
            self.links[at : at + step, :near] = np.argpartition(-s, near - 1, axis=1)[:, :near]
        self.links[:, near:] = rng.integers(0, k, size=(k, 4))
        # entry points spread over the collection: a coarse net of about sqrt(k) centroids
        self.entry = rng.permutation(k)[: max(BEAM, int(4 * np.sqrt(k)))].astype(np.int32)

    def search(self, q: np.ndarray, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, cosines) of the nearest found, best first, for unit queries."""
        n, k = len(q), len(self.c)
        width = min(width, k)
        first = q @ self.c[self.entry].T
        take = min(width, len(self.entry))
        best = np.argpartition(-first, take - 1, axis=1)[:, :take]
        beam = self.entry[best]
        score = np.take_along_axis(first, best, axis=1)
        expanded = np.zeros((n, k), dtype=bool)
        row = np.arange(n)[:, None]
        for _ in range(64):
            fresh = ~expanded[row, beam]
            if not fresh.any():
                break
            # the two best unexpanded members of every beam are expanded
            order = np.argsort(np.where(fresh, -score, 9), axis=1)[:, :2]
            pick = np.take_along_axis(beam, order, axis=1)
            expanded[row, pick] = True
            more = self.links[pick].reshape(n, -1)
            s = np.einsum("nd,nmd->nm", q, self.c[more])
            beam = np.concatenate([beam, more], axis=1)
            score = np.concatenate([score, s], axis=1)
            # one entry a centroid: sort by number, blank repeats
            o = np.argsort(beam, axis=1, kind="stable")
            beam, score = np.take_along_axis(beam, o, 1), np.take_along_axis(score, o, 1)
            score[:, 1:][beam[:, 1:] == beam[:, :-1]] = -9
            o = np.argsort(-score, axis=1, kind="stable")[:, :width]
            beam, score = np.take_along_axis(beam, o, 1), np.take_along_axis(score, o, 1)
            if not (~expanded[row, beam[:, : max(width // 2, 1)]]).any():
                break
        return beam, score


def _means(x: np.ndarray, c: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, label of every row) of spherical k-means; clusters that run empty restart at the rows worst served."""
    label, fit = np.zeros(len(x), np.int64), np.zeros(len(x), np.float32)
    for number in range(rounds + 1):
        for at in range(0, len(x), 4096):
            s = x[at : at + 4096] @ c.T
            label[at : at + 4096] = s.argmax(1)
            fit[at : at + 4096] = s.max(1)
        if number == rounds:
            return c, label
        order = np.argsort(label, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(label[order]) > 0]))
        c = c.copy()
        c[label[order][heads]] = np.add.reduceat(x[order], heads, axis=0)
        empty = np.setdiff1d(np.arange(len(c)), label)
        c[empty] = x[np.argsort(fit)[: len(empty)]]
        norm = np.linalg.norm(c, axis=1, keepdims=True)
        c = np.where(norm > 0, c / np.maximum(norm, 1e-12), x[:1]).astype(np.float32)
    raise AssertionError


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """About k centroids in balance: k-means in two layers (as many clusters as lists of each), then every cluster that holds more than
    HEAVY times the mean is split in two until none does or its rows are alike."""
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float32)
    k = min(k, len(x))
    if k <= 1024:
        c, label = _means(x, x[rng.permutation(len(x))[:k]], rounds)
        groups = [np.flatnonzero(label == i) for i in range(k)]
    else:
        coarse = int(np.sqrt(k))
        _, label = _means(x, x[rng.permutation(len(x))[:coarse]], rounds)
        groups = []
        for i in range(coarse):
            own = np.flatnonzero(label == i)
            part = max(1, round(k * len(own) / len(x)))
            if len(own):
                _, inner = _means(x[own], x[own][rng.permutation(len(own))[:part]], rounds)
                groups += [own[inner == j] for j in range(min(part, len(own)))]
    most = max(2, HEAVY * len(x) / k)
    done: list[np.ndarray] = []
    while groups:
        own = groups.pop()
        if len(own) > most:
            _, half = _means(x[own], x[own][rng.permutation(len(own))[:2]], 4)
            if 0 < half.sum() < len(own):
                groups += [own[half == 0], own[half == 1]]
                continue
        if len(own):
            done.append(own)
    c = np.stack([x[own].mean(axis=0) for own in done])
    norm = np.linalg.norm(c, axis=1, keepdims=True)
    return np.where(norm > 0, c / np.maximum(norm, 1e-12), x[:1]).astype(np.float32)


def choose_lists(graph: CentroidGraph, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, role) of unit vectors, the nearest list of a row first; role 1 is posted to the list, 2 asks it, 3 both."""
    k = len(graph.c)
    take = min(LISTS, k)
    # a search holds a mark for every vector and centroid, a scan a cosine and a place
    step = TOGETHER if k > SCANNED else max(1, min(TOGETHER, COSINES // 4 // k))
    near, score = [np.zeros((0, take), np.int64)], [np.zeros((0, take), np.float32)]
    for at in range(0, len(units), step):
        if k > SCANNED:
            n, s = (x[:, :take] for x in graph.search(units[at : at + step]))
        else:
            whole = units[at : at + step] @ graph.c.T
            n = np.argpartition(whole, k - take, axis=1)[:, k - take :]
            s = np.take_along_axis(whole, n, 1)
            order = np.argsort(-s, axis=1, kind="stable")
            n, s = np.take_along_axis(n, order, 1), np.take_along_axis(s, order, 1)
        near.append(n.astype(np.int64))
        score.append(s)
    near, score = np.concatenate(near), np.concatenate(score)
    r, c = np.nonzero((score >= score[:, :1] - MARGIN) & (score > -5))
    return r, near[r, c], np.full(len(r), 3, np.int8)


_MIX = np.random.default_rng(11).integers(0, 1 << 63, size=(2, 4096), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _usable(rows: DataFrame, dim: int, id_col: str, vector: str) -> DataFrame:
    usable = rows.filter(f"{id_col} is not null and size({vector}) = {dim} and not exists({vector}, x -> x is null)")
    return usable.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def _without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is not among the written ids; these are few as a rule, and then the rows need no exchange."""
    return rows.join(F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids, "id", "left_anti")


def _units(batch: pa.RecordBatch, dim: int) -> tuple[pa.Array, np.ndarray]:
    """(ids, unit vectors) of the rows whose numbers are finite and not all zero."""
    m = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(all="ignore"):
        peak = np.abs(m).max(axis=1) if len(m) else np.zeros(0)
        scaled = m / np.where(peak > 0, peak, 1)[:, None]
        norm = np.linalg.norm(scaled, axis=1)
        ok = np.isfinite(norm) & (norm > 0)
        return batch.column(0).filter(pa.array(ok)), scaled[ok] / norm[ok][:, None]


def _binary(m: np.ndarray) -> pa.Array:
    """One binary value a row of a float32 matrix, without a loop."""
    m = np.ascontiguousarray(m, dtype=np.float32)
    offsets = (np.arange(len(m) + 1) * m.shape[1] * 4).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(m)])


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    parts = [np.zeros((0, dim), np.float32)]
    for p in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(p):
            ends = np.frombuffer(p.buffers()[1], np.int32)[p.offset : p.offset + len(p) + 1]
            parts.append(np.frombuffer(p.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.float32).reshape(-1, dim))
    return np.concatenate(parts)


def _first(asker: np.ndarray, other: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k answers of every asker, repeats left out."""
    _, once = np.unique(asker * len(ids) + other, return_index=True)
    asker, other, score = asker[once], other[once], score[once]
    order = np.lexsort((ids[other], -score, asker))
    asker, other, score = asker[order], other[order], score[order]
    kept = np.arange(len(asker)) - np.searchsorted(asker, asker, "left") < k
    return asker[kept], other[kept], score[kept]


def cells_of(units: np.ndarray, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the cells every row enters, in order of the cells. A cell stands for a pair of directions, one of each of two
    sets; a row enters those where the sum of both is greatest, so that like rows share cells."""
    n, dim = units.shape
    side = max(4, int(np.ceil(np.sqrt(n * CELLS / CELL_ROWS))))
    rng = np.random.default_rng(seed)
    ways = rng.normal(size=(2, side, dim)).astype(np.float32)
    ways /= np.linalg.norm(ways, axis=2, keepdims=True)
    centre = units.mean(axis=0)
    best = min(side, CELLS)
    i, j = np.divmod(np.arange(best * best), best)
    # the cell of the places i and j (from 0) is outdone by (i + 1)(j + 1) - 1 others
    able = (i + 1) * (j + 1) <= CELLS
    i, j = i[able], j[able]
    cells = np.empty((n, CELLS), np.int32)
    for at in range(0, n, 4096):
        v = units[at : at + 4096] - centre
        place, value = [], []
        for w in ways:
            s = v @ w.T
            o = np.argpartition(s, side - best, axis=1)[:, side - best :]
            t = np.take_along_axis(s, o, 1)
            order = np.argsort(-t, axis=1)
            place.append(np.take_along_axis(o, order, 1))
            value.append(np.take_along_axis(t, order, 1))
        total = value[0][:, i] + value[1][:, j]
        o = np.argpartition(total, len(i) - CELLS, axis=1)[:, len(i) - CELLS :]
        cells[at : at + 4096] = np.take_along_axis(place[0][:, i], o, 1) * side + np.take_along_axis(place[1][:, j], o, 1)
    flat = cells.ravel()
    order = np.argsort(flat, kind="stable")
    return order // CELLS, flat[order]


def score_list(ids: np.ndarray, role: np.ndarray, units: np.ndarray, *, k: int, min_score: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, other, cosine) of the first k postings for every asker of a list; repeated rows count once. All pairs of a short
    list are compared, of a longer one those that share a cell."""
    _, first = np.unique(ids * 4 + role, return_index=True)
    ids, role, units = ids[first], role[first], units[first]
    if len(ids) <= PLAIN:
        row, edge = np.arange(len(ids)), np.array([0, len(ids)])
    else:
        row, cell = cells_of(units)
        edge = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
    asks, posted = role & 2 > 0, role & 1 > 0
    least = max(min_score - 1e-5, -5)
    out, held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
    for start, end in zip(edge[:-1], edge[1:]):
        own = row[start:end]
        qs, ps = own[asks[own]], own[posted[own]]
        pv = units[ps]
        for at in range(0, len(qs) if len(ps) else 0, BLOCK):
            q = qs[at : at + BLOCK]
            s = (pv if len(q) == len(ps) == len(own) else units[q]) @ pv.T  # the product with itself takes half the time
            hit = np.flatnonzero(s >= least)
            if len(hit) > 4 * (k + 1) * len(q):
                # everything that rounding could put among the first k, a row itself aside, is looked at again in double precision
                s[ids[q][:, None] == ids[ps][None, :]] = -9
                kth = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -5, np.float32)
                hit = np.flatnonzero(s >= np.maximum(kth - 1e-5, least)[:, None])
            r, c = np.divmod(hit, len(ps))
            a, b = q[r], ps[c]
            other = ids[a] != ids[b]
            a, b = a[other], b[other]
            exact = np.round(np.einsum("nd,nd->n", units[a].astype(np.float64), units[b].astype(np.float64)), 7)
            good = exact >= min_score
            out.append(_first(a[good], b[good], exact[good], ids, k) if len(hit) > 4 * (k + 1) * len(q) else (a[good], b[good], exact[good]))
            held += len(out[-1][0])
        if held > HELD:
            out = [_first(*(np.concatenate(x) for x in zip(*out)), ids, k)]
            held = len(out[0][0]) // 2
    a, b, exact = _first(*(np.concatenate(x) for x in zip(*out)), ids, k)
    return ids[a], ids[b], exact


def nearest(rows: DataFrame, *, k: int = 5, dim: int = 64, min_score: float = -1.0, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, neighbour, score, rank) of the k most similar others of every usable row, by cosine.

    Only neighbours of at least ``min_score`` are returned. Equal cosines (to seven digits) go to the smaller id. Null,
    empty, all-zero, non-finite and wrong-sized vectors are neither queries nor neighbours; copies and scaled copies
    (to nine digits of the unit vector) are neighbours of cosine 1; ids are taken to be distinct and repeated rows count
    once; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "neighbours")
    source = _usable(rows, dim, id_col, vector)

    def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, unit = _units(batch, dim)
            whole = np.round(unit * 1e9).astype(np.int64).view(np.uint64)
            h = [np.zeros(len(whole), np.uint64) for _ in range(2)]
            for j in range(dim):
                for i in range(2):
                    h[i] = (h[i] ^ (whole[:, j] * _MIX[i, j % 4096])) * np.uint64(0x9E3779B97F4A7C15)
                    h[i] ^= h[i] >> np.uint64(29)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.view(np.int64)) for x in h)], names=["id", "d1", "d2"])

    light = scratch.write(source.mapInArrow(directions, "id bigint, d1 bigint, d2 bigint")).distinct()
    sets = light.groupBy("d1", "d2").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n"))
    total = sets.count()
    empty = spark.createDataFrame([], "id bigint, neighbour bigint, score double, rank int")
    if not total:
        return empty
    # rows that share their direction with a smaller id; few as a rule, so the vectors need no exchange for this
    copies = scratch.write(light.join(sets.filter("n > 1"), ["d1", "d2"]).select("lead", "id"))
    leaders = _without(source, copies.filter("id <> lead").select("id"))
    lists = int(min(MAX_LISTS, max(1, -(-total // LIST_ROWS), min(SPREAD_LISTS, total // SPREAD_ROWS))))
    wanted = int(min(FIT_MOST, max(FIT_LEAST, FIT_A_LIST * lists)))
    bound = F.lit(min(wanted, total) * (2**63 - 1) // total)

    def as_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, unit = _units(batch, dim)
            yield pa.RecordBatch.from_arrays([ids, _binary(unit)], names=["id", "unit"])

    drawn = leaders.filter(F.xxhash64("id").bitwiseAND(F.lit(2**63 - 1)) <= bound).mapInArrow(as_units, "id bigint, unit binary").toArrow()
    ids, sample = drawn.column("id").to_numpy(), _matrix(drawn.column("unit"), dim)
    sample = sample[np.argsort(ids, kind="stable")]
    if not len(sample):  # so few vectors that the hash drew none
        drawn = leaders.orderBy("id").limit(1).mapInArrow(as_units, "id bigint, unit binary").toArrow()
        sample = _matrix(drawn.column("unit"), dim)
    graph = CentroidGraph(fit_centroids(sample, lists))
    # what the sample's lists hold, scaled up, says how many parts a list is dealt to
    _, where, role = choose_lists(graph, sample)
    scale = total / len(sample) / MAX_LIST
    parts, blocks = (np.maximum(1, np.ceil(np.bincount(where[role & bit > 0], minlength=len(graph.c)) * scale)).astype(np.int64) for bit in (1, 2))
    base = np.concatenate([[0], np.cumsum(parts * blocks)])
    copies_each = (parts + blocks - 1)[where].sum() / len(sample)
    turns = 1 if total * copies_each <= TURN_ROWS else int(np.ceil(copies_each / TURN_COPIES))
    shared = spark.sparkContext.broadcast((graph, parts, blocks, base))

    def assign(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph, parts, blocks, base = shared.value
            for batch in batches:
                ids, unit = _units(batch, dim)
                unit, number = unit.astype(np.float32), ids.to_numpy()
                for at in range(0, len(unit), TOGETHER):
                    r, where, role = choose_lists(graph, unit[at : at + TOGETHER])
                    now = where % turns == turn
                    r, where, role = r[now], where[now], role[now]
                    own = (number[at : at + TOGETHER][r].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                    p, b = (own % parts[where].astype(np.uint64)).astype(np.int64), (own % blocks[where].astype(np.uint64)).astype(np.int64)
                    # a posting lies in its part, for every block of askers; an asker in its block, for every part
                    spread = parts[where] * blocks[where]
                    i = np.repeat(np.arange(len(r)), spread)
                    cell = np.arange(len(i)) - np.repeat(np.cumsum(spread) - spread, spread)
                    there = np.where(cell // blocks[where[i]] == p[i], 1, 0) | np.where(cell % blocks[where[i]] == b[i], 2, 0)
                    there &= role[i]
                    hit = np.flatnonzero(there)
                    i, cell, there = i[hit], cell[hit] + base[where[i[hit]]], there[hit]
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(number[at : at + TOGETHER][r[i]] * 4 + there), _binary(unit[at : at + TOGETHER][r[i]])], names=["cell", "who", "unit"])

        return run

    def score(table: pa.Table) -> pa.Table:
        who = table.column("who").to_numpy()
        out = score_list(who >> 2, (who & 3).astype(np.int8), _matrix(table.column("unit"), dim), k=k, min_score=min_score)
        return pa.table([pa.array(x) for x in out], names=["id", "other", "score"])

    def turned(turn: int) -> DataFrame:
        return leaders.mapInArrow(assign(turn), "cell bigint, who bigint, unit binary").groupBy("cell").applyInArrow(score, "id bigint, other bigint, score double")

    found = turned(0) if turns == 1 else scratch.write(turned(0))
    for turn in range(1, turns):
        # what the exchange before has left on disk goes with the driver's garbage
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        found = found.unionByName(scratch.write(turned(turn)))
    # A neighbour stands for its copies, of which the first k + 1 can be wanted; the limit works before the exchange, too.
    first = copies.withColumn("r", F.row_number().over(Window.partitionBy("lead").orderBy("id"))).filter(F.col("r") <= k + 1)
    sets_ = scratch.write(first.groupBy("lead").agg(F.sort_array(F.collect_list("id")).alias("members")))
    members = F.explode(F.coalesce("members", F.array("stands"))).alias("neighbour")
    others = found.select(F.col("id").alias("asker"), F.col("other").alias("stands"), "score").join(sets_.withColumnRenamed("lead", "stands"), "stands", "left").select(F.col("asker").alias("lead"), members, "score")
    same = first.select("lead", F.col("id").alias("neighbour"), F.lit(1.0).alias("score"))
    # one exchange by the asker serves the removal of repeats and the ranking
    answer = others.unionByName(same).repartition("lead").groupBy("lead", "neighbour").agg(F.max("score").alias("score"))
    answer = scratch.write(answer.withColumn("r", F.row_number().over(Window.partitionBy("lead").orderBy(F.desc("score"), "neighbour"))).filter(F.col("r") <= k + 1))
    many = answer.join(copies.select("lead", "id"), "lead").filter("id <> neighbour")
    many = many.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("r"))).select("id", "neighbour", "score", "r")
    single = answer.join(sets_.select("lead"), "lead", "left_anti").select(F.col("lead").alias("id"), "neighbour", "score", "r")
    return single.unionByName(many).filter((F.col("r") <= k) & (F.col("score") >= min_score)).withColumnRenamed("r", "rank")


def latest_entries(index: DataFrame) -> DataFrame:
    """(id, embedding) of the latest row of every object; equal times go to the greater id.

    What is exchanged are keys and times; the rows that are outdated are removed from the table by their ids.
    """
    keys = ["graph_no", "graph_version", "object_type", "object_no"]
    last = index.groupBy(*keys).agg(F.max(F.struct("updated_at", "id")).alias("x"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    stale = index.select(*keys, "id").join(last.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("x.id").alias("last")), same).filter("id <> last").select("id")
    return _without(index.select("id", "embedding"), Scratch(index.sparkSession, "stale").write(stale))


def similar_pairs(index: DataFrame, *, k: int = 5, min_score: float = 0.85) -> DataFrame:
    """(id_a, id_b) where either is among the k most similar of the other with at least ``min_score``."""
    found = nearest(latest_entries(index), k=k, min_score=min_score)
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
