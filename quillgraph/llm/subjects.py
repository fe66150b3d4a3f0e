"""Subject areas of documents, from subject-specific interpolated n-gram language models.

The models are fitted on the sentences of a bounded sample of labelled documents. Labels name documents, not sentences,
and some are wrong, so fitting alternates between assigning sentences by cross-entropy and estimating the models from
the assigned sentences. The background model counts the whole corpus. A sentence is about the subject whose model needs
clearly fewer nats for it than the background; a document has the subjects of
at least a quarter of the sentences of its main body.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch
from .boilerplate import THRESHOLD, _Tables, block_net, line_features
from .tokenize import _LETTER, _NUMBER, _SPACE

#: Label rows the models are fitted on, at most.
FIT_LABELS = 6000
#: Code points of labelled texts the models are fitted on, at most; label rows beyond are left out of the fit.
FIT_CHARS = 20_000_000
#: Bins a nat in the histogram of all sentences' gains that acceptance is calibrated on, and the nats it ends at.
BINS, FAR = 256, 1000
#: Pseudo-count that ties the bigrams to the unigrams and these to the background.
K = 4.0
#: Rounds of sentence assignment, and the gain from which a sentence is clearly about a subject while fitting.
ROUNDS, CLEAR = 3, 3.5
#: Code points worked on at once; a longer text is still taken whole, alone.
BATCH_CHARS = 1_000_000
#: Sentences whose gains are summed at once, and counts of the vocabulary written in one row.
STEP, COUNTS = 8192, 65_536
_ENDERS = np.array([ord(c) for c in ".?!。？！"], dtype=np.uint32)
_WIDE_ENDERS = np.array([ord(c) for c in "。？！"], dtype=np.uint32)
_OPENERS = np.array([ord(c) for c in "-–*•#>`"], dtype=np.uint32)
#: Lines shorter than this (code points; with ideographs) that do not end a sentence stand alone.
SHORT_LINE, SHORT_WIDE_LINE = 50, 25


@dataclass
class Sentences:
    """Words of all sentences: hash of each word and of its pair with the word before, sentence of each word; text and
    whether it is a full sentence, by sentence."""

    word: np.ndarray
    pair: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    full: np.ndarray


def cut_sentences(texts: list[str]) -> Sentences:
    """Sentences of texts that hold main body only; code between fences is left out."""
    kind_of, _, lower_of, _ = _Tables.get()
    joined = "".join(t.replace("\r", "") + "\n\n" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    n = len(codes)
    if not n:
        z = np.zeros(0, np.int64)
        return Sentences(z, z, z, z, np.zeros(0, bool))
    lengths = np.array([len(t) - t.count("\r") + 2 for t in texts], dtype=np.int64)
    text_end = np.cumsum(lengths)
    kind = kind_of[codes]
    cjk = (codes >= 0x3400) & (codes <= 0x9FFF)
    feeds = np.flatnonzero(codes == 10)
    line_begin = np.concatenate([[0], feeds[:-1] + 1])
    solid = np.flatnonzero(kind != _SPACE)
    first = solid[np.minimum(np.searchsorted(solid, line_begin), len(solid) - 1)] if len(solid) else line_begin
    blank = (first >= feeds) | (first < line_begin) if len(solid) else np.ones(len(feeds), bool)
    head = np.where(blank, 0, codes[first])
    wide = np.add.reduceat(np.append(cjk, False).astype(np.int32), line_begin) > 0
    size = feeds - line_begin
    fence = ~blank & (head == 96) & (codes[np.minimum(first + 1, n - 1)] == 96)
    line_text = np.searchsorted(text_end, line_begin, "right")
    fences = np.cumsum(fence)
    begin_of_text = np.concatenate([[0], np.searchsorted(line_begin, text_end[:-1])]) if len(texts) else np.zeros(0, int)
    before_text = np.concatenate([[0], fences])[begin_of_text]
    code = fence | ((fences - before_text[line_text]) % 2 == 1)
    # a line feed ends a sentence unless the line is long and the next goes on, or both are one quotation
    next_head = np.append(head[1:], 0)
    next_blank = np.append(blank[1:], True)
    goes_on = ~next_blank & ~np.isin(next_head, _OPENERS) & (size >= np.where(wide, SHORT_WIDE_LINE, SHORT_LINE)) & ~np.append(code[1:], True) & ~code
    goes_on |= ~blank & (head == 62) & (next_head == 62)
    cut = np.zeros(n, dtype=bool)
    cut[feeds[~goes_on]] = True
    enders = np.flatnonzero(np.isin(codes, _ENDERS))
    following = kind[np.minimum(enders + 1, n - 1)] == _SPACE
    ends = enders[following | np.isin(codes[enders], _WIDE_ENDERS)]
    cut[ends] = True
    number = np.cumsum(cut) - cut  # the mark belongs to the sentence it ends
    total = int(number[-1]) + 1
    ended = np.zeros(total, dtype=bool)
    ended[number[ends]] = True

    inside = (kind == _LETTER) | (kind == _NUMBER)
    start = inside & (np.concatenate([[9], kind[:-1]]) != kind)
    start |= cjk | ((kind == _LETTER) & np.concatenate([[False], cjk[:-1]]))
    w = np.flatnonzero(start)
    run = np.cumsum(start) - 1
    place = np.arange(n) - w[np.maximum(run, 0)] if len(w) else np.zeros(n, np.int64)
    value = np.where(kind == _NUMBER, np.where(place > 0, 0, 8), lower_of[codes].astype(np.int64) + 1)
    mixed = value * ((place * 2 + 1) * 0x9E3779B1 + 0x7F4A7C15)
    mixed ^= mixed >> 15
    mixed *= 0x2C1B3C6D
    mixed ^= mixed >> 29
    word = np.add.reduceat(np.where(inside, mixed, 0), w) if len(w) else np.zeros(0, np.int64)
    sentence = number[w]
    if code.any():
        keep = ~code[np.searchsorted(feeds, w)]
        word, sentence = word[keep], sentence[keep]
    before = np.concatenate([[0], word[:-1]])
    if len(word):
        before[np.concatenate([[True], np.diff(sentence) > 0])] = 17
    pair = before * 1_000_003 + word * 31
    pair ^= pair >> 23
    # only sentences with words stay
    used, words_in = np.unique(sentence, return_counts=True)
    text = np.searchsorted(text_end, _first_of(number, used), "right")
    return Sentences(word, pair, np.repeat(np.arange(len(used)), words_in), text, ended[used] & (words_in >= 3))


def _first_of(number: np.ndarray, used: np.ndarray) -> np.ndarray:
    return np.searchsorted(number, used, "left")


def main_body(texts: list[str], pages: list[bool]) -> list[str]:
    """The texts, web pages without the lines that are furniture."""
    spots = [i for i, p in enumerate(pages) if p and texts[i]]
    if not spots:
        return texts
    f = line_features([texts[i] for i in spots])
    hit = block_net().scores(f) > THRESHOLD
    drop: dict[int, set[int]] = {}
    for t, n in zip(f.text[hit].tolist(), f.number[hit].tolist()):
        drop.setdefault(t, set()).add(n)
    out = list(texts)
    for k, lines in drop.items():
        i = spots[k]
        out[i] = "\n".join(line for n, line in enumerate(texts[i].split("\n"), 1) if n not in lines)
    return out


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys, -1 for absent ones."""
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(len(sorted_keys) - 1, 0))
    return np.where(sorted_keys[at] == keys, at, -1) if len(sorted_keys) else np.full(len(keys), -1)


@dataclass
class SubjectModel:
    """Sorted vocabularies and, for every entry, the gain in nats of each subject's model over the background."""

    subjects: list[str]
    words: np.ndarray
    pairs: np.ndarray
    word_gain: np.ndarray
    pair_gain: np.ndarray

    def table(self) -> np.ndarray:
        """Gains of all pairs, then of all words, then zeros for what is unknown."""
        return np.concatenate([self.pair_gain, self.word_gain, np.zeros((1, self.word_gain.shape[1]), np.float32)])

    def gains(self, s: Sentences) -> np.ndarray:
        """(sentence, subject) gains over the background, summed over the words."""
        if not len(s.word):
            return np.zeros((0, len(self.subjects)), np.float32)
        heads = np.flatnonzero(np.concatenate([[True], np.diff(s.sentence) > 0]))
        row = _rows(_find(self.words, s.word), _find(self.pairs, s.pair), len(self.words), len(self.pairs))
        return np.concatenate(list(_summed(self.table(), row, heads)))


def _rows(u: np.ndarray, b: np.ndarray, words: int, pairs: int) -> np.ndarray:
    """Rows of a model's table from the places of words and pairs: that of the pair if known, else that of the word."""
    return np.where(b >= 0, b, np.where(u >= 0, pairs + u, pairs + words))


def _summed(table: np.ndarray, row: np.ndarray, heads: np.ndarray) -> Iterator[np.ndarray]:
    """Sums of the table's rows over sentences that begin at ``heads``, some sentences at a time, so that the gathered rows stay small."""
    for at in range(0, len(heads), STEP):
        a = heads[at]
        z = heads[at + STEP] if at + STEP < len(heads) else len(row)
        yield np.add.reduceat(table[row[a:z]], heads[at : at + STEP] - a, axis=0)


class _Estimator:
    """Weighted counts of the sample by subject, against the corpus counts of the same vocabulary."""

    def __init__(self, s: Sentences, language: np.ndarray, subjects: list[str]):
        self.s = s
        self.subjects = subjects
        self.language = language[s.text]
        self.size = np.bincount(s.sentence, minlength=len(s.text)).astype(np.float64)
        self.words, self.u = np.unique(s.word, return_inverse=True)
        self.pairs, self.b = np.unique(s.pair, return_inverse=True)
        # word of a pair, and the word before it by way of any of its places
        self.last_of = np.zeros(len(self.pairs), np.int64)
        self.last_of[self.b] = self.u
        before = np.concatenate([[-1], self.u[:-1]])
        before[np.concatenate([[True], np.diff(s.sentence) > 0])] = -1
        self.first_of = np.full(len(self.pairs), -1)
        self.first_of[self.b] = before

    def background(self, words: np.ndarray, pairs: np.ndarray, tokens: int, sentences: int) -> None:
        self.bg_word = np.maximum(words, 1) / max(tokens, 1)
        context = np.where(self.first_of >= 0, np.maximum(words[self.first_of], 1), max(sentences, 1))
        self.bg_pair = np.minimum(np.maximum(pairs, 1) / context, 1.0)

    def model(self, weight: np.ndarray) -> SubjectModel:
        """Models from (sentence, subject) weights.

        Within each subject the languages are weighed to their share of the sample, so that a subject labelled less
        often in one language does not look unlike that language. A word's weight between its own count and the level
        below depends on the count to be expected: (count + K level) / (expected + K).
        """
        k = weight.shape[1]
        mass = np.zeros((self.language.max() + 1, k))
        np.add.at(mass, self.language, weight * self.size[:, None])
        share = mass.sum(1) / max(mass.sum(), 1e-9)
        scale = np.clip(share[:, None] * mass.sum(0) / np.maximum(mass, 1e-9), 0.1, 10)
        weight = weight * scale[self.language]
        uni = np.zeros((len(self.words), k))
        bi = np.zeros((len(self.pairs), k))
        for c in range(k):
            x = weight[self.s.sentence, c]
            uni[:, c] = np.bincount(self.u, weights=x, minlength=len(self.words))
            bi[:, c] = np.bincount(self.b, weights=x, minlength=len(self.pairs))
        total = uni.sum(0)
        ratio = (uni + K) / (total * self.bg_word[:, None] + K)
        context = np.where((self.first_of >= 0)[:, None], uni[self.first_of], weight.sum(0))
        pair_ratio = (bi + K * ratio[self.last_of]) / (context * self.bg_pair[:, None] + K)
        return SubjectModel(self.subjects, self.words, self.pairs, np.log(ratio).astype(np.float32), np.log(pair_ratio).astype(np.float32))


def fit_model(s: Sentences, labels: list[set[str]], languages: list[str], subjects: list[str], counts) -> SubjectModel:
    """Model from sentences of labelled texts; ``counts`` maps (words, pairs) to the corpus counts of both, its tokens
    and its sentences.

    Expectation-maximisation over sentences: each belongs to the subjects in proportion to the likelihood their models
    give it and to what the labels say of its text. Sentences that no subject's model clearly explains stay with the
    labels of their text, which spreads what is said everywhere evenly over the subjects.
    """
    spelled, code = np.unique(np.array(languages), return_inverse=True)
    e = _Estimator(s, code, subjects)
    e.background(*counts(e.words, e.pairs))
    k = len(subjects)
    place = {x: i for i, x in enumerate(subjects)}
    prior = np.full((len(labels), k), 0.15 / k)
    for t, names in enumerate(labels):
        for x in names:
            prior[t, place[x]] += 0.85 / len(names)
    weight = prior[s.text]
    model = e.model(weight)
    for _ in range(ROUNDS):
        g = model.gains(s).astype(np.float64)
        p = np.exp(g - g.max(1, keepdims=True)) * prior[s.text]
        # what none of the subjects explains clearly better than the background is no evidence
        flat = 1 / (1 + np.exp(np.clip(2 * (g.max(1, keepdims=True) - CLEAR), -30, 30)))
        weight = (1 - flat) * p / p.sum(1, keepdims=True) + flat * prior[s.text]
        model = e.model(weight)
    return model


def _valley(x: np.ndarray, n: np.ndarray) -> float:
    """Threshold between two classes of normally distributed values, by minimum error; x ascending, each n times."""
    if n.sum() < 10:
        return CLEAR
    x = np.clip(x, *x[np.searchsorted(np.cumsum(n), np.array([0.005, 0.99]) * n.sum())])
    count, edge = np.histogram(x, bins=160, weights=n.astype(np.float64))
    middle = (edge[:-1] + edge[1:]) / 2
    n0, s0, q0 = (np.cumsum(count * middle**i) for i in range(3))
    n1, s1, q1 = n0[-1] - n0, s0[-1] - s0, q0[-1] - q0
    with np.errstate(all="ignore"):
        v0, v1 = q0 / n0 - (s0 / n0) ** 2, q1 / n1 - (s1 / n1) ** 2
        p0, p1 = n0 / n0[-1], n1 / n0[-1]
        cost = p0 * np.log(v0) + p1 * np.log(v1) - 2 * p0 * np.log(p0) - 2 * p1 * np.log(p1)
    cost[(p0 < 0.03) | (p1 < 0.03) | ~np.isfinite(cost)] = np.inf
    return float(edge[1:][cost.argmin()]) if np.isfinite(cost).any() else CLEAR


def _batches(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[str]]]:
    texts = batch.column(column).to_pylist()
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS or i == len(texts) - 1:
            yield at, i + 1, texts[at : i + 1]
            at, size = i + 1, 0


class _Corpus:
    """Main body of the whole corpus (doc_id, text, page), cut into sentences once.

    Called with the words and pairs of the sample it counts both over all sentences, and writes the full sentences of
    every document to ``scratch`` as rows of a model's table, so that their gains need no texts.
    """

    def __init__(self, texts: DataFrame, scratch: Scratch):
        self.texts, self.scratch = texts, scratch

    def __call__(self, words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
        shared = self.texts.sparkSession.sparkContext.broadcast((words, pairs))  # as large as the vocabulary of the bounded sample
        v, total = len(words), len(words) + len(pairs)
        longs = T.ArrayType(T.LongType())
        told = T.StructType([T.StructField("doc_id", self.texts.schema["doc_id"].dataType), T.StructField("row", T.BinaryType()), T.StructField("size", T.ArrayType(T.IntegerType())), T.StructField("place", longs), T.StructField("n", longs)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ws, ps = shared.value
            sums = np.zeros(total + 2, np.int64)
            for batch in batches:
                for at, end, part in _batches(batch, 1):
                    s = cut_sentences(main_body(part, batch.column(2).slice(at, end - at).fill_null(False).to_pylist()))
                    u, b = _find(ws, s.word), _find(ps, s.pair)
                    sums[:v] += np.bincount(u[u >= 0], minlength=v)
                    sums[v:total] += np.bincount(b[b >= 0], minlength=total - v)
                    sums[total] += len(s.word)
                    sums[total + 1] += len(s.full)
                    # of every full sentence the table's rows, four bytes each, and how many they are
                    data = _rows(u, b, v, total - v)[s.full[s.sentence]].astype("<i4").tobytes()
                    size = np.bincount(s.sentence, minlength=len(s.full))[s.full].astype(np.int32)
                    edges = np.searchsorted(s.text[s.full], np.arange(end - at + 1))
                    byte = (4 * np.concatenate([[0], np.cumsum(size)])[edges]).tolist()
                    rows = pa.array([data[x:y] for x, y in pairwise(byte)], pa.binary())
                    none = pa.nulls(end - at, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), rows, pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(size)), none, none], names=told.names)
            some = np.flatnonzero(sums)
            if len(some):
                edges = pa.array([*range(0, len(some), COUNTS), len(some)], pa.int32())
                k = len(edges) - 1
                counts = [pa.ListArray.from_arrays(edges, pa.array(x, pa.int64())) for x in (some, sums[some])]
                yield pa.RecordBatch.from_arrays([pa.nulls(k, batch.schema.field(0).type), pa.nulls(k, pa.binary()), pa.nulls(k, pa.list_(pa.int32())), *counts], names=told.names)

        self.written = self.scratch.write(self.texts.mapInArrow(run, told))
        counts = self.written.filter(F.col("place").isNotNull()).select(F.inline(F.arrays_zip("place", "n"))).groupBy("place").agg(F.sum("n").alias("n")).toPandas()
        sums = np.zeros(total + 2, np.int64)
        sums[counts["place"].to_numpy()] = counts["n"].to_numpy()
        return sums[:v], sums[v:total], int(sums[total]), int(sums[total + 1])

    def sentences(self) -> DataFrame:
        """(doc_id, row, size) of every document."""
        return self.written.filter(F.col("size").isNotNull()).select("doc_id", "row", "size")


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, *, share: float = 0.25, fit_labels: int = FIT_LABELS, fit_chars: int = FIT_CHARS) -> DataFrame:
    """(doc_id, subject_no, share) of every document at least ``share`` of whose sentences are about a subject.

    The models are fitted on at most ``fit_labels`` label rows, taken in the order of a hash of label_id, whose texts
    have at most ``fit_chars`` code points together, which bounds what the driver holds; label
    spellings are trimmed and lower-cased, null and unknown ones are left out. Acceptance is calibrated on the sentences
    of all documents: their gains are written once, counted, and compared with the threshold that follows. Null, empty
    and blank texts have no subject; without labels or subjects the result is empty; repeated documents give one row; texts are read whole;
    the subject list is a parameter table of few rows. The texts are cut once, without a shuffle; what their words are in
    the vocabulary is written (four bytes a word) and dropped when the gains are.
    """
    spark = documents.sparkSession
    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("subject_no", T.StringType()), T.StructField("share", T.DoubleType())])
    names = sorted(r[0] for r in subjects.select("subject_no").distinct().collect() if r[0])
    spelled = {x.strip().lower(): x for x in names}
    clean = labels.select("label_id", "doc_id", F.lower(F.trim("subject_no")).alias("subject")).filter(F.col("subject").isin(list(spelled)) & F.col("doc_id").isNotNull())
    sample = clean.orderBy(F.xxhash64("label_id"), "label_id", "doc_id", "subject").limit(fit_labels)
    marks = sample.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    usable = documents.filter(F.col("text").rlike(r"(?U)\S")).select("doc_id", "text", (F.col("source") == "web").alias("page"), F.lower(F.trim(F.coalesce("lang", F.lit("")))).alias("lang"))
    # at most fit_labels rows, so the broadcast is bounded
    rows = usable.join(F.broadcast(marks), "doc_id")
    upto = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).filter(F.col("upto") <= fit_chars).drop("upto").orderBy("doc_id", "text").toPandas()
    rows["page"] = rows["page"].fillna(False).astype(bool)
    if not len(rows) or not names:
        return spark.createDataFrame([], schema)
    s = cut_sentences(main_body(rows["text"].tolist(), rows["page"].tolist()))
    scratch = Scratch(spark, "subjects")
    corpus = _Corpus(usable.select("doc_id", "text", "page"), scratch)
    model = fit_model(s, [{spelled[x] for x in v} for v in rows["subjects"]], rows["lang"].tolist(), names, corpus)
    shared = spark.sparkContext.broadcast(model.table())
    told = T.StructType([schema["doc_id"], T.StructField("best", T.ArrayType(T.FloatType())), T.StructField("subject", T.ArrayType(T.ShortType()))])

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            size = batch.column(2).flatten().to_numpy()
            best, subject = np.empty(len(size), np.float32), np.empty(len(size), np.int16)
            at = 0
            for g in _summed(table, np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4"), np.cumsum(size) - size):
                best[at : at + len(g)], subject[at : at + len(g)] = g.max(1), g.argmax(1)
                at += len(g)
            edges = pa.array(np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(edges, pa.array(x)) for x in (best, subject))], names=told.names)

    # the gain and subject of every full sentence, a few bytes each
    scored = scratch.write(corpus.sentences().mapInArrow(gains, told))
    scratch.drop(corpus.written)
    bins = scored.select(F.explode("best").alias("x")).groupBy(F.floor(F.greatest(F.least("x", F.lit(float(FAR))), F.lit(-float(FAR))) * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("bin")
    threshold = _valley((bins["bin"].to_numpy() + 0.5) / BINS, bins["n"].to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(names)
        for batch in batches:
            total = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ok = batch.column(1).flatten().to_numpy() > threshold
            row = np.repeat(np.arange(len(total)), total)[ok]
            hits = np.bincount(row * k + batch.column(2).flatten().to_numpy()[ok], minlength=len(total) * k).reshape(len(total), k)
            part = hits / np.maximum(total, 1)[:, None]
            t, c = np.nonzero((part >= share - 1e-9) & (hits > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(t)), pa.array([names[i] for i in c.tolist()], pa.string()), pa.array(part[t, c], pa.float64())], names=schema.names)

    found = scored.mapInArrow(run, schema)
    return found.groupBy("doc_id", "subject_no").agg(F.max("share").alias("share"))
