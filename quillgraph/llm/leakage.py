"""Held-out passages inside the training text, by suffix arrays over shards of the corpus.

Texts are reduced to their letters and digits (case, accents, width, spacing, punctuation, markup and escapes fall
away). Each shard sorts those of its suffixes that start with a stretch any test passage contains, which are the only
ones a test suffix can meet, by prefix doubling over ranks; every test suffix is then binary-searched in the sorted
suffixes and followed to the end of its longest match.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch

#: Code points of corpus text in one shard; a longer text is still taken whole, alone.
SHARD_CHARS = 1_000_000
#: Code points of test text sent to the executors at once; more test text is searched in further passes.
BLOCK_CHARS = 2_000_000
#: Matches followed to their ends at once.
PAIRS = 1_000_000

# Tags: anything short between angle brackets, or of any length a name with attributes that have values.
_MARKUP = re.compile(
    r"""</?[A-Za-z][^<>\x00]{0,400}>|<[A-Za-z][\w:.-]*(?:\s+[\w:.@-]+\s*=\s*(?:"[^"\x00]*"|'[^'\x00]*'|[^\s"'<>=\x00]+))+\s*/?>"""
    r"""|&(?:\#\d{1,7}|\#[xX][0-9a-fA-F]{1,6}|[A-Za-z]\w{1,30});|\\u[0-9a-fA-F]{4}|\\[nrtbf]|\]\((?:[^()\s\x00]|\([^()\s\x00]*\))+(?:\s+"[^"\x00]*")?\)|(?:%[0-9A-Fa-f]{2})+"""
)
_BARRIER = np.uint32(0xFFFFFFFF)
_DROP = np.uint32(0)
#: Odd multiplier of the rolling hash modulo 2**64, and its inverse.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_BITS = 22


def _expand(m: re.Match) -> str:
    s = m.group()
    if s[0] == "&":
        return html.unescape(s)
    if s[0] == "\\":
        return chr(int(s[2:], 16)) if s[1] == "u" else " "
    if s[0] == "%":
        raw = bytes.fromhex(s.replace("%", ""))
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            # an encoding of one byte a letter, or a percent sign before an ordinary word
            return raw.decode("latin-1") if s == s.upper() else s
    return ""


def _without_comments(s: str) -> str:
    """Text without what stands between comment marks; a mark that is not closed in its own text stays."""
    at, out, close, end = 0, [], -1, -1
    open_ = s.find("<!--")
    while open_ >= 0:
        if close < open_ + 4:
            close = s.find("-->", open_ + 4)
        if close < 0:
            break
        if end < open_:
            end = s.find("\x00", open_)
        if 0 <= end < close:
            open_ = s.find("<!--", end)
            continue
        out.append(s[at:open_])
        at = close + 3
        open_ = s.find("<!--", at)
    return "".join(out) + s[at:]


def resolve(text: str) -> str:
    """The text with escapes replaced by what they stand for and without markup."""
    if "<!--" in text:
        text = _without_comments(text)
    if "&" in text or "<" in text or "\\" in text or "](" in text or "%" in text:
        text = _MARKUP.sub(_expand, text)
    return text


def _folded(c: str) -> str:
    """Letters and digits of one character, without case, accents and presentation forms."""
    out = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", c).casefold())
    return "".join(x for x in out if unicodedata.category(x)[0] in "LN")


class _Folding:
    """Table from code point to folded code point; the few that fold to several are listed apart."""

    _one: np.ndarray | None = None
    _many: dict[int, str] = {}

    @classmethod
    def get(cls) -> tuple[np.ndarray, dict[int, str]]:
        if cls._one is None:
            one = np.zeros(0x110000, dtype=np.uint32)
            many: dict[int, str] = {}
            for c in range(0x323B0):
                if 0xD800 <= c <= 0xDFFF:
                    continue
                f = _folded(chr(c))
                if len(f) == 1:
                    one[c] = ord(f)
                elif f:
                    many[c] = f
                    one[c] = _BARRIER - 1
            cls._one, cls._many = one, many
        return cls._one, cls._many


def reduce_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, owner, place): folded letters and digits of all texts with a barrier after each, the number of the text
    and the position of each in its text after markup and escapes are resolved."""
    one, many = _Folding.get()
    joined = resolve("\x00".join(t.replace("\x00", " ") for t in texts) + "\x00")
    raw = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = one[raw]
    if (codes == _BARRIER - 1).any():
        joined = joined.translate(many)
        raw = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
        codes = one[raw]
    ends = np.flatnonzero(raw == 0)
    codes[ends] = _BARRIER
    kept = np.flatnonzero(codes != _DROP)
    owner = np.searchsorted(ends, kept).astype(np.int32)
    begin = np.concatenate([[0], ends[:-1] + 1])
    return codes[kept], owner, (kept - begin[owner]).astype(np.int32)


def _windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` codes from every position on (too short ends are left out)."""
    n = len(codes)
    if n < width:
        return np.zeros(0, np.uint64)
    powers, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[:n], out=total[1:])
    h = (total[width:] - total[:-width]) * inverse[: n - width + 1]
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("p", _P), ("i", _P_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def _first_in(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of every key in the sorted keys, -1 for absent ones."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _paired(ranks: np.ndarray, gap: int) -> np.ndarray:
    """For every position the ranks there and ``gap`` further on as one key, 0 where either has none."""
    out = np.zeros(len(ranks), np.int64)
    a, b = ranks[: max(len(ranks) - gap, 0)].astype(np.int64), ranks[gap:].astype(np.int64)
    out[: len(a)] = np.where((a > 0) & (b > 0), a << 32 | b, 0)
    return out


def _ranked(sorted_keys: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Rank from 1 of every key among the sorted ones, 0 for absent ones."""
    out = np.zeros(len(key), np.int32)
    some = np.flatnonzero(key)
    out[some] = _first_in(sorted_keys, key[some]) + 1
    return out


@dataclass
class TestSet:
    """Test passages of one block: the codes; for every test suffix its start, its needed length, its item and how far
    before it the item's former suffix starts (0 for the first); the windows of ``width`` codes by hash with their
    ranks in order of code points and a place where each stands; for every doubling the sorted keys of its windows and the
    ranks at all positions."""

    codes: np.ndarray
    start: np.ndarray
    need: np.ndarray
    item: np.ndarray
    back: np.ndarray
    width: int
    marks: np.ndarray
    openers: np.ndarray
    hashes: np.ndarray
    rank: np.ndarray
    seat: np.ndarray
    keys: list[np.ndarray]
    ranks: list[np.ndarray]


def opening_rows(item: int, lang: str | None, text: str, *, words: int, chars: int) -> list[tuple[int, str, int, str]]:
    """(item, opening, its length, what follows) of every stretch from the start of a text up to a full stop, colon or
    line break that is too short to be a case by itself."""
    out = []
    wide = (lang or "").strip().lower() == "zh"
    for m in re.finditer(r"[.:?!\n。：？！]\s*", text):
        head = text[: m.end()]
        if (len(re.sub(r"\W", "", head)) >= chars if wide else len(head.split()) >= words) or m.end() >= len(text):
            break
        rest = text[m.end() :]
        out.append((item, head, m.end(), rest[:8] if wide else " ".join(rest.split(None, 4)[:4])))
    return out


def build_test_set(items: list[tuple[int, str, str]], *, words: int, chars: int) -> TestSet | None:
    """Suffixes of (id, lang, text) items from every word start (zh: every character) that reach the needed length."""
    kept, start, need, item, back = [], [], [], [], []
    at = 0
    for number, lang, text in items:
        codes, _, place = reduce_texts([text])
        codes, place = codes[:-1], place[:-1]
        n = len(codes)
        if (lang or "").strip().lower() == "zh":
            s = np.arange(max(n - chars + 1, 0))
            k = np.full(len(s), chars)
        else:
            # words as written: stretches without blanks that hold a letter or digit
            spans = [m.span() for m in re.finditer(r"\S+", resolve(text).translate(_Folding.get()[1]))]
            first = np.searchsorted(place, [a for a, _ in spans])
            last = np.searchsorted(place, [b for _, b in spans])
            real = last > first
            first, last = first[real], last[real]
            m = len(first) - words + 1
            s = first[: max(m, 0)]
            k = last[words - 1 :][: len(s)] - s if len(s) else s
        kept.append(np.append(codes, _BARRIER))
        start.append(at + s)
        need.append(k)
        item.append(np.full(len(s), number, np.int64))
        back.append(np.diff(s, prepend=s[:1]))
        at += n + 1
    if not kept or not sum(map(len, start)):
        return None
    codes, start, need, item, back = map(np.concatenate, (kept, start, need, item, back))
    width = int(min(need.min(), chars))
    h = _windows(codes, width)
    ends = np.flatnonzero(codes == _BARRIER)
    spots = np.arange(len(h))
    spots = spots[spots + width <= ends[np.searchsorted(ends, spots)]]
    # ranks of the windows in order of code points, by doubling from single codes up to the width
    ranks = np.unique(codes, return_inverse=True)[1].astype(np.int32) + 1
    size = 1
    while size < width:
        gap = min(size, width - size)
        key = _paired(ranks, gap)
        ranks = np.unique(key, return_inverse=True)[1].astype(np.int32)
        ranks += 0 if (key == 0).any() else 1
        size += gap
    whole = np.zeros(len(codes), np.int32)
    whole[spots] = ranks[spots]
    hashes, seat = np.unique(h[spots], return_index=True)
    seat = spots[seat]
    keys, levels = [], [whole]
    longest = int(np.diff(ends, prepend=-1).max())
    gap = width
    while 2 * gap <= longest:
        key = _paired(levels[-1], gap)
        found = np.unique(key[key > 0])
        if not len(found):
            break
        keys.append(found)
        levels.append(_ranked(found, key))
        gap *= 2
    openers = np.unique(h[start])
    marks = np.zeros(1 << _BITS, dtype=bool)
    marks[(openers >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return TestSet(codes, start, need, item, back, width, marks, openers, hashes, whole[seat], seat, keys, levels)


def _match_lengths(test: TestSet, shard: list[np.ndarray], s: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Codes that the test suffixes at s and the shard's suffixes at p have in common, at least the width."""
    length = np.zeros(len(s), np.int64)
    step = test.width << len(test.keys)
    for a, b in zip(reversed(test.ranks), reversed(shard)):
        i, j = np.minimum(s + length, len(a) - 1), np.minimum(p + length, len(b) - 1)
        length += np.where((a[i] > 0) & (a[i] == b[j]), step, 0)
        step //= 2
    # what is left is shorter than a window: the furthest window that ends within it
    low, high = np.zeros(len(s), np.int64), np.full(len(s), test.width - 1)
    a, b = test.ranks[0], shard[0]
    base = length - test.width
    while (low < high).any():
        mid = (low + high + 1) // 2
        i, j = np.minimum(s + base + mid, len(a) - 1), np.minimum(p + base + mid, len(b) - 1)
        same = (a[i] > 0) & (a[i] == b[j])
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return length + low


def search_shard(test: TestSet, texts: list[str]) -> list[tuple[int, int, int, int]]:
    """(text, item, place, length) of the longest match of every text and item that reaches the needed length."""
    codes, owner, place = reduce_texts(texts)
    h = _windows(codes, test.width)
    spots = np.flatnonzero(test.marks[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
    spots = spots[_first_in(test.openers, h[spots]) >= 0]
    if not len(spots):
        return []
    # in the texts concerned, the suffixes that start with any window of the test, checked code by code
    touched = np.zeros(len(texts) + 1, dtype=bool)
    touched[owner[spots]] = True
    spots = np.flatnonzero(touched[owner[: len(h)]])
    window = _first_in(test.hashes, h[spots])
    del h
    spots, window = spots[window >= 0], window[window >= 0]
    same = np.ones(len(spots), dtype=bool)
    for i in range(test.width):
        same &= codes[spots + i] == test.codes[test.seat[window] + i]
    first = np.zeros(len(codes), np.int32)
    first[spots[same]] = test.rank[window[same]]
    shard = [first]
    for j, keys in enumerate(test.keys):
        shard.append(_ranked(keys, _paired(shard[-1], test.width << j)))
    best: dict[tuple[int, int], tuple[int, int]] = {}
    level = np.minimum(np.log2(test.need / test.width + 1e-9).astype(np.int64), len(test.keys))
    for j, ranks in enumerate(shard):
        # the shard's suffix array, in order of the codes the needed length reaches at this doubling
        array = np.flatnonzero(ranks)
        array = array[np.argsort(ranks[array], kind="stable")]
        order = ranks[array]
        own = np.flatnonzero(level == j)
        asked = test.ranks[j][test.start[own]]
        low, high = np.searchsorted(order, asked, "left"), np.searchsorted(order, asked, "right")
        some = high > low
        own, low, count = own[some], low[some], (high - low)[some]
        upto = np.cumsum(count)
        at = 0
        while at < len(own):
            to = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")), at + 1)
            t = np.repeat(own[at:to], count[at:to])
            p = array[np.arange(len(t)) - np.repeat(np.cumsum(count[at:to]) - count[at:to], count[at:to]) + np.repeat(low[at:to], count[at:to])]
            s, back = test.start[t], test.back[t]
            # a match that begins at the item's former suffix already is part of a longer one
            inner = (back > 0) & (back <= test.width) & (p >= back)
            inner &= (test.ranks[0][s - back] > 0) & (test.ranks[0][s - back] == first[np.maximum(p - back, 0)])
            t, p, s = t[~inner], p[~inner], s[~inner]
            length = _match_lengths(test, shard, s, p)
            reached = length >= test.need[t]
            t, p, length = t[reached], p[reached], length[reached]
            o = np.lexsort((p, -length, test.item[t], owner[p]))
            t, p, length = t[o], p[o], length[o]
            head = np.ones(len(t), dtype=bool)
            head[1:] = (test.item[t][1:] != test.item[t][:-1]) | (owner[p][1:] != owner[p][:-1])
            for k, i, q, n in zip(owner[p][head].tolist(), test.item[t][head].tolist(), place[p][head].tolist(), length[head].tolist()):
                if best.get((k, i), (0, 0))[1] < n:
                    best[k, i] = (q, n)
            at = to
    return [(k, i, q, n) for (k, i), (q, n) in best.items()]


def _with_openings_cut(items: DataFrame, *, words: int, chars: int) -> DataFrame:
    """Items (item_id, lang, text) without their shared instruction: the longest opening, too short to be a case, with
    which items of different passages start. An opening that is always followed by the same words is passage."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for i, lang, text in b.itertuples(index=False) for r in opening_rows(i, lang, text, words=words, chars=chars)]
            yield pd.DataFrame(rows, columns=["item_id", "opening", "n", "after"])

    opened = items.mapInPandas(run, "item_id bigint, opening string, n int, after string")
    shared = opened.groupBy("opening").agg(F.count_distinct("after").alias("fan"), F.max("n").alias("n")).filter("fan > 1")
    cut = opened.select("item_id", "opening").distinct().join(shared.select("opening", "n"), "opening").groupBy("item_id", "opening").agg(F.max("n").alias("n"))
    cut = items.join(cut, "item_id", "left").withColumn("n", F.when(F.col("text").startswith(F.col("opening")), F.col("n")).otherwise(0))
    return cut.groupBy("item_id", "lang", "text").agg(F.max("n").alias("n")).select("item_id", "lang", F.expr("substring(text, n + 1)").alias("text"))


def leaked_items(documents: DataFrame, items: DataFrame, *, words: int = 12, chars: int = 24) -> DataFrame:
    """(doc_id, item_id, place, length) of every document that carries an item's passage.

    A case is a run of at least ``words`` consecutive words of the passage (zh: ``chars`` characters) without the shared
    instruction; place and length are those of the longest such run, in letters and digits. Instructions are openings
    shorter than a case with which items of different passages start. Null and blank texts carry nothing; items shorter
    than the run cannot leak; repeated rows give one case; other columns are ignored; empty tables give an empty result.
    One pass over the texts for every BLOCK_CHARS of test text, which the driver holds one block at a time; no shuffle
    but the final removal of repeats.
    """
    spark = documents.sparkSession
    usable = items.filter(F.col("text").rlike(r"(?U)\S") & F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "lang", "text").distinct()
    rows = _with_openings_cut(usable, words=words, chars=chars).orderBy("item_id", "text").toLocalIterator()
    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("item_id", T.LongType()), T.StructField("place", T.LongType()), T.StructField("length", T.LongType())])
    texts = documents.select("doc_id", "text").filter("text is not null")

    def search(test: TestSet) -> tuple[DataFrame, object]:
        shared = spark.sparkContext.broadcast(test)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, values = batch.column(0), batch.column(1).to_pylist()
                at, size = 0, 0
                for i, t in enumerate(values):
                    size += len(t)
                    if size >= SHARD_CHARS or i == len(values) - 1:
                        hits = search_shard(shared.value, values[at : i + 1])
                        if hits:
                            t_no, item, place, length = zip(*hits)
                            yield pa.RecordBatch.from_arrays([keys.slice(at, i + 1 - at).take(pa.array(t_no)), pa.array(item, pa.int64()), pa.array(place, pa.int64()), pa.array(length, pa.int64())], names=schema.names)
                        at, size = i + 1, 0

        return texts.mapInArrow(run, schema), shared

    found: list[DataFrame] = []
    scratch = Scratch(spark, "leaks")
    block = next_block(rows)
    while block:
        test = build_test_set(block, words=words, chars=chars)
        block = next_block(rows)
        if test is None:
            continue
        part, shared = search(test)
        if found or block:  # one of several passes: written at once, so that its test text can be let go
            part = scratch.write(part)
            shared.unpersist()
        found.append(part)
    if not found:
        return spark.createDataFrame([], schema)
    all_found = found[0]
    for part in found[1:]:
        all_found = all_found.unionByName(part)
    return all_found.groupBy("doc_id", "item_id").agg(F.max_by("place", "length").alias("place"), F.max("length").alias("length"))


def next_block(rows: Iterator) -> list[tuple[int, str, str]]:
    """The next items of up to BLOCK_CHARS code points, at least one if any is left."""
    out, size = [], 0
    for r in rows:
        out.append(tuple(r))
        size += len(r[2])
        if size >= BLOCK_CHARS:
            break
    return out


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Documents that carry no passage, by the cases of ``leaked_items``; all columns and repeated rows stay.

    Rows without doc_id cannot be told apart: they are all removed if one of them carries a passage.
    """
    hit = found.select(F.col("doc_id").alias("hit")).distinct()
    return documents.join(hit, F.col("doc_id").eqNullSafe(F.col("hit")), "left_anti")
