"""Byte-level BPE of the whole corpus in numpy.

Words are cut from code-point classes, equal words are encoded once a batch, and the merges of all new words run
together: their symbols lie in one flat array, the rank of every adjacent pair is found by binary search over the
sorted pair keys, and each round merges the lowest-ranked pair of every word.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Code points worked on at once; a longer text is still taken whole, alone.
BATCH_CHARS = 1_000_000
#: Words remembered between batches; a full memory starts afresh, which costs time only.
MEMORY_WORDS = 400_000

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0
#: Code points with the Unicode property White_Space.
_WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BIG = np.int64(1 << 62)


def _classes() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint8)
    kind = {"L": _LETTER, "N": _NUMBER}
    for c in range(0x323B0):
        table[c] = kind.get(unicodedata.category(chr(c))[0], _OTHER)
    table[_WHITE] = _SPACE
    return table


class Encoder:
    """Encoder of one vocabulary; built once a Python worker."""

    def __init__(self, path: str):
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        # A pair may merge when its joined bytes are a token. All splits of all tokens cover every reachable pair.
        keys, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys = np.array(keys, dtype=np.int64)[order]
        self.pair_ids = np.array(merged, dtype=np.int64)[order]
        self.classes = _classes()
        rng = np.random.default_rng(7)
        self.odd = rng.integers(1, 1 << 62, size=2, dtype=np.int64) | 1
        self.memory: dict[bytes, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.memory.clear()
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0
        self.starts: list[int] = []
        self.sizes: list[int] = []

    def word_starts(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Flat positions where words start; ``first`` are the starts of the (non-empty) texts."""
        n = len(codes)
        kind = self.classes[np.minimum(codes, 0x10FFFF)]
        begin = np.zeros(n + 1, dtype=bool)
        begin[first] = True
        begin[n] = True
        before = np.empty(n, dtype=np.uint8)
        before[0] = 9
        before[1:] = kind[:-1]
        before[first] = 9  # nothing before the first character of a text
        space = kind == _SPACE
        start = kind != before
        # a run of white space gives up its last character to what follows in its text, if anything does
        last = np.zeros(n, dtype=bool)
        last[:-1] = space[:-1] & ~space[1:] & ~begin[1:n]
        start |= last
        # a plain blank given up joins the word after it
        after_blank = np.zeros(n, dtype=bool)
        after_blank[1:] = last[:-1] & (codes[:-1] == 32)
        start &= ~after_blank
        start |= begin[:n]
        # contractions, only where a word starts at the apostrophe
        at = np.flatnonzero((codes == 39) & start)
        if len(at):
            pad = np.concatenate([codes, np.zeros(3, codes.dtype)])
            text_of = np.cumsum(begin[:n])
            same = lambda k: (at + k < n) & (text_of[np.minimum(at + k, n - 1)] == text_of[at])
            one = np.isin(pad[at + 1], [ord(c) for c in "stmd"]) & same(1)
            two = np.zeros(len(at), dtype=bool)
            for a, b in ("re", "ve", "ll"):
                two |= (pad[at + 1] == ord(a)) & (pad[at + 2] == ord(b))
            two &= same(2) if len(at) else two
            hit, width = at[one | two], np.where(one, 2, 3)[one | two]
            start[hit + 1] = False
            ends = hit + width
            start[ends[ends < n]] = True
            # an apostrophe right after a contraction may start another one: settle these few in order
            for p in ends[(ends < n)]:
                p = int(p)
                while p < n and codes[p] == 39 and not begin[p]:
                    w = 2 if p + 1 < n and not begin[p + 1] and chr(codes[p + 1]) in "stmd" else 0
                    if not w and p + 2 < n and not begin[p + 1] and not begin[p + 2] and chr(codes[p + 1]) + chr(codes[p + 2]) in ("re", "ve", "ll"):
                        w = 3
                    if not w:
                        break
                    start[p] = True
                    start[p + 1 : p + w] = False
                    p += w
                    if p < n:
                        start[p] = True
        return np.flatnonzero(start)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids a word) of distinct words."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_words, done_at = [], [], []
        at = np.arange(len(symbols))
        while len(symbols) > 1:
            key = symbols[:-1] << 32 | symbols[1:]
            slot = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where((self.pair_keys[slot] == key) & (word[:-1] == word[1:]), self.pair_ids[slot], _BIG)
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            padded = np.append(rank, _BIG)
            least = np.minimum.reduceat(padded, head)
            alive = least < _BIG
            span = np.diff(np.append(head, len(symbols)))
            if not alive.all():  # words without a mergeable pair leave the arrays
                gone = np.repeat(~alive, span)
                done_ids.append(symbols[gone])
                done_words.append(word[gone])
                done_at.append(at[gone])
                if not alive.any():
                    symbols = symbols[:0]
                    break
            hit = (padded == np.repeat(least, span)) & np.repeat(alive, span)
            # of overlapping hits (x x x) every second one counts, from the left
            h = np.flatnonzero(hit)
            if len(h) > 1:
                run = np.concatenate([[True], np.diff(h) > 1])
                begin = np.maximum.accumulate(np.where(run, np.arange(len(h)), 0))
                h = h[(np.arange(len(h)) - begin) % 2 == 0]
            symbols = symbols.copy()
            symbols[h] = padded[h]
            keep = np.repeat(alive, span)
            keep[h + 1] = False
            symbols, word, at = symbols[keep], word[keep], at[keep]
        if len(symbols):
            done_ids.append(symbols)
            done_words.append(word)
            done_at.append(at)
        if not done_ids:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        order = np.argsort(np.concatenate(done_at), kind="stable")
        return np.concatenate(done_ids)[order].astype(np.int32), np.bincount(np.concatenate(done_words), minlength=len(words))

    def _learn(self, words: list[bytes]) -> None:
        ids, sizes = self.merge(words)
        need = self.used + len(ids)
        if need > len(self.flat):
            grown = np.zeros(max(need, 2 * len(self.flat)), dtype=np.int32)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : need] = ids
        starts = self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]])
        base = len(self.starts)
        self.memory.update(zip(words, range(base, base + len(words))))
        self.starts.extend(starts.tolist())
        self.sizes.extend(sizes.tolist())
        self.used = need

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids a text)."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
        data = np.frombuffer(joined.encode("utf-8", "replace"), dtype=np.uint8)
        text_begin = np.concatenate([[0], np.cumsum(lengths)])
        start = self.word_starts(codes, text_begin[:-1][lengths > 0])
        width = 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF)
        byte_at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        wb = byte_at[start]
        we = np.append(wb[1:], byte_at[-1])
        # words of equal bytes: two independent 64-bit sums over (byte, place in the word), and the length
        place = np.arange(len(data)) - np.repeat(wb, we - wb)
        mixed = (data.astype(np.int64) + 1) * (place * 2 + self.odd[0])
        mixed ^= mixed >> np.int64(29)
        mixed *= self.odd[1]
        mixed ^= mixed >> np.int64(31)
        total = np.add.reduceat(mixed, wb) + (we - wb)
        _, lead, inverse = np.unique(total, return_index=True, return_inverse=True)
        blob = data.tobytes()
        # equal sums are checked byte by byte against their first word, so that the result is exact
        a, b = wb[lead][inverse], wb
        size, lead_size = we - wb, (we - wb)[lead][inverse]
        if not (size == lead_size).all() or not (data[np.repeat(a, size) + place] == data).all():
            spelled = [blob[x:y] for x, y in zip(wb.tolist(), we.tolist())]
            distinct = list(dict.fromkeys(spelled))
            number = {w: i for i, w in enumerate(distinct)}
            inverse = np.array([number[w] for w in spelled])
        else:
            distinct = [blob[x:y] for x, y in zip(wb[lead].tolist(), we[lead].tolist())]
        if len(self.memory) > MEMORY_WORDS:
            self._forget()
        fresh = [w for w in distinct if w not in self.memory]
        if fresh:
            self._learn(fresh)
        slot = np.array([self.memory[w] for w in distinct], dtype=np.int64)
        s = np.array(self.starts, dtype=np.int64)[slot][inverse] if len(self.starts) < 4 * len(slot) else np.array([self.starts[i] for i in slot.tolist()], dtype=np.int64)[inverse]
        k = np.array([self.sizes[i] for i in slot.tolist()], dtype=np.int64)[inverse]
        out_at = np.concatenate([[0], np.cumsum(k)])
        ids = self.flat[np.repeat(s - out_at[:-1], k) + np.arange(out_at[-1])]
        word_text = np.searchsorted(text_begin, start, "right") - 1
        counts = np.bincount(word_text, weights=k, minlength=len(texts)).astype(np.int64)
        return ids, counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_corpus(documents: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids array<int>) of every row: the ids of its text, the empty list for an empty or null text.

    No shuffle; repeated rows give repeated results; long texts are encoded whole. ``vocabulary`` is the path of the
    rank file (or the environment variable QUILLGRAPH_BPE); where an executor has no such file it reads the copy the
    driver sends.
    """
    path = vocabulary or os.environ.get("QUILLGRAPH_BPE", DEFAULT_VOCABULARY)
    if os.path.exists(path):
        documents.sparkSession.sparkContext.addFile(path)
    field = documents.schema[key]
    schema = T.StructType([T.StructField(key, field.dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            at, chars = 0, 0
            for i, t in enumerate(texts):
                chars += len(t or "")
                if chars >= BATCH_CHARS or i == len(texts) - 1:
                    ids, counts = enc.encode([t or "" for t in texts[at : i + 1]])
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([keys.slice(at, i + 1 - at), lists], names=[key, "ids"])
                    at, chars = i + 1, 0

    return documents.select(key, text).mapInArrow(run, schema)
