"""Main body of web pages: a bidirectional LSTM labels every line with the whole page as context.

A line is a leaf of the page. Its tag path is rebuilt from the layout that survives in text (heading level, bullet,
quotation, code fence, place in the page, blank lines around it), its words enter as hashed vectors of single words
and word pairs.
"""

from __future__ import annotations

import io
import pkgutil
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokenize import _LETTER, _NUMBER, _OTHER, _SPACE, _classes

WEIGHTS = str(Path(__file__).with_name("boilerplate_weights.npz"))
#: Slots of the hashed words, size of their vectors, size of either LSTM state.
SLOTS, WORD, STATE = 8192, 16, 24
STRUCTURE = 40
#: Log-odds from which a line counts as furniture.
THRESHOLD = 1.0
#: Code points worked on at once; a longer text is still taken whole, alone.
BATCH_CHARS = 1_000_000

#: Marks counted a line, by group.
_GROUPS = ("/", "|", "·", ">›»", "\t", ":：", ".。", "?？", "(（", "–-")


@dataclass
class Features:
    """Lines that are not blank: structure vectors, hashed words with bounds, text and line number of each."""

    structure: np.ndarray
    words: np.ndarray
    bounds: np.ndarray
    text: np.ndarray
    number: np.ndarray


class _Tables:
    kind: np.ndarray | None = None

    @classmethod
    def get(cls) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if cls.kind is None:
            cls.kind = _classes()
            points = np.arange(0x30000)
            upper = np.zeros(0x110000, dtype=bool)
            lower = np.arange(0x110000, dtype=np.uint32)
            for c in points.tolist():
                if 0xD800 <= c <= 0xDFFF:
                    continue
                s = chr(c)
                low = s.lower()
                if low != s:
                    upper[c] = True
                    if len(low) == 1:
                        lower[c] = ord(low)
            cls.upper, cls.lower = upper, lower
            cls.group = np.zeros(0xFFFF, dtype=np.uint8)
            for g, marks in enumerate(_GROUPS, 1):
                cls.group[[ord(c) for c in marks]] = g
        return cls.kind, cls.upper, cls.lower, cls.group


def line_features(texts: list[str]) -> Features:
    """Features of all non-blank lines of all texts; lines are split at line feeds and counted from 1."""
    kind_of, is_upper, lower_of, group_of = _Tables.get()
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    n = len(codes)
    kind = kind_of[codes]
    feed = codes == 10
    line = np.cumsum(feed) - feed
    stop = np.flatnonzero(feed)
    begin = np.concatenate([[0], stop[:-1] + 1])
    total = len(stop)
    count = np.cumsum([t.count("\n") + 1 for t in texts])
    text_of = np.searchsorted(count, np.arange(total), "right")
    first_line = np.concatenate([[0], count[:-1]])
    number = np.arange(total) - first_line[text_of] + 1
    lines_in = np.diff(np.concatenate([[0], count]))[text_of]

    def per_line(at: np.ndarray) -> np.ndarray:
        return np.bincount(line[at], minlength=total).astype(np.float32)

    kinds = np.bincount(line * 4 + kind, minlength=4 * total).reshape(total, 4).astype(np.float32)
    solid = kinds[:, _OTHER] + kinds[:, _LETTER] + kinds[:, _NUMBER]
    size = (stop - begin).astype(np.float32)
    full = solid > 0
    # first and last character that is not blank
    at = np.where(kind != _SPACE, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    head = np.where(full, following[np.minimum(begin, n - 1)], 0)
    behind = np.maximum.accumulate(np.where(kind != _SPACE, np.arange(n), -1))
    tail = np.where(full, behind[np.maximum(stop - 1, 0)], 0)
    h, t = codes[head], codes[tail]
    second = codes[np.minimum(head + 1, n - 1)]
    letters, digits = kinds[:, _LETTER], kinds[:, _NUMBER]
    capitals = is_upper[codes]
    uppers = per_line(np.flatnonzero(capitals))
    cjk = (codes >= 0x3400) & (codes <= 0x9FFF)
    wide = per_line(np.flatnonzero(cjk))
    # words: runs of letters or of digits; every ideograph is a word
    start = ((kind == _LETTER) | (kind == _NUMBER)) & (np.concatenate([[9], kind[:-1]]) != kind)
    previous_cjk = np.concatenate([[False], cjk[:-1]])
    start |= cjk | ((kind == _LETTER) & previous_cjk)
    w = np.flatnonzero(start)
    word_count = per_line(w)
    capital = per_line(w[capitals[w]])
    # a word's hash adds its lower-case letters up, each weighed by its place; digits all read alike
    inside = (kind == _LETTER) | (kind == _NUMBER)
    run = np.cumsum(start) - 1
    place = np.arange(n) - w[np.maximum(run, 0)] if len(w) else np.zeros(n, np.int64)
    value = np.where(kind == _NUMBER, 7, lower_of[codes].astype(np.int64)) + 1
    value = np.where((kind == _NUMBER) & (place > 0), 0, value)
    mixed = value * ((place * 2 + 1) * 0x9E3779B1 + 0x7F4A7C15)
    mixed ^= mixed >> 15
    mixed *= 0x2C1B3C6D
    mixed ^= mixed >> 13
    sums = np.add.reduceat(np.where(inside, mixed, 0), w) if len(w) else np.zeros(0, np.int64)
    word_line = line[w]
    single = (sums ^ (sums >> 17)) % (SLOTS // 2)
    pair = sums[:-1] * 31 + sums[1:]
    pair = (pair ^ (pair >> 19)) % (SLOTS // 2) + SLOTS // 2
    same = word_line[:-1] == word_line[1:]
    slots = np.concatenate([single, pair[same]])
    owner = np.concatenate([word_line, word_line[:-1][same]])
    order = np.argsort(owner, kind="stable")
    slots, owner = slots[order], owner[order]

    fence = full & (h == 96) & (second == 96)
    fences = np.cumsum(fence)
    inside_code = ((fences - np.concatenate([[0], fences])[first_line[text_of]]) % 2 == 1) | fence
    # the ends of a text count as blank, whatever text stands next to it
    blank_before = (np.concatenate([[True], ~full[:-1]]) | (number == 1)).astype(np.float32)
    blank_after = (np.concatenate([~full[1:], [True]]) | (number == lines_in)).astype(np.float32)
    share = lambda x, y: x / np.maximum(y, 1)
    columns = [
        np.log1p(size) / 6, np.log1p(word_count) / 4, share(uppers, letters), share(digits, solid), share(wide, solid), share(capital, word_count),
        is_upper[h], (kind[head] == _NUMBER), (h == 35), (h == 35) & (second == 35), (h == 45), (h == 0x2013), (h == 42), (h == 62), fence, inside_code,
        np.isin(t, [46, 63, 33, 0x3002, 0xFF1F, 0xFF01]), (t == 58) | (t == 0xFF1A), (kind[tail] == _OTHER), (t == 41) | (t == 0xFF09),
        blank_before, blank_after, share(number, lines_in), np.minimum(number, 12) / 12, np.minimum(lines_in - number, 12) / 12, (number == 1), (h == 0xA9) | (h == 0xAB), (letters == 0),
    ]
    group = group_of[np.minimum(codes, len(group_of) - 1)]
    marked = np.flatnonzero(group)
    marks = np.bincount(line[marked] * 16 + group[marked], minlength=16 * total).reshape(total, 16)
    columns += list((np.minimum(marks[:, 1 : len(_GROUPS) + 1], 6) / 3).T)
    columns += [np.minimum(word_count, 4) / 4, (size < 40)]
    structure = np.stack([np.asarray(c, dtype=np.float32) for c in columns], axis=1)
    assert structure.shape[1] == STRUCTURE
    keep = np.flatnonzero(full)
    bounds_all = np.searchsorted(owner, np.arange(total + 1))
    lengths = (bounds_all[1:] - bounds_all[:-1])[keep]
    inside_kept = full[owner] if len(owner) else np.zeros(0, bool)
    return Features(structure[keep], slots[inside_kept].astype(np.int32), np.concatenate([[0], np.cumsum(lengths)]), text_of[keep], number[keep])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockNet:
    """Word vectors, a forward and a backward LSTM, and a logistic output."""

    NAMES = ("E", "Wx0", "Wh0", "b0", "Wx1", "Wh1", "b1", "Wo", "bo")

    def __init__(self, **p: np.ndarray):
        self.__dict__.update(p)

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> BlockNet:
        d = STRUCTURE + WORD
        g = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        bias = np.zeros(4 * STATE, np.float32)
        bias[STATE : 2 * STATE] = 1
        return cls(E=(rng.normal(size=(SLOTS, WORD)) * 0.3).astype(np.float32), Wx0=g(d, 4 * STATE), Wh0=g(STATE, 4 * STATE), b0=bias.copy(), Wx1=g(d, 4 * STATE), Wh1=g(STATE, 4 * STATE), b1=bias.copy(), Wo=g(2 * STATE + d, 1), bo=np.zeros(1, np.float32))

    def params(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def save(self, path: str) -> None:
        np.savez_compressed(path, **{n: getattr(self, n).astype(np.float16) for n in self.NAMES})

    @classmethod
    def load(cls, path: str) -> BlockNet:
        # read through the package, which may be a zip archive on the workers
        data = pkgutil.get_data(__package__, Path(path).name) if path == WEIGHTS else Path(path).read_bytes()
        with np.load(io.BytesIO(data)) as z:
            return cls(**{n: z[n].astype(np.float32) for n in cls.NAMES})

    def inputs(self, structure: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.zeros((len(structure), WORD), np.float32)
        size = np.diff(bounds)
        some = np.flatnonzero(size > 0)
        at = 0
        while at < len(some):
            # lines in parts, so that the gathered vectors stay small; a longer line is taken alone
            end = max(at + 1, int(np.searchsorted(bounds[some], bounds[some[at]] + 65_536)))
            first = bounds[some[at]]
            stop = bounds[some[end - 1] + 1]
            total[some[at:end]] = np.add.reduceat(self.E[words[first:stop]], bounds[some[at:end]] - first, axis=0)
            at = end
        total[some] /= np.sqrt(size[some])[:, None]
        return np.concatenate([structure, total], axis=1)

    def _run(self, x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, live: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States over x (time, batch, input); ``live`` (time, batch) holds the state where a sequence has ended."""
        steps, batch, _ = x.shape
        pre = x @ wx + b
        h = np.zeros((batch, STATE), np.float32)
        c = np.zeros((batch, STATE), np.float32)
        out = np.zeros((steps, batch, STATE), np.float32)
        for t in range(steps):
            z = pre[t] + h @ wh
            i, f, o = _sigmoid(z[:, :STATE]), _sigmoid(z[:, STATE : 2 * STATE]), _sigmoid(z[:, 2 * STATE : 3 * STATE])
            g = np.tanh(z[:, 3 * STATE :])
            c2 = f * c + i * g
            tc = np.tanh(c2)
            h2 = o * tc
            m = live[t][:, None]
            if keep is not None:
                keep.append((i, f, o, g, c, tc, h, m))
            c, h = np.where(m, c2, c), np.where(m, h2, h)
            out[t] = h
        return out

    def scores(self, f: Features) -> np.ndarray:
        """Log-odds of furniture for every line, page by page with the whole page as context.

        Pages run side by side, longest first, so that the pages still running at a step are a leading part of them.
        """
        n = len(f.structure)
        if not n:
            return np.zeros(0, np.float32)
        x = self.inputs(f.structure, f.words, f.bounds)
        cut = np.flatnonzero(np.concatenate([[True], np.diff(f.text) > 0]))
        sizes = np.diff(np.append(cut, n))
        order = np.argsort(-sizes, kind="stable")
        cut, sizes = cut[order], sizes[order]
        running = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), "right")
        y = x @ self.Wo[2 * STATE :, 0] + self.bo[0]
        # sigmoid(z) = tanh(z / 2) / 2 + 1 / 2, so that one tanh serves all gates
        half = np.repeat(np.array([0.5, 1], np.float32), [3 * STATE, STATE])
        for back, (wx, wh, b) in enumerate(((self.Wx0, self.Wh0, self.b0), (self.Wx1, self.Wh1, self.b1))):
            pre = x @ (wx * half) + b * half
            wh = wh * half
            h = np.zeros((len(sizes), STATE), np.float32)
            c = np.zeros((len(sizes), STATE), np.float32)
            states = np.empty((n, STATE), np.float32)
            for t, k in enumerate(running.tolist()):
                rows = cut[:k] + (sizes[:k] - 1 - t if back else t)
                z = pre[rows]
                if t:
                    z += h[:k] @ wh
                np.tanh(z, out=z)
                gates = z[:, : 3 * STATE] * 0.5 + 0.5
                ck = c[:k]
                ck *= gates[:, STATE : 2 * STATE]
                ck += gates[:, :STATE] * z[:, 3 * STATE :]
                h[:k] = gates[:, 2 * STATE :] * np.tanh(ck)
                states[rows] = h[:k]
            y += states @ self.Wo[back * STATE : (back + 1) * STATE, 0]
        return y

    def gradient(self, part: list, rng: np.random.Generator) -> tuple[float, int, list[np.ndarray]]:
        """(loss, lines, gradients) of one batch of (structure, words, labels)."""
        batch, steps = len(part), max(len(p[2]) for p in part)
        d = STRUCTURE + WORD
        x = np.zeros((steps, batch, d), np.float32)
        y = np.zeros((steps, batch), np.float32)
        live = np.zeros((steps, batch), bool)
        flat_words, spot, scale = [], [], []
        for b, (structure, words, label) in enumerate(part):
            k = len(label)
            x[:k, b, :STRUCTURE] = structure
            y[:k, b] = label
            live[:k, b] = True
            for t, ws in enumerate(words):
                if len(ws):
                    ws = ws[rng.random(len(ws)) > 0.1]  # words drop out, so that no single one decides
                    flat_words.append(ws)
                    spot.append(np.full(len(ws), t * batch + b))
                    scale.append(np.full(len(ws), 1 / np.sqrt(max(len(ws), 1)), np.float32))
        flat = np.concatenate(flat_words) if flat_words else np.zeros(0, np.int32)
        spots = np.concatenate(spot) if spot else np.zeros(0, int)
        scales = np.concatenate(scale)[:, None] if scale else np.zeros((0, 1), np.float32)
        flat_x = x.reshape(steps * batch, d)
        np.add.at(flat_x[:, STRUCTURE:], spots, self.E[flat] * scales)
        k0: list = []
        k1: list = []
        forward = self._run(x, self.Wx0, self.Wh0, self.b0, live, k0)
        backward = self._run(x[::-1], self.Wx1, self.Wh1, self.b1, live[::-1], k1)[::-1]
        joint = np.concatenate([forward, backward, x], axis=2)
        z = (joint @ self.Wo)[..., 0] + self.bo[0]
        p = _sigmoid(z)
        n = int(live.sum())
        loss = float(-(np.where(y > 0.5, np.log(p + 1e-7), np.log(1 - p + 1e-7)) * live).sum())
        dz = ((p - y) * live / n).astype(np.float32)[..., None]
        g_wo = joint.reshape(-1, joint.shape[2]).T @ dz.reshape(-1, 1)
        g_bo = dz.sum(keepdims=False).reshape(1)
        dj = dz * self.Wo[:, 0]
        dx = dj[..., 2 * STATE :].copy()
        grads = []
        for wx, wh, kept, dh_all, xs in ((self.Wx0, self.Wh0, k0, dj[..., :STATE], x), (self.Wx1, self.Wh1, k1, dj[::-1, :, STATE : 2 * STATE], x[::-1])):
            dzs = np.zeros((steps, batch, 4 * STATE), np.float32)
            g_wh = np.zeros_like(wh)
            dh = np.zeros((batch, STATE), np.float32)
            dc = np.zeros((batch, STATE), np.float32)
            for t in range(steps - 1, -1, -1):
                i, f, o, g, c, tc, h, m = kept[t]
                dh_t = dh + dh_all[t]
                a = np.where(m, dh_t, 0)
                do = a * tc
                dct = np.where(m, dc, 0) + a * o * (1 - tc * tc)
                dzt = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), do * o * (1 - o), dct * i * (1 - g * g)], axis=1)
                dzs[t] = dzt
                g_wh += h.T @ dzt
                dh = dzt @ wh.T + np.where(m, 0, dh_t)
                dc = dct * f + np.where(m, 0, dc)
            g_wx = xs.reshape(-1, d).T @ dzs.reshape(-1, 4 * STATE)
            back = dzs @ wx.T
            dx += back if wx is self.Wx0 else back[::-1]
            grads += [g_wx, g_wh, dzs.sum((0, 1))]
        g_e = np.zeros_like(self.E)
        np.add.at(g_e, flat, dx.reshape(steps * batch, d)[spots, STRUCTURE:] * scales)
        return loss, n, [g_e, *grads, g_wo.reshape(self.Wo.shape), g_bo]


_NETS: dict[str, BlockNet] = {}


def block_net(path: str = WEIGHTS) -> BlockNet:
    if path not in _NETS:
        _NETS[path] = BlockNet.load(path)
    return _NETS[path]


def furniture_lines(documents: DataFrame, *, weights: str = WEIGHTS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, line_no) of every non-blank line of a web page that is not main body.

    Lines are split at line feeds and counted from 1. Only rows with source ``web`` are pages; null, empty and blank
    texts have no lines; repeated rows give one result; long pages are labelled whole. One pass without a shuffle but
    for the removal of repeats, which doc_id groups.
    """
    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("line_no", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = block_net(weights)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            at, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= BATCH_CHARS or i == len(texts) - 1:
                    f = line_features(texts[at : i + 1])
                    hit = net.scores(f) > threshold
                    yield pa.RecordBatch.from_arrays([keys.slice(at, i + 1 - at).take(pa.array(f.text[hit])), pa.array(f.number[hit].astype(np.int32))], names=["doc_id", "line_no"])
                    at, size = i + 1, 0

    pages = documents.filter((F.col("source") == "web") & F.col("text").isNotNull()).select("doc_id", "text")
    return pages.mapInArrow(run, schema).distinct()
