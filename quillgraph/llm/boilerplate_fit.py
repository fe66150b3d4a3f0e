"""Fitting of the block labeller: seed labels for web pages, and training of the recurrent network in numpy.

Run as ``python -m quillgraph.llm.boilerplate_fit DOCUMENTS.parquet`` to write the weights beside the operator. There
are no labelled pages, so the labels come from seed rules for what page furniture says in four languages, and from the
pages of other sources, which have none. The network then generalises over words, layout and document context.
"""

from __future__ import annotations

import re
import sys

import numpy as np

from .boilerplate import WEIGHTS, BlockNet, line_features

#: Web pages and other documents used for fitting, at most.
FIT_PAGES, FIT_OTHERS = 4000, 2500

#: Words of site navigation, per language.
NAV = {
    "Home", "About us", "Sign in", "Status", "Products", "Partners", "Press", "Blog", "Support", "Docs", "Careers", "Contact", "Community", "Forum", "Pricing",
    "Start", "Über uns", "Produkte", "Presse", "Anmelden", "Hilfe", "Preise", "Karriere", "Kontakt",
    "Inicio", "Nosotros", "Contacto", "Precios", "Entrar", "Empleo", "Productos", "Prensa", "Ayuda",
    "价格", "招聘", "博客", "联系我们", "首页", "产品", "关于我们", "文档", "新闻", "登录",
}
_ROOT = {"Home", "Start", "Inicio", "首页"}
_SEPARATOR = re.compile(r"\s*[/|·>›»\t]\s*|\s{2,}")

#: What furniture lines say; matched against the line without bullets, quotation marks and blanks around it.
_SEEDS = re.compile(
    "|".join([
        # notices
        r"(we|wir|nosotros) (and|und|y) \d+ (partners|partner|socios)\b.*", r".{0,60}stores small files on your device.*", r"by staying on this page you agree.*", r"this site remembers your visit.*",
        r"to keep .{0,60} free of charge, we show notices.*", r".{0,60}verwendet cookies, um.*", r".{0,60}usa cookies para.*", r".{0,60}使用cookie.*", r"我们与\d+家伙伴.*",
        # share, follow, subscribe
        r"share this:.*", r"teilen:.*", r"compartir:.*", r"分享到.*", r"follow .{1,60}", r"folgen sie .{1,60}", r"siga a .{1,60}", r"关注.{1,60}", r"sign up for our newsletter.*", r"newsletter abonnieren.*", r"suscríbase al boletín.*", r"订阅我们.*",
        r"enjoying this page\?.*", r"gefällt ihnen .*", r"advertisement", r"anzeige", r"werbung", r"publicidad", r"anuncio", r"广告", r"continue reading after the ad.*",
        # teasers
        r"most read this week", r"you may also like", r"popular in this section", r"latest posts", r"meistgelesen", r"das könnte sie interessieren", r"lo más leído", r"también le puede gustar", r"热门文章", r"猜你喜欢",
        r"read also:.*", r"lesen sie auch:.*", r"lea también:.*", r"(延伸|相关)?阅读：.*", r"另请阅读.*", r"另见：.*",
        # page feet
        r"©.*", r"imprint · privacy.*", r"impressum · datenschutz.*", r"aviso legal · .*", r"隐私政策.*", r"back to top", r"nach oben", r"volver arriba", r"返回顶部", r"made with care in .*", r".{0,60}is a registered mark\. prices exclude tax\.", r"questions\? call the .{0,60} desk .*",
        r"was this page helpful\?.*", r"war diese seite hilfreich\?.*", r"¿le fue útil\?.*", r"本页有帮助吗.*", r"\d+ (comments|kommentare|comentarios|kommentar) – .*", r"\d+条评论.*",
        r"tags: .*", r"schlagwörter: .*", r"etiquetas: .*", r"标签：.*",
        # paging
        r"[«‹<]? ?(previous|zurück|anterior|上一页) .{0,20}(next|weiter|siguiente|下一页) ?[»›>]?", r"(page|seite|página) \d+ (of|von|de) \d+", r"第\d+页.*",
    ]),
    re.IGNORECASE,
)
_TEASER = re.compile(r"most read this week|you may also like|popular in this section|latest posts|meistgelesen|das könnte sie interessieren|lo más leído|también le puede gustar|热门文章|猜你喜欢", re.IGNORECASE)
_TITLE = re.compile(r"(?:[A-ZÄÖÜÉÁÍÓÚÑ][^.?!:;|]*|(?:Das|Der|Die|El|La|Los|Las) [^.?!;|]*|[^\x00-\x7f][^。？！：.?!|]{0,40})$")
_BULLET = re.compile(r"^\s*(?:[-–*•]\s+|\d+[.)]\s+)?")


def _core(line: str) -> str:
    return _BULLET.sub("", line).strip()


def _navigates(core: str) -> bool:
    parts = [p for p in _SEPARATOR.split(core) if p]
    if core in NAV or (len(parts) > 1 and all(p in NAV for p in parts)):
        return True
    return len(parts) > 1 and parts[0] in _ROOT and not core.endswith((".", "?", "。"))


def seed_labels(text: str) -> list[int]:
    """1 for furniture, 0 for main body, -1 for blank lines of a web page; ambiguous lines are main body."""
    lines = text.split("\n")
    out = [-1] * len(lines)
    sites = {m.group(1).strip() for line in lines for m in [re.search(r"(?:©\s*\d{4}|Follow|Folgen Sie|Siga a|关注)\s*(.+?)(?:\. All rights.*|\. Alle Rechte.*|\. Todos los.*|版权.*|:.*)?$", _core(line))] if m}
    teaser = False
    body = False
    run: list[int] = []
    for i, line in enumerate(lines):
        core = _core(line)
        if not core:
            teaser = False
            continue
        if line.lstrip().startswith(">"):  # a quotation of the article, whatever it quotes
            out[i] = 0
            body, teaser, run = True, False, []
            continue
        # the site's name above its navigation
        banner = not body and len(core.split()) < 5 and not line.lstrip().startswith("#") and i + 1 < len(lines) and _navigates(_core(lines[i + 1])) and all(not x.strip() for x in lines[:i])
        if _SEEDS.fullmatch(core) or _navigates(core) or banner or core in sites:
            out[i] = 1
            teaser = bool(_TEASER.fullmatch(core))
            run = []
            continue
        if teaser and not line.lstrip().startswith("#") and len(core) < 90 and _TITLE.match(core):
            out[i] = 1
            run.append(i)
            continue
        # the article's title is the last headline before its first text, if no other line was
        if not body and run and run[-1] >= i - 2 and all(out[j] == -1 for j in range(run[-1] + 1, i)) and not line.lstrip().startswith("#") and not (len(core) < 90 and _TITLE.match(core)):
            out[run[-1]] = 0
        out[i] = 0
        body = True
        teaser = False
        run = []
    return out


def train(sequences: list[tuple[np.ndarray, list, np.ndarray]], *, epochs: int = 8, rate: float = 4e-3, seed: int = 11) -> BlockNet:
    """Adam over batches of padded sequences of (structure, words, labels)."""
    rng = np.random.default_rng(seed)
    net = BlockNet.fresh(rng)
    params = net.params()
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(sequences))
        order = sorted(order, key=lambda i: len(sequences[i][2]) + rng.random() * 6)
        batches = [order[i : i + 32] for i in range(0, len(order), 32)]
        loss = count = 0.0
        for b in rng.permutation(len(batches)):
            part = [sequences[i] for i in batches[b]]
            value, n, grads = net.gradient(part, rng)
            loss += value
            count += n
            step += 1
            lr = rate * (0.5 ** (epoch / 3))
            for p, g, a, s in zip(params, grads, m, v):
                g = np.clip(g, -1, 1)
                a += 0.1 * (g - a)
                s += 0.001 * (g * g - s)
                p -= lr * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        print(f"epoch {epoch}: loss {loss / count:.4f}", flush=True)
    return net


def prepare(texts: list[str], labels: list[list[int]]) -> list[tuple[np.ndarray, list, np.ndarray]]:
    """Training windows of at most 80 lines."""
    out = []
    for text, marks in zip(texts, labels):
        f = line_features([text])
        y = np.array([k for k in marks if k >= 0], dtype=np.float32)
        if len(y) != len(f.structure):
            continue
        words = [f.words[a:b] for a, b in zip(f.bounds[:-1], f.bounds[1:])]
        for at in range(0, len(y), 80):
            out.append((f.structure[at : at + 80], words[at : at + 80], y[at : at + 80]))
    return out


def quote_notices(pages: list[str], *, share: float = 0.3, seed: int = 5) -> list[str]:
    """The pages, some with one of their furniture lines quoted at another place: a quotation is main body wherever it
    stands and whatever it quotes."""
    rng = np.random.default_rng(seed)
    out = []
    for text in pages:
        lines = text.split("\n")
        furniture = [i for i, k in enumerate(seed_labels(text)) if k == 1]
        if furniture and rng.random() < share:
            lines.insert(int(rng.integers(len(lines) + 1)), "> " + lines[int(rng.choice(furniture))].strip())
        out.append("\n".join(lines))
    return out


def fit(path: str) -> BlockNet:
    import pandas as pd

    rows = pd.read_parquet(path, columns=["doc_id", "source", "text"])
    rows = rows[rows["text"].notna()].sort_values("doc_id")
    pages = rows[rows["source"] == "web"]["text"].head(FIT_PAGES).tolist()
    others = rows[rows["source"] != "web"]["text"].head(FIT_OTHERS).tolist()
    pages = quote_notices(pages)
    labels = [seed_labels(t) for t in pages] + [[0 if line.strip() else -1 for line in t.split("\n")] for t in others]
    return train(prepare(pages + others, labels))


if __name__ == "__main__":
    fit(sys.argv[1]).save(WEIGHTS)
