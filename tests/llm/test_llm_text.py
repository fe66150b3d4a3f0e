import os
import random
import re
from urllib.parse import quote

import numpy as np
import pytest

from quillgraph.llm import leakage as K
from quillgraph.llm import subjects as S
from quillgraph.llm.boilerplate import block_net, furniture_lines, line_features
from quillgraph.llm.boilerplate_fit import seed_labels
from quillgraph.llm.splitting import split_oversized
from quillgraph.llm.tokenize import DEFAULT_VOCABULARY, Encoder, encode_corpus

needs_vocabulary = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary file")
ODD = ["don't 's't  'll x've", "'s", "''s 's", "  \n\n a", "\n", "a \n", "   ", "re'", "!'s", "<|endoftext|>", "　  x", "aaaa aaaaaaa", "x  y   z\t\tq", "été 中文，测试。 Ⅷ½ 👩‍🔬", "", "\r\n\r\n", "１２３ abc١٢", "a" * 5000, "\x00\x1c"]


@needs_vocabulary
def test_ids_equal_the_public_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(DEFAULT_VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    rng = random.Random(1)
    alphabet = "ab's  \n\tre vell12,.!?é中ß' \r"
    texts = [*ODD, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400))]
    ids, counts = Encoder(DEFAULT_VOCABULARY).encode(texts)
    got = [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert got == want


@needs_vocabulary
def test_empty_and_null_texts_give_empty_lists(spark):
    df = spark.createDataFrame([(1, "hi", "x"), (2, "", "y"), (3, None, "z"), (1, "hi", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in encode_corpus(df).collect())
    assert got[0] == got[1] and got[0][1] and got[2:] == [(2, []), (3, [])]
    assert encode_corpus(df.limit(0)).count() == 0


def cut(text, size, overlap, first):
    """The cutting rule, restated as a loop."""
    start, n, out = 0, len(text), []
    while True:
        end = min(start + size, n)
        if end < n:
            feed = text.rfind("\n", start, end)
            if feed - start > size // 2:
                end = feed
        if text[start:end].strip():
            out.append((len(out), start, end, first + text.count("\n", 0, start), first + text.count("\n", 0, end - 1)))
        if end >= n:
            return out
        start = end - overlap if end - overlap > start else end


def test_pieces_against_the_loop(spark):
    rng = random.Random(3)
    settings = [("default", 40, 10, 64), ("short", 7, 3, 64), ("plain", 25, 0, 64), ("legacy", 40, None, 64), ("odd", 5, 9, 64)]
    rows, want = [], set()
    for i in range(120):
        name, size, overlap, _ = settings[i % 5]
        text = "".join(rng.choice("ab é中\n\n 👩") for _ in range(rng.choice([0, size - 1, size, size + 1, 3 * size, 400])))
        first = rng.choice([1, 17])
        rows.append((i, text, first, name, "x"))
        if len(text) > size and text.strip():
            o = min(max(10 if overlap is None else overlap, 0), size - 1)
            want |= {(i, *p) for p in cut(text, size, o, first)}
    rows += [(900, None, 1, "default", "x"), (901, "x" * 99, None, "default", "x"), (902, "x" * 99, 1, "none", "x")]
    chunks = spark.createDataFrame(rows, "id bigint, content string, line_start int, settings_no string, chunk_size string")
    table = spark.createDataFrame(settings, "settings_no string, chunk_size int, chunk_overlap int, embed_dim int")
    got = {tuple(r) for r in split_oversized(chunks, table).collect()}
    assert {g for g in got if g[0] < 900} == want
    assert {g for g in got if g[0] >= 900} == {(901, 0, 0, 40, None, None), (901, 1, 30, 70, None, None), (901, 2, 60, 99, None, None)}
    assert split_oversized(chunks.limit(0), table).count() == 0


ITEM = "Which of the 972 script forms did Galasstad give to the balancer of Emsablotti when Quorebury reached the query planner early today"
ZH = "为什么衡昱调试了霁衡的分支而消息队列只有822当珩邈到达时衡垚的容器镜像已经等待69天"


@pytest.mark.parametrize(
    "text,hit",
    [
        (ITEM, True), (ITEM.upper(), True), ("> " + ITEM.replace(" ", "\n> "), True), (ITEM.replace("of", "<b>of</b>").replace(" ", "&nbsp;"), True), (" ".join(ITEM.split()[:12]), True), (" ".join(ITEM.split()[3:14]), False),
        ('{"p": "' + ITEM.replace("G", "\\u0047") + '"}', True), ("".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in ITEM), True), (ITEM.replace("a", "a​"), True), ("Answer in one sentence: " + " ".join(ITEM.split()[:8]), False), (None, False), ("", False), ("x " * 3000 + ITEM, True),
        (ITEM.replace("form", '<span style="' + "x:1;" * 120 + '">form</span>'), True), (ITEM.replace("form", "<!-- " + "note\n" * 200 + "-->form"), True), (quote(ITEM), True), (" ".join(ITEM.split()[:6]) + " i <n and " + " ".join(ITEM.split()[6:]) + ">", False),
        (quote(ZH), True), (quote(ZH).lower(), True), ("50%de " + ITEM, True), ("[" + ITEM.replace("form", "form](https://a.example/b_(c)?q=" + "x" * 400 + ' "t") ['), True),
        (ZH[:24], True), (ZH[:23], False), ("，".join(ZH[3:30]), True),
    ],
)
def test_leaks_in_any_dress(text, hit):
    test = K.build_test_set([(1, "en", ITEM), (2, "zh", ZH)], words=12, chars=24)
    assert bool(K.search_shard(test, ["filler text", text or "", "other"])) == hit


def test_longest_match_against_the_loop():
    rng = random.Random(4)
    words = ["ab", "ba", "a", "b", "aab"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, "en", say(rng.choice([8, 14, 30]))) for i in range(12)]
    test = K.build_test_set(items, words=5, chars=24)
    texts = [say(40) + " " + " ".join(rng.choice(items)[2].split()[rng.randrange(4) :]) + " " + say(9) for _ in range(12)]
    want = {}
    for t, text in enumerate(texts):
        bare = text.replace(" ", "")
        for i, _, item in items:
            parts = item.split()
            longest = 0
            for s in range(len(parts) - 4):
                rest, need = "".join(parts[s:]), len("".join(parts[s : s + 5]))
                n = max(n for n in range(len(rest) + 1) if rest[:n] in bare)
                longest = max(longest, n if n >= need else 0)
            if longest:
                want[t, i] = longest
    got = K.search_shard(test, texts)
    assert {(t, i): n for t, i, _, n in got} == want
    for t, i, at, n in got:
        assert re.sub(r"\W", "", texts[t][at:])[:n] in dict((i, x.replace(" ", "")) for i, _, x in items)[i]


def test_shared_instructions_are_cut_and_shared_passages_are_not(spark):
    first, *rest = ["The keeper of the mill told us.", *(f"Then guest {i} left for the hills with a load of {i} stones and rope" for i in range(9))]
    rows = [(i, "en", "Question: " + rest[i]) for i in range(2)] + [(i, "en", first + " " + rest[7]) for i in range(2, 7)] + [(8, "en", "Only one. " + rest[8])]
    items = spark.createDataFrame(rows, "item_id bigint, lang string, text string")
    got = {r["item_id"]: r["text"] for r in K._with_openings_cut(items, words=12, chars=24).collect()}
    assert got == {i: t.removeprefix("Question: ") for i, _, t in rows}


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"see {ITEM.replace('972', str(i))} end") for i in range(6)], "doc_id bigint, text string")
    items = spark.createDataFrame([(10 + i, "en", ITEM.replace("972", str(i))) for i in range(6)], "item_id bigint, lang string, text string")
    whole = {tuple(r) for r in K.leaked_items(docs, items).collect()}
    monkeypatch.setattr(K, "BLOCK_CHARS", 200)
    assert {tuple(r) for r in K.leaked_items(docs, items).collect()} == whole and len(whole) == 36


def test_leaks_end_to_end(spark):
    docs = spark.createDataFrame([(1, "see " + ITEM + " end", "a"), (2, None, "b"), (3, "nothing", "c"), (1, "see " + ITEM + " end", "a")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(10, "s", "en", ITEM), (11, "s", "en", None), (12, "s", None, "too short")], "item_id bigint, suite string, lang string, text string")
    rows = K.leaked_items(docs, items).collect()
    assert [(r["doc_id"], r["item_id"], r["place"]) for r in rows] == [(1, 10, 4)]
    assert K.leaked_items(docs, items.limit(0)).count() == 0 and K.leaked_items(docs.limit(0), items).count() == 0


def test_affected_documents_are_removed(spark):
    docs = spark.createDataFrame([(1, "see " + ITEM + " end"), (2, None), (3, "nothing"), (None, "nothing"), (1, "another")], "doc_id bigint, text string")
    items = spark.createDataFrame([(10, "en", ITEM)], "item_id bigint, lang string, text string")
    assert {tuple(r) for r in K.without_leaks(docs, K.leaked_items(docs, items)).collect()} == {(2, None), (3, "nothing"), (None, "nothing")}


PAGE = """Support > About us > Press > Home
Home / Press / How it works

How we handle isotope and charge
- See the plasma first, then the genome.
Share this: Mail  Print  Copy link
The polymer replaced the trial at the works.
Most read this week
Notes on the dairy and hive
From cell to rash
We and 66 partners use cookies for measurement.
> We and 77 partners use cookies for measurement.
© 2024 Emsurami Docs. All rights reserved.
Back to top"""


def test_page_lines():
    want = seed_labels(PAGE)
    f = line_features([PAGE])
    got = block_net().scores(f) > 0
    assert got.tolist() == [w == 1 for w in want if w >= 0]
    assert [i + 1 for i, w in enumerate(want) if w == 1] == [1, 2, 6, 8, 9, 10, 11, 13, 14]


def test_pages_end_to_end(spark):
    rows = [(1, PAGE, "web", "a"), (2, PAGE, "wiki", "a"), (3, None, "web", "a"), (4, " \n\n ", "web", "a"), (5, "", "web", "a"), (1, PAGE, "web", "a"), (6, "Back to top\n" + "long text. " * 20000, "web", "a"), (7, PAGE, None, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, line_no string")
    got = {(r["doc_id"], r["line_no"]) for r in furniture_lines(df).collect()}
    assert {d for d, _ in got} <= {1, 6} and {n for d, n in got if d == 1} == {1, 2, 6, 8, 9, 10, 11, 13, 14}
    assert furniture_lines(df).count() == len(got) and furniture_lines(df.limit(0)).count() == 0


def test_scores_do_not_depend_on_company():
    pages = [PAGE, "One line", PAGE.replace("\n", "\n\n"), "\n".join(PAGE.split("\n") * 5)]
    alone = np.concatenate([block_net().scores(line_features([p])) for p in pages])
    together = block_net().scores(line_features(pages))
    assert np.allclose(alone, together, atol=1e-4)


WORDS = {"law": "court plaintiff statute bailiff appeal verdict".split(), "sport": "goalkeeper stadium referee podium relay coach".split(), "energy": "turbine boiler inverter feeder rotor grid".split()}
FILLER = ["Please add comments before Friday.", "Nothing else was decided.", "Open question: who owns this page?"]


def write(rng, subject, n):
    w = WORDS[subject]
    return [f"The {rng.choice(w)} replaced the {rng.choice(w)} near the {rng.choice(w)}." for _ in range(n)]


def corpus(n=150):
    rng = random.Random(5)
    docs, truth = [], {}
    for i in range(n):
        main, other = rng.sample(sorted(WORDS), 2)
        split = rng.choice([(8, 0), (6, 4), (9, 1)])
        parts = write(rng, main, split[0]) + write(rng, other, split[1]) + rng.choices(FILLER, k=4)
        rng.shuffle(parts)
        docs.append((i, " ".join(parts), "en", "wiki", "x"))
        truth[i] = {main} | ({other} if split[1] / len(parts) >= 0.25 else set())
    return docs, truth


def test_subjects_of_held_out_documents(spark):
    docs, truth = corpus()
    labels = [(i, i, next(iter(sorted(truth[i]))).upper() + " ", "lab") for i in range(0, 150, 2)] + [(900, 4, None, "lab"), (901, 6, "unheard of", "lab"), (902, None, "law", "lab")]
    d = spark.createDataFrame([*docs, (500, None, "en", "web", "x"), (501, " ", None, None, "x"), (502, " ".join(FILLER * 3), "en", "wiki", "x"), (0, docs[0][1], "en", "wiki", "x")], "doc_id bigint, text string, lang string, source string, subject_no string")
    lab = spark.createDataFrame(labels, "label_id bigint, doc_id bigint, subject_no string, labeller string")
    sub = spark.createDataFrame([(s, "") for s in WORDS], "subject_no string, scope_note string")
    got = {}
    for r in S.document_subjects(d, lab, sub).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject_no"])
    held = [i for i in range(1, 150, 2)]
    assert sum(got.get(i) == truth[i] for i in held) >= 0.9 * len(held)
    assert not {500, 501, 502} & set(got)
    assert S.document_subjects(d, lab.limit(0), sub).count() == 0 and S.document_subjects(d.limit(0), lab, sub).count() == 0


def test_acceptance_is_calibrated_on_all_documents(spark, monkeypatch):
    docs, truth = corpus()
    labels = [(i, i, min(truth[i]), "lab") for i in range(0, 150, 2)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, subject_no string")
    lab = spark.createDataFrame(labels, "label_id bigint, doc_id bigint, subject_no string, labeller string")
    seen = []
    monkeypatch.setattr(S, "_valley", lambda x, *n: seen.append(int(n[0].sum()) if n else len(x)) or S.CLEAR)
    S.document_subjects(d, lab, spark.createDataFrame([(s, "") for s in WORDS], "subject_no string, scope_note string"))
    assert seen == [int(S.cut_sentences([r[1] for r in docs]).full.sum())]


def test_texts_are_cut_once(spark, monkeypatch):
    docs, truth = corpus()
    labels = [(i, i, min(truth[i]), "lab") for i in range(0, 150, 2)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, subject_no string")
    lab = spark.createDataFrame(labels, "label_id bigint, doc_id bigint, subject_no string, labeller string")
    seen, cut = spark.sparkContext.accumulator(0), S.cut_sentences

    def counted(texts):
        seen.add(len(texts))
        return cut(texts)

    monkeypatch.setattr(S, "cut_sentences", counted)
    S.document_subjects(d, lab, spark.createDataFrame([(s, "") for s in WORDS], "subject_no string, scope_note string")).collect()
    assert seen.value == len(docs) + len(labels)  # the labelled ones at the driver besides


def test_sentences():
    s = S.cut_sentences(["# Title here\nOne two three. Four five six?\n- alpha\n- beta\n```\ncode it now.\n```\n第一句话。第二句话。", "", "a wrapped line that goes on and on until the margin\nends here."])
    assert s.full.sum() == 5 and s.text.tolist().count(0) == 7 and s.text.tolist().count(2) == 1
