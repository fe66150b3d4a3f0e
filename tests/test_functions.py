import random

from pyspark.sql import functions as F

from quillgraph.functions import keys as K
from quillgraph.functions import refs as R
from quillgraph.functions import text as X
from quillgraph.functions.vectors import cosine
from quillgraph.sources.files import source_class


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_keys(spark):
    lit = F.lit
    r = one(
        spark, a=K.node_no(lit("Asset"), lit("Solution"), lit("Ada Lovelace")), b=K.node_no(lit("Asset"), lit("Solution"), lit("  ada   lovelace ")), c=K.node_no(lit("Asset"), lit("Solution"), lit("AdStyle")),
        d=K.node_no(lit("Event"), None, lit("阿达")), e=K.slug(lit("Ａｄａ!")), f=K.slug(lit("?!")), g=K.chunk_no(lit("doc/a.md"), lit(0)),
    )
    assert r["a"] == r["b"] == "Asset:Solution:ada-lovelace"
    assert (r["c"], r["d"], r["e"], r["f"]) == ("Asset:Solution:adstyle", "Event:阿达", "ada", "unnamed")
    assert r["g"] == "c3d4141ba29f572a71b3de5bce6f5257"


def test_url_keys_ignore_scheme_query_and_slash(spark):
    urls = ["https://example.com/docs/page?x=1", "http://example.com/docs/page/", "example.com/docs/page#top"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(K.url_doc_no(F.col("u")).alias("k")).distinct()
    assert [r[0] for r in df.collect()] == ["url:example.com/docs/page"]


def test_lines_titles_and_numbers(spark):
    r = one(spark, lines=X.split_lines(F.lit("a\r\nb\x0bc d\n")), none=X.split_lines(F.lit("")), title=X.title(F.lit("\n  ## Hello\nx"), F.lit("id")), fallback=X.title(F.lit(" \n#"), F.lit("id")), numbered=X.numbered_text(F.lit("x\ny")), at=X.line_of_offset(F.lit("a\nb\nc"), F.lit(4)))
    assert r["lines"] == ["a", "b", "c", "d"] and r["none"] == []
    assert (r["title"], r["fallback"], r["numbered"], r["at"]) == ("Hello", "id", "[1] x\n[2] y", 3)


def test_searchable_text_skips_blank_and_non_string(spark):
    none = F.array().cast("array<string>")
    entries = X.typed_entries(F.lit('{"title": "Admiral", "age": 40, "office": " Arlington ", "k": "  "}'))
    r = one(spark, a=X.searchable_text(F.lit("Grace Hopper"), F.lit("Pioneer"), entries, F.array(F.lit("Amazing Grace"))), b=X.searchable_text(F.lit("Name"), F.lit(""), X.typed_entries(F.lit("not json")), none), c=X.searchable_text(F.lit(""), F.lit(None).cast("string"), X.typed_entries(F.lit("{}")), none))
    assert r["a"] == "Grace Hopper\nPioneer\noffice: Arlington\ntitle: Admiral\nAmazing Grace"
    assert (r["b"], r["c"]) == ("Name", "")


def test_json_tolerance_and_templates(spark):
    r = one(spark, a=X.json_block(F.lit('Sure:\n```json\n{"a": 1}\n```')), b=X.json_block(F.lit('x {"a": 2} y')), c=X.json_block(F.lit("none")), d=X.json_list(F.lit('ok ["q1","q2"] done')))
    assert (r["a"], r["b"], r["c"], r["d"]) == ('{"a": 1}', '{"a": 2}', None, ["q1", "q2"])
    assert X.fill_template("{{a}}-{{b}}", {"a": "{{b}}", "b": "2"}) == "{{b}}-2"


def _pieces(text, size, overlap):
    """One after the other, as the definition has it."""
    size, out, at = max(size, 1), [], 0
    overlap = min(max(overlap, 0), size - 1)
    while at < len(text):
        end = min(at + size, len(text))
        feeds = [i for i in range(at, end) if text[i] == "\n"]
        if end < len(text) and feeds and feeds[-1] - at > size // 2:
            end = feeds[-1]
        if text[at:end].strip():
            out.append((len(out), text[at:end].strip("\n"), 1 + text[:at].count("\n"), 1 + text[: max(at, end - 1)].count("\n")))
        if end == len(text):
            break
        at = end - overlap if end - overlap > at else end
    return out


def test_chunks():
    assert X.cut_pieces([], 10, 2) == [] == X.cut_pieces(["", "   \n  "], 100, 2)
    assert X.cut_pieces(["", "a\nb\nc"], 100, 20) == [(1, 0, "a\nb\nc", 1, 3)]
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é中\n\n 👩") for _ in range(rng.choice([0, 1, 7, 8, 9, 60, 300]))) for _ in range(60)] + ["x" * 100, "\n" * 50, "\ud800ab"]
    for size, overlap in ((8, 3), (20, 999), (1, 0), (0, -1), (30, 10)):
        assert X.cut_pieces(texts, size, overlap) == [(t, *p) for t, text in enumerate(texts) for p in _pieces(text, size, overlap)]


def test_tokens_refs_and_properties(spark):
    df = spark.createDataFrame([(t,) for t in ["3", "5-7", "7-5", "", "abc", None, " 4 "]], "t string").select(R.token_lines(F.col("t")).alias("n"))
    assert [r[0] for r in df.collect()] == [[3], [5, 6, 7], [5, 6, 7], [], [], [], [4]]
    both = spark.createDataFrame([({"d1": ["1", "2"], "d2": ["5"]}, {"d1": ["2", "3"], "d3": ["9"]}, '{"title":"t","office":"o"}', '{"title":"u","born":1815}')], "a map<string,array<string>>, b map<string,array<string>>, p string, q string")
    r = both.select(R.ref_union(F.col("a"), F.col("b")).alias("r"), R.merge_props(F.col("p"), F.col("q")).alias("p"), R.filter_ref(F.col("a"), ["d2"]).alias("f"), R.support(F.col("a")).alias("s")).first()
    assert r["r"] == {"d1": ["1", "2", "3"], "d2": ["5"], "d3": ["9"]} and r["f"] == {"d2": ["5"]} and r["s"] == 2
    import json

    assert json.loads(r["p"]) == {"title": "t", "office": "o", "born": 1815}


def test_cosine(spark):
    pairs = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([], [1.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), (None, [1.0], 0.0)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b")))
    assert [r[0] for r in df.collect()] == [w for *_, w in pairs]


def test_source_class(spark):
    rows = [("src/a.py", "x", "CODE"), ("docs/roadmap.md", "x", "PLAN"), ("a.md", "项目计划书", "PLAN"), ("a.md", "notes", "DOC"), ("plan.go", "plan", "CODE")]
    df = spark.createDataFrame([(p, t) for p, t, _ in rows], "p string, t string").select(source_class(F.col("p"), F.col("t")))
    assert [r[0] for r in df.collect()] == [w for *_, w in rows]


def test_html_text():
    assert X.html_text("<nav>Home</nav><h1>T</h1><p>a <b>b</b></p><script>x()</script>") == "T\na b"
