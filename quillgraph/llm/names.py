"""Variant spellings of persons and organisations, by suffix blocking and longest-common-subsequence comparison.

Every row's name is split into folded words, titles and legal forms fall away, and the suffixes of the words that tell
names apart are indexed within a graph. Suffixes that are overly common are refined with the names a description holds
and with what the rest of the name must look like, where a row without one meets all the others, and worked on in
parts; none is discarded. Pairs that share a suffix are compared word by word by the ratio of their longest common
subsequence, with initials, short forms and abbreviations; descriptions confirm or refute.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .components import connected_groups
from .survivors import is_stand_in

#: Letters a suffix must have; rows a suffix may have within a graph before it is refined, and about as many rows a part has then.
MIN_SUFFIX, COMMON, PART = 4, 60, 2000
#: Least ratio of the longest common subsequence for two words to be spellings of each other.
WORD_RATIO = 0.78

_TITLES = set("mr mrs ms mx miss dr prof professor sir dame herr frau señor senor señora senora don doña dipl ing jr sr".split())
_LEGAL = set(
    "sa ag gmbh ltd limited inc incorporated corp corporation co company llc plc bv nv srl spa sarl kg ohg aktiengesellschaft "
    "sociedadanonima sociedadanónima sociedad anonima gesellschaft mbh gesellschaftmbh".split()
)
_SMALL = set("the of and for de la del der die das und y & von zu".split())
#: Given names and the short forms people use for them (public knowledge, one line a name).
_SHORT_FORMS = """
abigail abby gail abi; alexander alex sasha xander sandy al; andreas andi dre andy; benjamin ben benny benji; charlotte charlie lottie lotte; dorothea thea dora dot dorothy;
edward ed ned ted eddie; elizabeth liz betty beth eliza lisa lizzie bess; francisca fran paca frances cisca; frederik fred rik freddy freddie; gabriele gabi gaby; guadalupe lupe lupita;
henrietta harriet etta hattie hetty; ignacio nacho iggy; ines ine agnes; isabella izzy bella isa belle; johannes hannes jo hans john; jonathan jon jonny john; jurgen jogi juergen; katherine kit kathy kate kat katie;
leonard len leo lenny; margaret greta peg maggie meg peggy; mathilde tilly tilda; mehmed memo; nathaniel nat nate; oddvar odd; penelope nell penny; priyanka priya; richard rick rich dick ricky;
robert rob bob bobby robbie bert; rosalind roz rosa rose; samuel sam sammy; susanna sue sanna susie suzy; theodore theo ted teddy; tobias tobi toby; victoria vicky tori vic; wilhelmina willa mina minnie;
william bill will liam billy; zachary zach zack zac; thomas tom tommy; michael mike mick; james jim jimmy; joseph joe pepe; francisco paco pancho; jose pepe; antonio toni tony; anthony tony; christopher chris; daniel dan danny;
david dave; jennifer jen jenny; patricia pat trish patty; rebecca becky; stephen steve; catherine cathy kate; matthew matt; nicholas nick; gregory greg; timothy tim; peter pete; philip phil; eleanor nell ellie nora
"""  # fmt: skip
_SHORT: dict[str, set[str]] = {}
for _line in _SHORT_FORMS.replace("\n", " ").split(";"):
    _full, *_forms = _line.split()
    for _form in _forms:
        _SHORT.setdefault(_form, set()).add(_full)

#: Words of descriptions that say how something is put, not what.
_HOW = set(
    "a an and as at by for from in into is it its of on or out over the that to under up was were which who with works work working worked based located runs run reports report reporting "
    "go goes seat seats office offices headquartered headquarters since".split()
)
#: Share of a kind's descriptions from which a word counts as common, which bounds their number, and the descriptions in
#: which two common words would meet by chance, if they never do, to count as alternatives.
COMMON_WORD, ALTERNATIVE = 0.01, 5


def fold(text: str) -> str:
    """Lower case without accents."""
    out = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).casefold())
    return "".join(c for c in out if not unicodedata.combining(c))


@lru_cache(maxsize=200_000)
def lcs_ratio(a: str, b: str) -> float:
    """2 LCS(a, b) / (|a| + |b|), by bit-parallel dynamic programming."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return 2 * (len(a) - v.bit_count()) / (len(a) + len(b))


def person_words(name: str) -> tuple[list[str], str]:
    """(given words, surname) of a typed name; initials stay single letters, "Last, First" is turned round."""
    text = name.strip()
    if text.count(",") == 1:
        last, first = (p.strip() for p in text.split(","))
        if last and first and fold(first).strip(" .") not in _TITLES:
            text = f"{first} {last}"
    raw = [w for w in re.split(r"[\s,]+", text.replace("_", " ")) if re.search(r"\w", w)]
    letters = [w for w in raw if len(w) > 3]
    if len(raw) > 1 and raw[0].isupper() and len(raw[0]) > 3 and any(not w.isupper() for w in letters[1:]):
        raw = [*raw[1:], raw[0]]  # SURNAME Given
    words = []
    for w in raw:
        f = re.sub(r"[^\w]", "", fold(w))
        if not f or (f in _TITLES and len(raw) > 1):
            continue
        if w.isupper() and 1 < len(f) <= 3 and not text.isupper():
            words += list(f)  # initials written together
        else:
            words.append(f)
    if not words:
        return [], ""
    return words[:-1], words[-1]


def body_words(name: str) -> list[str]:
    """Words of an organisation's name without legal form, articles and prepositions."""
    text = fold(name).replace("g.m.b.h", "gmbh").replace("s.a.", "sa")
    words = [re.sub(r"[^\w]", "", w) for w in re.split(r"[\s,/]+", text)]
    words = [w for w in words if w]
    kept = [w for w in words if w not in _LEGAL and w not in _SMALL]
    return kept or words


def evidence(description: str | None) -> tuple[list[str], list[str]]:
    """(words of names, other words) of a description, folded, each once; a capital letter makes a name, at the beginning
    only if a name or a separator follows."""
    text = description or ""
    found = [(m.group(), m.end()) for m in re.finditer(r"[^\W_]+(?:-[^\W_]+)*", text)]
    named: dict[str, None] = {}
    plain: dict[str, None] = {}
    for i, (word, end) in enumerate(found):
        f = fold(word)
        if f in _HOW:
            continue
        name = word[0].isupper()
        if name and i == 0:
            name = text[end : end + 1] in tuple(":,;(") or (text[end : end + 1] == " " and len(found) > 1 and found[1][0][0].isupper())
        (named if name else plain)[f] = None
    return list(named), list(plain)


def _abbreviates(short: str, word: str) -> bool:
    """The letters of ``short`` occur in ``word`` in order, from its first letter on."""
    if not 2 <= len(short) < len(word) or short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


def _same_word(a: str, b: str) -> bool:
    return lcs_ratio(a, b) >= WORD_RATIO and abs(len(a) - len(b)) <= 2


def _wording(a: str, b: str) -> bool:
    """Whether two words of descriptions can be wordings of one thing."""
    return a == b or _abbreviates(a, b) or _abbreviates(b, a) or (len(a) > 4 and len(b) > 4 and a[:5] == b[:5])


def contradict(a: tuple[list[str], list[str]], b: tuple[list[str], list[str]], alternatives: set[tuple[str, str]]) -> bool:
    """Whether two descriptions' (names, other words) cannot be of the same one: both hold names of which neither has all
    of the other's, or what each says besides are alternatives of each other."""
    if a[0] and b[0] and not (set(a[0]) <= set(b[0]) or set(b[0]) <= set(a[0])):
        return True
    left = [w for w in a[1] if not any(_wording(w, x) for x in b[1])]
    right = [w for w in b[1] if not any(_wording(w, x) for x in a[1])]
    for few, many in ((left, right), (right, left)):
        if len(few) == 1 and few[0] == "".join(w[0] for w in many):  # initials of what the other spells out
            return False
    return any((min(u, v), max(u, v)) in alternatives for u in left for v in right)


def _given_match(a: str, b: str) -> int:
    """2 for spellings or short forms of one given name, 1 for an initial, 0 for different names."""
    if a == b:
        return 2
    if len(a) == 1 or len(b) == 1:
        return int(a[0] == b[0])
    if _same_word(a, b):
        # of two names that both exist, a near spelling is no typo
        return 2
    full_a = _SHORT.get(a, set()) | {a}
    full_b = _SHORT.get(b, set()) | {b}
    if full_a & full_b:
        return 2
    short, long = sorted((a, b), key=len)
    for form, fulls in _SHORT.items():  # a mistyped short form
        if (abs(len(form) - len(short)) <= 1 and lcs_ratio(form, short) >= (0.75 if len(short) > 3 else 0.66)) and any(_same_word(f, long) for f in fulls):
            return 2
    return 0


@lru_cache(maxsize=400_000)
def person_match(a: str, b: str) -> int:
    """2 for one name under two spellings, 1 where only an initial speaks for it, 0 otherwise."""
    ga, sa = person_words(a)
    gb, sb = person_words(b)
    if not sa or not sb:
        return 0
    if not ga or not gb:
        if not ga and not gb:
            return 2 if _same_word(sa, sb) else 0
        alone, given, last = (sa, gb, sb) if not ga else (sb, ga, sa)
        # initial and surname run together, as in a user name
        if alone[0] == given[0][0] and len(alone) > len(last) - 1 and lcs_ratio(alone[1:], last) >= 0.85:
            return 1
        return 1 if lcs_ratio(alone, last) >= 0.88 else 0
    if not _same_word(sa, sb):
        return 0
    if len(sa) < 4 and sa != sb:
        return 0
    first = _given_match(ga[0], gb[0])
    if first == 2 and len(ga) > 1 and len(gb) > 1 and ga[1][0] != gb[1][0]:
        return 1
    return first


@lru_cache(maxsize=400_000)
def body_match(a: str, b: str) -> int:
    """As ``person_match`` for organisations; words may come in any order."""
    wa, wb = body_words(a), body_words(b)
    if not wa or not wb:
        return 0
    if len(wa) == 1 or len(wb) == 1:
        if len(wa) == len(wb):
            return 2 if _same_word(wa[0], wb[0]) else 0
        one, many = (wa, wb) if len(wa) == 1 else (wb, wa)
        if one[0] == "".join(w[0] for w in many):
            return 1
        if sorted(one[0]) == sorted(w[0] for w in many):
            return 1
        return 2 if lcs_ratio(one[0], "".join(many)) >= 0.93 else 0
    if len(wa) != len(wb):
        return 2 if lcs_ratio("".join(wa), "".join(wb)) >= 0.95 else 0
    left = list(wb)
    weakest = 2
    for w in sorted(wa, key=len, reverse=True):
        best, level = None, 0.0
        for x in left:
            if w == x:
                score = 4.0
            elif len(w) > 1 and len(x) > 1 and _same_word(w, x):
                score = 2 + lcs_ratio(w, x)
            elif _abbreviates(w, x) or _abbreviates(x, w):
                score = 1.5
            elif (len(w) == 1 or len(x) == 1) and w[0] == x[0]:
                score = 1.0
            else:
                continue
            if score > level:
                best, level = x, score
        if best is None:
            return 0
        if level == 1.0:
            weakest = 1
        left.remove(best)
    return weakest


def judge(kind: str, a: tuple, b: tuple, alternatives: set[tuple[str, str]] = frozenset()) -> int:
    """2 to link, 1 to link unless another candidate fits as well, 0 to keep apart; a and b: (name, names in the
    description, its other words)."""
    name = (person_match if kind == "Person" else body_match)(a[0], b[0])
    if not name or contradict(a[1:], b[1:], alternatives):
        return 0
    return 2 if name == 2 or (a[1] and b[1]) else 1


def _letters(word: str) -> int:
    """A bit for every letter of a word."""
    return sum({1 << (ord(c) % 61) for c in word})


def block_keys(kind: str, name: str) -> list[tuple[str, int, int]]:
    """(key, letters, length) under which a name meets others: suffixes of its words (persons: of the surname) with the
    word's letters and length; what a mistyped end leaves, and initials, without them."""
    if kind == "Person":
        _, surname = person_words(name)
        words = [surname] if surname else []
        # an end or a middle mistyped leaves no common suffix
        extra = [f"<{w[:MIN_SUFFIX]}" for w in words] + [f"^{w[:2]}{w[-2:]}" for w in words if len(w) > 4]
    else:
        words = body_words(name)
        extra = ["=" + "".join(sorted(w[0] for w in words) if len(words) > 1 else sorted(words[0]))] if words else []
        words = [w for w in words if len(w) > 1]
    keys = {(w[i:], _letters(w), len(w)) for w in words for i in range(max(len(w) - MIN_SUFFIX + 1, 1))}
    return sorted(keys | {(k, 0, 0) for k in extra})


@lru_cache(maxsize=100_000)
def refinements(kind: str, name: str) -> tuple[str, ...]:
    """Of the rest of a name, what two spellings share one of at least; none for names without a rest, which fit all.

    Persons: initials of the given name and of what it may be short for, and its end. Organisations: the first letters of
    all words, and their last ones.
    """
    if kind != "Person":
        words = body_words(name)
        return ("i" + "".join(sorted(w[0] for w in words)), "l" + "".join(sorted(w[-1] for w in words))) if len(words) > 1 else ()
    given, _ = person_words(name)
    if not given:
        return ()
    g = given[0]
    full = set(_SHORT.get(g, ()))
    if len(g) > 1:
        full |= {f for form, fulls in _SHORT.items() if abs(len(form) - len(g)) <= 1 and lcs_ratio(form, g) >= (0.75 if len(g) > 3 else 0.66) for f in fulls}
    keys = {"i" + w[0] for w in {g, *full}}
    if len(g) > 4:
        keys.add("e" + g[-3:])
    return tuple(sorted(keys))


_PROFILE = "id bigint, graph_no string, kind string, name string, named array<string>, plain array<string>"
_ENTRY = "block bigint, lead bigint, letters bigint, size int"


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield pd.DataFrame([(i, g, k, n, *evidence(d)) for i, g, k, n, d in rows.itertuples(index=False)], columns=["id", "graph_no", "kind", "name", "named", "plain"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lead, *rest = (c.to_pylist() for c in batch.columns)
        digests, many, letters, sizes = [], [], [], []
        for graph, kind, name in zip(*rest):
            keys = block_keys(kind, name)
            # a block is known by a digest; names that share one by chance are compared in vain
            own = hashlib.blake2b(f"{graph}\0{kind}\0".encode(), digest_size=8)
            for key, mask, size in keys:
                h = own.copy()
                h.update(key.encode())
                digests.append(h.digest())
                letters.append(mask)
                sizes.append(size)
            many.append(len(keys))
        columns = [pa.array(np.frombuffer(b"".join(digests), np.int64)), pa.array(np.repeat(np.array(lead, np.int64), many)), pa.array(letters, pa.int64()), pa.array(sizes, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "lead", "letters", "size"])


def _refined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield pd.DataFrame({"lead": rows["lead"], "named": rows["named"], "rest": [list(refinements(k, n)) for k, n in zip(rows["kind"], rows["name"])]})


def alternatives(descriptions: DataFrame) -> dict[str, set[tuple[str, str]]]:
    """By kind, pairs of common words that never stand in one description although chance would have them to.

    ``descriptions`` is (kind, plain). Words count as common from a share of COMMON_WORD of a kind's descriptions, so
    there are at most 1 / COMMON_WORD times the mean number of words of them; the counts cover all descriptions.
    """
    said = descriptions.filter("size(plain) > 0").select("kind", F.array_sort(F.array_distinct("plain")).alias("plain"))
    totals = {r[0]: r[1] for r in said.groupBy("kind").agg(F.count(F.lit(1))).collect()}
    if not totals:
        return {}
    least = F.create_map(*[x for k, n in totals.items() for x in (F.lit(k), F.lit(max(2.0, COMMON_WORD * n)))])
    counts = said.select("kind", F.explode("plain").alias("w")).groupBy("kind", "w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least[F.col("kind")])
    df = {(k, w): n for k, w, n in counts.toLocalIterator()}
    common = F.array(*[F.lit(w) for w in sorted({w for _, w in df})]).cast("array<string>")
    met = said.select("kind", F.array_intersect("plain", common).alias("ws")).filter("size(ws) > 1")
    met = met.select("kind", F.explode("ws").alias("u"), "ws").select("kind", "u", F.explode("ws").alias("v")).filter("u < v").distinct()
    together = {tuple(r) for r in met.toLocalIterator()}
    out: dict[str, set[tuple[str, str]]] = {}
    for kind, n in totals.items():
        words = sorted(w for k, w in df if k == kind)
        out[kind] = {(u, v) for i, u in enumerate(words) for v in words[i + 1 :] if df[kind, u] * df[kind, v] / n >= ALTERNATIVE and (kind, u, v) not in together}
    return out


def same_entity_pairs(nodes: DataFrame, *, kinds: tuple[str, ...] = ("Person", "Organization")) -> DataFrame:
    """(id_a, id_b), smaller first, of rows of one graph that name the same person or the same organisation.

    The kind is the prefix of graph_node_no. Rows with a null or blank name, id or graph_no take no part; null,
    blank and stand-in descriptions are no evidence; rows that agree in name and evidence are compared once and linked
    to one another; ids are taken to be distinct and repeated rows count once; other columns are ignored; an empty
    table gives an empty result. Links are closed transitively, a link by initial alone only if a single entity fits.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "names")
    rows = nodes.withColumn("kind", F.element_at(F.split("graph_node_no", ":"), 1)).filter(F.col("kind").isin(*kinds))
    rows = rows.filter(F.col("id").isNotNull() & F.col("graph_no").isNotNull() & ~is_stand_in(F.col("name")))
    rows = rows.select(F.col("id").cast("bigint").alias("id"), "graph_no", "kind", F.trim("name").alias("name"), F.when(~is_stand_in(F.col("description")), F.col("description")).alias("description"))
    profiles = scratch.write(rows.mapInPandas(_profiles, _PROFILE))
    look = ["graph_no", "kind", "name", "named", "plain"]
    # Rows that look alike in everything compared stand behind the smallest of them.
    leaders = scratch.write(profiles.groupBy(*look).agg(F.min("id").alias("lead")))
    entries = scratch.write(leaders.select("lead", "graph_no", "kind", "name").mapInArrow(_entries, _ENTRY))
    counts = entries.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counted = scratch.write(entries.join(counts, "block"))
    rare = counted.filter(F.col("n") <= COMMON).select("block", "lead", "letters", "size")
    met = rare.join(_renamed(rare), "block").filter("lead < other").filter(_can_match()).select("lead", "other")
    common = counted.filter(F.col("n") > COMMON)
    refined = leaders.join(common.select("lead").distinct(), "lead", "left_semi").select("lead", "kind", "name", "named").mapInPandas(_refined, "lead bigint, named array<string>, rest array<string>")
    met = scratch.write(met.unionByName(_met_in_parts(common.join(refined, "lead"))).distinct())
    side = lambda n, s: leaders.select(F.col("lead").alias(n), *[F.col(c).alias(f"{c}{s}") for c in look[1:]])
    nested = (F.size("named_a") == 0) | (F.size("named_b") == 0) | (F.size(F.array_intersect("named_a", "named_b")) == F.least(F.size("named_a"), F.size("named_b")))
    candidates = met.join(side("lead", "_a"), "lead").join(side("other", "_b"), "other").filter(nested)
    apart = alternatives(leaders.select("kind", "plain"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            columns = (b[c] for c in ("kind_a", "name_a", "named_a", "plain_a", "name_b", "named_b", "plain_b"))
            verdict = [judge(k, (na, list(ca), list(pa)), (nb, list(cb), list(pb)), apart.get(k, frozenset())) for k, na, ca, pa, nb, cb, pb in zip(*columns)]
            out = pd.DataFrame({"a": b["lead"], "b": b["other"], "level": verdict})
            hit = out["level"] > 0
            out, b = out[hit], b[hit]
            out["weak_a"], out["weak_b"] = ([_is_weak(k, n) for k, n in zip(b["kind_a"], b[c])] for c in ("name_a", "name_b"))
            yield out

    judged = scratch.write(candidates.mapInPandas(compare, "a bigint, b bigint, level int, weak_a boolean, weak_b boolean"))
    strong = judged.filter("level = 2").select("a", "b")
    alone = leaders.select(F.col("lead").alias("a"), F.col("lead").alias("b"))
    groups = scratch.write(connected_groups(strong.unionByName(alone), spark))
    of = lambda c: groups.select(F.col("id").alias(c), F.col("root").alias(f"group_{c}"))
    weak = judged.filter("level = 1").join(of("a"), "a").join(of("b"), "b").filter("group_a <> group_b")
    open_ = weak.select(F.explode(F.array(F.struct(F.col("group_a").alias("g"), F.col("group_b").alias("h"), F.col("weak_a").alias("w")), F.struct(F.col("group_b").alias("g"), F.col("group_a").alias("h"), F.col("weak_b").alias("w")))).alias("x")).select("x.*")
    # a side that rests on initials may fit one entity only
    torn = open_.filter("w").groupBy("g").agg(F.count_distinct("h").alias("fits")).filter("fits > 1").select("g")
    torn = scratch.write(torn)
    sure = weak.join(torn.select(F.col("g").alias("group_a")), "group_a", "left_anti").join(torn.select(F.col("g").alias("group_b")), "group_b", "left_anti")
    links = groups.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(sure.select("a", "b"))
    final = scratch.write(connected_groups(links, spark))
    members = profiles.select("id", *look).distinct().alias("p").join(leaders.select("lead", *look).alias("l"), [F.col(f"p.{c}").eqNullSafe(F.col(f"l.{c}")) for c in look]).select("p.id", "lead")
    members = scratch.write(members.join(final.select(F.col("id").alias("lead"), "root"), "lead").select("id", "root"))
    return members.select(F.col("id").alias("id_a"), "root").join(members.select(F.col("id").alias("id_b"), "root"), "root").filter("id_a < id_b").select("id_a", "id_b")


def _renamed(entries: DataFrame) -> DataFrame:
    return entries.withColumnsRenamed({"lead": "other", "letters": "letters_b", "size": "size_b"})


def _can_match() -> Column:
    """Whether two words (letters, size) can reach the least ratio: letters that the other lacks are in no subsequence."""
    shared = F.least(F.col("size") - F.bit_count(F.col("letters").bitwiseAND(F.bitwise_not("letters_b"))), F.col("size_b") - F.bit_count(F.col("letters_b").bitwiseAND(F.bitwise_not("letters"))))
    return (F.col("letters") == 0) | (F.col("letters_b") == 0) | (2 * shared >= (F.col("size") + F.col("size_b")) * (WORD_RATIO - 1e-9))


def _met_in_parts(entries: DataFrame) -> DataFrame:
    """(lead, other), smaller first, of the pairs of overly common blocks that names in descriptions and the rest of the
    name do not rule out.

    Rows are told apart by which of the two they have. Where both have names, one's are all among the other's, so they
    meet under the first of the fewer; where both have a rest of the name, under one they share; a row without meets
    all. The rows of a key are dealt to parts of about PART and every two parts meet in a task.
    """
    has = F.when(F.size("named") > 0, 1).otherwise(0) + F.when(F.size("rest") > 0, 2).otherwise(0)
    parts = F.ceil(F.col("n") / PART).cast("int")
    dealt = entries.withColumns({"has": has, "part": F.pmod(F.xxhash64("lead"), parts).cast("int"), "parts": F.sequence(F.lit(0), parts - 1)})
    key = ["block", "has_a", "has_b", "part_a", "part_b", "same_name", "same_rest"]

    def side(own: str, its: str) -> DataFrame:
        d = dealt.withColumn(f"has_{own}", F.col("has")).withColumn(f"has_{its}", F.explode(F.array(*map(F.lit, range(4))))).filter("has_a <= has_b")
        d = d.withColumn(f"part_{own}", F.col("part")).withColumn(f"part_{its}", F.explode("parts"))
        both = F.col("has_a").bitwiseAND(F.col("has_b"))
        tagged = lambda t: F.transform("named", lambda x: F.concat(F.lit(t), x))
        first = lambda t: F.array(F.concat(F.lit(t), F.array_min("named")))
        names = F.concat(tagged(own), first(its))
        d = d.withColumn("same_name", F.explode(F.when(both.bitwiseAND(F.lit(1)) > 0, names).otherwise(F.array(F.lit("")))))
        return d.withColumn("same_rest", F.explode(F.when(both.bitwiseAND(F.lit(2)) > 0, F.col("rest")).otherwise(F.array(F.lit(""))))).select(*key, "lead", "letters", "size")

    met = side("a", "b").join(_renamed(side("b", "a")), key).filter("lead <> other").filter(_can_match())
    return met.select(F.least("lead", "other").alias("lead"), F.greatest("lead", "other").alias("other"))


def _is_weak(kind: str, name: str) -> bool:
    if kind == "Person":
        given, _ = person_words(name)
        return not given or len(given[0]) == 1
    words = body_words(name)
    return len(words) == 1 or any(len(w) == 1 for w in words)
