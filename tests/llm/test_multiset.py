import itertools
import random

import pytest

from lexiflow.llm import multiset as M
from lexiflow.llm.common import RUN
from lexiflow.llm.forms import Folded, folded

PAIRS = [("source", "Peirk word"), ("length", "24 m near Lo"), ("noted", "1750-06-14 by Tri"), ("title", "x: y")]
STYLES = {
    "tag": lambda p: " ".join(f"<{n}> {v}" for n, v in p), "dash": lambda p: ", ".join(f"{n} - {v}" for n, v in p), "json": lambda p: "{" + ", ".join(f'"{n}": "{v}"' for n, v in p) + "}",
    "bar": lambda p: " | ".join(f"{n}: {v}" for n, v in p), "tab": lambda p: "\t".join(f"{n}:{v}" for n, v in p), "equals": lambda p: "; ".join(f"{n}={v}" for n, v in p),
}


@pytest.mark.parametrize("style", STYLES)
def test_every_style_and_order_has_one_fingerprint(style):
    own = PAIRS[:3]
    want = M.multiset_hash(M.canonical_pairs(folded(STYLES["json"](own))))
    for order in itertools.permutations(own):
        text = STYLES[style](list(order)) + "\n"
        assert M.multiset_hash(M.canonical_pairs(folded(text))) == want
        assert M.multiset_hash(M.canonical_pairs(folded("- " + text.upper() if style != "dash" else text.title()))) == want


def test_values_belong_to_fields():
    swapped = [("source", "24 m near Lo"), ("length", "Peirk word"), PAIRS[2]]
    assert M.multiset_hash(M.canonical_pairs(STYLES["bar"](swapped))) != M.multiset_hash(M.canonical_pairs(STYLES["bar"](PAIRS[:3])))
    twice = [PAIRS[0], PAIRS[0], PAIRS[1]]
    assert M.multiset_hash(M.canonical_pairs(STYLES["tag"](twice))) != M.multiset_hash(M.canonical_pairs(STYLES["tag"](PAIRS[:2])))


def test_prose_keeps_its_order():
    assert M.fields("Note this: it is old. The book - it is said - is here") is None
    assert M.canonical_pairs(folded("The old   BOOK, isn't")) == [("", "theoldbookisnt")]
    assert folded("Straße") == folded("STRASSE") and folded("café") != folded("cafe")


def brute(rows, min_runs):
    groups = []
    for k, t in sorted({(k, t) for k, t in rows if k is not None and t is not None}):
        t = folded(t)
        if len(RUN.findall(t)) >= min_runs:
            own = {("fields", *sorted(M.canonical_pairs(t))), ("all", "".join(RUN.findall(t)))}
            touched = [g for g in groups if g[0] & own]
            groups = [g for g in groups if not g[0] & own] + [(own.union(*(g[0] for g in touched)), sorted([k, *(x for g in touched for x in g[1])]))]
    return {(g[0], k) for _, g in groups for k in g[1:]}


def test_like_brute_force(spark):
    rng = random.Random(3)
    rows = [(None, "a b c d e f g h"), (900, None), (901, ""), (902, "..."), (903, "w " * 60_000), (904, "W, " * 60_000)]
    for k in range(300):
        words = [rng.choice("alpha beta gamma delta".split()) for _ in range(rng.choice([2, 8, 9]))]
        text = rng.choice([" ", "  ", ", "]).join(words)
        if k % 3 == 0:
            p = [(n, " ".join(rng.choice(["one two", "two one", "x"]) for _ in range(2))) for n in rng.sample(["source", "title", "kind"], 3)]
            text = rng.choice(list(STYLES.values()))(p)
        rows.append((k, text.upper() if rng.random() < 0.3 else text))
    rows += [(k, "hot copy of eight words stands here now") for k in range(1000, 1200)] + [(1000, "hot copy of eight words stands here now")]
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "'x' AS fp", "1 AS k", "2 AS f").repartition(5)
    for least in (0, 8):
        assert {tuple(r) for r in M.copies(df, "id", "text", least).collect()} == brute(rows, least)
    texts = ["can't stop it, now or ever, one two", "CanT stop it now or ever one two", "54.3 km, a b c d e f", "543 km a b c d e f", "l'école est là où je la vois", "Lécole, est là, où, je, la, vois"]
    signs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert {tuple(r) for r in M.copies(signs, "id", "text", 6).collect()} == {(0, 1), (2, 3), (4, 5)}
    sizes = {r["k"]: r["copies"] for r in M.classes(df, "id", "text").collect()}
    assert sizes[1000] == sizes[1199] == 200
    assert M.copies(df.limit(0), "id", "text").count() == 0


def test_copies_that_lost_the_signs_of_their_fields(spark):
    """Fields in two orders, and each order without signs, make one class; prose that looks like fields goes with its copy."""
    p = PAIRS[:3]
    a, b = STYLES["bar"](p), STYLES["bar"](p[::-1])
    bare = lambda t: t.replace(":", "").replace("|", "").upper()
    prose = "In short: it is old, for example: the book is here"
    rows = [(1, bare(b)), (2, a), (3, b), (4, bare(a)), (5, prose), (6, bare(prose).replace(",", "")), (7, bare(a) + " x")]
    df = spark.createDataFrame(rows, "id long, text string")
    assert {tuple(r) for r in M.copies(df, "id", "text").collect()} == {(1, 2), (1, 3), (1, 4), (5, 6)}
    assert {tuple(r) for r in M.collapsed(df, "id", "text").collect()} == {(1, 4), (5, 2), (7, 1)}


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    assert not M.same_fields("a\x1fb\x1ec\x1fd", "a\x1fb\x1ec\x1fe") and M.same_fields("a\x1fb\x1ec\x1fd", "c\x1fd\x1ea\x1fb")
    rows = [(1, b"f", b"p", "\x1fone"), (2, b"f", b"p", "\x1ftwo"), (3, b"f", b"p", "\x1fone"), (4, b"f", b"q", "\x1fsix"), (5, b"g", b"r", "\x1fsix")]
    made = spark.createDataFrame(rows, "k long, fp binary, p binary, form string")
    monkeypatch.setattr(M, "fingerprints", lambda *_: made)
    assert {tuple(r) for r in M.copies(made, "k", "form").collect()} == {(1, 3)}


@pytest.mark.parametrize("style", [s for s in STYLES if s != "dash"])
def test_names_of_many_words(style):
    own = [("date of last change", "1750 06"), ("source", "Peirk word"), ("name of the 2 owners", "Lo Tri")]
    got = [M.canonical_pairs(folded(STYLES[style](list(order)))) for order in itertools.permutations(own)]
    assert all(dict(g) == {n.replace(" ", ""): v.casefold().replace(" ", "") for n, v in own} for g in got)


@pytest.mark.parametrize("sign", ["\n", "; ", ", ", " | ", "\t"])
@pytest.mark.parametrize("name", ["{}: {}", "{} : {}", "{}={}", "{} - {}"])
def test_any_sign_between_fields(sign, name):
    own = [("date of last change", "1750 06"), ("source", "Peirk word"), ("kind", "a")]
    got = {frozenset(M.canonical_pairs(folded(sign.join(name.format(n, v) for n, v in order)))) for order in itertools.permutations(own)}
    assert got == {frozenset({("dateoflastchange", "175006"), ("source", "peirkword"), ("kind", "a")})}


def test_fields_between_blanks():
    assert M.canonical_pairs("length:24 m near lo source:peirk word") == [("length", "24mnearlo"), ("source", "peirkword")]


def test_batches_fold_as_single_texts_do():
    texts = ["Don't buy 54.3 km, a-b", "", "ВОДА вода Boдa", "Νερο νan", "ﬁne e\u0301 x", "ＦＵＬＬ", "\U0010ffffa", "STRASSE Straße", "\u200b"]
    own = Folded(texts)
    for i, row in enumerate(own.row.tolist()):
        assert own.text(i) == folded(texts[row].replace("\U0010ffff", " "))
    words = dict(zip(own.row.tolist(), own.words(), strict=True))
    assert words[0] == "dont buy 543 km a b" and len(set(words[2].split())) == 1 and words[4] == "fine é x" and words[8] == ""


def test_clauses_between_dashes_are_prose():
    assert M.fields("That corpus asked the page - when that hill stood, the green section was our note - the dog found it") is None
