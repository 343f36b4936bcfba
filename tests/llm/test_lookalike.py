import unicodedata

import pytest

from lexiflow.llm import lookalike as L


@pytest.fixture(scope="module")
def lattice(spark):
    texts = ["Does the old book hold", "новая книга и старый дом", "Ответ был добрый"] * 5
    return L.train(spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string"))


CASES = {
    "Dоеs": "Does", "ＦＵＬＬ ｗidth，": "FULL width,", "reconﬁguration": "reconfiguration", "a­b​c⁠﻿": "abc", "éë": "éë",
    "a b c d": "a b c d", "новaя книгa": "новая книга", "\U0001f469‍\U0001f4bb x‍y": "\U0001f469‍\U0001f4bb xy", "Еще ещё": "Еще ещё",
    "𝐡𝐞𝐥𝐥𝐨": "hello", "a\ufe0fb\U000e0061": "ab", "❤\ufe0f": "❤\ufe0f", "ՏոսքL": "ՏոսքԼ", "ᎢᎬᎢ": "TET", "ᏣᎳᎩ": "ᏣᎳᎩ", "m² ½ ① ™": "m² ½ ① ™",
    "Βοοk": "Book", "plain “text” … – №5": "plain “text” … – №5", "": "", "​": "",
}


@pytest.mark.parametrize("text", CASES)
def test_one_form(lattice, text):
    assert lattice.text(text) == CASES[text]


def test_form_depends_on_the_look_alone(lattice):
    for word in ("cope", "HEAT", "OXE", "book", "сор", "Вот так"):
        swaps = {**{k: v for k, v in L.CYRILLIC.items()}}
        other = "".join(swaps.get(c, c) for c in word)
        greek = "".join(L.GREEK.get(c, c) for c in word)
        assert lattice.text(word) == lattice.text(other) == lattice.text(greek)
        assert lattice.text(lattice.text(word)) == lattice.text(word)


def test_case_accents_and_signs_stay(lattice):
    for text in ("É e E é", "a-b, c.", "ŽIVOT żółć ß", "naïve café", "x\n\ty  z"):
        assert lattice.text(text) == unicodedata.normalize("NFC", text)


def test_pairs(spark, lattice):
    rows = [(1, "the bоok is old"), (2, "the book is old"), (3, "the  book is\told\n"), (4, "the Book is old"), (5, "the book, is old"), (6, "the bo​ok is old"), (7, None), (None, "the book is old"), (8, ""), (9, " ​ "), (2, "the book is old"), (10, "x" * 100_000)]
    df = spark.createDataFrame(rows, "id long, t string").withColumnRenamed("t", "form")
    got = {tuple(r) for r in L.equal_looking_pairs(df, "id", "form", lattice).collect()}
    assert got == {(1, 2), (1, 3), (1, 6), (2, 6), (3, 6)}
    assert {tuple(r) for r in L.equal_looking_pairs(df, "id", "form", lattice, min_runs=5).collect()} == set()
    assert L.equal_looking_pairs(df.limit(0), "id", "form", lattice).count() == 0


def test_batches(lattice):
    texts = [*CASES, "plain", "\U0010ffff x", "e\u0301", "x\x0by"]
    assert lattice.texts(texts) == [lattice.text(t) for t in texts]
    assert lattice.texts([]) == []


def test_classes(spark, lattice):
    rows = [(5, "the bоok"), (2, "the book"), (3, "the  book"), (6, "the bo\u200bok"), (9, "other"), (10, "other"), (None, "the book"), (4, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {tuple(r) for r in L.equal_looking_classes(df, "id", "text", lattice).collect()}
    assert got == {(2, 2, 4, 3, 2), (3, 2, 4, 3, 2), (5, 2, 4, 3, 3), (6, 2, 4, 3, 3)}


def test_normalize(spark, lattice):
    df = spark.createDataFrame([(1, "Dоes", "old"), (2, None, "old")], "id long, text string, normal string")
    assert [r["normal"] for r in L.normalize(df, "text", lattice).orderBy("id").collect()] == ["Does", None]
