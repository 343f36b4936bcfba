import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiflow.operators.docs import assemble, doc_text
from lexiflow.operators.rules import DEFAULT, TokenizerRules
from lexiflow.operators.segment import segment_rows
from lexiflow.operators.tokenize import Splitter, space_tokenize, token_rows, tokenize, tokenize_documents

SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0       　"


def walked(text, rules=DEFAULT):
    """Character by character: the plain reading of the rules."""
    runs, out = [], []
    for c in text:
        if runs and runs[-1][0].isspace() == c.isspace():
            runs[-1] += c
        else:
            runs.append(c)
    for i, run in enumerate(runs):
        if run[0].isspace():
            if i:
                run = run[1:]
            if run:
                out.append([run, i == len(runs) - 1])
        else:
            spaced = i + 1 < len(runs)
            pieces = rules.split(run)
            out += [[p, False] for p in pieces]
            if out:
                out[-1][1] = spaced
    return [tuple(x) for x in out]


TEXTS = ["", "lorem", "I love apples", "I  love apples ", " I love ", "\n", "a\nb", "a \n", "   ", "don't (don't)", "x ~abc y", "\t\tab  cd", "a\U0001f600\U0001f600b c", "it's 10am.\r\n"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab.,-'5$ (\U0001f600" + SPACES), max_size=24))
def test_splitter_is_the_walk(text):
    words, flags = Splitter(DEFAULT).text(text)
    assert list(zip(words, flags, strict=True)) == walked(text)


def test_flags_of_examples():
    split = Splitter(DEFAULT).text
    assert split("I  love apples ") == (["I", " ", "love", "apples"], [True, False, True, True])
    assert split(" I love ") == ([" ", "I", "love"], [False, True, True])
    assert split("\n") == (["\n"], [True]) and split("a \n") == (["a", "\n"], [True, True]) and split("   ") == (["   "], [True])


def test_dropped_word_hands_its_blank_on():
    split = Splitter(TokenizerRules(infixes=["~"])).text
    assert split("x ~abc") == (["x"], [False]) and split("~abc") == ([], []) and split("x ~abc y") == (["x", "y"], [True, False])


def test_rows_arrays_and_native_segments(spark):
    rng = random.Random(5)
    texts = [*TEXTS, None, "ab " * 3000, *("".join(rng.choice("ab .,\n　") for _ in range(30)) for _ in range(40))]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, position string")
    want = {(i, p, *tok) for i, t in enumerate(texts) if t for p, tok in enumerate(walked(t))}
    assert {tuple(r) for r in tokenize(df, "doc_id").collect()} == want
    arrays = tokenize_documents(df)
    assert {tuple(r) for r in token_rows(arrays, "doc_id").collect()} == want
    assert {r[0]: r[1] for r in arrays.select("doc_id", F.size("tokens")).where("text is null or text = ''").collect()}.keys() == {0, len(TEXTS)}
    off = TokenizerRules((), (), (), {})
    assert {tuple(r) for r in segment_rows(df, "doc_id", "text").collect()} == {(i, p, *tok) for i, t in enumerate(texts) if t for p, tok in enumerate(walked(t, off))}


def test_partitioning_does_not_matter(spark):
    df = spark.createDataFrame([(i, TEXTS[i % len(TEXTS)]) for i in range(200)], "doc_id long, text string")
    results = [sorted(map(tuple, tokenize(df.repartition(n), "doc_id").collect())) for n in (1, 4, 16)]
    assert results[0] == results[1] == results[2]


def test_text_comes_back(spark):
    df = spark.createDataFrame([(1, "I love  (apples).  Yes"), (2, "a\tb")], "doc_id long, text string")
    rows = {r[0]: r[1] for r in assemble(tokenize(df, "doc_id"), "doc_id").select("doc_id", doc_text(F.col("tokens"))).collect()}
    assert rows == {1: "I love  (apples).  Yes", 2: "a b"}


def test_empty_table_and_string_key(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert tokenize(empty, "doc_id").collect() == [] and tokenize_documents(empty).collect() == [] and segment_rows(empty, "doc_id", "text").collect() == []
    assert tokenize(spark.createDataFrame([("k", "a b")], "doc_id string, text string"), "doc_id").count() == 2


@pytest.mark.parametrize(("text", "want"), [("a  b ", ["a", "", "b", ""]), ("", [""])])
def test_space_split(spark, text, want):
    rows = space_tokenize(spark.createDataFrame([(1, text)], "k long, text string"), "k").orderBy("position").collect()
    assert [r["text"] for r in rows] == want


def test_token_counts(spark):
    texts = {"Lorem, ipsum.": 4, "Lorem, (ipsum).": 6, "Lorem ipsum: 1984.": 5, "python.org": 1, "example.ai": 1, "matt@example.ai": 1}
    df = spark.createDataFrame([(t, t) for t in texts], "k string, text string")
    assert {r[0]: r[1] for r in tokenize(df, "k").groupBy("k").count().collect()} == texts
