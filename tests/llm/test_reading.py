import random

import numpy as np
import pytest

from lexiflow.llm import reading as R

WORDS = [["dog", "sees", "red", "ball", "the"], ["kept", "house", "small", "garden", "the"], ["although", "editor", "reports", "summary", "the"], ["methodology", "which", "consolidates", "notwithstanding", "the"]]


def passage(grade, rng, n=90):
    """Words of the grades around, the nearer the more often."""
    weight = [np.exp(-1.2 * abs(g + 1 - grade)) for g in range(4)]
    words = [rng.choice(rng.choices(WORDS, weight)[0]) for _ in range(n)]
    step = 4 + 4 * grade
    return " ".join(w + "." if i % step == 0 else w for i, w in enumerate(words, 1))


@pytest.fixture(scope="module")
def levels(spark):
    rng = random.Random(6)
    graded = []
    for i in range(160):
        g = i % 4 + 1
        graded.append((passage(g, rng), min(4, max(1, g + (rng.random() < 0.1) - (rng.random() < 0.1)))))
    docs = [(i, passage(i % 4 + 1, rng), "en") for i in range(200)]
    docs += [(1000, None, "en"), (1001, "", "en"), (1002, " \n", None), (1003, "dog sees the red ball", None), (1004, "Das Haus steht am Fluss. Es ist alt.", "de"), (1005, passage(4, rng, 60_000), "en"), (1006, "12 34", "en"), (1007, "Das Haus", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "'x' AS level", "0 AS item", "1 AS n").repartition(4)
    passages = spark.createDataFrame(graded + [(None, 3), ("x y", None)], "text string, grade int")
    return {r["doc_id"]: r for r in R.reading_levels(df, "doc_id", "text", "lang", passages).collect()}


def test_held_out_accuracy(levels):
    error = np.array([levels[i]["level"] - (i % 4 + 1) for i in range(200)])
    assert np.abs(error).mean() < 0.5
    assert np.mean([(levels[i]["level"] >= 2.5) == (i % 4 >= 2) for i in range(200)]) > 0.95


def test_defined_results(levels):
    assert all(levels[i]["level"] is None and levels[i]["basis"] is None for i in (1000, 1001, 1002, 1006))
    assert levels[1003]["basis"] == "words" and levels[1003]["level"] < 2.5 and levels[1004]["basis"] == levels[1007]["basis"] == "shape" and levels[1004]["level"] is not None
    assert levels[1005]["level"] > 3 and levels[1005]["n_words"] == 60_000 and levels[1001]["n_words"] == 0


def test_levels_solve_their_equation():
    family = R.Family(5)
    family.b = np.array([-1.0, -0.5, 0.0, 0.5, 1.0])
    family._table()
    n, weighted = np.array([50.0, 50.0, 0.0]), np.array([30.0, -30.0, 0.0])
    t = family.levels(n, weighted)
    mean = np.interp(t, R.GRID, family.mean)
    assert np.abs(weighted - n * mean - R.PRIOR * t).max() < 0.05 and t[0] > 0 > t[1] and abs(t[2]) < 0.01


def test_empty_tables(spark):
    docs, passages = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "text string, grade int")
    assert R.reading_levels(docs, "doc_id", "text", "lang", passages).count() == 0
    some = spark.createDataFrame([(1, "a b c", "en")], "doc_id long, text string, lang string")
    assert [r["level"] for r in R.reading_levels(some, "doc_id", "text", "lang", passages).collect()] == [None]


def test_counts_are_sums():
    rows = [{0: 2, 2: 1}, {}, {2: 5}]
    dense = np.array([[2, 0, 1], [0, 0, 0], [0, 0, 5.0]])
    own, level, weight = R.Counts(rows, 3), np.array([1.0, 2.0, -1.0]), np.array([0.5, 1.0, 2.0])
    assert (own.by_item() == dense.sum(axis=0)).all() and (own.by_item(level) == level @ dense).all()
    assert (own.by_row() == dense.sum(axis=1)).all() and (own.by_row(weight) == dense @ weight).all()
