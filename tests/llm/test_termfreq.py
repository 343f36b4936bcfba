import random
from collections import Counter

import numpy as np

from lexiflow.llm import termfreq as T


def brute(rows):
    kept = {}
    for r, p, t in rows:
        if r is not None and p is not None:
            kept[r, p] = max((x for x in (kept.get((r, p)), t) if x is not None), default=None)
    n, docs = Counter(), {}
    for (r, _), t in kept.items():
        if t is not None:
            n[t] += 1
            docs.setdefault(t, set()).add(r)
    return {t: (n[t], len(docs[t])) for t in n}, len({r for r, _ in kept})


def test_like_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice([rng.randrange(50), rng.randrange(10**12), -5]), rng.randrange(40), rng.choice(["the", "a", "é", "", None, f"w{rng.randrange(300)}"])) for _ in range(6000)]
    rows += rows[:500] + [(None, 1, "x"), (1, None, "x"), (77, 100, None), (77, 100_000, "far"), (77, 100_000, "far"), (88, 0, "old"), (88, 0, "new"), (99, 3, "long" * 5000)]
    df = spark.createDataFrame(rows, "rec long, pos long, word string").selectExpr("*", "'x' AS term", "0 AS n", "1 AS record").repartition(6)
    got = {r["term"]: (r["occurrences"], r["records"]) for r in T.term_frequencies(df, "rec", "pos", "word").collect()}
    want, total = brute(rows)
    assert got.pop(None)[1] == total and got == want


def test_hot_term_has_bitsets(spark):
    df = spark.range(200_000).selectExpr("id AS rec", "0L AS pos", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('w', id % 1000) END AS word")
    got = {r["term"]: (r["occurrences"], r["records"]) for r in T.term_frequencies(df, "rec", "pos", "word").collect()}
    assert got["hot"] == (66_667, 66_667) and got[None][1] == 200_000 and sum(n for t, (n, _) in got.items() if t) == 200_000


def test_union_of_containers():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 16, n)) for n in (3, 5000, 40, 6000, 1)]
    places = [T.bitset(s) if len(s) >= T.DENSE else s.astype("<u2").tobytes() for s in sets]
    group = np.array([0, 0, 1, 1, 2])
    assert T.union_sizes(group, 3, places).tolist() == [len(np.union1d(sets[0], sets[1])), len(np.union1d(sets[2], sets[3])), 1]


def test_marks_and_empty(spark):
    rows = [(i, 0, "common") for i in range(40)] + [(1, i, "few_records") for i in range(1, 9)] + [(i, 1, "fair") for i in range(20, 23)] + [(i, 2, "fair") for i in range(20, 23)] + [(3, 50, "once")]
    frequencies = T.term_frequencies(spark.createDataFrame(rows, "r long, p long, t string"), "r", "p", "t")
    assert {r["term"]: r["mark"] for r in T.marked(frequencies).collect()} == {"common": "common", "few_records": "rare", "fair": None, "once": "rare"}
    assert T.marked(T.term_frequencies(spark.createDataFrame([], "r long, p long, t string"), "r", "p", "t")).count() == 0
