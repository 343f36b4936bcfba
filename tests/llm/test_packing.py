import itertools
import random
from collections import Counter

from lexiflow.llm import packing as P


def best_fill(counts, room):
    items = [x for x, n in counts.items() for _ in range(n)]
    return max((sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room), default=0)


def test_fill_is_the_closest_sum():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(rng.randint(1, 4))}
        room = rng.randint(1, 40)
        got = P.fill(counts, room)
        assert sum(x * n for x, n in got.items()) == best_fill(counts, room) and all(n <= counts[x] for x, n in got.items())


def first_fit(histogram, capacity):
    left = []
    for x in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        i = next((i for i, r in enumerate(left) if r >= x), None)
        if i is None:
            left.append(capacity - x)
        else:
            left[i] -= x
    return len(left)


def test_plan_uses_everything_once():
    rng = random.Random(2)
    histogram = {rng.randint(1, 64): rng.randint(1, 30) for _ in range(40)}
    patterns = P.plan(histogram, 64)
    used = Counter()
    for chosen, times in patterns:
        assert sum(x * n for x, n in chosen.items()) <= 64
        for x, n in chosen.items():
            used[x] += n * times
    assert used == histogram and len(patterns) < 200
    assert sum(t for _, t in patterns) <= first_fit(histogram, 64)


def test_steps_do_not_grow_with_the_items():
    assert len(P.plan({x: 10**9 + x for x in range(1, 128)}, 128)) < 600


def test_rows(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 5, 7, 7, 7, 9, 16, 17, 40])) for i in range(500)] + [(1000, None), (1001, 4)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").selectExpr("*", "'x' AS size", "0 AS rank", "1 AS container").repartition(5)
    got = P.pack(df, "doc_id", "tokens", {1: 16, 2: 100, 3: 0}).collect()
    for spec, capacity in ((1, 16), (2, 100)):
        mine = [r for r in got if r["spec_id"] == spec]
        sizes, per_doc = Counter(), Counter()
        for r in mine:
            sizes[r["container"]] += r["size"]
            per_doc[r["doc_id"]] += r["size"]
        assert max(sizes.values()) <= capacity and per_doc == Counter({k: n or 0 for k, n in rows}) and set(per_doc) == {k for k, _ in rows}
        pieces = Counter(r["doc_id"] for r in mine)
        assert all(pieces[k] == max(1, -(-(n or 0) // capacity)) for k, n in rows)
        total, used = sum(sizes.values()), len([c for c, n in sizes.items() if n])
        assert used <= -(-total // capacity) + 2 and set(sizes) == set(range(max(sizes) + 1))
    assert P.pack(df.limit(0), "doc_id", "tokens", {1: 16}).count() == 0 and P.pack(df, "doc_id", "tokens", {}).count() == 0
    again = {(r["spec_id"], r["doc_id"], r["piece"]): r["container"] for r in P.pack(df.repartition(2), "doc_id", "tokens", {1: 16, 2: 100}).collect()}
    assert again == {(r["spec_id"], r["doc_id"], r["piece"]): r["container"] for r in got}


def test_summary(spark):
    packed = spark.createDataFrame([(1, 1, 0, 10, 0), (1, 2, 0, 6, 0), (1, 3, 0, 8, 1)], "spec_id int, doc_id long, piece long, size long, container long")
    specs = spark.createDataFrame([(1, 16, "n"), (1, 16, "n")], "spec_id int, capacity long, note string")
    assert tuple(P.summary(packed, specs).first()) == (1, 16, 2, 24, 8)


def test_hot_lengths_and_wide_containers(spark, monkeypatch):
    monkeypatch.setattr(P, "RANKED", 10)
    rows = [(i, 5_000_000) for i in range(300)] + [(i, 5_000_000 + i) for i in range(300, 320)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").repartition(4)
    plans = {1: [({5_000_000: 2}, 150), *(({5_000_000 + i: 1}, 1) for i in range(300, 320))]}
    monkeypatch.setattr(P, "plan", lambda histogram, capacity: plans[1])
    got = P.pack(df, "doc_id", "tokens", {1: 11_000_000, 7: 11_000_000, 8: 11_000_000, 9: 11_000_000}).collect()
    for spec in (1, 7, 8, 9):
        used = Counter(r["container"] for r in got if r["spec_id"] == spec)
        assert set(used) == set(range(170)) and sum(used.values()) == 320 and sum(n == 2 for n in used.values()) == 150
