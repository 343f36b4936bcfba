import random

import numpy as np
import pytest

from lexiflow.llm import overlap as O


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j - 1] + (x != y), row[j] + 1, now[-1] + 1))
        row = now
    return row[-1]


def edited(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        i, kind = rng.randrange(len(words)), rng.choice("cad")
        if kind == "c":
            words[i] = rng.choice("pqrs")
        elif kind == "a":
            words.insert(i, rng.choice("pqrs"))
        elif len(words) > 1:
            del words[i]
    return words


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(400):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        for most in (0, 1, 3, 12):
            assert O.edit_distance(a, b, most) == min(plain_distance(a, b), most + 1)


def keys(words, probe):
    _, key, place = O.keys_of([words], probe, 8)
    return dict(zip(key.tolist(), place.tolist(), strict=True))


def fits(p, q):
    (a, b, n), (c, d, m) = (((x >> 42), x >> 21 & O.FAR, x & O.FAR) for x in (p, q))
    return (max(0, a - d, c - b) + max(0, n - b - m + c, m - d - n + a)) * 8 < max(n, m)


def test_partners():
    for n in range(1, 300):
        near = [m for m in range(1, 400) if abs(m - n) <= O.most_edits(max(m, n), 8)]
        assert (O.shortest_partner(n, 8), O.longest_partner(n, 8)) == (min(near), max(near))


def test_joined_words_are_no_edit():
    assert O.edit_distance("we can t go".split(), "we cant go".split(), 2) == 0
    assert O.edit_distance("we cant go at all".split(), "we can t go all".split(), 2) == 1
    assert O.joined("a b can t".split(), "a b cant".split()) and not O.joined("a b c".split(), "a b d".split())


def test_both_ways_to_the_distance():
    rng = random.Random(5)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randint(1, 30))]
        b = edited(a, rng.randint(0, 6), rng)
        for most in (1, 3, 30):
            want = min(plain_distance(a, b), most + 1)
            assert O._plain_distance(a, b, most) == O._joining_distance(a, b, most) == want
    long = [f"w{i % 5003}" for i in range(100_000)]
    assert O.edit_distance(long, [*long[:500], "x", *long[501:70_000], *long[70_003:]], 12_499) == 4


def test_a_text_of_many_words_takes_keys_in_proportion():
    words = [f"w{i % 5003}" for i in range(100_000)]
    assert len(O.keys_of([words], True, 8)[1]) <= 4 * len(words) and len(O.keys_of([words, ["a"] * 9], False, 8)[1]) <= len(words) / 5


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 16, 17, 24, 40, 63, 64, 65, 70, 130])
def test_no_near_pair_is_lost(n):
    """Whatever is edited, a key of the training side is among those of the evaluation side."""
    rng = random.Random(n)
    for _ in range(60):
        a = [rng.choice("abcdefgh") for _ in range(n)]
        b = edited(a, rng.randint(0, O.most_edits(n, 8) + 1), rng)
        if plain_distance(a, b) <= O.most_edits(max(len(a), len(b)), 8):
            for x, y in ((a, b), (b, a)):
                index, probe = keys(x, False), keys(y, True)
                assert set(index) & set(probe)
                hot = np.array(sorted(set(index) & set(probe)), dtype=np.int64)
                for some in (hot, hot[:1], np.array(sorted(index), dtype=np.int64)):  # a pair without a cold segment in common has a refined key
                    cold = {k for k in index if k not in some.tolist()} & set(probe)
                    made, needed = O.refined_keys(x, some, False, 8)
                    other = set(O.refined_keys(y, np.intersect1d(some, list(probe)), True, 8)[0].ravel().tolist())
                    assert cold or any(len(other & set(row)) > len(row) - needed for row in made.tolist())
                assert any(fits(index[k], probe[k]) for k in set(index) & set(probe))


def test_like_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([8, 12, 20, 33, 70]))] for _ in range(25)]
    rows = []
    for k in range(220):
        words = edited(rng.choice(base), rng.choice([0, 0, 1, 2, 4, 9]), rng)
        text = rng.choice([" ", ", "]).join(words)
        rows.append((k, text.upper() if rng.random() < 0.5 else text, rng.choice(["train", "train", "valid", "test"])))
    rows += [(500, None, "train"), (501, "", "test"), (None, rows[0][1], "train"), (502, "a b", "test"), (503, "a b", "train"), (504, rows[0][1], None), (505, "zz " * 5000, "train"), (506, "zz " * 4990 + "y", "test"), rows[1]]
    df = spark.createDataFrame(rows, "id long, text string, split string").selectExpr("*", "'x' AS h", "0 AS words", "1 AS key").repartition(4)
    members, links = O.overlaps(df, "id", "text", "split")
    clean = {(k, s, tuple(t.lower().replace(",", "").split())) for k, t, s in rows if k is not None and t and s}
    want = set()
    for ka, sa, a in clean:
        for kb, sb, b in clean:
            if sa == "train" and sb != "train" and min(len(a), len(b)) >= 8 and abs(len(a) - len(b)) * 8 < max(len(a), len(b)) and O.edit_distance(list(a), list(b), 700) * 8 < max(len(a), len(b)):
                want.add((min(ka, kb), max(ka, kb)))
    got = [tuple(r) for r in O.overlap_pairs(members, links).collect()]
    assert set(got) == want and len(got) == len(want) and (505, 506) in want
    per = {r["k"]: r["links"] for r in O.overlap_records(members, links).collect()}
    train = {k for k, s, _ in clean if s == "train"}
    for k, n in per.items():
        assert n == sum(1 for p in want if k in p and ({*p} - {k}) & train)
    classes = df.where("split is not null and id is not null")
    classes = O.canonical(classes, "id", "text", "split").selectExpr("if(side = 'train', 'train', 'eval') AS side", "h", "words").distinct()
    classes = O.cut_table(classes.selectExpr("*", "monotonically_increasing_id() AS c"))
    near = {tuple(r) for r in O.near_classes(classes).collect()}
    assert near == {tuple(r) for r in O.near_classes(classes, most=1).collect()} and len(near) > 20
    empty = O.overlaps(df.limit(0), "id", "text", "split")
    assert O.overlap_pairs(*empty).count() == 0


def test_split_paths(spark):
    metas = spark.createDataFrame([("t1", "a", "b", None, "x"), ("t1", "a", "b", None, "y"), ("t2", "b", None, "c", "x")], "tag string, train_path string, valid_path string, test_path string, owner string")
    assert {tuple(r) for r in O.split_paths(metas).collect()} == {("a", "train", "t1"), ("b", "valid", "t1"), ("b", "train", "t2"), ("c", "test", "t2")}
