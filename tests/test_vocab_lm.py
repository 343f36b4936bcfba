import pytest
from pyspark.sql import functions as F

from lexiflow.operators import lexeme, lm, vocab
from lexiflow.operators.ordering import with_dense_number, with_running_sum
from lexiflow.operators.tokenize import tokenize
from lexiflow.plans.skew import lookup

TOKENS = [(1, 0, "b"), (1, 1, "a"), (1, 2, "b"), (2, 0, "c"), (2, 1, "a"), (3, 0, "b")]


def tokens(spark, rows=TOKENS):
    return spark.createDataFrame(rows, "doc_id long, position long, text string")


def ids(df):
    return {r["token"]: r["id"] for r in df.collect()}


def test_vocab_in_order_of_first_occurrence(spark):
    known = vocab.build_vocab(tokens(spark).repartition(7), ["doc_id", "position"])
    assert ids(known) == {"b": 0, "a": 1, "c": 2} and {r["token"]: r["n"] for r in known.collect()} == {"b": 3, "a": 2, "c": 1}
    more = tokens(spark, [(9, 0, "z"), (9, 1, "a"), (9, 2, "y"), (9, 3, None)])
    assert ids(vocab.extend_vocab(known, more, ["doc_id", "position"])) == {"b": 0, "a": 1, "c": 2, "z": 3, "y": 4}
    empty = spark.createDataFrame([], "token string, id long")
    assert ids(vocab.extend_vocab(empty, more, ["doc_id", "position"])) == {"z": 0, "a": 1, "y": 2}
    assert ids(vocab.extend_vocab(known, tokens(spark, []), ["doc_id", "position"])) == ids(known)


@pytest.mark.parametrize(("counts", "small"), [(True, 500), (True, 0), (False, 500), (False, 0)])
def test_encode_and_decode(spark, counts, small):
    known = vocab.build_vocab(tokens(spark), ["doc_id", "position"])
    known = known if counts else known.select("token", "id")
    rows = [*TOKENS, (4, 0, "unknown"), (4, 1, None)]
    src = tokens(spark, rows).withColumn("n", F.lit("clash")).withColumn("token_id", F.lit(7))
    got = {(r["doc_id"], r["position"]): r["token_id"] for r in vocab.encode(src, known, small=small).collect()}
    assert got == {(d, p): {"b": 0, "a": 1, "c": 2}.get(t) for d, p, t in rows}
    back = vocab.decode(vocab.encode(tokens(spark), known), known).collect()
    assert all(r["token"] == r["text"] for r in back)
    arrays = vocab.documents_of(vocab.encode(tokens(spark), known), "doc_id")
    assert {r[0]: r[1] for r in arrays.collect()} == {1: [0, 1, 0], 2: [2, 1], 3: [0]}


def test_hot_token_is_looked_up_without_a_shuffle_of_its_rows(spark):
    rows = [(i, 0, "the") for i in range(2000)] + [(i, 1, f"w{i}") for i in range(500)]
    known = vocab.build_vocab(tokens(spark, rows), ["doc_id", "position"])
    got = vocab.encode(tokens(spark, rows), known, small=0).groupBy("token_id").count().collect()
    assert sorted(r["count"] for r in got) == [1] * 500 + [2000] and all(r["token_id"] is not None for r in got)


def test_grown_vocabulary_keeps_counts(spark):
    known = vocab.build_vocab(tokens(spark), ["doc_id", "position"])
    grown = vocab.extend_vocab(known, tokens(spark, [(9, 0, "z"), (9, 1, "a"), (9, 2, "z")]), ["doc_id", "position"])
    assert {r["token"]: r["n"] for r in grown.collect()} == {"b": 3, "a": 3, "c": 1, "z": 2}
    again = vocab.extend_vocab(known.select("token", "id"), tokens(spark, [(9, 0, "a")]), ["doc_id", "position"])
    assert {r["token"]: r["n"] for r in again.collect()} == {"b": 0, "a": 1, "c": 0}


@pytest.mark.parametrize("small", [500, 0])
def test_arrays_are_encoded_like_rows(spark, small):
    docs = spark.createDataFrame([(3, ["b", "c", "b"]), (1, ["a", "b"]), (2, []), (4, None), (5, ["zz", None, "a"])], "doc_id long, tokens array<string>").repartition(3)
    known = vocab.build_vocab_of_arrays(docs.where("doc_id < 5"), "doc_id")
    assert {r["token"]: (r["id"], r["n"]) for r in known.collect()} == {"a": (0, 1), "b": (1, 3), "c": (2, 1)}
    got = {r["doc_id"]: r["ids"] for r in vocab.encode_arrays(docs, known, small=small).collect()}
    assert got[3] == [1, 2, 1] and got[1] == [0, 1] and got[2] == [] and not got[4] and got[5] == [None, None, 0]
    back = vocab.decode(spark.createDataFrame([(0,), (2,), (9,), (None,)], "token_id long"), known, small=small)
    assert {(r["token_id"], r["token"]) for r in back.collect()} == {(0, "a"), (2, "c"), (9, None), (None, None)}


def test_lookup_spreads_hot_keys(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"), "id")
    table = spark.createDataFrame([("hot", 1000, "x"), ("5", 1, "y"), ("no", 0, "z")], "k string, n long, v string")
    got = {r["id"]: r["v"] for r in lookup(rows, table, ["k"], "n", how="left").collect()}
    assert len(got) == 3000 and got[0] == "x" and got[5] == "y" and got[1] is None and got[8] is None
    assert lookup(rows, table, ["k"], "n").count() == 1001
    assert lookup(rows, table.limit(0), ["k"], "n").count() == 0


def test_encoder_grows(spark):
    encoder = vocab.SentenceEncoder(lambda df: tokenize(df, "doc_id"))
    docs = lambda *t: spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    assert not encoder.has_vocab
    first = encoder.encode(docs("a b", "b c"), "doc_id").orderBy("doc_id", "position").collect()
    second = encoder.encode(docs("c d a"), "doc_id").orderBy("position").collect()
    assert [r["token_id"] for r in first] == [0, 1, 1, 2] and [r["token_id"] for r in second] == [2, 3, 0]


def test_running_sums_over_partitions(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")).repartition(9)
    rows = with_running_sum(df, ["k"], "v", "s").orderBy("k").collect()
    total = 0
    for r in rows:
        assert r["s"] == total
        total += r["v"]
    assert [r["i"] for r in with_dense_number(df, ["k"], "i").orderBy("k").collect()] == list(range(1000))


def stream(spark, n):
    return spark.range(n).select(F.col("id").alias("pos"), F.col("id").alias("token_id")).repartition(5)


def test_batches_golden(spark):
    got = {r["batch_id"]: (r["input"], r["target"]) for r in lm.batch_matrices(lm.batches(stream(spark, 14), 3, 2)).collect()}
    assert got == {0: ([[0, 3], [1, 4], [2, 5]], [[1, 4], [2, 5], [3, 6]]), 1: ([[6, 9], [7, 10], [8, 11]], [[7, 10], [8, 11], [9, 12]])}
    assert tuple(lm.sizes(stream(spark, 14), 3, 2).first()) == (14, 4, 2)
    iterator = lm.BPTTIterator(2, 3).load(stream(spark, 14))
    assert len(iterator) == 2 and iterator.num_examples == 4 and [i for i, _ in iterator] == [got[0][0], got[1][0]] and len(list(iterator)) == 2
    with pytest.raises(NotImplementedError):
        lm.BPTTIterator(1, 1, shuffle=True)


@pytest.mark.parametrize("length", [1, 3, 7])
def test_pieces_give_the_examples_of_single_ids(spark, length):
    sizes, pos, pieces = [5, 1, 0, 9, 2, 2, 30, 1, 1, 1, 7], 0, []
    for n in sizes:
        pieces.append((pos, list(range(pos, pos + n))))
        pos += n
    docs = spark.createDataFrame([(k, ids) for k, (_, ids) in enumerate(pieces)], "doc_id long, ids array<long>").repartition(4)
    made = lm.stream_of_documents(docs, ["doc_id"])
    assert sorted((r["pos"], r["token_id"]) for r in lm.stream_rows(made).collect()) == [(i, i) for i in range(pos)]
    plain = {(r["example_id"], *r["input"], *r["target"]) for r in lm.examples(stream(spark, pos), length).collect()}
    got = [(r["example_id"], *r["input"], *r["target"]) for r in lm.examples(made, length).collect()]
    assert set(got) == plain and len(got) == len(plain) == (pos - 1) // length
    assert lm.matrices(made, length, 2).collect() == lm.batch_matrices(lm.batches(made, length, 2)).orderBy("batch_id").collect() or sorted(lm.matrices(made, length, 2).collect()) == sorted(lm.batch_matrices(lm.batches(made, length, 2)).collect())


@pytest.mark.parametrize(("n", "examples"), [(0, 0), (1, 0), (3, 0), (4, 1), (7, 2)])
def test_edge_sizes(spark, n, examples):
    assert lm.sizes(stream(spark, n), 3, 1).first()["num_examples"] == examples
    assert lm.examples(stream(spark, n), 3).count() == examples


def test_stream_has_all_documents_in_order(spark):
    known = vocab.build_vocab(tokens(spark), ["doc_id", "position"])
    rows = lm.token_stream(vocab.encode(tokens(spark), known).withColumn("offset", F.lit("x")), ["doc_id"]).orderBy("pos").collect()
    assert [tuple(r) for r in rows] == list(enumerate([0, 1, 0, 2, 1, 0]))


def test_lexemes(spark):
    saved = spark.createDataFrame([("Hello", 0), ("hello", 1), ("h", 2)], "token string, id long")
    rows = lexeme.lexemes(saved)
    store = lexeme.string_store(saved, rows)
    names = {r["id"]: r["token"] for r in store.collect()}
    assert len(names) == store.count() and names[0] == "Hello"
    by_id = {r["rank"]: r for r in lexeme.lexeme_ids(rows, store).collect()}
    plain = {r["id"]: r for r in rows.collect()}
    for i, r in by_id.items():
        assert all(names[r[c]] == plain[i][c] for c in ("lower", "shape", "prefix", "suffix", "lang"))
    vectors = spark.createDataFrame([(0, [3.0, 4.0])], "vec_id long, embedding array<float>")
    got = {r["id"]: (r["has_vector"], r["vector_norm"]) for r in lexeme.with_vectors(rows, vectors).collect()}
    assert got == {0: (True, 5.0), 1: (False, None), 2: (False, None)}


def test_stop_and_vocabulary_filters(spark):
    df, stops = tokens(spark, [(1, 0, "The"), (1, 1, "cat"), (1, 2, None)]), spark.createDataFrame([("the",), ("THE",)], "word string")
    assert {r["text"] for r in lexeme.without_stops(df, stops).collect()} == {"cat", None}
    assert lexeme.out_of_vocabulary(df.where("text is not null"), spark.createDataFrame([("cat", 0)], "token string, id long")).collect()[0]["text"] == "The"
