import itertools

from pyspark.sql import functions as F

from lexiflow.operators import docs as D


def doc(spark, words):
    return spark.createDataFrame([([(w, True) for w in words],)], "tokens array<struct<text:string,space_after:boolean>>")


def test_index_and_slice_like_python(spark):
    words, t = list("abcdef"), F.col("tokens")
    df = doc(spark, words)
    got = df.select(*(D.token_at(t, i).getField("text").alias(str(i)) for i in range(-8, 8))).first()
    for i in range(-8, 8):
        assert got[str(i)] == (words[i] if -6 <= i < 6 else None)
    bounds = list(itertools.product([None, -9, -2, 0, 3, 6, 9], repeat=2))
    got = df.select(*(F.transform(D.span(t, a, b), lambda x: x["text"]).alias(f"c{i}") for i, (a, b) in enumerate(bounds))).first()
    for i, (a, b) in enumerate(bounds):
        assert got[i] == words[a:b], (a, b)


def test_spans(spark):
    df, t = doc(spark, list("abcdef")), F.col("tokens")
    row = df.select(D.doc_text(D.span_of_span(t, (1, 5), (1, -1))).alias("inner"), D.span_token(t, 2, 4, 0)["text"].alias("first"), D.span_token(t, 2, 4, -1)["text"].alias("last"), D.span_token(t, 2, 4, 3)["text"].alias("beyond"), D.span_token(t, 2, 4, 9)["text"].alias("none")).first()
    assert tuple(row) == ("c d ", "c", "d", "f", None)


def test_text_forms_and_null(spark):
    df, t = doc(spark, ["ab", "c"]), F.col("tokens")
    assert tuple(df.select(D.doc_text(t), D.doc_length(t), D.token_repr(t[0]), D.token_length(t[0])).first()) == ("ab c ", 2, "Token[ab]", 3)
    null = spark.createDataFrame([(None,)], "tokens array<struct<text:string,space_after:boolean>>")
    assert null.select(D.span(t, 0, 1)).first()[0] is None


def test_attributes(spark):
    df = spark.createDataFrame([({"a": ["1"]},), (None,)], "m map<string,array<string>>")
    rows = df.select(D.set_attribute(F.col("m"), "a", ["2", "3"]).alias("m"), D.attribute(F.col("m"), "zz").alias("z")).collect()
    assert [r["m"] for r in rows] == [{"a": ["2", "3"]}] * 2 and rows[0]["z"] is None


def test_bad_step():
    import pytest

    with pytest.raises(ValueError):
        D.normalize_slice(F.lit(3), 0, 1, 2)
