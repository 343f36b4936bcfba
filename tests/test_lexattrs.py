import random
import unicodedata

from pyspark.sql import functions as F

from lexiflow.functions import lexattrs as L
from lexiflow.functions.sql import register

WORDS = [
    "", "10", "10.9", "1,000", "+5", "1/2", "1.2.3", "²", "½", "1/2/3", "ten", "+", "a@b.co", "a@b.co trailing", "a@b", "@b.co", "http://x", "www.a", "a.com", "a.com:80", "3.5/", "a.COM", "a.com/path", ".com", "a.", "a@b.com", "abc",
    "Ab", "A-B", "A1B", "3D", "It'S a", "aB", "3d", "AB", "a1", "A1", "1", "Hello2020", "abcdefgh", "U.S.", "x" * 100, "!!!!!!a", "(", "''", "``", "$", "€€", " \n", "ǅ", "ǅa", "Σας", "İ", "naïve", "1٣", "...", "аб", "ÀÉ",
]


def shape(w):
    if len(w) >= 100:
        return "LONG"
    out = []
    for c in w:
        c = ("X" if c.isupper() else "x") if c.isalpha() else "d" if c.isdigit() else c
        if out[-4:] != [c] * 4:
            out.append(c)
    return "".join(out)


def num(w):
    w = w[1:] if w[:1] in ("+", "-", "±", "~") and w else w
    w = w.replace(",", "").replace(".", "")
    return w.isdigit() or (w.count("/") == 1 and all(x.isdigit() for x in w.split("/")))


PLAIN = {
    "is_punct": lambda w: all(unicodedata.category(c)[0] == "P" for c in w), "is_ascii": str.isascii, "is_currency": lambda w: all(unicodedata.category(c) == "Sc" for c in w), "is_alpha": str.isalpha,
    "is_digit": str.isdigit, "is_space": str.isspace, "is_lower": str.islower, "is_upper": str.isupper, "is_title": str.istitle, "word_shape": shape, "lower": str.lower, "prefix": lambda w: w[:1], "suffix": lambda w: w[-3:],
    "length": len, "like_num": num,
}


def test_like_plain_python(spark):
    rng = random.Random(1)
    words = WORDS + ["".join(rng.choice("aAzZ19.,'éÉßАя(½ -") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for row in df.select("w", *(getattr(L, n)(F.col("w")).alias(n) for n in PLAIN)).collect():
        for n, f in PLAIN.items():
            assert row[n] == f(row["w"]), (n, row["w"])


def test_golden(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string")
    w = F.col("w")
    rows = {r["w"]: r for r in df.select("w", L.like_email(w).alias("email"), L.like_url(w).alias("url"), L.is_bracket(w).alias("b"), L.is_quote(w).alias("q"), L.is_left_punct(w).alias("l"), L.is_right_punct(w).alias("r")).collect()}
    assert {k for k, r in rows.items() if r["email"]} == {"a@b.co", "a@b.co trailing", "a@b.com"}
    assert {k for k, r in rows.items() if r["url"]} == {"http://x", "www.a", "a.com", "a.com:80", "3.5/"}
    assert rows["("]["b"] and rows["("]["l"] and not rows["("]["r"] and rows["''"]["q"] and rows["''"]["r"] and rows["``"]["l"] and rows["``"]["q"]


def test_flags(spark):
    df = spark.createDataFrame([("Hello",), ("42",), (None,), ("the",)], "w string").select("w", L.flag_word(F.col("w"), ["the"]).alias("flags"))
    rows = {r["w"]: r.asDict() for r in df.select("w", "flags", *(c.alias(n) for n, c in L.flag_accessors(F.col("flags")).items())).collect()}
    assert rows["Hello"]["is_title"] and rows["Hello"]["is_alpha"] and rows["Hello"]["is_oov"] and not rows["Hello"]["is_stop"]
    assert rows["42"]["like_num"] and rows["42"]["is_digit"] and rows["the"]["is_stop"] and rows[None]["flags"] is None
    assert len(L.flag_accessors(F.lit(0))) == 18 and [int(L.Attribute.IS_ALPHA), int(L.Attribute.IS_CURRENCY), len(L.Attribute), len(L.REGISTRY)] == [10, 27, 28, 23]
    f = spark.range(1).select(L.set_flag(F.lit(0).cast("long"), 12, True).alias("a"), L.set_flag(F.lit(4096 + 1024).cast("long"), 12, False).alias("b")).first()
    assert (f["a"], f["b"]) == (4096, 1024)


def test_stop_default_is_false(spark):
    assert spark.createDataFrame([("the",)], "w string").select(L.is_stop(F.col("w"))).first()[0] is False


def test_sql_functions_say_what_columns_do(spark):
    names = L.register_sql(spark, ["the"])
    df = spark.createDataFrame([(w,) for w in [*WORDS, "the", None]], "w string")
    w = F.col("w")
    columns = {a.name.lower(): L.is_stop(w, ["the"]) if a == L.Attribute.IS_STOP else f(w) for a, f in L.REGISTRY.items()}
    columns = {n if n.startswith(("is_", "like_")) else f"word_{n}": c for n, c in columns.items()} | {"flag_word": L.flag_word(w, ["the"])}
    assert set(names) == set(columns)
    for n, c in columns.items():
        assert df.select(c.alias("a"), F.expr(f"{n}(w)").alias("b")).where("NOT a <=> b").count() == 0, n


def test_sql_functions(spark):
    names = register(spark)
    assert "like_num" in names
    assert tuple(spark.sql("SELECT like_num('1,000'), is_alpha('ab'), is_upper('aB'), word_suffix('abcd')").first()) == (True, True, False, "bcd")
    rows = spark.sql("SELECT t.* FROM (SELECT 'I love-apples' AS text) d, LATERAL tokenize(d.text) t ORDER BY position").collect()
    assert [r["text"] for r in rows] == ["I", "love", "-", "apples"]
