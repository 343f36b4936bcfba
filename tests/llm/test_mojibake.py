import random

import pytest
from pyspark.sql import functions as F

from lexiflow.llm import mojibake as M

DE = "die größe der straße über dem tal für bücher wählte öffnete während prüfung mädchen gebühr schön"
FR = "le résumé a été préparé où la forêt célébré dès leçon l'élève théâtre répété près château modèle"
PT = "a informação não viu o coração da canção em são joão e a lição manhã avô até é você"
RU = "старый дом нашёл новая книга без ошибки каменный мост увидел большой архив хотя каждый читатель"


def clean(n, rng):
    out = []
    for i in range(n):
        words = (DE, FR, PT, RU)[i % 4].split()
        text = " ".join(rng.choice(words) for _ in range(14))
        text = text.upper() if i % 11 == 0 else text.capitalize()
        out.append(text + rng.choice([".", " … “x” — 5 €.", " (£50) 40 °C ± 2", " “MANHÃ”", " \U0001f680"]))
    return out


@pytest.fixture(scope="module")
def corpus():
    return clean(2000, random.Random(4))


@pytest.fixture(scope="module")
def scores(spark, corpus):
    return M.train(spark.createDataFrame([(t,) for t in corpus] + [(None,), ("",)], "text string"))


def garble(text, wrong, true="utf-8"):
    return "".join(M.forward(wrong)[b - 0x80] if b >= 0x80 else chr(b) for b in text.encode(true))


def test_clean_text_is_left_alone(corpus, scores):
    assert [t for t in corpus if M.repair(t, scores)[0]] == []


@pytest.mark.parametrize("wrong", ["cp1252", "mac_roman", "cp437", "cp850", "cp1251"])
def test_utf8_read_wrongly_comes_back(corpus, scores, wrong):
    texts = [t for t in corpus[:200] if "\U0001f680" not in t and "MANH" not in t]
    found = [M.repair(garble(t, wrong), scores) for t in texts if not t.isascii()]
    assert sum(d for d, _, _ in found) >= 0.98 * len(found)
    assert sum(t == o for (_, _, o), t in zip(found, [t for t in texts if not t.isascii()], strict=True)) >= 0.9 * len(found)


def test_twice_damaged(scores):
    text = "Le résumé a été préparé près du château"
    assert M.repair(garble(garble(text, "cp1252"), "cp1252"), scores) == (True, True, text)


@pytest.mark.parametrize(("wrong", "true", "text"), [("cp1252", "cp1251", "Старый дом нашёл новая книга"), ("cp437", "cp1252", "Le résumé a été préparé où la forêt"), ("mac_roman", "cp1252", "die größe der straße über dem tal")])
def test_one_byte_encodings(scores, wrong, true, text):
    assert M.repair(garble(text, wrong, true), scores) == (True, True, text)


def test_part_of_a_text_and_what_is_lost(scores):
    damaged, restored, text = M.repair("Le résumé a été préparé. " + garble("Le modèle a été répété", "cp1252"), scores)
    assert damaged and restored and text == "Le résumé a été préparé. Le modèle a été répété"
    assert M.repair("Le r�sum�", scores)[:2] == (True, False) and M.repair("an \u009c sign", scores)[:2] == (True, False)


def test_segments():
    import numpy as np

    assert M.segments(np.array([0, 0, -4, -4, 0, -4, 0, 0, 0, 0, 0, -4.0])) == [(2, 6), (11, 12)]
    assert M.segments(np.zeros(5)) == [] and M.segments(np.zeros(0)) == []


def test_rows(spark, scores):
    bad = garble("Le résumé a été préparé", "cp1252")
    rows = [(1, bad), (2, "plain"), (3, None), (4, ""), (5, "Le résumé a été préparé"), (6, bad), (7, "é" + " mot été" * 20_000 + bad)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("restored", F.lit("clash"))
    got = {r["id"]: (r["restored"], r["text"]) for r in M.restore(df, "id", "text", scores).collect()}
    assert set(got) == {1, 6, 7} and got[1] == (True, "Le résumé a été préparé") and got[7][0]
    empty = spark.createDataFrame([], "id long, text string")
    assert M.restore(empty, "id", "text", M.train(empty)).count() == 0


@pytest.mark.parametrize(("wrong", "true"), [("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1251", "koi8_r")])
def test_frequent_one_byte_damage_does_not_vouch_for_itself(spark, wrong, true):
    rng = random.Random(9)
    words = RU.split() if true == "koi8_r" else f"{DE} {FR} {PT}".split()
    texts = [" ".join(rng.choice(words) for _ in range(14)) for _ in range(1500)]
    texts = [t.upper() if i % 11 == 0 and true == "koi8_r" else t for i, t in enumerate(texts)]
    rows = [garble(t, wrong, true) if i % 3 == 0 else t for i, t in enumerate(texts)]
    scores = M.train(spark.createDataFrame([(t,) for t in rows], "text string"))
    found = [M.repair(t, scores)[0] for t in rows]
    assert sum(found[::3]) >= 0.9 * len(found[::3])
    assert sum(found) - sum(found[::3]) == 0


@pytest.mark.parametrize(("wrong", "text"), [("mac_roman", "Das frühstück"), ("mac_roman", "un rép"), ("cp437", "der straße"), ("mac_roman", "Le résumé")])
def test_few_characters_of_one_byte_damage(spark, corpus, wrong, text):
    scores = M.train(spark.createDataFrame([(t,) for t in [*corpus, *["das frühstück war gut"] * 40]], "text string"))
    assert M.repair(garble(text, wrong, "cp1252"), scores) == (True, True, text)
    assert not M.repair(text, scores)[0]


def test_one_byte_damage_of_some_runs(scores):
    french, german = garble("Le résumé a été préparé", "mac_roman", "cp1252"), garble("die größe der straße", "cp437", "cp1252")
    assert M.repair(f"{french} 漢 \U0001f9ff x​y", scores)[::2] == (True, "Le résumé a été préparé 漢 \U0001f9ff x​y")
    assert M.repair(f"{french} {german}", scores)[::2] == (True, "Le résumé a été préparé die größe der straße")
    assert M.repair(f"Le modèle {french}\U0001f9ff", scores)[::2] == (True, "Le modèle Le résumé a été préparé\U0001f9ff")


def test_pieces_of_utf8(spark, corpus):
    more = ["il est là où le résumé est", "« été » et «élan» et «é»", "où là"] * 40
    scores = M.train(spark.createDataFrame([(t,) for t in [*corpus, *more]], "text string"))
    assert M.repair("il est lÃ  où le modèle", scores) == (True, True, "il est là où le modèle")
    assert M.repair("le modèle a rÃpété", scores)[:2] == (True, False)
    assert M.repair("un «Ã©lan» modèle", scores) == (True, True, "un «élan» modèle")
    assert M.repair(garble("le résumé", "cp1250"), scores) == (True, True, "le résumé")
    assert M.repair("le résumé a été".encode().decode("gbk"), scores) == (True, True, "le résumé a été")
    assert [t for t in [*corpus, *more] if M.repair(t, scores)[0]] == []


OTHERS = {
    "pl": "żółta łódka płynęła przez święta rzekę gdzie źródło śpiewało wśród ćmy mąż książkę", "el": "το παλιό βιβλίο είναι στο σπίτι και η νέα ιστορία δεν έχει λάθος κάθε αναγνώστης",
    "ja": "古い本は家にある新しい物語には間違いがない読者は毎日図書館で長い文章を読む", "tr": "eski kitap şimdi çok güzel bir öğretmen için yazılmış ağaç ışık dağ",
}


@pytest.mark.parametrize(("lang", "wrong", "true"), [
    ("pl", "cp1252", "utf-8"), ("pl", "cp1250", "utf-8"), ("pl", "iso8859_2", "utf-8"), ("el", "cp1252", "utf-8"), ("el", "cp1253", "utf-8"), ("el", "iso8859_7", "utf-8"), ("ja", "cp1252", "utf-8"), ("ja", "mac_roman", "utf-8"),
    ("tr", "cp1254", "utf-8"), ("tr", "cp1252", "utf-8"), ("el", "cp1252", "cp1253"), ("ja", "cp1252", "euc_jp"),
])
def test_damage_of_other_languages(spark, corpus, lang, wrong, true):
    rng = random.Random(11)
    words = OTHERS[lang].split() if lang != "ja" else [OTHERS[lang][i : i + 6] for i in range(0, 36, 6)]
    rows = [" ".join(rng.choice(words) for _ in range(10)) for _ in range(600)]
    scores = M.train(spark.createDataFrame([(t,) for t in [*corpus, *rows]], "text string"))
    bad = [garble(t, wrong, true) for t in rows[:60]]
    found = [M.repair(t, scores) for t in bad]
    assert sum(d for d, _, _ in found) >= 59 and sum(o == t for (_, _, o), t in zip(found, rows, strict=False)) >= 50
    assert not any(M.repair(t, scores)[0] for t in rows)


def test_every_damage_stands_in_a_segment(scores):
    for text in ("�", "a �", "un mot\u0081", "Le r�sum� est l�", garble("Le résumé a été préparé", "cp1252")):
        assert M._suspects(text, scores) and M.repair(text, scores)[0]
    assert M.shrunk(3.0, 0, 10) == M.LOWEST and M.shrunk(3.0, 10, 10) == 3.0 and M.LOWEST < M.shrunk(3.0, 5, 10) < 3.0


def test_look_alike_letters_are_no_damage(scores):
    assert not M.repair("THЕЅE books are old", scores)[0] and M.repair("The cup (ВЈ1284) is old", scores)[2] == "The cup (£1284) is old"


@pytest.mark.parametrize(("text", "want"), [("the word PuÍvon is old", "the word Puêvon is old"), ("the word LewÄavo is old", "the word Lewéavo is old"), ("the word Kixbregrτu is old", "the word Kixbregrçu is old")])
def test_a_letter_that_no_word_has_at_its_place(spark, corpus, text, want):
    more = ["plusieurs êtres étranges", "le garçon reçu ici", "même la tête en rêve"] * 40
    scores = M.train(spark.createDataFrame([(t,) for t in [*corpus, *more]], "text string"))
    assert M.repair(text, scores) == (True, True, want) and not M.repair(want, scores)[0]
