import re

import pytest

from lexiflow.operators.rules import DEFAULT, TokenizerRules, default_exceptions, infix_pattern, norm_of, prefix_pattern, suffix_pattern

CASES = {
    "lorem": "lorem", "Lorem,": "Lorem ,", "(ipsum).": "( ipsum ) .", "1984.": "1984 .", "NASDAQ:GOOG": "NASDAQ : GOOG", "love-apples": "love - apples",
    "google.com": "google.com", "python.org": "python.org", "http://www.google.com": "http://www.google.com", "hello123@example.com": "hello123@example.com", "hi+there@gmail.it": "hi+there@gmail.it",
    "don't": "do n't", "(don't)": "( do n't )", "well": "well", "Id": "I d", "Sun's": "Sun 's", "10am": "10 am", "5km": "5 km", "100$": "100 $", "$100": "$ 100", "99.86%": "99.86 %", "+4.83;": "+4.83 ;",
    "USA.": "USA .", "U.S.": "U.S.", "1,392,684": "1,392,684", "fields.[12][13]": "fields.[12][13 ]", "http://a.com/b": "http://a.com / b", "km/h": "km / h", "and/or": "and/or", ":)": ": )",
    "ab###": "ab # # #", "ab$$$": "ab$$$", "ab%%%": "ab%%%", "ab.***": "ab . * * *", "ab.$$$": "ab.$$$", "(9)": "( 9 )", "9-9": "9 - 9", "9.9.9.9": "9.9.9.9", "9.9.": "9.9 .",
    "a\U0001f600\U0001f600b": "a \U0001f600", "wait...\U0001f600go": "wait ...", "5тб": "5тб", "……": "… …", "x……": "x ……", "they'll've": "they 'll 've", "cannot": "can not", "Mr.": "Mr.",
}


@pytest.mark.parametrize("word", CASES)
def test_default_words(word):
    assert DEFAULT.split(word) == CASES[word].split(" ")


def test_keep_loses_nothing():
    keep = TokenizerRules(infix_gaps="keep")
    assert keep.split("a\U0001f600\U0001f600b") == ["a", "\U0001f600", "\U0001f600", "b"]
    assert "".join(keep.split("wait...\U0001f600go")) == "wait...\U0001f600go"


def test_custom_rules():
    rules = TokenizerRules(infixes=["~"], exceptions={"token": ["to", "ken"], "dict": [{"ORTH": "di"}, {"ORTH": "ct"}]})
    assert rules.split("token") == ["to", "ken"] and rules.split("dict") == ["di", "ct"]
    assert rules.split("token~ized") == ["token", "~", "ized"] and rules.split("~abc") == []
    assert TokenizerRules((), (), (), {}).split("(a,b).") == ["(a,b)."]
    assert TokenizerRules(infixes=["", " "], exceptions={}).split("abc") == ["abc"]


def test_patterns():
    assert prefix_pattern(["a", " ", "b"]) == "^a|^b" and suffix_pattern(["a", "b"]) == "a$|b$" and infix_pattern(["a", "", "b"]) == "a|b"
    assert prefix_pattern(["(", "."]) == r"^\(|^\."
    with pytest.raises(re.error):
        TokenizerRules(suffixes=["("])
    with pytest.raises(ValueError):
        TokenizerRules(infix_gaps="other")


def test_lengths_and_spans():
    assert DEFAULT.prefix_length("(a") == 1 and DEFAULT.prefix_length("a") == 0 and DEFAULT.prefix_length("..a") == 2
    assert DEFAULT.suffix_length("a...") == 3 and DEFAULT.suffix_length("5km/h") == 4 and DEFAULT.suffix_length("") == 0
    assert DEFAULT.infix_spans("a-b,c") == [(1, 2), (3, 4)] and TokenizerRules(infixes=()).infix_spans("a-b") == []


def test_exceptions():
    table = default_exceptions()
    assert len(table) == 752 and table["I'ma"] == ("I", "'m", "a") and table["Whereve"] == ("Where", "ve") and table["12p.m."] == ("12", "p.m.")
    assert not {"Ill", "its", "hell", "Shed", "were", "well", "Whore"} & {*table}
    assert all("".join(v) == k for k, v in table.items())
    assert norm_of("'ll") == "will" and norm_of("ve") == "have" and norm_of("Do") == "do"


def test_long_sign_runs_end():
    assert len(DEFAULT.split("#" * 20000)) == 20000
    assert DEFAULT.split("ab" + "." * 5000) == ["ab", "." * 5000]
    assert DEFAULT.split("7" * 50000) == ["7" * 50000]
