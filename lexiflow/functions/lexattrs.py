"""Lexical attributes of a string as native expressions, and the flag word that holds the true-or-false ones.

All take and give columns and stay in generated code. Null gives null. Where nothing else is said, an attribute that asks
something of every character is true for the empty string.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from enum import IntEnum
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions.chars import ODD_DIGITS, SPACE

# The attributes in the order of their ids; those from 10 on are bits of the flag word.
Attribute = IntEnum(
    "Attribute",
    "NULL_ATTR ID ORTH LOWER NORM SHAPE PREFIX SUFFIX LENGTH LANG IS_ALPHA IS_ASCII IS_DIGIT IS_LOWER IS_PUNCT IS_SPACE IS_TITLE IS_UPPER "
    "LIKE_URL LIKE_NUM LIKE_EMAIL IS_STOP IS_OOV IS_BRACKET IS_QUOTE IS_LEFT_PUNCT IS_RIGHT_PUNCT IS_CURRENCY",
    start=0,
)

# Members of the sign classes.
BRACKETS = "( ) [ ] { } < >".split()
QUOTES = "\" ' ` « » ‘ ’ ‚ ‛ “ ” „ ‟ ‹ › ❮ ❯ '' ``".split()
LEFT_PUNCT = "( [ { < \" ' « ‘ ‚ ‛ “ „ ‟ ‹ ❮ ``".split()
RIGHT_PUNCT = ") ] } > \" ' » ’ ” › ❯ ''".split()
# The top-level domains that end a web address.
TOP_LEVEL_DOMAINS = (
    "com org edu gov net mil aero asia biz cat coop info int jobs mobi museum name pro tel travel xxx ac ad ae af ag ai al am an ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj "
    "bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cs cu cv cx cy cz dd de dj dk dm do dz ec ee eg eh er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm "
    "gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm "
    "mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so "
    "sr ss st su sv sy sz tc td tf tg th tj tk tl tm tn to tp tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw"
).split(" ")

DIGIT = rf"[\p{{Nd}}{ODD_DIGITS}]"
UPPER, LOWER, TITLE = r"\p{IsUppercase}", r"\p{IsLowercase}", r"\p{Lt}"
PATTERNS = {
    "is_punct": r"\A\p{P}*\z",
    "is_ascii": r"\A[\x00-\x7F]*\z",
    "is_currency": r"\A\p{Sc}*\z",
    "like_email": r"\A[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+",
    "is_alpha": r"\A\p{L}+\z",
    "is_digit": rf"\A{DIGIT}+\z",
    "is_space": rf"\A[{SPACE}]+\z",
}
MEMBERS = {"is_bracket": BRACKETS, "is_quote": QUOTES, "is_left_punct": LEFT_PUNCT, "is_right_punct": RIGHT_PUNCT}


def _matches(name: str) -> Callable[[Column], Column]:
    def attribute(s: Column) -> Column:
        return s.rlike(PATTERNS[name])

    attribute.__name__ = name
    return attribute


def _member(name: str) -> Callable[[Column], Column]:
    def attribute(s: Column) -> Column:
        return s.isin(MEMBERS[name])

    attribute.__name__ = name
    return attribute


is_punct, is_ascii, is_currency, like_email, is_alpha, is_digit, is_space = map(_matches, PATTERNS)
is_bracket, is_quote, is_left_punct, is_right_punct = map(_member, MEMBERS)


def like_num(s: Column) -> Column:
    """Digits, or digits over digits, after one leading sign and all commas and points are taken off."""
    bare = F.regexp_replace(F.regexp_replace(s, r"\A[+\-±~]", ""), "[,.]", "")
    return bare.rlike(rf"\A(?:{DIGIT}+|{DIGIT}+/{DIGIT}+)\z")


def like_url(s: Column, domains: Iterable[str] | None = None) -> Column:
    """A scheme or ``www.`` in front, or a known top-level domain (or a slash) at the end. False for the empty string."""
    end = F.substring_index(F.substring_index(s, ".", -1), ":", 1)
    known = end.isin(list(TOP_LEVEL_DOMAINS if domains is None else domains))
    return (
        F.when(s.startswith("http://") | s.startswith("https://") | (s.startswith("www.") & (F.length(s) >= 5)), True)
        .when(s.startswith(".") | s.endswith(".") | s.contains("@") | ~s.contains("."), False)
        .when(s.isNotNull(), end.endswith("/") | known)
    )


def word_shape(s: Column) -> Column:
    """Capital letters as X, other letters as x, digits as d, runs cut after four; LONG from 100 characters on."""
    shape = F.regexp_replace(s, r"[\p{L}&&\p{IsUppercase}]", "X")
    shape = F.regexp_replace(shape, r"[\p{L}&&[^X]]", "x")
    shape = F.regexp_replace(shape, DIGIT, "d")
    return F.when(F.length(s) >= 100, "LONG").otherwise(F.regexp_replace(shape, r"(?s)((.)\2{3})\2+", "$1"))


def lower(s: Column) -> Column:
    return F.lower(s)


norm = lower


def prefix(s: Column) -> Column:
    """The first character."""
    return F.substring(s, 1, 1)


def suffix(s: Column) -> Column:
    """The last three characters, or as many as there are."""
    return F.right(s, F.lit(3))


def length(s: Column) -> Column:
    return F.length(s)


def is_lower(s: Column) -> Column:
    """A cased letter, and no capital or title-case one."""
    return s.rlike(LOWER) & ~s.rlike(f"[{UPPER}{TITLE}]")


def is_upper(s: Column) -> Column:
    return s.rlike(UPPER) & ~s.rlike(f"[{LOWER}{TITLE}]")


def is_title(s: Column) -> Column:
    """Capitals only where no cased letter is before them, small letters only where one is."""
    cased = f"{UPPER}{LOWER}{TITLE}"
    return s.rlike(f"[{UPPER}{TITLE}]") & ~s.rlike(f"[{cased}][{UPPER}{TITLE}]") & ~s.rlike(f"(?<![{cased}]){LOWER}")


def is_stop(s: Column, stops: Iterable[str] = ()) -> Column:
    """Whether the string is one of ``stops`` in lower case. There is no list by default; use a semi join for a table."""
    return F.lower(s).isin(list(stops)) if (stops := list(stops)) else F.when(s.isNotNull(), F.lit(False))


def is_oov(s: Column) -> Column:
    """True for any string; see ``lexeme.out_of_vocabulary`` for what a vocabulary lacks."""
    return F.when(s.isNotNull(), F.lit(True))


#: Attribute to function, for every attribute that is computed from the string alone.
REGISTRY: dict[Attribute, Callable[[Column], Column]] = {
    Attribute.LOWER: lower, Attribute.NORM: norm, Attribute.SHAPE: word_shape, Attribute.PREFIX: prefix, Attribute.SUFFIX: suffix,
    Attribute.IS_ALPHA: is_alpha, Attribute.IS_ASCII: is_ascii, Attribute.IS_DIGIT: is_digit, Attribute.IS_LOWER: is_lower, Attribute.IS_PUNCT: is_punct,
    Attribute.IS_SPACE: is_space, Attribute.IS_TITLE: is_title, Attribute.IS_UPPER: is_upper, Attribute.LIKE_URL: like_url, Attribute.LIKE_NUM: like_num,
    Attribute.LIKE_EMAIL: like_email, Attribute.IS_STOP: is_stop, Attribute.IS_OOV: is_oov, Attribute.IS_BRACKET: is_bracket, Attribute.IS_QUOTE: is_quote,
    Attribute.IS_LEFT_PUNCT: is_left_punct, Attribute.IS_RIGHT_PUNCT: is_right_punct, Attribute.IS_CURRENCY: is_currency,
}
FLAGS = [a for a in REGISTRY if a >= Attribute.IS_ALPHA]


def flag_word(s: Column, stops: Iterable[str] = ()) -> Column:
    """All flags of a string in one number; bit i is the attribute with id i. Null for null."""
    stops = list(stops)
    bits = [F.when(is_stop(s, stops) if a == Attribute.IS_STOP else REGISTRY[a](s), F.lit(1 << int(a)).cast("long")).otherwise(F.lit(0).cast("long")) for a in FLAGS]
    return F.when(s.isNotNull(), reduce(lambda x, y: x.bitwiseOR(y), bits))


def check_flag(flags: Column, attribute: int) -> Column:
    return flags.bitwiseAND(F.lit(1 << int(attribute)).cast("long")) != 0


def set_flag(flags: Column, attribute: int, value: bool) -> Column:
    bit = F.lit(1 << int(attribute)).cast("long")
    return flags.bitwiseOR(bit) if value else flags.bitwiseAND(F.bitwise_not(bit))


def flag_accessors(flags: Column) -> dict[str, Column]:
    """A column for each flag, by its name."""
    return {a.name.lower(): check_flag(flags, a) for a in FLAGS}


def _in(words: Iterable[str]) -> str:
    return "s IN (" + ", ".join("r'" + w + "'" if "'" not in w else '"' + w.replace('"', '\\"') + '"' for w in words) + ")"


_CASED, _END = f"{UPPER}{LOWER}{TITLE}", "substring_index(substring_index(s, '.', -1), ':', 1)"
_SHAPED = rf"regexp_replace(regexp_replace(regexp_replace(s, r'[\p{{L}}&&\p{{IsUppercase}}]', 'X'), r'[\p{{L}}&&[^X]]', 'x'), r'{DIGIT}', 'd')"
#: What ``register_sql`` makes: names, result types, and SQL over the argument ``s``.
SQL_BODIES = {name: ("BOOLEAN", f"s RLIKE r'{p}'") for name, p in PATTERNS.items()} | {name: ("BOOLEAN", _in(words)) for name, words in MEMBERS.items()} | {
    "word_lower": ("STRING", "lower(s)"),
    "word_norm": ("STRING", "lower(s)"),
    "word_prefix": ("STRING", "substring(s, 1, 1)"),
    "word_suffix": ("STRING", "right(s, 3)"),
    "word_shape": ("STRING", rf"CASE WHEN length(s) >= 100 THEN 'LONG' ELSE regexp_replace({_SHAPED}, r'(?s)((.)\2{{3}})\2+', '$1') END"),
    "like_num": ("BOOLEAN", rf"regexp_replace(regexp_replace(s, r'\A[+\-±~]', ''), '[,.]', '') RLIKE r'\A(?:{DIGIT}+|{DIGIT}+/{DIGIT}+)\z'"),
    "like_url": ("BOOLEAN", f"""CASE WHEN startswith(s, 'http://') OR startswith(s, 'https://') OR (startswith(s, 'www.') AND length(s) >= 5) THEN true
        WHEN startswith(s, '.') OR endswith(s, '.') OR contains(s, '@') OR NOT contains(s, '.') THEN false
        WHEN s IS NOT NULL THEN endswith({_END}, '/') OR {_in(TOP_LEVEL_DOMAINS).replace('s IN', f'{_END} IN', 1)} END"""),
    "is_lower": ("BOOLEAN", f"s RLIKE r'{LOWER}' AND NOT s RLIKE r'[{UPPER}{TITLE}]'"),
    "is_upper": ("BOOLEAN", f"s RLIKE r'{UPPER}' AND NOT s RLIKE r'[{LOWER}{TITLE}]'"),
    "is_title": ("BOOLEAN", f"s RLIKE r'[{UPPER}{TITLE}]' AND NOT s RLIKE r'[{_CASED}][{UPPER}{TITLE}]' AND NOT s RLIKE r'(?<![{_CASED}]){LOWER}'"),
    "is_oov": ("BOOLEAN", "CASE WHEN s IS NOT NULL THEN true END"),
}


def sql_bodies(stops: Iterable[str] = ()) -> dict[str, tuple[str, str]]:
    """All SQL functions, with ``is_stop`` for the given words and the flag word made of the others."""
    bodies = SQL_BODIES | {"is_stop": ("BOOLEAN", _in(stops).replace("s IN", "lower(s) IN", 1) if (stops := list(stops)) else "CASE WHEN s IS NOT NULL THEN false END")}
    bits = " + ".join(f"CASE WHEN {bodies[a.name.lower()][1]} THEN {1 << int(a)} ELSE 0 END" for a in FLAGS)
    return bodies | {"flag_word": ("BIGINT", f"CASE WHEN s IS NOT NULL THEN CAST({bits} AS BIGINT) END")}


def register_sql(spark: SparkSession, stops: Iterable[str] = ()) -> list[str]:
    """Temporary SQL functions with the attributes' names; their bodies are inlined into the plan."""
    bodies = sql_bodies(stops)
    for name, (kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS {kind} RETURN {body}")
    return list(bodies)
