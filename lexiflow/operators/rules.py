"""Rules of the word splitter: prefixes, suffixes, infixes and exceptions, as immutable values that compile once."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

from lexiflow.functions.chars import letter_classes, symbol_class

# Fixed values, written as regular expressions one after the other.
PUNCTUATION = r"… …… , : ; \! \? ¿ ؟ ¡ \( \) \[ \] \{ \} < > _ # \* & 。 ？ ！ ， 、 ； ： ～ · । ، ۔ ؛ ٪".split(" ")
QUOTES = r"""\' " ” “ ` ‘ ´ ’ ‚ , „ » « 「 」 『 』 （ ） 〔 〕 【 】 《 》 〈 〉""".split(" ")
HYPHENS = "- – — -- --- —— ~".split(" ")
CURRENCY = r"\$ £ € ¥ ฿ US\$ C\$ A\$ ₽ ﷼ ₴".split(" ")
UNITS = (
    "km km² km³ m m² m³ dm dm² dm³ cm cm² cm³ mm mm² mm³ ha µm nm yd in ft kg g mg µg t lb oz m/s km/h kmh mph hPa Pa mbar mb MB kb KB gb GB tb TB T G M K % "
    "км км² км³ м м² м³ дм дм² дм³ см см² см³ мм мм² мм³ нм кг г мг м/с км/ч кПа Па мбар Кб КБ кб Мб МБ мб Гб ГБ гб Тб ТБ тбكم "  # the last two are one entry
    "كم² كم³ م م² م³ سم سم² سم³ مم مم² مم³ كم غرام جرام جم كغ ملغ كوب اكواب"
).split(" ")
ELLIPSES = [r"\.\.+", "…"]


# The patterns of the three lists below.
@lru_cache(maxsize=1)
def default_prefixes() -> tuple[str, ...]:
    return ("§", "%", "=", "—", "–", r"\+(?![0-9])", *PUNCTUATION, *ELLIPSES, *QUOTES, *CURRENCY, f"[{symbol_class()}]")


@lru_cache(maxsize=1)
def default_suffixes() -> tuple[str, ...]:
    letters = letter_classes()
    marks = "|".join(PUNCTUATION)
    quotes = "".join(QUOTES)
    after = [
        r"(?<=[0-9])\+",
        r"(?<=°[FfCcKk])\.",
        f"(?<=[0-9])(?:{'|'.join(CURRENCY)})",
        f"(?<=[0-9])(?:{'|'.join(UNITS)})",
        rf"(?<=[0-9{letters['lower']}%²\-\+{marks}(?:{quotes})])\.",
        rf"(?<=[{letters['upper']}][{letters['upper']}])\.",
    ]
    return (*PUNCTUATION, *ELLIPSES, *QUOTES, f"[{symbol_class()}]", "'s", "'S", "’s", "’S", "—", "–", *after)


@lru_cache(maxsize=1)
def default_infixes() -> tuple[str, ...]:
    letters, quotes = letter_classes(), "".join(QUOTES)
    alpha, lower, upper = letters["alpha"], letters["lower"], letters["upper"]
    between = [
        r"(?<=[0-9])[+\-\*^](?=[0-9-])",
        rf"(?<=[{lower}{quotes}])\.(?=[{upper}{quotes}])",
        f"(?<=[{alpha}]),(?=[{alpha}])",
        f"(?<=[{alpha}])(?:{'|'.join(HYPHENS)})(?=[{alpha}])",
        f"(?<=[{alpha}0-9])[:<>=/](?=[{alpha}])",
    ]
    return (*ELLIPSES, f"[{symbol_class()}]", *between)


#: More than any default suffix and what it looks back at.
REACH = 32

# Stems, and the endings they take; a plus joins the pieces of an ending. Each form also exists with its
# apostrophes left out and with a capital first letter.
CONTRACTIONS = (
    ("i", "'m 'm+a"),
    ("i you he she it we they", "'ll 'll+'ve 'd 'd+'ve"),
    ("i you we they", "'ve"),
    ("you we they", "'re"),
    ("he she it", "'s"),
    ("who what when where why how there that", "'s 'll 'll+'ve 're 've 'd 'd+'ve"),
    ("ca could do does did had may might must need ought sha should wo would", "n't n't+'ve"),
    ("could might must should would", "'ve"),
    ("ai are is was were have has dare", "n't"),
)
# What the pieces stand for.
NORMS = {"'m": "am", "a": "gonna", "'ll": "will", "'ve": "have", "'d": "would", "'re": "are", "'s": "'s", "n't": "not", "ca": "can", "sha": "shall", "wo": "will"}
# Forms whose pieces don't follow a rule.
IRREGULAR = (
    "y'+all y+all how+'d+'y How+'d+'y not+'ve not+ve Not+'ve Not+ve can+not Can+not gon+na Gon+na got+ta Got+ta let+'s Let+'s"
)
# Words that stay one token although a rule would cut them.
G_DROPPED = "doin goin nothin nuthin ol somethin lovin havin"
APOSTROPHE_DROPPED = "cause em ll nuff"
WHOLE = (
    "'S 's ‘S ‘s and/or w/o 're 'Cause 'cause 'cos 'Cos 'coz 'Coz 'cuz 'Cuz 'bout ma'am Ma'am o'clock O'clock "
    "Mt. Ak. Ala. Apr. Ariz. Ark. Aug. Calif. Colo. Conn. Dec. Del. Feb. Fla. Ga. Ia. Id. Ill. Ind. Jan. Jul. Jun. Kan. Kans. Ky. La. Mar. Mass. May. Mich. Minn. Miss. "
    "N.C. N.D. N.H. N.J. N.M. N.Y. Neb. Nebr. Nev. Nov. Oct. Okla. Ore. Pa. S.C. Sep. Sept. Tenn. Va. Wash. Wis. "
    "'d a.m. Adm. Bros. co. Co. Corp. D.C. Dr. e.g. E.g. E.G. Gen. Gov. i.e. I.e. I.E. Inc. Jr. Ltd. Md. Messrs. Mo. Mont. Mr. Mrs. Ms. p.m. Ph.D. Prof. Rep. Rev. Sen. St. vs. v.s."
)
# Forms that are words of their own.
HOMOGRAPHS = "Ill ill Its its Hell hell Shell shell Shed shed were Were Well well Whore whore"


@lru_cache(maxsize=1)
def default_exceptions() -> dict[str, tuple[str, ...]]:
    """Surface to pieces, grown from the tables above."""
    forms: list[tuple[str, ...]] = []
    for stems, endings in CONTRACTIONS:
        for stem in stems.split():
            for ending in endings.split():
                pieces = (stem, *ending.split("+"))
                forms += [pieces, tuple(p.replace("'", "") for p in pieces)]
    forms += [(p[0].capitalize(), *p[1:]) for p in forms]
    forms += [(str(hour), half) for hour in range(1, 13) for half in ("a.m.", "am", "p.m.", "pm")]
    forms += [tuple(f.split("+")) for f in IRREGULAR.split()]
    for word in G_DROPPED.split():
        forms += [(w + end,) for w in (word, word.capitalize()) for end in ("", "'")]
    forms += [(mark + word,) for word in APOSTROPHE_DROPPED.split() for mark in ("", "'")]
    forms += [(word,) for word in WHOLE.split()]
    out = {"".join(f): f for f in forms}
    for word in HOMOGRAPHS.split():
        out.pop(word, None)
    return out


def norm_of(piece: str) -> str:
    """What a piece of an exception stands for; the piece in lower case if nothing else is known."""
    low = piece.lower()
    return NORMS.get(low, NORMS.get("'" + low, low) if low in {"m", "ll", "ve", "re"} else low)


def _pieces(entry: Iterable) -> tuple[str, ...]:
    """An exception's pieces, given as strings or as mappings that have them under ORTH."""
    return tuple(str(e["ORTH"]) if isinstance(e, Mapping) else str(e) for e in entry)


def prefix_pattern(entries: Iterable[str]) -> str:
    """Alternation anchored entry by entry. A list that holds a bare ``(`` is one of plain strings and is escaped."""
    entries = list(entries)
    plain = "(" in entries
    return "|".join("^" + (re.escape(e) if plain else e) for e in entries if e.strip())


def suffix_pattern(entries: Iterable[str]) -> str:
    return "|".join(e + "$" for e in entries if e.strip())


def infix_pattern(entries: Iterable[str]) -> str:
    return "|".join(e for e in entries if e.strip())


@dataclass(frozen=True)
class TokenizerRules:
    """A rule family left at None has the defaults; an empty one (or one of blank entries) is off.

    ``infix_gaps`` tells what an empty piece between two infixes does: "drop" ends the word there, "keep" skips it.
    Raises ``re.error`` when a pattern is invalid.
    """

    prefixes: tuple[str, ...] | None = None
    suffixes: tuple[str, ...] | None = None
    infixes: tuple[str, ...] | None = None
    exceptions: Mapping[str, tuple[str, ...]] | None = field(default=None, hash=False)
    infix_gaps: str = "drop"

    def __post_init__(self) -> None:
        if self.infix_gaps not in ("drop", "keep"):
            raise ValueError("infix_gaps is 'drop' or 'keep'")
        for name in ("prefixes", "suffixes", "infixes"):
            if (value := getattr(self, name)) is not None:
                object.__setattr__(self, name, tuple(value))
        if self.exceptions is not None:
            object.__setattr__(self, "exceptions", {k: _pieces(v) for k, v in dict(self.exceptions).items()})
        _ = self.prefix_search, self.suffix_search, self.infix_iter

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("prefixes", "suffixes", "infixes", "exceptions", "infix_gaps")}

    def __setstate__(self, state: dict) -> None:
        for k, v in state.items():
            object.__setattr__(self, k, v)

    @cached_property
    def prefix_search(self) -> re.Pattern | None:
        p = prefix_pattern(default_prefixes() if self.prefixes is None else self.prefixes)
        return re.compile(p) if p else None

    @cached_property
    def suffix_search(self) -> re.Pattern | None:
        p = suffix_pattern(default_suffixes() if self.suffixes is None else self.suffixes)
        return re.compile(p) if p else None

    @cached_property
    def infix_iter(self) -> re.Pattern | None:
        p = infix_pattern(default_infixes() if self.infixes is None else self.infixes)
        return re.compile(p) if p else None

    @cached_property
    def table(self) -> Mapping[str, tuple[str, ...]]:
        return default_exceptions() if self.exceptions is None else self.exceptions

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.table), default=0)

    def prefix_length(self, word: str) -> int:
        if not self.prefix_search:
            return 0
        # Every default entry is anchored; an entry of one's own with a bar may match further on.
        m = self.prefix_search.match(word) if self.prefixes is None else self.prefix_search.search(word)
        return len(m[0]) if m else 0

    def suffix_length(self, word: str) -> int:
        if not self.suffix_search:
            return 0
        # Default entries are short but for a run of dots, so there is no need to search all of a long word.
        start = len(word.rstrip(".")) - REACH if self.suffixes is None and len(word) > REACH else 0
        m = self.suffix_search.search(word, max(start, 0))
        return len(m[0]) if m else 0

    def infix_spans(self, word: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.infix_iter.finditer(word)] if self.infix_iter and word else []

    def split(self, word: str) -> list[str]:
        """The tokens of a word without white space. May be empty (only under "drop")."""
        head: list[str] = []
        tail: list[str] = []
        misses, at_front = 0, True
        while misses < 2:
            if len(word) <= self.longest and word in self.table:
                return [*head, *self.table[word], *reversed(tail)]
            n = self.prefix_length(word) if at_front else self.suffix_length(word)
            if n and at_front:
                head.append(word[:n])
                word = word[n:]
            elif n:
                tail.append(word[-n:])
                word = word[:-n]
            misses = 0 if n else misses + 1
            at_front = not at_front
        return [*head, *self._between_infixes(word), *reversed(tail)]

    def _between_infixes(self, word: str) -> list[str]:
        spans = self.infix_spans(word)
        if not spans:
            return [word] if word else []
        borders = [0, *(x for s in spans for x in s), len(word)]
        out = []
        for a, b in zip(borders, borders[1:], strict=False):
            if a == b:
                if self.infix_gaps == "drop":
                    break
                continue
            out.append(word[a:b])
        return out


DEFAULT = TokenizerRules()
