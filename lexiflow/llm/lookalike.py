"""One consistent form for text that looks the same but is made of different characters.

The form is found in three steps:

1. compatibility normalisation of what looks the same (full-width and half-width forms, letters in other fonts,
   presentation forms, ligatures, odd blanks), deletion of ignorable characters, and canonical composition of accents.
   Superscripts, fractions, circled letters and signs look different, so they stay;
2. every look-alike letter is brought to a prototype, which gives the *skeleton* of the text. Texts that look the same
   have the same skeleton;
3. each word of the skeleton opens a lattice: at every place the letters of all scripts (Latin, Cyrillic, Greek, Armenian,
   Cherokee) that share the prototype. A Viterbi search picks the path of the best character bigram score, where a change
   of script inside a word costs ``SWITCH``, and the script that prevails among the unmistakable letters of the text (Latin
   if it has none) gets ``CONTEXT`` a letter.

The skeleton of a batch of texts is one lookup in a table of code points; only texts with characters that come out as
several, or that join their neighbours, are worked on one by one.

As the result depends on the skeleton alone, texts that look the same always get the same form. Letter case, accents and
punctuation signs are kept. Nulls stay null, an empty text stays empty, a text of ignorable characters becomes empty.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.plans.skew import lookup

# Letters of four other scripts that are drawn like the Latin letter before them.
CYRILLIC = {
    "a": "а", "c": "с", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "ј", "l": "ӏ", "o": "о", "p": "р", "q": "ԛ", "s": "ѕ", "w": "ԝ", "x": "х", "y": "у",
    "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "I": "І", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р", "S": "Ѕ", "T": "Т", "X": "Х", "Y": "У",
}
GREEK = {
    "o": "ο", "v": "ν",
    "A": "Α", "B": "Β", "E": "Ε", "H": "Η", "I": "Ι", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ", "X": "Χ", "Y": "Υ", "Z": "Ζ",
}

ARMENIAN = {"g": "ց", "h": "հ", "n": "ո", "o": "օ", "q": "զ", "u": "ս", "L": "Լ", "O": "Օ", "S": "Տ", "U": "Ս"}
CHEROKEE = {
    "A": "Ꭺ", "B": "Ᏼ", "C": "Ꮯ", "D": "Ꭰ", "E": "Ꭼ", "G": "Ꮐ", "H": "Ꮋ", "J": "Ꭻ", "K": "Ꮶ", "L": "Ꮮ", "M": "Ꮇ", "P": "Ꮲ", "R": "Ꭱ", "S": "Ꮪ", "T": "Ꭲ", "V": "Ꮩ", "W": "Ꮃ", "Z": "Ꮓ",
}

#: The planes that have characters with a decomposition or without a shape; the others have ideographs and private ones.
LOOKED_AT = [*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE1000)]
#: Characters that are not seen: format characters (soft hyphen, joiners, zero-width blanks, direction marks, byte order
#: mark, tags and the like) but for those that are drawn (signs before Arabic, Syriac, Kaithi and Egyptian text), fillers,
#: and selectors of variants.
DRAWN = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD, *range(0x13430, 0x13456)}
SELECTORS = [*range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
IGNORABLE = [cp for cp in LOOKED_AT if unicodedata.category(chr(cp)) == "Cf" and cp not in DRAWN] + [0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0, *SELECTORS]
#: Kinds of compatibility characters that look like what they stand for; ``<compat>`` is one for letters only.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")

#: Log-probabilities: the cost of a change of script within a word, and the worth of a letter in the text's own script.
SWITCH, CONTEXT, SMOOTH = -25.0, 6.0, 0.5

SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee")
ALPHABETS = (CYRILLIC, GREEK, ARMENIAN, CHEROKEE)


def _compat() -> dict[int, str | None]:
    """Compatibility characters that look the same, odd blanks and ignorable characters."""
    out: dict[int, str | None] = {}
    for cp in LOOKED_AT:
        kind = unicodedata.decomposition(chr(cp)).split(" ")[0]
        if kind in SAME_LOOK or kind == "<compat>" and unicodedata.category(chr(cp)) in ("Ll", "Lu", "Lt", "Lo", "Nl"):
            out[cp] = unicodedata.normalize("NFKC", chr(cp))
    out |= dict.fromkeys(IGNORABLE)
    for cp in [0x00A0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x0085, 0x0B, 0x0C]:
        out[cp] = " "
    return out


COMPAT = _compat()
SHAPERS = {0x200D, 0xFE0E, 0xFE0F}
COMPAT_BUT_SHAPERS = {k: v for k, v in COMPAT.items() if k not in SHAPERS}
PROTOTYPE = {ord(v): k for alphabet in ALPHABETS for k, v in alphabet.items()}
BLANKS = re.compile(r"[ \t\r\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: A joiner between two pictographs shapes them, and so does a selector after one, so both can be seen.
PICTURE = "\\U0001F000-\\U0001FAFF\\u2600-\\u27BF\\uFE0F"
LOST_SHAPER = re.compile(f"(?<![{PICTURE}])\\u200D|\\u200D(?![{PICTURE}])|(?<![{PICTURE}])[\\uFE0E\\uFE0F]")
AMBIGUOUS = "".join(sorted({c for alphabet in ALPHABETS for c in alphabet}))
AMBIGUOUS_WORD = re.compile(rf"(?<![^\W\d_])[{AMBIGUOUS}]+(?![^\W\d_])")
CLEAR = {
    "Latin": re.compile(rf"[^\W\d_{AMBIGUOUS}\u0370-\u1CFF\u1F00-\u1FFF\u2C80-\U0010FFFF]"),
    "Cyrillic": re.compile(r"[\u0400-\u052F]"),
    "Greek": re.compile(r"[\u0370-\u03FF\u1F00-\u1FFF]"),
    "Armenian": re.compile(r"[\u0531-\u058F]"),
    "Cherokee": re.compile(r"[\u13A0-\u13FF\uAB70-\uABBF]"),
}

OTHER = re.compile(r"[\u0370-\u03FF\u0400-\u052F\u0531-\u058F\u13A0-\u13FF\u1F00-\u1FFF\uAB70-\uABBF]")

#: The alphabet of the bigram counts. Index 0 is everything else, so the table has a fixed size whatever the corpus.
ALPHABET = [chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x180), *range(0x386, 0x3CF), *range(0x400, 0x460), *range(0x531, 0x588), *range(0x13A0, 0x13F6)] if chr(c).isalpha()]
ALPHABET += sorted({c for alphabet in ALPHABETS for c in alphabet.values()} - {*ALPHABET})
INDEX = {c: i + 1 for i, c in enumerate(ALPHABET)}
SIZE = len(ALPHABET) + 1


def script_of(c: str) -> int:
    """Place of the letter's script in SCRIPTS; 0 for whatever is none of them."""
    o = ord(c)
    if 0x400 <= o <= 0x52F:
        return 1
    if 0x370 <= o <= 0x3FF or 0x1F00 <= o <= 0x1FFF:
        return 2
    return 3 if 0x531 <= o <= 0x58F else 4 if 0x13A0 <= o <= 0x13FF or 0xAB70 <= o <= 0xABBF else 0


def skeleton(text: str) -> str:
    """The skeleton of one text."""
    if SHAPERS.isdisjoint(map(ord, text)):
        text = text.translate(COMPAT)
    else:
        text = LOST_SHAPER.sub("", text).translate(COMPAT_BUT_SHAPERS)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(PROTOTYPE))


#: Marks of the tables: a code point that goes, and one that needs the whole text.
GONE, ALONE, BORDER = 0, 0x110000, 0x10FFFF


@lru_cache(maxsize=1)
def joining() -> frozenset[int]:
    """Code points that may join or swap with the one before them."""
    second = {int(d.split(" ")[1], 16) for cp in LOOKED_AT if (d := unicodedata.decomposition(chr(cp))) and d[0] != "<" and " " in d}
    return frozenset(second | {cp for cp in LOOKED_AT if unicodedata.combining(chr(cp))} | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)})


@lru_cache(maxsize=1)
def skeleton_table() -> np.ndarray:
    """For each code point the one it has in a skeleton, GONE, or ALONE."""
    out = np.arange(0x110000, dtype=np.uint32)
    for cp in {*LOOKED_AT, *COMPAT}:
        made = skeleton(chr(cp))
        if len(made) != 1 or made != chr(cp):
            out[cp] = GONE if not made else ord(made) if len(made) == 1 else ALONE
    out[[*joining(), *SHAPERS]] = ALONE
    return out


def skeletons(texts: list[str]) -> list[str]:
    """Skeletons of many texts at once."""
    if not texts:
        return []
    whole = chr(BORDER).join(texts)
    if whole.isascii() or whole.count(chr(BORDER)) >= len(texts):
        return [t if t.isascii() and "\x0b" not in t and "\x0c" not in t else skeleton(t) for t in texts]
    cp = skeleton_table()[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    ends = np.flatnonzero(cp == BORDER)
    alone = np.unique(np.searchsorted(ends, np.flatnonzero(cp == ALONE))).tolist()
    out = cp[(cp != GONE) & (cp != ALONE)].tobytes().decode("utf-32-le", "surrogatepass").split(chr(BORDER))
    for i in alone:
        out[i] = skeleton(texts[i])
    return out


def _lookup() -> np.ndarray:
    out = np.zeros(0x110000, dtype=np.int32)
    for c, i in INDEX.items():
        out[ord(c)] = i
    return out


def bigram_counts(df: DataFrame, column: str) -> DataFrame:
    """(pair, n): how often each pair of letters of ALPHABET (or a letter and a border) is adjacent, over all rows.

    Counted in numpy by batch, so at most ``SIZE ** 2`` rows leave a task, then summed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _lookup(), np.zeros(SIZE * SIZE, dtype=np.int64)
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            if texts:
                at = table[np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "replace"), dtype=np.uint32)].astype(np.int64)
                total += np.bincount(at[:-1] * SIZE + at[1:], minlength=SIZE * SIZE)
        total[0] = 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["pair", "n"])

    return df.select(column).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


class Lattice:
    """The trained search. ``counts`` are (pair, n) rows; there are at most ``SIZE ** 2`` of them."""

    def __init__(self, counts: list[tuple[int, int]]):
        n = np.zeros((SIZE, SIZE))
        for pair, k in counts:
            n[pair // SIZE, pair % SIZE] = k
        side = np.array([-1, *map(script_of, ALPHABET)])
        self.score = np.full((SIZE, SIZE), SWITCH)
        for s in range(len(SCRIPTS)):
            own = np.flatnonzero((side == s) | (side == -1))
            part = n[np.ix_(own, own)] + SMOOTH
            self.score[np.ix_(own, own)] = np.log(part / part.sum(axis=1, keepdims=True))
        self.prior = np.log((np.array([n[side == s].sum() for s in range(len(SCRIPTS))]) + 1) / (n.sum() + len(SCRIPTS)))
        self.memory: dict[tuple[str, int], str] = {}

    def __getstate__(self):
        return {"score": self.score, "prior": self.prior, "memory": {}}

    def alternatives(self, c: str) -> list[tuple[str, int]]:
        """The letter itself and the look-alike letters of the other scripts, with its accent if it has one."""
        base, accent = c, ""
        if c >= "\x80":
            whole = unicodedata.normalize("NFD", c)
            base, accent = whole[0], whole[1:]
        out = [(c, script_of(c))]
        for script, alphabet in enumerate(ALPHABETS, 1):
            if base in alphabet and len(other := unicodedata.normalize("NFC", alphabet[base] + accent)) == 1:
                out.append((other, script))
        return out

    def word(self, skeleton: str, prevailing: int) -> str:
        """The best path through the lattice of one word."""
        key = (skeleton, prevailing)
        if (known := self.memory.get(key)) is not None:
            return known
        paths: list[tuple[float, int, int, str]] = []
        for k, c in enumerate(skeleton):
            now = []
            for letter, script in self.alternatives(c):
                i, own = INDEX.get(letter, 0), CONTEXT * (script == prevailing)
                if k == 0:
                    now.append((self.score[0, i] + self.prior[script] + own, script, i, letter))
                    continue
                best = max(paths, key=lambda p: p[0] + (SWITCH if p[1] != script else self.score[p[2], i]))
                now.append((best[0] + (SWITCH if best[1] != script else self.score[best[2], i]) + own, script, i, best[3] + letter))
            paths = now
        out = max(paths, key=lambda p: (p[0] + (self.score[p[2], 0] if p[2] else 0), -p[1]))[3] if paths else ""
        if len(self.memory) < 500_000:
            self.memory[key] = out
        return out

    def of_skeleton(self, text: str) -> str:
        """The consistent form of a text that has a skeleton."""
        prevailing, words = 0, AMBIGUOUS_WORD
        if not text.isascii() and OTHER.search(text):
            clear = [len(CLEAR[s].findall(text)) for s in SCRIPTS]
            prevailing, words = max(range(len(SCRIPTS)), key=lambda s: (clear[s], -s)), WORD
        return words.sub(lambda m: self.word(m[0], prevailing), text)

    def text(self, text: str) -> str:
        """The consistent form of a text; blanks are left as they are but for odd ones, which become plain ones."""
        return self.of_skeleton(skeleton(text))

    def texts(self, texts: list[str]) -> list[str]:
        """The same for many texts."""
        return list(map(self.of_skeleton, skeletons(texts)))


def collapse(text: str) -> str:
    """A run of blanks, tabs and line ends counts as one blank; those at both ends don't count."""
    return BLANKS.sub(" ", text).strip(" ")


def train(df: DataFrame, column: str = "text") -> Lattice:
    """Fit the bigram scores on all rows of ``column``. What reaches the driver is a table of fixed size."""
    return Lattice([(r[0], r[1]) for r in bigram_counts(df, column).collect()])


def normalize(df: DataFrame, column: str, lattice: Lattice, out: str = "normal") -> DataFrame:
    """``df`` with the consistent form of ``column`` in ``out`` (replaced if it exists)."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(lattice)

    @F.pandas_udf("string")
    def form(texts):
        own = shared.value
        some = texts.notna()
        out = texts.astype(object)
        out[some] = own.texts(texts[some].tolist())
        return out

    return df.withColumn(out, form(F.col(column)))


def looks(df: DataFrame, key: str, column: str, lattice: Lattice, min_runs: int = 0) -> DataFrame:
    """(k, form, raw): hashes of each row's consistent form and of its own characters, blanks collapsed; a key that comes
    twice counts once. Rows with a null key or text, and texts of blanks alone, are left out."""
    shared = df.sparkSession.sparkContext.broadcast(lattice)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        from lexiflow.llm.common import RUN

        own = shared.value
        for batch in batches:
            keys, forms, raws = [], [], []
            texts = batch.column(1).to_pylist()
            for k, t, form in zip(batch.column(0).to_pylist(), texts, own.texts(texts), strict=True):
                form = collapse(form)
                if not form or min_runs and len(RUN.findall(form)) < min_runs:
                    continue
                keys.append(k)
                forms.append(blake2b(form.encode("utf-8", "replace"), digest_size=16).digest())
                raws.append(blake2b(collapse(t).encode("utf-8", "replace"), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(forms, pa.binary()), pa.array(raws, pa.binary())], ["k", "form", "raw"])

    src = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(column).cast("string").alias("t"))
    once = src.mapInArrow(hashed, "k long, form binary, raw binary").groupBy("k").agg(F.min(F.struct("form", "raw")).alias("h"))
    return once.select("k", "h.form", "h.raw")


def mixed(df: DataFrame, key: str, column: str, lattice: Lattice, min_runs: int = 0) -> DataFrame:
    """The rows of ``looks`` whose form has several spellings, written once. Forms are compared before any join, where the
    rows are, so copies of one spelling collapse."""
    from lexiflow.llm.common import cut, cut_table

    rows = cut_table(looks(df, key, column, lattice, min_runs))
    several = rows.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    return cut(lookup(rows, several.select("form", "n"), ["form"], "n").select("k", "form", "raw"))


def equal_looking_pairs(df: DataFrame, key: str, column: str, lattice: Lattice, min_runs: int = 0) -> DataFrame:
    """(key_a, key_b): each pair of rows whose texts look the same but differ in characters, key_a < key_b.

    Only hashes are shuffled. Pairs are made between *different spellings* of a form and then expanded to their rows, so
    exact copies never meet each other and no more rows are made than the result has. For classes in place of pairs see
    ``equal_looking_classes``.
    """
    rows = mixed(df, key, column, lattice, min_runs)
    spellings = rows.groupBy("form", "raw").agg(F.count("*").alias("n"))
    a, b = spellings.select("form", F.col("raw").alias("raw_a")), spellings.select("form", F.col("raw").alias("raw_b"))
    pairs = a.join(b, "form").where("raw_a < raw_b")
    left = rows.select("form", F.col("raw").alias("raw_a"), F.col("k").alias("ka"))
    right = rows.select("form", F.col("raw").alias("raw_b"), F.col("k").alias("kb"))
    both = pairs.join(left, ["form", "raw_a"]).join(right, ["form", "raw_b"])
    return both.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))


def equal_looking_classes(df: DataFrame, key: str, column: str, lattice: Lattice, min_runs: int = 0) -> DataFrame:
    """(k, class_id, rows, spellings, links): each row of a form with several spellings, the smallest key of its class, the
    rows and spellings of the class, and how many rows look like it but differ in characters. No pair is made."""
    rows = mixed(df, key, column, lattice, min_runs)
    spellings = rows.groupBy("form", "raw").agg(F.count("*").alias("n"), F.min("k").alias("first"))
    whole = spellings.groupBy("form").agg(F.min("first").alias("class_id"), F.sum("n").alias("rows"), F.count("*").alias("spellings"))
    each = spellings.join(whole, "form").withColumn("links", F.col("rows") - F.col("n"))
    return lookup(rows, each.drop("first"), ["form", "raw"], "n").select("k", "class_id", "rows", "spellings", "links")
