"""Find text that was decoded with the wrong character encoding, and restore it where that is still possible.

1. Adjacent character pairs are scored by their mutual information over the whole corpus. Plain letters, digits, blanks
   and signs are one symbol each, every other character is its own, and only pairs with such a character are counted.
   Runs that are valid UTF-8 once mapped back through a wrong encoding, replacement characters and stray controls don't
   vouch for themselves, so they are left out of the counts. As mutual information is unreliable for what is rare, it is
   shrunk towards the lowest score in proportion to what a pair lacks of standing in ``SUPPORT`` of the records: the more two
   characters attract each other, the fewer records it takes to make them probable.
2. In each record the maximum-scoring segments of improbability are isolated: pairs with a low score add, others take off,
   and a segment counts by its sum. Only what stands in such a segment can make a record a damaged one.
3. Only inside these segments the inverse mappings are tested: back through each wrong encoding, then forward as UTF-8 or
   as another one-byte encoding. A mapping counts if the pairs it leaves are probable ones; this is repeated, for text
   that was damaged several times.

A record that holds a replacement character was damaged beyond restoration at that place; the rest is still restored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import cut
from lexiflow.llm.lookalike import COMPAT, PROTOTYPE, script_of

#: Share of the records that a pair must stand in for its score to count in full, and the least number of them.
SUPPORT, LEAST = 0.001, 3
#: Score of a pair without any support, scores between which mutual information counts (what stands in enough records isn't
#: improbable, however much the two avoid each other), the score down to which a pair counts as improbable, what each
#: pair takes off the improbability of a segment, and what a segment must come to: as much as one improbable pair.
LOWEST, LEAST_INFORMATION, HIGHEST, WEAK, DRAG = -4.0, -2.0, 4.0, -3.0, 1.0
ENOUGH = -WEAK - DRAG
#: Below this share of the support any pair is improbable, so it isn't kept.
FAINT = 0.1
#: What a mapping may leave of the improbability at most.
LEFT = 0.75
#: Wrong encodings a text may have come through, and one-byte encodings it may have been written in.
WRONG = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "iso8859_15", "cp1250", "iso8859_2", "cp1253", "cp1254", "cp1257", "cp1258", "iso8859_5", "iso8859_7")
TRUE = ("cp1252", "cp1251", "mac_roman", "cp850", "cp437", "koi8_r", "cp866", "cp1250", "cp1253")
#: Wrong encodings whose letters stand in many rare names, so a few of them are no evidence of one-byte damage.
NAMES = ("cp1250", "iso8859_2", "cp1257", "cp1254", "cp1258")
#: Encodings of two bytes that UTF-8 may have been read in, or that a text may have been written in.
WIDE = ("gbk", "big5", "cp932", "euc_kr", "euc_jp")
#: Characters of two bytes that a run must give to be taken for text of such an encoding.
WIDE_RUN = 3
DEPTH = 3
#: What one-byte damage there can be at most, in times of its rate; how even its rate is, beside how many letters, and for
#: how many more letters.
SLACK, AGREE, CONTEXTS, COMPANIONS = 3.0, 0.7, 4, 2
RUN_OF_OTHERS = re.compile(r"[^\x00-\x7f]+")
OTHER = re.compile(r"[^\x00-\x7f]")
CYRILLIC_RUN = re.compile("[\u0400-\u052f]{2}")
LOST = "�"
#: Control characters that no text has on purpose; only a wrong encoding makes them.
STRAY = re.compile("[\x80-\x84\x86-\x9f]")
#: Characters that are odd for other reasons than a wrong encoding.
NO_EVIDENCE = {*PROTOTYPE, *COMPAT}
OPEN = {"”": "“„", "’": "‘‚", "»": "«", "›": "‹"}


@lru_cache(maxsize=None)
def forward(encoding: str) -> tuple[str, ...]:
    """The character of each byte from 0x80 on; bytes without one stand for the control character of that number."""
    out = []
    for b in range(0x80, 0x100):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


@lru_cache(maxsize=None)
def backward(encoding: str) -> dict[int, int]:
    """Byte of each character, as ``str.translate`` takes it. Windows encodings also take the bare control characters."""
    out = {ord(c): 0x80 + i for i, c in enumerate(forward(encoding))}
    if encoding.startswith("cp125") or encoding.startswith("iso"):
        for b in range(0x80, 0xA0):
            out.setdefault(b, b)
    if encoding == "cp1252":
        for b in range(0xA0, 0x100):
            out.setdefault(b, b)
    return out


def to_bytes(text: str, encoding: str) -> bytes | None:
    if encoding in WIDE:
        try:
            return text.encode(encoding)
        except UnicodeEncodeError:
            return None
    table = backward(encoding)
    try:
        return bytes(o if (o := ord(c)) < 0x80 else table[o] for c in text)
    except KeyError:
        return None


def as_utf8(text: str, encoding: str) -> str | None:
    """``text`` mapped back through ``encoding`` and read as UTF-8, if that is possible and gives usual characters."""
    raw = to_bytes(text, encoding)
    if raw is None:
        return None
    try:
        out = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return out if all(unicodedata.category(c) not in ("Cn", "Co", "Cs") for c in out) else None


def as_torn_utf8(text: str, encoding: str) -> str | None:
    """As ``as_utf8`` for a run of which some bytes were lost on the way: two whole characters for each torn one, or more."""
    raw = to_bytes(text, encoding)
    if raw is None or len(raw) < 6:
        return None
    out = raw.decode("utf-8", "replace")
    torn = out.count(LOST)
    whole = sum(c > "\x7f" for c in out) - torn
    return out if whole >= 2 * torn > 0 and all(unicodedata.category(c) not in ("Cn", "Co", "Cs") for c in out) else None


@lru_cache(maxsize=200_000)
def invertible(run: str) -> bool:
    return len(run) > 1 and any(as_utf8(run, e) is not None for e in WRONG)


def symbols() -> np.ndarray:
    """Symbol of every code point: 1 to 6 for plain characters, the code point for others, 0 for what isn't counted."""
    out = np.arange(0x110000, dtype=np.int64)
    for cp in range(0x80):
        c = chr(cp)
        out[cp] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c.isspace() else 5
    out[0] = 0
    return out


SYMBOLS = symbols()
#: The same, but letters are themselves; with ``EXACT`` in the key.
LETTERS = np.where([c < 0x80 and chr(c).isalpha() for c in range(0x110000)], np.arange(0x110000), SYMBOLS)
EXACT, LOW = 1 << 42, (1 << 21) - 1
#: Of a character between two plain ones, letters as they are, the key has this bit.
TRIPLE = 1 << 43


def pair_keys(cp: np.ndarray, symbol: np.ndarray = SYMBOLS) -> np.ndarray:
    """A key for each adjacent pair, -1 where both are plain or one isn't counted."""
    s = symbol[cp]
    a, b = s[:-1], s[1:]
    return np.where(((a < 0x80) & (b < 0x80)) | (a == 0) | (b == 0), -1, a << 21 | b)


def triple_keys(cp: np.ndarray, known: np.ndarray) -> np.ndarray:
    """A key for each single character of the known ones that stands between two plain ones."""
    s = LETTERS[cp]
    a, c, b = s[:-2], s[1:-1], s[2:]
    some = (c >= 0x80) & known[c] & (a < 0x80) & (b < 0x80) & (a > 0) & (b > 0)
    return TRIPLE | a[some] << 28 | c[some] << 7 | b[some]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def repertoire() -> list[int]:
    """Every symbol that a one-byte encoding has: the plain ones and the characters from 0x80 on."""
    return sorted({*range(1, 0x80), *(ord(c) for e in (*WRONG, *TRUE) for c in forward(e))})


def in_repertoire() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[repertoire()] = True
    return out


IN_REPERTOIRE = in_repertoire()
RUN_OF_BYTES = re.compile("[" + "".join(re.escape(chr(c)) for c in repertoire() if c >= 0x80) + "]+")


def pair_counts(df: DataFrame, column: str) -> DataFrame:
    """(pair, n, records): how often, and in how many rows, each pair stands outside of runs that can be mapped back.

    The row of pair -1 has the number of rows with a text. Pairs with a letter as it is are there besides, with ``EXACT``
    in their key and without rows, if the other character is in a one-byte encoding; with ``TRIPLE``, such characters
    between two plain ones.
    """
    known = IN_REPERTOIRE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hide = lambda m: "\x00" * len(m[0]) if len(m[0]) > 1 and invertible(m[0]) or LOST in m[0] or STRAY.search(m[0]) else m[0]
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            if not texts:
                continue
            cp = code_points("\n".join(t if t.isascii() else RUN_OF_OTHERS.sub(hide, t) for t in texts))
            key = pair_keys(cp)
            row = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(key)]
            some = key >= 0
            pair, code = np.unique(key[some], return_inverse=True)
            n = np.bincount(code, minlength=len(pair))
            both = np.unique(code.astype(np.int64) << 32 | row[some])
            exact = pair_keys(cp, LETTERS)[some]
            exact, times = np.unique(exact[known[exact >> 21] & known[exact & LOW]], return_counts=True)
            triple, often = np.unique(triple_keys(cp, known), return_counts=True)
            exact, times = np.append(exact | EXACT, triple), np.append(times, often)
            records = np.bincount(both >> 32, minlength=len(pair))
            columns = [np.concatenate(x) for x in ((pair, exact, [-1]), (n, times, [0]), (records, 0 * times, [len(texts)]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["pair", "n", "records"])

    return df.select(column).mapInArrow(count, "pair long, n long, records long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("records").alias("records"))


class Scores:
    """The pairs' mutual information, shrunk by their support; a pair that isn't kept has the lowest score.

    ``letters`` says how often a character stands between two plain ones, letters as they are.
    """

    def __init__(self, rows: list[tuple[int, float]], letters: dict[int, int] | None = None):
        rows, self.letters = sorted(rows), letters or {}
        self.keys, self.score = np.array([k for k, _ in rows], dtype=np.int64), np.array([s for _, s in rows], dtype=float)
        self.costs: dict[str, tuple[float, float]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "costs"} | {"costs": {}}

    def of(self, cp: np.ndarray) -> np.ndarray:
        """Score of each adjacent pair; plain pairs have none to speak of, 0."""
        key = pair_keys(cp)
        out = np.zeros(len(key))
        some = np.flatnonzero(key >= 0)
        if len(some):
            k = key[some]
            at = np.minimum(np.searchsorted(self.keys, k), max(len(self.keys) - 1, 0))
            known = self.keys[at] == k if len(self.keys) else np.zeros(len(k), bool)
            out[some] = np.where(known, self.score[at] if len(self.keys) else 0, LOWEST)
        return out

    def cost(self, text: str) -> tuple[float, float]:
        """How improbable the pairs of a text are together (the sum of the scores below zero), and the lowest score."""
        if (known := self.costs.get(text)) is None:
            s = self.of(code_points(text))
            known = float(-s[s < 0].sum()), float(s.min(initial=0))
            if len(text) < 64:
                if len(self.costs) > 500_000:
                    self.costs.clear()
                self.costs[text] = known
        return known


def shrunk(score: float, records: float, least: float) -> float:
    """Mutual information brought towards the lowest score as far as the pair lacks support."""
    return LOWEST + (min(max(score, LEAST_INFORMATION), HIGHEST) - LOWEST) * min(1.0, max(records, 0.0) / least)


@lru_cache(maxsize=1)
def one_byte_maps() -> tuple[dict[int, int], ...]:
    """For each wrong and true one-byte encoding, the written code point of each one that is read in its place."""
    out = []
    for wrong in WRONG:
        for true in TRUE:
            pairs = [(ord(x), ord(c)) for x, c in zip(forward(wrong), forward(true), strict=True)]
            out.append({x: c for x, c in pairs if x != c and x >= 0xA0 and c >= 0xA0})
    return tuple(out)


def damage_records(exact: dict[int, int], records: dict[int, int]) -> dict[int, float]:
    """How many records of each pair may be one-byte damage of another pair, for pairs where that can be.

    Damage from one encoding to another changes a character in all its contexts alike, so the character it makes stands
    beside the same letters at one rate, whatever that rate is; a rightful one has contexts of its own. The rate of a
    letter is the median over its contexts. It counts if ``AGREE`` of what it makes expected is there, beside ``CONTEXTS``
    different letters or more, for ``COMPANIONS`` more letters of the same mapping too. ``SLACK`` times what is expected
    can be damage.
    """
    around: dict[int, list[tuple[int, int, int]]] = {}
    for key, n in exact.items():
        for c in {key >> 21, key & LOW}:
            if c >= 0x80 and chr(c).isalpha() and min(key >> 21, key & LOW) > 5:
                around.setdefault(c, []).append((key >> 21, key & LOW, n))
    beside: dict[int, list[tuple[int, int]]] = {}
    for key in records:
        for c in {key >> 21, key & LOW}:
            beside.setdefault(c, []).append((key >> 21, key & LOW))
    out: dict[int, float] = {}
    for back in one_byte_maps():
        made = {c: x for x, c in back.items()}
        rates = {}
        for x, c in back.items():
            if c not in around:
                continue
            seen = sorted((exact.get(made.get(a, a) << 21 | made.get(b, b), 0) / n, n) for a, b, n in around[c])
            total = sum(n for _, n in seen)
            rate = seen[int(np.searchsorted(np.cumsum([n for _, n in seen]), total / 2))][0]
            if 0 < rate < 1 and sum(r > 0 for r, _ in seen) >= CONTEXTS and sum(min(r, rate) * n for r, n in seen) >= AGREE * rate * total:
                rates[x] = rate
        if len(rates) <= COMPANIONS:
            continue
        for x, v in rates.items():
            for a, b in beside.get(x, ()):
                both = min(v, rates.get(a, 0.0) if a in back else v, rates.get(b, 0.0) if b in back else v)
                key = a << 21 | b
                out[key] = max(out.get(key, 0.0), SLACK * both * records.get(back.get(a, a) << 21 | back.get(b, b), 0))
    return out


def train(df: DataFrame, column: str = "text") -> Scores:
    """Scores from all rows. A pair has support by the records that can't be one-byte damage of a more frequent pair.

    At most 1 / (FAINT * SUPPORT) times the mean number of pairs in a row, and the pairs of the one-byte alphabets, reach the driver.
    """
    every = cut(pair_counts(df, column))
    rows = every.where("pair = -1").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    a, b = F.shiftright("pair", 21), F.col("pair").bitwiseAND((1 << 21) - 1)
    counts = every.where((F.col("pair") >= 0) & (F.col("pair") < EXACT)).withColumn("a", a).withColumn("b", b)
    left, right = counts.groupBy("a").agg(F.sum("n").alias("na")), counts.groupBy("b").agg(F.sum("n").alias("nb"))
    least = max(LEAST, SUPPORT * rows)
    kept = counts.where(F.col("records") >= FAINT * least)
    total = counts.agg(F.sum("n")).scalar()
    scored = kept.join(left, "a").join(right, "b").select("pair", "records", F.log(F.col("n") * F.lit(1.0) * total / F.col("na") / F.col("nb")).alias("score"))
    found, exact = scored.collect(), every.where(F.col("pair") >= EXACT).select("pair", "n").collect()
    damage = damage_records({k - EXACT: n for k, n in exact if k < TRIPLE}, {r[0]: r[1] for r in found})
    letters = {k: n for k, n in exact if k >= TRIPLE and n >= max(LEAST, SUPPORT * rows / 10)}
    return Scores([(k, shrunk(score, records - damage.get(k, 0.0), least)) for k, records, score in found], letters)


def segments(score: np.ndarray, enough: float = ENOUGH) -> list[tuple[int, int]]:
    """Maximum-scoring segments (first pair, last pair + 1) of improbability, from the left, disjoint, as far as their sum
    is ``enough``."""
    out, total, best, begin, end = [], 0.0, 0.0, 0, 0
    gain = -score - DRAG
    at, n = 0, len(gain)
    hot = np.flatnonzero(gain > 0)
    for h in hot.tolist():
        if h < at:
            continue
        total, best, begin, end, i = 0.0, 0.0, h, h, h
        while i < n:
            total += gain[i]
            if total <= 0:
                break
            if total > best:
                best, end = total, i + 1
            i += 1
        if best >= enough:
            out.append((begin, end))
        at = end
    return out


def cost(text: str, scores: Scores) -> float:
    """How improbable the pairs of a text are together: the sum of the scores below zero."""
    return scores.cost(text)[0]


def lowest(text: str, scores: Scores) -> float:
    return scores.cost(text)[1]


def _mapped(part: str, before: str, after: str, scores: Scores) -> str | None:
    """The best mapping of ``part`` back through a wrong encoding and forward as UTF-8, between its neighbours, or None.

    Look-alike letters, blanks and ignorable characters beside letters are no evidence on their own.
    """
    if (before.isalpha() or after.isalpha()) and all(ord(c) in NO_EVIDENCE for c in part):
        return None
    now = cost(before + part + after, scores)
    best, least = None, LEFT * now
    for wrong in (*WRONG, *WIDE) if min(part) >= "\u3400" else WRONG if len(part) > 1 else ():
        if (out := as_utf8(part, wrong)) is not None and out != part:
            c = cost(before + out + after, scores)
            if c < least - 1e-9:
                best, least = out, c
    if best is None and len(part) >= 6:
        best = next((out for wrong in WRONG if (out := as_torn_utf8(part, wrong)) is not None and cost(before + out + after, scores) < now), None)
    return best


@lru_cache(maxsize=None)
def sequences(encoding: str) -> re.Pattern:
    """UTF-8 sequences of two to four bytes as a wrong encoding shows them."""
    shown: dict[int, str] = {}
    for c, b in backward(encoding).items():
        shown[b] = shown.get(b, "") + re.escape(chr(c))
    some = lambda a, b: "[" + "".join(shown.get(x, "") for x in range(a, b)) + "]"
    rest = some(0x80, 0xC0)
    return re.compile(f"(?:{some(0xC2, 0xE0)}{rest}|{some(0xE0, 0xF0)}{rest}{{2}}|{some(0xF0, 0xF5)}{rest}{{3}})+")


def _part_mapped(part: str, before: str, after: str, scores: Scores) -> str | None:
    """``part`` with only the UTF-8 sequences in it mapped back, where they stand beside rightful signs, or None."""
    best, least = None, cost(before + part + after, scores) + WEAK / 2
    for wrong in WRONG if len(part) > 2 else ():
        out = sequences(wrong).sub(lambda m: as_utf8(m[0], wrong) or m[0], part)  # noqa: B023
        if out == part or any(c.isalpha() or c.isspace() for c in sequences(wrong).sub("", part)):
            continue
        if (c := cost(before + out + after, scores)) < least and lowest(before + out + after, scores) > WEAK:
            best, least = out, c
    return best


@lru_cache(maxsize=None)
def begun(first: str) -> tuple[str, ...]:
    """Latin letters whose UTF-8 form begins with ``first`` in one of the wrong encodings."""
    if ord(first) in NO_EVIDENCE or all(backward(w).get(ord(first)) != 0xC3 for w in WRONG):
        return ()
    return tuple(c for c in map(chr, range(0xC0, 0x100)) if c.isalpha() and c != first)


def _torn(text: str, runs: list[tuple[int, int]], scores: Scores) -> tuple[bool, str]:
    """(found, text): whether a single character is the rest of a torn UTF-8 sequence, by the letters around it.

    One whose second byte, a no-break space, became a blank is restored; others stay, as the lost byte isn't known.
    """
    found, parts, at = False, [], 0
    for s, e in runs:
        first, before = text[s:e], text[max(0, s - 1) : s]
        if e - s > 1 or not before.isalpha():
            continue
        blank = bytes([first_byte, 0xA0]).decode("utf-8", "ignore") if text[e : e + 1] == " " and (first_byte := backward("cp1252").get(ord(first), 0)) >= 0xC2 else ""
        if blank and _spelt(before, first, blank, text[e + 1 : e + 2], scores):
            parts += [text[at:s], blank]
            at, found = e + 1, True
        elif text[e : e + 1].isalpha() and any(_spelt(before, first, c, text[e : e + 1], scores) for c in begun(first)):
            parts += [text[at:s], LOST]
            at, found = e, True
    return found, "".join([*parts, text[at:]])


def _spelt(before: str, now: str, out: str, after: str, scores: Scores) -> bool:
    """Whether all pairs of ``out`` have support, and a single character is more frequent between these letters than now.

    A letter beside another isn't taken for a sign, nor a sign for a letter but between two letters, and a look-alike letter
    isn't put in. A capital or a Greek letter between two small Latin letters needs no such count. Most pairs of a longer run
    must lack support now, as those of a rare word don't.
    """
    if lowest(before + out + after, scores) <= WEAK:
        return False
    if len(out) > 1:
        score = scores.of(code_points(before + now + after))
        return 2 * int((score <= WEAK).sum()) > len(score)
    if ord(out) in NO_EVIDENCE or not (before + after).strip():
        return False
    if out.isalpha() and not now.isalpha() and not (before.isalpha() and after.isalpha()):
        return False
    if now.isalpha() and not out.isalpha() and (before.isalpha() or after.isalpha()):
        return False
    if before.islower() and after.islower() and out.islower() and (now.isupper() or script_of(now) == 2):
        return True  # no word has a capital or a Greek letter between two small Latin ones
    old, new = (sum(scores.letters.get(k, 0) for k in triple_keys(code_points((before or " ") + c + (after or " ")), IN_REPERTOIRE).tolist()) for c in (now, out))
    return new > old and (not old or out.isalpha() or not now.isalpha())


def _byte_mapping(text: str, runs: list[tuple[int, int]], scores: Scores) -> str | None:
    """The text with improbable runs mapped from one one-byte encoding to another, as far as pairs of them explain them.

    If one mapping makes all runs probable, their characters must be two different ones, or three in all, that aren't
    merely look-alike letters, blanks or ignorable characters, or a single sign of which neither pair has support, but
    both of the new one have. Any other run, however few characters it has, may be mapped if all its pairs get support and
    its character is more frequent between these very letters; of several mappings the one that explains most goes first. Characters that
    no one-byte encoding has aren't part of a run.
    """
    runs = [(m.start(), m.end()) for s, e in runs for m in RUN_OF_BYTES.finditer(text, s, e)]
    edge = lambda c: "" if c > "\x7f" else c
    around = [(edge(text[max(0, s - 1) : s]), text[s:e], edge(text[e : e + 1])) for s, e in runs]
    cost_now = [cost("".join(x), scores) for x in around]
    if CYRILLIC_RUN.search(text):  # a Cyrillic letter among Latin ones is a look-alike of such a text, not damage
        mixed = {i for i, (a, x, b) in enumerate(around) if CYRILLIC_RUN.match(x + x) and (a.isalpha() or b.isalpha())}
    else:
        mixed = set()
    done: dict[int, str] = {}
    while len(done) < len(runs):
        rest = [i for i in range(len(runs)) if i not in done and cost_now[i] >= -WEAK]
        chars = [c for i in rest for c in around[i][1] if ord(c) not in NO_EVIDENCE]
        if not chars:
            break
        few = len(chars) < 3 and len(set(chars)) < 2
        now = sum(cost_now[i] for i in rest)
        sign = few and len(chars) == 1 and not chars[0].isalpha() and now >= -2 * WEAK and all(around[i][0] and around[i][2] for i in rest)
        best, most = {}, 0.0
        for wrong in WRONG:
            raws = {i: raw for i in rest if (raw := to_bytes(around[i][1], wrong)) is not None}
            for true in TRUE if raws else ():
                if true == wrong:
                    continue
                table = forward(true)
                outs = {i: "".join(chr(x) if x < 0x80 else table[x - 0x80] for x in raw) for i, raw in raws.items()}
                outs = {i: o for i, o in outs.items() if o != around[i][1]}
                left = {i: cost(around[i][0] + o + around[i][2], scores) for i, o in outs.items()}
                c = sum(left.values())
                if len(outs) < len(rest) or c >= 0.1 * now or few and (c or not sign):
                    outs = {i: o for i, o in outs.items() if wrong not in NAMES and i not in mixed and left[i] < cost_now[i] and any(ord(x) not in NO_EVIDENCE for x in around[i][1]) and _spelt(around[i][0], around[i][1], o, around[i][2], scores)}
                gain = sum(cost_now[i] - left[i] for i in outs)
                if gain > most:
                    best, most = outs, gain
        if not best:
            break
        done |= best
    if not done:
        return None
    parts, at = [], 0
    for i, out in sorted(done.items()):
        parts += [text[at : runs[i][0]], out]
        at = runs[i][1]
    return "".join([*parts, text[at:]])


def _closes(text: str, start: int, end: int) -> bool:
    """Whether the run ends in a closing quote that an opening one before it, outside of any run of damage, waits for."""
    last = text[end - 1]
    if last not in OPEN:
        return False
    return any(text.rfind(o, 0, start) > text.rfind(last, 0, start) for o in OPEN[last])


def _suspects(text: str, scores: Scores) -> list[tuple[int, int]]:
    """The improbable segments, each widened to whole runs of other characters. A blank is put before and after the text."""
    score = scores.of(code_points(f"\n{text}\n"))
    out, at = [], 0
    for first, last in segments(score):
        runs = list(RUN_OF_OTHERS.finditer(text, max(at, first - 1), last))
        if not runs:
            continue
        a, b = runs[0].start(), runs[-1].end()
        while a > at and text[a - 1] > "\x7f":
            a -= 1
        while b < len(text) and text[b] > "\x7f":
            b += 1
        out.append((a, b))
        at = b
    return out


def _wide_mapping(text: str, runs: list[tuple[int, int]], scores: Scores, sure: bool) -> str | None:
    """The text with runs that are a text of two-byte characters read in a one-byte encoding: each pair of bytes must give a
    letter, ``WIDE_RUN`` or more, and no pair of the run may be a probable one. If ``sure``, all pairs of the new run must be."""
    parts, at = [], 0
    for s, e in runs:
        if (e - s) % 2 or e - s < 2 * WIDE_RUN or (scores.of(code_points(text[s:e])) > WEAK).any():
            continue
        made = []
        for wrong in ("cp1252", "mac_roman", "cp437", "cp1251"):
            raw = to_bytes(text[s:e], wrong)
            outs = (raw.decode(true, "replace") for true in WIDE) if raw is not None else ()
            made += [o for o in outs if len(o) == (e - s) // 2 and all(unicodedata.category(c) == "Lo" and c >= "\u3040" for c in o)]
        best = min(made, key=lambda o: cost(o, scores), default=None)
        if best is not None and (not sure or lowest(best, scores) > WEAK):
            parts += [text[at:s], best]
            at = e
    return "".join([*parts, text[at:]]) if parts else None


def repair(text: str, scores: Scores) -> tuple[bool, bool, str]:
    """(damaged, restored, text): whether some of the text was decoded wrongly, and the text with that mapped back."""
    # Replacement characters and stray controls have no support, so they always stand in a segment.
    ruined = lambda: any(LOST in text[a:b] or STRAY.search(text, a, b) for a, b in _suspects(text, scores))
    damaged = lost = ruined()
    lost = lost and LOST in text
    left = lambda: [(m.start(), m.end()) for a, b in _suspects(text, scores) for m in RUN_OF_OTHERS.finditer(text, a, b) if LOST not in m[0] and not _closes(text, a, b)]
    if (out := _wide_mapping(text, left(), scores, sure=True)) is not None:
        text, damaged = out, True
    for _ in range(DEPTH):
        changed, parts, at = False, [], 0
        for a, b in _suspects(text, scores):
            runs = [(m.start(), m.end()) for m in RUN_OF_OTHERS.finditer(text, a, b)]
            for s, e in [(a, b), *runs] if len(runs) > 1 else runs:
                if s < at or _closes(text, s, e) or LOST in text[s:e]:
                    continue
                around = text[s:e], text[max(0, s - 1) : s], text[e : e + 1]
                out = _mapped(*around, scores)
                if out is None and RUN_OF_OTHERS.fullmatch(text[s:e]):
                    out = _part_mapped(*around, scores)
                if out is not None:
                    parts += [text[at:s], out]
                    at, changed = e, True
        if not changed:
            break
        text, damaged = "".join([*parts, text[at:]]), True
    runs = left()
    for way in (_byte_mapping, partial(_wide_mapping, sure=False)):
        if runs and (out := way(text, runs, scores=scores)) is not None:
            text, damaged = out, True
            runs = left()
    if runs:
        torn, out = _torn(text, runs, scores)
        if torn:
            text, damaged = out, True
    return damaged, damaged and not lost and LOST not in text and not STRAY.search(text), text


def restore(df: DataFrame, key: str, column: str, scores: Scores) -> DataFrame:
    """(key, restored, text) of each damaged row: ``restored`` is false if some characters are lost for good.

    Plain texts and texts without an improbable pair are passed over in bulk. Nulls and empty texts aren't damaged.
    """
    shared = df.sparkSession.sparkContext.broadcast(scores)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            ks, oks, outs = [], [], []
            rows = [(k, t) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t and not t.isascii()]
            if rows:
                joined = "\n".join(["", *(t for _, t in rows), ""])
                score = own.of(code_points(joined))
                row = np.repeat(np.arange(len(rows)), [len(t) + 1 for _, t in rows])
                row = np.append(row, len(rows) - 1)[: len(score)]
                # No segment comes to enough where the pairs that add anything don't.
                gain = np.bincount(row, weights=np.maximum(-score - DRAG, 0), minlength=len(rows))
                for i in np.flatnonzero(gain >= ENOUGH).tolist():
                    k, t = rows[i]
                    damaged, ok, out = repair(t, own)
                    if damaged:
                        ks.append(k)
                        oks.append(ok)
                        outs.append(out)
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(oks, pa.bool_()), pa.array(outs, pa.string())], [key, "restored", "text"])

    return df.where(F.col(column).rlike("[^\\x00-\\x7F]")).select(F.col(key).cast("long").alias(key), column).mapInArrow(work, f"`{key}` long, restored boolean, text string")
