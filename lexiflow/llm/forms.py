"""Keys of texts that are the same but for look, letter case, white space and signs, for whole batches at once.

The *folded* form of a text is its skeleton (see ``lookalike``) in one letter case. Case and look are closed together: В
looks like B and is the capital of в, so b, B, В and в fold to the same letter. Two letters of other scripts would join two
letters that differ in one script this way (Ν and ν look like N and v; һ looks like h, as Н does); texts with Greek letters
or with һ therefore go through the look-alike search first, which finds out what script such a letter belongs to, and are
folded then. The search needs no corpus here, as it is the script of the word and of the text that decides.

The *letters* of a text are its folded letters and digits alone, one after the other. Its *words* are runs of them; signs
inside a word (an apostrophe between letters, a point or a comma between digits) don't cut it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache
from hashlib import blake2b

import numpy as np

from lexiflow.llm.lookalike import ALONE, ALPHABETS, BORDER, GONE, LOOKED_AT, Lattice, script_of, skeleton, skeleton_table

#: Letters that a capital look-alike of another letter would join to a different letter of their script.
HELD = "νһҺ"
#: What the look-alike letters fold to, in small letters.
FOLDED = {ord(v.casefold()): k.casefold() for alphabet in ALPHABETS for k, v in alphabet.items() if v.casefold() not in HELD and len(v.casefold()) == 1}
BLANK = 0x20
#: Characters that don't cut a word between two letters, and between two digits.
IN_LETTERS, IN_DIGITS = "'’ʼ‘`´", ".,’'"


@lru_cache(maxsize=1)
def search() -> Lattice:
    return Lattice([])


def _close(text: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.casefold()).translate(FOLDED))


def folded(text: str) -> str:
    """The folded form of one text."""
    return _close(search().text(text) if any(script_of(c) == 2 or c in HELD for c in text) else skeleton(text))


@lru_cache(maxsize=1)
def folded_table() -> np.ndarray:
    """For each code point the one it folds to, GONE, or ALONE."""
    out = skeleton_table().copy()
    for cp in [*range(0x80), *LOOKED_AT]:
        if out[cp] in (GONE, ALONE):
            continue
        if script_of(chr(cp)) == 2 or chr(cp) in HELD:
            out[cp] = ALONE
            continue
        made = _close(chr(out[cp]))
        out[cp] = ord(made) if len(made) == 1 else ALONE
    out[BORDER] = BORDER
    return out


def _where(test: Callable[[str], bool]) -> np.ndarray:
    """What ``test`` says of each code point; planes 4 to 13 have no characters, and 15 and 16 only private ones."""
    out = np.zeros(0x110000, dtype=bool)
    for cp in (range(0x40000), range(0xE0000, 0xF0000)):
        out[cp.start : cp.stop] = np.fromiter(map(test, map(chr, cp)), bool, len(cp))
    return out


@lru_cache(maxsize=1)
def letters_table() -> np.ndarray:
    """Whether a code point is a letter or a digit."""
    return _where(str.isalnum)


@lru_cache(maxsize=1)
def digits_table() -> np.ndarray:
    return _where(str.isdigit)


@lru_cache(maxsize=1)
def _inner() -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((2, 0x110000), dtype=bool)
    out[0, [*map(ord, IN_LETTERS)]] = True
    out[1, [*map(ord, IN_DIGITS)]] = True
    return out[0], out[1]


class Folded:
    """Folded forms of a batch: ``cp`` has the code points of all rows, each row with a border before and after it.

    ``row[i]`` is the place in the batch of the i-th row, and its code points are ``cp[start[i]:end[i]]``.
    """

    def __init__(self, texts: list[str]):
        whole = chr(BORDER).join(["", *texts, ""]).replace("ß", "ss")
        if whole.count(chr(BORDER)) != len(texts) + 1:  # the border stands in a text, where it is no letter
            texts = [t.replace(chr(BORDER), " ") for t in texts]
            whole = chr(BORDER).join(["", *texts, ""]).replace("ß", "ss")
        cp = folded_table()[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        ends = np.flatnonzero(cp == BORDER)
        alone = np.unique(np.searchsorted(ends, np.flatnonzero(cp == ALONE))) - 1
        keep = cp != GONE
        row = np.arange(len(texts))
        if len(alone):
            slow = np.zeros(len(texts), dtype=bool)
            slow[alone] = True
            keep &= ~np.append(False, np.repeat(slow, np.diff(ends)))
            more = chr(BORDER).join([*(folded(texts[i]) for i in alone.tolist()), ""])
            cp = np.concatenate([cp[keep], np.frombuffer(more.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)])
            row = np.concatenate([row[~slow], row[slow]])
        else:
            cp = cp[keep]
        borders = np.flatnonzero(cp == BORDER)
        self.cp, self.row, self.start, self.end = cp, row, borders[:-1] + 1, borders[1:]
        self.letter = letters_table()[cp]
        self.filled = np.concatenate([[0], np.cumsum(self.letter)])

    def runs(self) -> np.ndarray:
        """Unbroken runs of letters or digits of each row."""
        first = self.letter.copy()
        first[1:] &= ~self.letter[:-1]
        count = np.concatenate([[0], np.cumsum(first)])
        return count[self.end] - count[self.start]

    def text(self, i: int) -> str:
        return self.cp[self.start[i] : self.end[i]].tobytes().decode("utf-32-le", "surrogatepass")

    def letters(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Letters of all rows in four bytes each, and the first and last + 1 byte of each row."""
        return self.cp[self.letter].tobytes(), 4 * self.filled[self.start], 4 * self.filled[self.end]

    def words(self) -> list[str]:
        """The words of each row, joined by one blank."""
        cp, letter = self.cp, self.letter
        inner, numeric = _inner()
        digit = digits_table()[cp]
        joint = np.zeros(len(cp), dtype=bool)
        both = letter[:-2] & letter[2:]
        joint[1:-1] = both & (inner[cp[1:-1]] & ~digit[:-2] & ~digit[2:] | numeric[cp[1:-1]] & digit[:-2] & digit[2:])
        keep, cp, letter = ~joint, cp[~joint], letter[~joint]
        border = cp == BORDER
        shown = letter | border
        shown[1:] |= ~letter[1:] & letter[:-1]  # the first sign after a word becomes a blank
        out = np.where(letter | border, cp, np.uint32(BLANK))[shown].tobytes().decode("utf-32-le", "surrogatepass")
        return [t.strip(" ") for t in out.split(chr(BORDER))[1:-1]]


def digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()
