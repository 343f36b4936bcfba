"""Encoding with a public byte-level BPE tokenizer in batched numpy.

A batch of texts is one flat array of code points. Classes of characters (letter, number, white space, other) are looked
up in a table, the borders of the pre-tokens follow from a few vector operations, and each pre-token gets two 64-bit
polynomial hashes of its characters; they are known by the first, and told apart by the second where the first is the same. Distinct pre-tokens that this worker hasn't met are encoded together: the symbols of
all of them lie in one flat array; a round looks up every adjacent pair by binary search over the sorted pair keys,
finds each word's lowest rank and merges it wherever it occurs, until no pair of any word has a rank. The ids of all
pre-tokens are then gathered from the store of known ones. No Python loop runs over characters or tokens.

Results: special tokens are never added, and a marker that stands in a text is ordinary text. A null or an empty text
has an empty list of ids. Texts may be of any length; they are worked on in pieces of ``PIECE`` characters at most unless
a single text is longer. The file of the tokenizer is a parameter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_FILE = "/opt/tokenizers/byte_bpe_50k.json"
LETTER, NUMBER, SPACE, OTHER, BORDER = range(5)
#: Characters worked on at once, and known pre-tokens kept by a worker; neither changes a result.
PIECE, KNOWN = 1 << 20, 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: The endings that the public pattern splits off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
NO_RANK = np.int64(1 << 40)


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point: \\p{L}, \\p{N}, White_Space, anything else. The last code point marks a border."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for pattern, cls in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = cls
    out[0x10FFFF] = BORDER
    return out


@lru_cache(maxsize=2)
def _mixed(which: int) -> np.ndarray:
    """Two different numbers for each code point."""
    with np.errstate(over="ignore"):
        x = (np.arange(0x110000, dtype=np.uint64) + np.uint64(1 + which * 0x51ED270B)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(27)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE)])), np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, INVERSE)]))


def pre_token_starts(cp: np.ndarray) -> np.ndarray:
    """Start of each pre-token; ``cp`` must end with a border, and borders are pre-tokens of their own."""
    cls = character_classes()[cp]
    runs = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
    kind, end = cls[runs], np.concatenate([runs[1:], [len(cp)]])
    start = np.zeros(len(cp) + 1, dtype=bool)
    start[runs] = True
    borders = np.flatnonzero(cls == BORDER)
    start[borders] = True
    # White space before something else keeps all but its last character, and a plain blank goes to what follows.
    led = np.flatnonzero(kind[:-1] == SPACE)
    led = led[kind[led + 1] != BORDER]
    last = end[led] - 1
    start[last] = True
    blank = cp[last] == 0x20
    start[end[led[blank]]] = False
    # A lone apostrophe that begins a pre-token takes one of the known endings from the letters after it.
    lone = np.flatnonzero((kind[:-1] == OTHER) & (end[:-1] - runs[:-1] == 1) & (cp[runs[:-1]] == 0x27) & (kind[1:] == LETTER))
    lone = lone[start[runs[lone]]]
    a, size = runs[lone], end[lone + 1] - end[lone]
    c1, c2 = cp[a + 1], cp[np.minimum(a + 2, len(cp) - 1)]
    take = np.zeros(len(a), dtype=np.int64)
    for e in ENDINGS:
        hit = (c1 == ord(e[0])) & (size >= len(e)) & ((c2 == ord(e[1])) if len(e) > 1 else True) & (take == 0)
        take[hit] = len(e)
    a, take = a[take > 0], take[take > 0]
    start[a + 1] = False
    start[a + 1 + take] = True
    return np.flatnonzero(start[:-1])


class Encoder:
    """The merges of a tokenizer file, and the pre-tokens this worker has met."""

    def __init__(self, file: str = DEFAULT_FILE):
        with open(file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], model["merges"]
        # The public byte alphabet: printable bytes stand for themselves, the others follow from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in {*shown}]
        alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.bytes = np.array([vocab[alphabet[b]] for b in range(256)], dtype=np.int64)
        split = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in split] + [1 << 60], dtype=np.int64)  # the last is no pair
        order = np.argsort(keys)
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), np.array([vocab[a + b] for a, b in split] + [0], dtype=np.int64)
        self.known: dict[int, int] = {}
        self.at, self.size, self.ids, self.second = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has; no word may be empty."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        sym = self.bytes[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_owner = [], []
        while len(sym):
            key = sym[:-1] << 20 | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], NO_RANK)
            rank = np.append(rank, NO_RANK)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(sym)))
            best = np.repeat(least, count)
            open_ = best < NO_RANK
            done_sym.append(sym[~open_])
            done_owner.append(owner[~open_])
            hit = open_ & (rank == best)
            # In a run of equal symbols the hits overlap: every other one counts, from the left.
            at = np.flatnonzero(hit)
            if len(at):
                fresh = np.concatenate([[True], np.diff(at) > 1])
                begin = at[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
                at = at[(at - begin) % 2 == 0]
            sym = sym.copy()
            sym[at] = self.merged[rank[at]]
            keep = open_
            keep[at + 1] = False
            sym, owner = sym[keep], owner[keep]
        sym, owner = np.concatenate(done_sym or [sym]), np.concatenate(done_owner or [owner])
        order = np.argsort(owner, kind="stable")
        return sym[order].astype(np.int32), np.bincount(owner, minlength=len(words))

    def _learn(self, hashes: list[int], second: np.ndarray, words: list[bytes]) -> None:
        ids, sizes = self.words(words)
        base = len(self.at)
        self.second = np.concatenate([self.second, second])
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, ids])
        self.known.update(zip(hashes, range(base, base + len(hashes)), strict=True))

    def _piece(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the known pre-token, text) of each pre-token of some non-empty texts."""
        import pandas as pd

        joined = "\U0010ffff".join([*texts, ""])
        raw = cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        limits = np.cumsum(lengths + 1) - 1
        if cp.max(initial=0) == 0x10FFFF and np.count_nonzero(cp == 0x10FFFF) != len(texts):  # the border stands in a text
            own = np.ones(len(cp), dtype=bool)
            own[limits] = False
            cp = np.where(own & (cp == 0x10FFFF), np.uint32(0x10FFFE), cp)
        start = pre_token_starts(cp)
        end = np.append(start[1:], len(cp))
        inside = cp[start] != 0x10FFFF
        start, end = start[inside], end[inside]
        with np.errstate(over="ignore"):
            power, back = powers(len(cp))
            def hashes(which: int) -> np.ndarray:
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(which)[raw] * power[:-1], dtype=np.uint64)])
                return (sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)

            h, other = hashes(0), hashes(1)
            while True:
                codes, distinct = pd.factorize(h)
                if len(self.known) + len(distinct) > KNOWN:
                    self.known, self.at, self.size, self.ids, self.second = {}, self.at[:0], self.size[:0], self.ids[:0], self.second[:0]
                names = distinct.tolist()
                first = np.empty(len(names), dtype=np.int64)
                first[codes[::-1]] = np.arange(len(codes))[::-1]
                found = np.fromiter((self.known.get(x, -1) for x in names), np.int64, len(names))
                met = np.flatnonzero(found >= 0)
                taken = np.zeros(len(names), dtype=bool)
                taken[met] = self.second[found[met]] != other[first[met]]
                clash = (other != other[first][codes]) | taken[codes]
                if not clash.any():
                    break
                h = np.where(clash, h * BASE + other, h)  # the same first hash for different characters: another one
        new = np.flatnonzero(found < 0)
        if len(new):
            where = first[new]
            self._learn([names[i] for i in new.tolist()], other[where], [joined[s:e].encode("utf-8", "surrogatepass") for s, e in zip(start[where].tolist(), end[where].tolist(), strict=True)])
        index = np.array([self.known[x] for x in names], dtype=np.int64)[codes] if names else np.zeros(0, np.int64)
        return index, np.searchsorted(limits, start)

    def batch(self, texts: list[str | None], ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """Ids of all texts, one after the other (None if not asked for), and how many each text has."""
        counts = np.zeros(len(texts), dtype=np.int64)
        parts, i = [], 0
        some = [k for k, t in enumerate(texts) if t]
        while i < len(some):
            j, n = i, 0
            while j < len(some) and (j == i or n + len(texts[some[j]]) <= PIECE):
                n += len(texts[some[j]]) + 1
                j += 1
            index, text = self._piece([texts[k] for k in some[i:j]])
            size = self.size[index]
            counts[some[i:j]] = np.bincount(text, weights=size, minlength=j - i).astype(np.int64)
            if ids:
                ends = np.cumsum(size)
                parts.append(self.ids[np.repeat(self.at[index] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)])
            i = j
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)) if ids else None, counts


@lru_cache(maxsize=2)
def encoder(file: str) -> Encoder:
    return Encoder(file)


def encode(df: DataFrame, key: str, column: str, file: str = DEFAULT_FILE) -> DataFrame:
    """(key, ids): the ids of each row's text, in the rows' partitions: no shuffle. Every row comes out, as often as it came in."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(file)
        for batch in batches:
            ids, counts = own.batch(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))], [key, "ids"])

    src = df.select(F.col(key).cast("long").alias(key), F.col(column).cast("string").alias("text"))
    return src.mapInArrow(work, f"`{key}` long, ids array<int>")


def token_counts(df: DataFrame, key: str, column: str, file: str = DEFAULT_FILE) -> DataFrame:
    """(key, tokens): how many ids each row's text has; 0 for nulls and empty texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.batch(batch.column(1).to_pylist(), ids=False)[1])], [key, "tokens"])

    src = df.select(F.col(key).cast("long").alias(key), F.col(column).cast("string").alias("text"))
    return src.mapInArrow(work, f"`{key}` long, tokens long")
