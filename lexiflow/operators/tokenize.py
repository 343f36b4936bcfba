"""Rule-based tokens of whole texts, in one Arrow pass without any shuffle.

Splitting depends on the word alone, so every Python worker keeps the tokens of the words it has met, and a word costs one
dictionary lookup from the second time on. The tokens stay with their document; rows of single tokens come from a native
``posexplode``. The same functions take streams.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.functions.chars import PYTHON_SPACE
from lexiflow.operators.rules import DEFAULT, TokenizerRules

SEGMENT = re.compile(f"[^{PYTHON_SPACE}]+[{PYTHON_SPACE}]?|[{PYTHON_SPACE}]+")
TOKENS = "array<struct<text:string,space_after:boolean>>"
#: Words that a worker keeps; more only start it anew.
KEPT = 500_000


class Splitter:
    """The tokens of texts under some rules, with what is known of single words."""

    def __init__(self, rules: TokenizerRules):
        self.rules, self.known = rules, {}

    def segment(self, part: str) -> tuple[list[str], list[bool]]:
        """Tokens of one segment. A word that yields none hands its blank on: ([], [whether it had one])."""
        if part[0].isspace():
            return [part], [False]
        spaced = part[-1].isspace()
        pieces = self.rules.split(part[:-1] if spaced else part)
        return pieces, [False] * (len(pieces) - 1) + [spaced]

    def text(self, text: str) -> tuple[list[str], list[bool]]:
        known, words, flags = self.known, [], []
        parts = SEGMENT.findall(text)
        for part in parts:
            found = known.get(part)
            if found is None:
                if len(known) >= KEPT:
                    known.clear()
                found = known[part] = self.segment(part)
            if found[0]:
                words += found[0]
                flags += found[1]
            elif flags:
                flags[-1] = found[1][0]
        if parts and parts[-1][0].isspace():
            flags[-1] = True
        return words, flags


@lru_cache(maxsize=8)
def _shared(rules: TokenizerRules, exceptions: tuple | None) -> Splitter:
    return Splitter(rules)


def splitter(rules: TokenizerRules) -> Splitter:
    """One splitter a worker for equal rules."""
    return _shared(rules, None if rules.exceptions is None else tuple(sorted(rules.exceptions.items())))


def tokenize_documents(df: DataFrame, text: str = "text", rules: TokenizerRules = DEFAULT, out: str = "tokens") -> DataFrame:
    """``df`` with the array of tokens of ``text`` in ``out``; null for null, empty for an empty text."""

    @F.arrow_udf(TOKENS)
    def tokens(texts: pa.Array) -> pa.Array:
        own = splitter(rules)
        words, flags, ends, null = [], [], [0], []
        for t in texts.to_pylist():
            null.append(t is None)
            if t:
                w, f = own.text(t)
                words += w
                flags += f
            ends.append(len(words))
        items = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(flags, pa.bool_())], ["text", "space_after"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, mask=pa.array(null))

    return df.withColumn(out, tokens(F.col(text)))


def token_rows(df: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """(key, position, text, space_after), one row for each token of the array."""
    return df.select(key, F.posexplode(tokens).alias("position", "token")).select(key, F.col("position").cast("long").alias("position"), F.col("token.text").alias("text"), F.col("token.space_after").alias("space_after"))


def tokenize(df: DataFrame, key: str, text: str = "text", rules: TokenizerRules = DEFAULT) -> DataFrame:
    """(key, position, text, space_after) of every token. Nulls and empty texts have no rows.

    >>> tokenize(documents, "doc_id", rules=TokenizerRules(infixes=["~"]))

    Positions are dense from 0 in each row of ``df``. What ``TokenizerRules.infix_gaps`` = "drop" leaves out of a word is
    left out here too; a word of which nothing is left overwrites the blank of the token before it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = splitter(rules)
        for batch in batches:
            words, flags, counts = [], [], []
            for t in batch.column(1).to_pylist():
                w, f = own.text(t) if t else ([], [])
                words += w
                flags += f
                counts.append(len(w))
            n = np.array(counts, dtype=np.int64)
            row = np.repeat(np.arange(len(n)), n)
            position = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(position, pa.int64()), pa.array(words, pa.string()), pa.array(flags, pa.bool_())], [key, "position", "text", "space_after"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string").alias("text")).mapInArrow(work, f"`{key}` {kind}, position long, text string, space_after boolean")


def space_tokenize(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, position, text): pieces between single blanks."""
    from lexiflow.operators.segment import space_split

    return df.select(key, F.posexplode(space_split(F.col(text))).alias("position", "text")).withColumn("position", F.col("position").cast("long"))
