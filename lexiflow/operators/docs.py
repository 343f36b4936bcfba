"""Views of documents whose tokens are an array of structs with ``text`` and ``space_after``: index, slice, text, attributes.

Indexes follow Python: negative ones count from the end. What is out of range is null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_at(tokens: Column, index: int) -> Column:
    """The token at an index; null if there is none."""
    return F.try_element_at(tokens, F.lit(index + 1 if index >= 0 else index))


def normalize_slice(length: Column, start: int | None = None, stop: int | None = None, step: int | None = None) -> tuple[Column, Column]:
    """(start, stop) within 0..length for a Python slice; only a step of 1 is supported."""
    if step not in (None, 1):
        raise ValueError("only a step of 1 is supported")

    def placed(bound: int) -> Column:
        return length + bound if bound < 0 else F.lit(bound)

    low = F.lit(0) if start is None else F.least(length, F.greatest(F.lit(0), placed(start)))
    high = length if stop is None else F.least(length, F.greatest(low, placed(stop)))
    return low, high


def span(tokens: Column, start: int | None = None, stop: int | None = None, step: int | None = None) -> Column:
    """The tokens of a slice as a document of their own (empty if the slice is)."""
    low, high = normalize_slice(F.size(tokens), start, stop, step)
    return F.when(tokens.isNotNull(), F.slice(tokens, low + 1, high - low))


def span_of_span(tokens: Column, outer: tuple[int | None, int | None], inner: tuple[int | None, int | None]) -> Column:
    """A slice of a slice."""
    return span(span(tokens, *outer), *inner)


def span_token(tokens: Column, start: int, stop: int, index: int) -> Column:
    """Token of the span ``start:stop`` by an index that counts from its start, or from its end if negative. It isn't held
    against the span's borders, so it may lie in the document around it."""
    low, high = normalize_slice(F.size(tokens), start, stop)
    at = low + index if index >= 0 else high + index
    return F.when((at >= 0) & (at < F.size(tokens)), F.try_element_at(tokens, at + 1))


def text_with_ws(token: Column) -> Column:
    return F.concat(token.getField("text"), F.when(token.getField("space_after"), " ").otherwise(""))


def doc_text(tokens: Column) -> Column:
    """The text that the tokens make: a blank after each one that has ``space_after``."""
    return F.array_join(F.transform(tokens, text_with_ws), "")


def token_repr(token: Column) -> Column:
    return F.concat(F.lit("Token["), token.getField("text"), F.lit("]"))


def token_length(token: Column) -> Column:
    """Characters of the token with its blank."""
    return F.length(text_with_ws(token))


def doc_length(tokens: Column) -> Column:
    return F.size(tokens)


def set_attribute(attributes: Column, name: str, values: list[str]) -> Column:
    """A map of attributes with ``name`` set; a null map is an empty one."""
    own = F.create_map(F.lit(name), F.array(*map(F.lit, values)).cast("array<string>"))
    rest = F.map_filter(F.coalesce(attributes, F.expr("cast(map() as map<string,array<string>>)")), lambda k, _: k != name)
    return F.map_concat(rest, own)


def attribute(attributes: Column, name: str) -> Column:
    """The values of an attribute; null if it isn't set."""
    return F.try_element_at(attributes, F.lit(name))


def assemble(tokens: DataFrame, key: str) -> DataFrame:
    """(key, tokens): token rows (key, position, text, space_after) as one array a document, in order."""
    packed = F.sort_array(F.collect_list(F.struct("position", "text", "space_after")))
    return tokens.groupBy(key).agg(packed.alias("_t")).select(key, F.transform("_t", lambda t: F.struct(t["text"].alias("text"), t["space_after"].alias("space_after"))).alias("tokens"))
