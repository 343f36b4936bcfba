"""One row for each entry of a vocabulary: derived strings, their ids in the string store, the flag word, the vector."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.functions import lexattrs as L
from lexiflow.operators.ordering import with_dense_number

DERIVED = {"lower": L.lower, "shape": L.word_shape, "prefix": L.prefix, "suffix": L.suffix}


def lexemes(vocab: DataFrame, lang: str = "en", stops: Iterable[str] = ()) -> DataFrame:
    """(id, orth, lower, norm, shape, prefix, suffix, lang, length, flags) of each (token, id) of the vocabulary."""
    s = F.col("token")
    return vocab.select("id", s.alias("orth"), *(f(s).alias(n) for n, f in DERIVED.items()), L.norm(s).alias("norm"), F.lit(lang).alias("lang"), L.length(s).cast("long").alias("length"), L.flag_word(s, stops).alias("flags"))


def string_store(vocab: DataFrame, lexeme_rows: DataFrame) -> DataFrame:
    """(token, id): the vocabulary and, after its ids, the derived strings that it lacks, in the order of their characters."""
    strings = lexeme_rows.select(F.explode(F.array(*DERIVED, "lang")).alias("token")).where("token is not null").distinct()
    new = with_dense_number(strings.join(vocab.select("token"), "token", "left_anti"), ["token"], "id")
    size = vocab.agg(F.coalesce(F.max("id") + 1, F.lit(0))).scalar()
    return vocab.select("token", "id").unionByName(new.select("token", (F.col("id") + size).cast("long").alias("id")))


def lexeme_ids(lexeme_rows: DataFrame, store: DataFrame) -> DataFrame:
    """(rank, lower, shape, prefix, suffix, lang, length, flags) with ids of the store in place of strings.

    The strings of all columns are looked up in one join, so the store is shuffled once.
    """
    columns = [*DERIVED, "lang"]
    long = lexeme_rows.select("id", F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns))).alias("what", "token"))
    found = long.join(store.select("token", F.col("id").alias("string_id")), "token", "left").groupBy("id").pivot("what", columns).agg(F.first("string_id"))
    return lexeme_rows.select("id", "length", "flags").join(found, "id").select(F.col("id").alias("rank"), *columns, "length", "flags")


def out_of_vocabulary(tokens: DataFrame, vocab: DataFrame, token: str = "text") -> DataFrame:
    """The rows whose token the vocabulary lacks."""
    return tokens.join(vocab.select(F.col("token").alias(token)), token, "left_anti")


def without_stops(tokens: DataFrame, stops: DataFrame, token: str = "text", word: str = "word") -> DataFrame:
    """The rows whose token in lower case isn't in the table of stop words; rows with a null token stay."""
    return tokens.join(stops.select(F.lower(F.col(word)).alias("_stop")).distinct(), F.lower(F.col(token)) == F.col("_stop"), "left_anti")


def vector_norm(vector: Column) -> Column:
    """Euclidean length of an array; null for null, 0 for an empty one."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def with_vectors(lexeme_rows: DataFrame, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Lexemes with ``vector``, ``has_vector`` and ``vector_norm``; the vectors' key is the lexeme's id."""
    found = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    return lexeme_rows.join(found, "id", "left").withColumns({"has_vector": F.col("vector").isNotNull(), "vector_norm": vector_norm(F.col("vector"))})
