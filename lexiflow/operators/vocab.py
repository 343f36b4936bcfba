"""Vocabularies and encoding.

A vocabulary is a table (token, id, n): ids are dense from 0 in the order of first occurrence, n counts occurrences. It
always grows: there is no unknown or padding id, case counts, white-space tokens are tokens. It goes in and comes out
explicitly, so ids don't depend on the order of calls but on the vocabularies handed over.

Tokens may be rows (key, position, text) or stay with their document as an array of strings or of structs with ``text``;
arrays are counted and encoded where the document is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.operators.ordering import with_dense_number
from lexiflow.plans.lineage import cut
from lexiflow.plans.skew import lookup

#: A vocabulary of so many tokens or fewer (counted, not guessed) is looked up in memory, a larger one in a shuffle.
SMALL = 500_000


def first_seen(tokens: DataFrame, order: list[str], token: str = "text") -> DataFrame:
    """(token, first, n) of each distinct non-null token; pre-aggregated where the tokens are."""
    return tokens.where(F.col(token).isNotNull()).groupBy(F.col(token).alias("token")).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n"))


def first_seen_in_arrays(docs: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """The same of arrays of strings; each batch of documents gives a row for each of its distinct tokens."""
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = pc.sort_indices(batch.column(0))
            keys, lists = batch.column(0).take(order), batch.column(1).take(order)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            code = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            position = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            n = np.bincount(code, minlength=len(coded.dictionary) + 1)[: len(coded.dictionary)]
            first = np.zeros(len(coded.dictionary) + 1, dtype=np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]  # the last one written is the first one in the batch
            at = first[: len(coded.dictionary)]
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), keys.take(pa.array(row[at])), pa.array(position[at]), pa.array(n, pa.int64())], ["token", "k", "position", "n"])

    src = docs.where(F.col(key).isNotNull()).select(key, tokens)
    made = src.mapInArrow(count, f"token string, k {kind}, position long, n long")
    return made.groupBy("token").agg(F.min(F.struct(F.col("k").alias(key), "position")).alias("first"), F.sum("n").alias("n"))


def _numbered(seen: DataFrame) -> DataFrame:
    return with_dense_number(seen, ["first", "token"], "id").select("token", "id", "n")


def build_vocab(tokens: DataFrame, order: list[str], token: str = "text") -> DataFrame:
    """(token, id, n) over all rows of ``tokens``; ``order`` is the order of the stream, such as document and position."""
    return _numbered(first_seen(tokens, order, token))


def build_vocab_of_arrays(docs: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """The same of documents with arrays of strings, in the order of ``key``."""
    return _numbered(first_seen_in_arrays(docs, key, tokens))


def extend_vocab(vocab: DataFrame, tokens: DataFrame, order: list[str], token: str = "text") -> DataFrame:
    """(token, id, n): ``vocab`` with the tokens it lacks. Known ids stay, new ones go on from the largest in order of first
    occurrence. Occurrences are added up; a vocabulary that doesn't know them starts from 0."""
    seen = cut(first_seen(tokens, order, token))
    counted = F.col("n") if "n" in vocab.columns else F.lit(0)
    known = vocab.select("token", "id", counted.cast("long").alias("old")).join(seen.select("token", F.col("n").alias("more")), "token", "left")
    known = known.select("token", "id", (F.col("old") + F.coalesce("more", F.lit(0))).alias("n"))
    fresh = with_dense_number(seen.join(vocab.select("token"), "token", "left_anti"), ["first", "token"], "id")
    size = vocab.agg(F.coalesce(F.max("id") + 1, F.lit(0))).scalar()
    return known.unionByName(fresh.select("token", (F.col("id") + size).cast("long").alias("id"), "n"))


def encode(tokens: DataFrame, vocab: DataFrame, token: str = "text", out: str = "token_id", small: int = SMALL) -> DataFrame:
    """``tokens`` with the id of each one; tokens that the vocabulary lacks have no id (null).

    A vocabulary of ``small`` tokens or fewer is broadcast, and the tokens stay where they are. Beyond that they meet their
    ids in a shuffle that spreads hot tokens, by the vocabulary's counts or, if it has none, by those of ``tokens``.
    """
    tokens = tokens.drop(out)
    ids = cut(vocab.select(F.col("token").alias("_token"), F.col("id").cast("long").alias(out), *([F.col("n").alias("_n")] if "n" in vocab.columns else [])))
    if ids.count() <= small:
        return tokens.join(F.broadcast(ids.drop("_n")), F.col(token) == F.col("_token"), "left").drop("_token")
    if "_n" not in ids.columns:
        ids = ids.join(tokens.groupBy(F.col(token).alias("_token")).agg(F.count("*").alias("_n")), "_token")
    return lookup(tokens.withColumn("_token", F.col(token)), ids, ["_token"], "_n", how="left").drop("_token", "_n")


def encode_arrays(docs: DataFrame, vocab: DataFrame, tokens: str = "tokens", key: str = "doc_id", out: str = "ids", small: int = SMALL) -> DataFrame:
    """(key, ids): the ids of each document's array of strings, null for a token that the vocabulary lacks.

    A vocabulary of ``small`` tokens or fewer goes to the documents. Beyond that the tokens go to the vocabulary as rows and
    come back to their document.
    """
    ids = cut(vocab)
    kind = docs.schema[key].dataType.simpleString()
    if ids.count() > small:
        rows = docs.select(key, F.posexplode_outer(tokens).alias("position", "text"))
        return documents_of(encode(rows, ids, small=small), key).withColumnRenamed("token_ids", out)
    known = ids.select("token", F.col("id").cast("long").alias("id")).toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((known.column("token").combine_chunks(), known.column("id").to_numpy()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, numbers = shared.value
        numbers = np.append(numbers, 0)
        for batch in batches:
            lists = batch.column(1)
            at = pc.index_in(lists.flatten(), value_set=names.cast(lists.type.value_type), skip_nulls=True)
            none = at.is_null().to_numpy(zero_copy_only=False)
            made = pa.array(numbers[at.fill_null(len(numbers) - 1).to_numpy(zero_copy_only=False)], pa.int64(), mask=none)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), made, mask=lists.is_null())], [key, out])

    return docs.select(key, tokens).mapInArrow(work, f"`{key}` {kind}, `{out}` array<bigint>")


def decode(encoded: DataFrame, vocab: DataFrame, token_id: str = "token_id", out: str = "token", small: int = SMALL) -> DataFrame:
    """``encoded`` with the token of each id (null for an id that the vocabulary lacks); planned as ``encode`` is."""
    names = cut(vocab.where("id is not null").select(F.col("id").cast("long").alias("_id"), F.col("token").alias(out)))
    if names.count() <= small:
        return encoded.join(F.broadcast(names), F.col(token_id) == F.col("_id"), "left").drop("_id")
    counted = names.join(encoded.groupBy(F.col(token_id).cast("long").alias("_id")).agg(F.count("*").alias("_n")), "_id")
    return lookup(encoded.withColumn("_id", F.col(token_id).cast("long")), counted, ["_id"], "_n", how="left").drop("_id", "_n")


def documents_of(encoded: DataFrame, key: str, position: str = "position", token_id: str = "token_id") -> DataFrame:
    """(key, token_ids): the ids of each document in order; null for a token without an id."""
    packed = F.sort_array(F.collect_list(F.when(F.col(position).isNotNull(), F.struct(position, token_id))))
    return encoded.groupBy(key).agg(packed.alias("_ids")).select(key, F.col("_ids").getField(token_id).alias("token_ids"))


class SentenceEncoder:
    """Tokenize and encode tables one after the other with a vocabulary that grows from call to call.

    ``encode(df)`` gives (key, position, text, space_after, token_id) and leaves the grown vocabulary in ``vocab``.
    """

    def __init__(self, tokenizer, vocab: DataFrame | None = None):
        self.tokenizer, self.vocab = tokenizer, vocab

    @property
    def has_vocab(self) -> bool:
        return self.vocab is not None

    def create_vocab(self, df: DataFrame, key: str) -> DataFrame:
        self.vocab = cut(build_vocab(self.tokenizer(df), [key, "position"]))
        return self.vocab

    def encode(self, df: DataFrame, key: str) -> DataFrame:
        tokens = self.tokenizer(df)
        if self.has_vocab:
            self.vocab = cut(extend_vocab(self.vocab, tokens, [key, "position"]))
        else:
            self.create_vocab(df, key)
        return encode(tokens, self.vocab)
