"""Tokens and vocabularies of streams. Splitting keeps no state, so a stream takes the same operators as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.operators.rules import DEFAULT, TokenizerRules
from lexiflow.operators.tokenize import tokenize, tokenize_documents
from lexiflow.operators.vocab import extend_vocab


def stream_tokens(stream: DataFrame, key: str, text: str = "text", rules: TokenizerRules = DEFAULT) -> DataFrame:
    """(key, position, text, space_after) of a streaming table."""
    return tokenize(stream, key, text, rules)


def windowed_counts(stream: DataFrame, time: str, text: str = "text", window: str = "1 hour", delay: str = "2 hours", rules: TokenizerRules = DEFAULT) -> DataFrame:
    """(start, end, token, n): how often each token came in each window; rows later than ``delay`` are left out."""
    keyed = stream.where(F.col(time).isNotNull()).withWatermark(time, delay)
    tokens = tokenize_documents(keyed.select(F.col(time).alias("at"), F.col(text).alias("text")), "text", rules)
    words = tokens.select("at", F.explode("tokens.text").alias("token"))
    counts = words.groupBy(F.window("at", window), "token").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "token", "n")


def grow_vocab(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of a token stream: the vocabulary at ``path`` grows by each batch's new tokens.

    Every batch writes a version of its own, so a batch that is repeated after a failure writes the same version again.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            known = spark.read.parquet(f"{path}/version={number - 1}")
        else:
            known = spark.createDataFrame([], "token string, id long")
        extend_vocab(known, batch, [key, "position"]).write.mode("overwrite").parquet(f"{path}/version={number}")

    return step
