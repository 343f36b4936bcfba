"""Queries of the training-data operators over the driver's tables, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm import bpe, lookalike, mojibake, multiset, overlap, packing, reading, termfreq
from lexiflow.llm.common import records, table
from lexiflow.llm.oracle import oracle_sql


def _lattice(spark: SparkSession, sf_dir: str, also: DataFrame | None = None) -> lookalike.Lattice:
    texts = table(spark, sf_dir, "text_docs").select("text")
    return lookalike.train(texts if also is None else texts.unionByName(also))


def _split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = overlap.split_paths(table(spark, sf_dir, "dataset_metas"))
    docs = table(spark, sf_dir, "text_docs").select("td_id", "data_path", "text")
    return docs.join(paths.select("data_path", "split").distinct(), "data_path")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training and an evaluation record whose texts are the same or almost the same."""
    members, links = overlap.overlaps(_split_records(spark, sf_dir), "td_id", "text", "split")
    return overlap.overlap_pairs(members, links).select(F.col("a").alias("td_id_a"), F.col("b").alias("td_id_b"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping evaluation records by split and data-set tag: all, exact and near ones, and the links they have."""
    members, links = overlap.overlaps(_split_records(spark, sf_dir), "td_id", "text", "split")
    found = overlap.overlap_records(members, links).select(F.col("k").alias("td_id"), F.col("side").alias("split"), "links", "edits")
    where = table(spark, sf_dir, "text_docs").select("td_id", "data_path").distinct()
    paths = overlap.split_paths(table(spark, sf_dir, "dataset_metas"))
    return (
        found.join(where, "td_id").join(paths, ["data_path", "split"]).groupBy("split", "tag")
        .agg(F.countDistinct("td_id").alias("records"), F.sum(F.when(F.col("edits") == 0, 1).otherwise(0)).alias("exact"), F.sum(F.when(F.col("edits") > 0, 1).otherwise(0)).alias("near"), F.sum("links").alias("links"))
    )


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose text was decoded with the wrong encoding: the text restored as far as it can be, and whether wholly."""
    docs = table(spark, sf_dir, "text_docs").where("td_id is not null").select("td_id", "text")
    found = mojibake.restore(docs, "td_id", "text", mojibake.train(docs))
    return found.groupBy("td_id").agg(F.min("restored").alias("restored"), F.min("text").alias("text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose text, wholly or in part, was decoded with the wrong encoding."""
    return p2_restored(spark, sf_dir).select("td_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies hidden by formatting differences, each with the smallest id of its group."""
    return multiset.copies(table(spark, sf_dir, "text_docs").select("td_id", "text"), "td_id", "text")


def p3_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record once, with the number of its copies; records of any number of runs."""
    rows = multiset.collapsed(table(spark, sf_dir, "text_docs").select("td_id", "text"), "td_id", "text", min_runs=0)
    return rows.select(F.col("keep").alias("td_id"), "copies")


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences, records and mark of each distinct term of the tokens."""
    tokens = termfreq.term_frequencies(table(spark, sf_dir, "tokens"), "td_id", "token_position", "text")
    return termfreq.marked(tokens).withColumnRenamed("term", "token")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that are too rare or too common to be useful."""
    return p4_terms(spark, sf_dir).where("mark is not null").select("token", "mark")


def p4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences, records and mark of each token id of the stream."""
    ids = termfreq.term_frequencies(table(spark, sf_dir, "token_stream"), "td_id", "pos", "token_id")
    return termfreq.marked(ids).select(F.col("term").cast("long").alias("token_id"), "occurrences", "records", "mark")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows that look the same but differ in characters, in text_docs.text and token_exceptions.orth."""
    rules = table(spark, sf_dir, "token_exceptions")
    lattice = _lattice(spark, sf_dir, rules.select(F.col("orth").alias("text")))
    texts = lookalike.equal_looking_pairs(table(spark, sf_dir, "text_docs").select("td_id", "text"), "td_id", "text", lattice, min_runs=8)
    orths = lookalike.equal_looking_pairs(rules, "exc_id", "orth", lattice)
    return texts.select(F.lit("text").alias("field_name"), "key_a", "key_b").unionByName(orths.select(F.lit("orth").alias("field_name"), "key_a", "key_b"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text of a class that looks the same with several spellings: its class, the class's size, and its links."""
    docs = table(spark, sf_dir, "text_docs").select("td_id", "text")
    found = lookalike.equal_looking_classes(docs, "td_id", "text", _lattice(spark, sf_dir), min_runs=8)
    return found.select(F.col("k").alias("td_id"), "class_id", "rows", "spellings", "links")


def p5_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its consistent form."""
    docs = records(table(spark, sf_dir, "text_docs"), "text")
    return lookalike.normalize(docs, "text", _lattice(spark, sf_dir)).select("td_id", "normal")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the public tokenizer."""
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or piece of one, for each capacity."""
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", table(spark, sf_dir, "pack_specs"), bpe.DEFAULT_FILE)


def p7_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused space for each capacity."""
    return packing.summary(p7_packed(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id", "text", "lang", table(spark, sf_dir, "graded_passages"))


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading level of every document on the scale of the graded passages."""
    return _levels(spark, sf_dir).select("doc_id", "basis", "n_words", F.round("level", 2).alias("level"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents of 60 words or more that are as demanding as passages of grade 4 or 5."""
    english = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    found = _levels(spark, sf_dir).where("n_words >= 60 and level >= 3.5").select("doc_id")
    return found.join(english, "doc_id", "left_semi")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_restored, p3_found, p3_collapsed, p4_found, p4_terms, p4_token_ids, p5_found, p5_classes, p5_normalized, p6_ids, p7_packed, p7_summary, p8_found, p8_levels)}
