"""Text corpora with train, valid and test files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLITS = ("train", "valid", "test")


@dataclass(frozen=True)
class TextDatasetMeta:
    """The files of a data set; a split without a file is None."""

    train_path: str
    valid_path: str | None = None
    test_path: str | None = None

    def path(self, split: str) -> str:
        if split not in SPLITS:
            raise ValueError(f"split is one of {', '.join(SPLITS)}")
        if (path := getattr(self, f"{split}_path")) is None:
            raise ValueError(f"there is no {split} file")
        return path


def lines(text: Column) -> Column:
    """The lines of a text with their ends; every kind of line end becomes a line feed. An empty text has none."""
    return F.regexp_extract_all(F.regexp_replace(text, "\r\n|\r", "\n"), F.lit("[^\n]*\n|[^\n]+"), F.lit(0))


def _open_files(spark: SparkSession, path: str) -> DataFrame:
    """(data_path) of the files whose last line has no end, by their sizes alone.

    Cut at line feeds, the lines of a file with a last end have together its bytes less one for each line; those of another
    file have one more. A carriage return before the missing line feed is an end too. A byte order mark isn't shown.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("data_path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"))
    rows = rows.select("data_path", "size", F.octet_length("value").alias("n"), F.struct("block", F.monotonically_increasing_id()).alias("at"), F.col("value").endswith("\r").alias("closed"))
    files = rows.groupBy("data_path", "size").agg(F.sum(F.col("n") + 1).alias("total"), F.max_by("closed", "at").alias("closed"))
    return files.where(F.col("total").isin([F.col("size") + 1]) | (F.col("total") == F.col("size") - 2)).where("not closed").select("data_path")


def read_split(spark: SparkSession, meta: TextDatasetMeta, split: str) -> DataFrame:
    """(data_path, line_no, text) of a split, each line with its end; only the last line of a file may lack one.

    Files are split over tasks by ``spark.sql.files.maxPartitionBytes``, within a file too. Line feeds, carriage returns and
    both together end a line and come out as a line feed. ``line_no`` is dense from 0 in each file: a number within each
    block of a file, and one row a block to tell how many lines are before it. ``path`` may be a file, a folder or a pattern.
    """
    path = meta.path(split)
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("data_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = rows.groupBy("data_path", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy("data_path").orderBy("_block")
    total = F.sum("_n").over(Window.partitionBy("data_path"))
    blocks = blocks.select("data_path", "_block", "_first", (F.sum("_n").over(own) - F.col("_n")).alias("_before"), total.alias("_total"))
    blocks = blocks.join(_open_files(spark, path).withColumn("_open", F.lit(True)), "data_path", "left")
    placed = rows.join(blocks, ["data_path", "_block"])
    number = F.col("_at") - F.col("_first") + F.col("_before")
    end = F.when(F.col("_open") & (number == F.col("_total") - 1), "").otherwise("\n")
    return placed.select("data_path", number.alias("line_no"), F.concat("value", end).alias("text"))


def read_dataset(spark: SparkSession, meta: TextDatasetMeta, split: str | None = None) -> dict[str, DataFrame] | DataFrame:
    """One split, or all that have files by name."""
    if split is not None:
        return read_split(spark, meta, split)
    return {s: read_split(spark, meta, s) for s in SPLITS if getattr(meta, f"{s}_path") is not None}


def split_of_table(docs: DataFrame, metas: DataFrame, split: str) -> DataFrame:
    """Rows of ``docs`` (data_path, ...) that stand in a file that some descriptor of ``metas`` names as ``split``."""
    if split not in SPLITS:
        raise ValueError(f"split is one of {', '.join(SPLITS)}")
    return docs.join(metas.select(F.col(f"{split}_path").alias("data_path")).where("data_path is not null").distinct(), "data_path", "left_semi")


def encoded_splits(splits: dict[str, DataFrame], encoder, key: str) -> dict[str, DataFrame]:
    """Encoded tokens (key, position, text, space_after, token_id) of the splits of a data set, in the order train, valid, test.

    An encoder without a vocabulary gets one from the training split alone; tokens first met in another split then go on
    from there.
    """
    names = [s for s in SPLITS if s in splits]
    if not encoder.has_vocab and "train" in splits:
        encoder.create_vocab(splits["train"], key)
    return {s: encoder.encode(splits[s], key) for s in names}


def language_modeling_dataset(spark: SparkSession, meta: TextDatasetMeta, encoder, split: str | None = None) -> dict[str, DataFrame] | DataFrame:
    """Token streams (pos, token_id) of one or all splits; see ``encoded_splits`` for the vocabulary."""
    from lexiflow.operators.lm import token_stream

    def order(df: DataFrame) -> DataFrame:
        return df.withColumn("line", F.struct("data_path", "line_no"))

    if not encoder.has_vocab:
        encoder.create_vocab(order(read_split(spark, meta, "train")), "line")
    names = [split] if split is not None else [s for s in SPLITS if getattr(meta, f"{s}_path") is not None]
    found = encoded_splits({s: order(read_split(spark, meta, s)) for s in names}, encoder, "line")
    out = {s: token_stream(df, ["line"]) for s, df in found.items()}
    return out if split is None else out[split]
