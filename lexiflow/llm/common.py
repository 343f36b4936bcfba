"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.plans.lineage import cut, cut_table
from lexiflow.sources.tables import read_table

__all__ = ["MIN_RUNS", "RUN", "cut", "cut_table", "records", "table"]

#: A run of letters or digits; every "word" of these operators is one.
RUN = re.compile(r"[^\W_]+")

#: Records with fewer runs are left out where a problem says so.
MIN_RUNS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def records(df: DataFrame, *columns: str) -> DataFrame:
    """One row for each td_id: a record delivered twice is one record.

    Null ids and null texts are left out. Should two deliveries differ after all, the smallest value of each further
    column is kept, so the result doesn't depend on the order of the rows.
    """
    kept = [c for c in columns if c != "td_id"]
    src = df.select("td_id", *kept).where(F.col("td_id").isNotNull())
    if "text" in kept:
        src = src.where(F.col("text").isNotNull())
    return src.groupBy("td_id").agg(*(F.min(c).alias(c) for c in kept))
