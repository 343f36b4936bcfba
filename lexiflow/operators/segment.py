"""White-space segmentation in native expressions.

A text is cut into words, each with one white-space character after it, and into what white space is left. A word that is
followed by white space swallows exactly one such character, of any kind; other white space becomes a token of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.functions.chars import SPACE

#: One segment: a word and the white-space character after it, or a run of white space.
SEGMENT = f"([^{SPACE}]+[{SPACE}]?|[{SPACE}]+)"


#: The same for Java's engine, which then tests plain characters against one range before all others.
FAST_SEGMENT = f"([!-~[^{SPACE}]]+[{SPACE}]?|[{SPACE}]+)"


def space_split(text: Column) -> Column:
    """Pieces between single blanks, empty ones included; an empty text has one empty piece."""
    return F.split(text, " ", -1)


def segments(text: Column) -> Column:
    """The segments of a text in order; none for an empty text, null for null."""
    return F.regexp_extract_all(text, F.lit(FAST_SEGMENT), F.lit(1))


#: The tokens alone: a word, or what white space is left after the character that the word before it swallows.
TOKEN = f"[!-~[^{SPACE}]]+|(?<=[{SPACE}])[{SPACE}]+|\\A[{SPACE}]+"


def segment_texts(text: Column) -> Column:
    """The texts of the tokens in order, one array; none for an empty text, null for null."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def segment_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, text, space_after): words and white-space tokens without any splitting of words.

    Nulls and empty texts have no rows. A trailing white-space token has ``space_after`` true, any other one false. For
    arrays that stay with their document use ``tokenize_documents`` with all rules off, which gives the same tokens.
    """
    rows = df.select(key, segments(F.col(text)).alias("_parts")).select(key, F.size("_parts").alias("_n"), F.posexplode_outer("_parts").alias("position", "_part"))
    rows = rows.where("_part is not null").withColumn("_blank", F.col("_part").rlike(f"^[{SPACE}]")).withColumn("_closed", F.col("_part").rlike(f"[{SPACE}]\\z"))
    return rows.select(
        key,
        F.col("position").cast("long").alias("position"),
        F.when(F.col("_blank") | ~F.col("_closed"), F.col("_part")).otherwise(F.expr("substring(_part, 1, length(_part) - 1)")).alias("text"),
        F.when(F.col("_blank"), F.col("position") == F.col("_n") - 1).otherwise(F.col("_closed")).alias("space_after"),
    )
