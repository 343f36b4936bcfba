"""Look up keys of which a few may have a large share of all rows, without giving any task all rows of one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows is hot; there can be at most 1 / HOT of them, which bounds the broadcast.
HOT = 0.001
SALTS = 4096


def lookup(rows: DataFrame, table: DataFrame, on: list[str], count: str, hot: float = HOT, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each key and the number of rows of it in ``count``.

    Rows of hot keys get their values from a broadcast table of at most 1 / ``hot`` keys; the others meet theirs in a
    shuffle, in which the rows of hot keys are dealt out by a salt that no key has. ``how`` is inner or left. Null keys match
    nothing.
    """
    values = [c for c in table.columns if c not in on]
    hashed = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    total = table.agg(F.sum(count)).scalar()
    known = table.where(F.col(count) > F.lit(hot) * total).select(*on, F.struct(*values).alias("_hot"))
    marked = rows.join(F.broadcast(known), on, "left")
    salt = F.when(F.col("_hot").isNotNull(), 1 + F.pmod(F.xxhash64(*hashed), F.lit(SALTS))).otherwise(F.lit(0)).cast("long")
    cold = table.select(*on, F.struct(*values).alias("_cold"), F.lit(0).cast("long").alias("_salt"))
    found = marked.withColumn("_salt", salt).join(cold, [*on, "_salt"], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    if how == "inner":
        found = found.where("_found is not null")
    return found.select(*rows.columns, *(F.col("_found").getField(c).alias(c) for c in values))
