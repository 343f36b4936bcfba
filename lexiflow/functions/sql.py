"""SQL surface: attribute functions and a table function for tokens."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexiflow.functions.lexattrs import register_sql
from lexiflow.operators.rules import DEFAULT, TokenizerRules
from lexiflow.operators.tokenize import splitter


def register(spark: SparkSession, rules: TokenizerRules = DEFAULT, name: str = "tokenize") -> list[str]:
    """Register the attributes and ``tokenize(text)``, to be used as ``FROM docs, LATERAL tokenize(docs.text)``."""

    class Tokenize:
        def eval(self, text: str) -> Iterator[tuple]:
            words, flags = splitter(rules).text(text) if text else ([], [])
            yield from ((i, w, f) for i, (w, f) in enumerate(zip(words, flags, strict=True)))

    spark.udtf.register(name, F.udtf(Tokenize, returnType="position int, text string, space_after boolean"))
    return [*register_sql(spark), name]
