"""Collapse records that differ only in white space, letter case, punctuation signs or the order of their named fields.

A record made of named fields is a multiset of (name, value) pairs; prose is one pair without a name, so the order of
its words counts. Names and values are cut down to their folded letters and digits (see ``forms``), so white space and
signs never count, not even inside a word. Each pair is hashed to 128 bits, and the hashes of a record are added up modulo
2**128: a commutative multiset hash, so no fields are sorted. Records are grouped by that fingerprint, and the fields of
every record are then compared with those of its group, pair by pair.

What looks like fields may be prose whose signs a copy lost. Records also belong together if all their letters, in the
order of the text, are the same; so a wrong guess about fields never parts copies.

Nulls and records of fewer than ``min_runs`` runs of letters or digits have no row (0 keeps all but nulls; texts without any
letter are then copies of each other). A key that comes more than once counts once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import MIN_RUNS, RUN, cut, cut_table
from lexiflow.llm.forms import Folded, digest
from lexiflow.plans.skew import lookup

#: A name: a run of words that begins with a letter.
NAME = r"[^\W\d_][\w.'’-]*(?: +[\w.'’-]+)*"
#: With a dash, prose has clauses of many words that look like fields, so a name has four words at most there.
SHORT = r"[^\W\d_][\w.'’-]*(?: +[\w.'’-]+){0,3}"
WORD = r"[^\W\d_][\w.-]*"
#: A field begins a record, or comes after a sign between fields (a line end, tab, bar, semicolon or comma), or, with a
#: colon that its value touches, after a blank.
BEGIN = r"(?:\A[\W_]*|[\n\r\t|;,][^\S\n\r\t]*(?:[^\w\s]{1,3}[^\S\n\r\t]*)?)"
#: How a name is told from its value: a tag, or a name, maybe in quotes, with a colon, an equals sign or a spaced dash.
TAG = re.compile(rf"<({NAME})>")
SIGNED = tuple(re.compile(rf"{BEGIN}({name})[\"'”]?[^\S\n\r\t]*{sign}") for name, sign in ((NAME, ":(?!//)"), (NAME, "="), (SHORT, r"(?<=\s)[-–—](?=\s)")))
TOUCHED = re.compile(rf"(?:\A[\W_]*|\s)({WORD}):(?=\S)")
STYLES = (TAG, *SIGNED, TOUCHED)
#: A record has fields if it begins with one and has two or more.
FIRST = 2
SIGN = re.compile(r"[<:=]|\s[-–—]\s")
PAIR, FIELD = "\x1e", "\x1f"


def fields(text: str) -> list[tuple[str, str]] | None:
    """The (name, value) pairs of a record made of named fields, in their order; None for anything else.

    Of several ways to read it, the one that gives most fields counts.
    """
    best: list[re.Match] = []
    for style in STYLES:
        found = list(style.finditer(text))
        if len(found) >= FIRST and len(found) > len(best) and not RUN.search(text, 0, found[0].start()):
            best = found
    if not best:
        return None
    ends = [m.start() for m in best[1:]] + [len(text)]
    return [(m[1], text[m.end() : e]) for m, e in zip(best, ends, strict=True)]


def letters(text: str) -> str:
    return "".join(RUN.findall(text))


def canonical_pairs(text: str) -> list[tuple[str, str]]:
    """The pairs of a folded text in letters and digits alone; prose has one, with an empty name."""
    pairs = fields(text) if len(SIGN.findall(text)) >= FIRST else None
    return [("", letters(text))] if pairs is None else [(letters(n), letters(v)) for n, v in pairs]


def form_of(pairs: list[tuple[str, str]]) -> str:
    """The pairs as written, one string."""
    return PAIR.join(f"{n}{FIELD}{v}" for n, v in pairs)


def multiset_hash(pairs: list[tuple[str, str]]) -> int:
    """Sum of the pairs' 128-bit hashes: the order of the pairs doesn't matter, how often one occurs does."""
    return sum(int.from_bytes(digest(f"{n}{FIELD}{v}".encode("utf-8", "replace")), "little") for n, v in pairs) % (1 << 128)


def fingerprints(df: DataFrame, key: str, column: str, min_runs: int = MIN_RUNS) -> DataFrame:
    """(k, fp, p, form): the fingerprint of each row, a hash of all its letters in order, and its pairs as one string.

    The sum over the one pair of prose is just the hash of its letters.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Folded(batch.column(1).to_pylist())
            raw, start, end = own.letters()
            keys = batch.column(0).take(pa.array(own.row))
            kept = [i for i, n in enumerate(own.runs().tolist()) if n >= min_runs]
            fps, ps, forms = [], [], []
            for i in kept:
                text = own.text(i)
                pairs = canonical_pairs(text)
                ps.append(digest(raw[start[i] : end[i]]))
                fps.append(ps[-1] if pairs[0][0] == "" and len(pairs) == 1 else multiset_hash(pairs).to_bytes(16, "little"))
                forms.append(form_of(pairs))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(kept, pa.int64())), pa.array(fps, pa.binary()), pa.array(ps, pa.binary()), pa.array(forms, pa.string())], ["k", "fp", "p", "form"])

    src = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(column).cast("string").alias("t"))
    return src.mapInArrow(work, "k long, fp binary, p binary, form string")


def same_fields(a: str, b: str) -> bool:
    """Whether two forms have the same fields, or the same letters in order."""
    if a == b or Counter(a.split(PAIR)) == Counter(b.split(PAIR)):
        return True
    plain = str.maketrans("", "", PAIR + FIELD)
    return a.translate(plain) == b.translate(plain)


def _joined(forms: DataFrame) -> DataFrame:
    """(fp, root): the fingerprints that records with the same letters join to another one, and the least of each component.

    Few records have letters with several fingerprints, and a component is hardly ever longer than two steps; still it goes
    on until nothing changes.
    """
    several = forms.groupBy("p").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("p", "lo")
    edges = cut(forms.join(several, "p").select("fp", F.col("lo").alias("near")).where("fp <> near").distinct())
    if edges.isEmpty():
        return edges.select("fp", F.col("near").alias("root"))
    edges = cut(edges.unionByName(edges.select(F.col("near").alias("fp"), F.col("fp").alias("near"))))
    roots = cut(edges.groupBy("fp").agg(F.least(F.min("near"), F.col("fp")).alias("root")))
    while True:
        seen = edges.join(roots.select(F.col("fp").alias("near"), F.col("root").alias("far")), "near").groupBy("fp").agg(F.min("far").alias("far"))
        now = cut(roots.join(seen, "fp").select("fp", F.least("root", "far").alias("root"), (F.col("far") < F.col("root")).alias("moved")))
        roots = now.select("fp", "root")
        if now.where("moved").isEmpty():
            return roots


def grouped(df: DataFrame, key: str, column: str, min_runs: int = MIN_RUNS) -> tuple[DataFrame, DataFrame]:
    """((k, fp, p), (fp, p, n, keep, copies)): the records, and for each form its class: the smallest key and the size.

    Only hashes of the records are shuffled, and once, their forms, to be compared: equal forms collapse where they are,
    so a text that a third of all records share arrives as one row a task. Within (fp, p) the least and the greatest form
    must be equal, which holds only if all are; forms of one class that differ in ``p`` are compared with that of the
    class's smallest key by ``same_fields``. A form that only collides becomes a class of its own.
    """
    made = cut_table(fingerprints(df, key, column, min_runs))
    while True:
        rows = cut_table(made.groupBy("k").agg(F.min(F.struct("fp", "p")).alias("h")).select("k", "h.fp", "h.p"))
        forms = cut(rows.groupBy("fp", "p").agg(F.min("k").alias("first"), F.count("*").alias("n")))
        written = made.groupBy("fp", "p").agg(F.min("form").alias("form"), F.max("form").alias("last"))
        roots = _joined(forms.select("fp", "p"))
        rooted = forms.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        heads = rooted.groupBy("root").agg(F.min_by("p", "first").alias("head"), F.count("*").alias("forms")).where("forms > 1").drop("forms")
        asked = rooted.join(heads, "root").select("fp", "p", "root", "head")
        kept = cut(written.join(asked, ["fp", "p"], "left").where("root is not null or form <> last"))
        colliding = kept.where("form <> last").select("fp", "p")
        if colliding.isEmpty():
            break
        # Two texts have one hash: they go by their own form from here on.
        other = F.unhex(F.sha2(F.concat_ws(FIELD, F.hex("p"), "form"), 256))
        made = cut_table(made.join(colliding.withColumn("hit", F.lit(True)), ["fp", "p"], "left").select("k", F.when(F.col("hit"), other).otherwise(F.col("fp")).alias("fp"), F.when(F.col("hit"), other).otherwise(F.col("p")).alias("p"), "form"))

    @F.pandas_udf("boolean")
    def same(a, b):
        import pandas as pd

        return pd.Series([same_fields(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    first = kept.where("p = head").groupBy("root").agg(F.min("form").alias("head_form"))
    own = kept.join(first, "root").where(~same("form", "head_form")).select("root", "fp", "p")
    own = own.join(roots.select("root").distinct(), "root", "left_anti")  # those are joined over other records, not with the head itself
    own = cut(own.select("fp", "p", F.col("p").alias("split")))
    parted = rooted.join(own, ["fp", "p"], "left").withColumn("split", F.coalesce("split", F.lit(b"")))
    sizes = parted.groupBy("root", "split").agg(F.min("first").alias("keep"), F.sum("n").alias("copies"))
    return rows, parted.join(sizes, ["root", "split"]).select("fp", "p", "n", "keep", "copies")


def classes(df: DataFrame, key: str, column: str, min_runs: int = MIN_RUNS) -> DataFrame:
    """(k, keep, copies): each record's class, named by its smallest key, and how many records the class has."""
    rows, named = grouped(df, key, column, min_runs)
    return lookup(rows, named, ["fp", "p"], "n").select("k", "keep", "copies")


def collapsed(df: DataFrame, key: str, column: str, min_runs: int = MIN_RUNS) -> DataFrame:
    """(keep, copies): one row for each class."""
    return grouped(df, key, column, min_runs)[1].select("keep", "copies").distinct()


def copies(df: DataFrame, key: str, column: str, min_runs: int = MIN_RUNS) -> DataFrame:
    """(keep_id, copy_id): a row for each record of a class but the one with the smallest key."""
    rows, named = grouped(df, key, column, min_runs)
    found = lookup(rows, named.where("copies > 1"), ["fp", "p"], "n")
    return found.where("k <> keep").select(F.col("keep").alias("keep_id"), F.col("k").alias("copy_id"))
