"""Language-model examples and batches from a stream of token ids.

A stream is a table of pieces (pos, ids): the place of the first id, and ids that follow each other. A document is a piece,
so the ids stay together; a table of single ids (pos, token_id) is taken too. Places are dense from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.operators.ordering import with_running_sum
from lexiflow.operators.vocab import documents_of


def stream_of_documents(docs: DataFrame, order: list[str], ids: str = "ids") -> DataFrame:
    """(pos, ids): all documents one after the other in ``order``. Their arrays are brought into order once, by ranges, and
    what lies before each range is one row a range. Documents without ids are left out."""
    some = docs.where(F.size(ids) > 0).withColumn("_n", F.size(ids))
    return with_running_sum(some, order, "_n", "pos").select("pos", F.col(ids).alias("ids"))


def stream_rows(stream: DataFrame) -> DataFrame:
    """(pos, token_id), one row for each id."""
    return stream.select("pos", F.posexplode("ids").alias("_at", "token_id")).select((F.col("pos") + F.col("_at")).alias("pos"), "token_id")


def token_stream(encoded: DataFrame, order: list[str], position: str = "position", token_id: str = "token_id") -> DataFrame:
    """(pos, token_id) of encoded token rows, all documents one after the other in ``order``."""
    key = F.struct(*order)
    docs = documents_of(encoded.select(key.alias("_key"), F.col(position).alias("position"), F.col(token_id).alias("token_id")), "_key")
    return stream_rows(stream_of_documents(docs, ["_key"], "token_ids"))


def _pieces(stream: DataFrame) -> DataFrame:
    return stream if "ids" in stream.columns else stream.select("pos", F.array("token_id").alias("ids"))


def sizes(stream: DataFrame, bptt_len: int, batch_size: int) -> DataFrame:
    """(n_tokens, num_examples, num_batches): one row; 0 examples for streams of up to one token."""
    n = _pieces(stream).agg(F.coalesce(F.sum(F.size("ids").cast("long")), F.lit(0)).cast("long").alias("n_tokens"))
    examples = F.expr(f"greatest(n_tokens - 1, 0) div {int(bptt_len)}")
    return n.withColumn("num_examples", examples).withColumn("num_batches", F.expr(f"num_examples div {int(batch_size)}"))


def examples(stream: DataFrame, bptt_len: int) -> DataFrame:
    """(example_id, input, target): non-overlapping windows, and the same shifted by one token.

    A window has ``bptt_len`` + 1 ids, the last of which is the first of the next one. Windows inside a piece are cut out of
    it where it is; only the parts of windows that lie across pieces are brought together. An unfinished window at the end
    is left out.
    """
    length = int(bptt_len)
    last = F.col("pos") + F.size("ids") - 1
    first = F.greatest(F.floor((F.col("pos") - 1) / length), F.lit(0)).cast("long")
    windows = F.sequence(first, F.floor(last / length).cast("long"))

    def part(w):
        start, end = F.greatest(w * length - F.col("pos"), F.lit(0)), F.least(w * length + length + 1 - F.col("pos"), F.size("ids").cast("long"))
        return F.struct(w.alias("example_id"), start.alias("at"), F.slice("ids", (start + 1).cast("int"), (end - start).cast("int")).alias("w"))

    parts = _pieces(stream).select("pos", F.explode(F.transform(windows, part)).alias("p")).select("p.example_id", (F.col("pos") + F.col("p.at")).alias("at"), "p.w")
    inside = parts.where(F.size("w") == length + 1).select("example_id", "w")
    across = parts.where(F.size("w") <= length).groupBy("example_id").agg(F.sort_array(F.collect_list(F.struct("at", "w"))).alias("parts"))
    across = across.select("example_id", F.flatten(F.col("parts.w")).alias("w")).where(F.size("w") == length + 1)
    whole = inside.unionByName(across)
    return whole.select("example_id", F.slice("w", 1, length).alias("input"), F.slice("w", 2, length).alias("target"))


def example_rows(examples: DataFrame) -> DataFrame:
    """(example_id, t, input_id, target_id), one row for each place of each example."""
    rows = examples.select("example_id", F.posexplode(F.arrays_zip("input", "target")).alias("t", "p"))
    return rows.select("example_id", F.col("t").cast("long").alias("t"), F.col("p.input").alias("input_id"), F.col("p.target").alias("target_id"))


def batches(stream: DataFrame, bptt_len: int, batch_size: int) -> DataFrame:
    """(batch_id, t, col, input_id, target_id): consecutive examples side by side, time first; a partial batch is left out."""
    size = int(batch_size)
    count = sizes(stream, bptt_len, batch_size).select("num_batches").scalar()
    kept = examples(stream, bptt_len).where(F.expr(f"example_id div {size}") < count)
    rows = example_rows(kept)
    return rows.select(F.expr(f"example_id div {size}").alias("batch_id"), "t", F.expr(f"example_id % {size}").alias("col"), "input_id", "target_id")


def batch_matrices(batch_rows: DataFrame) -> DataFrame:
    """(batch_id, input, target): rows of batches as matrices of bptt_len rows and batch_size columns, arrays of arrays."""
    rows = batch_rows.groupBy("batch_id", "t").agg(F.sort_array(F.collect_list(F.struct("col", "input_id", "target_id"))).alias("r"))
    rows = rows.select("batch_id", "t", F.col("r.input_id").alias("i"), F.col("r.target_id").alias("o"))
    whole = rows.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("t", "i", "o"))).alias("m"))
    return whole.select("batch_id", F.col("m.i").alias("input"), F.col("m.o").alias("target"))


def matrices(stream: DataFrame, bptt_len: int, batch_size: int) -> DataFrame:
    """The same from a stream: the examples of a batch meet as arrays and are turned there, without rows of single ids."""
    size, length = int(batch_size), int(bptt_len)
    whole = examples(stream, length).groupBy(F.expr(f"example_id div {size}").alias("batch_id"))
    whole = whole.agg(F.sort_array(F.collect_list(F.struct("example_id", "input", "target"))).alias("e")).where(F.size("e") == size)
    turned = lambda name: F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda t: F.transform("e", lambda e: F.get(e[name], t)))
    return whole.select("batch_id", turned("input").alias("input"), turned("target").alias("target"))


class BPTTIterator:
    """Batches of a split in order, fetched a batch at a time; ends after ``num_batches``.

    Rows come to the driver one batch at a time. ``shuffle`` isn't supported and must be false.
    """

    def __init__(self, batch_size: int, bptt_len: int, shuffle: bool = False):
        if shuffle:
            raise NotImplementedError("batches come in the order of the text")
        self.batch_size, self.bptt_len, self.stream = batch_size, bptt_len, None

    def load(self, stream: DataFrame) -> BPTTIterator:
        self.stream = stream
        row = sizes(stream, self.bptt_len, self.batch_size).first()
        self.num_examples, self.num_batches = row["num_examples"], row["num_batches"]
        return self

    def __len__(self) -> int:
        return self.num_batches

    def __iter__(self):
        for row in matrices(self.stream, self.bptt_len, self.batch_size).orderBy("batch_id").toLocalIterator():
            yield row["input"], row["target"]
