import pytest
from pyspark.sql import functions as F

from lexiflow.operators.tokenize import tokenize
from lexiflow.operators.vocab import SentenceEncoder
from lexiflow.plans.handles import Store
from lexiflow.sources.textsplits import TextDatasetMeta, language_modeling_dataset, lines, read_dataset, read_split, split_of_table


@pytest.fixture
def meta(tmp_path):
    (tmp_path / "train.txt").write_bytes("Lorem ipsum.\n\nDolor\r\nsit é".encode())
    (tmp_path / "valid.txt").write_bytes(b"Dolor amet\n")
    return TextDatasetMeta(str(tmp_path / "train.txt"), str(tmp_path / "valid.txt"))


def test_lines_keep_their_ends(spark, meta):
    rows = read_split(spark, meta, "train").orderBy("line_no").collect()
    assert [(r["line_no"], r["text"]) for r in rows] == [(0, "Lorem ipsum.\n"), (1, "\n"), (2, "Dolor\n"), (3, "sit é")]
    assert spark.createDataFrame([("",)], "t string").select(F.size(lines(F.col("t")))).first()[0] == 0


@pytest.mark.parametrize("block", ["128m", "7"])
def test_line_ends_are_exact_however_files_are_split(spark, tmp_path, block):
    contents = [b"", b"a", b"a\n", b"a\r\nb\rc", b"a\r\nb\r", b"\n\n", "é\u2028x\n\nlast line é".encode(), b"x" * 50 + b"\n" + b"y z\n" * 9, b"\r\n", "\ufeffa b\nc".encode()]
    for i, data in enumerate(contents):
        (tmp_path / f"f{i}.txt").write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        rows = read_split(spark, TextDatasetMeta(str(tmp_path)), "train").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {}
    for r in sorted(rows, key=lambda r: (r["data_path"], r["line_no"])):
        got.setdefault(int(r["data_path"].rsplit("f", 1)[1][:-4]), []).append((r["line_no"], r["text"]))
    for i, data in enumerate(contents):
        with open(tmp_path / f"f{i}.txt", encoding="utf-8-sig") as f:
            assert got.get(i, []) == list(enumerate(f.readlines())), i


def test_splits(spark, meta):
    assert set(read_dataset(spark, meta)) == {"train", "valid"} and read_dataset(spark, meta, "valid").count() == 1
    for bad in ("test", "other"):
        with pytest.raises(ValueError):
            meta.path(bad)


def test_encoded_dataset_shares_a_growing_vocabulary(spark, meta):
    encoder = SentenceEncoder(lambda df: tokenize(df, "line"))
    streams = language_modeling_dataset(spark, meta, encoder)
    ids = {s: [r["token_id"] for r in d.orderBy("pos").collect()] for s, d in streams.items()}
    assert ids["train"] == list(range(7)) and ids["valid"] == [4, 7]


def test_split_of_table(spark):
    docs = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "data_path string, x int")
    metas = spark.createDataFrame([("a", None, "b"), ("a", None, None)], "train_path string, valid_path string, test_path string")
    assert {r["x"] for r in split_of_table(docs, metas, "train").collect()} == {1, 3} and split_of_table(docs, metas, "valid").count() == 0


def test_handles(spark):
    store = Store(spark)
    handle = store.publish("poem", spark.createDataFrame([(1, "a b")], "doc_id long, text string"), tags=["#poem", "#en"])
    assert store.find("#poem", "#en") == [handle] and store.find("#other") == [] and len(handle.get()) == 1
    assert handle.apply(lambda df: tokenize(df, "doc_id")).count() == 2 and spark.table("poem").count() == 1
    with pytest.raises(ValueError, match="more than 0 rows"):
        handle.get(limit=0)
    store.withdraw("poem")
    assert store.find("#poem") == []
