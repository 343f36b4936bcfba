import datetime as dt

from lexiflow.operators.vocab import build_vocab
from lexiflow.streaming.tokens import grow_vocab, stream_tokens, windowed_counts


def test_tokens_and_vocabulary_of_a_stream(spark, tmp_path):
    src, voc = tmp_path / "in", str(tmp_path / "voc")
    schema = "doc_id long, text string"
    for part, rows in enumerate([[(1, "b a"), (2, "c.")], [(3, "a d"), (4, None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src / f"part={part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    query = stream_tokens(stream, "doc_id").writeStream.foreachBatch(grow_vocab(voc, "doc_id")).option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    last = spark.read.parquet(f"{voc}/version=1")
    assert {r["token"] for r in last.collect()} == {"a", "b", "c", ".", "d"} and sorted(r["id"] for r in last.collect()) == list(range(5))
    first = {r["token"]: r["id"] for r in spark.read.parquet(f"{voc}/version=0").collect()}
    assert {r["token"]: r["id"] for r in last.collect()}.items() >= first.items()


def test_windowed_counts(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    schema = "doc_id long, text string, at timestamp"
    spark.createDataFrame([(1, "a b a", at(1)), (2, "a", at(2)), (3, "z", at(20)), (4, "a", None)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    query = windowed_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "at").writeStream.format("memory").queryName("counts").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["start"].hour, r["token"], r["n"]) for r in spark.table("counts").collect()} >= {(1, "a", 2), (1, "b", 1), (2, "a", 1)}
