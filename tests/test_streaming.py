"""Streams give what the batch gives."""

from pyspark.sql import functions as F

from frameloom.operators import annotate as A
from frameloom.operators import corpus as C
from frameloom.streaming.corpus import stream_table, windowed_accuracy

SF = "/root/testdata/sf0.001"


def run(stream, name, mode, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return q


def test_extraction_on_a_stream(spark, tmp_path):
    nested = A.nested_sentences(C.tokens_once(spark.read.parquet(f"{SF}/tokens.parquet")))
    model = A.train_labeller(nested, most_sentences=20, rounds=2)
    nested.repartition(3).write.parquet(str(tmp_path / "in"))
    batch = A.extract_arguments(nested, model)
    run(A.extract_arguments(stream_table(spark, str(tmp_path / "in"), nested.schema, 1), model), "extracted", "append", tmp_path)
    key = lambda df: sorted(map(tuple, df.select("sent_id", "word_no", "rank", "label", "predicate_no", "semantic_head").collect()))
    assert key(spark.table("extracted")) == key(batch) and batch.count() > 50


def test_windows(spark, tmp_path):
    results = spark.read.parquet(f"{SF}/pred_results.parquet")
    results.write.parquet(str(tmp_path / "r"))
    stream = stream_table(spark, str(tmp_path / "r"), results.schema)
    run(windowed_accuracy(stream, lateness="400 days"), "windows", "complete", tmp_path)
    key = lambda df: sorted(((r["start"], r["predicate"] or "", r["n"], r["correct"]) for r in df.collect()), key=str)
    want = windowed_accuracy(results.dropDuplicates(["result_id"]))
    assert key(spark.table("windows")) == key(want) and want.agg(F.sum("n")).first()[0] > 100
