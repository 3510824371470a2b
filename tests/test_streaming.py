from pyspark.sql import functions as F

from cuegrid.operators.segmentation import sentence_segments
from cuegrid.streaming.live import latest_jobs_stream, sentence_segments_stream


def run(spark, df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_latest_jobs_stream(spark, tmp_path):
    schema = "job_id long, status string, ts int, event_id long"
    spark.createDataFrame([(1, "queued", 1, 1), (1, "done", 3, 2), (2, "queued", 1, 3)], schema).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
    out = run(spark, latest_jobs_stream(stream), "jobs_now", "update")
    assert {(r.job_id, r.status) for r in out.collect()} == {(1, "done"), (2, "queued")}


def test_sentence_stream(spark, tmp_path):
    words = [" One", " two.", " Three", " four", " five!", " rest"]
    rows = [(1, i, i / 2, i / 2 + 0.5, w) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "video_id long, pos int, start double, end double, word string")
    df.coalesce(1).write.parquet(str(tmp_path / "words"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "words"))
    got = run(spark, sentence_segments_stream(stream), "sentences_now", "append")
    batch = sentence_segments(df).filter(F.col("text") != "rest")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select("video_id", "index", "start", "end", "text").collect()))
