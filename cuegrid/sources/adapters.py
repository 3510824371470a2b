"""Timed-text views over general tables. Times are multiples of 1/16 s, so sums of them are exact."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

_BLANKS = re.compile(r"[ \t\r\n]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORDS_OUT = 100_000


def words(documents: DataFrame) -> DataFrame:
    """video_id, pos, start, end, word. A text's words are timed where it is read, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for video, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = 0
                for pos, token in enumerate(filter(None, _BLANKS.split(text or ""))):
                    rows.append((video, pos, at / 16.0, (at + len(token)) / 16.0, f" {token}" if pos else token))
                    at += len(token) + (12 if pos % 11 == 10 else 1)
                    if len(rows) == _WORDS_OUT:
                        yield shaped(rows)
                        rows = []
            yield shaped(rows)

    def shaped(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    kind = dict(documents.dtypes)["doc_id"]
    schema = f"video_id {kind}, pos int, start double, end double, word string"
    shape = to_arrow_schema(documents.sparkSession.createDataFrame([], schema).schema)
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def segments(conversations: DataFrame) -> DataFrame:
    """video_id, index, start, end, text, translated, speaker."""
    length = F.length("text")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(length + 8).over(before), F.lit(0)) / F.lit(16.0)
    return conversations.select(
        F.col("conv_id").alias("video_id"),
        F.col("turn").alias("index"),
        start.alias("start"),
        (start + length / 16.0).alias("end"),
        "text",
        F.concat("text", F.lit(" "), F.substring("text", F.lit(1), length % 40)).alias("translated"),
        F.col("role").alias("speaker"),
    )


def clips(conversations: DataFrame) -> DataFrame:
    """Segments with the length of their synthesised clip."""
    ms = F.expr("(length(translated) * 1000) div (12 + index % 8)")
    return segments(conversations).withColumn("clip_ms", ms.cast("long"))


def turns(conversations: DataFrame) -> DataFrame:
    """video_id, ord, start, end, speaker: diarization turns, some left out."""
    rows = segments(conversations).filter(F.col("index") % 5 != 4)
    return rows.select("video_id", F.col("index").alias("ord"), (F.col("start") + 0.375).alias("start"), (F.col("end") + 0.25).alias("end"), "speaker")


def fragments(conversations: DataFrame) -> DataFrame:
    """Segments of which every third is cut to a few characters."""
    cut = (F.col("video_id") + F.col("index")) % 3 == 0
    text = F.when(cut, F.substring("text", F.lit(1), (1 + F.col("index") % 3).cast("int"))).otherwise(F.col("text"))
    return segments(conversations).select("video_id", "index", "start", "end", text.alias("text"), F.lit(None).cast("string").alias("translated"), "speaker")


def vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select((F.col("vec_id") % 20).alias("video_id"), F.col("vec_id").alias("index"), F.col("embedding").cast("array<double>").alias("vector"))


def urls(pages: DataFrame) -> DataFrame:
    code = F.substring(F.md5(F.col("page_id").cast("string")), 1, 11)
    shape = F.col("page_id") % 4
    url = (
        F.when(shape == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), code))
        .when(shape == 1, F.concat(F.lit("https://youtu.be/"), code, F.lit("?si=x")))
        .when(shape == 2, F.concat(F.lit("https://youtube.com/shorts/"), code))
        .otherwise(F.col("url"))
    )
    return pages.select("page_id", url.alias("url"))


def job_log(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), "ts", "event_id")
