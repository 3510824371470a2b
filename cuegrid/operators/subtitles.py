"""Subtitle files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions.text import or_else, srt_timestamp, strip


def cues(segments: DataFrame, translated: bool = True) -> DataFrame:
    """video_id, cue, body: numbered from 1 in order of index, whatever gaps the index has."""
    said = or_else(F.col("translated"), F.col("text")) if translated else F.col("text")
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("index"))
    rows = segments.withColumn("cue", number)
    span = F.concat(srt_timestamp(F.col("start")), F.lit(" --> "), srt_timestamp(F.col("end")))
    return rows.select("video_id", "cue", F.concat_ws("\n", F.col("cue").cast("string"), span, strip(said), F.lit("")).alias("body"))


def render_srt(segments: DataFrame, translated: bool = True) -> DataFrame:
    """video_id, srt: one document per video."""
    rows = cues(segments, translated).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("cue", "body"))).alias("c"))
    return rows.select("video_id", F.array_join("c.body", "\n").alias("srt"))


def write_srt(segments: DataFrame, folder: str, translated: bool = True) -> None:
    """One folder video_id=... per video, holding its subtitle text."""
    render_srt(segments, translated).write.mode("overwrite").partitionBy("video_id").text(folder)
