"""File sources: term lists, style notes, media folders and subtitle files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrid.functions.text import file_stem, strip


def _useful_lines(text: Column) -> Column:
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), strip)
    return F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("#")))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Through Hadoop's file system, whatever store the path is in; false for what is no path at all."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    except Exception:  # literal text is rarely a valid path
        return False


def read_glossary(spark: SparkSession, path: str | None) -> DataFrame:
    """ord, term: the list's lines in order, without blanks and # comments; none if there is no such file."""
    if not path or not path_exists(spark, path):
        return spark.createDataFrame([], "ord int, term string")
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.posexplode(_useful_lines(F.col("value"))).alias("ord", "term"))


def read_synopsis(spark: SparkSession, given: str | None) -> DataFrame:
    """text: one row with the synopsis, without blank lines and # comments. ``given`` is a path or the text
    itself; nothing at all gives an empty text."""
    if given and path_exists(spark, given):
        rows = spark.read.text(given, wholetext=True).select("value")
    else:
        rows = spark.createDataFrame([(given or "",)], "value string")
    return rows.select(F.array_join(_useful_lines(F.col("value")), "\n").alias("text"))


def pick_style(styles: DataFrame, style: str) -> DataFrame:
    """The row of ``styles`` (style, text) asked for; an unknown style raises and names the known ones."""
    known = styles.agg(F.array_sort(F.collect_set("style")).alias("known"), F.max_by("text", F.col("style") == style).alias("text"))
    missing = F.raise_error(F.concat(F.lit(f"no style called {style}; available: "), F.array_join("known", ", "))).cast("string")
    return known.select(F.lit(style).alias("style"), F.when(F.array_contains("known", style), F.col("text")).otherwise(missing).alias("text"))


def read_styles(spark: SparkSession, folder: str) -> DataFrame:
    """style, text: one row per *.txt file, comments dropped."""
    rows = spark.read.text(f"{folder}/*.txt", wholetext=True).select("value", "_metadata.file_name")
    return rows.select(file_stem(F.col("file_name")).alias("style"), F.array_join(_useful_lines(F.col("value")), "\n").alias("text"))


def read_media(spark: SparkSession, folder: str) -> DataFrame:
    """video_id (file stem), path, bytes and modification time of the media files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(file_stem(F.col("path")).alias("video_id"), "path", F.col("length").alias("bytes"), "modificationTime")


def acquire_local(media: DataFrame, probes: DataFrame, folder: str) -> DataFrame:
    """``media`` (video_id, path) -> video_id, path, seconds, track, command: the sound track at 16 kHz that is to
    be made, how, and the duration from ``probes`` (path, answer), 0 where it is no number or missing."""
    from cuegrid.functions.commands import extract_audio

    track = F.concat(F.lit(folder.rstrip("/") + "/"), F.col("video_id").cast("string"), F.lit(".wav"))
    answers = probes.groupBy("path").agg(F.min("answer").alias("answer"))
    rows = media.join(answers, "path", "left")
    return rows.select("video_id", "path", parse_duration(F.col("answer")).alias("seconds"), track.alias("track"), extract_audio(F.col("path"), track).alias("command"))


def parse_duration(text: Column) -> Column:
    """Seconds; 0 where the probe's answer is no number."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """video_id, cue, start, end, text from subtitle files, for correcting and planning again."""
    rows = spark.read.text(path, wholetext=True).select(file_stem(F.col("_metadata.file_name")).alias("video_id"), "value")
    blocks = rows.select("video_id", F.explode(F.split(strip(F.replace("value", F.lit("\r"), F.lit(""))), r"\n[ \t]*\n+")).alias("block"))
    number = r"^(\d+)\n(\d+):(\d+):(\d+),(\d+) --> (\d+):(\d+):(\d+),(\d+)\n?(?s)(.*)$"
    part = lambda k: F.regexp_extract("block", number, k)
    seconds = lambda k: ((part(k).cast("long") * 60 + part(k + 1).cast("long")) * 60 + part(k + 2).cast("long")) + part(k + 3).cast("long") / 1000
    return blocks.filter(F.col("block").rlike(number)).select("video_id", part(1).cast("int").alias("cue"), seconds(2).alias("start"), seconds(6).alias("end"), part(10).alias("text"))
