"""What happens to a planned dub: which file is made how, and where it goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions import commands
from cuegrid.operators.jobs import newest_outputs, output_name
from cuegrid.operators.timeline import align_plan
from cuegrid.settings import Settings


def has_video(streams: DataFrame) -> DataFrame:
    """``streams`` (video_id, codec_type) as a probe lists them -> video_id, has_video."""
    return streams.groupBy("video_id").agg(F.coalesce(F.max(F.col("codec_type") == "video"), F.lit(False)).alias("has_video"))


def publish_plan(dubs: DataFrame, reencode: bool = False, subtitles: bool = False, font_size: int = 14) -> DataFrame:
    """``dubs`` (video_id, target_lang, video_path, audio_path, has_video) with ``out_path`` and the ``steps``
    (array of command lines) that make it. An audio-only source has no step but the copy of its track, which
    is null; subtitles are burnt into videos only."""
    wav, mp4, srt, subbed = (output_name(F.col("video_id").cast("string"), F.col("target_lang"), kind) for kind in ("wav", "mp4", "srt", "subbed.mp4"))
    mux = commands.mux_audio(F.col("video_path"), F.col("audio_path"), mp4, reencode)
    burn = [commands.burn_subtitles(mp4, srt, subbed, font_size)] if subtitles else []
    steps = F.when(F.col("has_video"), F.array(mux, *burn))
    return dubs.select("*", F.when(F.col("has_video"), subbed if subtitles else mp4).otherwise(wav).alias("out_path"), srt.alias("srt_path"), steps.alias("steps"))


def batch_publish(files: DataFrame) -> DataFrame:
    """``files`` (base, lang, kind, path, mtime) of all runs -> base, lang, source, destination, command: the
    newest medium and the newest subtitles of each language. A wav and subtitles are copied (command null),
    another medium becomes an uncompressed wav."""
    kind = F.when(F.col("kind").isin("mp4", "mkv", "wav", "mp3", "m4a"), "wav").when(F.col("kind") == "srt", "srt")
    newest = newest_outputs(files.select("base", "lang", "path", "mtime", F.col("kind").alias("suffix"), kind.alias("kind")).filter("kind is not null"))
    destination = F.concat_ws("/", "base", F.concat_ws(".", "lang", "kind"))
    command = F.when((F.col("kind") == "wav") & (F.col("suffix") != "wav"), commands.transcode_wav(F.col("path"), destination))
    return newest.select("base", "lang", F.col("path").alias("source"), destination.alias("destination"), command.alias("command"))


def timeline_export(clips: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The plan a renderer needs for each clip: video_id, index, position_ms, placed_ms, file, aligned_file,
    and the command that fits the clip (null where it is copied)."""
    plan = align_plan(clips, settings)
    source, aligned = (F.format_string(f"{name}_%04d.wav", "index") for name in ("seg", "aligned"))
    return plan.select("video_id", "index", "position_ms", "placed_ms", source.alias("file"), aligned.alias("aligned_file"), commands.time_stretch(source, aligned, F.col("factor")).alias("command"))


def write_timeline(clips: DataFrame, folder: str, settings: Settings = Settings()) -> None:
    """The export plan as Parquet, one folder a video."""
    timeline_export(clips, settings).write.mode("overwrite").partitionBy("video_id").parquet(folder)


def loudness_match(measured: DataFrame) -> DataFrame:
    """Extension: ``measured`` (video_id, target_lang, source_lufs, dub_lufs) with the gain that brings the dub
    to the source's loudness, and the filter that does so."""
    gain = F.col("source_lufs") - F.col("dub_lufs")
    return measured.select("*", gain.alias("gain_db"), F.concat(F.lit("loudnorm=I="), F.format_string("%.1f", F.bround("source_lufs", 1)), F.lit(":TP=-1.5:LRA=11")).alias("filter"))


def self_test(runs: DataFrame) -> DataFrame:
    """``runs`` (video_id, source_seconds, dub_seconds, source_voice, dub_voice) -> video_id, drift in seconds
    and timbre, the cosine of the two voice vectors (null if one is missing or zero)."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot("source_voice", "source_voice")) * F.sqrt(dot("dub_voice", "dub_voice"))
    return runs.select("video_id", F.abs(F.col("source_seconds") - F.col("dub_seconds")).alias("drift"), (dot("source_voice", "dub_voice") / F.when(norm > 0, norm)).alias("timbre"))


def fitted_segments(segments: DataFrame, fit: DataFrame) -> DataFrame:
    """Extension: segments with the times they have after fitting (``fit``: video_id, index, fit_ms, placed_ms),
    from which subtitles are rendered."""
    rows = segments.join(fit.select("video_id", "index", "fit_ms", "placed_ms"), ["video_id", "index"])
    start = F.col("fit_ms") / 1000.0
    return rows.withColumn("start", start).withColumn("end", start + F.col("placed_ms") / 1000.0).drop("fit_ms", "placed_ms")


def next_job(jobs: DataFrame) -> DataFrame:
    """job_id, place: the order in which a single worker takes the queued jobs, by time and id. One row a
    job is ordered; 0 runs next, jobs in progress come before and have none."""
    queued = jobs.filter("status = 'queued'")
    return queued.select("job_id", (F.row_number().over(Window.orderBy("ts", "job_id")) - 1).alias("place"))


def missing_outputs(ran: DataFrame, files: DataFrame, out: Column | None = None) -> DataFrame:
    """``ran`` (out_path, exit_code, stderr) with ``error``: the tool's message, cut to its last 2000
    characters, if it failed, and a message if it succeeded without leaving the file (``files``: path)."""
    path = F.col("out_path") if out is None else out
    found = files.select(F.col("path").alias("found_path")).distinct()
    rows = ran.join(found, path == F.col("found_path"), "left")
    failed = F.concat(F.lit("tool failed: "), F.right(F.coalesce("stderr", F.lit("")), F.lit(2000)))
    error = F.when(F.col("exit_code") != 0, failed).when(F.col("found_path").isNull(), F.lit("tool succeeded but left no file"))
    return rows.withColumn("error", error).drop("found_path")
