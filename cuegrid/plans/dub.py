"""The whole dubbing plan as one chain of DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.operators.jobs import fan_out
from cuegrid.operators.speakers import assign_speakers
from cuegrid.operators.subtitles import render_srt
from cuegrid.operators.timeline import align_plan
from cuegrid.operators.translation import char_budget, translated_or_copied
from cuegrid.operators.voices import merge_fragments, reference_lookup, references
from cuegrid.settings import Settings


def dub_plan(segments: DataFrame, turns: DataFrame, targets: list[str], settings: Settings = Settings()) -> DataFrame:
    """video_id, target_lang, index, speaker, text, budget, reference, position_ms, factor, stretched.

    What does not depend on the language (speakers, references, merging) is planned once; the
    fan-out comes last. Clips are as long as their text at the settings' speech rate.
    """
    spoken = assign_speakers(segments, turns)
    refs = references(spoken, settings)
    ready = spoken.withColumn("translated", translated_or_copied(settings, F.col("translated"), F.col("text")))
    merged = reference_lookup(merge_fragments(ready, settings), refs)
    merged = merged.withColumn("budget", char_budget(settings))
    clip = (F.length("text") * 1000 / settings.chars_per_second).cast("long")
    clips = merged.withColumn("clip_ms", clip)
    plan = clips.join(align_plan(clips, settings), ["video_id", "index"])
    out = fan_out(plan, targets).filter("supported")
    return out.select("video_id", "target_lang", "index", "speaker", "text", "budget", "reference", "position_ms", "factor", "stretched")


def subtitles_only(segments: DataFrame, targets: list[str], settings: Settings = Settings(), corrected: DataFrame | None = None) -> DataFrame:
    """Extension: video_id, target_lang, srt, without any audio. Lines of ``corrected`` (video_id, cue, text, as
    ``files.read_srt`` gives them) replace the text of the cue with that number before translation is taken."""
    rows = segments
    if corrected is not None:
        number = F.row_number().over(Window.partitionBy("video_id").orderBy("index"))
        better = corrected.select("video_id", F.col("cue").alias("own_cue"), F.col("text").alias("better"))
        rows = rows.withColumn("own_cue", number).join(better, ["video_id", "own_cue"], "left")
        rows = rows.withColumn("translated", F.when(F.col("better").isNotNull(), F.col("better")).otherwise(F.col("translated"))).select(*segments.columns)
    said = rows.withColumn("translated", translated_or_copied(settings, F.col("translated"), F.col("text")))
    return fan_out(render_srt(said), targets).select("video_id", "target_lang", "srt")


def dub_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("target_lang").agg(F.count("*").alias("segments"), F.count_if("stretched").alias("stretched"), F.max("factor").alias("max_factor"))
