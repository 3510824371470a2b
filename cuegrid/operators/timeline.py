"""Fitting clips into their slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.operators.translation import duration
from cuegrid.settings import Settings

#: Shorter slots are left alone.
MIN_WINDOW = 0.05


def trimmed_ms(length: Column, lead: Column, trail: Column) -> Column:
    """Clip length without silence at both ends; unchanged if it is silent throughout."""
    return F.when(length - trail > lead, length - trail - lead).otherwise(length)


def stretch_factor(settings: Settings = Settings()) -> Column:
    """Above 1 the clip is sped up (capped), below 1 slowed down (always by the cap)."""
    window, clip = duration(), F.col("clip_ms") / 1000.0
    usable = window > MIN_WINDOW
    # The division is only reached for usable windows.
    faster = F.least(clip / F.when(usable, window), F.lit(settings.max_speedup))
    return F.when(usable & (clip > window), faster).when(usable & (clip < window * settings.max_slowdown), F.lit(settings.max_slowdown)).otherwise(F.lit(1.0))


def align_plan(clips: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """video_id, index, position_ms, factor, stretched, placed_ms of every clip that has audio."""
    voiced = clips.filter(F.col("clip_ms").isNotNull()).withColumn("factor", stretch_factor(settings))
    stretched = F.abs(F.col("factor") - 1.0) > 1e-3
    placed = F.when(stretched, (F.col("clip_ms") / F.col("factor")).cast("long")).otherwise(F.col("clip_ms"))
    return voiced.select("video_id", "index", (F.col("start") * 1000).cast("long").alias("position_ms"), "factor", stretched.alias("stretched"), placed.alias("placed_ms"))


def align_report(clips: DataFrame, settings: Settings = Settings(), total: Column | None = None, strict: bool = False) -> DataFrame:
    """Per video: clips, stretched ones, extreme factors, timeline length. ``strict`` raises for a video
    without any audio."""
    total = F.lit(0.0) if total is None else total
    rows = clips.withColumn("factor", stretch_factor(settings)).withColumn("__total", total)
    voiced = F.col("clip_ms").isNotNull()
    out = rows.groupBy("video_id").agg(
        F.count("clip_ms").alias("clips"),
        F.count_if(voiced & (F.abs(F.col("factor") - 1.0) > 1e-3)).alias("stretched"),
        F.max(F.when(voiced, F.col("factor"))).alias("max_factor"),
        F.min(F.when(voiced, F.col("factor"))).alias("min_factor"),
        ((F.greatest(F.max("__total"), F.max(F.when(voiced, F.col("end")))) * 1000).cast("long") + 200).alias("timeline_ms"),
    )
    if strict:
        ok = F.assert_true(F.col("clips") > 0, F.concat(F.lit("no audio to align in video "), F.col("video_id").cast("string")))
        out = out.withColumn("clips", F.when(ok.isNull(), F.col("clips")))
        return out
    return out.filter("clips > 0")


def timeline_fit(clips: DataFrame) -> DataFrame:
    """Extension: starts so that no clip overlaps the one before and none is early.

    s_i = max(start_i, s_(i-1) + d_(i-1)) unrolls to D_(i-1) + max over j <= i of (start_j - D_(j-1)), D
    being the running sum of lengths: two window passes, no recursion.
    """
    order = Window.partitionBy("video_id").orderBy("index")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = clips.filter("clip_ms is not null").withColumn("source_ms", (F.col("start") * 1000).cast("long"))
    rows = rows.withColumn("played", F.coalesce(F.sum("clip_ms").over(before), F.lit(0)))
    lag = F.max(F.col("source_ms") - F.col("played")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("fit_ms", F.col("played") + lag)
    return rows.select("video_id", "index", "source_ms", "fit_ms", (F.col("fit_ms") - F.col("source_ms")).alias("delay_ms"))


def exact_fit(clips: DataFrame, totals: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Extension: video_id, index, source_ms, fit_ms, placed_ms, factor, pad_ms for ``totals`` (video_id, total_ms):
    starts as in ``timeline_fit``, and an end that is exactly the total where the cap allows it.

    Overflow moves later clips into the silences first. What would still end after the total is
    compressed, as little as that takes and by at most ``max_speedup``: in a run of clips that touch each
    other up to the end, every clip takes the same factor. A plan that is short is padded with silence.
    """
    order = Window.partitionBy("video_id").orderBy("index")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fit = timeline_fit(clips).join(clips.select("video_id", "index", "clip_ms"), ["video_id", "index"]).join(totals, "video_id")
    end = F.max(F.col("fit_ms") + F.col("clip_ms")).over(whole)
    # Clips that start where they should begin a run; the last run is what can be compressed.
    run = F.max(F.when(F.col("delay_ms") == 0, F.col("index"))).over(whole)
    begin = F.max(F.when(F.col("delay_ms") == 0, F.col("source_ms"))).over(whole)
    rows = fit.withColumn("run", run).withColumn("begin", begin).withColumn("end", end)
    length = F.col("end") - F.col("begin")
    room = F.greatest(F.col("total_ms") - F.col("begin"), F.lit(1))
    wanted = F.when(F.col("end") > F.col("total_ms"), F.least(length / room, F.lit(settings.max_speedup))).otherwise(F.lit(1.0))
    rows = rows.withColumn("factor", F.when(F.col("index") >= F.col("run"), wanted).otherwise(F.lit(1.0)))
    squeezed = lambda ms: F.col("begin") + F.floor((ms - F.col("begin")) / F.col("factor"))
    start = F.when(F.col("factor") > 1.0, F.greatest(squeezed(F.col("fit_ms")), F.col("source_ms"))).otherwise(F.col("fit_ms"))
    stop = F.when(F.col("factor") > 1.0, squeezed(F.col("fit_ms") + F.col("clip_ms"))).otherwise(F.col("fit_ms") + F.col("clip_ms"))
    rows = rows.withColumn("start_ms", start.cast("long")).withColumn("placed_ms", F.greatest(F.lit(0), stop - start).cast("long"))
    pad = F.greatest(F.lit(0), F.col("total_ms") - F.max(F.col("start_ms") + F.col("placed_ms")).over(whole))
    return rows.select("video_id", "index", "source_ms", F.col("start_ms").alias("fit_ms"), "placed_ms", "factor", pad.cast("long").alias("pad_ms"))


def slack_budget(segments: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Extension: characters that fit until the next segment starts (the last one: its own slot)."""
    nxt = F.coalesce(F.lead("start").over(Window.partitionBy("video_id").orderBy("index")), F.col("end"))
    return segments.select("video_id", "index", (F.greatest(F.lit(0.0), nxt - F.col("start")) * settings.chars_per_second).cast("int").alias("budget"))


def overflow_report(clips: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Extension: per video the share of stretched clips and how far clips run into the next one."""
    plan = align_plan(clips, settings)
    nxt = F.lead("position_ms").over(Window.partitionBy("video_id").orderBy("index"))
    over = plan.withColumn("over_ms", F.greatest(F.lit(0), F.col("position_ms") + F.col("placed_ms") - nxt))
    return over.groupBy("video_id").agg(F.count("*").alias("clips"), F.count_if("stretched").alias("stretched"), F.count_if(F.col("over_ms") > 0).alias("overflowing"), F.coalesce(F.max("over_ms"), F.lit(0)).cast("long").alias("worst_over_ms"))


def clean_references(segments: DataFrame) -> DataFrame:
    """Extension: each voice's longest segment that no other segment overlaps."""
    order = Window.partitionBy("video_id").orderBy("start", "index")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    alone = segments.select("*", reach.alias("__reach"), F.lead("start").over(order).alias("__next")).filter("(__reach is null or __reach <= start) and (__next is null or __next >= end)")
    best = F.row_number().over(Window.partitionBy("video_id", "speaker").orderBy(F.desc(duration()), "index"))
    return alone.withColumn("__best", best).filter("__best = 1").select("video_id", "speaker", "index", duration().alias("seconds"))
