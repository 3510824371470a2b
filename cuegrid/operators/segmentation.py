"""Words to sentence segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions.text import ends_sentence, strip
from cuegrid.settings import Settings

_STATE = "struct<out:array<struct<start:double,end:double,text:string>>,text:string,start:double,end:double>"


def sentence_segments(words: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``words`` (video_id, pos, start, end, word) -> video_id, index, start, end, text.

    A segment ends behind sentence punctuation, before a pause, or once it has reached the caps (the
    word that reaches them is still in). The first two are windows and cut a video into groups; as any
    end resets everything, the caps are then folded inside each group alone, and only where they can bind.
    Blank segments vanish and take no index.
    """
    order = Window.partitionBy("video_id").orderBy("pos")
    pause = F.coalesce(F.lead("start").over(order) - F.col("end") > settings.max_gap, F.lit(False))
    marked = words.withColumn("__cut", (ends_sentence(F.col("word")) | pause).cast("int"))
    group = F.coalesce(F.sum("__cut").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = marked.withColumn("__group", group).groupBy("video_id", "__group").agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end", "word"))).alias("w"))
    text = strip(F.array_join("w.word", ""))
    first, last = F.element_at("w", 1)["start"], F.element_at("w", -1)["end"]
    whole = F.array(F.struct(first.alias("start"), last.alias("end"), text.alias("text")))
    loose = (F.length(F.array_join("w.word", "")) < settings.max_chars) & (last - first < settings.max_duration)

    def step(acc, x):
        body = F.concat(acc["text"], x["word"])
        since = F.coalesce(acc["start"], x["start"])
        done = F.struct(since.alias("start"), x["end"].alias("end"), strip(body).alias("text"))
        full = (F.length(strip(body)) >= settings.max_chars) | (x["end"] - since >= settings.max_duration)
        flushed = F.struct(F.array_append(acc["out"], done).alias("out"), F.lit("").alias("text"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"))
        going = F.struct(acc["out"].alias("out"), body.alias("text"), since.alias("start"), x["end"].alias("end"))
        return F.when(full, flushed).otherwise(going).cast(_STATE)

    def finish(acc):
        rest = F.struct(acc["start"].alias("start"), acc["end"].alias("end"), strip(acc["text"]).alias("text"))
        return F.when(acc["start"].isNotNull(), F.array_append(acc["out"], rest)).otherwise(acc["out"])

    empty = F.struct(F.array().alias("out"), F.lit("").alias("text"), F.lit(None).alias("start"), F.lit(None).alias("end")).cast(_STATE)
    folded = F.aggregate("w", empty, step, finish)
    rows = grouped.select("video_id", "__group", F.posexplode(F.when(loose, whole).otherwise(folded)).alias("k", "s")).filter("s.text <> ''")
    index = F.row_number().over(Window.partitionBy("video_id").orderBy("__group", "k")) - 1
    return rows.select("video_id", index.alias("index"), "s.start", "s.end", "s.text")


def segment_fallback(words: DataFrame, raw: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Sentence segments; videos without any word fall back to their raw segments (video_id, seq, start,
    end, text), stripped, non-blank, with a dense index."""
    built = sentence_segments(words.filter("word <> ''"), settings)
    bare = raw.join(words.filter("word <> ''").select("video_id").distinct(), "video_id", "left_anti")
    bare = bare.select("video_id", "seq", "start", "end", strip(F.col("text")).alias("text")).filter("text <> ''")
    index = F.row_number().over(Window.partitionBy("video_id").orderBy("seq")) - 1
    return built.unionByName(bare.select("video_id", index.alias("index"), "start", "end", "text"))


def explode_transcript(asr: DataFrame) -> DataFrame:
    """Raw segments with their word lists -> the word view, empty words dropped."""
    rows = asr.select("video_id", "seq", F.posexplode("words").alias("k", "w")).filter("w.word <> ''")
    pos = F.row_number().over(Window.partitionBy("video_id").orderBy("seq", "k")) - 1
    return rows.select("video_id", pos.alias("pos"), "w.start", "w.end", "w.word")
