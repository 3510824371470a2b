"""Voice references and fragments too short to be spoken."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions.text import or_else, strip
from cuegrid.settings import Settings

_PUNCTUATION = ".,!?…"
_STATE = "struct<out:array<struct<index:bigint,speaker:string,text:string>>,carry:string,speaker:string>"


def reference_clips(segments: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The slices each voice's reference is made of: in order, while less than the cap is gathered; the
    last one is cut at the cap. video_id, speaker, index, from_ms, take_ms."""
    cap = settings.reference_ms
    from_ms, to_ms = (F.col("start") * 1000).cast("long"), (F.col("end") * 1000).cast("long")
    rows = segments.select("video_id", "speaker", "index", from_ms.alias("from_ms"), F.greatest(F.lit(0), to_ms - from_ms).alias("ms"))
    before = Window.partitionBy("video_id", "speaker").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("gathered", F.coalesce(F.sum("ms").over(before), F.lit(0))).filter(F.col("gathered") < cap)
    return rows.select("video_id", "speaker", "index", "from_ms", F.least("ms", F.lit(cap) - F.col("gathered")).alias("take_ms"))


def references(segments: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """video_id, speaker, first_index, ms, path: one reference per voice (null is a voice); a voice
    without audio takes the head of the track."""
    cap = settings.reference_ms
    rows = reference_clips(segments, settings).groupBy("video_id", "speaker").agg(F.min("index").alias("first_index"), F.sum("take_ms").alias("ms"))
    path = F.when(F.col("speaker").isNull(), F.lit("reference.wav")).otherwise(F.concat(F.lit("reference_"), "speaker", F.lit(".wav")))
    return rows.select("video_id", "speaker", "first_index", F.when(F.col("ms") > 0, F.col("ms")).otherwise(F.lit(cap)).cast("long").alias("ms"), path.alias("path"))


def reference_lookup(segments: DataFrame, refs: DataFrame) -> DataFrame:
    """Segments with ``reference``: the voice's own, else the unlabelled voice's, else the first one."""
    default = refs.groupBy("video_id").agg(F.min(F.struct(F.col("speaker").isNotNull().alias("named"), "first_index", "path")).alias("d"))
    own = refs.select(F.col("video_id").alias("r_video"), F.col("speaker").alias("r_speaker"), "path")
    rows = segments.join(own, (F.col("video_id") == F.col("r_video")) & F.col("speaker").eqNullSafe(F.col("r_speaker")), "left")
    rows = rows.join(default, "video_id", "left")
    return rows.select(*[F.col(c) for c in segments.columns], F.coalesce("path", "d.path").alias("reference"))


def merge_fragments(segments: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Segments whose text is long enough to be spoken, with shorter ones merged into the next segment
    of the same voice (at the end of a video, the last one).

    video_id, index, speaker, start, end, text. A fragment waiting for its voice is replaced by the next
    fragment of another voice; the row that takes it over keeps its own times and is tested again.
    """
    said = strip(or_else(F.col("translated"), F.col("text")))
    videos = segments.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(F.col("index").cast("long").alias("index"), "speaker", said.alias("text")))).alias("rows"))

    def step(acc, x):
        joins = (acc["carry"] != "") & acc["speaker"].eqNullSafe(x["speaker"])
        body = F.when(joins, strip(F.concat(acc["carry"], F.lit(" "), x["text"]))).otherwise(x["text"])
        short = F.length(F.rtrim(body, F.lit(_PUNCTUATION))) < settings.min_fragment_chars
        held = F.struct(acc["out"].alias("out"), body.alias("carry"), x["speaker"].alias("speaker"))
        row = F.struct(x["index"].alias("index"), x["speaker"].alias("speaker"), body.alias("text"))
        rest = F.when(joins, F.lit("")).otherwise(acc["carry"])
        emitted = F.struct(F.array_append(acc["out"], row).alias("out"), rest.alias("carry"), F.when(joins, F.lit(None)).otherwise(acc["speaker"]).alias("speaker"))
        return F.when(short, held).otherwise(emitted).cast(_STATE)

    empty = F.struct(F.array().alias("out"), F.lit("").alias("carry"), F.lit(None).alias("speaker")).cast(_STATE)
    folded = videos.select("video_id", F.aggregate("rows", empty, step).alias("f"))
    last = F.array_max(F.transform(F.filter("f.out", lambda r: r["speaker"].eqNullSafe(F.col("f.speaker"))), lambda r: r["index"]))
    folded = folded.withColumn("last", F.when(F.col("f.carry") != "", last))
    rows = folded.select("video_id", "last", "f.carry", F.explode("f.out").alias("r"))
    text = F.when(F.col("r.index") == F.col("last"), F.concat("r.text", F.lit(" "), "carry")).otherwise(F.col("r.text"))
    rows = rows.select("video_id", F.col("r.index").cast(segments.schema["index"].dataType).alias("index"), "r.speaker", text.alias("text"))
    return rows.join(segments.select("video_id", "index", "start", "end"), ["video_id", "index"]).select("video_id", "index", "speaker", "start", "end", "text")
