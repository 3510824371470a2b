"""Source choice, package lookup, and checks before and after translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions.text import file_stem, or_else


def dispatch_sources(requests: DataFrame, media: DataFrame) -> DataFrame:
    """``requests`` (source) -> source, kind, video_id: a path among ``media`` (path) is local and named by
    its stem, everything else is a download."""
    known = media.select(F.col("path").alias("source"), F.lit(True).alias("local")).distinct()
    rows = requests.join(known, "source", "left")
    return rows.select("source", F.when(F.col("local"), "local").otherwise("download").alias("kind"), F.when(F.col("local"), file_stem(F.col("source"))).alias("video_id"))


def pick_format(formats: DataFrame) -> DataFrame:
    """``formats`` (video_id, rank, format) -> the available one with the lowest rank per video."""
    return formats.groupBy("video_id").agg(F.min(F.struct("rank", "format")).alias("f")).select("video_id", "f.format")


def set_options(**options: Column) -> Column:
    """A map of the options that are set."""
    pairs = [x for k, v in options.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def with_package(rows: DataFrame, packages: DataFrame, strict: bool = True) -> DataFrame:
    """``rows`` (source_lang, target_lang) with their translation ``package`` (from_code, to_code, package);
    a missing pair raises, or is null if not strict."""
    right = packages.groupBy(F.col("from_code").alias("source_lang"), F.col("to_code").alias("target_lang")).agg(F.min("package").alias("package"))
    out = rows.join(right, ["source_lang", "target_lang"], "left")
    if not strict:
        return out
    missing = F.raise_error(F.concat(F.lit("no package for "), "source_lang", F.lit(" to "), "target_lang")).cast("string")
    return out.withColumn("package", F.when(F.col("package").isNull(), missing).otherwise(F.col("package")))


def translation_batches(segments: DataFrame, size: int = 30, overlap: int = 5) -> DataFrame:
    """Extension: video_id, batch, index, is_context. Batches of ``size`` lines; the last ``overlap``
    lines of each are repeated in front of the next as context."""
    nth = F.row_number().over(Window.partitionBy("video_id").orderBy("index")) - 1
    rows = segments.select("video_id", "index", nth.alias("n"), F.max("index").over(Window.partitionBy("video_id")).alias("last"))
    own = F.floor(F.col("n") / size).cast("int")
    again = (F.col("n") % size >= size - overlap) & (F.col("index") < F.col("last"))
    batches = F.when(again, F.array(F.struct(own.alias("batch"), F.lit(False).alias("is_context")), F.struct((own + 1).alias("batch"), F.lit(True).alias("is_context"))))
    batches = batches.otherwise(F.array(F.struct(own.alias("batch"), F.lit(False).alias("is_context"))))
    return rows.select("video_id", "index", F.explode(batches).alias("b")).select("video_id", "b.batch", "index", "b.is_context")


def overshoots(segments: DataFrame, budget: Column) -> DataFrame:
    """Extension: video_id, index, chars, budget of the lines that are longer than their budget."""
    said = F.length(or_else(F.col("translated"), F.col("text")))
    rows = segments.select("video_id", "index", said.alias("chars"), budget.alias("budget"))
    return rows.filter("chars > budget")


def shorten_overshoots(segments: DataFrame, budget: Column, shorten, rounds: int = 2) -> DataFrame:
    """Extension: ``segments`` with ``translated`` no longer than its budget where ``shorten`` (text, budget ->
    text, columns) manages it in at most ``rounds`` attempts, and ``attempts``, how many a line took. An
    attempt that does not get shorter changes nothing. A bounded unrolling, no loop over rows."""
    out = segments.withColumn("attempts", F.lit(0))
    said = or_else(F.col("translated"), F.col("text"))
    for _ in range(rounds):
        over = F.length(said) > budget
        shorter = shorten(said, budget)
        better = over & (F.length(shorter) < F.length(said)) & (shorter != "")
        out = out.withColumns({"translated": F.when(better, shorter).otherwise(F.col("translated")), "attempts": F.col("attempts") + F.coalesce(over.cast("int"), F.lit(0))})
    return out


def context_load(batches: DataFrame, limit_tokens: int, chars_per_token: float = 4.0) -> DataFrame:
    """Extension: video_id, batch, tokens of ``batches`` (video_id, batch, text); one too large for the
    model's context raises."""
    rows = batches.groupBy("video_id", "batch").agg(F.ceil(F.sum(F.length("text")) / chars_per_token).alias("tokens"))
    fits = F.assert_true(F.col("tokens") <= limit_tokens, F.concat(F.lit("batch too large for the context in video "), F.col("video_id").cast("string")))
    return rows.select("video_id", "batch", F.when(fits.isNull(), F.col("tokens")).alias("tokens"))


def split_by_confidence(segments: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Extension: segments whose ``confidence`` is high enough (or unknown), and the dropped ones."""
    low = F.coalesce(F.col("confidence") < least, F.lit(False))
    return segments.filter(~low), segments.filter(low)
