"""Scalar text functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: the pattern of an 11-character id in a url.
_VIDEO_ID = r"(?:v=|/shorts/|youtu\.be/|/)([0-9A-Za-z_-]{11})(?:[?&/]|$)"


def strip(text: Column) -> Column:
    """Without Unicode blanks at either end (``trim`` knows only the space)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def or_else(first: Column, other: Column) -> Column:
    """``first`` unless it is null or empty."""
    return F.coalesce(F.nullif(first, F.lit("")), other)


# Fixed value: what closes a sentence.
SENTENCE_END = r"[.!?…。！？]+[\"'”’)]?\s*$"


def ends_sentence(word: Column) -> Column:
    """The word closes a sentence: final punctuation, perhaps one closing quote or bracket, then blanks."""
    return word.rlike("(?U)" + SENTENCE_END)


def video_id(url: Column) -> Column:
    """The id of a video url; null if there is none."""
    return F.nullif(F.regexp_extract(url, _VIDEO_ID, 1), F.lit(""))


def file_stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def srt_timestamp(seconds: Column) -> Column:
    """HH:MM:SS,mmm; negative times are 0, milliseconds round half to even, hours are unbounded."""
    ms = F.rint(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    hours, minutes, secs = (F.floor(ms / n) for n in (3_600_000, 60_000, 1_000))
    return F.format_string("%02d:%02d:%02d,%03d", hours, minutes % 60, secs % 60, ms % 1000)


def atempo_chain(factor: Column) -> Column:
    """Tempo filters of 0.5 to 2 each whose product is the factor clamped to 0.25 to 4."""
    f = F.least(F.greatest(factor, F.lit(0.25)), F.lit(4.0))
    stages = F.when(f > 2, F.array(F.lit(2.0), f / 2)).when(f < 0.5, F.array(F.lit(0.5), f / 0.5)).otherwise(F.array(f))
    # Rounds the number itself, as printf does; bround and format_string round its shortest decimals.
    return F.array_join(F.transform(stages, lambda x: F.concat(F.lit("atempo="), F.format_number(x, 6))), ",")


# The patterns of what a model puts around its answer.
_THINKING, _FENCE_OPEN, _FENCE_CLOSE = r"(?s)<think>.*?</think>", r"^```[a-zA-Z]*\n?", r"\n?```$"
_LABEL = r"(?i)^(translation|translated text|output)(?U)\s*:\s*"


def clean_reply(text: Column) -> Column:
    """A model's reply without thinking, code fences, one layer of quotes and a leading label, in that
    order (quotes behind a label therefore stay)."""
    bare = strip(F.regexp_replace(text, _THINKING, ""))
    bare = F.regexp_replace(bare, _FENCE_OPEN, "")
    bare = strip(F.regexp_replace(bare, _FENCE_CLOSE, ""))
    first = F.substring(bare, 1, 1)
    quoted = (F.length(bare) > 1) & first.isin('"', "'") & (first == F.right(bare, F.lit(1)))
    bare = F.when(quoted, strip(F.substring(bare, F.lit(2), F.length(bare) - 2))).otherwise(bare)
    return strip(F.regexp_replace(bare, _LABEL, ""))


def filter_path(path: Column) -> Column:
    """A path escaped for a subtitle filter argument."""
    out = path
    for mark in ("\\", ":", "'"):
        out = F.replace(out, F.lit(mark), F.lit("\\" + mark))
    return out
