"""Command lines of the external media tools, as array columns. Nothing here runs them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuegrid.functions.text import atempo_chain, filter_path


# The argument lists below are what the tools are called with.
def _line(*parts: Column | str) -> Column:
    return F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def extract_audio(src: Column, dst: Column, rate: int = 16_000) -> Column:
    return _line("ffmpeg", "-y", "-i", src, "-vn", "-ar", str(rate), "-ac", "1", dst)


def time_stretch(src: Column, dst: Column, factor: Column) -> Column:
    """Null where the factor is close enough to 1 for a plain copy."""
    return F.when(F.abs(factor - 1.0) >= 1e-3, _line("ffmpeg", "-y", "-i", src, "-filter:a", atempo_chain(factor), "-ar", "24000", dst))


def mux_audio(video: Column, audio: Column, out: Column, reencode: bool = False) -> Column:
    codec = ["-c:v", "libx264", "-pix_fmt", "yuv420p", "-profile:v", "high", "-crf", "23"] if reencode else ["-c:v", "copy"]
    tail = ["-c:a", "aac", "-b:a", "192k", "-movflags", "+faststart", "-shortest"]
    return _line("ffmpeg", "-y", "-i", video, "-i", audio, "-map", "0:v:0", "-map", "1:a:0", *codec, *tail, out)


def faststart_remux(src: Column, dst: Column) -> Column:
    return _line("ffmpeg", "-y", "-i", src, "-c:v", "copy", "-c:a", "aac", "-b:a", "192k", "-movflags", "+faststart", dst)


def transcode_wav(src: Column, dst: Column, rate: int | None = None) -> Column:
    """Sound alone, uncompressed; at ``rate`` if given (48,000 for delivery)."""
    return _line("ffmpeg", "-y", "-loglevel", "error", "-i", src, "-vn", "-acodec", "pcm_s16le", *(["-ar", str(rate)] if rate else []), dst)


def probe_streams(src: Column) -> Column:
    """Prints the kind of the first video stream, or nothing."""
    return _line("ffprobe", "-v", "error", "-select_streams", "v:0", "-show_entries", "stream=codec_type", "-of", "csv=p=0", src)


def burn_subtitles(video: Column, srt: Column, out: Column, font_size: int = 14) -> Column:
    style = f"FontName=DejaVu Sans,FontSize={font_size},Alignment=2,MarginV=10,Outline=1,Shadow=0,BorderStyle=1"
    filters = F.concat(F.lit("subtitles="), filter_path(srt), F.lit(f":force_style='{style}'"))
    return _line("ffmpeg", "-y", "-i", video, "-vf", filters, "-c:a", "copy", "-movflags", "+faststart", out)


def lip_sync(python: Column, folder: Column, checkpoint: Column, face: Column, audio: Column, out: Column) -> Column:
    script = F.concat(folder, F.lit("/inference.py"))
    return _line(python, script, "--checkpoint_path", checkpoint, "--face", face, "--audio", audio, "--outfile", out)
