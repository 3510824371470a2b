"""Slots for speech models and downloads: downloaders, transcribers, diarizers, voice embeddings,
translators and voices as table functions.

A backend is looked up by its lower-cased name; the ones here are deterministic stand-ins, and more are
added with ``register``. Model objects are built once per Python worker and kept. A row that fails
keeps its place with an error, it never fails the task.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cuegrid.settings import Settings

#: (text, source, target, budget) -> text
Translator = Callable[[str, str, str, int | None], str]
#: (text, language) -> milliseconds of speech
Voice = Callable[[str, str], int]

#: (url) -> (path, seconds)
Downloader = Callable[[str], tuple[str, float]]
#: (path, language or None) -> (segments as (start, end, text, [(start, end, word)]), detected language)
Transcriber = Callable[[str, str | None], tuple[list[tuple], str]]
#: (path) -> turns as (start, end, speaker)
Diarizer = Callable[[str], list[tuple[float, float, str]]]
#: (path, start, end) -> the vector of the voice between these seconds
Embedder = Callable[[str, float, float], list[float]]

_SLOTS: dict[str, dict[str, Callable[[], Callable]]] = {kind: {} for kind in ("downloader", "transcriber", "diarizer", "embedder", "translator", "voice")}


def register(kind: str, name: str, factory: Callable) -> None:
    _SLOTS[kind][name.lower()] = factory


@lru_cache(maxsize=None)
def model(kind: str, name: str) -> Callable:
    known = _SLOTS[kind]
    if name.lower() not in known:
        raise ValueError(f"unknown {kind} {name!r}; known: {sorted(known)}")
    return known[name.lower()]()


def translator(name: str) -> Translator:
    return model("translator", name)


def voice(name: str) -> Voice:
    return model("voice", name)


def _steady_words(path: str, language: str | None) -> tuple[list[tuple], str]:
    """Stand-in: the words of the path itself, half a second each, four to a segment."""
    words = [(0.5 * i, 0.5 * i + 0.4, " " + w) for i, w in enumerate(re.findall(r"[^\W_]+", path))]
    groups = [words[i : i + 4] for i in range(0, len(words), 4)]
    return [(g[0][0], g[-1][1], "".join(w for *_, w in g), g) for g in groups], language or "en"


def _digest_vector(path: str, start: float, end: float) -> list[float]:
    """Stand-in: a unit vector that depends on its arguments alone."""
    raw = [b - 127.5 for b in hashlib.sha256(f"{path} {start:.3f} {end:.3f}".encode()).digest()[:16]]
    norm = math.sqrt(sum(x * x for x in raw))
    return [x / norm for x in raw]


register("downloader", "named", lambda: lambda url: (f"{hashlib.md5(url.encode()).hexdigest()}.mp4", float(len(url))))
register("transcriber", "steady", lambda: _steady_words)
register("diarizer", "alternating", lambda: lambda path: [(2.0 * i, 2.0 * i + 2.0, f"SPK{i % 2}") for i in range(1 + len(path) % 5)])
register("embedder", "digest", lambda: _digest_vector)
register("translator", "echo", lambda: lambda text, source, target, budget: f"[{target}] {text}"[: budget or None])
register("voice", "steady", lambda: lambda text, language: 1000 * len(text) // 15)


def _apply(rows: DataFrame, kind: str, backend: str, arguments: list[str], call: Callable, fields: str) -> DataFrame:
    """A slot applied to each row of (video_id, *arguments); ``call`` makes rows of ``fields`` from the model and
    the arguments. A row that fails gives one row with nothing but ``error``."""
    schema = f"video_id {dict(rows.dtypes)['video_id']}, {fields}, error string"
    shape = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    names = shape.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    found = call(model(kind, backend), *[row[a] for a in arguments])
                    out += [dict(zip(names, (row["video_id"], *values, None), strict=True)) for values in found]
                except Exception as e:  # the row keeps its place, the task goes on
                    out.append({"video_id": row["video_id"], "error": str(e)[:2000]})
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    return rows.select("video_id", *arguments).mapInArrow(run, schema)


def download(requests: DataFrame, backend: str = "named") -> DataFrame:
    """``requests`` (video_id, url) -> video_id, path, seconds, error."""
    return _apply(requests, "downloader", backend, ["url"], lambda get, url: [get(url)], "path string, seconds double")


def transcribe(media: DataFrame, backend: str = "steady", language: str | None = None) -> DataFrame:
    """``media`` (video_id, path) -> video_id, seq, start, end, text, words, detected, error: the shape that
    ``segmentation.explode_transcript`` and ``segment_fallback`` take. A medium without speech has no row."""

    def call(hear, path):
        segments, detected = hear(path, language)
        words = lambda own: [{"start": a, "end": b, "word": w} for a, b, w in own]
        return [(seq, start, end, text, words(own), detected) for seq, (start, end, text, own) in enumerate(segments)]

    return _apply(media, "transcriber", backend, ["path"], call, "seq int, start double, end double, text string, words array<struct<start:double,end:double,word:string>>, detected string")


def require_transcripts(media: DataFrame, segments: DataFrame) -> DataFrame:
    """``media`` (video_id) with ``segments``, their number; a video without any raises, with the others' ids left alone."""
    counts = segments.groupBy("video_id").agg(F.count("*").alias("segments"))
    rows = media.join(counts, "video_id", "left")
    heard = F.assert_true(F.col("segments").isNotNull(), F.concat(F.lit("no speech was found in video "), F.col("video_id").cast("string")))
    return rows.withColumn("segments", F.when(heard.isNull(), F.col("segments")))


def diarize(media: DataFrame, backend: str = "alternating") -> DataFrame:
    """``media`` (video_id, path) -> video_id, ord, start, end, speaker, error: turns from a model that hears
    them, as ``speakers.assign_speakers`` takes them."""
    call = lambda listen, path: [(i, *turn) for i, turn in enumerate(listen(path))]
    return _apply(media, "diarizer", backend, ["path"], call, "ord int, start double, end double, speaker string")


def embed_segments(segments: DataFrame, backend: str = "digest") -> DataFrame:
    """``segments`` (video_id, path, index, start, end) -> video_id, index, vector, error, as
    ``speakers.cluster_speakers`` takes them."""
    return _apply(segments, "embedder", backend, ["path", "index", "start", "end"], lambda hear, path, index, start, end: [(index, hear(path, start, end))], "index int, vector array<double>")


def identify_speakers(media: DataFrame, segments: DataFrame, method: str = "embedding", backend: str | None = None, speakers: int = 0) -> DataFrame:
    """``segments`` with ``speaker``: by clustering voice vectors ("embedding"), or from a model's turns ("turns")."""
    from cuegrid.operators.speakers import assign_speakers, cluster_speakers

    if method == "turns":
        return assign_speakers(segments, diarize(media, backend or "alternating").filter("error is null").drop("error"))
    if method != "embedding":
        raise ValueError(f"unknown method {method!r}; known: ['embedding', 'turns']")
    vectors = embed_segments(segments.select("video_id", "index", "start", "end").join(media.select("video_id", "path"), "video_id"), backend or "digest")
    labels = cluster_speakers(vectors.filter("error is null").drop("error"), speakers).select("video_id", "index", F.col("speaker").alias("label"))
    return segments.join(labels, ["video_id", "index"], "left").withColumn("speaker", F.coalesce("label", "speaker")).select(*segments.columns)


def translate_lines(segments: DataFrame, backend: str, settings: Settings = Settings()) -> DataFrame:
    """``segments`` with ``translated``: line by line, in Arrow batches; nothing for the same language."""
    if settings.source_lang == settings.target_lang:
        return segments.withColumn("translated", F.col("text"))
    from cuegrid.operators.translation import accept_translation, char_budget

    @F.arrow_udf("string")
    def run(texts: pa.Array, budgets: pa.Array) -> pa.Array:
        speak = translator(backend)
        out = []
        for text, budget in zip(texts.to_pylist(), budgets.to_pylist(), strict=True):
            try:
                out.append(speak(text, settings.source_lang, settings.target_lang, budget) if text and text.strip() else text)
            except Exception:  # a failed line falls back to its source text
                out.append(None)
        return pa.array(out, pa.string())

    return segments.withColumn("translated", accept_translation(run("text", char_budget(settings)), F.col("text")))


def translate_in_order(segments: DataFrame, reply: Callable[[str, list[tuple[str, str]], int | None], str], settings: Settings = Settings()) -> DataFrame:
    """``segments`` with ``translated`` where each line sees the last pairs translated with success.

    Serial inside a video, as every line depends on those before it; videos run in parallel.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("index")
        history: list[tuple[str, str]] = []
        out = []
        for text, start, end in zip(*[table.column(c).to_pylist() for c in ("text", "start", "end")], strict=True):
            budget = None
            if settings.chars_per_second:
                budget = max(settings.min_budget, int(max(0.0, end - start) * settings.chars_per_second * settings.max_speedup))
            answer = ""
            if text and text.strip():
                try:
                    answer = reply(text.strip(), history[-settings.context_lines :], budget).strip()
                except Exception:  # failures leave no trace in the history
                    answer = ""
            if answer:
                history.append((text.strip(), answer))
            out.append(answer or text)
        return table.drop_columns(["translated"]).append_column("translated", pa.array(out, pa.string()))

    names = [c for c in segments.columns if c != "translated"]
    shaped = segments.select(*names, F.lit(None).cast("string").alias("translated"))
    return shaped.groupBy("video_id").applyInArrow(run, shaped.schema)


def synthesize(segments: DataFrame, backend: str, language: str) -> DataFrame:
    """``segments`` with ``audio_path``, ``clip_ms`` and ``error``; a failed row has no audio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speak = voice(backend)
        for batch in batches:
            paths, lengths, errors = [], [], []
            for index, text in zip(batch.column("index").to_pylist(), batch.column("text").to_pylist(), strict=True):
                try:
                    ms = int(speak(text, language))
                    paths.append(f"seg_{index:04d}.wav")
                    lengths.append(ms)
                    errors.append(None)
                except Exception as e:
                    paths.append(None)
                    lengths.append(None)
                    errors.append(str(e)[:2000])
            arrays = [*batch.columns, pa.array(paths, pa.string()), pa.array(lengths, pa.int64()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "audio_path", "clip_ms", "error"])

    names = [c for c in segments.columns if c not in ("audio_path", "clip_ms", "error")]
    plain = segments.select(*names)
    schema = StructType(list(plain.schema.fields)).add("audio_path", "string").add("clip_ms", "long").add("error", "string")
    return plain.mapInArrow(run, schema)
