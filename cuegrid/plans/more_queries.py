"""Registered queries of sources, slots, commands, publishing and the extensions, and the same in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.functions import commands, languages
from cuegrid.operators import backends, jobs, planning, publish, segmentation, speakers, subtitles, timeline, translation
from cuegrid.plans.cluster_sql import kmeans_sql, linkage_sql
from cuegrid.plans.dub import subtitles_only
from cuegrid.plans.queries import _CLIPS, _MS, _SEGMENTS, _STAMP, _clips, _segments, _strip
from cuegrid.settings import Settings
from cuegrid.sources import adapters, files
from cuegrid.sources.adapters import table

CODES = ["de", "en", "fr", "xx", "qq_Latn", "zh", "sv"]
SYNOPSIS, PROTECTED = "A talk about boats.", ["Kestrel", "Port Ellis"]


def _text(column):
    return F.concat_ws("\u0001", column)


def _coded(spark, d) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in CODES])
    return table(spark, d, "documents").select("doc_id", F.get(codes, (F.col("doc_id") % len(CODES)).cast("int")).alias("code"), "lang", "source", "text")


def q_source_dispatch(spark, d):
    urls = table(spark, d, "pages").select("page_id", "url")
    media = urls.filter("page_id % 3 = 0").select(F.col("url").alias("path"))
    return planning.dispatch_sources(urls.select(F.col("url").alias("source")), media)


def q_pick_format(spark, d):
    parts = table(spark, d, "part").select((F.col("p_partkey") % 40).alias("video_id"), F.col("p_size").alias("rank"), F.col("p_type").alias("format"))
    return planning.pick_format(parts)


def q_download_options(spark, d):
    options = planning.set_options(browser=F.when(F.col("event_id") % 2 == 0, F.col("event_type")), file=F.when(F.col("event_id") % 3 == 0, F.lit("cookies.txt")), retries=F.col("event_id") % 5)
    pairs = F.array_sort(F.transform(F.map_entries(options), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return table(spark, d, "events").select("event_id", F.array_join(pairs, ",").alias("options"))


def q_media_commands(spark, d):
    path = lambda kind: F.concat(F.lit("v:"), F.col("conv_id").cast("string"), F.lit("'" + kind))
    tools = {
        "extract": commands.extract_audio(path(".mp4"), path(".wav")),
        "mux": commands.mux_audio(path(".mp4"), path(".wav"), path(".out.mp4")),
        "reencode": commands.mux_audio(path(".mp4"), path(".wav"), path(".out.mp4"), True),
        "faststart": commands.faststart_remux(path(".mp4"), path(".fast.mp4")),
        "burn": commands.burn_subtitles(path(".mp4"), path(".srt"), path(".sub.mp4"), 18),
        "wav": commands.transcode_wav(path(".mp4"), path(".wav")),
        "deliver": commands.transcode_wav(path(".mp4"), path(".wav"), 48_000),
        "probe": commands.probe_streams(path(".mp4")),
        "lips": commands.lip_sync(F.lit("python"), F.lit("/opt/lips"), F.lit("/opt/m.pth"), path(".mp4"), path(".wav"), path(".lips.mp4")),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("tool"), F.array_join(v, " ").alias("command")) for k, v in tools.items()])).alias("c")
    return table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", rows).select("conv_id", "c.*")


def q_time_stretch(spark, d):
    return publish.timeline_export(_clips(spark, d)).select("video_id", "index", "position_ms", "placed_ms", "file", "aligned_file", F.array_join("command", " ").alias("command"))


def q_acquire_local(spark, d):
    media = table(spark, d, "pages").select(F.col("page_id").alias("video_id"), F.concat(F.lit("in/"), F.col("page_id").cast("string"), F.lit(".mp4")).alias("path"))
    answer = F.when(F.col("video_id") % 4 == 0, "N/A").otherwise((F.col("video_id") / 4).cast("string"))
    probes = media.filter("video_id % 5 <> 0").select("path", answer.alias("answer"))
    return files.acquire_local(media, probes, "work/").select("video_id", "seconds", "track", F.array_join("command", " ").alias("command"))


def q_transcript_words(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    timed = F.transform(F.split("line", " "), lambda w, i: F.struct((F.col("seq") + i / 16.0).alias("start"), (F.col("seq") + (i + 1) / 16.0).alias("end"), w.alias("word")))
    return segmentation.explode_transcript(lines.select("video_id", "seq", timed.alias("words")))


def q_resolved_language(spark, d):
    rows = _coded(spark, d)
    asked = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("code"))
    return rows.select("doc_id", languages.resolve_language(F.when(F.col("doc_id") % 2 == 0, F.col("lang")), asked).alias("language"))


def q_model_language(spark, d):
    return _coded(spark, d).select("doc_id", languages.nllb_code(F.col("code"), strict=False).alias("model_code"), languages.display_name(F.col("code")).alias("name"))


def q_voice_errors(spark, d):
    return _coded(spark, d).select("doc_id", languages.voice_error("openvoice", F.col("code")).alias("error"))


def q_same_language(spark, d):
    text = translation.translated_or_copied(Settings(source_lang="de", target_lang="de"), F.col("translated"), F.col("text"))
    return _segments(spark, d).select("video_id", "index", text.alias("said"))


def q_system_prompt(spark, d):
    synopsis = F.when(F.col("doc_id") % 2 == 0, F.lit(SYNOPSIS)).otherwise("")
    terms = F.when(F.col("doc_id") % 3 == 0, F.array(*[F.lit(t) for t in PROTECTED]))
    return _coded(spark, d).select("doc_id", translation.system_prompt(F.lit("en"), F.col("code"), synopsis, terms, locale=True).alias("prompt"))


def q_request_body(spark, d):
    body = translation.request_body("m:8b", F.col("text"), F.concat(F.lit("to "), F.col("code")), unload=True)
    return _coded(spark, d).select("doc_id", F.md5(body).alias("body_md5"), F.length(body).alias("chars"))


def q_response_text(spark, d):
    reply = F.when(F.col("doc_id") % 3 == 0, F.lit("no json")).otherwise(F.to_json(F.struct(F.concat(F.lit(' "'), F.col("text"), F.lit('"')).alias("response"))))
    return _coded(spark, d).select("doc_id", F.md5(translation.response_text(reply)).alias("said_md5"))


def q_generation_cap(spark, d):
    return _segments(spark, d).select("video_id", "index", translation.generation_cap(F.length("text")).alias("cap"))


def q_silence_trim(spark, d):
    lead, trail = F.col("index") * 311 % 900, F.col("index") * 57 % 700
    return _clips(spark, d).select("video_id", "index", timeline.trimmed_ms(F.col("clip_ms"), lead, trail).cast("long").alias("trimmed_ms"))


def _produced(spark, d) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("mp4", "srt", "wav", "txt")])
    rows = table(spark, d, "events").select("event_id", (F.col("user_id") % 60).cast("string").alias("base"), F.col("event_type").alias("lang"), F.get(kinds, (F.col("event_id") % 4).cast("int")).alias("kind"), F.col("ts").alias("mtime"))
    return rows.withColumn("path", F.concat(jobs.output_name(F.col("base"), F.col("lang"), F.col("event_id").cast("string")), F.lit("."), "kind"))


def q_newest_outputs(spark, d):
    return jobs.newest_outputs(_produced(spark, d)).select("base", "lang", "kind", "path")


def q_batch_publish(spark, d):
    return publish.batch_publish(_produced(spark, d)).select("base", "lang", "source", "destination", F.array_join("command", " ").alias("command"))


def q_publish_plan(spark, d):
    streams = _segments(spark, d).select("video_id", F.when(F.col("video_id") % 3 == 0, "audio").when(F.col("index") % 2 == 0, "video").otherwise("audio").alias("codec_type"))
    dubs = jobs.fan_out(publish.has_video(streams), ["de", "fr"]).select("video_id", "target_lang", F.lit("in.mp4").alias("video_path"), F.lit("dub.wav").alias("audio_path"), "has_video")
    plan = publish.publish_plan(dubs, subtitles=True)
    steps = F.array_join(F.transform("steps", lambda s: F.array_join(s, " ")), " && ")
    return plan.select("video_id", "target_lang", "has_video", "out_path", "srt_path", steps.alias("steps"))


def _job_table(spark, d) -> DataFrame:
    return jobs.latest_jobs(table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.when(F.col("event_id") % 3 == 0, "completed").when(F.col("event_id") % 3 == 1, "queued").otherwise("failed").alias("status"), "ts", "event_id"))


def _asked(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"))


def q_job_lookup(spark, d):
    return jobs.lookup_jobs(_asked(spark, d), _job_table(spark, d))


def q_job_results(spark, d):
    made = F.when(F.col("job_id") % 2 == 0, F.concat(F.col("job_id").cast("string"), F.lit(".mp4")))
    return jobs.lookup_results(_asked(spark, d), _job_table(spark, d).withColumn("output_path", made))


def q_next_job(spark, d):
    return publish.next_job(_job_table(spark, d))


def q_failed_languages(spark, d):
    results = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("base"), F.col("o_orderpriority").alias("lang"), F.when(F.col("o_orderkey") % 7 == 0, "x").alias("error")).groupBy("base", "lang").agg(F.max("error").alias("error"))
    return jobs.failed_languages(results).select("base", _text("failed").alias("failed"))


def q_tool_errors(spark, d):
    ran = table(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".mp4")).alias("out_path"), (F.col("doc_id") % 3).cast("int").alias("exit_code"), F.col("text").alias("stderr"))
    there = ran.filter("doc_id % 2 = 0").select(F.col("out_path").alias("path"))
    return publish.missing_outputs(ran, there).select("doc_id", "error")


def q_context_load(spark, d):
    batches = planning.translation_batches(_segments(spark, d), 3, 1).join(_segments(spark, d).select("video_id", "index", "text"), ["video_id", "index"])
    return planning.context_load(batches, 1_000_000)


def q_confidence_split(spark, d):
    rows = _segments(spark, d).select("video_id", "index", F.when(F.col("index") % 5 != 0, (F.col("index") % 7) / 7.0).alias("confidence"))
    kept, dropped = planning.split_by_confidence(rows, 0.5)
    return kept.withColumn("dropped", F.lit(False)).unionByName(dropped.withColumn("dropped", F.lit(True))).select("video_id", "index", "dropped")


def q_translate_lines(spark, d):
    return backends.translate_lines(_segments(spark, d), "echo").select("video_id", "index", "translated")


def q_synthesize(spark, d):
    return backends.synthesize(_segments(spark, d), "steady", "de").select("video_id", "index", "audio_path", "clip_ms", "error")


def q_translate_in_order(spark, d):
    said = lambda text, history, budget: f"{len(history)}|{budget}|{history[-1][1][:1] if history else ''}|{text}"
    return backends.translate_in_order(_segments(spark, d), said).select("video_id", "index", "translated")


def q_speaker_agglomerative_loose(spark, d):
    """A low threshold, so that clusters do merge."""
    return speakers.cluster_speakers(adapters.vectors(table(spark, d, "embeddings")), 0, 0.12).select("video_id", "index", "label", "speaker")


def _media(spark, d) -> DataFrame:
    return table(spark, d, "pages").select(F.col("page_id").alias("video_id"), F.col("url").alias("path"))


def q_download(spark, d):
    return backends.download(_media(spark, d).withColumnRenamed("path", "url"))


def q_transcribe(spark, d):
    return backends.transcribe(_media(spark, d)).select("video_id", "seq", "start", "end", "text", F.size("words").alias("words"), "detected", "error")


def q_diarize(spark, d):
    return backends.diarize(_media(spark, d))


def q_embed_segments(spark, d):
    segments = _segments(spark, d).withColumn("path", F.col("text"))
    rows = backends.embed_segments(segments)
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    return rows.select("video_id", "index", F.size("vector").alias("width"), F.bround(norm, 6).alias("norm"), "error")


def q_identify_speakers(spark, d):
    segments = _segments(spark, d).withColumn("speaker", F.lit(None).cast("string"))
    media = segments.select("video_id").distinct().withColumn("path", F.col("video_id").cast("string"))
    return backends.identify_speakers(media, segments, "turns").select("video_id", "index", "speaker")


def q_transcript_guard(spark, d):
    segments = _segments(spark, d)
    return backends.require_transcripts(segments.select("video_id").distinct(), segments)


def q_self_test(spark, d):
    voices = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    other = voices.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("dub_voice"))
    runs = voices.join(other, "vec_id").select(F.col("vec_id").alias("video_id"), (F.col("vec_id") / 8).alias("source_seconds"), (F.col("vec_id") % 16 / 4).alias("dub_seconds"), F.col("v").alias("source_voice"), "dub_voice")
    return publish.self_test(runs).select("video_id", "drift", (F.bround("timbre", 6) + 0.0).alias("timbre"))


def q_loudness_match(spark, d):
    rows = _segments(spark, d).groupBy("video_id").agg(F.max("index").alias("n"))
    measured = jobs.fan_out(rows, ["de"]).select("video_id", "target_lang", (-14 - F.col("n") / 4).alias("source_lufs"), (-20 + F.col("video_id") % 8 / 2).alias("dub_lufs"))
    return publish.loudness_match(measured)


def q_exact_fit(spark, d):
    clips = _clips(spark, d)
    totals = clips.groupBy("video_id").agg((F.max("end") * 1000).cast("long").alias("total_ms"))
    return timeline.exact_fit(clips, totals)


def q_fitted_srt(spark, d):
    """Subtitles with the times after fitting."""
    fit = timeline.timeline_fit(_clips(spark, d)).join(_clips(spark, d).select("video_id", "index", F.col("clip_ms").alias("placed_ms")), ["video_id", "index"])
    return subtitles.render_srt(publish.fitted_segments(_segments(spark, d), fit)).select("video_id", F.md5("srt").alias("srt_md5"), F.length("srt").alias("chars"))


def q_subtitles_only(spark, d):
    """The first cue of every second video is corrected."""
    corrected = _segments(spark, d).select("video_id").distinct().filter("video_id % 2 = 0").select("video_id", F.lit(1).alias("cue"), F.lit("Corrected line").alias("text"))
    return subtitles_only(_segments(spark, d), ["de", "fr"], corrected=corrected).select("video_id", "target_lang", F.md5("srt").alias("srt_md5"))


def q_shorten_overshoots(spark, d):
    cut = lambda text, budget: F.regexp_replace(text, r"\s+\S+\z", "")
    rows = planning.shorten_overshoots(_segments(spark, d), translation.char_budget(Settings(chars_per_second=9.0)), cut)
    return rows.select("video_id", "index", "translated", "attempts")


def q_stage_cache(spark, d):
    work = _segments(spark, d).select(F.col("video_id").cast("string").alias("base"), F.when(F.col("index") % 2 == 0, "de").alias("lang"), F.col("index").cast("string").alias("stage"), jobs.stage_key(F.col("text")).alias("key"))
    kept = _segments(spark, d).filter("video_id % 3 <> 0").select(F.col("video_id").cast("string").alias("base"), F.when(F.col("index") % 2 == 0, "de").alias("lang"), F.col("index").cast("string").alias("stage"), F.when(F.col("video_id") % 3 == 1, jobs.stage_key(F.col("text"))).otherwise("old").alias("key"), F.concat(F.lit("out/"), F.col("video_id").cast("string")).alias("output"))
    return jobs.stage_cache(work, kept).select("base", "stage", "output", "state")


MORE_QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

# ---- the same in SQL ----------------------------------------------------------------------------

_LIST = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"
_CODED = f"coded AS (SELECT doc_id, ({_LIST})[doc_id % {len(CODES)} + 1] AS code, lang, source, text FROM documents)"


def _case(mapping: dict[str, str], key: str, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {other} END"


_NAME = _case(languages.DISPLAY_NAMES, "code", "code")
_STYLE = "FontName=DejaVu Sans,FontSize={},Alignment=2,MarginV=10,Outline=1,Shadow=0,BorderStyle=1"
_V = "'v:' || conv_id || chr(39) || '{}'".format


def _q(parts: str, **paths: str) -> str:
    """A command line as an SQL expression: words in braces are paths."""
    out = "'" + parts.replace("'", "''") + "'"
    for name, expression in paths.items():
        out = out.replace("{" + name + "}", f"' || {expression} || '")
    return out


_TOOLS = {
    "extract": _q("ffmpeg -y -i {a} -vn -ar 16000 -ac 1 {b}", a=_V(".mp4"), b=_V(".wav")),
    "mux": _q("ffmpeg -y -i {a} -i {b} -map 0:v:0 -map 1:a:0 -c:v copy -c:a aac -b:a 192k -movflags +faststart -shortest {c}", a=_V(".mp4"), b=_V(".wav"), c=_V(".out.mp4")),
    "reencode": _q("ffmpeg -y -i {a} -i {b} -map 0:v:0 -map 1:a:0 -c:v libx264 -pix_fmt yuv420p -profile:v high -crf 23 -c:a aac -b:a 192k -movflags +faststart -shortest {c}", a=_V(".mp4"), b=_V(".wav"), c=_V(".out.mp4")),
    "faststart": _q("ffmpeg -y -i {a} -c:v copy -c:a aac -b:a 192k -movflags +faststart {b}", a=_V(".mp4"), b=_V(".fast.mp4")),
    "burn": _q("ffmpeg -y -i {a} -vf subtitles={b}:force_style=@" + _STYLE.format(18) + "@ -c:a copy -movflags +faststart {c}", a=_V(".mp4"), b="'v' || chr(92) || ':' || conv_id || chr(92) || chr(39) || '.srt'", c=_V(".sub.mp4")).replace("@", "''"),
    "wav": _q("ffmpeg -y -loglevel error -i {a} -vn -acodec pcm_s16le {b}", a=_V(".mp4"), b=_V(".wav")),
    "deliver": _q("ffmpeg -y -loglevel error -i {a} -vn -acodec pcm_s16le -ar 48000 {b}", a=_V(".mp4"), b=_V(".wav")),
    "probe": _q("ffprobe -v error -select_streams v:0 -show_entries stream=codec_type -of csv=p=0 {a}", a=_V(".mp4")),
    "lips": _q("python /opt/lips/inference.py --checkpoint_path /opt/m.pth --face {a} --audio {b} --outfile {c}", a=_V(".mp4"), b=_V(".wav"), c=_V(".lips.mp4")),
}
_PRODUCED = """produced AS (SELECT *, concat_ws('.', base, lang, event_id::VARCHAR) || '.' || kind AS path FROM (
  SELECT event_id, (user_id % 60)::VARCHAR AS base, event_type AS lang, (['mp4', 'srt', 'wav', 'txt'])[event_id % 4 + 1] AS kind, ts AS mtime FROM events))"""
_JOBS = """jobs AS (SELECT user_id AS job_id, arg_max(CASE event_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'queued' ELSE 'failed' END, (ts, event_id)) AS status, max(ts) AS ts FROM events GROUP BY user_id)"""
_KEY = "sha256(text)"


def _rule(text: str) -> str:
    return "'" + text.replace("'", "''").replace("{target}", f"' || {_NAME} || '") + "'"


_RULES = " || chr(10) || ".join(_rule(r) for r in translation.RULES + translation.LOCALE_RULES)

MORE_SQL = {
    "speaker_kmeans": kmeans_sql(4),
    "speaker_agglomerative": linkage_sql(0.75),
    "speaker_agglomerative_loose": linkage_sql(0.12),
    "source_dispatch": r"""SELECT r.url AS source, CASE WHEN m.path IS NULL THEN 'download' ELSE 'local' END AS kind,
  CASE WHEN m.path IS NOT NULL THEN regexp_replace(regexp_replace(r.url, '^.*/', ''), '^(.+)\.[^.]*$', '\1') END AS video_id
FROM pages r LEFT JOIN (SELECT DISTINCT url AS path FROM pages WHERE page_id % 3 = 0) m ON m.path = r.url""",
    "pick_format": "SELECT p_partkey % 40 AS video_id, arg_min(p_type, (p_size, p_type)) AS format FROM part GROUP BY 1",
    "download_options": """SELECT event_id, concat_ws(',', CASE WHEN event_id % 2 = 0 THEN 'browser=' || event_type END, CASE WHEN event_id % 3 = 0 THEN 'file=cookies.txt' END, 'retries=' || (event_id % 5)) AS options FROM events""",
    "media_commands": "WITH c AS (SELECT DISTINCT conv_id FROM conversations) " + " UNION ALL ".join(f"SELECT conv_id, '{k}' AS tool, {v} AS command FROM c" for k, v in _TOOLS.items()),
    "time_stretch": f"""WITH {_CLIPS} SELECT video_id, index, position_ms, placed_ms, printf('seg_%04d.wav', index) AS file, printf('aligned_%04d.wav', index) AS aligned_file,
  CASE WHEN stretched THEN 'ffmpeg -y -i ' || printf('seg_%04d.wav', index) || ' -filter:a ' || printf('atempo=%.6f', factor) || ' -ar 24000 ' || printf('aligned_%04d.wav', index) END AS command FROM plan""",
    "acquire_local": """SELECT page_id AS video_id, CASE WHEN page_id % 5 = 0 OR page_id % 4 = 0 THEN 0.0 ELSE page_id / 4.0 END::DOUBLE AS seconds, 'work/' || page_id || '.wav' AS track,
  'ffmpeg -y -i in/' || page_id || '.mp4 -vn -ar 16000 -ac 1 work/' || page_id || '.wav' AS command FROM pages""",
    "transcript_words": """WITH l AS (SELECT doc_id AS video_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS seq FROM documents),
w AS (SELECT video_id, seq, unnest(string_split(line, ' ')) AS word, unnest(range(len(string_split(line, ' ')))) AS i FROM l)
SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY seq, i) - 1)::INT AS pos, seq + i / 16.0::DOUBLE AS start, seq + (i + 1) / 16.0::DOUBLE AS "end", word FROM w WHERE word <> ''""",
    "resolved_language": f"WITH {_CODED} SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN lang END, ''), CASE WHEN doc_id % 3 = 1 THEN code END, 'unknown') AS language FROM coded",
    "model_language": f"WITH {_CODED} SELECT doc_id, {_case(languages.NLLB_CODES, 'code', 'CASE WHEN contains(code, chr(95)) THEN code END')} AS model_code, {_NAME} AS name FROM coded",
    "voice_errors": f"WITH {_CODED} SELECT doc_id, CASE WHEN code NOT IN ('en', 'es', 'fr', 'zh', 'ja', 'ko') THEN 'openvoice cannot speak ' || code || '; supported: en, es, fr, ja, ko, zh' END AS error FROM coded",
    "same_language": f"WITH {_SEGMENTS} SELECT video_id, index, text AS said FROM segments",
    "system_prompt": f"""WITH {_CODED} SELECT doc_id, 'You translate subtitles of a video from English into ' || {_NAME} || '.' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'About the video:' || chr(10) || '{SYNOPSIS}' ELSE '' END
  || chr(10) || chr(10) || 'Rules:' || chr(10) || {_RULES}
  || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || 'Never translate these terms:' || chr(10) || '  {PROTECTED[0]}' || chr(10) || '  {PROTECTED[1]}' ELSE '' END AS prompt FROM coded""",
    "request_body": f"""WITH {_CODED}, b AS (SELECT doc_id, '{{"model":"m:8b","prompt":' || to_json(text) || ',"system":"to ' || code || '","stream":false,"think":false,"options":{{"temperature":0.3,"num_predict":512}},"keep_alive":0}}' AS body FROM coded)
SELECT doc_id, md5(body) AS body_md5, length(body)::INT AS chars FROM b""",
    "response_text": f"""WITH {_CODED}, t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS t FROM coded)
SELECT doc_id, md5(t) AS said_md5 FROM t""",
    "generation_cap": f"WITH {_SEGMENTS} SELECT video_id, index, least(400, length(text) * 2 + 16)::INT AS cap FROM segments",
    "silence_trim": f"""WITH {_CLIPS} SELECT video_id, index, CASE WHEN clip_ms - index * 57 % 700 > index * 311 % 900 THEN clip_ms - index * 57 % 700 - index * 311 % 900 ELSE clip_ms END::BIGINT AS trimmed_ms FROM clips""",
    "newest_outputs": f"WITH {_PRODUCED} SELECT base, lang, kind, arg_min(path, (-epoch_us(mtime), path)) AS path FROM produced GROUP BY ALL",
    "batch_publish": f"""WITH {_PRODUCED}, k AS (SELECT *, CASE WHEN kind = 'srt' THEN 'srt' ELSE 'wav' END AS target FROM produced WHERE kind <> 'txt'),
n AS (SELECT *, row_number() OVER (PARTITION BY base, lang, target ORDER BY mtime DESC, path) AS n FROM k)
SELECT base, lang, path AS source, base || '/' || lang || '.' || target AS destination,
  CASE WHEN kind = 'mp4' THEN 'ffmpeg -y -loglevel error -i ' || path || ' -vn -acodec pcm_s16le ' || base || '/' || lang || '.wav' END AS command FROM n WHERE n = 1""",
    "publish_plan": f"""WITH v AS (SELECT conv_id AS video_id, bool_or(conv_id % 3 <> 0 AND turn % 2 = 0) AS has_video FROM conversations GROUP BY 1),
r AS (SELECT *, video_id || '.' || target_lang AS base FROM v, (VALUES ('de'), ('fr')) t(target_lang))
SELECT video_id, target_lang, has_video, base || CASE WHEN has_video THEN '.subbed.mp4' ELSE '.wav' END AS out_path, base || '.srt' AS srt_path,
  CASE WHEN has_video THEN 'ffmpeg -y -i in.mp4 -i dub.wav -map 0:v:0 -map 1:a:0 -c:v copy -c:a aac -b:a 192k -movflags +faststart -shortest ' || base || '.mp4 && ffmpeg -y -i ' || base || '.mp4 -vf subtitles=' || base || '.srt:force_style=''{_STYLE.format(14)}'' -c:a copy -movflags +faststart ' || base || '.subbed.mp4' END AS steps FROM r""",
    "job_lookup": f"WITH {_JOBS} SELECT c_custkey AS job_id, status, CASE WHEN status IS NULL THEN 404 ELSE 200 END AS code, CASE WHEN status IS NULL THEN 'Unknown job' END AS detail FROM customer LEFT JOIN jobs ON job_id = c_custkey",
    "job_results": f"""WITH {_JOBS}, r AS (SELECT c_custkey AS job_id, coalesce(status = 'completed' AND c_custkey % 2 = 0, false) AS ready FROM customer LEFT JOIN jobs ON job_id = c_custkey)
SELECT job_id, CASE WHEN ready THEN job_id || '.mp4' END AS output_path, CASE WHEN ready THEN 200 ELSE 404 END AS code, CASE WHEN NOT ready THEN 'Video not ready' END AS detail FROM r""",
    "next_job": f"WITH {_JOBS} SELECT job_id, (row_number() OVER (ORDER BY ts, job_id) - 1)::INT AS place FROM jobs WHERE status = 'queued'",
    "failed_languages": """WITH r AS (SELECT o_custkey % 50 AS base, o_orderpriority AS lang, bool_or(o_orderkey % 7 = 0) AS failed FROM orders GROUP BY ALL)
SELECT base, coalesce(string_agg(lang, chr(1) ORDER BY lang) FILTER (WHERE failed), '') AS failed FROM r GROUP BY base""",
    "tool_errors": "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'tool failed: ' || right(coalesce(text, ''), 2000) WHEN doc_id % 2 <> 0 THEN 'tool succeeded but left no file' END AS error FROM documents",
    "context_load": f"""WITH {_SEGMENTS}, n AS (SELECT video_id, index, text, row_number() OVER (PARTITION BY video_id ORDER BY index) - 1 AS n, max(index) OVER (PARTITION BY video_id) AS last FROM segments),
b AS (SELECT video_id, (n // 3)::INT AS batch, text FROM n UNION ALL SELECT video_id, (n // 3 + 1)::INT, text FROM n WHERE n % 3 = 2 AND index < last)
SELECT video_id, batch, ceil(sum(length(text)) / 4.0)::BIGINT AS tokens FROM b GROUP BY ALL""",
    "confidence_split": f"WITH {_SEGMENTS} SELECT video_id, index, index % 5 <> 0 AND index % 7 < 3.5 AS dropped FROM segments",
    "translate_lines": f"""WITH {_SEGMENTS}, b AS (SELECT *, greatest(20, trunc(greatest(0, "end" - start) * 15.0::DOUBLE * 1.4::DOUBLE)::INT) AS budget FROM segments)
SELECT video_id, index, {_strip("substr('[de] ' || text, 1, budget)")} AS translated FROM b""",
    "synthesize": f"WITH {_SEGMENTS} SELECT video_id, index, printf('seg_%04d.wav', index) AS audio_path, (1000 * length(text) // 15)::BIGINT AS clip_ms, NULL::VARCHAR AS error FROM segments",
    "translate_in_order": f"""WITH {_SEGMENTS}, b AS (SELECT *, greatest(20, trunc(greatest(0, "end" - start) * 15.0::DOUBLE * 1.4::DOUBLE)::INT) AS budget,
  least(6, row_number() OVER (PARTITION BY video_id ORDER BY index) - 1) AS n FROM segments)
SELECT video_id, index, n || '|' || budget || '|' || coalesce((lag(n) OVER (PARTITION BY video_id ORDER BY index))::VARCHAR, '') || '|' || {_strip('text')} AS translated FROM b""",
    "download": "SELECT page_id AS video_id, md5(url) || '.mp4' AS path, length(url)::DOUBLE AS seconds, NULL::VARCHAR AS error FROM pages",
    "transcribe": """WITH w AS (SELECT page_id AS video_id, regexp_extract_all(url, '[a-zA-Z0-9]+') AS w FROM pages),
s AS (SELECT video_id, w, unnest(range((len(w) + 3) // 4)) AS seq FROM w)
SELECT video_id, seq::INT AS seq, seq * 2.0::DOUBLE AS start, 0.5 * (least(len(w), seq * 4 + 4) - 1) + 0.4::DOUBLE AS "end", ' ' || array_to_string(w[seq * 4 + 1 : seq * 4 + 4], ' ') AS text,
  len(w[seq * 4 + 1 : seq * 4 + 4])::INT AS words, 'en' AS detected, NULL::VARCHAR AS error FROM s""",
    "diarize": """SELECT page_id AS video_id, i::INT AS ord, 2.0::DOUBLE * i AS start, 2.0::DOUBLE * i + 2 AS "end", 'SPK' || (i % 2) AS speaker, NULL::VARCHAR AS error
FROM (SELECT page_id, unnest(range(1 + length(url) % 5)) AS i FROM pages)""",
    "embed_segments": f"WITH {_SEGMENTS} SELECT video_id, index, 16 AS width, 1.0::DOUBLE AS norm, NULL::VARCHAR AS error FROM segments",
    "identify_speakers": f"""WITH {_SEGMENTS}, turns AS (SELECT video_id, i AS ord, 2.0::DOUBLE * i AS start, 2.0::DOUBLE * i + 2 AS "end", 'SPK' || (i % 2) AS speaker FROM (SELECT DISTINCT conv_id AS video_id, unnest(range(1 + length(conv_id::VARCHAR) % 5)) AS i FROM conversations)),
pairs AS (SELECT s.video_id, s.index, t.ord, t.speaker, least(s."end", t."end") - greatest(s.start, t.start) AS o, abs((t.start + t."end") / 2 - (s.start + s."end") / 2) AS gap FROM segments s JOIN turns t USING (video_id))
SELECT video_id, index, coalesce(arg_min(speaker, (-o, ord)) FILTER (WHERE o > 0), arg_min(speaker, (gap, ord))) AS speaker FROM pairs GROUP BY ALL""",
    "transcript_guard": "SELECT conv_id AS video_id, count(*) AS segments FROM conversations GROUP BY 1",
    "self_test": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.vec_id AS video_id, abs(a.vec_id / 8.0::DOUBLE - a.vec_id % 16 / 4.0::DOUBLE) AS drift, round_even(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) + 0.0 AS timbre
FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""",
    "loudness_match": """WITH r AS (SELECT conv_id AS video_id, 'de' AS target_lang, -14 - max(turn) / 4.0::DOUBLE AS source_lufs, -20 + conv_id % 8 / 2.0::DOUBLE AS dub_lufs FROM conversations GROUP BY conv_id)
SELECT *, source_lufs - dub_lufs AS gain_db, 'loudnorm=I=' || printf('%.1f', round_even(source_lufs, 1)) || ':TP=-1.5:LRA=11' AS filter FROM r""",
    "exact_fit": f"""WITH {_CLIPS}, p AS (SELECT video_id, index, clip_ms, position_ms AS source_ms, coalesce(sum(clip_ms) OVER (PARTITION BY video_id ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS played FROM plan),
q AS (SELECT *, played + max(source_ms - played) OVER (PARTITION BY video_id ORDER BY index) AS fit_ms FROM p),
t AS (SELECT video_id, trunc(max("end") * 1000)::BIGINT AS total_ms FROM segments GROUP BY video_id),
r AS (SELECT q.*, total_ms, max(fit_ms + clip_ms) OVER w AS last, max(index) FILTER (WHERE fit_ms = source_ms) OVER w AS run, max(source_ms) FILTER (WHERE fit_ms = source_ms) OVER w AS begin FROM q JOIN t USING (video_id) WINDOW w AS (PARTITION BY video_id)),
f AS (SELECT *, CASE WHEN index >= run AND last > total_ms THEN least((last - begin)::DOUBLE / greatest(total_ms - begin, 1), 1.4::DOUBLE) ELSE 1.0::DOUBLE END AS factor FROM r),
g AS (SELECT *, CASE WHEN factor > 1 THEN greatest(begin + floor((fit_ms - begin) / factor), source_ms) ELSE fit_ms END::BIGINT AS start_ms, CASE WHEN factor > 1 THEN begin + floor((fit_ms + clip_ms - begin) / factor) ELSE fit_ms + clip_ms END::BIGINT AS stop_ms FROM f)
SELECT video_id, index, source_ms, start_ms AS fit_ms, greatest(0, stop_ms - start_ms) AS placed_ms, factor, greatest(0, total_ms - max(start_ms + greatest(0, stop_ms - start_ms)) OVER (PARTITION BY video_id)) AS pad_ms FROM g""",
    "fitted_srt": f"""WITH {_CLIPS}, p AS (SELECT video_id, index, clip_ms, translated, text, trunc(start * 1000)::BIGINT AS source_ms, coalesce(sum(clip_ms) OVER (PARTITION BY video_id ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS played FROM clips),
q AS (SELECT *, played + max(source_ms - played) OVER (PARTITION BY video_id ORDER BY index) AS fit_ms FROM p),
c AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY index) AS n, {_MS.format('fit_ms / 1000.0::DOUBLE')} AS a, {_MS.format('(fit_ms / 1000.0::DOUBLE + clip_ms / 1000.0::DOUBLE)')} AS b, {_strip("coalesce(nullif(translated, ''), text)")} AS t FROM q),
s AS (SELECT video_id, string_agg(n || chr(10) || {_STAMP.format('a')} || ' --> ' || {_STAMP.format('b')} || chr(10) || t || chr(10), chr(10) ORDER BY n) AS srt FROM c GROUP BY video_id)
SELECT video_id, md5(srt) AS srt_md5, length(srt)::INT AS chars FROM s""",
    "subtitles_only": f"""WITH {_SEGMENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY index) AS n FROM segments),
c AS (SELECT video_id, n, {_MS.format('start')} AS a, {_MS.format('"end"')} AS b, CASE WHEN n = 1 AND video_id % 2 = 0 THEN 'Corrected line' ELSE {_strip("coalesce(nullif(translated, ''), text)")} END AS t FROM n),
s AS (SELECT video_id, string_agg(n || chr(10) || {_STAMP.format('a')} || ' --> ' || {_STAMP.format('b')} || chr(10) || t || chr(10), chr(10) ORDER BY n) AS srt FROM c GROUP BY video_id)
SELECT video_id, target_lang, md5(srt) AS srt_md5 FROM s, (VALUES ('de'), ('fr')) t(target_lang)""",
    "shorten_overshoots": rf"""WITH {_SEGMENTS}, z AS (SELECT video_id, index, text, translated AS t0, greatest(20, trunc(greatest(0, "end" - start) * 9.0::DOUBLE * 1.4::DOUBLE)::INT) AS budget FROM segments),
a AS (SELECT *, (length(coalesce(nullif(t0, ''), text)) > budget) AS over1, regexp_replace(coalesce(nullif(t0, ''), text), '\s+\S+\z', '') AS c1 FROM z),
b AS (SELECT *, CASE WHEN over1 AND length(c1) < length(coalesce(nullif(t0, ''), text)) AND c1 <> '' THEN c1 ELSE t0 END AS t1 FROM a),
c AS (SELECT *, (length(coalesce(nullif(t1, ''), text)) > budget) AS over2, regexp_replace(coalesce(nullif(t1, ''), text), '\s+\S+\z', '') AS c2 FROM b)
SELECT video_id, index, CASE WHEN over2 AND length(c2) < length(coalesce(nullif(t1, ''), text)) AND c2 <> '' THEN c2 ELSE t1 END AS translated, (over1::INT + over2::INT)::INT AS attempts FROM c""",
    "stage_cache": f"""WITH {_SEGMENTS} SELECT video_id::VARCHAR AS base, index::VARCHAR AS stage, CASE WHEN video_id % 3 = 1 THEN 'out/' || video_id END AS output, CASE video_id % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'cached' ELSE 'stale' END AS state FROM segments""",
}
