"""Registered queries of the timed-text operators over the general tables, and the same in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrid.functions.languages import DEFAULT_TARGETS, DISPLAY_NAMES, VOICES
from cuegrid.functions.text import atempo_chain, clean_reply, srt_timestamp, video_id
from cuegrid.operators import jobs, planning, segmentation, speakers, subtitles, timeline, translation, voices
from cuegrid.plans.dub import dub_plan
from cuegrid.settings import Settings
from cuegrid.sources import adapters
from cuegrid.sources.adapters import table

TIGHT = Settings(max_chars=30, max_duration=2.0)
TERMS = ["the", "Thonent", "que", "ung", "MIT", "token"]


def _from(adapter, name: str):
    return lambda spark, d: adapter(table(spark, d, name))


_words, _segments, _clips = _from(adapters.words, "documents"), _from(adapters.segments, "conversations"), _from(adapters.clips, "conversations")
_turns, _fragments, _vectors = _from(adapters.turns, "conversations"), _from(adapters.fragments, "conversations"), _from(adapters.vectors, "embeddings")


def q_video_id(spark: SparkSession, d: str) -> DataFrame:
    return adapters.urls(table(spark, d, "pages")).select("page_id", video_id(F.col("url")).alias("video_id"))


def q_srt_timestamp(spark, d):
    return table(spark, d, "events").select("event_id", srt_timestamp(F.col("value") * 37 - 10).alias("stamp"))


def q_atempo_chain(spark, d):
    factor = F.floor(F.abs("value") * 16) / F.lit(256.0)
    return table(spark, d, "events").select("event_id", atempo_chain(factor).alias("chain"))


def q_llm_clean(spark, d):
    body, k = F.col("text"), F.col("doc_id") % 6
    raw = (
        F.when(k == 0, F.concat(F.lit("<think>a\nb</think> "), body))
        .when(k == 1, F.concat(F.lit("```text\n"), body, F.lit("\n```")))
        .when(k == 2, F.concat(F.lit('"'), body, F.lit('"')))
        .when(k == 3, F.concat(F.lit("Translation: "), body))
        .when(k == 4, F.concat(F.lit('OUTPUT : "'), body, F.lit('"')))
        .otherwise(F.concat(F.lit("  "), body, F.lit(" ")))
    )
    return table(spark, d, "documents").select("doc_id", clean_reply(raw).alias("cleaned"))


def q_char_budget(spark, d):
    text = translation.accept_translation(F.col("translated"), F.col("text"))
    return _segments(spark, d).select("video_id", "index", translation.char_budget().alias("budget"), F.length(text).alias("chars"))


def q_pick_candidate(spark, d):
    """The lines of a text are its candidates, and the whole text twice."""
    options = F.concat(F.split("text", "\n"), F.array(F.concat(F.lit(" "), "text"), F.col("text"), F.lit("  ")))
    budget = (F.col("doc_id") % 600).cast("int")
    return table(spark, d, "documents").select("doc_id", translation.pick_candidate(options, budget, F.col("text")).alias("picked"))


def q_sentence_segments(spark, d):
    return segmentation.sentence_segments(_words(spark, d))


def q_sentence_segments_tight(spark, d):
    return segmentation.sentence_segments(_words(spark, d), TIGHT)


def q_segment_fallback(spark, d):
    """Every fifth document has no word times; its lines are the raw segments."""
    docs = table(spark, d, "documents")
    lines = docs.select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    raw = lines.select("video_id", "seq", F.col("seq").cast("double").alias("start"), (F.col("seq") + 1.0).alias("end"), "text")
    return segmentation.segment_fallback(_words(spark, d).filter("video_id % 5 <> 0"), raw)


def q_assign_speakers(spark, d):
    segments = _segments(spark, d).withColumn("speaker", F.lit(None).cast("string"))
    return speakers.assign_speakers(segments, _turns(spark, d)).select("video_id", "index", "speaker")


def q_speaker_kmeans(spark, d):
    return speakers.cluster_speakers(_vectors(spark, d), 4).select("video_id", "index", "label", "speaker")


def q_speaker_agglomerative(spark, d):
    return speakers.cluster_speakers(_vectors(spark, d), 0, 0.75).select("video_id", "index", "label", "speaker")


def q_reference_clips(spark, d):
    return voices.reference_clips(_segments(spark, d))


def q_reference_lookup(spark, d):
    """Every seventh segment has a voice nobody has heard, every fifth none."""
    segments = _segments(spark, d)
    refs = voices.references(segments.withColumn("speaker", F.when(F.col("index") % 5 == 4, None).otherwise(F.col("speaker"))))
    asked = segments.withColumn("speaker", F.when(F.col("index") % 7 == 6, "stranger").when(F.col("index") % 5 == 4, None).otherwise(F.col("speaker")))
    return voices.reference_lookup(asked, refs).select("video_id", "index", "speaker", "reference")


def q_context_window(spark, d):
    """Every third translation failed."""
    failed = F.when(F.col("index") % 3 == 2, F.lit("")).otherwise(F.col("translated"))
    rows = translation.context_window(_segments(spark, d).withColumn("translated", failed))
    lines = F.array_join(F.transform("context", lambda p: F.concat(p["source"], F.lit(" -> "), p["target"])), "\n")
    return rows.select("video_id", "index", F.size("context").alias("lines"), F.md5(lines).alias("context_md5"))


def q_prompts(spark, d):
    rows = translation.context_window(_segments(spark, d)).withColumn("budget", translation.char_budget())
    prompt = translation.user_prompt(F.col("text"), F.col("context"), F.col("budget"))
    return rows.select("video_id", "index", prompt.alias("prompt"))


def q_merge_fragments(spark, d):
    return voices.merge_fragments(_fragments(spark, d))


def q_align_plan(spark, d):
    return timeline.align_plan(_clips(spark, d))


def q_align_report(spark, d):
    return timeline.align_report(_clips(spark, d))


def q_timeline_fit(spark, d):
    return timeline.timeline_fit(_clips(spark, d))


def q_slack_budget(spark, d):
    return timeline.slack_budget(_segments(spark, d))


def q_overflow_report(spark, d):
    return timeline.overflow_report(_clips(spark, d))


def q_clean_references(spark, d):
    return timeline.clean_references(_turns(spark, d).withColumnRenamed("ord", "index"))


def q_srt_render(spark, d):
    return subtitles.render_srt(_segments(spark, d)).select("video_id", F.md5("srt").alias("srt_md5"), F.length("srt").alias("chars"))


def q_language_fanout(spark, d):
    return jobs.fan_out(_segments(spark, d).select("video_id", "index"), DEFAULT_TARGETS + ["xx"], "openvoice")


def q_speaker_count(spark, d):
    segments = _segments(spark, d)
    return speakers.speaker_counts(segments.withColumn("speaker", F.when(F.col("index") % 5 == 4, None).otherwise(F.col("speaker"))))


def q_glossary_hits(spark, d):
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    texts = table(spark, d, "documents").select((F.col("doc_id") % 10).alias("video_id"), "text")
    return translation.glossary_hits(texts, terms)


def q_job_latest(spark, d):
    return jobs.latest_jobs(adapters.job_log(table(spark, d, "events"))).select("job_id", "status", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


def q_checked_requests(spark, d):
    return jobs.checked_requests(adapters.urls(table(spark, d, "pages")).select("page_id", "url")).select("page_id", "video_id", "error")


def q_stage_key(spark, d):
    return _segments(spark, d).select("video_id", "index", jobs.stage_key(F.col("text"), F.col("speaker"), F.col("index")).alias("key"))


def q_dub_plan(spark, d):
    segments = _segments(spark, d).withColumn("speaker", F.lit(None).cast("string"))
    plan = dub_plan(segments, _turns(spark, d), ["de", "fr"], Settings(chars_per_second=16.0))
    return plan.groupBy("video_id", "target_lang").agg(F.count("*").alias("segments"), F.count_if("stretched").alias("stretched"), F.max("factor").alias("max_factor"), F.sum("budget").alias("budget"))


def q_translation_batches(spark, d):
    return planning.translation_batches(_segments(spark, d), 3, 1)


def q_overshoots(spark, d):
    return planning.overshoots(_segments(spark, d), translation.char_budget())


def q_with_package(spark, d):
    """Pairs of the language fan-out; only those out of English have a package."""
    rows = jobs.fan_out(_segments(spark, d).select("video_id", "index", F.when(F.col("index") % 2 == 0, "en").otherwise("pl").alias("source_lang")), ["de", "fr"])
    packages = spark.createDataFrame([("en", "de", "en-de-1"), ("en", "fr", "en-fr-1")], "from_code string, to_code string, package string")
    return planning.with_package(rows, packages, strict=False).select("video_id", "index", "source_lang", "target_lang", "package")


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

# ---- the same in SQL ----------------------------------------------------------------------------

_SEGMENTS = """segments AS (
  SELECT conv_id AS video_id, turn AS index, start, start + length(text) / 16.0::DOUBLE AS "end", text,
    text || ' ' || substr(text, 1, length(text) % 40) AS translated, role AS speaker
  FROM (SELECT *, coalesce(sum(length(text) + 8) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / 16 AS start FROM conversations))"""
_CLIPS = _SEGMENTS + """, clips AS (SELECT *, (length(translated) * 1000) // (12 + index % 8) AS clip_ms, greatest(0, "end" - start) AS slot FROM segments),
factors AS (
  SELECT *, CASE WHEN slot > 0.05 AND clip_ms / 1000.0::DOUBLE > slot THEN least(clip_ms / 1000.0::DOUBLE / slot, 1.4::DOUBLE)
    WHEN slot > 0.05 AND clip_ms / 1000.0::DOUBLE < slot * 0.85::DOUBLE THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM clips),
plan AS (
  SELECT video_id, index, trunc(start * 1000)::BIGINT AS position_ms, factor, abs(factor - 1) > 0.001 AS stretched,
    CASE WHEN abs(factor - 1) > 0.001 THEN trunc(clip_ms / factor)::BIGINT ELSE clip_ms END AS placed_ms, "end", clip_ms, start FROM factors)"""
_TURNS = _SEGMENTS + """, turns AS (SELECT video_id, index AS ord, start + 0.375 AS start, "end" + 0.25 AS "end", speaker FROM segments WHERE index % 5 <> 4)"""
_ASSIGNED = _TURNS + """, pairs AS (
  SELECT s.video_id, s.index, t.ord, t.speaker, least(s."end", t."end") - greatest(s.start, t.start) AS o,
    abs((t.start + t."end") / 2 - (s.start + s."end") / 2) AS gap FROM segments s JOIN turns t USING (video_id)),
assigned AS (
  SELECT s.*, coalesce(
    (SELECT arg_min(p.speaker, (-p.o, p.ord)) FROM pairs p WHERE p.video_id = s.video_id AND p.index = s.index AND p.o > 0),
    (SELECT arg_min(p.speaker, (p.gap, p.ord)) FROM pairs p WHERE p.video_id = s.video_id AND p.index = s.index)) AS voice FROM segments s)"""
_WORDS = r"""tokens AS (
  SELECT doc_id AS video_id, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '') AS t FROM documents),
flat AS (SELECT video_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM tokens),
timed AS (
  SELECT *, coalesce(sum(length(token) + CASE WHEN pos % 11 = 10 THEN 12 ELSE 1 END)
    OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / 16 AS start FROM flat),
words AS (SELECT video_id, pos, start, start + length(token) / 16.0::DOUBLE AS "end", CASE WHEN pos > 0 THEN ' ' ELSE '' END || token AS word FROM timed)"""


def _sentences(chars: int, seconds: float, source: str = "words") -> str:
    return rf""", cuts AS (
  SELECT *, (regexp_matches(word, '[.!?…。！？]+["''”’)]?\s*$') OR coalesce(lead(start) OVER w - "end" > 0.6, false))::INT AS cut
  FROM {source} WINDOW w AS (PARTITION BY video_id ORDER BY pos)),
grouped AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM cuts),
lists AS (
  SELECT video_id, g, list({{'done': []::STRUCT(s DOUBLE, e DOUBLE, t VARCHAR)[], 't': word, 's': start, 'e': "end"}} ORDER BY pos) AS w FROM grouped GROUP BY ALL),
folds AS (
  SELECT video_id, g, list_reduce(w, lambda a, x: CASE
      WHEN length(trim(coalesce(a.t, '') || x.t)) >= {chars} OR x.e - coalesce(a.s, x.s) >= {seconds}
      THEN {{'done': list_append(a.done, {{'s': coalesce(a.s, x.s), 'e': x.e, 't': trim(coalesce(a.t, '') || x.t)}}), 't': ''::VARCHAR, 's': NULL::DOUBLE, 'e': NULL::DOUBLE}}
      ELSE {{'done': a.done, 't': coalesce(a.t, '') || x.t, 's': coalesce(a.s, x.s), 'e': x.e}} END,
    {{'done': []::STRUCT(s DOUBLE, e DOUBLE, t VARCHAR)[], 't': ''::VARCHAR, 's': NULL::DOUBLE, 'e': NULL::DOUBLE}}) AS f FROM lists),
pieces AS (SELECT video_id, g, CASE WHEN f.s IS NULL THEN f.done ELSE list_append(f.done, {{'s': f.s, 'e': f.e, 't': trim(f.t)}}) END AS p FROM folds),
built AS (SELECT video_id, g, unnest(range(len(p))) AS k, unnest(p) AS x FROM pieces),
sentences AS (
  SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY g, k) - 1)::INT AS index, x.s AS start, x.e AS "end", x.t AS text FROM built WHERE x.t <> '')"""


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


_URLS = """urls AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://www.youtube.com/watch?v=' || substr(md5(page_id::VARCHAR), 1, 11)
  WHEN 1 THEN 'https://youtu.be/' || substr(md5(page_id::VARCHAR), 1, 11) || '?si=x' WHEN 2 THEN 'https://youtube.com/shorts/' || substr(md5(page_id::VARCHAR), 1, 11) ELSE url END AS url FROM pages),
ids AS (SELECT page_id, url, nullif(regexp_extract(url, '(?:v=|/shorts/|youtu\\.be/|/)([0-9A-Za-z_-]{11})(?:[?&/]|$)', 1), '') AS video_id FROM urls)""".replace("\\\\", "\\")
_STAMP = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
_MS = "round_even(greatest({0}, 0) * 1000, 0)::BIGINT"



def _merged(text: str, speaker: str, source: str) -> str:
    """Short-fragment merging as a recursion over the rows of each video."""
    return f""", f AS (
  SELECT video_id, index, {speaker} AS speaker, start, "end", {text} AS t, row_number() OVER (PARTITION BY video_id ORDER BY index) AS n FROM {source}),
fold AS (
  SELECT video_id, 0::BIGINT AS n, NULL::BIGINT AS index, NULL::VARCHAR AS out_speaker, NULL::VARCHAR AS text, ''::VARCHAR AS carry, NULL::VARCHAR AS speaker FROM f WHERE n = 1
  UNION ALL
  SELECT video_id, n, CASE WHEN short THEN NULL ELSE index END, x_speaker, CASE WHEN short THEN NULL ELSE body END,
    CASE WHEN short THEN body WHEN joins THEN '' ELSE carry END, CASE WHEN short THEN x_speaker WHEN joins THEN NULL ELSE speaker END
  FROM (SELECT *, length(rtrim(body, '.,!?…')) < 3 AS short FROM (
    SELECT o.video_id, f.n, f.index, f.speaker AS x_speaker, o.carry, o.speaker, o.carry <> '' AND o.speaker IS NOT DISTINCT FROM f.speaker AS joins,
      CASE WHEN o.carry <> '' AND o.speaker IS NOT DISTINCT FROM f.speaker THEN trim(o.carry || ' ' || f.t) ELSE f.t END AS body
    FROM fold o JOIN f ON f.video_id = o.video_id AND f.n = o.n + 1))),
ends AS (SELECT video_id, arg_max(carry, n) AS carry, arg_max((speaker,), n)[1] AS speaker FROM fold GROUP BY video_id),
emitted AS (SELECT * FROM fold WHERE index IS NOT NULL),
lasts AS (SELECT e.video_id, max(e.index) AS index, any_value(x.carry) AS carry FROM emitted e JOIN ends x ON x.video_id = e.video_id AND x.carry <> '' AND x.speaker IS NOT DISTINCT FROM e.out_speaker GROUP BY e.video_id),
merged AS (
  SELECT e.video_id, e.index, f.speaker, f.start, f."end", e.text || coalesce(' ' || l.carry, '') AS text
  FROM emitted e JOIN f ON f.video_id = e.video_id AND f.index = e.index LEFT JOIN lasts l ON l.video_id = e.video_id AND l.index = e.index)"""


SQL = {
    "video_id": f"WITH {_URLS} SELECT page_id, video_id FROM ids",
    "checked_requests": f"WITH {_URLS} SELECT page_id, video_id, CASE WHEN video_id IS NULL THEN 'not a video url' END AS error FROM ids",
    "srt_timestamp": f"SELECT event_id, {_STAMP.format('ms')} AS stamp FROM (SELECT event_id, {_MS.format('value * 37 - 10')} AS ms FROM events)",
    "atempo_chain": """WITH f AS (SELECT event_id, least(greatest(floor(abs(value) * 16) / 256.0, 0.25), 4.0)::DOUBLE AS f FROM events)
SELECT event_id, CASE WHEN f > 2 THEN printf('atempo=2.000000,atempo=%.6f', f / 2) WHEN f < 0.5 THEN printf('atempo=0.500000,atempo=%.6f', f / 0.5) ELSE printf('atempo=%.6f', f) END AS chain FROM f""",
    "llm_clean": r"""WITH raw AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '<think>a' || chr(10) || 'b</think> ' || b WHEN 1 THEN '```text' || chr(10) || b || chr(10) || '```'
  WHEN 2 THEN '"' || b || '"' WHEN 3 THEN 'Translation: ' || b WHEN 4 THEN 'OUTPUT : "' || b || '"' ELSE '  ' || b || ' ' END AS t FROM (SELECT doc_id, text AS b FROM documents)),
a AS (SELECT doc_id, regexp_replace(regexp_replace(t, '<think>.*?</think>', '', 'gs'), '^\s+|\s+$', '', 'g') AS t FROM raw),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '^```[a-zA-Z]*\n?', ''), '\n?```$', ''), '^\s+|\s+$', '', 'g') AS t FROM a),
c AS (SELECT doc_id, CASE WHEN length(t) > 1 AND substr(t, 1, 1) IN ('"', '''') AND substr(t, 1, 1) = right(t, 1) THEN regexp_replace(substr(t, 2, length(t) - 2), '^\s+|\s+$', '', 'g') ELSE t END AS t FROM b)
SELECT doc_id, regexp_replace(regexp_replace(t, '^(translation|translated text|output)\s*:\s*', '', 'i'), '^\s+|\s+$', '', 'g') AS cleaned FROM c""",
    "char_budget": f"WITH {_SEGMENTS} SELECT video_id, index, greatest(20, trunc(greatest(0, \"end\" - start) * 15.0::DOUBLE * 1.4::DOUBLE)::INT) AS budget, length(coalesce(nullif(regexp_replace(translated, '^\\s+|\\s+$', '', 'g'), ''), text))::INT AS chars FROM segments",
    "pick_candidate": """WITH b AS (SELECT doc_id, (doc_id % 600)::INT AS budget, list_concat(string_split(text, chr(10)), [' ' || text, text, '  ']) AS o, text FROM documents),
options AS (SELECT doc_id, budget, regexp_replace(unnest(o), '^\\s+|\\s+$', '', 'g') AS c, unnest(range(len(o))) AS i FROM b),
clean AS (SELECT doc_id, budget, c, min(i) AS i FROM options WHERE c <> '' GROUP BY doc_id, budget, c),
ranked AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY length(c) <= budget DESC, CASE WHEN length(c) <= budget THEN -length(c) ELSE length(c) END, i) AS n FROM clean)
SELECT b.doc_id, coalesce(r.c, b.text) AS picked FROM b LEFT JOIN ranked r ON r.doc_id = b.doc_id AND r.n = 1""",
    "sentence_segments": f"WITH {_WORDS}{_sentences(140, 8.0)} SELECT * FROM sentences",
    "sentence_segments_tight": f"WITH {_WORDS}{_sentences(30, 2.0)} SELECT * FROM sentences",
    "segment_fallback": f"""WITH {_WORDS}, some_words AS (SELECT * FROM words WHERE video_id % 5 <> 0){_sentences(140, 8.0, "some_words")},
raw AS (SELECT doc_id AS video_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS seq FROM documents),
bare AS (SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY seq) - 1)::INT AS index, seq::DOUBLE AS start, seq + 1.0::DOUBLE AS "end", trim(text) AS text FROM raw
  WHERE trim(text) <> '' AND video_id NOT IN (SELECT video_id FROM some_words)),
every AS (SELECT * FROM sentences UNION ALL SELECT * FROM bare)
SELECT * FROM every""",
    "assign_speakers": f"WITH {_ASSIGNED} SELECT video_id, index, voice AS speaker FROM assigned",
    "reference_clips": f"""WITH {_SEGMENTS}, ms AS (SELECT video_id, speaker, index, trunc(start * 1000)::BIGINT AS from_ms, greatest(0, trunc("end" * 1000)::BIGINT - trunc(start * 1000)::BIGINT) AS ms FROM segments),
g AS (SELECT *, coalesce(sum(ms) OVER (PARTITION BY video_id, speaker ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS gathered FROM ms)
SELECT video_id, speaker, index, from_ms, least(ms, 20000 - gathered) AS take_ms FROM g WHERE gathered < 20000""",
    "reference_lookup": f"""WITH {_SEGMENTS}, v AS (SELECT video_id, index, CASE WHEN index % 5 = 4 THEN NULL ELSE speaker END AS speaker FROM segments),
refs AS (SELECT video_id, speaker, min(index) AS first_index, CASE WHEN speaker IS NULL THEN 'reference.wav' ELSE 'reference_' || speaker || '.wav' END AS path FROM v GROUP BY ALL),
asked AS (SELECT video_id, index, CASE WHEN index % 7 = 6 THEN 'stranger' WHEN index % 5 = 4 THEN NULL ELSE speaker END AS speaker FROM segments)
SELECT a.video_id, a.index, a.speaker, coalesce(r.path, (SELECT arg_min(d.path, (d.speaker IS NOT NULL, d.first_index)) FROM refs d WHERE d.video_id = a.video_id)) AS reference
FROM asked a LEFT JOIN refs r ON r.video_id = a.video_id AND r.speaker IS NOT DISTINCT FROM a.speaker""",
    "context_window": f"""WITH {_SEGMENTS}, t AS (SELECT video_id, index, {_strip('text')} AS source, CASE WHEN index % 3 = 2 THEN '' ELSE {_strip('translated')} END AS target FROM segments),
p AS (SELECT a.video_id, a.index, b.index AS k, b.source || ' -> ' || b.target AS line, row_number() OVER (PARTITION BY a.video_id, a.index ORDER BY b.index DESC) AS n
  FROM t a JOIN t b ON b.video_id = a.video_id AND b.index < a.index AND b.source <> '' AND b.target <> '')
SELECT t.video_id, t.index, count(p.k)::INT AS lines, md5(coalesce(string_agg(p.line, chr(10) ORDER BY p.k), '')) AS context_md5
FROM t LEFT JOIN p ON p.video_id = t.video_id AND p.index = t.index AND p.n <= 6 GROUP BY ALL""",
    "merge_fragments": "WITH RECURSIVE " + _SEGMENTS + _merged("trim(CASE WHEN (video_id + index) % 3 = 0 THEN substr(text, 1, (1 + index % 3)::INT) ELSE text END)", "speaker", "segments") + " SELECT * FROM merged",
    "prompts": f"""WITH {_SEGMENTS}, t AS (SELECT *, {_strip('text')} AS source, {_strip('translated')} AS target, greatest(20, trunc(greatest(0, "end" - start) * 15.0::DOUBLE * 1.4::DOUBLE)::INT) AS budget FROM segments),
p AS (SELECT a.video_id, a.index, b.index AS k, '  ' || b.source || '  ->  ' || b.target AS line, row_number() OVER (PARTITION BY a.video_id, a.index ORDER BY b.index DESC) AS n FROM t a JOIN t b ON b.video_id = a.video_id AND b.index < a.index AND b.source <> '' AND b.target <> ''),
c AS (SELECT video_id, index, string_agg(line, chr(10) ORDER BY k) AS lines FROM p WHERE n <= 6 GROUP BY ALL)
SELECT t.video_id, t.index, coalesce('Earlier lines, for context:' || chr(10) || c.lines, 'Opening line: it sets the tone.') || chr(10) || chr(10) || 'Line to translate:' || chr(10) || t.source || chr(10) || chr(10)
  || 'At most about ' || t.budget || ' characters, but keep the meaning.' AS prompt FROM t LEFT JOIN c ON c.video_id = t.video_id AND c.index = t.index""",
    "dub_plan": "WITH RECURSIVE " + _ASSIGNED + _merged(f"coalesce(nullif({_strip('translated')}, ''), text)", "voice", "assigned") + """,
sized AS (SELECT *, greatest(0, "end" - start) AS slot, trunc(length(text) * 1000 / 16.0::DOUBLE)::BIGINT AS clip_ms FROM merged),
fitted AS (SELECT *, greatest(20, trunc(slot * 16.0::DOUBLE * 1.4::DOUBLE)::INT) AS budget,
  CASE WHEN slot > 0.05 AND clip_ms / 1000.0::DOUBLE > slot THEN least(clip_ms / 1000.0::DOUBLE / slot, 1.4::DOUBLE)
    WHEN slot > 0.05 AND clip_ms / 1000.0::DOUBLE < slot * 0.85::DOUBLE THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM sized)
SELECT video_id, target_lang, count(*) AS segments, count(*) FILTER (WHERE abs(factor - 1) > 0.001) AS stretched, max(factor) AS max_factor, sum(budget)::BIGINT AS budget
FROM fitted, (VALUES ('de'), ('fr')) t(target_lang) GROUP BY ALL""",
    "align_plan": f"WITH {_CLIPS} SELECT video_id, index, position_ms, factor, stretched, placed_ms FROM plan",
    "align_report": f"""WITH {_CLIPS} SELECT video_id, count(*) AS clips, count(*) FILTER (WHERE stretched) AS stretched, max(factor) AS max_factor, min(factor) AS min_factor,
trunc(greatest(0, max("end")) * 1000)::BIGINT + 200 AS timeline_ms FROM plan GROUP BY video_id""",
    "timeline_fit": f"""WITH {_CLIPS}, p AS (SELECT video_id, index, position_ms AS source_ms, coalesce(sum(clip_ms) OVER (PARTITION BY video_id ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS played FROM plan),
q AS (SELECT *, played + max(source_ms - played) OVER (PARTITION BY video_id ORDER BY index) AS fit_ms FROM p)
SELECT video_id, index, source_ms, fit_ms, fit_ms - source_ms AS delay_ms FROM q""",
    "slack_budget": f"WITH {_SEGMENTS} SELECT video_id, index, trunc(greatest(0, coalesce(lead(start) OVER (PARTITION BY video_id ORDER BY index), \"end\") - start) * 15.0::DOUBLE)::INT AS budget FROM segments",
    "overflow_report": f"""WITH {_CLIPS}, o AS (SELECT *, greatest(0, position_ms + placed_ms - lead(position_ms) OVER (PARTITION BY video_id ORDER BY index)) AS over_ms FROM plan)
SELECT video_id, count(*) AS clips, count(*) FILTER (WHERE stretched) AS stretched, count(*) FILTER (WHERE over_ms > 0) AS overflowing, coalesce(max(over_ms), 0)::BIGINT AS worst_over_ms FROM o GROUP BY video_id""",
    "clean_references": f"""WITH {_TURNS}, alone AS (SELECT * FROM turns a WHERE NOT EXISTS (
  SELECT 1 FROM turns b WHERE b.video_id = a.video_id AND b.ord <> a.ord AND b.start < a."end" AND b."end" > a.start)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id, speaker ORDER BY "end" - start DESC, ord) AS n FROM alone)
SELECT video_id, speaker, ord AS index, "end" - start AS seconds FROM ranked WHERE n = 1""",
    "srt_render": f"""WITH {_SEGMENTS}, c AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY index) AS n, {_MS.format('start')} AS a, {_MS.format('"end"')} AS b, {_strip("coalesce(nullif(translated, ''), text)")} AS t FROM segments),
s AS (SELECT video_id, string_agg(n || chr(10) || {_STAMP.format('a')} || ' --> ' || {_STAMP.format('b')} || chr(10) || t || chr(10), chr(10) ORDER BY n) AS srt FROM c GROUP BY video_id)
SELECT video_id, md5(srt) AS srt_md5, length(srt)::INT AS chars FROM s""",
    "language_fanout": "WITH " + _SEGMENTS + ", langs(target_lang, target_name, supported) AS (VALUES "
    + ", ".join(f"('{x}', '{DISPLAY_NAMES.get(x, x)}', {str(x in VOICES['openvoice']).lower()})" for x in [*DEFAULT_TARGETS, "xx"])
    + ") SELECT video_id, index, target_lang, target_name, supported FROM segments, langs",
    "speaker_count": f"WITH {_SEGMENTS}, v AS (SELECT video_id, CASE WHEN index % 5 = 4 THEN NULL ELSE speaker END AS s FROM segments) SELECT video_id, count(DISTINCT s) + max((s IS NULL)::BIGINT) AS speakers, count(*) AS segments FROM v GROUP BY video_id",
    "glossary_hits": "SELECT doc_id % 10 AS video_id, term, count(*) AS hits FROM documents JOIN (VALUES " + ", ".join(f"('{t}')" for t in TERMS) + ") t(term) ON contains(text, term) GROUP BY ALL",
    "job_latest": "SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events GROUP BY user_id",
    "translation_batches": f"""WITH {_SEGMENTS}, n AS (SELECT video_id, index, row_number() OVER (PARTITION BY video_id ORDER BY index) - 1 AS n, max(index) OVER (PARTITION BY video_id) AS last FROM segments)
SELECT video_id, (n // 3)::INT AS batch, index, false AS is_context FROM n UNION ALL SELECT video_id, (n // 3 + 1)::INT, index, true FROM n WHERE n % 3 = 2 AND index < last""",
    "overshoots": f"""WITH {_SEGMENTS}, b AS (SELECT video_id, index, length(coalesce(nullif(translated, ''), text))::INT AS chars, greatest(20, trunc(greatest(0, "end" - start) * 15.0::DOUBLE * 1.4::DOUBLE)::INT) AS budget FROM segments)
SELECT * FROM b WHERE chars > budget""",
    "with_package": f"""WITH {_SEGMENTS} SELECT video_id, index, CASE WHEN index % 2 = 0 THEN 'en' ELSE 'pl' END AS source_lang, target_lang, CASE WHEN index % 2 = 0 THEN 'en-' || target_lang || '-1' END AS package
FROM segments, (VALUES ('de'), ('fr')) t(target_lang)""",
    "stage_key": f"WITH {_SEGMENTS} SELECT video_id, index, sha256(text || chr(1) || speaker || chr(1) || index) AS key FROM segments",
}
