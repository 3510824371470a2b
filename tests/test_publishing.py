"""Slots, sources, publishing, the command line and the extensions."""

import json

import pytest
from pyspark.sql import functions as F

from cuegrid import cli, scratch
from cuegrid.functions import languages
from cuegrid.operators import backends, jobs, planning, publish, segmentation, timeline, translation
from cuegrid.plans.dub import dub_summary
from cuegrid.settings import Settings
from cuegrid.sources import files

SEGMENT = "video_id long, index int, start double, end double, text string, translated string, speaker string"


def test_slots_keep_failed_rows(spark):
    media = spark.createDataFrame([(1, "one two three four five"), (2, None), (3, "")], "video_id long, path string")
    heard = backends.transcribe(media).orderBy("video_id", "seq").collect()
    assert [(r.video_id, r.seq, r.text) for r in heard if not r.error] == [(1, 0, " one two three four"), (1, 1, " five")]
    assert [r.video_id for r in heard if r.error] == [2]
    words = segmentation.explode_transcript(backends.transcribe(media).filter("error is null")).collect()
    assert [(r.pos, r.word) for r in words] == [(i, f" {w}") for i, w in enumerate("one two three four five".split())]
    turns = backends.diarize(media).collect()
    assert {r.video_id for r in turns if r.error} == {2} and sum(r.video_id == 1 for r in turns) == 1 + 23 % 5
    got = backends.download(spark.createDataFrame([(1, "u"), (2, None)], "video_id long, url string")).orderBy("video_id").collect()
    assert got[0].path.endswith(".mp4") and got[0].seconds == 1.0 and got[1].path is None and got[1].error
    with pytest.raises(ValueError, match="unknown diarizer"):
        backends.model("diarizer", "nobody")


def test_identify_speakers(spark):
    segments = spark.createDataFrame([(1, i, i * 1.0, i + 1.0, "x", None, "old") for i in range(4)], SEGMENT)
    media = spark.createDataFrame([(1, "abcd")], "video_id long, path string")
    assert [r.speaker for r in backends.identify_speakers(media, segments, "turns").orderBy("index").collect()] == ["SPK0", "SPK0", "SPK1", "SPK1"]
    by_voice = backends.identify_speakers(media, segments, speakers=2).collect()
    assert {r.speaker for r in by_voice} == {"SPK0", "SPK1"}
    with pytest.raises(ValueError, match="unknown method"):
        backends.identify_speakers(media, segments, "ear")


def test_transcript_guard(spark):
    segments = spark.createDataFrame([(1, 0, 0.0, 1.0, "x", None, None)], SEGMENT)
    assert backends.require_transcripts(segments.select("video_id"), segments).first().segments == 1
    with pytest.raises(Exception, match="no speech was found in video 2"):
        backends.require_transcripts(spark.createDataFrame([(1,), (2,)], "video_id long"), segments).collect()


def test_voice_errors(spark):
    df = spark.createDataFrame([("en",), ("sv",), (None,)], "code string")
    got = [r[0] for r in df.select(languages.voice_error("openvoice", F.col("code"))).collect()]
    assert got[0] is None and got[1] == "openvoice cannot speak sv; supported: en, es, fr, ja, ko, zh" and "null" in got[2]
    with pytest.raises(Exception, match="cannot speak sv; supported: en, es"):
        df.filter("code = 'sv'").select(languages.checked_voice("openvoice", F.col("code"))).collect()
    assert df.filter("code = 'en'").select(languages.checked_voice("openvoice", F.col("code"))).first()[0] == "en"


def test_file_sources(spark, tmp_path):
    assert files.read_glossary(spark, str(tmp_path / "none.txt")).count() == 0 and files.read_glossary(spark, None).count() == 0
    (tmp_path / "plot.txt").write_text("# note\n Two friends sail.\n\nThey argue.\n")
    assert files.read_synopsis(spark, str(tmp_path / "plot.txt")).first().text == "Two friends sail.\nThey argue."
    assert files.read_synopsis(spark, "Just a talk: about *boats*?").first().text == "Just a talk: about *boats*?"
    assert files.read_synopsis(spark, None).first().text == ""
    styles = files.read_styles(spark, str(tmp_path))
    assert files.pick_style(styles, "plot").first().text.startswith("Two friends")
    with pytest.raises(Exception, match="no style called duo; available: plot"):
        files.pick_style(styles, "duo").collect()
    media = spark.createDataFrame([(1, "a.mp4"), (2, "b.mp4")], "video_id long, path string")
    probes = spark.createDataFrame([("a.mp4", "12.5"), ("b.mp4", "N/A")], "path string, answer string")
    got = files.acquire_local(media, probes, "w").orderBy("video_id").collect()
    assert [(r.seconds, r.track) for r in got] == [(12.5, "w/1.wav"), (0.0, "w/2.wav")] and "16000" in got[0].command


def test_prompts_and_bodies(spark):
    df = spark.createDataFrame([("de", "about boats", ["Kestrel"]), ("xx", None, None)], "code string, plot string, terms array<string>")
    full, bare = [r[0] for r in df.select(translation.system_prompt(F.lit("en"), F.col("code"), F.col("plot"), F.col("terms"))).collect()]
    assert "into German." in full and "About the video:\nabout boats" in full and full.endswith("Never translate these terms:\n  Kestrel")
    assert "About the video" not in bare and "Never translate" not in bare and bare.count("\n- ") == len(translation.RULES)
    body = df.select(translation.request_body("m", F.lit("line \"1\""), F.col("code"))).first()[0]
    assert json.loads(body) == {"model": "m", "prompt": 'line "1"', "system": "de", "stream": False, "think": False, "options": {"temperature": 0.3, "num_predict": 512}}
    replies = spark.createDataFrame([('{"response": "<think>x</think> Hallo"}',), ("broken",), ("{}",), (None,)], "b string")
    assert [r[0] for r in replies.select(translation.response_text(F.col("b"))).collect()] == ["Hallo", "", "", ""]
    assert [r[0] for r in spark.range(1).select(translation.generation_cap(F.lit(10)), translation.generation_cap(F.lit(999))).collect()] == [36]
    assert spark.range(1).select(translation.generation_cap(F.lit(999))).first()[0] == 400


def test_glossary_hits(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "the kestrel and the Kestrel"), (1, "Kestrel"), (2, "est"), (2, None), (2, "")], "video_id long, text string")
    terms = spark.createDataFrame([("Kestrel",), ("est",), ("est",), ("",), ("none of it",)], "term string")
    want = {(1, "Kestrel", 2), (1, "est", 2), (2, "est", 1)}
    assert {tuple(r) for r in translation.glossary_hits(texts, terms).collect()} == want
    monkeypatch.setattr(translation, "TERMS_BLOCK", 1)
    assert {tuple(r) for r in translation.glossary_hits(texts, terms).collect()} == want
    assert translation.glossary_hits(texts, terms.limit(0)).count() == 0


def test_publish(spark):
    streams = spark.createDataFrame([(1, "audio"), (1, "video"), (2, "audio")], "video_id long, codec_type string")
    assert {r.video_id: r.has_video for r in publish.has_video(streams).collect()} == {1: True, 2: False}
    dubs = spark.createDataFrame([(1, "de", "v", "a", True), (2, "de", "v", "a", False)], "video_id long, target_lang string, video_path string, audio_path string, has_video boolean")
    plain = {r.video_id: r for r in publish.publish_plan(dubs).collect()}
    assert plain[1].out_path == "1.de.mp4" and len(plain[1].steps) == 1 and plain[2].out_path == "2.de.wav" and plain[2].steps is None
    burnt = publish.publish_plan(dubs, reencode=True, subtitles=True).filter("video_id = 1").first()
    assert burnt.out_path == "1.de.subbed.mp4" and "libx264" in burnt.steps[0] and burnt.steps[1][-1] == "1.de.subbed.mp4"
    made = [("f", "de", "a.mp4", 1, "mp4"), ("f", "de", "b.wav", 2, "wav"), ("f", "de", "c.srt", 1, "srt"), ("f", "fr", "d.mkv", 1, "mkv"), ("f", "fr", "e.txt", 9, "txt")]
    files_ = spark.createDataFrame(made, "base string, lang string, path string, mtime int, kind string")
    got = {(r.lang, r.destination): (r.source, r.command) for r in publish.batch_publish(files_).collect()}
    assert got["de", "f/de.wav"] == ("b.wav", None) and got["de", "f/de.srt"] == ("c.srt", None) and got["fr", "f/fr.wav"][1][-1] == "f/fr.wav" and len(got) == 3


def test_timeline_export(spark, tmp_path):
    clips = spark.createDataFrame([(1, 0, 0.0, 1.0, 1500), (1, 1, 2.0, 3.0, 950)], "video_id long, index int, start double, end double, clip_ms long")
    rows = publish.timeline_export(clips).orderBy("index").collect()
    assert rows[0].command[-1] == "aligned_0000.wav" and rows[1].command is None and rows[1].file == "seg_0001.wav"
    publish.write_timeline(clips, str(tmp_path / "plan"))
    assert spark.read.parquet(str(tmp_path / "plan")).count() == 2


def test_job_lookups(spark):
    table = spark.createDataFrame([(1, "completed", "1.mp4"), (2, "queued", None), (3, "completed", "")], "job_id long, status string, output_path string")
    asked = spark.createDataFrame([(1,), (2,), (3,), (9,)], "job_id long")
    assert {r.job_id: (r.code, r.detail) for r in jobs.lookup_jobs(asked, table).collect()} == {1: (200, None), 2: (200, None), 3: (200, None), 9: (404, "Unknown job")}
    assert {r.job_id: (r.code, r.output_path) for r in jobs.lookup_results(asked, table).collect()} == {1: (200, "1.mp4"), 2: (404, None), 3: (404, None), 9: (404, None)}
    queue = spark.createDataFrame([(5, "queued", 3), (4, "queued", 2), (6, "processing", 1), (7, "queued", 2)], "job_id long, status string, ts int")
    assert {r.job_id: r.place for r in publish.next_job(queue).collect()} == {4: 0, 7: 1, 5: 2}


def test_stage_cache_and_metrics(spark):
    work = spark.createDataFrame([("f", None, "asr", "k1"), ("f", "de", "mt", "k2"), ("g", None, "asr", "k1")], "base string, lang string, stage string, key string")
    cache = spark.createDataFrame([("f", None, "asr", "k1", "o1"), ("f", "de", "mt", "old", "o2"), ("f", "de", "mt", "older", "o3")], "base string, lang string, stage string, key string, output string")
    assert sorted(map(tuple, jobs.stage_cache(work, cache).select("base", "stage", "output", "state").collect()), key=str) == [("f", "asr", "o1", "cached"), ("f", "mt", None, "stale"), ("g", "asr", None, "missing")]
    assert {r.state for r in jobs.stage_cache(work, cache, force=True).collect()} == {"missing"}
    rows, seen = jobs.stage_metrics(spark.range(7), "stage", rows=F.count(F.lit(1)), top=F.max("id"))
    assert rows.count() == 7 and seen.get == {"rows": 7, "top": 6}


def test_exact_fit(spark):
    clips = spark.createDataFrame([(1, 0, 0.0, 1.0, 900), (1, 1, 1.0, 2.0, 1500), (1, 2, 2.0, 3.0, 900), (2, 0, 0.0, 1.0, 400)], "video_id long, index int, start double, end double, clip_ms long")
    totals = spark.createDataFrame([(1, 3000), (2, 1000)], "video_id long, total_ms long")
    got = {(r.video_id, r["index"]): r for r in timeline.exact_fit(clips, totals).collect()}
    assert got[1, 0].factor == 1.0 and got[1, 1].factor == got[1, 2].factor == pytest.approx(1.2)
    assert got[1, 1].fit_ms == 1000 and got[1, 1].fit_ms + got[1, 1].placed_ms == got[1, 2].fit_ms and got[1, 2].fit_ms + got[1, 2].placed_ms == 3000
    assert got[2, 0].pad_ms == 600 and got[2, 0].factor == 1.0
    for r in got.values():
        assert r.fit_ms >= r.source_ms and r.factor <= Settings().max_speedup


def test_extensions(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 1.0, "s", "one two three four five six seven", None), (1, 1, 1.0, 2.0, "s", "fine", None)], SEGMENT)
    cut = lambda text, budget: F.regexp_replace(text, r" \S+\z", "")
    got = planning.shorten_overshoots(rows, F.lit(22), cut, rounds=3).orderBy("index").collect()
    assert [(r.translated, r.attempts) for r in got] == [("one two three four", 3), ("fine", 0)]
    loud = spark.createDataFrame([(1, "de", -14.04, -20.0)], "video_id long, target_lang string, source_lufs double, dub_lufs double")
    assert publish.loudness_match(loud).first().filter == "loudnorm=I=-14.0:TP=-1.5:LRA=11"
    runs = spark.createDataFrame([(1, 10.0, 9.5, [3.0, 4.0], [4.0, 3.0]), (2, 1.0, 1.0, [0.0, 0.0], [1.0, 0.0])], "video_id long, source_seconds double, dub_seconds double, source_voice array<double>, dub_voice array<double>")
    assert [(r.drift, r.timbre) for r in publish.self_test(runs).orderBy("video_id").collect()] == [(0.5, pytest.approx(0.96)), (0.0, None)]
    ran = spark.createDataFrame([("a", 0, None), ("b", 0, None), ("c", 1, "x" * 3000)], "out_path string, exit_code int, stderr string")
    there = spark.createDataFrame([("a",)], "path string")
    errors = {r.out_path: r.error for r in publish.missing_outputs(ran, there).collect()}
    assert errors["a"] is None and "left no file" in errors["b"] and errors["c"] == "tool failed: " + "x" * 2000
    plan = spark.createDataFrame([("de", True, 1.2), ("de", False, 1.0)], "target_lang string, stretched boolean, factor double")
    assert tuple(dub_summary(plan).first()) == ("de", 2, 1, 1.2)


def test_command_line(tmp_path, capsys):
    assert cli.parse(["dub", "a.wav", "--speakers", "2", "de", "--style", "duo", "fr"]) == cli.Run("a.wav", "duo", 2, ("de", "fr"))
    assert cli.parse(["dub", "a.wav", "--srt-only"]).srt_only
    assert cli.parse(["dub", "a.wav"]).targets == tuple(languages.DEFAULT_TARGETS) and cli.parse(["info"]) is None
    cli.main(["info"])
    assert "device: " in capsys.readouterr().out
    layout = cli.Layout(str(tmp_path))
    assert all(p.is_dir() for p in (layout.downloads, layout.work, layout.output))
    assert cli.missing_tools(("surely-no-such-tool",)) == ["surely-no-such-tool"]
    assert cli.lip_sync_errors(None, "x") and len(cli.lip_sync_errors(str(tmp_path), str(tmp_path / "net"))) == 2
    (tmp_path / "inference.py").touch()
    (tmp_path / "net").touch()
    assert cli.lip_sync_errors(str(tmp_path), str(tmp_path / "net")) == []


def test_scratch_needs_a_shared_folder(spark):
    assert scratch.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")

    class Unset:
        def __init__(self, master):
            self.conf, self.sparkContext = self, type("Context", (), {"master": master})

        def get(self, key, default=None):
            return default

        def set(self, key, value):
            assert key == scratch.CLEANUP

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.scratch_root(Unset(master))
    assert scratch.scratch_root(Unset("local[2]")).startswith("file://")
