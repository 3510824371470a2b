"""Jobs, fan-out over languages, publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions.languages import DEFAULT_TARGETS, display_name, voice_supports
from cuegrid.functions.text import video_id


def latest_jobs(log: DataFrame) -> DataFrame:
    """job_id, status, ts: each job's newest entry, by time and then event_id. An aggregation, so a job
    with a long history combines before it shuffles."""
    newest = F.max(F.struct("ts", "event_id", "status")).alias("n")
    return log.groupBy("job_id").agg(newest).select("job_id", "n.status", "n.ts")


def fan_out(rows: DataFrame, targets: list[str] | None = None, backend: str = "chatterbox") -> DataFrame:
    """Every row once per target language, with its name and whether the voices support it."""
    langs = F.array(*[F.lit(x) for x in (targets or DEFAULT_TARGETS)])
    out = rows.select("*", F.explode(langs).alias("target_lang"))
    return out.select("*", display_name(F.col("target_lang")).alias("target_name"), voice_supports(backend, F.col("target_lang")).alias("supported"))


def checked_requests(requests: DataFrame) -> DataFrame:
    """Requests with ``video_id`` and ``error`` (null if the url is one)."""
    return requests.withColumn("video_id", video_id(F.col("url"))).withColumn("error", F.when(F.col("video_id").isNull(), F.lit("not a video url")))


def lookup_jobs(asked: DataFrame, jobs: DataFrame) -> DataFrame:
    """``asked`` (job_id) -> job_id, status, code, detail: 200 with the job's status, or 404 if there is none."""
    rows = asked.join(jobs.select("job_id", "status"), "job_id", "left")
    unknown = F.col("status").isNull()
    return rows.select("job_id", "status", F.when(unknown, 404).otherwise(200).alias("code"), F.when(unknown, F.lit("Unknown job")).alias("detail"))


def lookup_results(asked: DataFrame, jobs: DataFrame) -> DataFrame:
    """``asked`` (job_id) -> job_id, output_path, code, detail: 200 for completed jobs (job_id, status, output_path)
    that have a file, else 404."""
    rows = asked.join(jobs.select("job_id", "status", "output_path"), "job_id", "left")
    ready = F.coalesce((F.col("status") == "completed") & (F.col("output_path") != ""), F.lit(False))
    return rows.select("job_id", F.when(ready, F.col("output_path")).alias("output_path"), F.when(ready, 200).otherwise(404).alias("code"), F.when(~ready, F.lit("Video not ready")).alias("detail"))


def output_name(base: Column, lang: Column, kind: Column | str) -> Column:
    return F.concat_ws(".", base, lang, F.lit(kind) if isinstance(kind, str) else kind)


def newest_outputs(files: DataFrame) -> DataFrame:
    """base, lang, kind, path: the newest file of each."""
    newest = F.row_number().over(Window.partitionBy("base", "lang", "kind").orderBy(F.desc("mtime"), "path"))
    return files.withColumn("__n", newest).filter("__n = 1").drop("__n")


def failed_languages(results: DataFrame) -> DataFrame:
    """base, failed: the languages whose run has an error; the others are unaffected."""
    return results.groupBy("base").agg(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.col("lang")))).alias("failed"))


def stage_cache(work: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """Extension: ``work`` (base, lang, stage, key) with ``output`` from ``cache`` (base, lang, stage, key, output)
    and ``state``: cached where a result of the same inputs is kept, stale where only one of other inputs
    is, missing otherwise; ``force`` makes everything missing. lang is null for stages that do not
    depend on it."""
    kept = cache.groupBy("base", "lang", "stage").agg(F.collect_set(F.struct("key", "output")).alias("kept"))
    names = ["base", "lang", "stage"]
    right = kept.select(*[F.col(c).alias(f"c_{c}") for c in names], "kept")
    same = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in names]
    rows = work.join(right, same[0] & same[1] & same[2], "left")
    hit = F.array_min(F.transform(F.filter("kept", lambda k: k["key"] == F.col("key")), lambda k: k["output"]))
    output = F.lit(None).cast("string") if force else hit
    state = F.when(output.isNotNull(), "cached").when(F.lit(not force) & F.col("kept").isNotNull(), "stale").otherwise("missing")
    return rows.select(*work.columns, output.alias("output"), state.alias("state"))


def stage_metrics(stage: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, object]:
    """``stage`` with an observation of it (its rows by default), and the observation; its ``get`` holds the
    figures once the stage has been written, without a pass of its own."""
    from pyspark.sql import Observation

    seen = Observation(name)
    found = metrics or {"rows": F.count(F.lit(1))}
    return stage.observe(seen, *[column.alias(key) for key, column in found.items()]), seen


def stage_key(*inputs: Column) -> Column:
    """Extension: the key under which a stage's result is kept, a digest of its inputs."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in inputs]), 256)
