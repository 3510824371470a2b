"""Length budgets, candidate choice, rolling context and prompts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions.languages import display_name
from cuegrid.functions.text import clean_reply, or_else, strip
from cuegrid.settings import Settings


#: Protected terms that make one automaton, about.
TERMS_BLOCK = 100_000


def duration(start: str = "start", end: str = "end") -> Column:
    return F.greatest(F.lit(0.0), F.col(end) - F.col(start))


def char_budget(settings: Settings = Settings()) -> Column:
    """Characters that fit the slot at the fastest speed, truncated; null when budgets are off."""
    if not settings.chars_per_second:
        return F.lit(None).cast("int")
    fit = duration() * F.lit(float(settings.chars_per_second)) * F.lit(float(settings.max_speedup))
    return F.greatest(F.lit(settings.min_budget), fit.cast("int"))


def accept_translation(translated: Column, text: Column) -> Column:
    """The stripped translation, or the source text where that is empty."""
    return or_else(strip(translated), text)


def translated_or_copied(settings: Settings, translated: Column, text: Column) -> Column:
    """Nothing is translated into its own language."""
    return text if settings.source_lang == settings.target_lang else accept_translation(translated, text)


def pick_candidate(candidates: Column, budget: Column, fallback: Column) -> Column:
    """The longest candidate within the budget, else the shortest; the first one on ties; the fallback
    if there is none. Candidates are stripped, blank and repeated ones ignored."""
    clean = F.array_distinct(F.filter(F.transform(candidates, strip), lambda c: c != ""))
    longest = F.array_max(F.transform(clean, lambda c, i: F.when(F.length(c) <= budget, F.struct(F.length(c).alias("n"), (-i).alias("i"), c.alias("c")))))
    shortest = F.array_min(F.transform(clean, lambda c, i: F.struct(F.length(c).alias("n"), i.alias("i"), c.alias("c"))))
    return F.coalesce(longest["c"], shortest["c"], fallback)


def context_window(segments: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Segments with ``context``: the last pairs (source, target) translated with success before them."""
    ok = strip(F.coalesce("text", F.lit(""))) != ""
    ok = ok & (strip(F.coalesce("translated", F.lit(""))) != "")
    pair = F.when(ok, F.struct(strip(F.col("text")).alias("source"), strip(F.col("translated")).alias("target")))
    # Failed lines leave no trace, so line n of the successful ones is found by its number among them.
    order = Window.partitionBy("video_id").orderBy("index")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    done = segments.withColumn("__pair", pair).withColumn("__done", F.coalesce(F.count("__pair").over(before), F.lit(0)))
    by_number = Window.partitionBy("video_id").orderBy("__done").rangeBetween(-settings.context_lines, -1)
    kept = F.collect_list(F.when(F.col("__pair").isNotNull(), F.struct(F.col("__done").alias("k"), F.col("__pair.source").alias("source"), F.col("__pair.target").alias("target")))).over(by_number)
    context = F.transform(F.array_sort(kept), lambda p: F.struct(p["source"].alias("source"), p["target"].alias("target")))
    return done.withColumn("context", context).drop("__pair", "__done")


def user_prompt(text: Column, context: Column, budget: Column) -> Column:
    """Context lines or an opening hint, the line, and its budget."""
    lines = F.transform(context, lambda p: F.concat(F.lit("  "), p["source"], F.lit("  ->  "), p["target"]))
    head = F.when(F.size(context) > 0, F.concat(F.array(F.lit("Earlier lines, for context:")), lines, F.array(F.lit("")))).otherwise(F.array(F.lit("Opening line: it sets the tone."), F.lit("")))
    tail = F.when(budget.isNotNull(), F.array(F.lit(""), F.concat(F.lit("At most about "), budget.cast("string"), F.lit(" characters, but keep the meaning.")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, F.array(F.lit("Line to translate:"), strip(text)), tail), "\n")


#: What the model is told about every line, in words of our own; {target} is the language's name.
RULES = (
    "- Reply with the {target} line alone: no remarks, no quotation marks.",
    "- Say what is meant, as a {target} speaker would say it aloud, not word for word.",
    "- Idioms, fillers and slang become what {target} has for them; where it has nothing, rephrase.",
    "- Keep the tone of speech; short forms and informal words are right.",
    "- Names of people, channels, games, brands and features stay as they are.",
    "- A fragment stays a fragment; add nothing that is not said.",
)
#: Extension: what is said aloud differs between places.
LOCALE_RULES = (
    "- Keep currencies as given, and always alike.",
    "- Say dates and units the way {target} speakers do.",
    "- Spell numbers out where they are read aloud.",
)


def system_prompt(source: Column, target: Column, synopsis: Column | str = "", terms: Column | list[str] = (), locale: bool = False) -> Column:
    """Task, what the video is about, the rules, and the terms that stay as they are. ``synopsis`` and ``terms``
    (an array) may be columns, so that videos differ; empty or null ones leave their part out."""
    synopsis = F.lit(synopsis) if isinstance(synopsis, str) else synopsis
    terms = F.array(*[F.lit(t) for t in terms]).cast("array<string>") if not isinstance(terms, Column) else terms
    name = display_name(target)
    none = F.array().cast("array<string>")
    task = F.array(F.concat(F.lit("You translate subtitles of a video from "), display_name(source), F.lit(" into "), name, F.lit(".")))
    about = F.when(F.coalesce(synopsis, F.lit("")) != "", F.array(F.lit(""), F.lit("About the video:"), synopsis)).otherwise(none)
    rules = F.array(F.lit(""), F.lit("Rules:"), *[F.replace(F.lit(r), F.lit("{target}"), name) for r in RULES + (LOCALE_RULES if locale else ())])
    kept = F.when(F.coalesce(F.size(terms), F.lit(0)) > 0, F.concat(F.array(F.lit(""), F.lit("Never translate these terms:")), F.transform(terms, lambda t: F.concat(F.lit("  "), t)))).otherwise(none)
    return F.array_join(F.concat(task, about, rules, kept), "\n")


def request_body(model: str, prompt: Column, system: Column, unload: bool = False) -> Column:
    """The JSON body of a request to a local model server: no stream, no thinking, and its options."""
    options = F.struct(F.lit(0.3).alias("temperature"), F.lit(512).alias("num_predict"))
    fields = [F.lit(model).alias("model"), prompt.alias("prompt"), system.alias("system"), F.lit(False).alias("stream"), F.lit(False).alias("think"), options.alias("options")]
    return F.to_json(F.struct(*fields, *([F.lit(0).alias("keep_alive")] if unload else [])))


def response_text(body: Column) -> Column:
    """The reply in a response body, cleaned; empty if the body is no JSON object or has none."""
    return F.coalesce(clean_reply(F.get_json_object(body, "$.response")), F.lit(""))


def glossary_hits(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """video_id, term, hits: how many texts hold each protected term. One pass over the texts with an
    automaton of all terms for every TERMS_BLOCK of them, so the time does not grow with their number."""
    wanted = terms.select("term").filter("term <> ''").distinct()
    blocks = -(-wanted.count() // TERMS_BLOCK)
    kind = dict(texts.dtypes)["video_id"]
    out = None
    for block in range(blocks):
        own = wanted.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block)
        shared = texts.sparkSession.sparkContext.broadcast([r["term"] for r in own.collect()])
        found = texts.select("video_id", "text").mapInArrow(_term_counts(shared), f"video_id {kind}, term string, hits long")
        out = found if out is None else out.union(found)
    if out is None:
        return texts.select("video_id", F.lit("").alias("term"), F.lit(0).cast("long").alias("hits")).limit(0)
    return out.groupBy("video_id", "term").agg(F.sum("hits").alias("hits"))


def _term_counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for term in shared.value:
            automaton.add_word(term, term)
        automaton.make_automaton()
        for batch in batches:
            seen: Counter = Counter()
            for video, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text and len(automaton):
                    seen.update((video, term) for term in {term for _, term in automaton.iter(text)})
            keys = list(seen)
            columns = [pa.array([k[0] for k in keys], batch.schema.field(0).type), pa.array([k[1] for k in keys], pa.string()), pa.array(list(seen.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["video_id", "term", "hits"])

    return run


def generation_cap(tokens: Column) -> Column:
    return F.least(F.lit(400), tokens * 2 + 16)
