"""Mixing sources to target weights by weighted fair queueing (operator 7). DataFrame functions only.

Each source is a queue of shuffled documents, up to three passes over it. A document's virtual
finish time is the number of the source's tokens served up to its end, divided by the source's
target; so every queue reaches its target at virtual time 1 and, at any earlier cut, all sources
have been served in proportion. All finish times are ranged globally and the mix is truncated
where the running total reaches the budget.

Nothing here needs one task to see a whole source: the shuffle key is a digest, its first hex
digits split every source (the hot one too) into slices, and running totals are the slice's
offset plus a window inside the slice. The global cut is found from a histogram of finish times,
from finer ones inside the bin where the budget ends until it holds few entries, and an exact pass there.

Defined results: null text has size 0; the null source is one source, ordered last; documents of
size 0 are never taken; an empty table gives an empty result; repeated rows are separate queue
entries; ``mix_documents`` carries all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.llm.text import WORD
from cuegrid.scratch import materialise, release

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source, and so no document, is served more often than this.
MAX_PASSES = 3
#: Leading hex digits of the shuffle digest that make a slice: 16**3 slices a source.
SLICE_DIGITS = 3
#: Bins of a unit of virtual time, and of a bin that is still too full.
BINS = 4096
#: Entries of one bin that are ordered in one task, and how often bins are split for that.
ORDERED_ENTRIES = 200_000
SPLITS = 4


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (k_null, k, source_size) -> with ``target`` and ``total``.

    Shares by weight of the total, capped at MAX_PASSES times the source's size. With sources in
    ascending order of cap / weight the capped ones are a prefix, so the common level is the first
    at which no further source is above its cap. One row per source reaches this global window,
    after pre-aggregation.
    """
    place = Window.orderBy("k_null", "k")
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = sizes.withColumn(
        "weight", F.element_at(weights, ((F.row_number().over(place) - 1) % len(WEIGHTS) + 1).cast("int")).cast("double")
    ).withColumn("cap", F.col("source_size") * MAX_PASSES)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "k_null", "k")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        (
            (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            / F.sum("weight").over(after)
        ).alias("level"),
    )
    # The level at the first uncapped source; later rows see a level computed with too many caps.
    fits = levels.withColumn("fits", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    final = fits.withColumn("common", F.first("fits", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return final.select(
        "k_null",
        "k",
        "source_size",
        "total",
        F.least(F.col("cap").cast("double"), F.col("common") * F.col("weight")).alias("target"),
    )


def _ticket() -> Column:
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))))


def _source() -> list[Column]:
    """A null-safe key of two plain columns: null sorts last and joins like any other source."""
    return [F.coalesce(F.col("source").cast("string"), F.lit("")).alias("k"), F.col("source").isNull().alias("k_null")]


def fair_queue(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, source) -> doc_id, size, source_size, target, copies, taken and the
    keys ticket, k, k_null. Deterministic for equal input rows."""
    entries = docs.select("doc_id", *_source(), token_count(F.col("text")).alias("size"), _ticket().alias("ticket"))
    entries = materialise(entries.withColumn("slice", F.substring("ticket", 1, SLICE_DIGITS)), "mix-entries")

    slices = entries.groupBy("k", "k_null", "slice").agg(F.sum("size").alias("slice_size"))
    before = Window.partitionBy("k", "k_null").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("slice_from", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    slices = materialise(slices, "mix-slices")
    targets = source_targets(slices.groupBy("k", "k_null").agg(F.sum("slice_size").alias("source_size")))
    offsets = slices.join(targets, ["k", "k_null"])
    # The join and the window below share one shuffle, by source and slice.
    inside = Window.partitionBy("k", "k_null", "slice").orderBy("ticket", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = entries.withColumn("inside", F.sum("size").over(inside)).join(offsets, ["k", "k_null", "slice"])
    queued = queued.withColumn("served", F.col("slice_from") + F.col("inside")).drop("inside", "slice_from", "slice_size", "slice")
    queued = materialise(queued, "mix-queue")
    release(entries)
    release(slices)

    passes = (
        queued.filter("size > 0")
        .select("k", "k_null", "size", "total", "served", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(MAX_PASSES - 1))).alias("pass"))
        .withColumn("finish", (F.col("served") + F.col("pass") * F.col("source_size")) / _positive("target"))
        .withColumn("place", F.least(F.col("finish"), F.lit(float(MAX_PASSES))) * BINS)
    )
    cut = _cut(passes)
    copies = F.lit(0)
    if cut is not None:
        finish = [(F.col("served") + n * F.col("source_size")) / _positive("target") for n in range(MAX_PASSES)]
        # Inside one source finish times are distinct, so a tie is broken by the source alone.
        k, k_null = F.lit(cut["k"]), F.lit(cut["k_null"])
        tie = (F.col("k_null") < k_null) | ((F.col("k_null") == k_null) & (F.col("k") <= k))
        for n in range(MAX_PASSES):
            within = (finish[n] < F.lit(cut["finish"])) | ((finish[n] == F.lit(cut["finish"])) & tie)
            copies = copies + F.when((F.col("size") > 0) & within, 1).otherwise(0)
    return queued.select(
        "doc_id",
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        copies.alias("copies"),
        (F.col("size") * copies).cast("long").alias("taken"),
        "ticket",
        "k",
        "k_null",
    )


def _positive(name: str) -> Column:
    """Null instead of 0: a source without words has nothing to finish."""
    return F.when(F.col(name) > 0, F.col(name))


def _cut(passes: DataFrame):
    """The last entry of the mix, as a row; None if nothing is queued. At most BINS * MAX_PASSES + 1
    sums meet in one task at a time, and then only the entries of a bin that holds few are ordered (or
    of one that cannot be split: equal finish times, at most one a source)."""
    entries, start, total = passes, 0, None
    for _ in range(1 + SPLITS):
        sums = entries.groupBy(F.floor("place").alias("bin")).agg(F.sum("size").alias("bin_size"), F.count("*").alias("n"), F.max("total").alias("total"))
        running = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("bin_size").over(running) + start)
        edge = sums.filter(F.col("upto") >= (F.col("total") if total is None else F.lit(total))).orderBy("bin").limit(1).collect()
        if not edge:
            return None
        edge, total = edge[0], edge[0]["total"]
        start = edge["upto"] - edge["bin_size"]
        entries = entries.filter(F.floor("place") == edge["bin"])
        if edge["n"] <= ORDERED_ENTRIES:
            break
        # Inside the bin places spread over a unit again.
        entries = entries.withColumn("place", (F.col("place") - edge["bin"]) * BINS)
    within = Window.orderBy("finish", "k_null", "k").rowsBetween(Window.unboundedPreceding, 0)
    last = entries.withColumn("upto", F.sum("size").over(within) + start).filter(F.col("upto") >= total).orderBy("upto").limit(1).collect()
    return last[0]


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every column of ``docs``, a row once for each time it is served.

    The queue travels without the texts; what each document is served comes back to it by its ticket.
    Rows that repeat id, text and source share their copies as evenly as they go.
    """
    key = ["ticket", "k", "k_null"]
    served = fair_queue(docs).groupBy(*key).agg(F.sum("copies").alias("all"), F.count("*").alias("rows")).filter("all > 0")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = docs.select(row, _ticket().alias("ticket"), *_source()).join(served, key)
    if not served.filter("rows > 1").isEmpty():
        nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("row")))
        found = found.withColumn("nth", F.when(F.col("rows") > 1, nth).otherwise(1))
    else:
        found = found.withColumn("nth", F.lit(1))
    copies = F.expr("int(all div rows)") + F.when(F.col("nth") <= F.expr("all % rows"), 1).otherwise(0)
    served_rows = found.select("row", copies.alias("copies")).filter("copies > 0")
    return served_rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op7_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return fair_queue(docs).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH entries AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS ticket
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * 3 AS cap,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight
  FROM entries GROUP BY source),
total AS (SELECT sum(source_size)::BIGINT AS total FROM sources),
levels AS (
  SELECT *, ((SELECT total FROM total)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
     row_number() OVER (ORDER BY cap / weight, source IS NULL, source) AS nth
  FROM sources),
common AS (SELECT arg_min(level, nth) AS level FROM levels WHERE level * weight <= cap),
targets AS (SELECT source, source_size, least(cap, (SELECT level FROM common) * weight) AS target FROM levels),
queued AS (
  SELECT e.*, t.source_size, t.target,
    sum(e.size) OVER (PARTITION BY e.source ORDER BY e.ticket, e.doc_id, e.size ROWS UNBOUNDED PRECEDING)::BIGINT AS served
  FROM entries e JOIN targets t ON e.source IS NOT DISTINCT FROM t.source),
passes AS (
  SELECT q.*, p.pass, (q.served + p.pass * q.source_size)::DOUBLE / q.target AS finish
  FROM queued q, (VALUES (0), (1), (2)) p(pass) WHERE q.size > 0),
running AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, coalesce(source, '') ROWS UNBOUNDED PRECEDING) - size AS upto FROM passes),
kept AS (SELECT ticket, doc_id, served, source, count(*) AS copies FROM running WHERE upto < (SELECT total FROM total) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(k.copies, 0))::BIGINT AS taken
FROM queued q LEFT JOIN kept k ON q.ticket = k.ticket AND q.doc_id IS NOT DISTINCT FROM k.doc_id AND q.served = k.served AND q.source IS NOT DISTINCT FROM k.source
"""
