"""Who speaks: interval and nearest joins with diarization turns, clustering of voice embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a time bin of the interval join.
BIN_SECONDS = 60.0


def _bins(start: str, end: str):
    low = F.floor(F.col(start) / BIN_SECONDS)
    return F.sequence(low, F.greatest(low, F.floor(F.col(end) / BIN_SECONDS)))


def overlapping_turn(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """video_id, index, best: the turn with the largest positive overlap, the first one on ties.

    An equi join on (video_id, time bin); a pair that shares several bins counts in its first only, so
    neither a long video nor a long turn makes a nested loop.
    """
    left = segments.select("video_id", "index", "start", "end", F.explode(_bins("start", "end")).alias("bin"))
    right = turns.select("video_id", F.col("start").alias("t_start"), F.col("end").alias("t_end"), "ord", F.col("speaker").alias("t_speaker"), F.explode(_bins("start", "end")).alias("bin"))
    overlap = F.least("end", "t_end") - F.greatest("start", "t_start")
    pairs = left.join(right, ["video_id", "bin"]).filter(overlap > 0).filter(F.col("bin") == F.floor(F.greatest("start", "t_start") / BIN_SECONDS))
    return pairs.groupBy("video_id", "index").agg(F.min(F.struct((-overlap).alias("o"), "ord", "t_speaker")).alias("best"))


def nearest_turn(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """video_id, index, near: the speaker of the turn whose midpoint is nearest, the first on ties. One
    ordered pass over both, no pairs."""
    middle = (F.col("start") + F.col("end")) / 2
    points = turns.groupBy("video_id", middle.alias("mid")).agg(F.min(F.struct("ord", "speaker")).alias("turn"))
    points = points.select("video_id", "mid", F.struct("mid", "turn.ord", "turn.speaker").alias("turn"), F.lit(None).cast("long").alias("index"))
    asked = segments.select("video_id", middle.alias("mid"), F.lit(None).cast(points.schema["turn"].dataType).alias("turn"), F.col("index").cast("long").alias("index"))
    order = Window.partitionBy("video_id").orderBy("mid")
    upto = order.rangeBetween(Window.unboundedPreceding, 0)
    onward = order.rangeBetween(0, Window.unboundedFollowing)
    both = points.unionByName(asked).select("*", F.last("turn", True).over(upto).alias("before"), F.first("turn", True).over(onward).alias("after"))
    gap = lambda t: F.abs(F.col(t)["mid"] - F.col("mid"))
    choice = lambda t: F.when(F.col(t).isNotNull(), F.struct(gap(t).alias("gap"), F.col(t)["ord"].alias("ord"), F.col(t)["speaker"].alias("speaker")))
    return both.filter("index is not null").select("video_id", "index", F.least(choice("before"), choice("after")).alias("near"))


def assign_speakers(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """Segments with ``speaker`` from the turns of their video: most overlap with a single turn, else the
    nearest midpoint; videos without turns keep what they had."""
    best = overlapping_turn(segments, turns)
    rows = segments.join(best, ["video_id", "index"], "left")
    missing = rows.filter("best is null").select("video_id", "index", "start", "end")
    near = nearest_turn(missing, turns)
    rows = rows.join(near.withColumn("index", F.col("index").cast(segments.schema["index"].dataType)), ["video_id", "index"], "left")
    speaker = F.when(F.col("best").isNotNull(), F.col("best.t_speaker")).when(F.col("near").isNotNull(), F.col("near.speaker")).otherwise(F.col("speaker"))
    return rows.withColumn("speaker", speaker).select(*segments.columns)


def kmeans_labels(vectors: np.ndarray, k: int, steps: int = 50) -> np.ndarray:
    """Cosine k-means from farthest-first seeds; the lowest index wins every tie."""
    unit = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9)
    seeds = [0]
    nearest = unit @ unit[0]
    while len(seeds) < min(k, len(unit)):
        seeds.append(int(np.argmax(1.0 - nearest)))
        nearest = np.maximum(nearest, unit @ unit[seeds[-1]])
    centre, labels = unit[seeds].copy(), None
    for _ in range(steps):
        found = np.argmax(unit @ centre.T, axis=1)
        if labels is not None and (found == labels).all():
            break
        labels = found
        for j in np.unique(labels):
            mean = unit[labels == j].mean(axis=0)
            centre[j] = mean / (np.linalg.norm(mean) + 1e-9)
    return labels


def linkage_labels(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Average linkage by cosine until the closest two clusters are below the threshold.

    The mean similarity of two clusters is the product of their vector sums over the product of their
    sizes, so a merge updates one row and one column; time is about the square of the number of vectors.
    """
    unit = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9)
    n = len(unit)
    owner, size, alive = np.arange(n), np.ones(n), np.ones(n, bool)
    total = unit @ unit.T
    # Means of the pairs i < j that are still apart, with the best of every row; a merge changes one
    # row and one column, so only rows whose best was there are searched again.
    mean = np.where(np.triu(np.ones((n, n), bool), 1), total, -np.inf)
    where = mean.argmax(axis=1)
    best = mean[np.arange(n), where]
    for _ in range(n - 1):
        i = int(np.argmax(best))
        j = int(where[i])
        if best[i] <= -1.0 or best[i] < threshold:
            break
        total[i] += total[j]
        total[:, i] += total[:, j]
        size[i] += size[j]
        alive[j] = False
        owner[owner == j] = i
        mean[j], mean[:, j], best[j] = -np.inf, -np.inf, -np.inf
        others = alive.copy()
        others[i] = False
        fresh = np.where(others, total[i] / (size[i] * size), -np.inf)
        mean[i, i + 1 :], mean[:i, i] = fresh[i + 1 :], fresh[:i]
        again = alive & np.isin(where, (i, j))
        again[i] = True
        above = np.flatnonzero(alive[:i] & ~again[:i])
        better = above[(mean[above, i] > best[above]) | ((mean[above, i] == best[above]) & (i < where[above]))]
        best[better], where[better] = mean[better, i], i
        for row in np.flatnonzero(again):
            where[row] = int(mean[row].argmax())
            best[row] = mean[row, where[row]]
    return np.unique(owner, return_inverse=True)[1]


def cluster_speakers(vectors: DataFrame, speakers: int = 0, threshold: float = 0.75) -> DataFrame:
    """``vectors`` (video_id, index, vector) -> video_id, index, label, speaker. ``speakers`` > 0 asks for
    that many voices, else their number follows from the threshold. One video is one group: its
    vectors are as many as it has segments."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("index")
        rows = np.array(table.column("vector").to_pylist(), np.float64)
        if len(rows) <= 1:
            labels = np.zeros(len(rows), int)
        else:
            labels = kmeans_labels(rows, speakers) if speakers >= 1 else linkage_labels(rows, threshold)
        out = table.select(["video_id", "index"]).append_column("label", pa.array(labels, pa.int32()))
        yield from out.to_batches()

    kinds = dict(vectors.dtypes)
    found = vectors.groupBy("video_id").applyInArrow(lambda t: pa.Table.from_batches(list(label(iter(t.to_batches())))), f"video_id {kinds['video_id']}, index {kinds['index']}, label int")
    return found.withColumn("speaker", F.concat(F.lit("SPK"), F.col("label")))


def speaker_counts(segments: DataFrame) -> DataFrame:
    """video_id, speakers: distinct voices, unlabelled segments being one voice."""
    unlabelled = F.max(F.col("speaker").isNull().cast("long"))
    return segments.groupBy("video_id").agg((F.count_distinct("speaker") + unlabelled).alias("speakers"), F.count("*").alias("segments"))
