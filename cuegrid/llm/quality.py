"""Quality rules (operator 4): counted base rules and a calibrated hashed n-gram classifier.

Features are means of hashed indicator weights over four families: words, word pairs, character
trigrams and character four-grams. A logistic regression over them is fitted on a bounded sample
of labelled rows (SAMPLE_ROWS, the smallest hashes of doc_id, so reruns agree), two thirds for the
weights and one third for Platt calibration; the calibrated probability is held against a fixed
threshold. Fitting is bounded by the sample whatever the corpus; scoring runs in Arrow batches
over every document, with the weight vector (DIMENSION floats) shipped to the executors.

Defined results: a null or blank text has no words and fails the base rule; null ids pass through;
labels without a document, or with null quality, teach nothing; with labels of one kind only (or
none) the classifier accepts everything, with fewer than three rows of a kind it is not calibrated; of
labels that contradict each other the better one counts; repeated rows are scored one by one; very long
texts are taken whole; other columns are carried by ``good_documents`` and ignored otherwise, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.text import as_bytes, window_hashes, word_hashes

#: Hashed weights, shared by all feature families.
DIMENSION = 1 << 16
#: Most labelled rows the classifier is fitted on.
SAMPLE_ROWS = 3000
#: Documents whose calibrated probability of good quality is below this are rejected.
MIN_PROBABILITY = 0.35
#: Base rules.
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
REPEAT_WINDOW = 8

_BLANK = b"\t\n\x0b\x0c\r "
_SYMBOLS = b"#*$%&|<>"
_SHIFT = np.uint32(16)
_SHIFT64 = np.uint64(48)
#: Scale of a family's mean, so that unit weights give useful margins.
_SCALE = 20.0


def repeated_words(hashes: np.ndarray, width: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``width`` words that occur at least twice in the text."""
    windows = window_hashes(hashes, width)
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(windows, twice))
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(_BLANK)]
    return len(lines) - len(set(lines))


def base_counts(text: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    solid = text.translate(None, _BLANK)
    return (
        len(words),
        len(solid.decode("utf-8", "replace")),
        len(solid) - len(solid.translate(None, _SYMBOLS)),
        duplicate_lines(text),
        repeated_words(hashes),
    )


def feature_slots(text: bytes, hashes: np.ndarray) -> list[np.ndarray]:
    """Slots of the text's words, word pairs, character trigrams and four-grams."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    points = points * np.uint32(0x9E3779B1)
    three = four = points[:0]
    if len(points) >= 3:
        three = (points[:-2] * np.uint32(0x85EBCA6B) + points[1:-1]) * np.uint32(0xC2B2AE35) + points[2:]
    if len(three) >= 2:
        four = (three[:-1] * np.uint32(0x27D4EB2F) + points[3:]) * np.uint32(0x165667B1)
    return [
        (hashes >> _SHIFT64).astype(np.int64),
        (window_hashes(hashes, 2) >> _SHIFT64).astype(np.int64),
        ((three * np.uint32(0x2545F491)) >> _SHIFT).astype(np.int64),
        (four >> _SHIFT).astype(np.int64),
    ]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, slots: list[np.ndarray]) -> float:
        margin = self.bias + sum(_SCALE * float(self.weights[s].mean()) for s in slots if len(s))
        return float(_sigmoid(self.slope * margin + self.offset))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def labelled_features(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Sparse features of at most ``rows`` labelled documents. The sampled ids are bounded, so they
    go to the documents and no text is shuffled."""
    sample = (
        labels.filter("quality is not null and doc_id is not null")
        .select("doc_id", F.col("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(rows)
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, slots, values = [], [], [], []
            for doc_id, text, quality in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if not text or not (words := text.split()):
                    continue
                families = feature_slots(text, word_hashes(words))
                dense = sum(np.bincount(s, minlength=DIMENSION) * (_SCALE / len(s)) for s in families if len(s))
                used = np.flatnonzero(dense)
                ids.append(doc_id)
                kinds.append(quality)
                slots.append(used.astype(np.uint16).tobytes())
                values.append(dense[used].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.int32()), pa.array(slots, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "quality", "slots", "values"])

    return joined.mapInArrow(featurise, "doc_id long, quality int, slots binary, values binary")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """The calibrated classifier; None when the labels are of one kind or missing. One task fits it, as the
    sample is bounded, and only the weights come to the driver."""
    found = labelled_features(docs, labels, rows).repartition(1).mapInArrow(_fitted, "weights binary, bias double, slope double, offset double").collect()
    if not found:
        return None
    return Model(np.frombuffer(found[0]["weights"], np.float32), found[0]["bias"], found[0]["slope"], found[0]["offset"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    model = _fit_rows(pa.Table.from_batches(parts)) if parts else None
    if model is not None:
        columns = [pa.array([model.weights.tobytes()], pa.binary()), *[pa.array([float(x)]) for x in (model.bias, model.slope, model.offset)]]
        yield pa.RecordBatch.from_arrays(columns, names=["weights", "bias", "slope", "offset"])


def _fit_rows(found: pa.Table) -> Model | None:
    found = found.sort_by([("doc_id", "ascending"), ("quality", "ascending"), ("slots", "ascending")])
    target = np.array(found.column("quality").to_pylist(), float)
    if len(set(target.tolist())) < 2:
        return None
    # One flat copy in narrow types.
    ends = np.cumsum([len(x) // 2 for x in found.column("slots").to_pylist()])
    flat = np.frombuffer(b"".join(found.column("slots").to_pylist()), np.uint16)
    value = np.frombuffer(b"".join(found.column("values").to_pylist()), np.float32)
    del found
    parts = _parts(flat, value, ends)
    # Every third row of each kind calibrates.
    held = np.zeros(len(target), bool)
    for kind in (0.0, 1.0):
        held[np.flatnonzero(target == kind)[2::3]] = True
    weights, bias = _descend(parts, target, ~held)
    margins = bias + _margins(parts, weights)
    slope, offset = _calibrate(margins[held], target[held]) if len(set(target[held].tolist())) == 2 else (1.0, 0.0)
    return Model(weights, bias, slope, offset)


#: Rows whose features are expanded at a time.
_PART_ROWS = 256


def _parts(flat: np.ndarray, value: np.ndarray, ends: np.ndarray) -> list[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, slots, values, row lengths) of consecutive rows; views, not copies."""
    starts, out = np.concatenate([[0], ends[:-1]]), []
    for a in range(0, len(ends), _PART_ROWS):
        b = min(len(ends), a + _PART_ROWS)
        span = slice(starts[a], ends[b - 1])
        out.append((slice(a, b), flat[span], value[span], ends[a:b] - starts[a:b]))
    return out


def _margins(parts, weights: np.ndarray) -> np.ndarray:
    return np.concatenate([np.add.reduceat(weights[slots] * values, np.cumsum(lengths) - lengths) for _, slots, values, lengths in parts]).astype(float)


def _descend(parts, target: np.ndarray, learn: np.ndarray, steps: int = 120, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the class-balanced logistic loss of the rows in ``learn``."""
    n, good = learn.sum(), target[learn].sum()
    balance = np.where(learn, np.where(target == 1, n / (2 * good), n / (2 * (n - good))), 0.0)
    weights, bias = np.zeros(DIMENSION, np.float32), 0.0
    first, second, bias_first, bias_second = np.zeros(DIMENSION), np.zeros(DIMENSION), 0.0, 0.0
    for step in range(1, steps + 1):
        error = balance * (_sigmoid(bias + _margins(parts, weights)) - target) / n
        slope = ridge * weights.astype(float)
        for rows, slots, values, lengths in parts:
            slope += np.bincount(slots, np.repeat(error[rows], lengths) * values, DIMENSION)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        bias_first, bias_second = 0.9 * bias_first + 0.1 * error.sum(), 0.999 * bias_second + 0.001 * error.sum() ** 2
        a, b = 1 - 0.9**step, 1 - 0.999**step
        weights -= (rate * (first / a) / (np.sqrt(second / b) + 1e-8)).astype(np.float32)
        bias -= rate * (bias_first / a) / (np.sqrt(bias_second / b) + 1e-8)
    return weights, float(bias)


def _calibrate(margin: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Platt scaling with smoothed targets, by Newton steps on two parameters."""
    good, bad = target.sum(), len(target) - target.sum()
    smooth = np.where(target == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(slope * margin + offset)
        g = np.array([((p - smooth) * margin).sum() + 1e-3 * (slope - 1), (p - smooth).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * margin**2).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        move *= min(1.0, 2.0 / max(1e-12, np.abs(move).max()))
        slope, offset = slope - move[0], offset - move[1]
        if np.abs(move).max() < 1e-9:
            break
    return float(max(slope, 1e-3)), float(offset)


_VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, quality_probability double, base_failed boolean, kept boolean"


def verdict_of(text: bytes | None, model: Model | None, min_probability: float = MIN_PROBABILITY) -> tuple:
    """The fields of ``_VERDICT`` for one text."""
    text = text or b""
    words = text.split()
    hashes = word_hashes(words)
    counts = base_counts(text, words, hashes)
    failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEATED_PERCENT * counts[0]
    if not words:
        p = 0.0
    else:
        p = 1.0 if model is None else model.probability(feature_slots(text, hashes))
    return (*counts, p, failed, not failed and p >= min_probability)


def verdict_column(spark, model: Model | None, text="text", min_probability: float = MIN_PROBABILITY):
    """A struct column of the verdict on a text column; only the text goes to Python."""
    shared = spark.sparkContext.broadcast(model)
    fields = [f.split() for f in _VERDICT.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

    @F.arrow_udf(f"struct<{', '.join(':'.join(f) for f in fields)}>")
    def verdict(texts: pa.Array) -> pa.Array:
        columns = list(zip(*(verdict_of(t, shared.value, min_probability) for t in as_bytes(texts)), strict=True)) or [()] * len(fields)
        return pa.StructArray.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    return verdict(F.col(text))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The filter: rows and columns of ``docs`` whose verdict is to keep them."""
    return docs.filter(verdict_column(docs.sparkSession, fit(docs, labels))["kept"])


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select("doc_id", verdict_column(spark, model).alias("verdict")).select("doc_id", "verdict.*")
