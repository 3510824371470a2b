"""Language identification by interpolated Kneser-Ney character models (operator 8).

A gram is up to four characters, lower-cased, anything but letters being a gap; a character is its code
point (16 bits; those beyond the basic plane are hashed into them), so scripts stay apart and a gram is
one 64-bit key. Spark counts the four-grams of all learning documents and derives the continuation counts
of the lower orders, the sums of every context and, per language and order, the least count at which
no more than KEEP grams are left. Tasks then build one model per language: sorted arrays of keys, found
by binary search, with log-probabilities, and sorted arrays of contexts with the mass left to
the lower order (what grams below the least count had is part of it). So a model has at most 4 * KEEP keys,
however large the corpus, and its tables are never dense.

The language with the lowest cross-entropy per gram wins. Its score is a softmax over languages of
cross-entropy times a capped length, whose temperature is fitted on at most CALIBRATION_ROWS learning
documents; these come from a part of the learning documents (one in CALIBRATION_PART) that the counts do
not cover. A prediction is rejected (in its own column) if its score is below MIN_SCORE, or if its
cross-entropy is above the language's own of all but one in a hundred calibration documents, by
a margin that grows for short texts.

Defined results: text that is null or without letters is ``und`` with score 0, rejected; with no learning
documents every text is; languages tie to the smaller name; null ids are neither held out nor
learnt from; repeated rows each count; texts are worked on in pieces, however long; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.text import as_bytes, chunks
from cuegrid.scratch import materialise

ORDER = 4
#: Absolute discount of every order.
DISCOUNT = 0.75
#: Grams of one order that a language's model keeps, at most.
KEEP = 1 << 17
#: Learning documents whose scores fit the temperature, at most, and the part they are taken from.
CALIBRATION_ROWS = 1000
CALIBRATION_PART = 16
#: Predictions scored below this are marked as rejected.
MIN_SCORE = 0.5
#: Grams from which on a longer text no longer adds certainty.
CERTAIN_GRAMS = 200
UNKNOWN = "und"

_MERGE_AT = 2_000_000
_BITS = 16


def _code_of(point: int) -> int:
    if 0xD800 <= point < 0xE000:
        return 0
    char = chr(point).lower()[0]
    if not char.isalpha():
        return 0
    folded = ord(char)
    return folded if folded < 1 << _BITS else 1 + folded * 2654435761 % ((1 << _BITS) - 1)


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """Code of every code point of the basic plane; later planes are looked up one by one."""
    return np.array([_code_of(p) for p in range(1 << 16)], np.uint16)


def _coded(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    found = _codes()[points & np.uint32(0xFFFF)]
    if len(points) and points.max() > 0xFFFF:
        beyond = np.flatnonzero(points > 0xFFFF)
        values, back = np.unique(points[beyond], return_inverse=True)
        found = found.copy()
        found[beyond] = np.array([_code_of(int(v)) for v in values], np.uint16)[back]
    return found


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all four-grams of the texts, and the index of the text each belongs to. Runs of
    non-letters are one gap; no gram reaches into another text."""
    decoded = [t.decode("utf-8", "replace") for t in texts]
    lengths = np.array([len(t) for t in decoded], np.int64) + 3
    raw = _coded("".join(t + "\0\0\0" for t in decoded))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    ends = np.cumsum(lengths)
    edge = np.zeros(len(raw), bool)
    for k in (1, 2, 3):
        edge[ends - k] = True
    before = np.concatenate([[np.uint16(0)], raw[:-1]])
    keep = (raw > 0) | (before > 0) | edge
    kept = np.concatenate([np.zeros(3, np.uint64), raw[keep].astype(np.uint64)])
    owner = owner[keep]
    b = np.uint64(_BITS)
    keys = (((kept[:-3] << b | kept[1:-2]) << b | kept[2:-1]) << b) | kept[3:]
    real = (kept[3:] > 0) | (kept[2:-1] > 0)
    return keys[real], owner[real]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over every row of ``docs`` (text, lang), both non-null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows(lang):
            keys, numbers = held.pop(lang)
            for a in range(0, len(keys), 100_000):
                part = keys[a : a + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(numbers[a : a + 100_000])], names=["lang", "gram", "n"])

        for batch in batches:
            texts = [t or b"" for t in as_bytes(batch.column(0))]
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(langs.tolist())):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for a, b in chunks(own):
                    keys, numbers = np.unique(grams(own[a:b])[0], return_counts=True)
                    older = held.get(lang, (keys[:0], numbers[:0]))
                    both, back = np.unique(np.concatenate([older[0], keys]), return_inverse=True)
                    held[lang] = both, np.bincount(back, np.concatenate([older[1], numbers]), len(both)).astype(np.int64)
                    if len(both) > _MERGE_AT:
                        yield from rows(lang)
        for lang in sorted(held):
            yield from rows(lang)

    counted = docs.select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Language:
    """Per order, longest first: sorted keys with log-probabilities, sorted contexts with the log of the
    mass left to the next order; the order below all is uniform over the codes."""

    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    left: list[np.ndarray]
    limit: float = float("inf")

    def log_probabilities(self, queries: np.ndarray) -> np.ndarray:
        """Of four-grams in ascending order of key."""
        out = np.zeros(len(queries))
        rest = np.arange(len(queries))
        for order in range(ORDER):
            own = queries[rest] & _mask(ORDER - order)
            at, known = _find(self.keys[order], own)
            out[rest[known]] += self.logs[order][at[known]]
            rest, own = rest[~known], own[~known]
            at, known = _find(self.contexts[order], own >> np.uint64(_BITS))
            out[rest[known]] += self.left[order][at[known]]
        out[rest] -= np.log(1 << _BITS)
        return out


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << _BITS * order) - 1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def kneser_ney(tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Language:
    """The model from (keys, counts, sums of the key's context) for orders four to one; keys may be missing."""
    keys, logs, contexts, left = [], [], [], []
    for own, counts, sums in reversed(tables):
        order = np.argsort(own)
        own, counts, sums = own[order], counts[order].astype(float), sums[order].astype(float)
        share = np.maximum(counts - DISCOUNT, 0) / sums
        seen, first, back = np.unique(own >> np.uint64(_BITS), return_index=True, return_inverse=True)
        rest = np.maximum(1 - np.bincount(back, share, len(seen)), 1e-12)
        below = np.full(len(own), -np.log(1 << _BITS))
        if keys:
            lower = Language(keys[::-1], logs[::-1], contexts[::-1], left[::-1])
            below = _lower(lower, own & _mask(len(keys)), len(keys))
        logs.append(np.log(share + rest[back] * np.exp(below)).astype(np.float32))
        keys.append(own)
        contexts.append(seen)
        left.append(np.log(rest).astype(np.float32))
    return Language(keys[::-1], logs[::-1], contexts[::-1], left[::-1])


def _lower(lower: Language, queries: np.ndarray, order: int) -> np.ndarray:
    """Log-probabilities of shorter grams under a model that ends at their order."""
    out, rest = np.zeros(len(queries)), np.arange(len(queries))
    for k in range(order):
        own = queries[rest] & _mask(order - k)
        at, known = _find(lower.keys[k], own)
        out[rest[known]] += lower.logs[k][at[known]]
        rest, own = rest[~known], own[~known]
        at, known = _find(lower.contexts[k], own >> np.uint64(_BITS))
        out[rest[known]] += lower.left[k][at[known]]
    out[rest] -= np.log(1 << _BITS)
    return out


@dataclass(frozen=True)
class Model:
    """The languages in order of name."""

    langs: list[str] = field(default_factory=list)
    languages: list[Language] = field(default_factory=list)
    temperature: float = 1.0

    def cross_entropies(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """[text, language] mean negative log-probability, and the number of grams of each text."""
        keys, owner = grams(texts)
        n = np.bincount(owner, minlength=len(texts))
        distinct, back = np.unique(keys, return_inverse=True)
        out = np.zeros((len(texts), len(self.langs)))
        for i, language in enumerate(self.languages):
            log = language.log_probabilities(distinct)
            out[:, i] = -np.bincount(owner, log[back], len(texts)) / np.maximum(n, 1)
        return out, n

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and whether the prediction is rejected."""
        langs, scores, rejected = [], [], []
        for a, b in chunks(texts):
            own = [t or b"" for t in texts[a:b]]
            entropy, n = self.cross_entropies(own) if self.langs else (np.zeros((len(own), 1)), np.zeros(len(own), int))
            best = entropy.argmin(axis=1)
            score = softmax(entropy, n, self.temperature)[np.arange(len(own)), best]
            for i, at in enumerate(best.tolist()):
                if not self.langs or not n[i]:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                langs.append(self.langs[at])
                scores.append(float(score[i]))
                rejected.append(bool(score[i] < MIN_SCORE or entropy[i, at] > self.languages[at].limit + margin(n[i])))
        return langs, scores, rejected


def margin(n):
    """By how much the mean over ``n`` grams may lie above that of a long text."""
    return 4.0 / np.sqrt(np.maximum(n, 1))


def softmax(entropy: np.ndarray, n: np.ndarray, temperature: float) -> np.ndarray:
    z = -entropy * (np.minimum(n, CERTAIN_GRAMS) * temperature)[:, None]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def held_out(doc_id="doc_id"):
    """Documents that are never learnt from."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def _kept_grams(counted: DataFrame) -> DataFrame:
    """(lang, length, gram, n, total): the counts of each order with the sum of the gram's context, from
    the least count on at which no more than KEEP grams of a language are left."""
    orders, table = [], (counted := materialise(counted, "language-grams"))
    for length in range(ORDER, 0, -1):
        if length < ORDER:
            # Continuation counts: distinct left neighbours.
            short = F.col("gram").bitwiseAND(F.lit((1 << _BITS * length) - 1))
            table = table.groupBy("lang", short.alias("gram")).agg(F.count("*").alias("n"))
        orders.append(table.withColumn("length", F.lit(length)))
    every = orders[0]
    for one in orders[1:]:
        every = every.unionByName(one)
    every = materialise(every, "language-orders")
    context = F.shiftrightunsigned("gram", _BITS)
    # Few rows come back: a language has at most 64 levels an order.
    levels = every.groupBy("lang", "length", F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count("*").alias("k")).collect()
    least = []
    for lang, length in sorted({(r["lang"], r["length"]) for r in levels}):
        own = sorted(((r["level"], r["k"]) for r in levels if (r["lang"], r["length"]) == (lang, length)), reverse=True)
        total, bound = 0, 0
        for level, k in own:
            total += k
            if total > KEEP:
                bound = level + 1
                break
        least.append((lang, length, 1 << bound if bound else 1))
    spark = counted.sparkSession
    least = spark.createDataFrame(least, "lang string, length int, least long")
    sums = every.groupBy("lang", "length", context.alias("context")).agg(F.sum("n").alias("total"))
    kept = every.join(F.broadcast(least), ["lang", "length"]).filter("n >= least").withColumn("context", context)
    return kept.join(sums, ["lang", "length", "context"]).select("lang", "length", "gram", "n", "total")


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One model a language from its kept grams, which arrive together; arrays as bytes."""
    held: list[pa.RecordBatch] = []
    lang = None

    def model():
        parts = pa.Table.from_batches(held)
        length = parts.column("length").to_numpy()
        keys, n, total = (parts.column(c).to_numpy() for c in ("gram", "n", "total"))
        tables = [(keys[length == k].view(np.uint64), n[length == k], total[length == k]) for k in range(ORDER, 0, -1)]
        own = kneser_ney(tables)
        columns = [[x.tobytes() for x in part] for part in (own.keys, own.logs, own.contexts, own.left)]
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), *[pa.array([c], pa.list_(pa.binary())) for c in columns]], names=["lang", "keys", "logs", "contexts", "left"])

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        cuts = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), len(langs)] if len(langs) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and langs[a] != lang:
                yield model()
                held = []
            lang = langs[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield model()


def fit(docs: DataFrame) -> Model:
    """A model of every language in ``docs`` (doc_id, text, lang) outside the held-out part."""
    learn = docs.select("doc_id", "text", "lang").filter(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    apart = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(CALIBRATION_PART)) == 0
    kept = _kept_grams(gram_counts(learn.filter(~apart)))
    built = kept.repartition("lang").sortWithinPartitions("lang").mapInArrow(_built, "lang string, keys array<binary>, logs array<binary>, contexts array<binary>, left array<binary>")
    found = sorted(built.collect(), key=lambda r: r["lang"])
    kinds = {"keys": np.uint64, "logs": np.float32, "contexts": np.uint64, "left": np.float32}
    languages = [Language(*[[np.frombuffer(x, kind) for x in r[name]] for name, kind in kinds.items()]) for r in found]
    model = Model([r["lang"] for r in found], languages)
    return _calibrated(model, learn.filter(apart)) if len(found) > 1 else model


def _calibrated(model: Model, apart: DataFrame) -> Model:
    """The temperature that makes the labels of documents outside the counts likeliest, and each language's
    limit of cross-entropy."""
    # Ids alone are ordered and cut; the bounded rest goes to the texts.
    drawn = apart.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(CALIBRATION_ROWS).select("doc_id").distinct()
    sample = apart.join(F.broadcast(drawn), "doc_id").select("text", "lang")
    shared = apart.sparkSession.sparkContext.broadcast(model)

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in as_bytes(batch.column(0))]
            for a, b in chunks(texts):
                found, n = shared.value.cross_entropies(texts[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(found.tolist(), pa.list_(pa.float64())), pa.array(n, pa.int64()), batch.column(1).slice(a, b - a)], names=["entropy", "n", "lang"])

    rows = [r for r in sample.mapInArrow(entropies, "entropy array<double>, n long, lang string").collect() if r["lang"] in model.langs and r["n"]]
    if not rows:
        return model
    entropy, n = np.array([r["entropy"] for r in rows]), np.array([r["n"] for r in rows])
    right = np.array([model.langs.index(r["lang"]) for r in rows])
    grid = 2.0 ** np.arange(-8, 4.5, 0.5)
    fits = [-np.log(np.maximum(softmax(entropy, n, t)[np.arange(len(rows)), right], 1e-12)).mean() for t in grid]
    languages = []
    for i, language in enumerate(model.languages):
        own = entropy[right == i, i] - margin(n[right == i])
        languages.append(replace(language, limit=float(np.quantile(own, 0.99)) if len(own) else float("inf")))
    return Model(model.langs, languages, float(grid[int(np.argmin(fits))]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores, rejected = shared.value.predict(as_bytes(texts))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["lang", "score", "rejected"])

    found = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), predict("text").alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def op8_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs.select("doc_id", "text"), fit(docs))
