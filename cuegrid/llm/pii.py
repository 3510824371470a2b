"""Personal data by bootstrapped contextual extraction (operator 5).

Four base kinds are found by pattern and check (length, octet range, Luhn). They are seeds, and so are
strings in the format of a digest or of a known access key, for the fifth kind, secrets. The words around
every seed, and around every other candidate, are lexical patterns. Patterns and instances form a
bipartite graph whose scores Spark iterates: a pattern is as good as the share of its distinct instances
that are of one kind (those of unknown kind that look like it are left out), an instance is as good as
its patterns together (noisy or). Candidates are taken by shape over the text: runs of one or more
number-like tokens, addresses with @, (at) or [at], and long strings of letters and digits. Those that no
base pattern knows but that stand in high-confidence patterns of one kind, and look like that kind,
are added as ``context_<kind>`` spans; of nested ones of a kind the longest. A string in the format of a
secret is reported only so: a digest in a context of no confidence is none.

Python only reads each text once; the graph carries 64-bit digests, never the values. Mentions
are a small fraction of the text, every aggregation over them combines before it shuffles, and
the rounds are fixed in number, each written to the shared scratch folder.

Defined results: null text counts as empty (no spans, digest of the empty string); ids may be null
or repeated, every input row gives one row; offsets are code points, end exclusive; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.scratch import materialise

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the graph.
ALL_KINDS = (*KINDS, "secret")
#: Rounds of scoring.
ROUNDS = 3
#: A pattern counts from this score and this many distinct seeds on, an instance from this score on.
MIN_PATTERN = 0.8
MIN_SEEDS = 3
MIN_INSTANCE = 0.9
#: Code points on either side in which the context words are sought.
REACH = 80
#: Fewest digits of a number that a shape takes; most digits and most groups of one written with blanks,
#: so that a table of numbers has a few candidates a number.
MIN_DIGITS, MAX_DIGITS, MAX_GROUPS = 4, 19, 8
#: Most code points of a candidate.
MAX_LENGTH = 200

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# Digit runs are taken whole, so possessive forms find the same matches without backtracking.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_HAS_LETTER = re.compile(r"[A-Za-z]")
_RUN = re.compile(r"[+(]?[0-9](?:[ ().:-]*+[0-9])*+")
_PIECE = re.compile(r"[^ ]+")
_AT = re.compile(r"@|\(at\)|\[at\]")
_BLANK = re.compile(r"\s")
_TRIM = "\"'`.,;:!?()[]{}<>#*$%&|="
_SHAPES = {
    "email": re.compile(r".*(?:@|\(at\)|\[at\]).*[.].*", re.S),
    "ip": re.compile(r"[0-9]{1,3}(?:[.:-][0-9]{1,3}){3,}"),
    "card": re.compile(r"(?:[0-9][ -]?){11,18}[0-9]"),
    "phone": re.compile(r"[+(]?[0-9](?:[ ().-]*[0-9]){6,14}"),
}
_LONG = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+")
#: Formats that are known without any context: digests in hexadecimal, access keys by their prefix.
_SECRET_SEED = re.compile(r"[0-9a-fA-F]{32,128}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @ outwards in linear time."""
    found, low = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        end = _DOMAIN.match(text, at + 1) if start < at else None
        low = end.end() if end else at + 1
        if end:
            found.append((start, low))
        at = text.find("@", low)
    return found


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), kinds as listed, then by start."""
    found = [("email", a, b) for a, b in emails(text)]
    if not _DIGITS.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                found.append(("phone", *m.span()))
    return found


def _digest(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode("utf-8", "replace")) - (1 << 63)


def _contexts(text: str, start: int, end: int) -> list[int]:
    """Digests of the patterns around a span: one and two words before, one on each side, two after.
    A word is taken without its punctuation, and punctuation alone as it is."""
    bare = lambda words: [w.strip(_TRIM).lower() or w for w in words]
    left, right = bare(text[max(0, start - REACH) : start].split()[-2:]), bare(text[end : end + REACH].split()[:2])
    # What is glued to the span is no word.
    if left and start and not text[start - 1].isspace() and not left[-1][-1].isalnum() and len(left) > 1 and set(left[-1]) <= set("\"'`([{<"):
        left = bare(text[max(0, start - REACH) : start].split()[-3:-1])
    patterns = []
    if left:
        patterns.append(f"{left[-1]} _")
    if len(left) == 2:
        patterns.append(f"{left[0]} {left[1]} _")
    if left and right:
        patterns.append(f"{left[-1]} _ {right[0]}")
    if len(right) == 2:
        patterns.append(f"_ {right[0]} {right[1]}")
    return [_digest(p) for p in patterns]


def _bounded(text: str, start: int, end: int) -> bool:
    """The span is not a part of a longer word, number or path."""
    before, after = text[max(0, start - 2) : start], text[end : end + 2]
    if before and not before[-1].isspace() and (before[-1] not in _TRIM or (before[-1] in ",.:" and before[0].isdigit())):
        return False
    return not after or after[0].isspace() or (after[0] in _TRIM and not (after[0] in ",.:;" and after[1:].isalnum()))


def number_spans(text: str) -> Iterator[tuple[int, int]]:
    """Runs of digits and separators: every sequence of their blank-separated pieces that has no more
    digits and groups than an identifier, by start."""
    for m in _RUN.finditer(text):
        pieces = [(m.start() + p.start(), m.start() + p.end()) for p in _PIECE.finditer(m.group())]
        digits = [sum(map(str.isdigit, text[a:b])) for a, b in pieces]
        for i, (start, _) in enumerate(pieces):
            n = groups = 0
            for j in range(i, len(pieces)):
                n += digits[j]
                groups += digits[j] > 0
                if j > i and (n > MAX_DIGITS or groups > MAX_GROUPS or pieces[j][1] - start > MAX_LENGTH):
                    break
                if n < MIN_DIGITS or not digits[j]:
                    continue
                b = start + len(text[start : pieces[j][1]].rstrip(_TRIM))
                a = b - len(text[start:b].lstrip(_TRIM))
                # An opening bracket belongs to the number if it is closed in it.
                if a > start and text[a - 1] == "(" and text[a:b].count(")") > text[a:b].count("("):
                    a -= 1
                if _bounded(text, a, b):
                    yield a, b


def address_spans(text: str) -> Iterator[tuple[int, int]]:
    """Tokens with an @, (at) or [at], the bracketed ones also with a blank on either side."""
    low = 0
    for m in _AT.finditer(text):
        if m.start() < low:
            continue
        first, last = m.span()
        spelt = m.group() != "@"
        if spelt and first - 1 > low and text[first - 1] == " ":
            first -= 1
        while first > low and not text[first - 1].isspace():
            first -= 1
        if spelt and text[last : last + 1] == " ":
            last += 1
        end = _BLANK.search(text, last)
        last = end.start() if end else len(text)
        low = last
        first += len(text[first:last]) - len(text[first:last].lstrip(_TRIM))
        last = first + len(text[first:last].rstrip(_TRIM))
        if first < last:
            yield first, last


def secret_spans(text: str) -> Iterator[tuple[int, int]]:
    """Strings of 16 letters and digits or more with at least four digits and a letter."""
    for m in _LONG.finditer(text):
        value = m.group()
        if len(value) <= MAX_LENGTH and len(_DIGITS.findall(value)) >= 4 and any(map(str.isalpha, value)):
            yield m.span()


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[tuple]:
    """(kind or None, kinds the span looks like, instance, start, end, patterns) of the seeds and of
    the candidates outside them."""
    found = [(kind, [], _digest(text[a:b].lower()), a, b, _contexts(text, a, b)) for kind, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    for spans, kinds in ((address_spans(text), KINDS[:1]), (number_spans(text), KINDS[1:])):
        k = 0
        for a, b in spans:
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if k < len(taken) and taken[k][0] < b:
                continue
            value = text[a:b]
            like = [kind for kind in kinds if len(value) <= MAX_LENGTH and _SHAPES[kind].fullmatch(value)]
            if like and (patterns := _contexts(text, a, b)):
                found.append((None, like, _digest(value.lower()), a, b, patterns))
        # A number inside an address is no candidate of its own.
        taken = sorted((m[3], m[4]) for m in found)
    k = 0
    for a, b in secret_spans(text):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if (k == len(taken) or taken[k][0] >= b) and (patterns := _contexts(text, a, b)):
            value = text[a:b]
            found.append(("secret" if _SECRET_SEED.fullmatch(value) and _HAS_LETTER.search(value) else None, ["secret"], _digest(value.lower()), a, b, patterns))
    return found


_MENTION = pa.struct([("kind", pa.string()), ("shapes", pa.list_(pa.string())), ("instance", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("patterns", pa.list_(pa.int64()))])
_SCAN = "doc_id {id}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, mentions array<struct<kind:string,shapes:array<string>,instance:long,start:long,stop:long,patterns:array<long>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, bases, rows = [[], [], [], []], [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            spans = base_spans(text)
            line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            for n, kind in zip(counts, KINDS, strict=True):
                n.append(sum(k == kind for k, _, _ in spans))
            digests.append(hashlib.sha256(line.encode()).hexdigest())
            bases.append(line)
            rows.append([dict(zip(("kind", "shapes", "instance", "start", "stop", "patterns"), m, strict=True)) for m in mentions(text, spans)])
        arrays = [batch.column(0), *[pa.array(n, pa.int64()) for n in counts], pa.array(digests, pa.string()), pa.array(bases, pa.string()), pa.array(rows, pa.list_(_MENTION))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "base", "mentions"])


def confident(mention: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, instance) for unknown instances that the graph assigns to a kind.

    ``mention``: kind, shapes, instance, pattern, one row per occurrence and pattern.
    """
    known = [F.max(F.when(F.col("kind") == k, 1.0).otherwise(0.0)).alias(k) for k in ALL_KINDS]
    looks = [F.max(F.array_contains("shapes", k)).alias(f"like_{k}") for k in ALL_KINDS]
    edges = mention.groupBy("pattern", "instance").agg(*known, *looks)
    # Patterns without an instance to be found can discover nothing.
    open_ = mention.filter("kind is null or kind = 'secret'").select("pattern").distinct()
    edges = materialise(edges.join(open_, "pattern", "left_semi"), "pii-edges")
    seeds = edges.groupBy("instance").agg(*[F.max(k).alias(k) for k in ALL_KINDS])
    scores = seeds
    patterns = None
    for _ in range(rounds):
        weighed = edges.select("pattern", "instance", *[f"like_{k}" for k in ALL_KINDS]).join(scores, "instance")
        unknown = F.greatest(*ALL_KINDS) < MIN_INSTANCE
        patterns = weighed.groupBy("pattern").agg(
            *[(F.sum(F.when(F.col(k) >= MIN_INSTANCE, F.col(k)).otherwise(0.0)) / (F.count(F.when(~(unknown & F.col(f"like_{k}")), 1)) + 1)).alias(k) for k in ALL_KINDS],
            *[F.count(F.when(F.col(k) >= MIN_INSTANCE, 1)).alias(f"seeds_{k}") for k in ALL_KINDS],
        )
        patterns = materialise(patterns, "pii-patterns")
        trusted = patterns.select("pattern", *[F.when((F.col(k) >= MIN_PATTERN) & (F.col(f"seeds_{k}") >= MIN_SEEDS), F.col(k)).otherwise(0.0).alias(f"p_{k}") for k in ALL_KINDS])
        looks = edges.select("pattern", "instance", *[f"like_{k}" for k in ALL_KINDS]).join(trusted, "pattern")
        # A pattern speaks only for instances that look like its kind.
        miss = lambda k: F.log(1 - F.least(F.when(F.col(f"like_{k}"), F.col(f"p_{k}")).otherwise(0.0), F.lit(0.999999)))
        learnt = looks.groupBy("instance").agg(*[(1 - F.exp(F.sum(miss(k)))).alias(f"l_{k}") for k in ALL_KINDS])
        scores = materialise(seeds.join(learnt, "instance").select("instance", *[F.greatest(F.col(k), F.col(f"l_{k}")).alias(k) for k in ALL_KINDS]), "pii-scores")
    best = F.array(*[F.struct(F.col(k).alias("score"), F.lit(k).alias("found")) for k in ALL_KINDS])
    named = scores.join(seeds.filter(" + ".join(KINDS) + " = 0").select("instance"), "instance", "left_semi").select("instance", F.array_max(best).alias("b"))
    named = named.filter(F.col("b.score") >= MIN_INSTANCE).select("instance", "b.found")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("found"), F.col(k).alias("score"), F.col(f"seeds_{k}").alias("support")) for k in ALL_KINDS]))
    good = patterns.select("pattern", kinds.alias("p")).filter((F.col("p.score") >= MIN_PATTERN) & (F.col("p.support") >= MIN_SEEDS)).select("pattern", "p.found")
    return edges.select("pattern", "instance").join(named, "instance").join(good, ["pattern", "found"]).select("pattern", "instance", "found")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base digest and ``spans`` for every row of ``docs`` (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]
    scanned = docs.select("doc_id", "text").mapInArrow(_scan, _SCAN.format(id=kind))
    scanned = materialise(scanned.withColumn("row", F.monotonically_increasing_id()), "pii-scan")
    mention = scanned.filter(F.size("mentions") > 0).select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    mention = mention.select("row", "kind", "shapes", "instance", "start", "stop", F.explode("patterns").alias("pattern"))
    found = materialise(confident(mention), "pii-found")
    extra = (
        mention.filter("kind is null or kind = 'secret'")
        .join(found, ["pattern", "instance"])
        .filter(F.array_contains("shapes", F.col("found")))
        .select("row", "start", "stop", F.concat(F.lit("context_"), "found").alias("kind"))
        .distinct()
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("kind", "start", "stop"))).alias("more"))
    )
    outer = lambda s: lambda t: (t["kind"] == s["kind"]) & (t["start"] <= s["start"]) & (t["stop"] >= s["stop"]) & (t != s)
    extra = extra.withColumn("more", F.filter("more", lambda s: ~F.exists("more", outer(s))))
    line = F.array_join(F.transform("more", lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    joined = scanned.drop("mentions").join(extra, "row", "left")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("more").isNotNull(), line))
    counted = sum((F.col(f"n_{k}") for k in KINDS), F.coalesce(F.size("more"), F.lit(0)).cast("long"))
    return joined.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans"), F.greatest(counted, F.lit(0)).alias("n_spans"))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
