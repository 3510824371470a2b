"""Near-duplicate documents by circulant MinHash (operator 1).

A document is the set of its 5-word shingles. C-MinHash takes two permutations of the 32-bit
universe: the first scrambles the set once, the second, shifted circularly by k, gives coordinate k
of the signature as the smallest permuted element. BANDS bands of ROWS coordinates become bucket keys.
Two sets at the linking threshold of 0.75 miss each other in all 48 bands with probability
(1 - 0.75**5)**48 = 2.3e-6; above the threshold that falls quickly. Every link is confirmed on the full sets.

Groups of copies are never expanded into pairs:

1. equal sets collapse to one representative (the smallest doc_id) by an aggregation that combines
   before it shuffles;
2. every member of a shared bucket is compared with one pivot, the smallest id it shares a bucket
   with (a star, not all pairs); the confirmed links give components;
3. a bucket whose members are still in several components may hide links between members that both
   differ from the pivot. Members of one pivot are then compared across components block by block,
   passing over what set sizes or the triangle inequality through the pivot exclude; pairs of members
   with different pivots are few and are confirmed one by one. So no possible link goes unexamined,
   nothing already connected is compared again, and large groups never become rows of pairs.

Defined results: text that is null or has no words gives an empty set, linked with nothing, its own
component, kept; a shorter text is one shingle; rows with a null doc_id are not linked
(component null, kept); repeated rows each give a row, and rows that repeat a doc_id are one vertex
of the link graph; an empty table gives an empty result; other columns are carried by
``drop_near_duplicates`` and ignored by ``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.graph import components
from cuegrid.llm.text import as_bytes, mix64, shingle_set
from cuegrid.scratch import materialise, release, tidy

#: Words in a shingle, and the linking threshold in percent of the union.
SHINGLE_WORDS = 5
MIN_PERCENT = 75
#: Signature layout.
BANDS = 48
ROWS = 5
#: Members of one pivot that travel together, and bytes of their sets, about.
BLOCK_MEMBERS = 128
BLOCK_BYTES = 4 << 20
#: Up to so many ids are broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000

_SHIFTS = np.arange(1, BANDS * ROWS + 1, dtype=np.uint32)
_BLOCK = 512


def _permute(x: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of 32-bit words, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray) -> np.ndarray:
    """Coordinate k is the minimum of the second permutation at (first permutation - k)."""
    first = (mix64(shingles) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    lowest = np.full(len(_SHIFTS), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(first), _BLOCK):
        shifted = first[a : a + _BLOCK, None] - _SHIFTS
        np.minimum(lowest, _permute(shifted).min(axis=0), out=lowest)
    return lowest


def band_keys(lowest: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band; the band's number is part of it."""
    rows = lowest.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, marks, bands = [], [], []
        for text in as_bytes(batch.column(1)):
            own = shingle_set(text, SHINGLE_WORDS)
            n.append(len(own))
            marks.append(xxhash.xxh3_128_digest(own.tobytes()))
            bands.append(band_keys(signature(own)) if len(own) else own.view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "mark", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(text, SHINGLE_WORDS).tobytes() for text in as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])


def overlap(one: np.ndarray, other: np.ndarray) -> int:
    """Size of the intersection of sorted distinct arrays."""
    small, large = (one, other) if len(one) <= len(other) else (other, one)
    if not len(small):
        return 0
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int(np.count_nonzero(large[at] == small))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        common, distance = [], []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            one, other = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = overlap(one, other)
            common.append(both > 0 and 100 * both >= MIN_PERCENT * (len(one) + len(other) - both))
            distance.append(1.0 - both / max(1, len(one) + len(other) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.bool_()), pa.array(distance, pa.float64())], names=["a", "b", "linked", "distance"])


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with ``linked`` and their Jaccard ``distance`` on the full sets, materialised."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("one"))
    other = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("other"))
    full = pairs.join(one, "a").join(other, "b").select("a", "b", "one", "other")
    return materialise(full.mapInArrow(_measure, "a long, b long, linked boolean, distance double"), "near-measured")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = texts.mapInArrow(_sign, "doc_id long, n_shingles long, mark binary, bands array<long>")
    signed = materialise(signed, "near-signatures")
    scratch = [signed]
    # Bands depend on the set alone, so any row of a group of equal sets has the right ones.
    groups = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("mark")
    groups = materialise(groups.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "near-groups")
    scratch.append(groups)

    entries = groups.select("rep", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).filter("pivot < last")
    members = materialise(entries.join(shared.select("bucket", "pivot"), "bucket"), "near-members")
    nearest = members.groupBy("rep").agg(F.min("pivot").alias("pivot"))
    nearest = materialise(nearest.join(groups.select("rep", "n", "bands"), "rep"), "near-nearest")
    wanted = nearest.select(F.col("rep").alias("doc_id"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    sets = materialise(texts.join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles binary"), "near-sets")

    first = measured(nearest.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")), sets)
    links = first.filter("linked").select("a", "b")
    nearest = nearest.join(first.select(F.col("b").alias("rep"), "distance"), "rep", "left").withColumn("distance", F.coalesce("distance", F.lit(0.0)))
    nearest = materialise(nearest, "near-placed")
    reached = components(links)
    tidy(docs.sparkSession)
    members_all, members = members, _open_members(members, reached)
    if members is not None:
        links = links.union(_within_pivots(members, nearest, sets))
        links = links.union(measured(_between_pivots(members, nearest), sets).filter("linked").select("a", "b"))
        reached = components(links)

    scratch += [members_all, sets, first, nearest, reached]
    component = groups.select("mark", "rep").join(reached.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = component.select("mark", F.coalesce("component", "rep").alias("component"))
    # Rows that are linked with nothing meet no other; they would all have the same empty key.
    linkable = F.coalesce((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.lit(False))
    out = signed.filter(linkable).select("doc_id", "n_shingles", "mark").join(component, "mark").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    out = out.union(signed.filter(~linkable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    out = materialise(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near-result")
    for used in scratch:
        release(used)
    tidy(docs.sparkSession)
    return out


def _open_members(members: DataFrame, reached: DataFrame) -> DataFrame | None:
    """Members, with their component as ``part``, of the buckets that are in several components."""
    placed = members.select("bucket", "rep").join(reached.select(F.col("node").alias("rep"), "component"), "rep", "left")
    placed = placed.select("bucket", "rep", F.coalesce("component", "rep").alias("part"))
    several = placed.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("bucket")
    found = materialise(placed.join(several, "bucket", "left_semi"), "near-open")
    return None if found.isEmpty() else found


_MEMBER = "array<struct<rep:long,part:long,n:long,distance:double,shingles:binary>>"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links across components between two blocks of one pivot's members, on the full sets."""
    for batch in batches:
        found_a, found_b = [], []
        for at in range(batch.num_rows):
            one, other = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
            fields = [[np.array([m[f] for m in block]) for f in ("rep", "part", "n", "distance")] for block in (one, other)]
            (rep, part, n, far), (rep_b, part_b, n_b, far_b) = [[c[:, None] for c in fields[0]], fields[1]]
            ask = (part != part_b) & (100 * np.minimum(n, n_b) >= MIN_PERCENT * np.maximum(n, n_b))
            ask &= np.abs(far - far_b) <= (100 - MIN_PERCENT) / 100 + 1e-9
            rows, columns = np.flatnonzero(ask.any(axis=1)), np.flatnonzero(ask.any(axis=0))
            if not len(rows):
                continue
            common = _overlaps([one[i]["shingles"] for i in rows], [other[j]["shingles"] for j in columns])
            union = n[rows] + n_b[columns] - common
            linked = ask[np.ix_(rows, columns)] & (100 * common >= MIN_PERCENT * union)
            for i, j in zip(*np.nonzero(linked), strict=True):
                x, y = int(rep[rows[i], 0]), int(rep_b[columns[j]])
                found_a.append(min(x, y))
                found_b.append(max(x, y))
        yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])


def _overlaps(one: list[bytes], other: list[bytes]) -> np.ndarray:
    """Sizes of all intersections: a product of incidence matrices over the shingles both sides have."""
    sides = [[np.frombuffer(x, np.uint64) for x in side] for side in (one, other)]
    shared = np.intersect1d(np.unique(np.concatenate(sides[0])), np.unique(np.concatenate(sides[1])), assume_unique=True)
    out = np.zeros((len(one), len(other)), np.float32)
    for a in range(0, len(shared), 4096):
        part = shared[a : a + 4096]
        incidence = []
        for side in sides:
            held = np.zeros((len(side), len(part)), np.float32)
            for i, x in enumerate(side):
                at = np.searchsorted(part, x)
                at[at == len(part)] = 0
                held[i, at[part[at] == x]] = 1
            incidence.append(held)
        out += incidence[0] @ incidence[1].T
    return out.astype(np.int64)


def _within_pivots(members: DataFrame, nearest: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) across components among the open members that were measured against one pivot.

    A member has one such pivot, so its set travels once, in a block of about BLOCK_MEMBERS members or
    BLOCK_BYTES, whichever makes more blocks; those of a pivot's largest component travel apart, as they
    need no comparison among themselves. A row is a pair of blocks, never a pair of members. As Jaccard
    distance is a metric, members whose distances to the pivot differ by more than the linking distance
    cannot link and are passed over.
    """
    rows = members.select("rep", "part").distinct().join(nearest.filter("rep <> pivot").drop("bands"), "rep")
    parts = rows.groupBy("pivot", "part").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    parts = parts.groupBy("pivot").agg(F.max(F.struct("k", "s", "part")).alias("top"), F.sum("k").alias("all"), F.sum("s").alias("sizes")).filter("top.k < all")
    blocks = lambda k, s: F.ceil(F.greatest(k / BLOCK_MEMBERS, s * 8 / BLOCK_BYTES))
    minors, majors = blocks(F.col("all") - F.col("top.k"), F.col("sizes") - F.col("top.s")), blocks(F.col("top.k"), F.col("top.s"))
    parts = parts.select("pivot", F.col("top.part").alias("major"), minors.alias("minors"), majors.alias("majors"))
    rows = rows.join(parts, "pivot").join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    own = F.xxhash64("rep")
    block = F.when(F.col("part") == F.col("major"), F.col("minors") + F.pmod(own, F.col("majors"))).otherwise(F.pmod(own, F.col("minors")))
    packed = rows.groupBy("pivot", block.alias("block"), "minors", "majors").agg(F.collect_list(F.struct("rep", "part", "n", "distance", "shingles")).cast(_MEMBER).alias("members"))
    packed = materialise(packed, "near-blocks")
    left = packed.filter("block < minors").select("pivot", F.col("members").alias("one"), F.explode(F.sequence("block", F.col("minors") + F.col("majors") - 1)).alias("block"))
    met = left.join(packed.select("pivot", "block", F.col("members").alias("other")), ["pivot", "block"])
    found = materialise(met.select("one", "other").mapInArrow(_compare, "a long, b long").distinct(), "near-within")
    release(packed)
    return found


def _between_pivots(members: DataFrame, nearest: DataFrame) -> DataFrame:
    """The other pairs (a, b) across components inside the open buckets, each once, in the smallest
    bucket it shares: both have pivots of their own, and neither is the other's."""
    one = members.join(nearest, "rep").select("bucket", "part", F.col("rep").alias("a"), "n", "pivot", "bands")
    other = one.select(F.col("bucket").alias("bucket_b"), *[F.col(c).alias(f"{c}_b") for c in ("part", "n", "pivot", "bands")], F.col("a").alias("b"))
    may_link = (
        (F.col("a") < F.col("b"))
        & (F.col("part") != F.col("part_b"))
        & (F.col("pivot") != F.col("pivot_b"))
        & (F.col("pivot_b") != F.col("a"))
        & (100 * F.least("n", "n_b") >= MIN_PERCENT * F.greatest("n", "n_b"))
    )
    once = F.array_min(F.array_intersect("bands", "bands_b")) == F.col("bucket")
    return one.join(other, on=(F.col("bucket") == F.col("bucket_b")) & may_link & once).select("a", "b")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, every column as it was. Of rows that
    repeat id and text the one with the smallest hash of its columns stays; null ids all stay."""
    place = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    own, doc_id, text = docs.toDF(*place.values()), F.col(place["doc_id"]), F.col(place["text"])
    found = near_duplicates(own.select(doc_id.alias("doc_id"), text.alias("text")))
    found = found.filter("kept and doc_id is not null").select(F.col("doc_id").alias("stays")).distinct()
    stay = own.join(found, doc_id.cast("long") == F.col("stays"), "left_semi")
    hashed = F.xxhash64(*[c for c, kind in own.dtypes if not kind.startswith("map")])
    once = stay.groupBy(doc_id.alias("own_id"), F.md5(text).alias("digest")).agg(F.min_by(F.struct(*place.values()), hashed).alias("row"))
    return once.select("row.*").union(own.filter(doc_id.isNull())).toDF(*docs.columns)


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS hit FROM documents UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.hit),
lowest AS (SELECT node, min(hit) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN lowest l ON l.node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
