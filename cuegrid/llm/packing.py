"""Best-fit packing into bins of several permitted lengths (operator 6).

Documents become pieces (one each; a longer one than the largest bin is cut into full bins and a rest,
nothing is dropped). Pieces are dealt at random, by digest, to shards of about SHARD_PIECES pieces, so
a shard is a fair sample of the lengths and shards pack independently on any number of executors.
Inside a shard, longest first, a piece goes into the open bin it fills best. If none has room a bin
is opened: of every permitted size that holds the piece the one with the least expected cost per
token, judged by the lengths still waiting in the shard. A bin costs BIN_COST, its length, and its length
squared over ATTENTION_TOKENS, as attention does; so a long bin is worth it only for long pieces or where
it saves empty room, and sizes compete. At the end every bin is downsized to the smallest permitted size
that holds its contents, which never loses a piece.

Defined results: pieces of length 0 (null or blank text) are not placed and give no row; null ids and
repeated rows are packed like any other; an empty table gives an empty result. Lengths are words
unless ``length`` is given; very long texts are cut into bins, never shortened. Other columns are ignored,
whatever their names. Reruns agree.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.mixing import token_count
from cuegrid.scratch import materialise

#: Permitted sequence lengths.
CAPACITIES = (512, 1024, 2048, 4096)
#: Fixed cost of a bin, in tokens, and the length at which attention costs as much as the rest.
BIN_COST = 32
ATTENTION_TOKENS = 8192
#: Pieces of a shard, about.
SHARD_PIECES = 20_000


def bin_cost(capacity: int) -> float:
    """What a bin of this size costs, in tokens."""
    return BIN_COST + capacity + capacity * capacity / ATTENTION_TOKENS


def _opening(length: int, waiting: list[int], capacities: tuple[int, ...]) -> int:
    """The permitted size with the least expected cost per token for a bin that starts with ``length``.

    ``waiting`` are the lengths still to come, ascending. The room left is filled greedily with the
    longest that fit, as best fit will do; what stays empty is paid for.
    """
    best, best_cost = capacities[-1], None
    for capacity in capacities:
        if capacity < length:
            continue
        used, top = length, len(waiting)
        while top and used < capacity:
            k = bisect.bisect_right(waiting, capacity - used, 0, top) - 1
            if k < 0:
                break
            used += waiting[k]
            top = k
        # Downsizing later means paying only for the smallest size that holds the contents.
        final = capacities[bisect.bisect_left(capacities, used)]
        cost = bin_cost(final) / used
        if best_cost is None or cost < best_cost or (cost == best_cost and capacity < best):
            best, best_cost = capacity, cost
    return best


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> list[tuple[int, int, int]]:
    """(bin, capacity of the bin, offset) of each piece; lengths are between 1 and the largest size."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    waiting = sorted(lengths)
    rooms: list[tuple[int, int]] = []  # (room left, bin), ascending
    used: list[int] = []
    where = [(0, 0)] * len(lengths)
    for i in order:
        n = lengths[i]
        waiting.pop()
        k = bisect.bisect_left(rooms, (n, -1))
        if k < len(rooms):
            room, at = rooms.pop(k)
        else:
            room, at = _opening(n, waiting, capacities), len(used)
            used.append(0)
        where[i] = (at, used[at])
        used[at] += n
        if room > n:
            bisect.insort(rooms, (room - n, at))
    final = [capacities[bisect.bisect_left(capacities, u)] for u in used]
    return [(at, final[at], offset) for at, offset in where]


def pieces_of(docs: DataFrame, capacities: tuple[int, ...], length: Column | None) -> DataFrame:
    """doc_id, piece, start, length of every piece, in words of the document."""
    size = token_count(F.col("text")) if length is None else length
    largest = capacities[-1]
    rows = docs.select("doc_id", size.alias("size"), F.xxhash64("doc_id", "text").alias("ticket")).filter("size > 0")
    rows = rows.select("doc_id", "ticket", "size", F.explode(F.sequence(F.lit(0), F.expr(f"int((size - 1) div {largest})"))).alias("piece"))
    start = F.col("piece").cast("long") * largest
    return rows.select("doc_id", "ticket", "piece", start.alias("start"), F.least(F.lit(largest).cast("long"), F.col("size") - start).alias("length"))


_PLACED = "doc_id long, piece int, start long, length long, shard long, bin int, capacity long, offset long"


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, length: Column | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start and length in the document, bin_id, capacity of the
    bin, offset in it. ``docs`` needs doc_id and text; other columns are ignored."""
    capacities = tuple(sorted(capacities))
    pieces = materialise(pieces_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), capacities, length), "pack-pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("ticket", "piece"), F.lit(shards)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, shard = [], None

        def flush():
            placed = pack([row[4] for row in group], capacities)
            rows = [(d, p, s, n, shard, at, cap, off) for (d, _, p, s, n), (at, cap, off) in zip(group, placed, strict=True)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in _PLACED.split(", ")])

        for batch in batches:
            for *row, own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != shard:
                    if group:
                        yield flush()
                    group, shard = [], own
                group.append(row)
        if group:
            yield flush()

    ordered = dealt.repartition(min(shards, 4096), "shard").sortWithinPartitions("shard", "ticket", "piece", "doc_id", "length")
    placed = ordered.select("doc_id", "ticket", "piece", "start", "length", "shard").mapInArrow(place, _PLACED)
    bin_id = F.concat_ws("-", F.col("shard"), F.col("bin"))
    return placed.select("doc_id", "piece", "start", "length", bin_id.alias("bin_id"), "capacity", "offset")


def op6_pack(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
