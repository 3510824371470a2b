"""Exact top-k search by inner product with KD-trees per shard (operator 2).

Vectors are floored to whole numbers, floor(64 x). They are dealt to shards by space: median splits
fitted on at most SAMPLE_VECTORS of them make cells, every vector is in the cell it falls into, and a cell
of more than about SHARD_VECTORS is dealt to several shards by digest (a third of all rows may be one
vector). Every shard builds one KD-tree: median splits on the widest dimension, a tight bounding box per
node. For a query q and a box [lo, hi] the sum of max(q_i lo_i, q_i hi_i) bounds every score inside, so a
best-first walk that opens the box with the highest bound may stop once that bound is below the
query's k-th best score so far.

The k-th score is propagated: queries travel in blocks of about QUERY_BLOCK from one cell; each block
first searches its home shard alone, and carries the k-th scores found there into the others. A shard
whose root box cannot reach a query's k-th score never sees that query. Each shard's tree is loaded once,
for all blocks that come to it; queries of a block that open the same box are scored by one
matrix product. Only k rows per query and shard come back to be merged.

Scores are whole numbers, computed in doubles only while they are exact there (else in Python integers).
Defined results: vectors that are null, empty or hold null or non-finite components, also after scaling,
take no part; vectors compare with those of their own length only; a query's own vec_id is never a
candidate; repeated rows are separate candidates and separate queries (``query_row`` tells them apart);
null vec_ids are neither queries nor candidates; fewer than k candidates give all; ties go to the
smaller vec_id; a score that does not fit 64 bits is ranked exactly and given as the nearest that fits;
other columns serve ``is_query`` only; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.llm.text import mix64
from cuegrid.scratch import materialise

TOP = 20
SCALE = 64
SHARD_VECTORS = 8192
LEAF_VECTORS = 128
QUERY_BLOCK = 1024
#: Vectors whose medians make the cells, at most; any cells give the same result.
SAMPLE_VECTORS = 20_000
#: Bytes of root boxes up to which shards are ruled out before their queries travel; beyond, in the shard.
ROOT_BYTES = 64 << 20

_MOST = (1 << 63) - 1


class Tree:
    """A KD-tree over the rows of a matrix of whole numbers, by ascending id in each leaf."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_VECTORS):
        spans, low, high = [], [], []
        order = np.argsort(ids, kind="stable")
        stack = [(0, len(ids))]
        while stack:
            a, b = stack.pop()
            part = rows[order[a:b]]
            lo, hi = part.min(axis=0), part.max(axis=0)
            wide = int(np.argmax(hi - lo))
            if b - a > leaf and hi[wide] > lo[wide]:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, wide], middle)]
                stack += [(a, a + middle), (a + middle, b)]
                continue
            order[a:b] = np.sort(order[a:b])
            spans.append((a, b))
            low.append(lo)
            high.append(hi)
        self.ids, self.rows, self.spans = ids[order], rows[order], spans
        self.low, self.high = np.array(low), np.array(high)

    def whole(self) -> Tree:
        """The same tree over Python integers."""
        other = object.__new__(Tree)
        other.ids, other.spans = self.ids, self.spans
        other.rows, other.low, other.high = (whole_numbers(m) for m in (self.rows, self.low, self.high))
        return other

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """[query, leaf]: no vector in the leaf scores more."""
        return reach(queries, self.low, self.high)


def reach(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """[query, box]: the highest score that a vector in the box can have."""
    zero = queries * 0
    return np.maximum(queries, zero) @ high.T + np.minimum(queries, zero) @ low.T


def whole_numbers(m: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)


def _exact(*matrices: np.ndarray) -> bool:
    """Every sum of products of two of them is exact in doubles."""
    most = max(float(np.abs(m).max(initial=0)) for m in matrices)
    return most * most * max(1, matrices[0].shape[1]) < 2**53


@dataclass
class Found:
    """The k best of a block's queries so far: scores and ids, best first, and how many."""

    scores: list[np.ndarray]
    ids: list[np.ndarray]
    opened: int = 0


def search(tree: Tree, queries: np.ndarray, own: np.ndarray, floors: list, k: int) -> Found:
    """Best-first search of the tree for all queries of a block. Only scores of at least the query's
    floor (None: any) are of use. In round r every query opens its r-th best leaf, unless even that
    cannot beat its limit; queries that open the same leaf share a product."""
    if not _exact(queries, tree.rows):
        tree, queries = tree.whole(), whole_numbers(queries)
    bounds = tree.bounds(queries)
    ranked = np.argsort(-bounds, axis=1, kind="stable")
    n = len(queries)
    found = Found([np.empty(0, tree.rows.dtype)] * n, [np.empty(0, np.int64)] * n)
    limits = np.array([-np.inf if f is None else f for f in floors], tree.rows.dtype)
    active = np.arange(n)
    for nth in range(len(tree.spans)):
        leaves = ranked[active, nth]
        open_ = (bounds[active, leaves] >= limits[active]).astype(bool)
        active, leaves = active[open_], leaves[open_]
        if not len(active):
            break
        found.opened += len(active)
        order = np.argsort(leaves, kind="stable")
        for group in np.split(active[order], np.flatnonzero(np.diff(leaves[order])) + 1):
            a, b = tree.spans[ranked[group[0], nth]]
            scores, ids = tree.rows[a:b] @ queries[group].T, tree.ids[a:b]
            useful = (scores >= limits[group]).astype(bool) & (ids[:, None] != own[group])
            for column in np.flatnonzero(useful.any(axis=0)):
                _take(found, group[column], scores[useful[:, column], column], ids[useful[:, column]], limits, k)
    return found


def _take(found: Found, q: int, scores: np.ndarray, ids: np.ndarray, limits: np.ndarray, k: int) -> None:
    scores, ids = np.concatenate([found.scores[q], scores]), np.concatenate([found.ids[q], ids])
    order = np.lexsort((ids, -scores))[:k] if scores.dtype != object else sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
    found.scores[q], found.ids[q] = scores[order], ids[order]
    if len(order) == k and found.scores[q][-1] > limits[q]:
        limits[q] = found.scores[q][-1]


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors that take part, floored to whole numbers, as bytes of doubles."""
    for batch in batches:
        keep, raw, widths = [], [], []
        lists = batch.column(1)
        for i, vector in enumerate(lists):
            values = vector.values
            if values is None or not len(values) or values.null_count:
                continue
            with np.errstate(all="ignore"):
                scaled = np.floor(np.asarray(values, np.float64) * SCALE)
            if np.isfinite(scaled).all():
                keep.append(i)
                raw.append(scaled.tobytes())
                widths.append(len(scaled))
        kept = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(2), pa.array(widths, pa.int32()), pa.array(raw, pa.binary())], names=["vec_id", "asks", "width", "v"])


def usable_vectors(vectors: DataFrame, is_query: Column) -> DataFrame:
    """vec_id, asks (is a query), width, v (bytes of whole doubles) of the vectors that take part."""
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("asks"))
    return rows.mapInArrow(_scaled, "vec_id long, asks boolean, width int, v binary")


def _matrix(raw: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(-1, width)


def _splits(rows: np.ndarray, depth: int) -> list:
    """Median splits, nested: (dimension, value, below, from it on); None for a cell."""
    if not depth or len(rows) < 2:
        return None
    wide = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
    value = float(np.median(rows[:, wide]))
    below = rows[:, wide] < value
    if not below.any():
        return None
    return [wide, value, _splits(rows[below], depth - 1), _splits(rows[~below], depth - 1)]


def _cells(rows: np.ndarray, splits: list | None, number: int = 0) -> np.ndarray:
    """The number of the cell of each row: a path through the splits."""
    out = np.full(len(rows), 2 * number + 1, np.int64)
    if splits is not None:
        below = rows[:, splits[0]] < splits[1]
        out[below] = _cells(rows[below], splits[2], 2 * number + 1)
        out[~below] = _cells(rows[~below], splits[3], 2 * number + 2)
    return out


def _placed(splits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, raw = np.asarray(batch.column(2)), np.array(batch.column(3).to_pylist(), object)
            cells = np.zeros(len(raw), np.int64)
            for width in np.unique(widths).tolist():
                own = widths == width
                cells[own] = _cells(_matrix(raw[own].tolist(), width), splits.value[width])
            digest = mix64(np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)) >> np.uint64(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(digest.astype(np.int64))], names=[*batch.schema.names, "cell", "digest"])

    return run


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One tree a shard, with the box of its root; shards arrive whole and in order."""
    held, shard, width = [], None, None

    def tree():
        grown = Tree(np.array([i for i, _ in held], np.int64), _matrix([v for _, v in held], width))
        low, high = grown.low.min(axis=0), grown.high.max(axis=0)
        columns = [pa.array([shard], pa.int64()), pa.array([width], pa.int32()), *[pa.array([x], pa.binary()) for x in (low.tobytes(), high.tobytes(), pickle.dumps(grown, 5))]]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "width", "low", "high", "tree"])

    for batch in batches:
        for own, length, vec_id, v in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and own != shard:
                yield tree()
                held = []
            shard, width = own, length
            held.append((vec_id, v))
    if held:
        yield tree()


def _dealt(k: int, shards_of: dict, roots):
    """Blocks of queries to (shard, queries): to the home shard if they have no floors yet, else to every
    other shard of their length whose root box may reach them. ``shards_of``: width -> (cell -> home shard, all shards)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                width = block[0]["width"]
                home, every = shards_of[width]
                first = home.get(block[0]["cell"], every[0])
                if roots is None:
                    yield _block(first, block)
                    continue
                boxes = roots.value.get(width)
                if boxes is None:
                    for shard in every:
                        if shard != first:
                            yield _block(shard, block)
                    continue
                rows = _matrix([q["v"] for q in block], width)
                numbers, low, high = boxes
                if not _exact(rows, low, high):
                    rows, low, high = whole_numbers(rows), whole_numbers(low), whole_numbers(high)
                bounds = reach(rows, low, high)
                for at, shard in enumerate(numbers):
                    reached = [q for q, bound in zip(block, bounds[:, at], strict=True) if q["floor"] is None or bound >= q["floor"]]
                    if shard != first and reached:
                        yield _block(shard, reached)

    return run


_BLOCK = "shard long, width int, load binary, is_tree boolean"


def _block(shard: int, block: list[dict]) -> pa.RecordBatch:
    load = pickle.dumps(([q["query_row"] for q in block], [q["vec_id"] for q in block], b"".join(q["v"] for q in block), [q["floor"] for q in block]), 5)
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([block[0]["width"]], pa.int32()), pa.array([load], pa.binary()), pa.array([False])], names=["shard", "width", "load", "is_tree"])


_FOUND = "query_row long, query_id long, vec_id long, score long, opened long"


def _searched(k: int):
    """A shard's tree, then the blocks that came to it. ``opened`` counts a block's opened leaves, on its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for _, width, load, is_tree in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if is_tree:
                    tree = pickle.loads(load)
                    continue
                query_rows, own, raw, floors = pickle.loads(load)
                found = search(tree, _matrix([raw], width), np.array(own), floors, k)
                sizes = [len(x) for x in found.ids]
                scores = [max(-_MOST - 1, min(_MOST, int(x))) for part in found.scores for x in part.tolist()]
                opened = np.zeros(sum(sizes), np.int64)
                opened[:1] = found.opened
                ids = np.concatenate(found.ids) if found.ids else np.empty(0, np.int64)
                columns = [np.repeat(query_rows, sizes), np.repeat(own, sizes), ids]
                yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int64)) for c in columns], pa.array(scores, pa.int64()), pa.array(opened)], names=[f.split()[0] for f in _FOUND.split(", ")])

    return run


def searched_rows(vectors: DataFrame, is_query: Column, k: int = TOP, shard_vectors: int = SHARD_VECTORS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``_FOUND`` rows of the home shards and of the others, not yet merged."""
    spark = vectors.sparkSession
    usable = materialise(usable_vectors(vectors, is_query), "topk-vectors")
    sizes = {r["width"]: r["n"] for r in usable.groupBy("width").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], _FOUND)
    share = min(1.0, SAMPLE_VECTORS / sum(sizes.values()))
    drawn = usable.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) <= F.lit(int(share * (1 << 20)))).select("width", "v").limit(2 * SAMPLE_VECTORS).collect()
    splits = {}
    for width, n in sizes.items():
        sample = [r["v"] for r in drawn if r["width"] == width]
        depth = max(0, -(-n // shard_vectors) - 1).bit_length()
        splits[width] = _splits(_matrix(sample, width), depth) if sample else None
    placed = usable.mapInArrow(_placed(spark.sparkContext.broadcast(splits)), "vec_id long, asks boolean, width int, v binary, cell long, digest long")
    placed = materialise(placed.withColumn("query_row", F.monotonically_increasing_id()), "topk-placed")

    # A shard is a part of a cell; a row for each cell is known here, about one in SHARD_VECTORS rows.
    cells = placed.groupBy("width", "cell").agg(F.count("*").alias("n"), F.count(F.when(F.col("asks"), 1)).alias("q")).orderBy("width", "cell").collect()
    shards_of: dict[int, tuple[dict, list]] = {}
    rows, first = [], 0
    for c in cells:
        parts, blocks = -(-c["n"] // shard_vectors), max(1, -(-c["q"] // query_block))
        home, every = shards_of.setdefault(c["width"], ({}, []))
        home[c["cell"]] = first
        every += range(first, first + parts)
        rows.append((c["width"], c["cell"], first, parts, blocks))
        first += parts
    numbers = spark.createDataFrame(rows, "width int, cell long, first long, parts long, blocks long")
    located = placed.join(numbers, ["width", "cell"])
    dealt = located.select((F.col("first") + F.col("digest") % F.col("parts")).alias("shard"), "width", "vec_id", "v")
    grown = dealt.repartition(min(first, 4096), "shard").sortWithinPartitions("shard", "vec_id").mapInArrow(_grow, "shard long, width int, low binary, high binary, tree binary")
    trees = materialise(grown, "topk-trees")
    loads = trees.select("shard", "width", F.col("tree").alias("load"), F.lit(True).alias("is_tree"))

    asking = located.filter("asks").select("width", "cell", F.pmod(F.xxhash64("query_row"), F.col("blocks")).alias("block"), "query_row", "vec_id", "v")
    asking = materialise(asking, "topk-queries")

    def meet(queries: DataFrame, roots) -> DataFrame:
        block = F.collect_list(F.struct("width", "cell", "query_row", "vec_id", "v", "floor")).alias("queries")
        blocks = queries.groupBy("width", "cell", "block").agg(block).select("queries").mapInArrow(_dealt(k, shards_of, roots), _BLOCK)
        # Trees before queries: each is loaded once for everything that comes to its shard.
        both = loads.unionByName(blocks).repartition(min(first, 4096), "shard").sortWithinPartitions("shard", F.desc("is_tree"))
        return both.mapInArrow(_searched(k), _FOUND)

    near = materialise(meet(asking.withColumn("floor", F.lit(None).cast("long")), None), "topk-home")
    floors = near.groupBy("query_row").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    boxes: dict[int, tuple] = {}
    if sum(2 * 8 * width * len(every) for width, (_, every) in shards_of.items()) <= ROOT_BYTES:
        for r in trees.select("shard", "width", "low", "high").collect():
            boxes.setdefault(r["width"], ([], [], []))
            for part, x in zip(boxes[r["width"]], (r["shard"], r["low"], r["high"]), strict=True):
                part.append(x)
        boxes = {w: (numbers, _matrix(low, w), _matrix(high, w)) for w, (numbers, low, high) in boxes.items()}
    return near.unionByName(meet(asking.join(floors, "query_row", "left"), spark.sparkContext.broadcast(boxes)))


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, shard_vectors: int = SHARD_VECTORS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_row, query_id, rank, vec_id, score of the k best candidates of every query row."""
    found = searched_rows(vectors, is_query, k, shard_vectors, query_block)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")


def op2_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 20 == 0).drop("query_row")


OP2_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
