"""Top-k, mixing, packing, archives and the pipeline."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cuegrid.llm import mixing, near_dedup, packing, quality, topk, warc
from cuegrid.scratch import scratch_path
from tests.llm.helpers import DOC, blank_split, documents, folded, frame, prose

VEC = "vec_id long, embedding array<float>, label int"


def topk_brute(rows, k):
    ok = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_topk(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, rng.gauss(0, 1)]) for _ in range(6)], 0) for i in range(400)]
    rows += [(400, [1.0] * 5, 0), (420, [0.5] * 5, 0), (401, None, 0), (440, [], 0), (402, [float("nan")] * 6, 0), (460, [None] * 6, 0), (None, [1.0] * 6, 0), (403, [float("inf")] + [0.0] * 5, 0)]
    rows += [(i + 1000, [9.0] * 6, 0) for i in range(50)] + [(7, rows[7][1], 0)]
    df = spark.createDataFrame(rows, VEC)
    for shard, block in ((8192, 1024), (37, 5)):
        got = topk.top_k(df, F.col("vec_id") % 20 == 0, shard_vectors=shard, query_block=block)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == topk_brute(rows, 20)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_topk_opens_few_leaves_where_vectors_cluster(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 8, (20, 8))
    rows = [(i, (centres[i % 20] + rng.normal(0, 0.05, 8)).tolist(), 0) for i in range(2000)]
    found = topk.searched_rows(spark.createDataFrame(rows, VEC), F.col("vec_id") % 20 == 0, k=5, shard_vectors=200).collect()
    queries = {r.query_id for r in found}
    assert len(queries) == 100
    leaves = 2000 // topk.LEAF_VECTORS
    assert sum(r.opened for r in found) < 0.5 * leaves * len(queries)


def test_topk_overflow(spark):
    rows = [(i, [x, 1.0], 0) for i, x in ((0, 1e30), (1, 1e29), (2, -1e30), (20, 2e-3), (3, 1e307), (4, 1e12))]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 20 == 0, k=4).collect()
    most = 2**63 - 1
    by = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got}
    assert by[0, 1] == (1, most) and by[0, 2] == (4, most) and by[0, 4] == (2, -most - 1) and all(r.vec_id != 3 for r in got)


def test_search_of_large_numbers():
    rng = np.random.default_rng(3)
    rows = rng.integers(-(2**40), 2**40, (300, 3)).astype(float)
    tree = topk.Tree(np.arange(300), rows, leaf=8)
    found = topk.search(tree, rows[5:6], np.array([5]), [None], 4)
    best = sorted((-sum(int(a) * int(b) for a, b in zip(r, rows[5], strict=True)), i) for i, r in enumerate(rows) if i != 5)[:4]
    assert list(zip((-x for x in found.scores[0]), found.ids[0], strict=True)) == best


def duck_mix(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    return sorted(map(repr, map(tuple, con.execute(mixing.OP7_SQL).fetchall())))


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    rows = documents(seed)
    got = mixing.fair_queue(frame(spark, rows))
    own = got.select("doc_id", "size", "source_size", "target", "taken").collect()
    # Rows equal in id and text but dealt different passes are interchangeable.
    assert sorted(map(repr, map(tuple, own))) == duck_mix(rows)
    assert all(r.taken <= 3 * r.size for r in own)
    biggest = max(r.size for r in own)
    total = sum(r.size for r in own)
    assert abs(sum(r.taken for r in own) - total) <= biggest
    by = {}
    for (doc_id, text, _, source, _) in rows:
        by.setdefault(source, 0)
    for target in {r.target for r in own}:
        same = [r for r in own if r.target == target]
        sources = {r.source_size for r in same}
        if len(sources) == 1:
            many = sum(r.size for r in same) // max(1, next(iter(sources)))
            assert abs(sum(r.taken for r in same) - target * many) <= biggest * max(1, many)


def test_mixing_splits_full_bins(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 3), "en", f"s{i % 2}", 0) for i in range(300)]
    df = frame(spark, rows)
    want = sorted(map(repr, map(tuple, mixing.fair_queue(df).select("doc_id", "size", "source_size", "target", "taken").collect())))
    assert want == duck_mix(rows)
    for bins, few in ((4, 3), (2, 1)):
        monkeypatch.setattr(mixing, "BINS", bins)
        monkeypatch.setattr(mixing, "ORDERED_ENTRIES", few)
        assert sorted(map(repr, map(tuple, mixing.fair_queue(df).select("doc_id", "size", "source_size", "target", "taken").collect()))) == want


def test_mix_documents(spark):
    rows = [(*r, 1) for r in documents(4)]
    df = spark.createDataFrame(rows, DOC + ", ticket int")
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    counts = mixing.fair_queue(df.drop("ticket")).groupBy().sum("copies").first()[0]
    assert out.count() == counts and out.filter("text is null").count() == 0
    assert mixing.fair_queue(frame(spark, [])).count() == 0
    assert mixing.fair_queue(frame(spark, [(1, None, None, None, 0)])).select("taken").first()[0] == 0
    empty_source = [(1, "a b", None, "s", 0), (2, " ", None, "t", 0), (3, None, None, None, 0)]
    assert sorted((r.doc_id, r.taken) for r in mixing.fair_queue(frame(spark, empty_source)).collect()) == [(1, 2), (2, 0), (3, 0)]


def test_pack_units():
    rng = random.Random(1)
    for _ in range(50):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(1, 80))]
        placed = packing.pack(lengths, (16, 32, 64))
        bins = {}
        for n, (at, capacity, offset) in zip(lengths, placed, strict=True):
            bins.setdefault((at, capacity), []).append((offset, n))
        assert len({at for at, _ in bins}) == len(bins)
        for (_, capacity), spans in bins.items():
            spans.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
            used = sum(n for _, n in spans)
            assert used <= capacity and capacity == min(c for c in (16, 32, 64) if c >= used)


def naive_pack(lengths, capacities):
    """The rules once more, with plain lists and no searching: best fit, least expected cost, downsizing."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins, where = [], {}
    for nth, i in enumerate(order):
        fits = [b for b in bins if b[0] - b[1] >= lengths[i]]
        if fits:
            chosen = min(fits, key=lambda b: (b[0] - b[1], bins.index(b)))
        else:
            costs = []
            for capacity in capacities:
                if capacity >= lengths[i]:
                    used = lengths[i]
                    for j in order[nth + 1 :]:
                        if used + lengths[j] <= capacity:
                            used += lengths[j]
                    costs.append((packing.bin_cost(min(c for c in capacities if c >= used)) / used, capacity))
            chosen = [min(costs)[1], 0, len(bins)]
            bins.append(chosen)
        where[i] = (chosen[2], chosen[1])
        chosen[1] += lengths[i]
    final = [min(c for c in capacities if c >= b[1]) for b in bins]
    return [(where[i][0], final[where[i][0]], where[i][1]) for i in range(len(lengths))]


def test_pack_against_brute_force(monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(packing, "ATTENTION_TOKENS", 64)
    monkeypatch.setattr(packing, "BIN_COST", 2)
    capacities = (16, 32, 64)
    for _ in range(120):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(1, 60))]
        got, want = packing.pack(lengths, capacities), naive_pack(lengths, capacities)
        assert got == want

    def cost(placed):
        return sum(packing.bin_cost(c) for c in {at: c for at, c, _ in placed}.values())

    def best(lengths):
        """The least cost over all ways to group the pieces."""
        found = [float("inf")]

        def go(i, bins):
            if i == len(lengths):
                found[0] = min(found[0], sum(packing.bin_cost(min(c for c in capacities if c >= b)) for b in bins))
                return
            for k in range(len(bins)):
                if bins[k] + lengths[i] <= capacities[-1]:
                    go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
            go(i + 1, [*bins, lengths[i]])

        go(0, [])
        return found[0]

    ratios = []
    for _ in range(60):
        lengths = [rng.randint(1, 64) for _ in range(7)]
        ratios.append(cost(packing.pack(lengths, capacities)) / best(lengths))
    assert min(ratios) >= 1 - 1e-9 and max(ratios) < 1.35 and sum(ratios) / len(ratios) < 1.1


def test_several_sizes_beat_any_single_one():
    rng = random.Random(4)
    cost = lambda placed: sum(packing.bin_cost(c) for c in {at: c for at, c, _ in placed}.values())
    # Pieces up to the largest size: only that one holds all of them.
    mixed = [min(4096, int(rng.lognormvariate(5.8, 1.2)) + 1) for _ in range(3000)]
    joint = packing.pack(mixed)
    assert len({c for _, c, _ in joint}) == 4 and cost(joint) < 0.9 * cost(packing.pack(mixed, (4096,)))
    # Short pieces, of which every size holds all: some lengths share a bin of one size best, some of another.
    short = [rng.choice([170, 340, 500]) + rng.randint(0, 10) for _ in range(1000)]
    singles = []
    for size in packing.CAPACITIES:
        singles.append(sum(packing.bin_cost(size) for _ in {at for at, _, _ in packing.pack(short, (size,))}))
    joint = packing.pack(short)
    assert len({c for _, c, _ in joint}) > 1 and cost(joint) < min(singles), (cost(joint), singles)


def test_pack_documents(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(0, 300)), None, None, 0) for i in range(60)] + [(1, None, None, None, 0), (None, prose(rng, 40), None, None, 0), (3, "a b", None, None, 0), (3, "a b", None, None, 0)]
    got = packing.pack_documents(frame(spark, rows), (32, 64, 128), shard_pieces=25).collect()
    want = sorted(repr((d, len(blank_split(t)))) for d, t, *_ in rows if blank_split(t))
    sums = {}
    for r in got:
        sums.setdefault(r.doc_id, []).append((r.start, r.length))
        assert 0 < r.length <= r.capacity <= 128
    assert sum(r.length for r in got) == sum(len(blank_split(t)) for _, t, *_ in rows) and len(want) >= len(sums)
    again = packing.pack_documents(frame(spark, rows), (32, 64, 128), shard_pieces=25).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert packing.pack_documents(frame(spark, [])).count() == 0


def warc_brute(rows):
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "")]
        first = min((p for p in same if p is not None), default=None)
        revisit = len(body) >= 100 and len(same) > 1 and first is not None and page_id != first
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_warc(spark):
    rng = random.Random(3)
    big = [prose(rng, 40) for _ in range(4)]
    rows = [(i, f"http://www.h{i % 7}.Example.org/{i % 11}?q={i % 3}#f", rng.choice([*big, "é" * 50, "short", None, "x" * 99, "x" * 100])) for i in range(200)]
    rows += [(None, None, big[0]), (None, "bad url", "lonely " * 30), (5, rows[5][1], rows[5][2]), (300, "http://[bad", ""), (301, "http://a.b/\tx\ny", "tab " * 40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = scratch_path(spark, "warc-test")
    captures = warc.write_archives(df, folder)
    directory = warc.build_index(captures, folder)
    got = warc.read_back(df, directory, folder).collect()
    assert sorted(map(tuple, got), key=repr) == warc_brute(rows)
    index = warc.CaptureIndex(folder, [tuple(r) for r in directory.collect()])
    for page_id, url, html in rows:
        found = index.read(url)
        assert any(h["X-Page-ID"] == ("" if page_id is None else str(page_id)) and (h["WARC-Type"] == "revisit" or body == (html or "").encode()) for h, body in found)
    assert index.read("http://nowhere.example/") == []
    # The rows come by way of the keys asked for, and of no others.
    some = df.filter("page_id < 20")
    keys = {warc.url_key(r[1]) for r in rows if r[0] is not None and r[0] < 20}
    assert sorted(r.page_id for r in warc.read_back(some, directory, folder).collect()) == sorted(r[0] for r in rows if warc.url_key(r[1]) in keys)
    empty = df.limit(0)
    assert warc.read_back(empty, directory, folder).count() == 0
    assert warc.read_back(df, warc.build_index(warc.write_archives(empty, folder), folder), folder).count() == 0


def test_warc_key_in_many_blocks(spark):
    rows = [(i, None if i % 3 else f"http://h{i % 5}.example/{i}", f"body {i}") for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = scratch_path(spark, "warc-blocks")
    directory = warc.build_index(warc.write_archives(df, folder), folder, block_lines=4)
    assert sorted(map(tuple, warc.read_back(df, directory, folder).collect()), key=repr) == warc_brute(rows)
    index = warc.CaptureIndex(folder, [tuple(r) for r in directory.collect()])
    assert len(list(index.blocks(""))) >= 20 and len(index.captures(None)) == 80 and len(list(index.blocks("zzz"))) == 0


def test_warc_of_very_long_pages(spark):
    rows = [(1, "http://a.example/", "é" * 2_000_000), (2, "http://b.example/", "é" * 2_000_000), (3, None, "z" * 5_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = scratch_path(spark, "warc-long")
    files = warc.build_index(warc.write_archives(df, folder), folder)
    assert sorted(map(tuple, warc.read_back(df, files, folder).collect()), key=repr) == warc_brute(rows)


def test_url_keys():
    assert warc.url_key("HTTPS://www.News.Example.com:8080/a?b#c") == "com,example,news)/a?b"


@pytest.mark.parametrize("stage", ["quality", "packing", "near", "mixing"])
def test_clashing_columns(spark, stage):
    names = ["__text", "__key", "row", "size", "verdict", "kept", "ticket", "k", "copies", "mark", "c0", "piece"]
    schema = DOC + ", " + ", ".join(f"`{n}` string" for n in names)
    rng = random.Random(2)
    rows = [(i, prose(rng, 40), "en", "s", 0, *names) for i in range(12)]
    df = spark.createDataFrame([*rows, rows[0], (None, None, None, None, None, *names)], schema)
    if stage == "packing":
        got = packing.pack_documents(df).collect()
        assert sum(r.length for r in got) == 13 * 40
        return
    if stage == "quality":
        labels = spark.createDataFrame([(i, i % 2, 0) for i in range(4)], "doc_id long, quality int, toxic int")
        out = quality.good_documents(df, labels)
    else:
        out = near_dedup.drop_near_duplicates(df) if stage == "near" else mixing.mix_documents(df)
    assert out.columns == df.columns
    got = out.collect()
    assert got and all(list(r)[5:] == names for r in got)
    if stage == "near":
        assert sorted((r.doc_id for r in got), key=str) == sorted([*range(12), None], key=str)


def shingles(text):
    w = blank_split(folded(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_brute(rows):
    """The rows that stay: the smallest id of every component, one of rows that repeat id and text."""
    texts = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            texts.setdefault(doc_id, []).append(shingles(text))
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in texts[a] for y in texts[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    kept = {r[:2] for r in rows if r[0] is not None and find(r[0]) == r[0]}
    return sorted([*kept, *[r[:2] for r in rows if r[0] is None]], key=repr)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on what the stage before it kept, against a restatement of its operator."""
    import corpus_pipeline

    from tests.llm.test_line_dedup import brute as lines_brute

    rng = random.Random(8)
    rows = documents(8) + [(700 + i, prose(rng, 40) + "\n" + rows_line, "en", "s2", 0) for i, rows_line in enumerate([prose(rng, 12)] * 4 + ["share this"] * 3)]
    rows += [(500 + i, " ".join(w.upper() + "!!" for w in prose(rng, 60).split()), "en", "s1", 0) for i in range(30)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], int(not 500 <= r[0] < 600), 0) for r in rows if r[0] is not None and r[0] % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, stages = spark.read.parquet(str(tmp_path / "documents.parquet")), dict(corpus_pipeline.STAGES)
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    model = quality.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    good = stages["quality rules"](spark, docs, str(tmp_path))
    kept = [r for r in rows if quality.verdict_of(r[1].encode() if r[1] is not None else None, model)[-1]]
    assert pairs(good) == sorted([r[:2] for r in kept], key=repr) and 20 < len(kept) < len(rows)

    short = stages["line dedup"](spark, frame(spark, kept), str(tmp_path))
    assert pairs(short) == lines_brute(kept)

    rest = [tuple(r) for r in short.collect()]
    single = stages["MinHash near-dedup"](spark, frame(spark, rest), str(tmp_path))
    assert pairs(single) == near_brute(rest)

    left = [tuple(r) for r in single.collect()]
    mixed = stages["mixing sources"](spark, frame(spark, left), str(tmp_path))
    taken = sorted(eval(x, {"nan": None})[0::4] for x in duck_mix(left))  # (doc_id, taken)
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(blank_split(r.text))
    want = {}
    for doc_id, n in taken:
        want[doc_id] = want.get(doc_id, 0) + n
    assert words == {k: v for k, v in want.items() if v}

    final = frame(spark, [tuple(r) for r in mixed.collect()])
    packed = stages["best-fit packing"](spark, final, str(tmp_path)).collect()
    pieces = sorted(tuple(r) for r in packing.pieces_of(final, packing.CAPACITIES, None).select("ticket", "piece", "doc_id", "length").collect())
    expected = naive_pack([p[3] for p in pieces], packing.CAPACITIES)
    assert sorted((r.doc_id, r.piece, r.length, r.capacity, r.offset) for r in packed) == sorted((p[2], p[1], p[3], c, o) for p, (_, c, o) in zip(pieces, expected, strict=True))
    assert {r.bin_id for r in packed} == {f"0-{at}" for at, _, _ in expected}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    rows = documents(6) + [(500 + i, " ".join(w.upper() + "!!" for w in prose(rng, 60).split()), "en", "s1", 0) for i in range(40)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], int(r[0] < 500), 0) for r in rows if r[0] is not None and r[0] % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, sf = frame(spark, rows), str(tmp_path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        before, docs = docs, spark.createDataFrame(out.collect(), out.schema)
        if name == "quality rules":
            assert docs.filter("doc_id >= 500").count() <= 1 and docs.filter("doc_id < 500").count() > 20
        if name == "line dedup":
            assert docs.count() == before.count()
    assert corpus_pipeline.run(spark, sf).count() > 0 and corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules"
