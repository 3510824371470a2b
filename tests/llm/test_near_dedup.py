import random

import numpy as np
import pytest

from cuegrid.llm import near_dedup as nd
from cuegrid.llm.graph import components
from tests.llm.helpers import DOC, blank_split, documents, folded, frame, prose


def brute(rows):
    sets = []
    for doc_id, text, *_ in rows:
        w = blank_split(folded(text or ""))
        sets.append((doc_id, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = documents(seed)
    got = nd.near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chains_of_copies(spark):
    """Groups in which few members are close to the first one: links must be found between the others."""
    rng, rows = random.Random(4), []
    for group in range(4):
        text = prose(rng, 120).split()
        for _ in range(40):
            rows.append((len(rows), " ".join(text), None, None, 0))
            text = list(text)
            for _ in range(rng.choice([1, 2, 3, 4])):
                text[rng.randrange(120)] = f"new{rng.randrange(10**6)}"
        shared = prose(rng, 60)
        rows += [(len(rows) + i, shared + " " + prose(rng, rng.randint(10, 40)) + f" g{group}{i}", None, None, 0) for i in range(40)]
    got = nd.near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)


def test_drop_keeps_columns_and_clean_rows(spark):
    rows = [(*r, 7, "k") for r in documents(3)]
    df = spark.createDataFrame(rows, DOC + ", rep long, bucket string")
    out = nd.drop_near_duplicates(df)
    assert out.columns == df.columns
    stay = sorted({c for _, _, c in brute([r[:5] for r in rows]) if c is not None})
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == stay
    assert out.filter("doc_id is null").count() == 2


def test_empty(spark):
    assert nd.near_duplicates(frame(spark, [])).count() == 0
    assert nd.drop_near_duplicates(frame(spark, [(1, None, None, None, 0), (2, "", None, None, 0)])).count() == 2


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for overlap in (300, 1200, 1800):
        a, b = np.unique(pool[:2000]), np.unique(pool[2000 - overlap : 4000 - overlap][:2000])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((nd.signature(a) == nd.signature(b)).mean() - true) < 0.12


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    parent = {n: n for e in edges for n in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {n: find(n) for n in parent}
