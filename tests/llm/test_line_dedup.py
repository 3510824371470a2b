import random
import re
import time
from hashlib import md5

import pytest

from cuegrid.llm import line_dedup as ld
from tests.llm.helpers import DOC, documents, frame, prose


def tokens(line):
    w = re.findall(r"[^\x20\x09-\x0D]+", line)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Text after removal, by row; rows that repeat id and text are one document."""
    docs = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1] is not None}, key=lambda d: (*d[:2], md5(d[2].encode()).hexdigest()))
    lines = [(d, n, line, tokens(line)) for d in docs for n, line in enumerate(d[2].split("\n"))]
    gone = set()
    for i, (d, n, _, s) in enumerate(lines):
        if s and any(t and 100 * len(s & t) >= 75 * len(s | t) for *_, t in lines[:i]):
            gone.add((d, n))
    out = []
    for doc_id, text, *_ in rows:
        key = (doc_id is None, doc_id or 0, text)
        out.append((doc_id, None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if (key, n) not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 5])
def test_against_brute_force(spark, seed):
    rows = [r for r in documents(seed)]
    got = ld.drop_repeated_lines(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == brute(rows)


def test_families_of_lines(spark):
    rng, rows = random.Random(8), []
    for _ in range(6):
        base = prose(rng, 60).split()
        for _ in range(25):
            line = list(base)
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(60)] = f"w{rng.randrange(1000)}"
            rows.append((len(rows), prose(rng, 9) + "\n" + " ".join(line), None, None, 0))
    got = ld.drop_repeated_lines(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == brute(rows)


def test_columns_and_counts(spark):
    line = "these six words are one line"
    rows = [(1, f"{line}\nshort one", "en", "s", 37, "a", 1), (2, f"{line}\nshort two", "en", "s", 37, "b", 2), (3, None, None, None, None, None, 3)]
    df = spark.createDataFrame(rows, DOC + ", tokens string, id int")
    out = {r.doc_id: r for r in ld.drop_repeated_lines(df).collect()}
    assert out[1].text == f"{line}\nshort one" and out[1].n_chars == 37
    assert out[2].text == "short two" and out[2].n_chars == 9 and out[2].tokens == "b"
    assert out[3].text is None and out[3].n_chars is None
    counts = {r.doc_id: (r.n_lines, r.n_removed) for r in ld.line_counts(df).collect()}
    assert counts == {1: (2, 0), 2: (2, 1), 3: (0, 0)}


def test_clashing_columns(spark):
    names = ["__key", "__twin", "__gone", "__lines", "__removed", "gone", "twin", "doc_key", "lines", "removed", "rest", "c0", "row"]
    df = spark.createDataFrame([(i, "one line of six plain words\n\n", *names) for i in range(3)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = ld.drop_repeated_lines(df)
    assert out.columns == df.columns
    assert sorted(r.text for r in out.collect()) == ["\n", "\n", "one line of six plain words\n\n"]
    assert all(list(r)[2:] == names for r in out.collect())


def test_copied_short_and_blank_lines(spark):
    text = "Read more about us\nshare this\n\n \t\nshare  this\nno"
    rows = [(i, text if i < 5 else "yes\nno", None, None, 0) for i in range(6)]
    got = {r.doc_id: r.text for r in ld.drop_repeated_lines(frame(spark, rows)).collect()}
    assert got[0] == "Read more about us\nshare this\n\n \t\nno" and got[3] == "\n \t" and got[5] == "yes"


def test_many_texts_under_one_id(spark):
    rows = [(7 if i % 2 else None, "\n".join(" ".join(f"w{i}x{k}{c}" for c in "abcdef") for k in range(3)), None, None, 0) for i in range(2000)]
    got = ld.drop_repeated_lines(frame(spark, rows + [rows[4], rows[5]])).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(r[0], r[1]) for r in rows + [rows[4], rows[5]]], key=repr)


def test_tokens_have_the_ranks_that_were_counted(spark):
    """Tokens are hashed in one way where they are counted and in another where they are made; short lines too."""
    lines = ["a b c d e"] * 40 + ["x  y"] * 40 + ["x y\t"] * 40 + ["one"] * 10 + [f"u{i} v w z q r" for i in range(50)]
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    ranks = ld.token_ranks(df)
    made = ld._tokens(ld._lines(df, "doc_id"), ranks, "line_no")
    assert not made.schema["tokens"].dataType.containsNull
    found = {r.line_no: [t >> 56 for t in r.tokens] for r in made.collect()}
    assert found[0] == [90] and found[40] == found[80] == [95] and found[120] == [80]
    assert [len(found[130 + i]) for i in range(50)] == [2] * 50 and all(64 in found[130 + i] for i in range(50)) and all(max(found[130 + i]) == 92 for i in range(50))


def test_one_document_of_many_lines(spark):
    """Time is about linear in the lines of one document: equal lines, and near copies of each other."""
    lines = [f"line {i % 30_000} has some words of its own {i % 30_000}" for i in range(60_000)]
    near = [f"{i} " + " ".join(f"v{i}x{k}" for k in range(24)) + tail for i in range(10_000) for tail in ("", f" z{i}")]
    began = time.monotonic()
    got = ld.drop_repeated_lines(frame(spark, [(1, "\n".join(lines), None, None, 0), (2, "", None, None, 0), (3, "\n".join(near), None, None, 0)])).collect()
    assert {r.doc_id: r.text for r in got} == {1: "\n".join(lines[:30_000]), 2: "", 3: "\n".join(near[::2])}
    assert time.monotonic() - began < 120


def test_long_words_and_lines(spark):
    rng = random.Random(3)
    long = "x" * 700_000 + " y"
    words = " ".join(f"{rng.randrange(10**6)}" for _ in range(200_000))
    rows = [(1, f"{long}\n{words}", None, None, 0), (2, f"a {long}\n{words} z\n{long}", None, None, 0)]
    got = {r.doc_id: r.text for r in ld.drop_repeated_lines(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: f"a {long}"}


def test_empty(spark):
    assert ld.drop_repeated_lines(frame(spark, [])).count() == 0
