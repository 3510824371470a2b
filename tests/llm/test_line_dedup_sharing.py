import random

from cuegrid.llm import line_dedup as ld
from tests.llm.helpers import frame, prose
from tests.llm.test_line_dedup import brute, tokens


def test_matching_lines_share_an_entry(spark):
    """Also where words and whole shingles repeat, and with fewer different words than the prefix has tokens."""
    rng, lines = random.Random(4), []
    for words in (3, 12, 300):
        for _ in range(60):
            line = [f"v{rng.randrange(words)}" for _ in range(rng.randint(1, 50))]
            edited = list(line)
            for _ in range(rng.randint(0, 2)):
                edited.insert(rng.choice([0, len(edited), rng.randrange(len(edited) + 1)]), f"v{rng.randrange(words)}")
            lines += [" ".join(line), " ".join(edited[rng.randint(0, 1) :])]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
    found = {}
    for row in ld._entries(ld._lines(df, "id"), "id").collect():
        found.setdefault(row.id, set()).add(row.token)
    sets = [tokens(line) for line in lines]
    pairs = [(i, j) for i, s in enumerate(sets) for j, t in enumerate(sets[:i]) if s and t and 100 * len(s & t) >= 75 * len(s | t)]
    assert len(pairs) > 100 and all(found[i] & found[j] for i, j in pairs)
    assert sum(len(found[i]) for i in range(240, 360) if i in found) < 0.6 * sum(len(s) for s in sets[240:])


def test_sets_are_made_only_of_lines_that_share(spark, monkeypatch):
    rng, made, plain = random.Random(6), [], ld._shingles
    monkeypatch.setattr(ld, "_shingles", lambda rows, *keep: made.append(rows.count()) or plain(rows, *keep))
    line = " ".join(f"k{i}" for i in range(40))
    rows = [(i, " ".join(f"u{i}x{k}" for k in range(rng.randint(5, 30))), None, None, 0) for i in range(200)]
    rows += [(200, line, None, None, 0), (201, f"{line} z", None, None, 0), (202, line, None, None, 0)]
    got = ld.drop_repeated_lines(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in got if not r.text) == [201, 202]
    assert made == [2]


def test_lines_with_most_copies(spark, monkeypatch):
    """Their copies give no entries, near copies of them are found."""
    rng = random.Random(9)
    lines = [prose(rng, 30) for _ in range(4)]
    rows = [(i, lines[i % 4] + (f" q{i}" if i % 9 == 8 else "") + "\n" + prose(rng, 8), None, None, 0) for i in range(90)]
    for often in (0, 2, 100):
        monkeypatch.setattr(ld, "OFTEN", often)
        got = ld.drop_repeated_lines(frame(spark, rows)).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == brute(rows)


def test_common_tokens_are_dealt_with_their_lines(spark, monkeypatch):
    """A passage that very many lines hold sends no more entries to one key than a line has."""
    rng, dealt, plain = random.Random(2), [], ld._shared
    monkeypatch.setattr(ld, "_shared", lambda entries, owner: dealt.append(entries.groupBy("token").count().agg({"count": "max"}).first()[0]) or plain(entries, owner))
    passage = " ".join(f"a{k}" for k in range(8))
    rows = [(i, " ".join(f"u{i}x{k}" for k in range(24)) + " " + passage, None, None, 0) for i in range(1500)]
    rows += [(1500 + i, rows[i][1] + f" z{i}", None, None, 0) for i in range(0, 1500, 50)]
    got = {r.doc_id: r.text for r in ld.drop_repeated_lines(frame(spark, rows)).collect()}
    assert sorted(r for r in got if not got[r]) == [r[0] for r in rows[1500:]]
    assert dealt[0] <= 32
