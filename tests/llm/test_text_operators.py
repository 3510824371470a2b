"""Quality, licences, personal data and language, against plain restatements."""

import random
import re
from collections import Counter

import numpy as np

from cuegrid.llm import language, licenses, pii, quality
from tests.llm.helpers import DOC, blank_split, documents, folded, frame, prose


def quality_brute(text):
    text = text or ""
    w = blank_split(text)
    lines = [x for x in text.split("\n") if blank_split(x)]
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = set()
    for i, x in enumerate(wins):
        if wins.count(x) > 1:
            hit |= set(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark):
    rng = random.Random(2)
    texts = [r[1] for r in documents(1)] + ["a b c d e f g h " * 3, "x\r\nx\r\n \n \nx", "##$ <a|b> & %", "\x0b\x0c", " ".join(rng.choice("ab") for _ in range(60))]
    for text in texts:
        got = quality.verdict_of(text.encode() if text is not None else None, None)
        assert got[:5] == quality_brute(text), text
        assert got[6] == (got[0] < 20 or 100 * got[4] > 30 * got[0]) and got[7] == (not got[6])


def test_quality_model_separates(spark):
    rng = random.Random(3)
    good = [(i, prose(rng, 60)) for i in range(120)]
    bad = [(i, " ".join(w.upper() + "!!" for w in prose(rng, 60).split())) for i in range(120, 240)]
    docs = spark.createDataFrame([*good, *bad, (999, None), (None, prose(rng, 40))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(0, 240, 2)] + [(5000, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.good_documents(docs, labels).collect()}
    odd_good, odd_bad = set(range(1, 120, 2)), set(range(121, 240, 2))
    assert len(kept & odd_good) >= 58 and len(kept & odd_bad) <= 2 and 999 not in kept and None in kept
    one_kind = labels.filter("quality = 1")
    assert quality.fit(docs, one_kind) is None and quality.good_documents(docs, one_kind).count() == 241
    assert quality.good_documents(docs.limit(0), labels).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_license_base(spark):
    rng = random.Random(5)
    bits = ["MIT License", "mit-license", "Apache  LICENSE.", "GNU General Public License", "license", "mit", "été", "general public", "\n", "x9"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(200)] + [None, "", "MIT"]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        w = WORD.findall(folded(text or ""))
        hits = [(k, label) for phrase, label in licenses.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(hits))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_license_templates(spark):
    rng = random.Random(6)
    rows, expected = [], {}
    for label, (text, _) in licenses.TEMPLATES.items():
        rows.append((len(rows), prose(rng, 50) + " " + text.upper() + ". " + prose(rng, 50)))
        expected[len(rows) - 1] = label
    rows.append((len(rows), "free of charge is hereby granted the software permission without restriction in deal " + prose(rng, 30)))
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[i].labels.split(",") and got[i].score > 0.9 for i, label in expected.items())
    assert got[len(rows) - 1].labels == "" and got[len(rows) - 1].score == 0
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_license_index_decides():
    index = licenses.build_index({}, 10)
    mit = licenses.license_words(licenses.TEMPLATES["mit"][0].encode())
    assert set(licenses.template_hits(mit, index)) == {"mit"}
    # Rarer words of the template elsewhere in the file do not hide it.
    common = {w: 10 for p in licenses.TEMPLATES["mit"][1] for w in licenses.license_words(p.encode())}
    skewed = licenses.build_index(common, 10)
    tail = licenses.license_words(b"merchantability noninfringement sublicense tort contract dealings furnished")
    assert "mit" in licenses.template_hits([b"x"] * 50 + mit[:40] + [b"y"] * 90 + tail, skewed)
    # Without postings there is no alignment, and key phrases far apart are none either.
    assert licenses.template_hits(mit, licenses.Index(index.words, index.postings, index.phrases, {}, index.idf)) == {}
    one, two = (licenses.license_words(p.encode()) for p in licenses.TEMPLATES["mit"][1])
    assert licenses.template_hits(one + [b"x"] * 300 + two, index) == {}
    assert set(licenses.template_hits(one + mit[8:22] + two, index)) == {"mit"}


def test_license_hits_against_brute_force():
    """Every place of the rarest key phrase is tried, without the index."""
    rng = random.Random(9)
    index = licenses.build_index({b"the": 9, b"license": 5, b"software": 4}, 10)
    anchor = {label: at for own in index.anchors.values() for label, at in own}

    def brute(words):
        out = set()
        for label, phrases in index.phrases.items():
            for offset in range(-len(index.words[label]), len(words)):
                spread = lambda at: licenses.SLACK + abs(at - anchor[label]) // licenses.DRIFT  # noqa: B023, E731
                first = next((p, at) for p, at in phrases if at <= anchor[label] < at + len(p))
                if words[max(0, offset + first[1]) : offset + first[1] + len(first[0])] != first[0] or offset + first[1] < 0:
                    continue
                if all(any(words[k : k + len(p)] == p for k in range(max(0, offset + at - spread(at)), offset + at + spread(at) + 1)) for p, at in phrases):
                    out.add(label)
        return out

    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 4)):
            text = licenses.license_words(rng.choice(list(licenses.TEMPLATES.values()))[0].encode())
            a = rng.randrange(len(text))
            words += text[: rng.randint(1, len(text))] if rng.random() < 0.6 else text[a:]
            for _ in range(rng.randint(0, 3)):
                words.insert(rng.randrange(len(words) + 1), b"x")
        assert brute(words) <= set(licenses.template_hits(words, index))


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def pii_brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub(r"\D", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_pii_base():
    rng = random.Random(1)
    for _ in range(30_000):
        text = "".join(rng.choice("1204@.a-+ ()é\n5") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == pii_brute(text), text
    for _ in range(5_000):
        text = "".join(rng.choice("0123456789- ") for _ in range(rng.randint(10, 40)))
        assert pii.base_spans(text) == pii_brute(text), text
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 200_000) == []


def test_pii_contexts(spark):
    rng = random.Random(2)
    rows = [(i, f"{prose(rng, 5)} please call me +1 (555) 010-{i:04d} thanks {prose(rng, 5)}") for i in range(30)]
    rows += [(100 + i, f"{prose(rng, 4)} please call me 555010{i:04d} thanks {prose(rng, 3)}") for i in range(3)]
    rows += [(200, "there were 5550100 people in the room"), (201, None), (None, "write to a.b@c.de now"), (202, ""), (202, "")]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[3].n_phone == 1 and by[3].spans.startswith("phone:")
    text = dict(rows)[101]
    found = by[101].spans.split(",")
    assert by[101].n_phone == 0 and found and all(s.startswith("context_phone:") for s in found)
    start, end = map(int, found[0].split(":")[1:])
    assert text[start:end] == "5550100001"
    assert by[200].spans == "" and by[201].spans == "" and by[None].n_email == 1
    import hashlib

    assert by[202].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def counted(text):
    """(keys, counts, context sums) of the orders four to one, restated."""
    four = Counter(language.grams([text.encode()])[0].tolist())
    tables, table = [], four
    for length in (4, 3, 2, 1):
        if length < 4:
            table = Counter(k & ((1 << 16 * length) - 1) for k in table)
        sums = Counter()
        for k, n in table.items():
            sums[k >> 16] += n
        keys = sorted(table)
        tables.append((np.array(keys, np.uint64), np.array([table[k] for k in keys]), np.array([sums[k >> 16] for k in keys])))
    return tables


def test_language_model_is_a_distribution():
    tables = counted(prose(random.Random(1), 200) + " été là 日本")
    whole = language.kneser_ney(tables)
    few = language.kneser_ney([tuple(x[t[1] >= 3] for x in t) for t in tables])
    for model in (whole, few):
        for context in (int(tables[0][0][5]) >> 16, int(tables[0][0][-1]) >> 16, 0, 77 << 16 | 3):
            every = np.arange(context << 16, (context << 16) + (1 << 16), dtype=np.uint64)
            assert abs(np.exp(model.log_probabilities(every)).sum() - 1) < 1e-4


def test_language_against_brute_force():
    """Interpolation written as its recursion, from the same counts."""
    tables = counted(prose(random.Random(2), 120))
    tables_by_length = [dict(zip(t[0].tolist(), zip(t[1].tolist(), t[2].tolist(), strict=True), strict=True)) for t in tables]

    def p(key, at):
        if at == 4:
            return 1 / (1 << 16)
        length = 4 - at
        context = (key & ((1 << 16 * length) - 1)) >> 16
        own = {k: v for k, v in tables_by_length[at].items() if k >> 16 == context}
        rest = 1 - sum((n - 0.75) / total for n, total in own.values()) if own else 1
        n, total = own.get(key & ((1 << 16 * length) - 1), (0, 1))
        return max(n - 0.75, 0) / total + rest * p(key, at + 1)

    queries = np.unique(language.grams([(prose(random.Random(3), 20) + " xyz ß").encode()])[0])
    got = language.kneser_ney(tables).log_probabilities(queries)
    assert np.allclose(got, [np.log(p(int(k), 0)) for k in queries], atol=1e-4)


def test_grams_stay_inside_texts_and_scripts_apart():
    texts = ["Été à la", "  x!!y  ", "", "日本 z", "a", "𐐀𐐁 x"]
    alone = [language.grams([t.encode()])[0].tolist() for t in texts]
    keys, owner = language.grams([t.encode() for t in texts])
    assert [keys[owner == i].tolist() for i in range(len(texts))] == alone
    assert len({language.grams([c.encode()])[0].tolist()[0] for c in "aéжя日本語한"}) == 8


def test_language_counts_orders_and_rejection(spark):
    rng = random.Random(7)
    kinds = {"aa": ["the", "of", "tion", "and", "ing"], "bb": ["der", "und", "schaft", "ung", "ich"]}
    make = lambda k: " ".join("".join(rng.choice(kinds[k]) for _ in range(2)) for _ in range(30))
    rows = [(i, make(k), k, "s", 0) for i, k in enumerate(rng.choice(list(kinds)) for _ in range(600))]
    df = frame(spark, rows, DOC)
    table = language._kept_grams(language.gram_counts(df.select("text", "lang"))).filter("lang = 'aa'").collect()
    want = Counter()
    for _, t, k, *_ in rows:
        if k == "aa":
            want.update(language.grams([t.encode()])[0].tolist())
    for length in (4, 3, 2, 1):
        if length < 4:
            want = Counter(k & ((1 << 16 * length) - 1) for k in want)
        assert {r.gram % 2**64: r.n for r in table if r.length == length} == dict(want)
    model = language.fit(df)
    strange = spark.createDataFrame([(1, "zqxv wkjy qqzx vvkw xjqz " * 8), (2, make("aa"))], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(strange, model).collect()}
    assert got[1].rejected and not got[2].rejected and got[2].lang_pred == "aa"


def test_language_accuracy(spark):
    rng = random.Random(4)
    kinds = {"aa": ["the", "of", "tion", "and", "ing"], "bb": ["der", "und", "schaft", "ung", "ich"], "cc": ["que", "ñor", "los", "ción", "una"]}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(2)) for _ in range(30)), k, "s", 0) for i, k in enumerate(rng.choice(list(kinds)) for _ in range(240))]
    rows += [(900, None, "aa", "s", 0), (901, "12 34 !", "bb", "s", 0), (None, "the and of", None, "s", 0), (902, "", None, "s", 0)]
    df = frame(spark, rows, DOC)
    model = language.fit(df)
    got = {r.doc_id: r for r in language.identify(df.select("doc_id", "text"), model).collect()}
    held = [r for r in rows if r[0] is not None and r[0] < 900 and got[r[0]].held_out]
    assert len(held) > 30 and sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.98 * len(held)
    assert got[900].lang_pred == got[901].lang_pred == got[902].lang_pred == "und" and got[900].score == 0
    assert got[None].held_out is False and got[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = language.fit(df.limit(0))
    assert [r.lang_pred for r in language.identify(df.limit(1), empty).collect()] == ["und"] and language.identify(df.limit(0), model).count() == 0


def test_very_long_texts(spark):
    """Three million characters, with and without blanks, in a row each."""
    rng = random.Random(12)
    texts = [prose(rng, 400_000) + " mit license " + prose(rng, 50_000) + " a.b@c.de", "x" * 3_000_000, "7" * 3_000_000, "1 " * 200_000, "\n" * 2_000_000]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert found[0].first_word == 400_000 and found[0].n_words == 450_006 and found[1].n_words == found[2].n_words == 1 and found[4].n_words == 0
    spans = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert spans[0].n_email == 1 and all(spans[i].n_spans == 0 for i in (1, 2, 4))
    verdicts = {r.doc_id: r.v for r in df.select("doc_id", quality.verdict_column(spark, None).alias("v")).collect()}
    assert verdicts[0].n_words == 450_003 and verdicts[1].word_chars == 3_000_000 and verdicts[3].base_failed and not verdicts[4].kept
    said = {r.doc_id: r for r in language.identify(df, language.fit(df)).collect()}
    assert said[0].lang_pred == "en" and said[2].lang_pred == said[4].lang_pred == "und"
