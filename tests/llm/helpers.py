"""Small tables with every awkward case."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ba", "ko", "mi", "zu", "ter", "lan") for b in ("no", "ri", "se", "ta", "ul", "")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(seed: int = 1):
    """Originals, exact and near copies, repeated lines, nulls, blanks, ties and repeated rows."""
    rng = random.Random(seed)
    texts: list[str | None] = []
    for _ in range(12):
        base = prose(rng, rng.randint(30, 90)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS) + "x"
            texts.append(" ".join(copy))
    line = prose(rng, 14)
    texts += [prose(rng, 20) + "\n" + line + "\n" + prose(rng, 3) for _ in range(5)]
    texts += [line.replace(" ", "  ", 1) + "\n" + line, None, "", " \t\n ", "one two three", "one two three", "ONE two three", "x" * 3000, "été là " * 30]
    rng.shuffle(texts)
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, "a text without any id at all", "en", "s1", 28), (None, None, None, None, None)]


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def blank_split(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
