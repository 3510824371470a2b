import random

from cuegrid.llm import pii
from tests.llm.helpers import prose


def luhn_card(rng):
    body = [rng.randrange(10) for _ in range(15)]
    check = -sum(x if i % 2 else sum(divmod(2 * x, 10)) for i, x in enumerate(body)) % 10
    digits = "".join(map(str, [*body, check]))
    return " ".join(digits[i : i + 4] for i in range(0, 16, 4))


def candidates(text):
    return {(text[a:b], tuple(like)) for kind, like, _, a, b, _ in pii.mentions(text, pii.base_spans(text)) if kind is None}


def test_unseen_forms_are_found_whole(spark):
    rng = random.Random(3)
    rows = [(i, f"{prose(rng, 4)} please call me +1 (017) 555-{i:04d} thanks {prose(rng, 3)}") for i in range(20)]
    rows += [(100 + i, f"{prose(rng, 4)} write to me {prose(rng, 1)}{i}@mail.example today {prose(rng, 3)}") for i in range(20)]
    rows += [(200 + i, f"{prose(rng, 4)} pay with card {luhn_card(rng)} please {prose(rng, 3)}") for i in range(20)]
    unseen = {
        300: ("phone", "(017) 555-7713", "please call me {} thanks"),
        301: ("email", "jane(at)mail.example", "write to me {} today"),
        302: ("email", "jane [at] mail.example", "write to me {} today"),
        303: ("card", "1234 5678 9012 3456", "pay with card {} please"),
        304: ("phone", "555 010 7713", "room 12 (please call me {}) thanks"),
    }
    rows += [(i, f"{prose(rng, 3)} {around.format(value)} {prose(rng, 3)}") for i, (_, value, around) in unseen.items()]
    texts = dict(rows)
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (kind, value, _) in unseen.items():
        start = texts[i].index(value)
        assert got[i].spans == f"context_{kind}:{start}:{start + len(value)}", (i, got[i].spans)


def test_candidates_by_shape():
    assert ("(017) 555-7713", ("phone",)) in candidates("you may call (017) 555-7713, they said")
    assert ("5550100001", ("phone",)) in candidates("it has 12 5550100001 people")
    assert ("1234 5678 9012 3456", ("card",)) in candidates("the card 1234 5678 9012 3456 expired")
    assert ("jane(at)mail.example", ("email",)) in candidates("ask them, jane(at)mail.example, for it")
    assert candidates("ask 5550100001(at)mail.example for it") == {("5550100001(at)mail.example", ("email",))}
    assert candidates("a1234567890b and 1,2345678 and x.12345678,9") == set()
    assert candidates("no numbers here") == set()


def test_candidates_take_linear_time():
    for text in ("1 - " * 50_000, "(" * 200_000, "7" * 200_000, "1 " * 50_000, "@" * 200_000, "(at)" * 50_000, "a" * 200_000 + " (at) b.c", "1 " + "." * 200_000):
        pii.mentions(text, pii.base_spans(text))
