import hashlib
import random
import re

import pytest

from driftline.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn_slow(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0


def brute(text):
    text = text or ""
    count = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text)
               if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text)
                 if 13 <= len(count(m.group())) <= 19 and luhn_slow(count(m.group()))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(count(m.group())) <= 15]}


def test_base_spans_equal_the_patterns_on_random_text():
    machine, rng = pii.anchor_automaton(), random.Random(7)
    for alphabet in ("a1@. -", "0123. -+()", "49.+@a-", "é1@b.c%+ \n", "01 -"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 45)))
            found = pii.find_spans(text, machine)
            assert {k: found[k] for k in pii.BASE_KINDS} == brute(text), text


@pytest.mark.parametrize("text,kind,values", [
    ("mail jo.e+x@mail-7.example.co.uk now", "email", ["jo.e+x@mail-7.example.co.uk"]),
    ("a@b@c.d", "email", ["b@c.d"]),
    ("1.2.3.4.5.6.7.8 and 256.1.1.1", "ip", ["1.2.3.4", "5.6.7.8"]),
    ("pay 4111 1111-1111 1111.", "card", ["4111 1111-1111 1111"]),
    ("pay 4111 1111 1111 1112.", "card", []),
    ("call +1 (555) 010-9999!", "phone", ["+1 (555) 010-9999"]),
    ("see https://a.example/x?y=1, ok", "url", ["https://a.example/x?y=1"]),
    ("IBAN: GB82 WEST 1234 5698 7654 32.", "account", ["GB82 WEST 1234 5698 7654 32"]),
    ("IBAN: GB82 WEST 1234 5698 7654 33.", "account", []),
    ("account number: 12-345-678", "account", ["12-345-678"]),
])
def test_spans(text, kind, values):
    found = pii.find_spans(text, pii.anchor_automaton())[kind]
    assert [text[a:b] for a, b in found] == values


def test_query_on_nulls_empty_long_and_repeated_texts(spark):
    long = "word " * 200_000 + "z@y.xx " + "7" * 100_000
    texts = [(1, None, "x"), (2, "", "x"), (3, long, None), (4, "t@u.vw", "x"), (4, "t@u.vw", "x"),
             (None, "\U0001F600 t@u.vw", "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, spans string")
    rows = sorted(map(tuple, pii.span_digest(pii.personal_data(docs)).collect()), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    one = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert rows == sorted([
        (1, 0, 0, 0, 0, empty, ""), (2, 0, 0, 0, 0, empty, ""),
        (3, 1, 0, 0, 0, one("email:1000000:1000006"), "email:1000000:1000006"),
        (4, 1, 0, 0, 0, one("email:0:6"), "email:0:6"),
        (4, 1, 0, 0, 0, one("email:0:6"), "email:0:6"),
        (None, 1, 0, 0, 0, one("email:2:8"), "email:2:8")], key=str)
    assert pii.span_digest(pii.personal_data(docs.limit(0))).count() == 0
