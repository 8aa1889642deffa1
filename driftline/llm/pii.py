"""Personal data in whole texts by anchor expansion.

One Aho-Corasick pass over a text reports anchors: at-signs, plus signs, digits, schemes and
account cues.  Each anchor is expanded to the left and right by a local parser of its kind and
the found span is validated; text without anchors costs one automaton pass only.

Kinds, in output order: ``email``, ``ip``, ``card``, ``phone`` (the base kinds) and ``url``,
``account`` (the spans that schemes and cues add).  Spans of one kind never overlap: an anchor
inside an earlier span of its kind is skipped, and a span that fails validation is consumed
without a retry at a later start.

Edge cases: a null text counts as empty; an empty text has no spans; extra columns are ignored;
repeated rows give repeated results; an empty table gives an empty table.  A text is scanned
once from left to right whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from driftline.llm.common import map_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("url", "account")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("account", "acct", "iban", "routing", "passport", "ssn")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN_TAIL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
DIGIT_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ADDRESS = re.compile(r"[^\s<>\"'`{}|\\^]+")
HOST = re.compile(r"(?:[^/@]*@)?(?:[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)(?::[0-9]+)?(?=[/?#]|$)")
IDENTIFIER = re.compile(
    r"(?: (?:number|no\.?|id|code))?[ ]?[:#=]?[ ]?"
    r"([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?|[0-9](?:[ -]?[0-9])+)",
    re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) << (place & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def iban(value: str) -> bool:
    compact = value.replace(" ", "").upper()
    turned = compact[4:] + compact[:4]
    return len(compact) >= 15 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


class Parser:
    """Expands the anchors of one text; ``ends`` holds where the last span of a kind ended."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.ends = dict.fromkeys(KINDS, 0)
        self.found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}

    def take(self, kind: str, start: int, end: int, valid: bool) -> None:
        self.ends[kind] = end
        if valid:
            self.found[kind].append((start, end))

    def at_sign(self, at: int) -> None:
        text, floor = self.text, self.ends["email"]
        tail = DOMAIN_TAIL.match(text, at + 1)
        if tail is None or at < floor:
            return
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            self.take("email", start, tail.end(), True)

    def digit(self, at: int) -> None:
        text = self.text
        if at >= self.ends["card"]:
            chain = DIGIT_CHAIN.match(text, at)
            if chain:
                digits = only_digits(chain.group())
                self.take("card", at, chain.end(), 13 <= len(digits) <= 19 and luhn(digits))
            else:
                self.ends["card"] = at + 1
        if at >= self.ends["ip"]:
            quad = QUAD.match(text, at)
            if quad:
                parts = quad.group().split(".")
                small = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
                            for p in parts)
                self.take("ip", at, quad.end(), small)
            else:  # no later start in this run of digits can match either
                end = at + 1
                while end < len(text) and "0" <= text[end] <= "9":
                    end += 1
                self.ends["ip"] = end

    def plus(self, at: int) -> None:
        if at >= self.ends["phone"]:
            number = DIALLED.match(self.text, at)
            if number:
                self.take("phone", at, number.end(), 9 <= len(only_digits(number.group())) <= 15)

    def scheme(self, end: int, word: str) -> None:
        start = end - len(word)
        if start < self.ends["url"] or (start and self.text[start - 1].isalnum()):
            return
        rest = ADDRESS.match(self.text, end)
        if rest:
            body = rest.group().rstrip(".,;:!?)]")
            self.take("url", start, end + len(body), HOST.match(body) is not None)

    def cue(self, end: int, word: str) -> None:
        start = end - len(word)
        if start < self.ends["account"] or (start and self.text[start - 1].isalnum()):
            return
        value = IDENTIFIER.match(self.text, end)
        if value:
            number = value.group(1)
            valid = iban(number) if number[0].isalpha() else 6 <= len(only_digits(number)) <= 18
            self.take("account", value.start(1), value.end(1), valid)


def anchor_automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    automaton.add_word("@", ("at", "@"))
    automaton.add_word("+", ("plus", "+"))
    for digit in "0123456789":
        automaton.add_word(digit, ("digit", digit))
    for word in SCHEMES:
        automaton.add_word(word, ("scheme", word))
    for word in CUES:
        for form in {word, word.upper(), word.capitalize()}:
            automaton.add_word(form, ("cue", word))
    automaton.make_automaton()
    return automaton


def find_spans(text: str | None, automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, ordered by start, as code point offsets with exclusive ends."""
    parser = Parser(text or "")
    for last, (what, word) in automaton.iter(parser.text):
        if what == "digit":
            parser.digit(last)
        elif what == "at":
            parser.at_sign(last)
        elif what == "plus":
            parser.plus(last)
        elif what == "scheme":
            parser.scheme(last + 1, word)
        else:
            parser.cue(last + 1, word)
    return parser.found


def spelled(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in kinds for start, end in found[kind])


def personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  automaton: Callable = anchor_automaton) -> DataFrame:
    """One row per document: its id and an array of (kind, start, end) of all spans."""

    def scan(batches):
        machine = automaton()
        for ids, texts in batches:
            spans = [find_spans(text, machine) for text in texts]
            yield {"doc_id": ids, "spans": [
                [{"kind": kind, "start": a, "end": b} for kind in KINDS for a, b in s[kind]]
                for s in spans]}

    key = docs.schema[id_column].dataType.simpleString()
    return map_batches(
        docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")),
        ["doc_id", "text"], scan,
        f"doc_id {key}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def span_digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans and the list of all spans."""
    def of_kind(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def joined(*kinds):
        return F.array_join(F.transform(of_kind(*kinds), lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *[F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(joined(*BASE_KINDS), 256).alias("base_sha256"),
        joined(*KINDS).alias("spans"))
