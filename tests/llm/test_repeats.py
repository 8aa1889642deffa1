import hashlib
import random

import numpy as np
import pytest

from driftline.llm import repeats, suffixes

DDL = "text string, doc_id long, spans string, block int, n_bytes string"


def removed(rows, width=50):
    """Per row (id, bytes): which bytes go, by a table of all strings."""
    first = {}
    order = [(i is not None, i or 0) for i, _ in rows]
    for key, (_, text) in zip(order, rows):
        for at in range(len(text) - width + 1):
            string = text[at:at + width]
            first[string] = min(first.get(string, key), key)
    out = []
    for key, (_, text) in zip(order, rows):
        gone = bytearray(len(text))
        for at in range(len(text) - width + 1):
            if first[text[at:at + width]] < key:
                gone[at:at + width] = b"\1" * width
        out.append(gone)
    return out


def brute_force(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    out = []
    for (i, text), gone in zip(data, removed(data)):
        kept = bytes(c for c, g in zip(text, gone) if not g)
        spans = sum(g and not b for g, b in zip(gone, [0, *gone]))
        out.append((i, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **how):
    docs = spark.createDataFrame([(t, i, "x", 1, "y") for i, t in rows], DDL)
    got = repeats.repeat_digest(repeats.repeated_passages(docs, **how))
    return sorted((tuple(r) for r in got.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def made_rows(seed, count):
    draw = random.Random(seed)
    words = ["lorem", "ipsum", "dolor", "ä", "漢字", "sit\0", "  ", "amet.", "x" * 30]
    passages = [" ".join(draw.choice(words) for _ in range(draw.randint(5, 60)))
                for _ in range(12)]
    rows = []
    for i in range(count):
        parts = [draw.choice(passages) if draw.random() < .5 else
                 " ".join(draw.choice(words) + str(draw.random())[:draw.randint(2, 9)]
                          for _ in range(draw.randint(1, 30))) for _ in range(draw.randint(0, 4))]
        rows.append((draw.choice([i, i, i, 7, None]), draw.choice(["", "\n"]).join(parts)))
    hot = "one passage that a third of all documents hold, word by word, until it ends. " * 3
    rows += [(1000 + i, hot if i % 2 else f"{i} {hot} {i}") for i in range(count // 2)]
    rows += [(5000, None), (5001, ""), (5002, "short"), (3, hot[:49]), (4, hot[:50])]
    rows += [(8, "over and over, the same line of a document. " * 40), (9000, "=" * 60),
             (7000, "before " + "over and over, the same line of a document. " * 9 + "after")]
    rows += [(6000, "=" * 3000), (6001, "a" + "=" * 200), (6001, "a" + "=" * 200), (6002, "ab" * 90)]
    return rows


@pytest.mark.parametrize("how", [{}, {"block_bytes": 3000, "part_bytes": 2000},
                                 {"block_bytes": 900, "part_bytes": 5000, "fan": 3}])
def test_equals_a_table_of_all_strings(spark, how):
    rows = made_rows(len(how), 120)
    assert found(spark, rows, **how) == brute_force(rows)


def test_very_long_texts_and_empty_table(spark):
    draw = random.Random(1)
    long = "".join(draw.choice("abcdef ") for _ in range(60000))
    rows = [(1, long + "-" * 60000), (2, long[100:40000] + "+" + long[:70]), (3, "-" * 55)]
    assert found(spark, rows, block_bytes=20000) == brute_force(rows)
    assert found(spark, []) == []


def test_spans_and_kept_text(spark):
    docs = spark.createDataFrame([("A" + "z" * 50 + "B", 2), ("z" * 60, 1)], "text string, doc_id long")
    rows = {r.doc_id: r for r in repeats.repeated_passages(docs).collect()}
    assert [tuple(s) for s in rows[2].spans] == [(1, 51)] and bytes(rows[2].kept) == b"AB"
    assert rows[1].spans == [] and bytes(rows[1].kept) == b"z" * 60


def test_suffix_sort_of_random_texts():
    for seed in range(60):
        draw = random.Random(seed)
        letters = draw.choice([b"ab", b"a\0b", b"abcdefgh ", bytes(range(256)), b"a"])
        width = draw.choice([3, 9, 20, 50])
        base = bytes(draw.choice(letters) for _ in range(300))
        texts = [base[(a := draw.randint(0, 250)):a + draw.randint(0, 150)] + base[:draw.randint(0, 90)]
                 + bytes([draw.choice(letters)]) * draw.randint(0, 90)
                 for _ in range(draw.randint(1, 12))]
        ids = [draw.randint(0, 6) for _ in texts]
        raw = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).copy()
        ends = np.cumsum([len(t) + 1 for t in texts])
        starts = [int(e) - len(t) - 1 for e, t in zip(ends, texts)]
        wanted = [s + at for s, t in zip(starts, texts) for at in range(len(t) - width + 1)]
        doc = [i for i, t in zip(ids, texts) for _ in range(len(t) - width + 1)]
        least = {}
        for at, i in zip(wanted, doc):
            string = raw[at:at + width].tobytes()
            least[string] = min(least.get(string, i), i)
        got, first = suffixes.seen_earlier(raw, ends - 1, np.array(wanted, np.int64),
                                           np.array(doc, np.int64), width)
        string = [raw[at:at + width].tobytes() for at in wanted]
        assert first.tolist() == [min(j for j, s in enumerate(string) if s == own and doc[j] == least[own])
                                  for own in string], seed
        assert got.tolist() == [i > least[raw[at:at + width].tobytes()]
                                for at, i in zip(wanted, doc)], seed
