import hashlib
import heapq
import random
import zlib

import pytest

from driftline.llm import repair

DDL = "text string, role string, turn long, conv_id long, audit string, at int"
SPACE = " \t\n\x0b\x0c\r"
#: state -> symbol -> state; states: nothing yet, after s, after u, after a
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def cheapest(rows):
    """rows: (initial, dead, cut); least (cost, audit) by best-first search over all edits."""
    heap, closed = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit
        # audits that end with an insertion are never closed, so no tie is cut off
        if not audit.endswith("I"):
            if (i, state) in closed:
                continue
            closed.add((i, state))
        if audit.endswith("III"):
            continue
        if i < len(rows):
            initial, dead, cut = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            for symbol, after in {} if dead else GRAMMAR[state].items():
                if symbol == initial:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, after))
                if symbol in "ua":
                    heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, after))
        for symbol, after in GRAMMAR[state].items():
            if symbol in "ua":
                heapq.heappush(heap, (cost + 2, audit + "I", i, after))


def chained(rows, block):
    chain = repair.Chain()
    for low in range(0, len(rows), block):
        chain.add(repair.block_repairs(*map(list, zip(*rows[low:low + block]))))
    return chain.finish()


@pytest.mark.parametrize("seed", range(6))
def test_audits_equal_exhaustive_search(seed):
    draw = random.Random(seed)
    for _ in range(150):
        rows = [(draw.choice("uuuaaas t"), draw.random() < .15, draw.random() < .2)
                for _ in range(draw.randint(0, 13))]
        want = cheapest(rows)
        for block in (1, 2, 5, 32):
            assert chained(rows, block) == want, (rows, block)


def test_long_conversation_equals_search():
    draw = random.Random(7)
    rows = [("ua"[i % 2] if draw.random() < .9 else draw.choice("sua"), draw.random() < .05,
             draw.random() < .05) for i in range(400)]
    want = cheapest(rows)
    assert all(chained(rows, block) == want for block in (7, 32, 400))


def brute_force(turns):
    """Rows of (conv_id, turn, role, text) after the rule of damage, one conversation at a time."""
    out = []
    for conversation in {t[0] for t in turns}:
        rows = []
        for conv, turn, role, text in turns:
            if conv != conversation:
                continue
            key = ":".join(" " if v is None else str(v) for v in (conv, turn))
            mark = zlib.crc32(key.encode()) % 20
            role, text = role if role is not None else " ", text if text is not None else " "
            text = "" if mark == 1 else "".join(
                c for c in text if c not in ".!?") if mark == 2 else text
            role = "user" if mark == 4 else role
            rows += [(turn, role, text)] * {0: 0, 3: 2}.get(mark, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        known, marked = set(), []
        for _, role, text in rows:
            blank = not text.strip(SPACE)
            again = not blank and (role, text) in known
            known.add((role, text))
            marked.append((blank, again, not blank and not again
                           and text.rstrip(SPACE)[-1] not in ".!?"))
        numbers = [r[0] for r in rows if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = cheapest([(r[1][:1], m[0] or m[1], m[2]) for r, m in zip(rows, marked)])
        lines, last, at = [], "", 0
        for letter in audit:
            symbol = "a" if last == "u" else "u"
            name = {"a": "assistant", "u": "user"}[symbol]
            row = rows[at] if letter != "I" else None
            at += letter != "I"
            if letter == "D":
                continue
            if letter == "K":
                name, symbol = row[1], row[1][:1]
            lines.append(f"{name}:{row[2] if row else ''}")
            last = symbol
        out.append((conversation, gaps, *(sum(m[i] for m in marked) for i in range(3)), illegal,
                    cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, turns):
    frame = spark.createDataFrame([(x, r, t, c, None, 1) for c, t, r, x in turns], DDL)
    return sorted((tuple(r) for r in repair.repair_of_damage(frame).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        "repaired_sha256").collect()), key=repr)


def test_digests_equal_brute_force(spark):
    draw = random.Random(3)
    turns = []
    for conv in (*range(60), None):
        n = 700 if conv == 5 else draw.randint(0, 12)
        for turn in range(n):
            if draw.random() < .05:
                continue
            text = draw.choice(["Yes.", "No!", "cut", " \x0b", "", None, "Ünï. \n", f"t{turn}?"])
            role = draw.choice([None, "tool", "system", ""]) if draw.random() < .1 else (
                "user", "assistant")[turn % 2]
            turns.append((conv, None if draw.random() < .02 else turn * 2 - 3, role, text))
    turns.append((999, 4, "user", "long. " * 50000))
    # rows without a turn share a place: one each, so that their order is fixed
    seen, kept = set(), []
    for t in turns:
        if t[1] is None and t[0] in seen:
            continue
        seen |= {t[0]} if t[1] is None else set()
        kept.append(t)
    assert found(spark, kept) == brute_force(kept)


def test_repeated_rows_and_empty_table(spark):
    turns = [(1, 1, "user", "Hi.")] * 300 + [(1, 2, "assistant", "Yes.")]
    assert found(spark, turns) == brute_force(turns)
    assert found(spark, []) == []
