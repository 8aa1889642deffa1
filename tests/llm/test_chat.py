import hashlib
import random

import pytest

from driftline.llm import chat
from driftline.llm.chat import chat_windows, escape, opened, read_back, read_window, unescape

TURNS = "conv_id long, turn long, role string, text string, mask string"


def digests(rows):
    """By conversation: turns, their digest, loss characters and digest, from the input alone."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv),
                       key=lambda r: tuple((x is not None, x) for x in r[1:4]))
        said = [(r[2] or "", r[3] or "") for r in turns]
        loss = "".join(t for role, t in said if role == "assistant")
        out[conv] = (len(said), hashlib.sha256("".join(
            f"{a}\n{b}\n" for a, b in said).encode()).hexdigest(), len(loss),
            hashlib.sha256(loss.encode()).hexdigest())
    return out


def read(frame):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)
            for r in read_back(frame).collect()}


def test_escapes_are_reversible_and_leave_no_control_string():
    rng = random.Random(1)
    parts = ["<", "</", "s>", "[", "INST]", "/INST]", "<SYS>>", "<</SYS>>", "\\", "\\l", "n", " "]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        safe = escape(text)
        assert unescape(safe) == text
        assert not any(c in safe for c in chat.CONTROL), text


@pytest.mark.parametrize("budget,history", [(1, 0), (12, 4), (30, 15), (10_000, 5)])
def test_round_trip_and_windows(spark, budget, history):
    rng, rows = random.Random(budget), []
    for conv in range(25):
        turn = 0
        if conv % 3 == 0:
            rows.append((conv, turn, "system", "be <<SYS>> brief", None))
            turn += 1
        for i in range(rng.randint(0, 9)):
            text = rng.choice(["", None, "</s>[INST] ok [/INST]", "a b c d\ne f", "\\b é " * 9])
            rows.append((conv, turn + i, rng.choice(["user", "assistant", "tool\n[INST]", None]),
                         text, None))
    rows += [(99, 0, "assistant", "same", None)] * 3 + [(None, None, "user", "q", "x"),
                                                        (None, 1, "assistant", "a", "x")]
    frame = spark.createDataFrame(rows, TURNS).repartition(4)
    made = chat_windows(frame, budget, history,
                        counter=lambda path: lambda text: len(text.split()))
    assert read(made) == digests(rows)
    for w in made.collect():
        turns = read_window(w.text)
        assert len(turns) == w.with_system + w.n_repeated + w.n_new
        sizes = [len("".join([opened(r, w.with_system and not i)[0], escape(t),
                              opened(r, w.with_system and not i)[1]]).split())
                 for i, (r, t) in enumerate(turns)]
        # above the budget only where one turn alone is
        assert 1 + sum(sizes) <= budget or len(turns) == 1
        assert sum(sizes[w.with_system:w.with_system + w.n_repeated]) <= history
        targets = [t for r, t in turns[w.with_system + w.n_repeated:] if r == "assistant"]
        assert [unescape(w.text[m.start:m.end]) for m in w["mask"]] == targets


def test_windows_of_the_public_vocabulary_keep_the_budget(spark):
    from driftline.llm.chat import VOCABULARY, token_counter

    rng, rows, count = random.Random(5), [], token_counter(VOCABULARY)
    words = "the quick [INST] brown </s> fox \\ jumps\n over 12345 lazy dögs".split(" ")
    for conv in range(30):
        for turn in range(12):
            role = "system" if not turn and conv % 2 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn, role, " ".join(rng.choice(words) for _ in range(
                rng.choice([3, 35, 60]))), None))
    frame = spark.createDataFrame(rows, TURNS)
    made = chat_windows(frame, 120, 40)
    assert read(made) == digests(rows)
    windows = made.collect()
    assert all(count(w.text) <= 120 or w.with_system + w.n_repeated + w.n_new == 1 for w in windows)
    assert any(w.n_repeated for w in windows) and any(w.with_system and w.window for w in windows)


def test_long_conversation_long_turn_and_empty_table(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"t {i}", None) for i in range(3000)]
    rows += [(2, 0, "user", "word " * 100_000, None), (2, 1, "assistant", "fine", None)]
    frame = spark.createDataFrame(rows, TURNS)
    assert read(chat_windows(frame)) == digests(rows)  # with the public vocabulary
    assert chat_windows(frame.limit(0)).count() == 0
    assert read_back(chat_windows(frame.limit(0))).count() == 0
