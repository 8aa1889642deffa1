"""Conversations as formatted training windows of a token budget.

Turns of a conversation are read in order.  Prefix sums of the tokens of their formatted text, with
template and escapes, choose spans of whole turns: a window takes new turns while they and the
retained system turn (the first turn, if its role is ``system``) fit into ``budget``; as many of
the last earlier turns as fit into ``history`` tokens, and into what is left of the budget, are
repeated.  An assistant turn is a target in the window where it is new; where it is repeated as
history the loss mask leaves it out, so every target counts once.  A turn that is larger than the
budget has a window of its own and is never cut; a turn that fits alone, but not beside the system
turn, stands without it (and the system turn then has the first window to itself).

Template: ``<s>``, then per turn ``[INST] role``, newline, text `` [/INST]``, or, for the assistant,
its text and ``</s>``; the system turn's text stands between ``<<SYS>>`` and ``<</SYS>>``.  Control
strings in texts and roles are escaped with a backslash, and `unescape` takes that back.

Windows are made in one pass over rows that are dealt by conversation and sorted by turn; a task
holds one window and the history, never a conversation, whatever its length.

Edge cases: a null text or role is empty; null turns come first and equal turns stand by role and
text; rows without a conversation id are one conversation; repeated rows are turns of their own;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from driftline.llm.common import kept, map_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The strings that the template uses as control.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TO_ESCAPE = re.compile(r"\\|" + "|".join(
    f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
ESCAPED = re.compile(r"\\([\\lbn])")
NAMES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
PLAIN = {"\\": "\\", "l": "<", "b": "[", "n": "\n"}


def escape(text: str) -> str:
    return TO_ESCAPE.sub(lambda m: NAMES[m.group()], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: PLAIN[m.group(1)], text)


def opened(role: str, system: bool) -> tuple[str, str]:
    """What stands before and after the escaped text of a turn."""
    if role == "assistant":
        return "", "</s>"
    name = escape(role).replace("\n", "\\n")
    return (f"[INST] {name}\n<<SYS>>", "<</SYS>> [/INST]") if system else (
        f"[INST] {name}\n", " [/INST]")


def token_counter(path: str) -> Callable[[str], int]:
    """Tokens of a text in a public vocabulary of byte ranks."""
    return kept("token_counter", path, lambda: read_vocabulary(path))


def read_vocabulary(path: str) -> Callable[[str], int]:
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    pattern = (r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(own.encode_ordinary(text))


class Windower:
    """Turns of one conversation after another in, finished windows out."""

    def __init__(self, count: Callable[[str], int], budget: int, history: int) -> None:
        self.count, self.budget, self.history = count, budget, history
        self.start(None)

    def start(self, conversation) -> None:
        self.conversation, self.number, self.turn = conversation, 0, 0
        self.system: tuple | None = None
        self.past: list[tuple] = []  # the last turns that are in windows already
        self.new: list[tuple] = []
        self.sums = [0]  # prefix sums of the tokens of the new turns
        self.room = self.budget - self.count("<s>")  # for turns

    def formatted(self, role: str, text: str, system: bool) -> tuple[str, str, str]:
        before, after = opened(role, system)
        return before, escape(text), after

    def add(self, role: str, text: str) -> Iterator[dict]:
        system = self.turn == 0 and role == "system"
        tokens = self.count("".join(self.formatted(role, text, system)))
        turn = (self.turn, role, text, tokens)
        self.turn += 1
        if system:
            self.system = turn
            return
        if self.new and self.head_tokens() + self.sums[-1] + tokens > self.room:
            yield self.window()
        if self.number == 0 and self.system and self.system[3] + tokens > self.room and not self.new:
            yield self.window()  # the system turn alone
        self.new.append(turn)
        self.sums.append(self.sums[-1] + tokens)

    def head_tokens(self) -> int:
        """Tokens of the system turn, where it stands in the window of the new turns."""
        if not self.system or (self.new and self.system[3] + self.sums[1] > self.room):
            return 0
        return self.system[3]

    def repeated(self, room: int) -> list[tuple]:
        """The longest run of last turns that fits into the room."""
        used, at = 0, len(self.past)
        while at and used + self.past[at - 1][3] <= room:
            at -= 1
            used += self.past[at][3]
        return self.past[at:]

    def window(self) -> dict:
        head = [self.system] if self.head_tokens() else []
        old = self.repeated(min(
            self.history, self.room - self.head_tokens() - self.sums[-1])) if self.new else []
        pieces, mask, at = ["<s>"], [], 3
        for i, (_, role, text, _) in enumerate([*head, *old, *self.new]):
            before, inner, after = self.formatted(role, text, i < len(head))
            if role == "assistant" and i >= len(head) + len(old):
                mask.append({"start": at, "end": at + len(inner)})
            pieces += [before, inner, after]
            at += len(before) + len(inner) + len(after)
        first = self.new[0][0] if self.new else self.turn
        out = {"conv_id": self.conversation, "window": self.number, "first_turn": first,
               "with_system": bool(head), "n_repeated": len(old), "n_new": len(self.new),
               "text": "".join(pieces), "mask": mask}
        self.number += 1
        self.past = [*self.past, *self.new]
        self.past = self.repeated(self.history)
        self.new, self.sums = [], [0]
        return out

    def finish(self) -> Iterator[dict]:
        if self.new or (self.system and not self.number):
            yield self.window()


def chat_windows(turns: DataFrame, budget: int = 1024, history: int = 256,
                 vocabulary: str = VOCABULARY,
                 counter: Callable[[str], Callable[[str], int]] = token_counter) -> DataFrame:
    """One row per window, all windows of a conversation in order in one partition.

    ``mask`` holds the code point ranges of ``text`` that count for the loss.
    """
    def scan(batches: Iterator) -> Iterator[dict]:
        maker, begun = Windower(counter(vocabulary), budget, history), False
        names = ("conv_id", "window", "first_turn", "with_system", "n_repeated", "n_new",
                 "text", "mask")
        for conversations, roles, texts in batches:
            done: list[dict] = []
            for conversation, role, text in zip(conversations, roles, texts):
                if not begun or conversation != maker.conversation:
                    done += maker.finish() if begun else []
                    maker.start(conversation)
                    begun = True
                done += maker.add(role or "", text or "")
            yield {n: [w[n] for w in done] for n in names}
        done = list(maker.finish()) if begun else []
        yield {n: [w[n] for w in done] for n in names}

    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id")
    return map_batches(
        rows.sortWithinPartitions("conv_id", "turn", "role", "text"), ["conv_id", "role", "text"],
        scan, f"conv_id {kind}, window bigint, first_turn bigint, with_system boolean, "
        "n_repeated bigint, n_new bigint, text string, "
        "mask array<struct<start: bigint, end: bigint>>")


def read_window(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted window."""
    turns, at = [], len("<s>")
    while at < len(text):
        if not text.startswith("[INST] ", at):
            end = text.index("</s>", at)
            turns.append(("assistant", unescape(text[at:end])))
            at = end + len("</s>")
            continue
        line = text.index("\n", at)
        role = unescape(text[at + len("[INST] "):line])
        end = text.index(" [/INST]", line + 1)
        inner = text[line + 1:end]
        if inner.startswith("<<SYS>>"):
            inner = inner[len("<<SYS>>"):-len("<</SYS>>")]
        turns.append((role, unescape(inner)))
        at = end + len(" [/INST]")
    return turns


def read_back(windows: DataFrame) -> DataFrame:
    """Digests per conversation of what its windows say; windows are parsed, not remembered."""
    def scan(batches: Iterator) -> Iterator[dict]:
        state: dict | None = None

        def closed() -> list[dict]:
            return [] if state is None else [{
                **state, "turns_sha256": state["turns_sha256"].hexdigest(),
                "loss_sha256": state["loss_sha256"].hexdigest()}]

        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                 "formatted_chars", "n_windows")
        for rows in batches:
            done: list[dict] = []
            for conversation, number, system, repeated, text, mask in zip(*rows):
                if number == 0:
                    done += closed()
                    state = {"conv_id": conversation, "n_turns": 0, "loss_chars": 0,
                             "formatted_chars": 0, "n_windows": 0,
                             "turns_sha256": hashlib.sha256(), "loss_sha256": hashlib.sha256()}
                turns = read_window(text)
                for role, said in turns[repeated + system if number else 0:]:
                    state["n_turns"] += 1
                    state["turns_sha256"].update(
                        f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in mask:
                    said = unescape(text[span["start"]:span["end"]])
                    state["loss_chars"] += len(said)
                    state["loss_sha256"].update(said.encode("utf-8", "surrogatepass"))
                state["formatted_chars"] += len(text)
                state["n_windows"] += 1
            yield {n: [w[n] for w in done] for n in names}
        yield {n: [w[n] for w in closed()] for n in names}

    kind = windows.schema["conv_id"].dataType.simpleString()
    return map_batches(
        windows, ["conv_id", "window", "with_system", "n_repeated", "text", "mask"], scan,
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint, n_windows bigint")
