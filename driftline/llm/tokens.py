"""Token counts of whole texts by a linear longest-match automaton.

The vocabulary of word pieces becomes a trie.  Each state has a failure link to the state that
remains after the longest pieces of its string have been taken off, and the number of pieces
taken off on the way.  Reading a word follows goto links, and failure links where there is none,
adding up those numbers: greedy longest-match counts in time linear in the word, without
building the pieces.

Words are runs of characters that are not white space; a word is read with a mark in front, which
is a character like any other: pieces may begin with it, and the bare mark is a piece after which
the word is continued.  A character that no piece covers counts as its byte pieces (one per byte
of its UTF-8 form); without byte pieces, its word is one unknown token.  Counts of words that
repeat are kept in a cache of bounded size.

Edge cases: a null or wordless text has no tokens; a word of any length is read in linear time; an
empty vocabulary makes every word unknown; extra columns are ignored; repeated rows give repeated
results; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F

from driftline.llm.common import kept, map_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose counts a task remembers.
CACHED_WORDS = 500_000


def byte_length(character: str) -> int:
    return len(character.encode("utf-8", "surrogatepass"))


class LongestMatch:
    """Trie over pieces; ``fail[s]`` and ``popped[s]`` as described above (-1: no match).

    ``mark`` is put in front of every word.  With ``spelled``, a character that no piece covers
    counts as its bytes.
    """

    def __init__(self, starts: Iterable[str], continuations: Iterable[str], mark: str = "",
                 spelled: bool = False) -> None:
        self.mark, self.spelled = mark, spelled
        self.goto: list[dict[str, int]] = [{}, {}]  # state 0: word start, state 1: inside
        self.fail, self.popped, self.ends = [-1, -1], [0, 0], [0, 0]  # ends: tokens of the piece
        for root, pieces in ((0, starts), (1, continuations)):
            pieces = [p for p in pieces if p]
            for piece in pieces:
                self.insert(root, piece, 1)
            if spelled:
                for character in set(mark).union(*pieces):
                    if not self.ends[self.goto[root].get(character, 0)]:
                        self.insert(root, character, byte_length(character))
        self.link()

    def insert(self, state: int, piece: str, tokens: int) -> None:
        for character in piece:
            following = self.goto[state].get(character)
            if following is None:
                following = self.goto[state][character] = len(self.goto)
                self.goto.append({})
                self.fail.append(-1)
                self.popped.append(0)
                self.ends.append(0)
            state = following
        self.ends[state] = tokens

    def link(self) -> None:
        queue = deque([0, 1])
        while queue:
            state = queue.popleft()
            for character, following in self.goto[state].items():
                if self.ends[following]:
                    self.fail[following], self.popped[following] = 1, self.ends[following]
                else:
                    back, taken = self.fail[state], self.popped[state]
                    while back >= 0 and character not in self.goto[back]:
                        taken += self.popped[back]
                        back = self.fail[back]
                    if back >= 0:
                        self.fail[following] = self.goto[back][character]
                        self.popped[following] = taken
                queue.append(following)

    def count(self, word: str) -> int:
        """Pieces of a word by greedy longest match; 0 if they do not cover it."""
        goto, fail, popped = self.goto, self.fail, self.popped
        state = total = 0
        for character in self.mark + word:
            while character not in goto[state]:
                if state == 1 and self.spelled:
                    total += byte_length(character)
                    break
                total += popped[state]
                state = fail[state]
                if state < 0:
                    return 0
            else:
                state = goto[state][character]
        while state != 1:
            total += popped[state]
            state = fail[state]
            if state < 0:
                return 0
        return total


def automaton(path: str, mark: str = "▁") -> LongestMatch:
    """Automaton over the pieces of a public vocabulary file; control pieces are left out."""
    return kept("automaton", (path, mark), lambda: read_automaton(path, mark))


def read_automaton(path: str, mark: str) -> LongestMatch:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in ids if not (
        model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return LongestMatch([p for p in pieces if p.startswith(mark)], pieces, mark,
                        sum(map(model.is_byte, ids)) == 256)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, build=automaton,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown (words that count as one unknown token each)."""
    def scan(batches: Iterator) -> Iterator[dict]:
        machine, known = build(vocabulary), {}
        for ids, texts in batches:
            rows = []
            for text in texts:
                words = tokens = unknown = 0
                for word, times in Counter((text or "").split()).items():
                    n = known.get(word)
                    if n is None:
                        if len(known) >= CACHED_WORDS:
                            known.clear()
                        n = machine.count(word)
                        if len(word) < 64:
                            known[word] = n
                    words += times
                    tokens += (n or 1) * times
                    unknown += times * (not n)
                rows.append((words, tokens, unknown))
            yield {"doc_id": ids, "n_words": [r[0] for r in rows],
                   "n_tokens": [r[1] for r in rows], "n_unknown": [r[2] for r in rows]}

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(docs.select(F.col(id_column).alias("doc_id"),
                                   F.col(text_column).alias("text")),
                       ["doc_id", "text"], scan,
                       f"doc_id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint")
