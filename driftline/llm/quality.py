"""Quality of whole texts by a regularised quadratic discriminant.

Every text becomes a vector of transformed statistics (lengths, shares of character kinds, word
shapes, repetition of words, lines and phrases).  Per class, the mean and covariance are built
from sums that Spark adds up over all labelled rows of the fit; covariances shrink towards the
pooled one and a diagonal.  The score is the logistic of the difference of the Gaussian
log-densities, by Mahalanobis distances with Cholesky factors that are computed once.

Edge cases: a null text counts as empty and gets the score of the all-zero statistics; labels that
are null or neither 0 nor 1 teach nothing; without rows of both classes every score is 0.5;
repeated rows give repeated results; a label row counts once per document row of its id; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from driftline.llm.common import Scratch, held_out, kept, map_batches

FEATURES = (
    "repeated_words", "top_word", "runs", "repeated_pairs", "repeated_fives", "repeated_lines",
    "upper_letters", "upper_words", "digits", "letters", "word_rate", "stops", "inner_marks",
    "edge_marks", "odd_marks", "marked_words", "short_words", "characters", "words",
    "word_length", "word_spread", "lines", "line_words", "distinct_characters",
    "sentence_words")
PLAIN_MARKS = ".,;:!?'\"()-"
UPPER, LETTER, DIGIT, SPACE, PLAIN, ODD = range(6)
ODD_MARK = re.compile(r"[^\w\s.,;:'\"()-]")


def kind_of(character: str) -> int:
    if character.isalpha():
        return UPPER if character.isupper() else LETTER
    if character.isdigit():
        return DIGIT
    if character.isspace():
        return SPACE
    return PLAIN if character in PLAIN_MARKS else ODD


def kinds() -> np.ndarray:
    """Kind of every code point of the basic plane; all above count with the last."""
    return kept("kinds", None, lambda: np.array(
        [kind_of(chr(i)) for i in range(0x10000)], np.uint8))


def share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def repeated(items: list) -> float:
    """Share of the items that stood earlier in the list."""
    return 1 - share(len(set(items)), len(items)) if items else 0.0


def statistics(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    lines = [line for line in text.split("\n") if line.strip()]
    n, size = len(words), len(text)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.bincount(kinds()[np.minimum(points, 0xFFFF)], minlength=6)
    letters = int(kind[UPPER] + kind[LETTER])
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    upper = edge = inner = marked = 0
    for word, times in counts.items():
        if word.isupper():
            upper += times
        if not word.isalnum():
            last = not word[-1].isalnum()
            edge += last * times
            inner += (not last) * times
            marked += (ODD_MARK.search(word) is not None) * times
    stops = text.count(".") + text.count("!") + text.count("?")
    pairs = list(zip(words, words[1:]))
    fives = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    log_shares = [float(np.log(x + 0.01)) for x in (
        repeated(words), share(max(counts.values(), default=0), n),
        share(sum(a == b for a, b in pairs), n), repeated(pairs), repeated(fives),
        repeated(lines), share(int(kind[UPPER]), max(letters, 1)), share(upper, n),
        share(int(kind[DIGIT]), size), share(letters, size), share(n, size), share(stops, n),
        share(inner, n), share(edge, n), share(int(kind[ODD]), size), share(marked, n),
        share(int((lengths < 3).sum()) if n else 0, n))]
    return [*log_shares, np.log1p(size), np.log1p(n), float(lengths.mean()),
            float(lengths.std()), np.log1p(len(lines)), np.log1p(share(n, len(lines))),
            np.log1p(len(set(text))), np.log1p(share(n, stops))]


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors and constants of the log-densities."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    temperature: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(rows), 0.5)
        density = [c - 0.5 * (((rows - m) @ f.T) ** 2).sum(axis=1)
                   for m, f, c in zip(self.means, self.factors, self.constants)]
        return 1 / (1 + np.exp(np.clip((density[0] - density[1]) / self.temperature, -500, 500)))


def features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out and the statistics of every row."""
    def scan(batches: Iterator) -> Iterator[dict]:
        for ids, held, texts in batches:
            yield {"doc_id": ids, "held_out": held, "x": [statistics(t) for t in texts]}

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), held_out(id_column).alias("held_out"),
                       F.col(text_column).alias("text"))
    return map_batches(rows, ["doc_id", "held_out", "text"], scan,
                       f"doc_id {kind}, held_out boolean, x array<double>")


def class_sums(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class: rows, sum of the vectors, sum of their outer products (a fixed size each)."""
    d = len(FEATURES)

    def scan(batches: Iterator) -> Iterator[dict]:
        total = {c: np.zeros((d + 1, d + 1)) for c in (0, 1)}
        for classes, xs in batches:
            if classes:
                rows = np.column_stack([np.ones(len(xs)), np.array(xs, dtype=np.float64)])
                of = np.array(classes)
                for c in total:
                    total[c] += rows[of == c].T @ rows[of == c]
        yield {"class": [0, 1], "m": [total[c].ravel().tolist() for c in (0, 1)]}

    parts = map_batches(labelled, ["class", "x"], scan, "class int, m array<double>")
    cells = parts.select("class", F.posexplode("m").alias("i", "v")).groupBy("class", "i").agg(
        F.sum("v").alias("v")).collect()
    table = np.zeros((2, (d + 1) ** 2))
    for row in cells:
        table[row["class"], row.i] = row.v
    table = table.reshape(2, d + 1, d + 1)
    return {c: (table[c, 0, 0], table[c, 0, 1:], table[c, 1:, 1:]) for c in (0, 1)}


def discriminant(sums: dict, pooled: float = 0.1, diagonal: float = 0.02,
                 temperature: float = 2.0) -> Discriminant:
    """``pooled`` and ``diagonal`` are the weights of the two shrinkage targets."""
    if min(n for n, _, _ in sums.values()) < 2:
        return Discriminant(np.empty(0), np.empty(0), np.empty(0), temperature)
    total = sum(n for n, _, _ in sums.values())
    means = np.array([s / n for n, s, _ in sums.values()])
    spread = [q / n - np.outer(m, m) for m, (n, _, q) in zip(means, sums.values())]
    common = sum(n * s for (n, _, _), s in zip(sums.values(), spread)) / total
    factors, constants = [], []
    for (n, _, _), s in zip(sums.values(), spread):
        s = (1 - pooled) * s + pooled * common
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(common)) + 1e-6 * np.eye(len(s))
        lower = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(n / total) - np.log(np.diag(lower)).sum())
    return Discriminant(means, np.array(factors), np.array(constants), temperature)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3,
                   id_column: str = "doc_id", text_column: str = "text",
                   label_column: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scratch = Scratch(docs.sparkSession)
    table = scratch.table(features(docs, id_column, text_column), "features")
    taught = labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).cast("int")
                           .alias("class")).where("class in (0, 1)").distinct()
    model = discriminant(class_sums(table.where(~F.col("held_out")).join(taught, "doc_id")))

    def scan(batches: Iterator) -> Iterator[dict]:
        for ids, held, xs in batches:
            score = model.scores(np.array(xs, dtype=np.float64).reshape(-1, len(FEATURES)))
            yield {"doc_id": ids, "held_out": held, "score": score,
                   "predicted": (score >= threshold).astype(np.int32)}

    kind = table.schema["doc_id"].dataType.simpleString()
    return scratch.result(map_batches(
        table, ["doc_id", "held_out", "x"], scan,
        f"doc_id {kind}, held_out boolean, score double, predicted int"), "quality")
