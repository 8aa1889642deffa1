"""Language of whole texts: script ranges, word scores and a Viterbi path with a switch penalty.

Fit: character n-grams (one to four, with word borders) of labelled texts are counted per
language in a table of fixed size, and so are the scripts of their words.  The fit reads a
bounded sample: every labelled row while there are at most ``train_rows``, else a share of the
rows, chosen by a hash, that is expected to give that many.

Prediction: words are runs of letters, lower-cased.  The script of a word leaves the languages
that were seen with it as candidates; its n-grams score them.  Over a text, the best path of
languages, where each change costs ``switch`` nats, labels every word and so cuts a text of mixed
languages into spans.  The text's language holds most letters; its score is their share.

Edge cases: a null text and a text without a letter give ``und`` with score 0 and no spans, and
so does every text if nothing was learned; ties go to the language that sorts first; extra
columns are ignored; repeated rows give repeated results; an empty table gives an empty table.
Texts are read whole; memory is bounded by an Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftline.llm.common import held_out, map_batches, slices, small_batches

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (1, 2, 3, 4)
#: First code point of a range, and its script.
SCRIPT_RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Other"),
    (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"),
    (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, "Other"), (0x20000, "Han"), (0x30000, "Han"))
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
RANGE_STARTS = np.array([start for start, _ in SCRIPT_RANGES])
RANGE_SCRIPT = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES])
#: Letters of a batch that are labelled together, and words that are scored together.
GROUP_LETTERS, GROUP_WORDS = 1_500_000, 20_000


@dataclass
class LanguageModel:
    """``scores[slot, language]``: log probability of an n-gram; ``allowed[script, language]``."""

    languages: list[str]
    scores: np.ndarray
    allowed: np.ndarray
    switch: float


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; numerals that count as word characters alone are no words."""
    return [w for w in WORD.findall((text or "").lower())
            if w.isalpha() or any(map(str.isalpha, w))]


def letters_of(words: list[str]) -> np.ndarray:
    """Code points of the words, each after a space, and a last space."""
    return np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"),
                         np.uint32)


def ngram_slots(points: np.ndarray, slots: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the word numbers (ascending) and table slots of all n-grams of the words."""
    space = points == 32
    word = np.cumsum(space) - 1
    wide = points.astype(np.uint64)
    for order in ORDERS:
        count = len(points) - order + 1
        if count <= 0:
            return
        mixed = np.full(count, order, np.uint64)
        for i in range(order):
            mixed = (mixed ^ wide[i:count + i]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        inside = ~space[:count] if order == 1 else word[:count] < word[-1]
        for i in range(1, order - 1):
            inside &= ~space[i:count + i]
        yield word[:count][inside], (mixed[inside] % np.uint64(slots)).astype(np.int64)


def scripts_of(words: list[str]) -> np.ndarray:
    first = np.array([ord(w[0]) for w in words], dtype=np.int64)
    return RANGE_SCRIPT[np.searchsorted(RANGE_STARTS, first, side="right") - 1]


def word_scores(words: list[str], model: LanguageModel) -> np.ndarray:
    """One row of language scores per word."""
    out = np.zeros((len(words), len(model.languages)), np.float32)
    for low in range(0, len(words), GROUP_WORDS):
        part = words[low:low + GROUP_WORDS]
        total = np.zeros((len(part), out.shape[1]))
        for word, slot in ngram_slots(letters_of(part), len(model.scores)):
            running = np.zeros((len(slot) + 1, out.shape[1]))
            np.cumsum(model.scores[slot], axis=0, out=running[1:])
            ends = np.searchsorted(word, np.arange(len(part) + 1))
            total += running[ends[1:]] - running[ends[:-1]]
        allowed = model.allowed[scripts_of(part)]
        known = allowed.any(axis=1)
        total = np.where(allowed, total, total.min(axis=1, keepdims=True) - 50.0)
        out[low:low + GROUP_WORDS] = np.where(known[:, None], total, 0.0)
    return out


def best_paths(emissions: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
               switch: float) -> np.ndarray:
    """Label of every word; texts (longest first) advance together, a word at a time."""
    path = np.zeros(len(emissions), np.int16)
    if not len(emissions):
        return path
    came = np.zeros(emissions.shape, np.int16)
    value = np.zeros((len(starts), emissions.shape[1]), np.float64)
    own = np.arange(emissions.shape[1], dtype=np.int16)
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    for t, n in enumerate(active):
        here, v = starts[:n] + t, value[:n]
        if t:
            top = v.argmax(axis=1)
            entry = v[np.arange(n), top] - switch
            stay = v >= entry[:, None]
            came[here] = np.where(stay, own, top[:, None])
            v = np.where(stay, v, entry[:, None])
        value[:n] = v + emissions[here]
    label = value.argmax(axis=1)
    for t in range(lengths[0] - 1, -1, -1):
        n = active[t]
        here = starts[:n] + t
        path[here] = label[:n]
        label[:n] = came[here, label[:n]]
    return path


def groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of about ``GROUP_LETTERS`` together; a longer text is a run of its own."""
    part, letters = [], 0
    for text in texts:
        if part and letters + len(text or "") > GROUP_LETTERS:
            yield part
            part, letters = [], 0
        part.append(text)
        letters += len(text or "")
    if part:
        yield part


def label_texts(texts: list[str | None], model: LanguageModel) -> list[tuple]:
    """(language, score, spans) per text; a span is (language, first word, words)."""
    found = [words_of(t) for t in texts]
    order = sorted(range(len(texts)), key=lambda i: -len(found[i]))
    order = [i for i in order if found[i]] if model.languages else []
    out: list[tuple] = [("und", 0.0, [])] * len(texts)
    if not order:
        return out
    ids: dict[str, int] = {}
    index = np.concatenate([np.fromiter((ids.setdefault(w, len(ids)) for w in found[i]),
                                        np.int64, len(found[i])) for i in order])
    words = list(ids)
    sizes = np.fromiter(map(len, words), np.int64, len(words))[index]
    lengths = np.array([len(found[i]) for i in order])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    path = best_paths(word_scores(words, model)[index], starts, lengths, model.switch)
    count = len(model.languages)
    text = np.repeat(np.arange(len(order)), lengths)
    share = np.bincount(text * count + path, weights=sizes, minlength=count * len(order))
    share = share.reshape(len(order), count)
    best = share.argmax(axis=1)
    score = share[np.arange(len(order)), best] / share.sum(axis=1)
    cuts = np.flatnonzero((np.diff(path) != 0) | (np.diff(text) != 0)) + 1
    heads = np.concatenate([[0], cuts])
    ends = np.concatenate([cuts, [len(path)]])
    spans: list[list] = [[] for _ in order]
    for k, a, b in zip(text[heads].tolist(), heads.tolist(), ends.tolist()):
        spans[k].append((model.languages[path[a]], a - int(starts[k]), b - a))
    for k, i in enumerate(order):
        out[i] = (model.languages[best[k]], float(score[k]), spans[k])
    return out


def sample_limit(train_rows: int, total: int) -> int:
    """Below which hash of 62 bits a row is in the sample: an expected ``train_rows`` of ``total``."""
    return max(1, (train_rows << 62) // total)


def fit_languages(docs: DataFrame, train_rows: int = 10_000, slots: int = 1 << 16,
                  switch: float = 6.0, least_share: float = 0.005, id_column: str = "doc_id",
                  text_column: str = "text", language_column: str = "lang") -> LanguageModel:
    """Counts of n-grams and scripts per language over the sample of labelled rows.

    The sample is an expected ``train_rows`` rows by hash, and of every language the row with the
    smallest hash, so none is left out at any size.  The driver receives at most ``slots`` plus the
    number of scripts values per language.
    """
    rows = docs.where(~held_out(id_column)).select(
        F.col(language_column).cast("string").alias("lang"), F.col(text_column).alias("text"),
        F.xxhash64(id_column, text_column).alias("h"))
    rows = rows.where("lang is not null and text is not null")
    rows = rows.withColumn("h", F.shiftrightunsigned("h", 2))
    least = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()
    total = sum(row["n"] for row in least)
    if total > train_rows:
        rows = rows.where((F.col("h") < sample_limit(train_rows, total)) | F.col("h").isin(
            [row["least"] for row in least]))
    buckets = slots + len(SCRIPTS)

    def scan(batches: Iterator) -> Iterator[dict]:
        counts: dict[str, np.ndarray] = {}
        for languages, texts in batches:
            for language, text in zip(languages, texts):
                words = words_of(text)
                if not words:
                    continue
                table = counts.setdefault(language, np.zeros(buckets, np.int64))
                for _, slot in ngram_slots(letters_of(words), slots):
                    table += np.bincount(slot, minlength=buckets)
                table += np.bincount(scripts_of(words) + slots, minlength=buckets)
        for language, table in counts.items():
            at = np.flatnonzero(table)
            yield {"lang": [language] * len(at), "slot": at, "n": table[at]}

    found = map_batches(rows.repartition(8, "h"), ["lang", "text"], scan,
                        "lang string, slot int, n bigint")
    found = found.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found.lang.unique())
    table = np.zeros((len(languages), buckets))
    table[[languages.index(x) for x in found.lang], found.slot.to_numpy(int)] = found.n
    grams, scripts = table[:, :slots] + 0.1, table[:, slots:]
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return LanguageModel(languages, np.log(grams / grams.sum(axis=1, keepdims=True)).T.copy(),
                         (share >= least_share).T.copy(), switch)


def identify(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id",
             text_column: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and the spans of every row."""
    def scan(batches: Iterator) -> Iterator[dict]:
        for ids, held, texts in batches:
            found = [f for part in groups(texts) for f in label_texts(part, model)]
            yield {"doc_id": ids, "held_out": held, "lang_pred": [f[0] for f in found],
                   "score": [f[1] for f in found],
                   "spans": [[{"lang": s[0], "first_word": s[1], "words": s[2]}
                              for s in f[2]] for f in found]}

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), held_out(id_column).alias("held_out"),
                       F.col(text_column).alias("text"))
    return map_batches(rows, ["doc_id", "held_out", "text"], scan,
                       f"doc_id {kind}, held_out boolean, lang_pred string, score double, "
                       "spans array<struct<lang: string, first_word: bigint, words: bigint>>")


def known_language(docs: DataFrame, model: LanguageModel, least_score: float = 1 / 3,
                   text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with a language that holds ``least_score`` of the letters.

    Rows pass through the tasks whole; nothing is joined or shuffled.
    """
    place = docs.columns.index(text_column)
    small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(place).to_pylist()
            keep = [f[0] != "und" and f[1] >= least_score
                    for part in groups(texts) for f in label_texts(part, model)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
