"""Exact removal of passages that repeat across documents, by suffix sorting.

A byte goes if a string of ``width`` bytes that covers it also starts in a document with a smaller
id; strings are judged on the whole input, overlaps count and no string crosses a document.

Plan, one job over one shuffle of the texts (`blocks`), which its three readers share:

1. ``anchors``: equal strings have an equal least gram hash (a minimizer).  Every block of texts
   sends its distinct anchors, packed, by hash range; what comes back to a block is which of them
   other blocks have too.  All text whose anchors are nobody else's is done.
2. ``candidates``: a block sorts the suffixes of the strings that are left (`suffixes`), which settles
   all repeats within the block.  Of the rest, those whose anchors other blocks have travel by anchor,
   as runs of neighbouring strings; a string that a third of all documents hold, or that one document
   holds a thousand times, travels once per block, and echoes say where it stands besides.  An anchor of very many blocks deals its strings by their own hash, so a frequent
   phrase with ever different neighbours is spread.
3. ``resolved``: the strings of one part are suffix-sorted and all but the smallest document's are
   marked.  Blocks meet in teams of ``fan``, whose survivors meet in larger teams, so no task sees
   more than ``fan`` copies of a string.
4. ``cut``: marks go back to their blocks and are taken out of the texts.

Hashes only choose what is compared and where; whether strings are equal is decided on their bytes.

Edge cases: a null text is empty; documents shorter than ``width`` stay whole; a null id counts as
smaller than all others and rows that share an id do not repeat one another, equal rows included,
so each has the same result; other columns are ignored; an empty table gives no rows.  A document is
held whole by one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftline.llm import suffixes

#: Bytes of text in a block, and of strings that are expected in a part.
BLOCK_BYTES, PART_BYTES = 4 << 20, 3 << 20
#: Anchors that are expected in a hash range.
RANGE_ANCHORS = 1 << 20
NULL_ID = -(1 << 63)
FOUND = "part bigint, block bigint, team bigint, kind int, data binary"
STRINGS, MARKS, ECHOES = range(3)
REPLIES = "block bigint, several binary, very binary"
RESULT = ("doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, "
          "kept binary")
#: The Arrow types of the rows above.
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
TYPES = {"part": pa.int64(), "block": pa.int64(), "team": pa.int64(), "kind": pa.int32(), "data": pa.binary(),
         "several": pa.binary(), "very": pa.binary(), "doc_id": pa.int64(),
         "n_bytes": pa.int64(), "spans": SPANS, "kept": pa.binary()}


def arrow(columns: dict[str, list]) -> pa.Table:
    return pa.table({n: pa.array(v, TYPES[n]) for n, v in columns.items()})


def packed(*arrays: np.ndarray) -> bytes:
    """Number of entries, then the arrays one after another; the last may have any length."""
    return b"".join([np.int64(len(arrays[0])).tobytes(), *(a.tobytes() for a in arrays)])


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of `packed`; the rest of the bytes comes last."""
    count, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    return [*out, np.frombuffer(data, np.uint8, offset=at)]


class Texts:
    """The distinct (id, text) of a block in ascending order, one after another."""

    def __init__(self, table: pa.Table) -> None:
        rows = zip(table["doc_id"].to_pylist(), table["text"].to_pylist())
        self.docs = sorted({(NULL_ID if i is None else i, t or b"") for i, t in rows})
        self.raw = np.frombuffer(b"".join(t for _, t in self.docs), np.uint8)
        self.sizes = np.array([len(t) for _, t in self.docs], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.ids = np.array([i for i, _ in self.docs], np.int64)

    def windows(self, width: int, gram: int, bits: int) -> tuple[np.ndarray, ...]:
        """Positions of all strings, their documents' places, and starts and anchors of the runs
        of neighbours with one anchor."""
        count = np.maximum(0, self.sizes - width + 1)
        place = np.repeat(np.arange(len(self.docs), dtype=np.int32), count)
        first = np.cumsum(count) - count
        at = np.arange(len(place)) + np.repeat(self.ends - self.sizes - first, count)
        least = suffixes.window_anchors(self.raw, width, gram)[at]
        change = np.ones(len(at), bool)
        change[1:] = (least[1:] != least[:-1]) | (place[1:] != place[:-1])
        runs = np.flatnonzero(change)
        with np.errstate(over="ignore"):
            anchors = suffixes.mixed(least[runs])
        low = np.uint64((1 << 48) - 1 | (1 << 64) - (1 << 64 - bits))
        return at, place, runs, anchors & low


def is_in(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def laid_out(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of ``raw``, a separator after each; their new starts; the separators."""
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    text = np.zeros(ends[-1], np.uint8)
    text[ranges(begins, sizes)] = raw[ranges(starts, sizes)]
    return text, begins, ends - 1


def neighbours(at: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Where runs of consecutive positions that agree in ``same`` start."""
    head = np.ones(len(at), bool)
    head[1:] = at[1:] != at[:-1] + 1
    for values in same:
        head[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(head)


def lengths(starts: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.append(starts, total))


def edges(*values: np.ndarray) -> Iterable[tuple[int, int]]:
    """First and last (exclusive) places of runs that agree in all values."""
    head = np.ones(len(values[0]), bool)
    head[1:] = False
    for value in values:
        head[1:] |= value[1:] != value[:-1]
    starts = np.flatnonzero(head).tolist()
    return zip(starts, [*starts[1:], len(head)])


class Found:
    """Rows of FOUND under construction."""

    def __init__(self) -> None:
        self.rows: dict[str, list] = {
            "part": [], "block": [], "team": [], "kind": [], "data": []}

    def add(self, part: int, block: int, kind: int, data: bytes) -> None:
        for name, value in zip(self.rows, (part, block, block, kind, data)):
            self.rows[name].append(value)

    def marks(self, block: np.ndarray, place: np.ndarray, at: np.ndarray, width: int) -> None:
        """Strings to remove, given by blocks, documents' places and positions in them."""
        order = np.lexsort((at, place, block))
        block, place, at = block[order], place[order], at[order]
        runs = neighbours(at, place, block)
        size = lengths(runs, len(at)) + width - 1
        block, place, at = block[runs], place[runs], at[runs]
        for low, high in edges(block):
            self.add(int(-1 - block[low]), int(block[low]), MARKS, packed(
                place[low:high].astype(np.int32), at[low:high].astype(np.int32),
                size[low:high].astype(np.int32)))

    def echoes(self, block: int, place: np.ndarray, at: np.ndarray, as_place: np.ndarray,
               as_at: np.ndarray) -> None:
        """Strings that go if the equal ones do that stand for them."""
        runs = neighbours(at, place, as_place, as_at - at)
        if len(runs):
            self.add(-1 - block, block, ECHOES, packed(*(a.astype(np.int32) for a in (
                place[runs], at[runs], as_place[runs], as_at[runs], lengths(runs, len(at))))))

    def strings(self, part: np.ndarray, block: np.ndarray, raw: np.ndarray, starts: np.ndarray,
                doc: np.ndarray, place: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        """Runs of strings, each one piece of bytes, by part and block."""
        order = np.lexsort((block, part))
        part, block, starts, doc, place, at, size = (
            a[order] for a in (part, block, starts, doc, place, at, size))
        codec = pa.Codec("zstd")
        for low, high in edges(part, block):
            mine = slice(low, high)
            text = codec.compress(raw[ranges(starts[mine], size[mine])], asbytes=True)
            self.add(int(part[low]), int(block[low]), STRINGS, packed(
                doc[mine].astype(np.int64), place[mine].astype(np.int32),
                at[mine].astype(np.int32), size[mine].astype(np.int32),
                np.frombuffer(text, np.uint8)))

    def table(self) -> pa.Table:
        return arrow(self.rows)


def repeated_passages(docs: DataFrame, width: int = 50, gram: int = 24, fan: int = 4096,
                      block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_bytes, ``spans`` (start and end of the bytes that go) and ``kept`` of every row."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_blocks, n_parts = 1 + total // block_bytes, 1 + total // part_bytes
    # a string has about 2 / (width - gram + 2) new anchors
    expected = 2 * total / (width - gram + 2)
    bits = max(1, math.ceil(math.log2(1 + expected / RANGE_ANCHORS)))
    text = F.col("text").cast("binary")
    texts = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).alias("block"),
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))

    def anchors(table: pa.Table) -> pa.Table:
        *_, found = Texts(table).windows(width, gram, bits)
        found = np.unique(found)
        chunks = (found >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(chunks)) + 1
        parts = np.split(found, cuts) if len(found) else []
        return pa.table({
            "chunk": pa.array([int(p[0] >> np.uint64(64 - bits)) for p in parts], pa.int64()),
            "block": pa.array([table["block"][0].as_py()] * len(parts), pa.int64()),
            "anchors": pa.array([packed(p.astype("u4"), (p >> np.uint64(32)).astype("u2"))
                                 for p in parts], pa.binary())})

    def shared(table: pa.Table) -> pa.Table:
        """Which anchors of a hash range other blocks have too, and which very many have."""
        top = np.uint64(table["chunk"][0].as_py()) << np.uint64(64 - bits)
        mine = []
        for data in table["anchors"]:
            low, high, _ = unpacked(data.as_py(), "u4", "u2")
            mine.append(low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)) | top)
        values, count = np.unique(np.concatenate(mine), return_counts=True)
        several, very = values[count > 1], values[count > fan]
        out: dict[str, list] = {"block": [], "several": [], "very": []}
        for block, own in zip(table["block"].to_pylist(), mine):
            own = own[is_in(own, several)]
            if len(own):
                out["block"].append(block)
                out["several"].append(packed(own))
                out["very"].append(packed(own[is_in(own, very)]))
        return arrow(out)

    def candidates(table: pa.Table, replies: pa.Table) -> pa.Table:
        """Repeats within the block as marks; other strings that may repeat elsewhere, by part."""
        found = Found()
        if not table.num_rows:
            return found.table()
        block, block_texts = table["block"][0].as_py(), Texts(table)
        at, place, runs, anchor = block_texts.windows(width, gram, bits)
        several, very = (np.sort(np.concatenate([np.zeros(0, np.uint64), *(
            unpacked(d.as_py(), "u8")[0] for d in replies[n])])) for n in ("several", "very"))
        order = np.lexsort((place[runs], anchor))
        same = anchor[order][1:] == anchor[order][:-1]
        inside = anchor[order][1:][same & (place[runs][order][1:] != place[runs][order][:-1])]
        across = is_in(anchor, several)
        sizes = lengths(runs, len(at))
        chosen = np.repeat(across | is_in(anchor, np.unique(inside)), sizes)
        across = np.repeat(across, sizes)[chosen]
        frequent = np.repeat(is_in(anchor, very), sizes)[chosen]
        anchor = np.repeat(anchor, sizes)[chosen]
        at, place = at[chosen], place[chosen]
        if not len(at):
            return found.table()
        # regions of overlapping strings are sorted together
        head = np.ones(len(at), bool)
        head[1:] = (at[1:] >= at[:-1] + width) | (place[1:] != place[:-1])
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(at)) - 1
        text, begins, separators = laid_out(
            block_texts.raw, at[first], at[last] + width - at[first])
        shift = np.repeat(begins - at[first], lengths(first, len(at)))
        doc = block_texts.ids[place]
        gone, first = suffixes.seen_earlier(text, separators, at + shift, doc, width)
        offset = at - (block_texts.ends - block_texts.sizes)[place]
        found.marks(np.full(gone.sum(), block), place[gone], offset[gone], width)
        sent = across & ~gone
        echo = sent & (first != np.arange(len(first)))
        found.echoes(block, place[echo], offset[echo], place[first[echo]], offset[first[echo]])
        sent &= ~echo
        at, place, offset, key, doc = (a[sent] for a in (at, place, offset, anchor, doc))
        if frequent.any() and len(at):
            own = suffixes.mixed(suffixes.rolling(block_texts.raw, width)[at])
            key = np.where(frequent[sent], own, key)
        heads = neighbours(at, place, key)
        with np.errstate(over="ignore"):
            part = (suffixes.mixed(key[heads]) % np.uint64(n_parts)).astype(np.int64)
        found.strings(part, np.full(len(part), block), block_texts.raw, at[heads], doc[heads],
                      place[heads], offset[heads], lengths(heads, len(at)) + width - 1)
        return found.table()

    def resolved(last: bool):
        def settle(table: pa.Table) -> pa.Table:
            """Marks pass; of equal strings all but those of the smallest document are marked."""
            part = table["part"][0].as_py()
            if part < 0:
                return table
            found, blocks = Found(), np.array(table["block"].to_pylist())
            rows = [unpacked(d.as_py(), "i8", "i4", "i4", "i4") for d in table["data"]]
            doc, place, at, size = (np.concatenate([r[i] for r in rows]) for i in range(4))
            codec = pa.Codec("zstd")
            raw = np.concatenate([np.frombuffer(
                codec.decompress(r[4], int(r[3].sum())), np.uint8) for r in rows])
            block = np.repeat(blocks, [len(r[0]) for r in rows])
            size = size.astype(np.int64)
            text, begins, separators = laid_out(raw, np.cumsum(size) - size, size)
            count = size - width + 1
            wanted, run = ranges(begins, count), np.repeat(np.arange(len(size)), count)
            inner = wanted - begins[run]
            gone, _ = suffixes.seen_earlier(text, separators, wanted, doc[run], width)
            found.marks(block[run[gone]], place[run[gone]], at[run[gone]] + inner[gone], width)
            if not last:
                wanted, run, inner = wanted[~gone], run[~gone], inner[~gone]
                heads = neighbours(wanted)
                its = run[heads]
                found.strings(np.full(len(heads), part), block[its], text, wanted[heads], doc[its],
                              place[its], at[its] + inner[heads],
                              lengths(heads, len(wanted)) + width - 1)
            return found.table()
        return settle

    def cut(table: pa.Table, marks: pa.Table) -> pa.Table:
        block_texts = Texts(table)
        begin = block_texts.ends - block_texts.sizes
        goes = np.zeros(len(block_texts.raw) + width, bool)  # starts of strings to remove
        rows = list(zip(marks["kind"].to_pylist(), marks["data"].to_pylist()))
        for data in (d for kind, d in rows if kind == MARKS):
            place, at, size, _ = unpacked(data, "i4", "i4", "i4")
            goes[ranges(begin[place] + at, size.astype(np.int64) - width + 1)] = True
        for data in (d for kind, d in rows if kind == ECHOES):
            place, at, as_place, as_at, count, _ = unpacked(data, "i4", "i4", "i4", "i4", "i4")
            count = count.astype(np.int64)
            goes[ranges(begin[place] + at, count)] |= goes[ranges(begin[as_place] + as_at, count)]
        starts = np.flatnonzero(goes)
        cover = np.zeros(len(goes) + width, np.int32)
        cover[starts] += 1
        cover[starts + width] -= 1
        gone = np.cumsum(cover)[:len(block_texts.raw)] > 0
        results = {}
        for i, key in enumerate(block_texts.docs):
            mine = gone[begin[i]:block_texts.ends[i]]
            turns = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]])))
            results[key] = ([{"start": int(a), "end": int(b)} for a, b in turns.reshape(-1, 2)],
                            block_texts.raw[begin[i]:block_texts.ends[i]][~mine].tobytes())
        rows = [(i, t or b"", results[NULL_ID if i is None else i, t or b""]) for i, t in zip(
            table["doc_id"].to_pylist(), table["text"].to_pylist())]
        return arrow({
            "doc_id": [r[0] for r in rows], "n_bytes": [len(r[1]) for r in rows],
            "spans": [r[2][0] for r in rows], "kept": [r[2][1] for r in rows]})

    by_block = texts.groupBy("block")
    ranged = by_block.applyInArrow(anchors, "chunk bigint, block bigint, anchors binary")
    replies = ranged.groupBy("chunk").applyInArrow(shared, REPLIES)
    found = by_block.cogroup(replies.groupBy("block")).applyInArrow(candidates, FOUND)
    teams, reach = n_blocks, 1
    while True:
        teams, reach = -(-teams // fan), reach * fan
        found = found.withColumn("team", F.floor(F.col("block") / F.lit(reach))).groupBy(
            "part", "team").applyInArrow(resolved(teams == 1), FOUND)
        if teams == 1:
            break
    marks = found.where("part < 0").select("block", "kind", "data")
    return by_block.cogroup(marks.groupBy("block")).applyInArrow(cut, RESULT)


def repeat_digest(passages: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"),
                          lambda total, span: total + span["end"] - span["start"])
    return passages.select(
        "doc_id", "n_bytes", removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: All strings of 50 bytes, as hexadecimal digits, and the runs of those that start earlier too.
REPEATS_SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS k,
         coalesce(hex(encode(text)), '') AS h
  FROM documents),
places AS (SELECT r, k, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM texts),
strings AS (SELECT r, k, i, substr(h, 2 * i + 1, 100) AS s FROM places),
least AS (SELECT s, min(k) AS lo FROM strings GROUP BY s HAVING min(k) < max(k)),
gone AS (SELECT r, i FROM strings JOIN least USING (s) WHERE k > lo),
marked AS (
  SELECT r, i, (i > 50 + lag(i) OVER (PARTITION BY r ORDER BY i)) IS NOT FALSE AS opens FROM gone),
runs AS (
  SELECT r, i, sum(opens::int) OVER (PARTITION BY r ORDER BY i) AS run FROM marked),
spans AS (SELECT r, run, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY r, run),
gaps AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM spans),
parts AS (
  SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
         string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head
  FROM gaps JOIN texts USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN parts USING (r)
"""
