"""Repair of conversations whose turns do not follow the grammar ``(s?(ua)+)?`` of role initials.

The cheapest edits that make a conversation legal are found by aligning its rows to alternating
target strings (Wagner-Fischer): keep a row (0), give it the user's or assistant's role (2), delete
it (3; required for blank and repeated rows), insert an empty row (2).  A truncated row that stays
costs 1 more.  Of the cheapest audits (``K R D I`` in order) the least in ASCII wins.

A conversation is aligned in blocks of rows, so one of any length is spread over tasks.  What a
block must know of the others is the symbol that its output goes on from and the one that it ends
with; for both it aligns its rows to each feasible length of the alternating string.  One cost table
per ending symbol serves all lengths, because shorter targets are suffixes of longer ones; its band
(Ukkonen) comes from the cost of a greedy repair, since a cell that is further off than that cost
allows cannot be on a cheapest path.  Audits are read off the tables and compared.  Blocks are then
chained per conversation: four states, one audit each.

Why chaining is exact: inside a block no insertion follows the last row, so all its audits
consume the same rows and end with the letter of a row; none is a proper prefix of another, and
the least of the whole is made of the least of the parts.

Edge cases: rows of one conversation stand by turn (null first), role and a hash of the text; null
fields are read as the ``null`` argument; a null conversation id is a conversation; other columns
are ignored; a conversation without rows is listed with zeros if ``known`` names it; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftline.llm.common import Scratch, map_batches

#: Costs of the edits.
RETITLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
#: Rows of one alignment are those whose place agrees above this many bits.
BLOCK_BITS = 5
#: What the output may go on from: nothing yet, s, u or a.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
OTHER = {"u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def greedy_cost(initials: list[str], extra: list[int], first: str, last: str) -> int:
    """Cost of one valid repair, hence a bound: next symbol kept, inserted before, or given."""
    cost, expected, final = 0, first, len(initials) - 1
    for i, initial in enumerate(initials):
        cost += extra[i]
        symbol = last if i == final else initial if initial in OTHER else expected
        cost += (INSERT if symbol != expected else 0) + (RETITLE if symbol != initial else 0)
        expected = OTHER[symbol]
    return cost


class Suffixes:
    """Least costs from every row on to the last ``k`` symbols of an alternating string."""

    def __init__(self, initials: list[str], extra: list[int], last: str) -> None:
        self.initials, self.extra = initials, extra
        n = self.n = len(initials)
        self.symbols = ["", *((last, OTHER[last]) * (n + 1))]
        bound = max(greedy_cost(initials, extra, first, last) for first in "ua")
        below, above = bound // DELETE, bound // INSERT
        self.rows: list[dict[int, int]] = [{} for _ in range(n)] + [{0: 0}]
        for i in reversed(range(n)):
            row, after, left = self.rows[i], self.rows[i + 1], n - i
            for k in range(max(0, left - below), left + above + 1):
                cost = DELETE + after.get(k, FAR)
                if k:
                    change = extra[i] + (0 if self.symbol(k) == initials[i] else RETITLE)
                    cost = min(cost, change + after.get(k - 1, FAR), INSERT + row.get(k - 1, FAR))
                if cost <= bound:
                    row[k] = cost

    def symbol(self, k: int) -> str:
        return self.symbols[1 + (k - 1) % 2] if k else ""

    def trace(self, i: int, k: int) -> list[str]:
        """The letters of each row from ``i`` on: least audit of the cheapest ones."""
        tokens, inserted = [], ""
        while i < self.n:
            cost, after = self.rows[i][k], self.rows[i + 1]
            if DELETE + after.get(k, FAR) == cost:
                tokens.append(inserted + "D")
            elif INSERT + self.rows[i].get(k - 1, FAR) == cost:
                inserted, k = inserted + "I", k - 1
                continue
            else:
                tokens.append(inserted + ("K" if self.symbol(k) == self.initials[i] else "R"))
                k -= 1
            inserted, i = "", i + 1
        return tokens


def whole_audit(dead: list[bool], tokens: list[str]) -> str:
    """Deletions of dead rows come right after the letter before them."""
    live = iter(tokens)
    return "".join("D" if d else next(live) for d in dead)


def block_repairs(initials: list[str], dead: list[bool], cut: list[bool]) -> list[tuple]:
    """(first symbol, end state, cost, audit) of a block; first ``""``: nothing is left of it."""
    live = [i for i, d in enumerate(dead) if not d]
    base, n = DELETE * (len(dead) - len(live)), len(live)
    mine, extra = [initials[i] for i in live], [CUT_SHORT * cut[i] for i in live]
    out = [("", None, base + DELETE * n, "D" * len(dead))]
    starts = [i for i in range(n) if mine[i] == "s"]
    if starts:
        cost = base + DELETE * (n - 1)
        out.append(min((("s", SYSTEM, cost + extra[i], whole_audit(
            dead, ["D"] * i + ["K"] + ["D"] * (n - i - 1))) for i in starts),
            key=lambda found: found[2:]))
    for last, state in (("u", USER), ("a", ASSISTANT)) if n else ():
        table = Suffixes(mine, extra, last)
        for first in "ua":
            ks = [k for k in table.rows[0] if k and table.symbol(k) == first]
            least = min((table.rows[0][k] for k in ks), default=FAR)
            if ks:
                out.append((first, state, base + least, min(whole_audit(dead, table.trace(0, k))
                            for k in ks if table.rows[0][k] == least)))
        after = [(DELETE * i + extra[i] + cost, i, k) for i in starts
                 for k, cost in table.rows[i + 1].items() if k and table.symbol(k) == "u"]
        if after:
            least = min(after)[0]
            out.append(("s", state, base + least, min(
                whole_audit(dead, ["D"] * i + ["K"] + table.trace(i + 1, k))
                for cost, i, k in after if cost == least)))
    return out


#: Which first symbols each state may go on with.
NEXT = {NOTHING: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}


class Chain:
    """Blocks of one conversation in order; per state the least cost and its least audit."""

    def __init__(self) -> None:
        self.states: dict[int, tuple] = {NOTHING: (0, 0, None)}  # cost, order of audits, parts

    def add(self, repairs: list[tuple]) -> None:
        best: dict[int, tuple] = {}
        for state, (cost, order, parts) in self.states.items():
            for first, end, more, audit in repairs:
                if first and first not in NEXT[state]:
                    continue
                end = end if first else state
                new = (cost + more, order, audit, parts)
                if end not in best or new[:3] < best[end][:3]:
                    best[end] = new
        ranks = sorted(best, key=lambda s: best[s][1:3])
        self.states = {s: (best[s][0], ranks.index(s), (best[s][3], best[s][2])) for s in ranks}

    def finish(self) -> tuple[int, str]:
        tails = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
        cost, _, tail, parts = min(
            (c + INSERT * len(tails[s]), order, tails[s], parts)
            for s, (c, order, parts) in self.states.items())
        found = [tail]
        while parts:
            parts, audit = parts
            found.append(audit)
        return cost, "".join(reversed(found))


def faults(rows: DataFrame) -> DataFrame:
    """Narrow rows (conv_id, at, turn, initial, blank, duplicate, cut) of placed rows.

    The first of equal rows is found per block of places first, so that a row that is repeated
    very often is not gathered.
    """
    said = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    narrow = rows.select(
        "conv_id", "at", "turn", F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
        F.unhex(said).alias("said"), F.shiftright("at", 12).alias("part"))
    first = narrow.groupBy("conv_id", "said", "part").agg(F.min("at").alias("_first"))
    first = first.select(
        F.col("conv_id").alias("_conv"), F.col("said").alias("_said"), F.col("part").alias("_part"),
        F.min("_first").over(Window.partitionBy("conv_id", "said")).alias("_first"))
    met = narrow.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (
        F.col("said") == F.col("_said")) & (F.col("part") == F.col("_part")))
    duplicate = ~F.col("blank") & (F.col("at") > F.col("_first"))
    return met.select("conv_id", "at", "turn", "initial", "blank", duplicate.alias("duplicate"),
                      (F.col("cut") & ~F.col("blank") & ~duplicate).alias("cut"))


REPAIRS = "array<struct<first: string, state: int, cost: bigint, audit: string>>"
BLOCK = ("lo bigint, hi bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, "
         f"illegal bigint, first string, last string, repairs {REPAIRS}")


def is_legal(pair: str) -> bool:
    return pair in ("su", "ua", "au")


def block_of_rows(rows: list[tuple]) -> dict:
    turns = [t for t, *_ in rows if t is not None]
    initials, blank, duplicate, cut = ([r[i] for r in rows] for i in range(1, 5))
    dead = [b or d for b, d in zip(blank, duplicate)]
    return {"lo": turns[0] if turns else None, "hi": turns[-1] if turns else None,
            "turns": len(set(turns)), "blank": sum(blank), "duplicate": sum(duplicate),
            "truncated": sum(cut),
            "illegal": sum(not is_legal(a + b) for a, b in zip(initials, initials[1:])),
            "first": initials[0], "last": initials[-1],
            "repairs": [dict(zip(("first", "state", "cost", "audit"), r))
                        for r in block_repairs(initials, dead, cut)]}


def aligned_blocks(narrow: DataFrame) -> DataFrame:
    """One row per block of a conversation's rows."""
    def scan(batches: Iterator) -> Iterator[dict]:
        key, rows = None, []
        names = ("conv_id", "block", *(f.split()[0] for f in BLOCK.split(", ")[:9]), "repairs")
        for columns in batches:
            done = []
            for conversation, block, _, *row in zip(*columns):
                if rows and key != (conversation, block):
                    done.append({"conv_id": key[0], "block": key[1], **block_of_rows(rows)})
                    rows = []
                key = (conversation, block)
                rows.append(row)
            yield {n: [d[n] for d in done] for n in names}
        done = [{"conv_id": key[0], "block": key[1], **block_of_rows(rows)}] if rows else []
        yield {n: [d[n] for d in done] for n in names}

    kind = narrow.schema["conv_id"].dataType.simpleString()
    dealt = narrow.withColumn("block", F.shiftright("at", BLOCK_BITS)).repartition(
        "conv_id", "block").sortWithinPartitions("conv_id", "block", "at")
    return map_batches(
        dealt, ["conv_id", "block", "at", F.col("turn").cast("long").alias("turn"), "initial",
                "blank", "duplicate", "cut"], scan, f"conv_id {kind}, block bigint, {BLOCK}")


def chained(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """Counts, cost and audit per conversation; ``known`` (conv_id) lists those without rows too."""
    class Conversation:
        def __init__(self, conv_id) -> None:
            self.conv_id, self.chain = conv_id, Chain()
            self.lo = self.hi = self.last = None
            self.turns, self.sums = 0, dict.fromkeys(COUNTS[1:], 0)

        def add(self, lo, hi, turns, blank, duplicate, truncated, illegal, first, last, repairs):
            if lo is not None:
                self.turns += turns - (lo == self.hi)
                self.lo, self.hi = lo if self.lo is None else self.lo, hi
            border = self.last is not None and not is_legal(self.last + first)
            for name, value in zip(COUNTS[1:], (blank, duplicate, truncated, illegal + border)):
                self.sums[name] += value
            self.last = last
            self.chain.add([(r["first"], r["state"], r["cost"], r["audit"]) for r in repairs])

        def row(self) -> dict:
            cost, audit = self.chain.finish()
            gaps = self.hi - self.lo + 1 - self.turns if self.lo is not None else 0
            return {"conv_id": self.conv_id, "gaps": gaps, **self.sums, "cost": cost,
                    "audit": audit}

    def scan(batches: Iterator) -> Iterator[dict]:
        now = None
        names = ("conv_id", *COUNTS, "cost", "audit")
        for columns in batches:
            done = []
            for conversation, block, *rest in zip(*columns):
                if now is None or now.conv_id != conversation:
                    done += [now.row()] if now else []
                    now = Conversation(conversation)
                if block is not None:
                    now.add(*rest)
            yield {n: [d[n] for d in done] for n in names}
        done = [now.row()] if now else []
        yield {n: [d[n] for d in done] for n in names}

    kind = blocks.schema["conv_id"].dataType.simpleString()
    rows = blocks.unionByName(known.select("conv_id").distinct(), allowMissingColumns=True)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return map_batches(
        rows, blocks.columns, scan, f"conv_id {kind}, " + ", ".join(
            f"{c} bigint" for c in (*COUNTS, "cost")) + ", audit string")


def repaired_rows(audits: DataFrame, rows: DataFrame) -> DataFrame:
    """Digest of the repaired conversation beside its counts, cost and audit.

    The digest of a conversation is sequential, so its rows pass one task; it holds the audit and
    one batch of rows.
    """
    class Text:
        def __init__(self, stats: dict) -> None:
            self.stats, self.hash = stats, hashlib.sha256()
            self.audit, self.at, self.count, self.last = stats["audit"], 0, 0, ""

        def emit(self, role: str, text: str, initial: str) -> None:
            line = f"{role}:{text}" if not self.count else f"\n{role}:{text}"
            self.hash.update(line.encode("utf-8", "surrogatepass"))
            self.count, self.last = self.count + 1, initial

        def insertions(self) -> None:
            while self.at < len(self.audit) and self.audit[self.at] == "I":
                symbol = "a" if self.last == "u" else "u"
                self.emit(NAMES[symbol], "", symbol)
                self.at += 1

        def add(self, role: str, text: str) -> None:
            self.insertions()
            letter = self.audit[self.at]
            self.at += 1
            if letter == "K":
                self.emit(role, text, role[:1])
            elif letter == "R":
                symbol = "a" if self.last == "u" else "u"
                self.emit(NAMES[symbol], text, symbol)

        def row(self) -> dict:
            self.insertions()
            return {**self.stats, "repaired_sha256": self.hash.hexdigest()}

    names = ("conv_id", *COUNTS, "cost", "audit", "repaired_sha256")

    def scan(batches: Iterator) -> Iterator[dict]:
        now = None
        for columns in batches:
            done = []
            for at, role, text, *stats in zip(*columns):
                if at is None:
                    done += [now.row()] if now else []
                    now = Text(dict(zip(names, stats)))
                else:
                    now.add(role, text)
            yield {n: [d[n] for d in done] for n in names}
        done = [now.row()] if now else []
        yield {n: [d[n] for d in done] for n in names}

    kind = rows.schema["conv_id"].dataType.simpleString()
    both = rows.select("conv_id", "at", "role", "text").unionByName(
        audits, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(
        "conv_id", "at")
    return map_batches(
        both, ["at", "role", "text", "conv_id", *COUNTS, "cost", "audit"], scan,
        f"conv_id {kind}, " + ", ".join(f"{c} bigint" for c in (*COUNTS, "cost"))
        + ", audit string, repaired_sha256 string")


def repair(turns: DataFrame, known: DataFrame | None = None, null: str = "") -> DataFrame:
    """Faults, cheapest audit and digest of the repaired rows of every conversation."""
    scratch = Scratch(turns.sparkSession)
    rows = turns.select("conv_id", "turn", *[
        F.coalesce(c, F.lit(null)).alias(c) for c in ("role", "text")])
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    rows = scratch.table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "at", F.monotonically_increasing_id()), "placed")
    audits = chained(aligned_blocks(faults(rows)), turns if known is None else known)
    return scratch.result(repaired_rows(audits, rows), "repaired")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults put in by the checksum of ``conv_id:turn``; nulls are one space."""
    space, mark = F.lit(" "), F.crc32(F.concat_ws(":", *[
        F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    hurt: Column = F.when(F.col("mark") == 1, "").when(
        F.col("mark") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return turns.select("conv_id", "turn", "role", "text", mark.alias("mark")).where(
        "mark != 0").select(
        "conv_id", "turn", F.when(F.col("mark") == 4, "user").otherwise(role).alias("role"),
        hurt.alias("text"), F.explode(F.when(F.col("mark") == 3, F.array(F.lit(1), F.lit(2)))
                                      .otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def repair_of_damage(turns: DataFrame) -> DataFrame:
    return repair(damaged(turns), known=turns)


#: Damage, faults, the cheapest audits row by row over the four states, and the repaired lines.
REPAIR_SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::bigint, list_transform(string_split(
             coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''),
             lambda c: ascii(c)::bigint)),
           lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda y, k: xor(y >> 1, 3988292384 * (y & 1))))) % 20 AS mark
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN mark = 4 THEN 'user' ELSE role END AS role,
         CASE mark WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g')
                   ELSE text END AS text,
         unnest(CASE WHEN mark = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM turns WHERE mark <> 0),
placed AS (
  SELECT conv_id, turn, role, text, substr(role, 1, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i
  FROM damaged),
faults AS (
  SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
rows_ AS (
  SELECT conv_id, turn, i, role, text, initial, blank, NOT blank AND again AS duplicate,
         NOT blank AND NOT again AND cut AS truncated,
         coalesce(before || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM faults),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal,
         count(*) AS n
  FROM rows_ GROUP BY conv_id),
steps(state, inserted, symbol, after) AS (VALUES
  (0, '', 's', 1), (0, '', 'u', 2), (0, 'I', 'a', 3), (0, 'II', 'u', 2), (0, 'III', 'a', 3),
  (1, '', 'u', 2), (1, 'I', 'a', 3), (1, 'II', 'u', 2), (1, 'III', 'a', 3),
  (2, '', 'a', 3), (2, 'I', 'u', 2), (2, 'II', 'a', 3), (2, 'III', 'u', 2),
  (3, '', 'u', 2), (3, 'I', 'a', 3), (3, 'II', 'u', 2), (3, 'III', 'a', 3)),
moves AS (
  SELECT state, after, inserted, symbol, letter, 2 * length(inserted) + extra AS cost
  FROM steps, (VALUES ('K', 0), ('R', 2)) AS l(letter, extra)
  WHERE letter = 'K' OR symbol <> 's'
  UNION ALL SELECT unnest([0, 1, 2, 3]), unnest([0, 1, 2, 3]), '', NULL, 'D', 3),
walk AS (
  SELECT conv_id, 0 AS i, 0 AS state, {'cost': 0, 'audit': ''} AS best FROM counts
  UNION ALL
  SELECT w.conv_id, r.i, m.after, min({
           'cost': w.best.cost + m.cost + CASE WHEN r.truncated AND m.letter <> 'D' THEN 1
                                               ELSE 0 END,
           'audit': w.best.audit || m.inserted || m.letter})
  FROM walk w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
  JOIN moves m ON m.state = w.state AND (m.letter = 'D' OR NOT (r.blank OR r.duplicate))
       AND (m.letter <> 'K' OR m.symbol = r.initial)
  GROUP BY w.conv_id, r.i, m.after),
audits AS (
  SELECT w.conv_id, min({'cost': w.best.cost + e.cost, 'audit': w.best.audit || e.tail}) AS best
  FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i
  JOIN (VALUES (0, 0, ''), (1, 4, 'II'), (2, 2, 'I'), (3, 0, '')) AS e(state, cost, tail)
       ON e.state = w.state
  GROUP BY w.conv_id),
letters AS (
  SELECT conv_id, unnest(range(1, length(best.audit) + 1)) AS pos,
         unnest(string_split(best.audit, '')) AS letter
  FROM audits WHERE best.audit <> ''),
numbered AS (
  SELECT conv_id, pos, letter,
         count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i,
         count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY pos) AS o
  FROM letters),
outputs AS (
  SELECT n.conv_id, n.o, n.letter, r.role, r.text,
         max(CASE WHEN n.o = 1 AND n.letter = 'K' AND r.initial = 's' THEN 1 ELSE 0 END)
           OVER (PARTITION BY n.conv_id) AS shift
  FROM numbered n LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM n.conv_id AND r.i = n.i
       AND n.letter <> 'I'
  WHERE n.letter <> 'D'),
lines AS (
  SELECT conv_id, string_agg(
           CASE WHEN letter = 'K' THEN role WHEN (o - shift) % 2 = 1 THEN 'user'
                ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY o) AS said
  FROM outputs GROUP BY conv_id)
SELECT k.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank,
       coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
       coalesce(c.illegal, 0) AS illegal, coalesce(a.best.cost, 0)::bigint AS cost,
       coalesce(a.best.audit, '') AS audit, sha256(coalesce(l.said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM k.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM k.conv_id
LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM k.conv_id
"""
