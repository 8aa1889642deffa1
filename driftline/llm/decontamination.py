"""Benchmark passages in whole documents by a prefix-filtered containment join.

Every window of an item is a short sequence of word shingles.  A document that holds the window
holds all its shingles, so one of them is a sufficient prefix: the rarest, by its count over
the whole corpus.  Documents are scanned for those prefix shingles only; a hit is joined with
the windows that chose the shingle, tested against the length and position that the window
needs around the hit, and verified word by word over the window.

Plan: both scans of the documents test each shingle against a bitmap of fixed size that a
scalar subquery builds from the benchmark, inside one array expression per row, so that only
possible hits leave the row, each with no more than ``2 * window - 1`` words around it.  The
only rows that are shuffled are those hits and one narrow row per document.  All steps are
DataFrame expressions.

Edge cases: words are lower-cased for A-Z only; a null or wordless text has no words and no
hits; a null or wordless item has no windows; an item with fewer words than the window is one
window; a null item id counts as an item whose id is the empty string; items that share an id
count once.  Repeated document rows each give a row; extra columns are ignored; with an empty
benchmark nothing is hit; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from driftline.llm.common import Scratch, bitmap, bitmap_bits, is_set

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts that the hits of one shingle are dealt into.
SALTS = 4
#: Between words: every ASCII character but digits and letters.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once per row however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), "")


def shingle_at(hashes: Column, at: Column, length: int) -> Column:
    """Hash of ``length`` words from the zero-based position ``at``, given the words' hashes."""
    return F.xxhash64(*[F.get(hashes, at + i if i else at) for i in range(length)])


def word_hashes(words: Column) -> Column:
    """Hashes of words in lower case, each by itself: in a text, its neighbours change a sigma."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def positions(words: Column, length: int) -> Column:
    last = F.size(words) - length
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def at_positions(hashes: Column, places: Column, length: int) -> Column:
    return F.transform(places, lambda i: F.struct(
        shingle_at(hashes, i, length).alias("shingle"), i.alias("at")))


def item_windows(benchmark: DataFrame, window: int, item_column: str,
                 text_column: str) -> DataFrame:
    """Distinct windows: words, and the ids (as text) of the items that hold them."""
    items = benchmark.select(
        F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item"),
        split_words(ascii_lower(F.col(text_column))).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    return (items.select("item", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
            .select("item", F.slice("words", F.col("at") + 1, window).alias("window"))
            .groupBy("window").agg(F.collect_set("item").alias("items")))


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """Every shingle of every window with its offset; shorter where the window is shorter."""
    parts = [windows.where(fits).select(
        "window", "items", F.lit(k).alias("k"),
        F.explode(let(
            word_hashes(F.col("window")),
            lambda h: at_positions(h, positions(h, k), k))).alias("s"))
        .select("window", "items", "k", F.col("s.shingle"), F.col("s.at").alias("offset"))
        for k, fits in [(shingle, F.size("window") >= shingle)]
        + [(k, F.size("window") == k) for k in range(1, shingle)]]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scan(text: Column, field: Column, lengths: list[int], bits: int) -> Column:
    """Word count of a text, and (shingle, at) of its shingles whose bit is set."""
    def found(hashes: Column, marks: Column) -> Column:
        parts = [at_positions(hashes, F.filter(positions(hashes, k), lambda i: is_set(
            marks, shingle_at(hashes, i, k), bits)), k) for k in lengths]
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    return let(word_hashes(split_words(text)), lambda hashes: let(
        field, lambda marks: F.struct(F.size(hashes).cast("long").alias("n_words"),
                                      found(hashes, marks).alias("found"))))


def prefix_shingles(docs: DataFrame, windows: DataFrame, shingle: int, bits: int,
                    text_column: str) -> DataFrame:
    """Per window its rarest shingle over the whole corpus, ties to the smaller hash."""
    every = window_shingles(windows, shingle)
    vocabulary = every.select("shingle", "k").distinct()
    marks = bitmap(vocabulary.select("shingle"), bits)
    marked = docs.select(F.col(text_column).alias("text"), marks.alias("marks"))
    # explode_outer: from an inner explode the optimizer derives a filter that scans twice
    seen = marked.select(F.explode_outer(scan(
        F.col("text"), F.col("marks"), used_lengths(every), bits)["found"]["shingle"])
        .alias("shingle"))
    counts = seen.groupBy("shingle").agg(F.count("*").alias("n"))
    return (every.join(counts, "shingle", "left")
            .groupBy("window", "items").agg(F.min(F.struct(
                F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset", "k")).alias("best"))
            .select("window", "items", "best.shingle", "best.offset", "best.k"))


def used_lengths(shingles: DataFrame) -> list[int]:
    return sorted(row.k for row in shingles.select("k").distinct().collect())


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3,
                  bits: int | None = None, id_column: str = "doc_id", text_column: str = "text",
                  item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """Per document row: id, hash of the text, words, hit words, items found (sorted, as text).

    The bitmap that travels to the tasks has ``bits`` bits, by default sixteen for each shingle
    of the benchmark up to 16 MB; more shingles let more rows leave the scan and change no result.
    Hits meet the prefixes by shingle and salt; the row itself meets none and is dealt by its hash.
    """
    scratch = Scratch(docs.sparkSession)
    windows = scratch.table(item_windows(benchmark, window, item_column, item_text_column),
                            "windows")
    shingles = window_shingles(windows, shingle)
    lengths = used_lengths(shingles)
    bits = bits or bitmap_bits(shingles.select("shingle").distinct().count())
    text = F.col(text_column)
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("text_hash"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("_crc"), text.alias("_text"))
    near = "struct<shingle: bigint, at: int, start: int, near: array<string>>"
    prefixes = None
    if lengths:
        prefixes = scratch.table(
            prefix_shingles(docs, windows, shingle, bits, text_column), "prefixes")
        rows = rows.withColumn("_marks", bitmap(prefixes.select("shingle"), bits))
        rows = rows.withColumn("_scan", scan(
            F.col("_text"), F.col("_marks"), used_lengths(prefixes), bits))
        reach = F.lit(window - 1)

        def around(found: Column) -> Column:
            return let(split_words(F.col("_text")), lambda words: F.transform(
                found, lambda s: F.struct(
                    s["shingle"].alias("shingle"), s["at"].alias("at"),
                    F.greatest(s["at"] - reach, F.lit(0)).alias("start"),
                    F.slice(words, F.greatest(s["at"] - reach, F.lit(0)) + 1,
                            2 * window - 1 + shingle).alias("near"))))

        rows = rows.select("doc_id", "text_hash", "_crc", F.col("_scan.n_words"), F.when(
            F.size("_scan.found") > 0, around(F.col("_scan.found"))).alias("_hits"))
    else:
        rows = rows.select("doc_id", "text_hash", "_crc", F.size(split_words(F.col("_text")))
                           .cast("long").alias("n_words"), F.lit(None).alias("_hits"))
    keys = ["doc_id", "text_hash", "_crc", "n_words"]
    match = "struct<start: int, stop: int, items: array<string>>"
    # the first element, null, stands for the row itself
    spread = rows.select(*keys, F.explode_outer(F.concat(
        F.array(F.lit(None).cast(near)), F.coalesce("_hits", F.array().cast(f"array<{near}>"))))
        .alias("hit"))
    if prefixes is None:
        matched = spread.withColumn("match", F.lit(None).cast(match))
    else:
        # rows themselves are no hits and meet nothing, dealt by their own hash
        is_hit = F.col("hit").isNotNull()
        dealt = prefixes.withColumnRenamed("shingle", "_key").withColumns({
            "_hit": F.lit(True),
            "_salt": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))})
        matched = spread.withColumns({
            "_key": F.coalesce("hit.shingle", F.xxhash64("doc_id", "text_hash")), "_hit": is_hit,
            "_salt": F.pmod(F.xxhash64("doc_id", "hit.at"), F.lit(SALTS))}).join(
            dealt, ["_key", "_hit", "_salt"], "left")
        start, length = F.col("hit.at") - F.col("offset"), F.size("window")
        fits = (start >= 0) & (start + length <= F.col("n_words"))
        same = F.transform(F.slice("hit.near", F.greatest(start, F.lit(0)) - F.col("hit.start") + 1,
                                   length), ascii_lower) == F.col("window")
        matched = matched.withColumn("match", F.when(fits & same, F.struct(
            start.cast("int").alias("start"), (start + length).cast("int").alias("stop"),
            "items").cast(match)))
    grouped = matched.groupBy(*keys).agg(
        F.collect_set("match").alias("m"), F.count_if(F.col("hit").isNull()).alias("rows"))
    covered = F.aggregate(
        F.array_sort("m"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], acc["upto"])))
            .alias("n"), F.greatest(acc["upto"], x["stop"]).alias("upto")))
    return scratch.result(grouped.select(
        "doc_id", "text_hash", "n_words", covered["n"].cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("m", lambda x: x["items"]))))
        .alias("items"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("col"),
        "contamination")


def contamination_digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


CONTAMINATION_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(
        coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
    SELECT DISTINCT item, least(len(w), 10) AS n,
        array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b
          WHERE len(w) > 0)),
grams AS (
    SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, i, grams.n, item FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n),
covered AS (SELECT r, count(DISTINCT p) AS n_hit
            FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""
