"""Jaccard self-join of documents on word n-grams by rare-first prefix filtering.

A document's set holds the distinct n-grams (default: five words) of its text; two documents
link when ``percent`` per cent of the union lies in the intersection.  The result is one row per
document with the component that its links form.

1. *Classes.* Documents with equal sets are one class, found by a signature of the set.
2. *Rare first.* Each task reports n-grams that repeat among runs of its classes; the most frequent
   (a table of bounded size) come last in the order of a set, all others by hash.  The order
   decides cost only: any order gives the same links.
3. *Prefixes.* Two sets that link share an n-gram among the first ``n - ceil(t * n) + 1`` of
   each, so only those postings are shuffled, once, by n-gram.  Frequent n-grams are salted.
4. *Stars.* Within an n-gram each class is paired with one class that lies close to the others,
   not with all others.  Pairs pass a length and a positional filter on the postings and a suffix filter
   (parity bitmaps of two bits a gram bound the symmetric difference from below); what is left
   is verified once on the texts.
5. *Rest.* Classes of one n-gram that the verified links leave in different components are
   paired across components and verified too, so no link that joins components is lost.

N-grams and sets are compared by 64-bit hashes.

Edge cases: a text with fewer words than n is one n-gram; a null or wordless text has an empty
set, links with nothing and is its own component.  Rows that repeat an id give a row each; a
component's id is its smallest non-null id (null if there is none).  Extra columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from driftline.llm.common import Scratch, bitmap, is_set, map_batches

#: N-grams of a task that are counted together to find frequent ones.
COUNTED_NGRAMS = 3_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def ngram_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        total = total * MULTIPLIER + hashes[i:len(hashes) - width + 1 + i]
    return np.unique(mixed(total))


def signature(grams: np.ndarray) -> int | None:
    """A signed 64-bit name of a set; none for the empty set."""
    if not len(grams):
        return None
    value = xxhash.xxh3_64_intdigest(grams.tobytes())
    return value - (1 << 64) if value >> 63 else value


def parity(grams: np.ndarray) -> bytes:
    """A bitmap of twice as many bits as grams or more: which bits an odd number falls on.

    Two bitmaps differ in no more bits than the sets differ in grams; the wider of two is
    folded to the other's width.
    """
    width = max(64, 1 << (2 * len(grams) - 1).bit_length())
    counts = np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(counts.astype(np.uint8), bitorder="little").tobytes()


def apart(parity_a: bytes, parity_b: bytes) -> int:
    """Least number of grams that are in one of two sets only, by their bitmaps."""
    width = min(len(parity_a), len(parity_b))
    both = [np.bitwise_xor.reduce(np.frombuffer(p, np.uint8).reshape(-1, width), axis=0)
            for p in (parity_a, parity_b)]
    return int(np.bitwise_count(both[0] ^ both[1]).sum())


def least_overlap(size_a, size_b, percent: int):
    """Smallest intersection of two sets of these sizes that links them."""
    return -(-percent * (size_a + size_b) // (100 + percent))


def repeated_ngrams(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that two or more of the sets hold, and how many do."""
    grams, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
    return grams[counts > 1].view(np.int64), counts[counts > 1]


def first_pass(docs: DataFrame, width: int, id_column: str, text_column: str) -> DataFrame:
    """Rows of two kinds: per document id, size, node (signature) and parity bitmap of its set;
    and per run of ``COUNTED_NGRAMS`` the n-grams that several of its classes hold, with the
    number of classes."""
    def scan(batches: Iterator) -> Iterator[dict]:
        held: dict = {}
        count = 0
        for ids, hashes, texts in batches:
            sets = [ngram_set(t, width) for t in texts]
            nodes = [signature(s) for s in sets]
            none = [None] * len(ids)
            yield {"doc_id": ids, "text_hash": hashes, "n_shingles": [len(s) for s in sets],
                   "node": nodes, "parity": [parity(s) if len(s) else None for s in sets],
                   "gram": none, "n": none}
            for node, grams in zip(nodes, sets):
                if node not in held:
                    held[node] = grams
                    count += len(grams)
            if count >= COUNTED_NGRAMS:
                yield counted(list(held.values()))
                held, count = {}, 0
        yield counted(list(held.values()))

    def counted(sets: list[np.ndarray]) -> dict:
        grams, counts = repeated_ngrams(sets)
        none = [None] * len(grams)
        return {"doc_id": none, "text_hash": none, "n_shingles": none, "node": none,
                "parity": none, "gram": grams, "n": counts}

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("hash"),
                       F.col(text_column).alias("text"))
    return map_batches(rows, ["doc_id", "hash", "text"], scan, f"doc_id {kind}, "
                       "text_hash bigint, n_shingles bigint, node bigint, parity binary, "
                       "gram bigint, n bigint")


def frequent_ngrams(found: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` n-grams that repeat most often within batches, with their counts."""
    found = (found.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n"))
             .where("n > 7").orderBy(F.desc("n"), "gram").limit(most).toPandas())
    found = found.assign(gram=found.gram.to_numpy(np.int64).view(np.uint64)).sort_values("gram")
    return found.gram.to_numpy(np.uint64), found.n.to_numpy(np.int64)


def prefix_postings(docs: DataFrame, width: int, percent: int, text_column: str,
                    frequent: tuple[np.ndarray, np.ndarray], salt_rows: int) -> DataFrame:
    """Postings of each class's prefix; a class that repeats in a task is posted once there.

    ``at`` holds the size of the set in its upper and the place of the n-gram in its lower half
    (narrow rows: this is the one large shuffle); ``salt`` is 0 where a gram is not salted.
    """
    grams, counts = frequent

    def counts_of(values: np.ndarray) -> np.ndarray:
        if not len(grams):
            return np.zeros(len(values), np.int64)
        at = np.minimum(np.searchsorted(grams, values), len(grams) - 1)
        return np.where(grams[at] == values, counts[at], 0)

    def scan(batches: Iterator) -> Iterator[dict]:
        seen = set()
        for (texts,) in batches:
            parts = []
            for text in texts:
                values = ngram_set(text, width)
                node = signature(values)
                if node is None or node in seen:
                    continue
                seen.add(node)
                size = len(values)
                often = counts_of(values)
                order = np.argsort(often, kind="stable")[:size + percent * -size // 100 + 1]
                salts = often[order] // salt_rows
                parts.append((values[order].view(np.int64), np.full(len(order), node),
                              (size << 32) + np.arange(len(order)),
                              np.where(salts, 1 + node % (salts + 1), 0)))
            columns = list(zip(*parts)) or [[np.empty(0, np.int64)]] * 4
            yield {n: np.concatenate(c) for n, c in zip(("gram", "node", "at", "salt"), columns)}

    return map_batches(docs, [text_column], scan,
                       "gram bigint, node bigint, at bigint, salt int")


def size_in(at: Column) -> Column:
    return F.shiftright(at, 32)


def place_in(at: Column) -> Column:
    return at.bitwiseAND(F.lit(0xFFFFFFFF))


def may_link(a: str, b: str, percent: int) -> Column:
    """Length and positional filter for two postings of one n-gram.

    Two sets of these sizes that link share an n-gram within even shorter prefixes, of
    ``size - needed + 1``; pairs that meet further behind meet there too.
    """
    def size(side: str) -> Column:
        return size_in(F.col(f"{side}.at"))

    def place(side: str) -> Column:
        return place_in(F.col(f"{side}.at"))

    length = 100 * F.least(size(a), size(b)) >= percent * F.greatest(size(a), size(b))
    needed = F.ceil((size(a) + size(b)) * percent / F.lit(100 + percent) - 1e-9)
    prefixes = (place(a) <= size(a) - needed) & (place(b) <= size(b) - needed)
    most = F.least(place(a), place(b)) + F.least(size(a) - place(a), size(b) - place(b))
    return length & prefixes & (most >= needed)


def ordered_pair(a: str, b: str) -> list[Column]:
    return [F.least(F.col(f"{a}.node"), F.col(f"{b}.node")).alias("a"),
            F.greatest(F.col(f"{a}.node"), F.col(f"{b}.node")).alias("b")]


def star_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """Each class with the first class of its n-gram (through its salt's first).

    The first class has the n-gram at the smallest place, so it has the fewest rarer n-grams of
    its own: among near copies it is one that lies close to the others.
    """
    ends = shared.select(F.struct("node", "at").alias("x"), "first")
    inner = ends.where(F.col("x.node") != F.col("first.node")).where(
        may_link("x", "first", percent)).select(*ordered_pair("x", "first"))
    heads = shared.where("salt > 0").select("gram", "first").distinct()
    heads = heads.withColumn("top", F.min("first").over(Window.partitionBy("gram")))
    outer = heads.where(F.col("first.node") != F.col("top.node")).where(
        may_link("first", "top", percent)).select(*ordered_pair("first", "top"))
    return inner.unionByName(outer).distinct()


def suffix_filtered(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps leave room for the overlap that their sizes need."""
    def scan(batches: Iterator) -> Iterator[dict]:
        for nodes_a, nodes_b, sizes_a, sizes_b, maps_a, maps_b in batches:
            keep = [i for i, (m, n, p, q) in enumerate(zip(sizes_a, sizes_b, maps_a, maps_b))
                    if apart(p, q) <= m + n - 2 * least_overlap(m, n, percent)]
            yield {"a": [nodes_a[i] for i in keep], "b": [nodes_b[i] for i in keep]}

    def side(name: str) -> DataFrame:
        return sketches.select(F.col("node").alias(name), F.col("n_shingles").alias(f"n_{name}"),
                               F.col("parity").alias(f"p_{name}"))

    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return map_batches(both, ["a", "b", "n_a", "n_b", "p_a", "p_b"], scan, "a bigint, b bigint")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose sets link, by the texts of both classes."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def scan(batches: Iterator) -> Iterator[dict]:
        last, set_a = None, None
        for nodes_a, nodes_b, texts_a, texts_b in batches:
            keep = []
            for i, (node, text_a, text_b) in enumerate(zip(nodes_a, texts_a, texts_b)):
                if node != last:
                    last, set_a = node, ngram_set(text_a, width)
                set_b = ngram_set(text_b, width)
                common = len(np.intersect1d(set_a, set_b, assume_unique=True))
                if 100 * common >= percent * (len(set_a) + len(set_b) - common):
                    keep.append(i)
            yield {"a": [nodes_a[i] for i in keep], "b": [nodes_b[i] for i in keep]}

    both = pairs.join(right, "b").join(left, "a")
    return map_batches(both, ["a", "b", "text_a", "text_b"], scan, "a bigint, b bigint").distinct()


def texts_of(pairs: DataFrame, rows: DataFrame, docs: DataFrame, width: int, id_column: str,
             text_column: str, bits: int, scratch: Scratch) -> DataFrame:
    """(node, text) of every class in a pair.

    The documents are first thinned by a bitmap of fixed size over the wanted ids, so hardly
    any text but the wanted ones is hashed again and shuffled.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = scratch.table(rows.join(nodes, "node", "left_semi").groupBy("node").agg(
        F.min("doc_id").alias("doc_id")), "wanted")
    marks = bitmap(wanted.select(F.xxhash64("doc_id")), bits)
    some = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"),
                       marks.alias("marks"))
    some = some.where(is_set(F.col("marks"), F.xxhash64("doc_id"), bits)).drop("marks")

    def scan(batches: Iterator) -> Iterator[dict]:
        for ids, texts in batches:
            yield {"id": ids, "sign": [signature(ngram_set(t, width)) for t in texts],
                   "text": texts}

    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = map_batches(some, ["doc_id", "text"], scan, f"id {kind}, sign bigint, text string")
    return scratch.table(signed.join(wanted, (F.col("sign") == F.col("node"))
                               & F.col("id").eqNullSafe(F.col("doc_id")))
                   .select("node", "text"), "texts")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label: the smallest node of its component, by alternating large and small stars.

    Every round is written to the shared folder.  Neighbourhoods meet as grouped minima and
    joins, never as lists, so a hub of any degree does not gather in one place.
    """
    def least(frame: DataFrame) -> DataFrame:
        return frame.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m"))

    links = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.join(least(large), "u")
        links = scratch.table(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .unionByName(small.select("u", F.col("m").alias("v")))
                        .where("u <> v").distinct(), "links")
        row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == row:
            break
        state = row
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def residual_pairs(shared: DataFrame, labels: DataFrame, known: DataFrame,
                   percent: int, scratch: Scratch) -> DataFrame:
    """Pairs of one n-gram whose components differ, that pass the filters and are new."""
    members = scratch.table(shared.join(labels, "node", "left").select(
        "gram", "node", "at", F.coalesce("label", "node").alias("label")), "members")
    split = members.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    rest = scratch.table(members.join(split.where("low <> high").select("gram"), "gram"), "rest")
    found = rest.alias("x").join(rest.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (
        F.col("x.label") < F.col("y.label")) & may_link("x", "y", percent))
    return found.select(*ordered_pair("x", "y")).distinct().join(known, ["a", "b"], "left_anti")


def ngram_components(docs: DataFrame, width: int = 5, percent: int = 75,
                     id_column: str = "doc_id", text_column: str = "text",
                     most_frequent: int = 100_000, salt_rows: int = 20_000,
                     bits: int = 1 << 22) -> DataFrame:
    """doc_id, text_hash, n_shingles and component_id of every row.

    ``most_frequent`` bounds the table of frequent n-grams that tasks receive, ``salt_rows`` the
    postings of a frequent n-gram that meet in one place, ``bits`` the bitmap of wanted ids.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.table(first_pass(docs, width, id_column, text_column), "found")
    rows = found.where("gram is null").select("doc_id", "text_hash", "n_shingles", "node")
    sketches = scratch.table(found.where("node is not null").groupBy("node").agg(
        F.any_value("n_shingles").alias("n_shingles"), F.any_value("parity").alias("parity")),
        "sketches")
    frequent = frequent_ngrams(found, most_frequent)
    postings = prefix_postings(docs, width, percent, text_column, frequent, salt_rows)
    bucket = Window.partitionBy("gram", "salt")
    shared = scratch.table(
        postings.withColumns({
            "first": F.min(F.struct(place_in(F.col("at")).alias("place"), "node", "at"))
            .over(bucket), "least": F.min("node").over(bucket), "last": F.max("node").over(bucket)})
        .where((F.col("salt") > 0) | (F.col("least") != F.col("last"))).drop("least", "last")
        .distinct(), "shared")

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = scratch.table(suffix_filtered(pairs, sketches, percent), "near")
        texts = texts_of(pairs, rows, docs, width, id_column, text_column, bits, scratch)
        return verified(pairs, texts, width, percent)

    pairs = scratch.table(star_pairs(shared, percent), "pairs")
    links = scratch.table(checked(pairs), "links")
    labels = scratch.table(components(links, scratch), "labels")
    more = scratch.table(residual_pairs(shared, labels, pairs, percent, scratch), "pairs")
    if not more.isEmpty():
        links = scratch.table(links.unionByName(checked(more)), "links")
        labels = components(links, scratch)
    return scratch.result(labelled(rows, labels), "components")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Component ids of all rows: the smallest id of any row of any class of the component."""
    by_class = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = by_class.join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(least, "label").select("node", "component_id")
    return rows.join(named, "node", "left").select(
        "doc_id", "text_hash", "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        .alias("component_id"))


def one_of_each(found: DataFrame) -> DataFrame:
    """(doc_id, text_hash) of the rows that go when one row of each component stays: that with
    the component's id, of several such that with the smallest text hash.  Rows without
    n-grams stay."""
    rows = found.where("n_shingles > 0").select("doc_id", "text_hash", "component_id")
    stays = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(
        "component_id").agg(F.min("text_hash").alias("first"))
    stays = stays.withColumnRenamed("component_id", "_component")
    return rows.join(stays, F.col("component_id").eqNullSafe(F.col("_component"))).where(
        ~F.col("doc_id").eqNullSafe(F.col("component_id")) | (F.col("text_hash") != F.col("first"))
    ).select("doc_id", "text_hash").distinct()


JACCARD_SQL = r"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
s AS (
    SELECT DISTINCT r, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') AS g
    FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d
          WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pair AS (
    SELECT x.r AS a, y.r AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r
    GROUP BY ALL),
link AS (
    SELECT a, b FROM pair JOIN n na ON na.r = a JOIN n nb ON nb.r = b
    WHERE 100 * common >= 75 * (na.n + nb.n - common)),
reach AS (
    SELECT r AS a, r AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link
    ON reach.b = link.a),
least AS (SELECT reach.a AS r, min(o.doc_id) AS component_id
          FROM reach JOIN d o ON o.r = reach.b GROUP BY reach.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id
FROM d JOIN least USING (r) LEFT JOIN n USING (r)
"""
