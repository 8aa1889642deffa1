"""Mixing sources to target weights with exact quotas drawn down a splitting tree.

Sources, ordered by code point with null last, weigh ``weights`` in turn and share ``epochs``
times all words; a target never exceeds ``most_epochs`` times its source, and what is above is
shared again by weight among the others.

Documents are cut into blocks of at most ``block_words`` words.  A source gives whole passes over
all its blocks, and for the rest blocks in a permuted (hash) order until the target is met; the
block at the border is trimmed, so a source gives its target to the word.  The blocks a source
gives are its quota.  A binary tree over the output shards splits the vector of quotas by
multivariate hypergeometric draws, so every shard gets an exact number of blocks of each source
and equal totals; the blocks of a source go to the shards in a second permuted order, without
overlap, and a third one shuffles each shard.

The driver sees one row per source (name, words, blocks).  All orders come from seeded hashes, so
reruns agree.

Edge cases: a null text has no words; documents without words are never drawn; a null source is a
source; repeated rows are drawn one by one; extra columns are ignored; an empty table gives an
empty mix, and sources without words have the target 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from driftline.llm.common import SPACED_WORDS, Scratch, cumulative, piece_of, written

#: From this many blocks on numpy has no hypergeometric draw, and `by_inversion` takes over.
NUMPY_DRAW = 1_000_000_000
#: Standard deviations on both sides of the mode that an inversion covers; beyond lies 1e-40.
REACH = 14


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACED_WORDS)).cast("long")


def target_words(sizes: list[int], weights: tuple[int, ...], epochs: float,
                 most_epochs: float) -> list[float]:
    """Targets of sources given in their order; shares above the limit go to the others."""
    limits = [most_epochs * s for s in sizes]
    shares = [weights[i % len(weights)] for i in range(len(sizes))]
    targets, free, left = [0.0] * len(sizes), set(range(len(sizes))), epochs * sum(sizes)
    while free:
        unit = left / sum(shares[i] for i in free)
        above = {i for i in free if unit * shares[i] > limits[i]}
        for i in above or free:
            targets[i] = limits[i] if above else unit * shares[i]
        left -= sum(limits[i] for i in above)
        free = free - above if above else set()
    return targets


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if good + bad < NUMPY_DRAW:
        return int(rng.hypergeometric(good, bad, draws))
    return by_inversion(rng, good, bad, draws)


def by_inversion(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """A hypergeometric draw of any size: the distribution around its mode, inverted.

    Neighbouring probabilities differ by a ratio of four counts, so no factorials are needed; the
    range grows with the root of the draws (30 million values for 1e13 blocks).
    """
    low, high = max(0, draws - bad), min(draws, good)
    share = good / (good + bad)
    spread = (draws * share * (1 - share) * (good + bad - draws) / max(1, good + bad - 1)) ** 0.5
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    low, high = max(low, mode - int(REACH * spread) - 50), min(high, mode + int(REACH * spread) + 50)
    k = np.arange(high - low, dtype=np.float64)  # from each value to the next
    steps = (np.log((good - low - k) / (low + 1 + k))
             + np.log((draws - low - k) / (bad - draws + low + 1 + k)))
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(weights - weights.max()))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def split_quotas(quotas: list[int], shards: int, rng: np.random.Generator) -> list[list[int]]:
    """Per shard the blocks of each source; columns add up to ``quotas``, rows are even."""
    if shards == 1:
        return [quotas]
    left = shards // 2
    rest, draws, half = sum(quotas), sum(quotas) * left // shards, []
    for q in quotas:
        rest -= q
        half.append(hypergeometric(rng, q, rest, draws) if draws else 0)
        draws -= half[-1]
    return (split_quotas(half, left, rng)
            + split_quotas([q - h for q, h in zip(quotas, half)], shards - left, rng))


def source_plan(measured: DataFrame, weights, epochs, most_epochs) -> DataFrame:
    """source, s (its place in order), source_size, target, words to take."""
    found = [(r.source, int(r.size)) for r in
             measured.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    found.sort(key=lambda row: (row[0] is None, row[0] or ""))
    targets = target_words([size for _, size in found], weights, epochs, most_epochs)
    return measured.sparkSession.createDataFrame(
        [(name, i, size, float(t), round(t)) for i, ((name, size), t) in
         enumerate(zip(found, targets))],
        "source string, s int, source_size long, target double, words long")


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's plan, whole passes and the words of the last pass."""
    named = plan.withColumnRenamed("source", "_source").withColumns({
        "passes": F.expr("if(source_size > 0, words div source_size, 0L)"),
        "rest": F.expr("if(source_size > 0, words % source_size, 0L)")})
    return rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), epochs: float = 1.5,
        most_epochs: float = 2.0, shards: int = 16, block_words: int = 512, seed: int = 11,
        id_column: str = "doc_id", source_column: str = "source",
        text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, blocks).

    documents: doc_id, source, size, source_size, target, row (a key of the row).
    blocks: row, doc_id, source, word_from, words, shard, position (gapless in its shard); word
    ``word_from`` is zero-based in its document.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"),
        word_count(F.col(text_column)).alias("size"),
        F.xxhash64(F.lit(seed), id_column, source_column, text_column).alias("h"),
        F.crc32(F.coalesce(F.col(text_column), F.lit(""))).alias("h2"))
    same = Window.partitionBy("h", "h2", "doc_id", "source").orderBy("size")
    rows = scratch.table(rows.withColumn("copy", F.row_number().over(same)), "rows")
    plan = source_plan(rows, weights, epochs, most_epochs)
    documents = with_plan(rows, plan).withColumn("row", F.struct("h", "h2", "copy"))
    cut = (documents.where("size > 0")
           .withColumn("word_from", F.explode(F.sequence(
               F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_words).cast("long"))))
           .withColumn("words", F.least(F.col("size") - F.col("word_from"), F.lit(block_words)))
           .withColumn("order", F.xxhash64("h", "h2", "copy", "word_from")))
    keys = ["row", "doc_id", "source", "s", "word_from", "order", "words"]
    whole = cut.where("passes > 0").select(
        *keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col("passes"))).alias("epoch"))
    part = cumulative(cut.where("rest > 0").select(*keys, "rest"), ["s"], F.col("order"),
                      F.col("words"))
    part = part.where("before < rest").withColumn(
        "words", F.least(F.col("words"), F.col("rest") - F.col("before")))
    drawn = scratch.table(whole.unionByName(part.select(*keys, F.lit(0).cast("long").alias(
        "epoch"))).withColumn("order", F.xxhash64("order", "epoch", F.lit(seed))), "drawn")
    quotas = {r.s: r["n"] for r in drawn.groupBy("s").agg(F.count("*").alias("n")).collect()}
    names = sorted(quotas)
    table = split_quotas([quotas[s] for s in names], shards, np.random.default_rng(seed))
    ends = np.cumsum(np.array(table, dtype=np.int64).reshape(shards, len(names)), axis=0)
    bounds = docs.sparkSession.createDataFrame(
        [(s, [int(x) for x in ends[:, i]]) for i, s in enumerate(names)], "s int, ends array<long>")
    placed = cumulative(drawn, ["s"], F.col("order"), F.lit(1)).join(bounds, "s").withColumn(
        "shard", F.size(F.filter("ends", lambda end: end <= F.col("before")))).drop("before")
    placed = cumulative(placed, ["shard"], F.xxhash64("order", F.lit(seed + 1)), F.lit(1))
    blocks = placed.select("row", "doc_id", "source", "word_from", "words", "shard",
                           F.col("before").alias("position"))
    blocks = written(blocks, "mix-blocks")
    return scratch.result(documents.select(
        "doc_id", "source", "size", "source_size", "target", "row"), "mix-documents"), blocks


def mixed_sizes(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per document row the words that the mix takes of it."""
    taken = blocks.groupBy("row").agg(F.sum("words").alias("taken"))
    return documents.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


#: A round takes the documents of at most ``cap`` words from one place in the order to another.
ROUNDS = ("array<struct<cap: bigint, low: struct<piece: bigint, order: bigint>, "
          "high: struct<piece: bigint, order: bigint>>>")
FIRST = (-1, 0)


def place_of(order: Column) -> Column:
    """Place of an order value as `cumulative` has it."""
    return F.struct(piece_of(order).cast("long").alias("piece"), order.alias("order"))


def taken_in(rounds: Column, size: Column, order: Column) -> Column:
    place = place_of(order)
    return F.exists(rounds, lambda r: (size <= r["cap"]) & (place >= r["low"]) & (
        place <= r["high"]))


def last_pass(rows: DataFrame, rests: dict[int, int], scratch: Scratch) -> dict[int, list[tuple]]:
    """Per source the rounds that draw whole documents (s, order, size) worth ``rests`` words.

    A round goes through the documents that still fit, in their order, up to the first that does
    not fit behind the others, and takes these or, if it alone is larger, that one.  What is
    left halves at least, so a source has at most as many rounds as its rest has bits.  When
    nothing fits, the smallest document left is taken if the rest is then nearer.
    """
    rounds, left = {s: [] for s in rests}, dict(rests)

    def free(sources: list[int]) -> DataFrame:
        state = scratch.table(rows.sparkSession.createDataFrame(
            [(s, left[s], rounds[s]) for s in sources],
            f"s int, left long, rounds {ROUNDS}").coalesce(1), "state")
        return rows.join(state, "s").where(~taken_in(
            F.col("rounds"), F.col("size"), F.col("order"))).drop("rounds")

    place = [piece_of(F.col("order")).cast("long").alias("piece"), F.col("order")]
    active = sorted(s for s in left if left[s] > 0)
    while active:
        upto = F.col("before") + F.col("size")
        found = cumulative(free(active).where("size <= left"), ["s"], F.col("order"),
                           F.col("size")).groupBy("s").agg(
            F.max(F.when(upto <= F.col("left"), F.struct(*place, upto.alias("words")))).alias(
                "fits"),
            F.min(F.when(upto > F.col("left"), F.struct(*place, "size"))).alias("over")).collect()
        active = []
        for s, fits, over in found:
            words = fits.words if fits else 0
            if over is None or 2 * words >= left[s]:
                rounds[s].append((left[s], FIRST, (fits.piece, fits.order)))
            else:
                rounds[s].append((left[s], *[(over.piece, over.order)] * 2))
                words = over["size"]
            left[s] -= words
            if over is not None and left[s] > 0:
                active.append(s)
        active.sort()
    short = sorted(s for s in left if left[s] > 0)
    if short:
        for s, least in free(short).groupBy("s").agg(F.min(F.struct("size", *place))).collect():
            if least["size"] < 2 * left[s]:
                rounds[s].append((least["size"], *[(least.piece, least.order)] * 2))
    return rounds


def told_apart(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows whose ``order`` is in ``repeated`` (column _order) get orders of their own."""
    marked = rows.join(repeated, F.col("order") == F.col("_order"), "left")
    same = Window.partitionBy("order").orderBy(F.to_json("doc"))
    again = marked.where("_order is not null").withColumn("copy", F.row_number().over(same))
    return marked.where("_order is null").drop("_order").unionByName(again.withColumn(
        "order", F.xxhash64("order", "copy")).drop("_order", "copy"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), epochs: float = 1.5,
                  most_epochs: float = 2.0, seed: int = 11) -> DataFrame:
    """The mix in whole documents: rows repeat as often as they are drawn, columns stay.

    A source's last pass draws documents in a hash order and goes on past those that do not fit
    (`last_pass`), so a source misses its target by at most half of its smallest document that
    is left out.  The draw is a short list of hash ranges and size limits per source: the texts
    are filtered where they are read and never shuffled, unless rows repeat.

    Documents are neither cut into blocks nor dealt to shards, so this form has no splitting
    tree; `mix` has both.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(
        F.struct(*docs.columns).alias("doc"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("order"))
    measured = scratch.table(rows.drop("doc"), "rows")
    repeated = measured.where("size > 0").groupBy(F.col("order").alias("_order")).count().where(
        "count > 1").drop("count")
    if not repeated.isEmpty():
        rows = told_apart(rows, written(repeated, "mix-repeated"))
        measured = scratch.table(rows.drop("doc"), "rows")
    plan = scratch.table(source_plan(measured, weights, epochs, most_epochs), "plan")
    rests = {r.s: r.rest for r in with_plan(plan.select("source"), plan).where("rest > 0")
             .select("s", "rest").collect()}
    drawn = last_pass(with_plan(measured, plan).where("rest > 0 and size > 0")
                      .select("s", "order", "size"), rests, scratch)
    rounds = docs.sparkSession.createDataFrame(list(drawn.items()), f"s int, rounds {ROUNDS}")
    plan = scratch.result(plan.join(rounds, "s", "left").coalesce(1), "mix-plan")
    again = F.coalesce(taken_in(F.col("rounds"), F.col("size"), F.col("order")), F.lit(False))
    times = F.when(F.col("size") > 0, F.col("passes") + again.cast("long")).otherwise(0)
    return (with_plan(rows, plan).withColumn("times", times).where("times > 0")
            .withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
            .select("doc.*"))
