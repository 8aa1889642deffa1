"""Shards of equal row counts by balanced label propagation over linked documents.

Documents with equal texts are linked through a node that stands for their group (a large group
through one node per block of rows, so that no node outgrows a shard).  Linked documents start
in evenly dealt shards; in each round a node takes the shard that most of its documents have,
and the documents that are elsewhere ask to move there.  Quotas between each two shards allow
what the opposite moves and the free capacity make room for, so no shard ever exceeds its final
size.  Documents without links then fill what is free, which makes the counts of any two
shards differ by one at most (law ``rows``).

Every step is a join, grouping or window of DataFrames.  Ranks are taken by pieces (`cumulative`),
so neither a shard nor a group is sorted in one task.

Edge cases: a null text has no bytes and is linked with other null texts; a null id is an id like
any other; repeated rows are placed one by one; extra columns are ignored unless asked for; an
empty table gives an empty table; with fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftline.llm.common import Scratch, cumulative

#: A node links at most this part of a shard's rows; larger groups have several nodes.
BLOCKS_PER_SHARD = 2


def capacity(rows: int, shards: int) -> Column:
    """Final size of the shard in column ``shard``."""
    return (F.lit(rows // shards) + (F.col("shard") < rows % shards).cast("long"))


def block_order(block: list[str], row: str) -> Column:
    """A mixed long whose upper bits are the block's, so that blocks move as a whole."""
    upper = F.shiftleft(F.shiftrightunsigned(F.xxhash64(*block), 24), 24)
    return upper.bitwiseOR(F.col(row).bitwiseAND(F.lit((1 << 24) - 1)))


def linked_rows(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows of groups of two or more, with the block that links them."""
    group = ["g1", "g2", "size"]
    large = rows.groupBy(*group).agg(F.count("*").alias("members")).where("members > 1")
    found = rows.join(large, group)
    return cumulative(found, group, F.col("h"), F.lit(1)).withColumn(
        "block", F.expr(f"before div {block_rows}")).drop("before", "members")


def allowed_moves(wishes: DataFrame, rows: int, shards: int) -> DataFrame:
    """Per (shard, wish) how many documents may move: swaps, then free places.

    ``wishes`` has one row per pair of shards with the number of documents that have the one
    and want the other (the same, if they stay): at most ``shards`` squared rows.
    """
    sizes = wishes.groupBy("shard").agg(F.sum("n").alias("held"))
    moves = wishes.where("shard <> wish")
    back = moves.select(F.col("wish").alias("shard"), F.col("shard").alias("wish"),
                        F.col("n").alias("back"))
    paired = moves.join(back, ["shard", "wish"], "left").withColumn(
        "swap", F.least("n", F.coalesce("back", F.lit(0))))
    free = wishes.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(
        sizes, "shard", "left").select(F.col("shard").alias("wish"), (
            capacity(rows, shards) - F.coalesce("held", F.lit(0))).alias("free"))
    earlier = Window.partitionBy("wish").orderBy("shard").rowsBetween(
        Window.unboundedPreceding, -1)
    paired = paired.join(free, "wish").withColumn("more", F.col("n") - F.col("swap"))
    paired = paired.withColumn("used", F.coalesce(F.sum("more").over(earlier), F.lit(0)))
    return paired.select("shard", "wish", (F.col("swap") + F.greatest(F.lit(0), F.least(
        F.col("more"), F.col("free") - F.col("used")))).alias("quota"))


def propagate(linked: DataFrame, rows: int, shards: int, rounds: int,
              scratch: Scratch) -> DataFrame:
    """Shards of linked rows after at most ``rounds`` rounds of balanced propagation."""
    block = ["g1", "g2", "size", "block"]
    state = scratch.table(cumulative(linked, [], F.xxhash64("h"), F.lit(1)).withColumn(
        "shard", (F.col("before") % shards).cast("int")).drop("before"), "labels")
    for _ in range(rounds):
        votes = state.groupBy(*block, "shard").agg(F.count("*").alias("votes"))
        # ties go by hash: wishes then run both ways between shards and can be swapped
        wish = votes.groupBy(*block).agg(F.max(F.struct(
            "votes", F.xxhash64(*block, "shard").alias("tie"), "shard")).alias("best"))
        asked = scratch.table(state.join(wish.select(*block, F.col("best.shard").alias("wish")),
                                         block), "wishes")
        quotas = scratch.table(allowed_moves(
            asked.groupBy("shard", "wish").agg(F.count("*").alias("n")), rows, shards), "quotas")
        if quotas.where("quota > 0").isEmpty():
            break
        ranked = cumulative(asked, ["shard", "wish"], block_order(block, "h"), F.lit(1))
        moved = ranked.join(F.broadcast(quotas), ["shard", "wish"], "left").withColumn(
            "shard", F.when(F.col("before") < F.col("quota"), F.col("wish"))
            .otherwise(F.col("shard")))
        state = scratch.table(moved.drop("wish", "before", "quota"), "labels")
    return state


def balanced_shards(docs: DataFrame, shards: int = 16, rounds: int = 6, seed: int = 5,
                    id_column: str = "doc_id", text_column: str = "text",
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the columns of ``keep``.

    ``slot`` numbers the rows of a shard from 0.  The broadcast table of quotas has at most
    ``shards`` squared rows.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = scratch.table(docs.select(
        F.col(id_column).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text_column).alias("g1"),
        F.xxhash64(F.lit(seed), F.col(text_column).isNull(), F.crc32(text), text).alias("g2"),
        F.xxhash64(F.lit(seed), id_column, text_column, *keep).alias("h"),
        F.struct(*keep, F.lit(law := "rows").alias("law")).alias("kept")), "rows")
    count = rows.count()
    block_rows = max(1, count // (shards * BLOCKS_PER_SHARD))
    linked = linked_rows(rows, block_rows).drop("block") if not count else propagate(
        linked_rows(rows, block_rows), count, shards, rounds, scratch).drop("block")
    alone = rows.join(rows.groupBy("g1", "g2", "size").agg(F.count("*").alias("members"))
                      .where("members = 1").drop("members"), ["g1", "g2", "size"], "left_semi")
    if not count:
        placed = linked.withColumn("shard", F.lit(0))
    else:
        held = linked.groupBy("shard").agg(F.count("*").alias("held"))
        places = docs.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
        ends = places.join(held, "shard", "left").withColumn("end", F.sum(
            capacity(count, shards) - F.coalesce("held", F.lit(0))).over(
                Window.orderBy("shard")))
        ends = ends.agg(F.array_sort(F.collect_list("end")).alias("ends"))
        filled = cumulative(alone, [], F.xxhash64("h"), F.lit(1)).withColumn("ends", ends.scalar())
        placed = linked.unionByName(filled.withColumn("shard", F.size(F.filter(
            "ends", lambda end: end <= F.col("before")))).drop("ends", "before"))
    slots = cumulative(placed, ["shard"], F.xxhash64("h", F.lit(seed)), F.lit(1))
    return scratch.result(slots.select(
        "doc_id", "size", "text_crc32", F.col("kept.law").alias("law"), "shard",
        F.col("before").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"kept.{c}").alias(c) for c in keep]), "shards")
