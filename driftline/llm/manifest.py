"""Merkle manifests: a digest for every row, every partition and the whole dataset, with proofs.

A leaf is the digest of a row's fields.  Leaves of one language stand by id; every eight
consecutive nodes become one until a single one is left, the language's subroot; subroots stand
by language and meet in the same way in the root.  A proof lists, level by level, the digests
left and right of the node, so anyone who has a row can fold it up to the root.

Plan: ranks come from one range shuffle (`ranked`).  The octal digits of a rank say where a leaf
stands on every level, so `nested` groups them away one after another inside blocks of 4096
leaves: one shuffle by (language, block) serves all its groupings, and each grouping nests the
structs of the children in the struct of their parent.  Block digests are the leaves of the next
climb.  On the way back a block meets its one row of higher siblings in a grouping by block, and
transforms and explodes unfold its tree into leaves that carry their proofs.  No step holds more
than a block, and a hot language is many blocks.

Edge cases: a null field is ``-``, so it differs from an empty one; null ids and null languages
stand first; rows that share language and id stand by digest, and equal rows have the places next
to each other; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftline.llm.common import Scratch

#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that are grouped inside one block, of 8 ** LEVELS nodes.
LEVELS = 4


def digest_of(joined: Column) -> Column:
    return F.unhex(F.sha2(joined, 256))


def as_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def row_digest(text: Column | None = None) -> Column:
    """Digest of a row's fields, each ``-`` or its UTF-8 length, a colon and its value."""
    def field(name: str) -> Column:
        value = text if name == "text" and text is not None else F.col(name).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value),
                          F.lit("-"))

    return digest_of(F.concat(*[field(name) for name in FIELDS]))


def same(keys: list[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_{key}"))
    return condition


def ranked(frame: DataFrame, scratch: Scratch, keys: list[str], order: list[str]) -> DataFrame:
    """``rank`` from 0 and ``total`` of every row within its keys, in ascending order.

    One range shuffle sorts all rows, so a key of any size is spread; a piece of it then needs
    only the number of rows that the pieces before it hold.
    """
    rows = scratch.table(
        frame.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id()), "ranked")
    piece = F.shiftright("_at", 33)
    pieces = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], piece.alias("_piece")).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    every = Window.partitionBy(*[f"_{k}" for k in keys])
    earlier = every.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))) \
        .withColumn("total", F.sum("_rows").over(every))
    return rows.join(pieces, same(keys) & (piece == F.col("_piece"))).select(
        *frame.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("rank"), "total")


def nested(nodes: DataFrame, keys: list[str], rest: list[str]) -> DataFrame:
    """One row per block of nodes: the tree over them as a struct of its digest and its kids."""
    trees = nodes.select(
        *keys, "total", F.shiftright("rank", 3 * LEVELS).alias("block"), F.col("rank").alias("at"),
        F.struct("digest", *rest).alias("node")).repartition(*keys, "block")
    for level in range(LEVELS):
        trees = trees.groupBy(*keys, "total", "block", F.shiftright("at", 3).alias("up")).agg(
            F.array_sort(F.collect_list(F.struct("at", "node"))).alias("kids"))
        joined = F.array_join(F.transform("kids", lambda k: as_text(k["node"]["digest"])), "")
        trees = trees.select(
            *keys, "total", "block", F.col("up").alias("at"),
            F.struct(F.when(F.col("total") > 8 ** level, digest_of(joined))
                     .otherwise(F.col("kids")[0]["node"]["digest"]).alias("digest"),
                     F.transform("kids", lambda k: k["node"]).alias("kids")).alias("node"))
    return trees.select(*keys, "total", "block", F.col("node").alias("tree"))


def unfolded(blocks: DataFrame, keep: list[str], rest: list[str]) -> DataFrame:
    """The nodes of the blocks again, each with its siblings put before those of its block."""
    def side(first: Column, length: Column, level: int) -> Column:
        joined = F.array_join(F.transform(
            F.slice(F.col("tree.kids"), first, length), lambda k: as_text(k["digest"])), "")
        return F.when(F.col("total") > 8 ** level, joined)

    rows = blocks
    for level in reversed(range(LEVELS)):
        rows = rows.select("*", F.posexplode("tree.kids").alias("place", "kid"))
        sides = F.struct(
            side(F.lit(1), F.col("place"), level).alias("left"),
            side(F.col("place") + 2, F.size("tree.kids") - F.col("place") - 1, level)
            .alias("right"))
        rows = rows.select(*keep, "total", F.concat(F.array(sides), "proof").alias("proof"),
                           F.col("kid").alias("tree"))
    return rows.select(*keep, "proof", F.col("tree.digest").alias("digest"),
                       *[F.col(f"tree.{name}").alias(name) for name in rest])


def climb(nodes: DataFrame, scratch: Scratch, keys: list[str], rest: list[str],
          finish: Callable[[DataFrame], DataFrame], found: list[str]) -> DataFrame:
    """Every node (keys, digest, rest) with its proof and the columns ``found``.

    ``finish`` adds ``proof`` and ``found`` to the nodes that stand alone in their key.
    """
    most = nodes.agg(F.max("total")).first()[0] or 0
    if most <= 1:
        return finish(nodes.select(*keys, "digest", *rest))
    blocks = scratch.table(nested(nodes, keys, rest), "blocks")
    above = climb(blocks.select(
        *keys, "block", F.col("block").alias("rank"), F.col("tree.digest").alias("digest"),
        F.ceil(F.col("total") / 8 ** LEVELS).alias("total")),
        scratch, keys, ["block"], finish, found)
    # one row of either kind per block
    met = blocks.unionByName(above.drop("digest"), allowMissingColumns=True)
    met = met.groupBy(*keys, "block").agg(*[
        F.first(c, ignorenulls=True).alias(c) for c in ("total", "tree", "proof", *found)])
    return unfolded(met, [*keys, *found], rest)


def merkle_manifest(docs: DataFrame, **others: Column) -> DataFrame:
    """``lang``, ``doc_id``, ``leaf``, ``subroot``, ``root`` (binary) and ``proof`` of every row.

    ``proof`` is an array of (left, right), the hex digests beside the node on each level, null
    on levels that its language does not have.  ``others`` are digests that travel with a leaf.
    """
    scratch, rest = Scratch(docs.sparkSession), ["doc_id", *others]
    # texts are read and hashed once; what is sorted is narrow
    leaves = scratch.table(docs.select(
        "lang", "doc_id", row_digest().alias("digest"),
        *[c.alias(n) for n, c in others.items()]), "leaves")

    def rooted(nodes: DataFrame) -> DataFrame:
        empty = F.array().cast("array<struct<left: string, right: string>>")
        return nodes.withColumns({"root": F.col("digest"), "proof": empty})

    def languages(nodes: DataFrame) -> DataFrame:
        mine = [c for c in nodes.columns if c != "digest"]
        whole = ranked(nodes.withColumn("whole", F.lit(0)), scratch, ["whole"], ["lang"])
        return climb(whole, scratch, ["whole"], mine, rooted, ["root"]).drop("whole").withColumn(
            "subroot", F.col("digest"))

    out = climb(ranked(leaves, scratch, ["lang"], ["doc_id", "digest"]), scratch, ["lang"], rest,
                languages, ["subroot", "root"])
    return scratch.result(out.withColumnRenamed("digest", "leaf"), "manifest")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, as_text(leaf), lambda digest, side: F.when(
        side["left"].isNull(), digest).otherwise(
            F.sha2(F.concat(side["left"], digest, side["right"]), 256)))


def tampered_text() -> Column:
    """The text in lower case where 3 divides the checksum of the id."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(chosen, lower).otherwise(F.col("text"))


def tamper_check(docs: DataFrame) -> DataFrame:
    """Every row's digests, and whether its leaf, taken after tampering, still leads to the root."""
    manifest = merkle_manifest(docs, seen=row_digest(tampered_text()))
    siblings = F.array_join(F.transform("proof", lambda side: F.coalesce(
        F.concat(side["left"], side["right"]), F.lit(""))), "")
    return manifest.select(
        "doc_id", *[as_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.col("seen"), F.col("proof")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar)::varchar || ':' || {value}::varchar, '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(
        _sql_field(text if name == "text" else name) for name in FIELDS) + ")"


#: Checksum of the id, bit by bit; nodes, siblings and folds level by level.
MANIFEST_SQL = f"""
WITH RECURSIVE checked AS (
  SELECT *, xor(4294967295, list_reduce(
      list_prepend(4294967295::bigint,
                   list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
                            lambda y, k: xor(y >> 1, 3988292384 * (y & 1))))) % 3 = 0 AS chosen
  FROM documents),
leaves AS (
  SELECT doc_id, lang, {_sql_leaf("text")} AS leaf,
         {_sql_leaf("(CASE WHEN chosen THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
                    "'abcdefghijklmnopqrstuvwxyz') ELSE text END)")} AS seen
  FROM checked),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY lang) AS n
  FROM leaves),
nodes AS (
  SELECT lang, 0 AS level, idx, n, leaf AS digest FROM placed
  UNION ALL
  SELECT lang, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY lang, level, idx // 8, n),
subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place,
         count(*) OVER () AS n
  FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, place AS idx, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx))
  FROM upper WHERE n > 1 GROUP BY level, idx // 8, n),
sides AS (
  SELECT a.lang, a.level, a.idx,
         coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') || '|' ||
         coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS side
  FROM nodes a JOIN nodes b ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level
       AND a.idx // 8 = b.idx // 8
  WHERE a.n > 1 GROUP BY a.lang, a.level, a.idx),
upper_sides AS (
  SELECT a.level, a.idx,
         coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') || '|' ||
         coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS side
  FROM upper a JOIN upper b ON a.level = b.level AND a.idx // 8 = b.idx // 8
  WHERE a.n > 1 GROUP BY a.level, a.idx),
upper_proofs AS (
  SELECT r.lang, r.subroot,
         coalesce(list(s.side ORDER BY s.level) FILTER (s.side IS NOT NULL), []) AS proof
  FROM subroots r LEFT JOIN upper_sides s ON s.idx = r.place // (8 ** s.level)::bigint
  GROUP BY r.lang, r.subroot),
lower_proofs AS (
  SELECT p.lang, p.idx,
         coalesce(list(s.side ORDER BY s.level) FILTER (s.side IS NOT NULL), []) AS proof
  FROM placed p LEFT JOIN sides s ON s.lang IS NOT DISTINCT FROM p.lang
       AND s.idx = p.idx // (8 ** s.level)::bigint
  GROUP BY p.lang, p.idx),
proofs AS (
  SELECT p.doc_id, p.leaf, p.seen, u.subroot, (SELECT digest FROM upper WHERE n = 1) AS root,
         list_concat(l.proof, u.proof) AS proof
  FROM placed p
  JOIN lower_proofs l ON l.lang IS NOT DISTINCT FROM p.lang AND l.idx = p.idx
  JOIN upper_proofs u ON u.lang IS NOT DISTINCT FROM p.lang),
climbed AS (
  SELECT *, sha256(replace(array_to_string(proof, ''), '|', '')) AS proof_sha256,
         list_reduce(list_prepend(seen, proof), lambda a, b:
             sha256(split_part(b, '|', 1) || a || split_part(b, '|', 2))) AS folded_root
  FROM proofs)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM climbed
"""
