"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard of the vectors.

Equal vectors form one class, so copies cannot crowd a graph; a class keeps its smallest ids, as
many as an answer can use.  Classes are dealt to shards of bounded size by hash.  In a shard,
points join the graph in growing batches: a greedy beam search from the medoid proposes
neighbours for each point of a batch, and pruning with a relaxed distance keeps near and diverse
ones; the kept edges are also added backwards, and full lists are pruned again.  The graph is built
over directions: a coordinate that levels the norms would outweigh what tells neighbours apart.
The search then orders its beam by inner product, as distances in a space with that coordinate.

Queries are grouped into blocks, and every block beam-searches every shard; a task searches a few
blocks in one shard, whose graph is copied to as many tasks as its blocks need.  The best of all
shards are ranked by the exact inner product in double precision, ties to the smaller id.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part,
nor do rows with a null id; vectors of different dimension never meet; rows that repeat an id and
a vector count once; with fewer candidates than asked for, all that are found are returned;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from driftline.llm.common import Scratch, map_batches, schema_of

#: Beam entries that are expanded together, and points that join a graph or search it together.
EXPANDED, TOGETHER = 4, 512
#: Query blocks whose numbers agree above this many bits are searched by one task per shard.
TEAM_BITS = 3
#: Parts in which the ids of a class are ranked before they are ranked together.
ID_PARTS = 64
SHARD = ("shard bigint, dim int, start bigint, vectors binary, edges binary, ids binary, "
         "offsets binary")


def usable(vector: Column) -> Column:
    """Vectors that take part: finite throughout, and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def distances(points: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own list of points (id -1: infinite)."""
    gap = points[ids] - queries[:, None, :]
    return np.where(ids >= 0, np.einsum("qkd,qkd->qk", gap, gap), np.inf)


def beam(points: np.ndarray, edges: np.ndarray, queries: np.ndarray, start: int,
         width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: none) and distances of the ``width`` nearest points that greedy search meets."""
    count = len(queries)
    ids = np.full((count, width), -1, np.int64)
    ids[:, 0] = start
    near = distances(points, ids, queries)
    open_ = ids >= 0
    rows = np.arange(count)
    while len(rows):
        waiting = np.where(open_[rows], near[rows], np.inf)
        best = np.argpartition(waiting, min(EXPANDED, width) - 1, axis=1)[:, :EXPANDED]
        real = np.isfinite(np.take_along_axis(waiting, best, axis=1))
        going = real[:, 0] | real.any(axis=1)
        rows, best, real = rows[going], best[going], real[going]
        if not len(rows):
            break
        own = ids[rows]
        chosen = np.where(real, np.take_along_axis(own, best, axis=1), -1)
        open_[rows[:, None], best] = False
        found = np.where(chosen[:, :, None] >= 0, edges[chosen], -1).reshape(len(rows), -1)
        found.sort(axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        seen = np.zeros((len(rows), len(points) + 1), bool)
        np.put_along_axis(seen, own, True, axis=1)  # -1 marks the spare last column
        found[np.take_along_axis(seen, found, axis=1)] = -1
        new = distances(points, found, queries[rows])
        every = np.concatenate([near[rows], new], axis=1)
        keep = np.argpartition(every, width - 1, axis=1)[:, :width]
        near[rows] = np.take_along_axis(every, keep, axis=1)
        ids[rows] = np.take_along_axis(np.concatenate([own, found], axis=1), keep, axis=1)
        open_[rows] = np.take_along_axis(
            np.concatenate([open_[rows], found >= 0], axis=1), keep, axis=1)
        ids[rows] = np.where(np.isfinite(near[rows]), ids[rows], -1)
    return ids, near


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int,
                 relaxed: float) -> np.ndarray:
    """Neighbours of each point: repeatedly its nearest candidate, which removes those that are
    ``relaxed`` times closer to it than to the point."""
    here = points[own]
    candidates = np.where(candidates == own[:, None], -1, candidates)
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    near = distances(points, candidates, here)
    vectors = points[candidates]
    out = np.full((len(own), degree), -1, np.int64)
    left, row = near.copy(), np.arange(len(own))
    for slot in range(degree):
        best = left.argmin(axis=1)
        some = np.isfinite(left[row, best])
        if not some.any():
            break
        out[:, slot] = np.where(some, candidates[row, best], -1)
        gap = vectors - vectors[row, best][:, None, :]
        covered = relaxed ** 2 * np.einsum("qkd,qkd->qk", gap, gap) <= near
        left[covered & some[:, None]] = np.inf
        left[row, best] = np.inf
    return out


def add_backwards(points: np.ndarray, edges: np.ndarray, own: np.ndarray, degree: int,
                  relaxed: float) -> None:
    """Adds each new edge's reverse; a list that overflows is pruned to ``degree`` again."""
    source = np.repeat(own, edges.shape[1])
    target = edges[own].ravel()
    source, target = source[target >= 0], target[target >= 0]
    gap = points[source] - points[target]
    order = np.lexsort((np.einsum("kd,kd->k", gap, gap), target))
    source, target = source[order], target[order]
    nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
    held = (edges[nodes] >= 0).sum(axis=1)
    place = np.arange(len(target)) - np.repeat(first, counts)
    at = np.repeat(held, counts) + place
    roomy = np.repeat(held + counts <= edges.shape[1], counts)
    edges[target[roomy], at[roomy]] = source[roomy]
    full = np.flatnonzero(held + counts > edges.shape[1])
    new = np.full((len(nodes), edges.shape[1]), -1, np.int64)
    fits = ~roomy & (place < edges.shape[1])
    new[np.repeat(np.arange(len(nodes)), counts)[fits], place[fits]] = source[fits]
    prune_lists(points, edges, nodes[full], degree, relaxed, new[full])


def prune_lists(points: np.ndarray, edges: np.ndarray, nodes: np.ndarray, degree: int,
                relaxed: float, new: np.ndarray) -> None:
    for low in range(0, len(nodes), TOGETHER):
        part = slice(low, low + TOGETHER)
        kept = robust_prune(points, nodes[part], np.concatenate(
            [edges[nodes[part]], new[part]], axis=1), degree, relaxed)
        edges[nodes[part]] = -1
        edges[nodes[part], :degree] = kept


def build_graph(vectors: np.ndarray, degree: int, width: int, relaxed: float,
                seed: int = 3) -> tuple[np.ndarray, int]:
    """Edges (-1: none) and the start of a graph over the directions of the vectors."""
    norms = np.sqrt(np.einsum("kd,kd->k", vectors, vectors))
    points = (vectors / norms[:, None]).astype(np.float32)
    start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    edges = np.full((len(points), 2 * degree), -1, np.int64)
    order = np.random.default_rng(seed).permutation(len(points))
    order = order[order != start]
    low, size = 0, 1
    while low < len(order):
        own = order[low:low + size]
        found, _ = beam(points, edges, points[own], start, width)
        edges[own, :degree] = robust_prune(points, own, found, degree, relaxed)
        add_backwards(points, edges, own, degree, relaxed)
        low, size = low + size, min(2 * size, TOGETHER)
    long = np.flatnonzero((edges >= 0).sum(axis=1) > degree)
    prune_lists(points, edges, long, degree, relaxed, np.empty((len(long), 0), np.int64))
    return edges[:, :degree], start


def shard_graphs(classes: DataFrame, degree: int, width: int, relaxed: float) -> DataFrame:
    """One row per shard: its vectors, edges, start, and the ids of each class."""
    schema = schema_of(SHARD)

    def build(table: pa.Table) -> pa.Table:
        shard, dim = table.column("shard")[0].as_py(), table.column("dim")[0].as_py()
        vectors = table.column("vector").combine_chunks().flatten().to_numpy(
            zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        ids = table.column("ids").to_pylist()
        edges, start = build_graph(vectors, degree, width, relaxed)
        offsets = np.cumsum([0, *map(len, ids)])
        flat = np.array([i for own in ids for i in own], np.int64)
        return pa.Table.from_pylist([{
            "shard": shard, "dim": dim, "start": start, "vectors": vectors.tobytes(),
            "edges": edges.astype(np.int32).tobytes(), "ids": flat.tobytes(),
            "offsets": offsets.astype(np.int64).tobytes()}], schema=to_arrow_schema(schema))

    return classes.groupBy("shard", "dim").applyInArrow(build, schema)


def search_shard(vectors, edges, start, ids, offsets, queries, query_ids, k, width) -> Iterator:
    """(query id, id, score) of the ``k`` best rows of a shard for each query."""
    norms = np.einsum("kd,kd->k", vectors, vectors)
    points = np.column_stack([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))])
    points = (points / np.sqrt(norms.max())).astype(np.float32)
    lengths = np.sqrt(np.einsum("kd,kd->k", queries, queries))
    asked = np.column_stack([queries / lengths[:, None], np.zeros(len(queries))])
    width = min(max(width, k + 1), max(len(vectors), 1))
    for low in range(0, len(queries), TOGETHER):
        found, _ = beam(points, edges, asked[low:low + TOGETHER].astype(np.float32), start, width)
        for query, own, hits in zip(queries[low:], query_ids[low:], found):
            hits = hits[hits >= 0]
            scores = np.einsum("kd,d->k", vectors[hits], query)
            rows = []
            for at in np.argsort(-scores, kind="stable"):
                if len(rows) >= k and scores[at] < rows[-1][0]:
                    break
                mine = ids[offsets[hits[at]]:offsets[hits[at] + 1]]
                rows += [(float(scores[at]), int(i)) for i in mine if i != own]
            rows.sort(key=lambda r: (-r[0], r[1]))
            yield from ((own, i, score) for score, i in rows[:k])


def nearest(table: DataFrame, is_query: Column, k: int = 20, shard_rows: int = 16_384,
            degree: int = 32, build_width: int = 64, width: int = 160, relaxed: float = 1.2,
            block_rows: int = 1024, id_column: str = "vec_id",
            vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found of every query row.

    ``shard_rows`` bounds what one task indexes and ``block_rows`` what one searches for, both
    in expectation.
    """
    scratch = Scratch(table.sparkSession)
    rows = scratch.table(table.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(vector_column).cast("array<double>").alias("vector"), is_query.alias("asks"))
        .where(F.col("id").isNotNull() & usable(F.col("vector")))
        .withColumns({"dim": F.size("vector"), "h1": F.xxhash64("vector"),
                      "h2": F.xxhash64(F.lit(1), "vector")}), "rows")
    key = ["h1", "h2", "dim"]
    part = Window.partitionBy(*key, "part").orderBy("id")
    few = (rows.select(*key, "id", "vector", F.pmod(F.xxhash64("id"), F.lit(ID_PARTS))
                       .alias("part")).withColumn("place", F.dense_rank().over(part))
           .where(F.col("place") <= k + 1))
    classes = scratch.table(few.groupBy(*key).agg(
        F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"),
        F.any_value("vector").alias("vector")), "classes")
    sizes = {r.dim: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return scratch.result(table.sparkSession.createDataFrame(
            [], "query_id long, rank int, vec_id long, score double"), "nearest")
    shards = {dim: -(-n // shard_rows) for dim, n in sizes.items()}
    of_dim = F.create_map(*[F.lit(x) for pair in shards.items() for x in pair])
    dealt = classes.withColumn("shard", F.pmod("h1", of_dim[F.col("dim")]).cast("long"))
    graphs = scratch.table(shard_graphs(dealt.select("shard", "dim", "vector", "ids"), degree,
                                        build_width, relaxed), "graphs")
    asked = rows.where("asks").select("id", "vector", "dim").distinct()
    blocks = max(1, -(-asked.count() // block_rows))
    blocked = asked.groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(
        F.collect_list("id").alias("query_ids"),
        F.flatten(F.collect_list("vector")).alias("queries"))
    blocked = blocked.withColumn("team", F.shiftright("block", TEAM_BITS))
    teams = F.sequence(F.lit(0).cast("long"), F.lit((blocks - 1) >> TEAM_BITS).cast("long"))
    pairs = blocked.withColumn("shard", F.explode(F.sequence(
        F.lit(0).cast("long"), of_dim[F.col("dim")].cast("long") - 1))).join(
            graphs.withColumn("team", F.explode(teams)), ["shard", "dim", "team"])

    def scan(batches: Iterator) -> Iterator[dict]:
        for batch in batches:
            for (dim, own, queries, start, vectors, edges, ids, offsets) in zip(*batch):
                vectors = np.frombuffer(vectors).reshape(-1, dim)
                out = list(search_shard(
                    vectors, np.frombuffer(edges, np.int32).reshape(len(vectors), -1)
                    .astype(np.int64), start, np.frombuffer(ids, np.int64),
                    np.frombuffer(offsets, np.int64), np.array(queries).reshape(-1, dim),
                    own, k, width))
                yield {"query_id": [r[0] for r in out], "vec_id": [r[1] for r in out],
                       "score": [r[2] for r in out]}

    found = map_batches(pairs, ["dim", "query_ids", "queries", "start", "vectors", "edges", "ids",
                                "offsets"], scan, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return scratch.result(found.withColumn("rank", F.row_number().over(best)).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
