"""Ordered analytics that stay parallel inside one key.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in one task, so a
session with a third of the data would run on one core.  Here every key is cut
into blocks of its ordering column.  The sort runs per (key, block); what must
cross a block border (last row, row count, running sum) is a mergeable
aggregate of one row per block, combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftline.session import is_materialised, materialise

BLOCK_COLUMN = "_block"


def block_of(order: Column, width: int | float) -> Column:
    """Block number of a numeric ordering column."""
    return F.floor(order / F.lit(width))


def _window(keys, *order):
    return Window.partitionBy(*keys).orderBy(*order)


def lag_in_order(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str],
                 block_width: int | float) -> DataFrame:
    """Previous row's values per key, in ``order``.

    ``columns`` maps a source column to the name of its lagged copy.  The first
    column of ``order`` must be numeric; it defines the blocks.
    """
    block = df.withColumn(BLOCK_COLUMN, block_of(F.col(order[0]), block_width))
    payload = F.struct(*[F.col(name) for name in columns])
    tails = block.groupBy(*keys, BLOCK_COLUMN).agg(
        F.max_by(payload, F.struct(*order)).alias("_tail"))
    carried = tails.select(
        *keys, BLOCK_COLUMN,
        F.lag("_tail").over(_window(keys, BLOCK_COLUMN)).alias("_carry"))
    inside = _window([*keys, BLOCK_COLUMN], *order)
    lagged = block.withColumn("_previous", F.lag(payload).over(inside))
    joined = lagged.join(carried, [*keys, BLOCK_COLUMN], "left")
    return joined.select(
        *[F.col(name) for name in df.columns],
        *[F.coalesce(F.col("_previous"), F.col("_carry"))[source].alias(target)
          for source, target in columns.items()],
    )


BROADCAST_BYTES = 8 << 20


def per_key_join(rows: DataFrame, per_key: DataFrame, keys: list[str], order: Column,
                 block_width: int | float) -> DataFrame:
    """Add per-key values (one narrow row per key) to rows, whatever the key's size.

    ``per_key`` is checkpointed, unless it is already, and measured (rows times row width).  Up to ``BROADCAST_BYTES`` it
    is broadcast and the rows are not shuffled at all.  Beyond that the values
    are first copied to each (key, block) that occurs, and rows meet them
    there: a plain join on the key would gather a hot key in one task, and a
    later grouping on (key, ...) would accept that partitioning and keep it.
    """
    if not is_materialised(per_key):
        per_key = materialise(per_key)
    width = per_key._jdf.schema().defaultSize()
    if per_key.count() * width <= BROADCAST_BYTES:
        return rows.join(F.broadcast(per_key), keys)
    placed = rows.withColumn(BLOCK_COLUMN, block_of(order, block_width))
    blocks = placed.select(*keys, BLOCK_COLUMN).distinct().join(per_key, keys)
    return placed.join(blocks, [*keys, BLOCK_COLUMN]).drop(BLOCK_COLUMN)


def row_sequence(df: DataFrame, keys: list[str], order: list[str], block_width: int | float,
                 name: str = "row_index") -> DataFrame:
    """Zero-based position of every row of a key, in ``order``."""
    block = df.withColumn(BLOCK_COLUMN, block_of(F.col(order[0]), block_width))
    counts = block.groupBy(*keys, BLOCK_COLUMN).agg(F.count(F.lit(1)).alias("_rows"))
    before = _window(keys, BLOCK_COLUMN).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, BLOCK_COLUMN,
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = _window([*keys, BLOCK_COLUMN], *order)
    return (
        block.withColumn("_position", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, BLOCK_COLUMN])
        .select(*df.columns, (F.col("_offset") + F.col("_position")).alias(name))
    )


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values per key with their frequency: ties collapse before any sort."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_freq"))
    )


SALTS = 32


def cumulative_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Number of rows below each distinct value of its key (``_below``), and the total."""
    return running_sums(counts, keys, "_value", ["_freq"]).select(
        *keys, "_value", "_freq", F.col("total__freq").alias("_total"),
        F.col("before__freq").alias("_below"))


def running_max_before(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str,
                       block_width: int | float) -> DataFrame:
    """Greatest ``value`` among the rows of a key that stand before a row (null for the first).

    A block hands on the greatest value of all blocks up to it, so what began long before still
    shows many blocks later.
    """
    block = df.withColumns({BLOCK_COLUMN: block_of(F.col(order[0]), block_width), "_value": value})
    tops = block.groupBy(*keys, BLOCK_COLUMN).agg(F.max("_value").alias("_top"))
    carried = tops.select(*keys, BLOCK_COLUMN, F.max("_top").over(
        _window(keys, BLOCK_COLUMN).rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    inside = _window([*keys, BLOCK_COLUMN], *order).rowsBetween(Window.unboundedPreceding, -1)
    return block.withColumn("_inside", F.max("_value").over(inside)).join(
        carried, [*keys, BLOCK_COLUMN]).select(
        *df.columns, F.greatest("_inside", "_carry").alias(name))


def running_sums(df: DataFrame, keys: list[str], order: str, sums: list[str]) -> DataFrame:
    """``before_*`` and ``total_*`` of every column in ``sums``, over the rows of the same keys.

    ``order`` is unique within the keys.  Rows are sorted by one range shuffle, in as many parts as
    the session shuffles into, so a hot key is cut wherever it is large; parts carry their sums over.
    """
    placed = materialise(df.repartitionByRange(*keys, order).withColumn(
        "_part", F.spark_partition_id()))
    parts = placed.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    every = Window.partitionBy(*keys)
    earlier = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*keys, "_part", *[expr for c in sums for expr in (
        F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_carry_{c}"),
        F.sum(f"_sum_{c}").over(every).alias(f"total_{c}"))])
    inside = _window([*keys, "_part"], order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumns({
        f"_inside_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums
    }).join(carried, [*keys, "_part"]).select(
        *df.columns, *[(F.col(f"_carry_{c}") + F.col(f"_inside_{c}")).alias(f"before_{c}")
                       for c in sums], *[f"total_{c}" for c in sums])


def split_by_size(rows: DataFrame, keys: list[str], limit: int
                  ) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the keys with at most ``limit`` rows, and those of larger keys (None without any).

    Rows with a null key are dropped.  Only the larger keys are stored: one per ``limit`` rows at
    most, so they may be broadcast whatever the number of keys is.
    """
    for key in keys:
        rows = rows.filter(F.col(key).isNotNull())
    large = materialise(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(
        F.col("_rows") > limit).select(*keys))
    if large.isEmpty():
        return rows, None
    return rows.join(F.broadcast(large), keys, "left_anti"), rows.join(F.broadcast(large), keys)


def _every(keys):
    """All rows of a key, in the order ``_ranked`` needs, so that one sort serves both."""
    return _window(keys, "_piece", "_kept").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)


def _ranked(rows: DataFrame, keys: list[str], piece: Column, kept: Column) -> DataFrame:
    """Kept values of a key with the number of rows before them; others stand before their piece's."""
    value = F.col("_value")
    counts = rows.groupBy(*keys, piece.alias("_piece"), kept.alias("_kept")).agg(
        F.count(F.lit(1)).alias("_freq"), F.min(value).alias("_min"), F.max(value).alias("_max"))
    before = _window(keys, "_piece", "_kept").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumns({
        "_below": F.coalesce(F.sum("_freq").over(before), F.lit(0)),
        "_total": F.sum("_freq").over(_every(keys))})


def _order_statistics(outputs: dict[str, float]) -> dict[str, Column]:
    """Aggregates over the ranked rows of a key: the two neighbours of each quantile."""
    found = {}
    for name, probability in outputs.items():
        position = (F.col("_total") - 1) * F.lit(probability)
        for part, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = (F.col("_below") <= at) & (at < F.col("_below") + F.col("_freq"))
            value = F.when(F.col("_kept").isNotNull(), F.col("_kept")).otherwise(
                F.raise_error(F.lit("an order statistic lies outside its bracket")))
            found[f"_{name}_{part}"] = F.max(F.when(hit, value))
    return found


def _interpolated(outputs: dict[str, float]) -> list[Column]:
    columns = []
    for name, probability in outputs.items():
        position = (F.col("_total") - 1) * F.lit(probability)
        fraction = position - F.floor(position)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        columns.append((low + (high - low) * fraction).alias(name))
    return columns


def _quantiles(ranked: DataFrame, keys: list[str], outputs: dict[str, float],
               extent: bool) -> DataFrame:
    stats = ranked.groupBy(*keys).agg(
        F.max("_total").alias("_total"), F.min("_min").alias("minimum"),
        F.max("_max").alias("maximum"),
        *[c.alias(name) for name, c in _order_statistics(outputs).items()])
    columns = [F.col("_total").alias("row_count"), "minimum", "maximum"] if extent else []
    return stats.select(*keys, *columns, *_interpolated(outputs))


#: Keys of at most this many times ``accuracy`` rows are sorted by one task, larger ones are sketched.
GATHERED = 5


def exact_quantiles(df: DataFrame, keys: list[str], value: str, outputs: dict[str, float],
                    extent: bool = False, accuracy: int = 20_000) -> DataFrame:
    """Linear-interpolated quantiles per key, exact for groups of any size.

    ``outputs`` maps an output name to its probability; ``extent`` adds
    ``row_count``, ``minimum`` and ``maximum`` from the same pass.

    The distinct values of a key with at most ``GATHERED * accuracy`` rows are sorted in one place;
    larger keys go through `sketched_quantiles`.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_value"))
    gathered, large = split_by_size(rows, keys, GATHERED * accuracy)
    found = _quantiles(_ranked(gathered, keys, F.lit(0), F.col("_value")), keys, outputs, extent)
    return found if large is None else found.unionByName(
        sketched_quantiles(large, keys, "_value", outputs, extent, accuracy))


def sketched_quantiles(df: DataFrame, keys: list[str], value: str, outputs: dict[str, float],
                       extent: bool = False, accuracy: int = 20_000) -> DataFrame:
    """`exact_quantiles` of few large keys, by selection instead of sorting.

    A mergeable sketch, whose rank error is at most one in ``accuracy``, brackets each order
    statistic that is needed.  A second pass counts, without a shuffle of the values, what lies
    between the brackets, and keeps the values inside them: eight in ``accuracy`` of a key per
    quantile, or all of a key that has no more than ``accuracy``.  Only those are ordered.  An order
    statistic outside its bracket would be an error, and fails.  A sketch costs far more than the
    sort of a key of few rows, so those do not belong here.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_value"))
    margin = 4.0 / accuracy
    ends = [(max(0.0, p - margin), min(1.0, p + margin)) for p in outputs.values()]
    sketch = F.percentile_approx("_value", [p for pair in ends for p in pair], accuracy)
    facts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_total"), F.min("_value").alias("_min"),
        F.max("_value").alias("_max"), sketch.alias("_ends"))
    small, brackets, names = F.col("_total") <= accuracy, [], []
    for i, (low, high) in enumerate(ends):
        brackets += [
            F.when(small | F.lit(low == 0.0), F.col("_min")).otherwise(F.col("_ends")[2 * i])
            .alias(f"_low{i}"),
            F.when(small | F.lit(high == 1.0), F.col("_max")).otherwise(F.col("_ends")[2 * i + 1])
            .alias(f"_high{i}")]
        names.append((f"_low{i}", f"_high{i}"))
    spread = F.pmod(F.xxhash64("_value"), F.lit(SALTS))
    met = per_key_join(rows, facts.select(*keys, *brackets), keys, spread, 1)
    v, inside, piece = F.col("_value"), F.lit(False), F.lit(0)
    for low, high in names:
        inside = inside | v.between(F.col(low), F.col(high))
        piece = piece + (F.col(low) < v).cast("int") + (F.col(high) < v).cast("int")
    return _quantiles(_ranked(met, keys, piece, F.when(inside, v)), keys, outputs, extent)


def counts_with_quantiles(rows: DataFrame, keys: list[str], value: str,
                          outputs: dict[str, float]) -> DataFrame:
    """Distinct values per key, their frequency, and the quantiles of the key on each.

    For keys that one task may sort (see `split_by_size`): values and quantiles share the sort.
    """
    named = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_value"))
    ranked = _ranked(named, keys, F.lit(0), F.col("_value"))
    return ranked.withColumns({
        name: c.over(_every(keys)) for name, c in _order_statistics(outputs).items()
    }).select(*keys, F.col("_kept").alias("_value"), "_freq", *_interpolated(outputs))


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str = "average_rank") -> DataFrame:
    """One row per (key, distinct value): 1-based rank, ties sharing their mean rank."""
    ranked = cumulative_counts(value_counts(df, keys, value), keys)
    return ranked.select(
        *keys, F.col("_value").alias(value), F.col("_freq").alias("tie_count"),
        (F.col("_below") + (F.col("_freq") + 1) / F.lit(2.0)).alias(name))


def has_duplicates_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Later occurrences of a key, with the first occurrence's order columns as ``first_*``.

    The rows of a key are dealt by a salt from their order.  Each (key, salt) finds its first row
    by a mergeable minimum, the salts of a key agree on the first of all, and only repeated keys
    meet their rows again, by (key, salt): a key that fills a third of the table is spread.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    parts = salted.groupBy(*keys, "_salt").agg(
        F.min(F.struct(*order)).alias("_part"), F.count(F.lit(1)).alias("_rows"))
    every = Window.partitionBy(*keys)
    first = parts.select(
        *keys, "_salt", F.min("_part").over(every).alias("_first"),
        F.sum("_rows").over(every).alias("occurrences")).filter(F.col("occurrences") > 1)
    return (
        salted.join(first, [*keys, "_salt"])
        .filter(F.struct(*order) != F.col("_first"))
        .select(*df.columns, "occurrences",
                *[F.col("_first")[name].alias(f"first_{name}") for name in order])
    )
