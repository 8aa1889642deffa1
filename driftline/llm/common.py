"""Small helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from driftline.session import shared_dir

#: The sixteen control and space characters that part words: U+0020 and U+0009 to U+000D.
SPACED_WORDS = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


#: Rows of whole texts that go to a Python worker at a time, which bounds what both sides hold.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to at most ``BATCH_ROWS`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices; at the end of the task, freed memory goes back to the system.

    Workers outlive their tasks, and what their allocators keep would add to what the next
    stage's tasks and the executor itself need.
    """
    for batch in batches:
        for low in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(low, BATCH_ROWS)
        del batch
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(frame: DataFrame, columns: list[str], function: Callable[..., Iterable[dict]],
                ddl: str) -> DataFrame:
    """Run ``function(batches)`` in every task.

    ``batches`` yields a tuple of Python lists, one per column, for each slice of rows; the
    function yields dicts of output columns (lists or arrays).
    """
    schema = schema_of(ddl)
    small_batches(frame.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        rows = (tuple(c.to_pylist() for c in batch.columns) for batch in slices(batches))
        for out in function(rows):
            arrays = [pa.array(out[f.name], type=f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return frame.select(*columns).mapInArrow(task, schema)


def written(frame: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends, all executors read it.

    The folder lies under ``spark.checkpoint.dir``.
    """
    spark = frame.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


class Scratch:
    """Intermediate tables of one operator call, in one folder that goes when the call ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = os.path.join(shared_dir(spark), f"scratch-{uuid.uuid4().hex}")

    def table(self, frame: DataFrame, label: str) -> DataFrame:
        path = os.path.join(self.folder, f"{label}-{uuid.uuid4().hex}")
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def result(self, frame: DataFrame, label: str) -> DataFrame:
        """The final rows, written outside the folder, which is then removed."""
        out = written(frame, label)
        self.close()
        return out

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(name: str, key, build: Callable[[], object]) -> object:
    """What ``build`` returns, built once per Python process.

    Functions travel to the workers by value, so a variable of their module would not outlive a
    task, and `functools.cache` would be looked up by name in a package the workers need not have.
    """
    store = sys.modules.setdefault("kept_by_tasks", types.ModuleType("kept_by_tasks")).__dict__
    if (name, key) not in store:
        store[name, key] = build()
    return store[name, key]


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from every fit: crc32 of the id as text is divisible by five (null id: fit)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def address(value: Column, bits: int) -> tuple[Column, Column]:
    """Index of the long and of the bit in it; ``bits`` is a power of two."""
    slot = value.bitwiseAND(F.lit(bits - 1))
    return F.shiftright(slot, 6).cast("int"), slot.bitwiseAND(F.lit(63)).cast("int")


def bitmap(hashes: DataFrame, bits: int) -> Column:
    """Scalar subquery: ``bits`` bits as an array of longs, set where a hash (one column) falls.

    Its size is fixed, so it may travel to every task; more hashes let more values pass.
    """
    place, bit = address(F.col(hashes.columns[0]), bits)
    filled = (hashes.select(place.alias("place"), bit.alias("bit")).groupBy("place")
              .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("set")))
    places = hashes.sparkSession.range(bits // 64).withColumnRenamed("id", "place")
    return (places.join(filled, "place", "left")
            .agg(F.array_sort(F.collect_list(
                F.struct("place", F.coalesce("set", F.lit(0)).alias("set")))).alias("all"))
            .select(F.transform("all", lambda p: p["set"]))).scalar()


def is_set(field: Column, value: Column, bits: int) -> Column:
    place, bit = address(value, bits)
    return F.getbit(F.get(field, place), bit) == 1


def bitmap_bits(count: int) -> int:
    """Bits of a bitmap in which at most a sixteenth is set, up to 16 MB of them."""
    return 1 << min(max((16 * count).bit_length(), 16), 27)


def marked_rows(docs: DataFrame, named: DataFrame, bits: int | None) -> tuple[DataFrame, ...]:
    """(rows that ``named`` (doc_id, text_hash) cannot hold, the others beside its columns).

    Rows are structs ``doc``.  A bitmap, sized by the count of ``named``, tells them apart where
    they are read; only the others are shuffled to be told apart exactly (``_hash`` is then null
    or not).
    """
    gone = named.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    bits = bits or bitmap_bits(named.count())
    marks = bitmap(gone.select(F.xxhash64("_id", "_hash")), bits)
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("_doc_id"),
                        F.xxhash64("text").alias("_text_hash"), marks.alias("_marks"))
    marked = is_set(F.col("_marks"), F.xxhash64("_doc_id", "_text_hash"), bits)
    checked = whole.where(marked).join(gone.distinct(), F.col("_doc_id").eqNullSafe(
        F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    return whole.where(~marked).select("doc"), checked.select(
        "doc", "_doc_id", "_text_hash", "_hash")


def without(docs: DataFrame, dropped: DataFrame, bits: int | None = None) -> DataFrame:
    """Rows of ``docs`` whose id and text hash are not in ``dropped`` (doc_id, text_hash)."""
    clear, checked = marked_rows(docs, dropped, bits)
    return clear.unionByName(checked.where("_hash is null").select("doc")).select("doc.*")


def once_each(docs: DataFrame, repeated: DataFrame, bits: int | None = None) -> DataFrame:
    """``docs`` with one row of each id and text hash in ``repeated``; only those are grouped.

    Of rows that differ in other columns the first by its JSON text stays.
    """
    clear, checked = marked_rows(docs, repeated, bits)
    first = checked.where("_hash is not null").groupBy("_doc_id", "_text_hash").agg(
        F.min_by("doc", F.to_json("doc")).alias("doc"))
    return clear.unionByName(checked.where("_hash is null").select("doc")).unionByName(
        first.select("doc")).select("doc.*")


def piece_of(order: Column, pieces: int = 256) -> Column:
    """The piece of `cumulative` that an order value falls into."""
    return F.shiftrightunsigned(order, 40) % pieces


def cumulative(frame: DataFrame, keys: list[str], order: Column, weight: Column,
               pieces: int = 256) -> DataFrame:
    """``before``: the sum of ``weight`` over rows of the same keys that stand earlier.

    ``order`` must be a well mixed long; its upper bits cut every key into equal pieces, so a
    key that holds a third of all rows is still spread over many tasks.  Rows stand by piece,
    then by order.  Piece sums (at most ``pieces`` per key) carry over between pieces.  Null
    keys are keys.
    """
    w = frame.withColumns({"_order": order, "_weight": weight.cast("long")})
    # dealt by piece: an earlier dealing by the keys alone would leave a hot key in one task
    w = w.withColumn("_piece", piece_of(F.col("_order"), pieces)).repartition(*keys, "_piece")
    names = [f"_k{i}" for i in range(len(keys))]
    rank_in_piece = Window.partitionBy(*keys, "_piece").orderBy("_order").rowsBetween(
        Window.unboundedPreceding, -1)
    sums = (w.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)],
                      F.col("_piece").alias("_p")).agg(F.sum("_weight").alias("_sum")))
    earlier = Window.partitionBy(*names).orderBy("_p").rowsBetween(
        Window.unboundedPreceding, -1)
    sums = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    condition = F.col("_piece") == F.col("_p")
    for k, n in zip(keys, names):
        condition = condition & F.col(k).eqNullSafe(F.col(n))
    return (w.withColumn("_inside", F.coalesce(F.sum("_weight").over(rank_in_piece), F.lit(0)))
            .join(sums, condition)
            .withColumn("before", F.col("_offset") + F.col("_inside"))
            .drop("_order", "_weight", "_piece", "_inside", "_p", "_sum", "_offset", *names))
