import os
import random

from pyspark.sql import functions as F

from driftline.llm import common
from driftline.llm.common import Scratch, cumulative, without


def test_cumulative_is_a_running_sum_in_one_order_with_hot_and_null_keys(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.randrange(9)) for i in range(800)]
    frame = spark.createDataFrame(rows, "k string, i long, w long").withColumn("h", F.xxhash64("i"))
    got = cumulative(frame, ["k"], F.col("h"), F.col("w"), pieces=16).collect()
    assert len(got) == len(rows)
    for key in ("hot", "a", None):
        mine = sorted((r for r in got if r.k == key), key=lambda r: (
            ((r.h % 2 ** 64) >> 40) % 16, r.h))
        total = 0
        for r in mine:
            assert r.before == total
            total += r.w
    plain = cumulative(frame, [], F.col("h"), F.lit(1)).select("before").collect()
    assert sorted(r.before for r in plain) == list(range(800))


def test_without_is_exact_whatever_the_bitmap(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, "a", "x"), (None, "a", "x"),
                                  (None, None, "x"), (3, None, "x"), (1, "a", "y")],
                                 "doc_id long, text string, text_hash string")
    gone = docs.where("doc_id is null or (doc_id = 1 and text = 'a')").select(
        "doc_id", F.xxhash64("text").alias("text_hash"))
    for bits in (64, 1 << 16):
        left = without(docs, gone, bits)
        assert left.columns == docs.columns
        assert sorted(map(tuple, left.collect()), key=str) == [
            (1, "b", "x"), (2, "a", "x"), (3, None, "x")]
    assert without(docs, gone.limit(0)).count() == 7


def test_scratch_tables_go_and_the_result_stays(spark):
    scratch = Scratch(spark)
    table = scratch.table(spark.range(5), "part")
    out = scratch.result(table.where("id > 2"), "whole")
    assert not os.path.exists(scratch.folder.removeprefix("file:"))
    assert sorted(r.id for r in out.collect()) == [3, 4]


def test_once_each_groups_only_repeated_rows(spark):
    rows = [(i % 7, f"t{i % 5}", i % 2) for i in range(60)] + [(None, None, 1)] * 3 + [(1, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc int")
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    again = hashed.groupBy("doc_id", "text_hash").count().where("count > 1")
    got = common.once_each(docs, again)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(
        {repr((a, b, min(c for x, y, c in rows if (x, y) == (a, b)))) for a, b, _ in rows})
    kept = common.once_each(docs, again.where("doc_id = 3"), bits=64)
    others = [r for r in rows if r[0] != 3]
    assert sorted(map(repr, (tuple(r) for r in kept.where(
        "doc_id is null or doc_id <> 3").collect()))) == sorted(map(repr, others))


def test_bitmaps_grow_with_what_they_hold():
    assert [common.bitmap_bits(n) for n in (0, 10, 10 ** 5, 10 ** 6, 10 ** 12)] == [
        1 << 16, 1 << 16, 1 << 21, 1 << 24, 1 << 27]
