import random
import zlib
from collections import Counter, defaultdict

import pytest

from driftline.llm.sharding import balanced_shards

DOCS = "doc_id long, text string, lang string, shard string"


def check(rows, found, shards):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in found if r.doc_id is not None) == sorted(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
        for d, t, *_ in rows if d is not None)
    counts = Counter(r.shard for r in found)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert set(counts) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.law for r in found} <= {"rows"} and {r.grown_shard for r in found} <= {None}


def test_groups_stay_together_and_counts_are_even(spark):
    rng = random.Random(1)
    rows = [(i, f"text {i} é" * rng.randint(1, 9), "x", None) for i in range(300)]
    rows += [(1000 + i, f"copy {i // 5}", "y", None) for i in range(150)]
    rows += [(2000, None, None, None), (2001, "", None, None), (2001, "", None, None),
             (None, "z" * 300_000, None, None)]
    found = balanced_shards(spark.createDataFrame(rows, DOCS), keep=("lang",)).collect()
    check(rows, found, 16)
    homes = defaultdict(set)
    for r in found:
        if r.doc_id is not None and 1000 <= r.doc_id < 2000:
            homes[(r.doc_id - 1000) // 5].add(r.shard)
    assert sum(len(h) == 1 for h in homes.values()) >= 29
    again = balanced_shards(spark.createDataFrame(rows, DOCS).repartition(5), keep=("lang",))
    assert sorted(again.collect(), key=str) == sorted(found, key=str)


def test_a_group_of_a_third_of_all_rows_fills_few_shards(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}", None, None) for i in range(960)]
    found = balanced_shards(spark.createDataFrame(rows, DOCS)).collect()
    check(rows, found, 16)
    assert len({r.shard for r in found if r.doc_id % 3 == 0}) <= 11


def test_all_rows_linked_leaves_only_swaps(spark):
    rows = [(i, f"pair {i // 2}", None, None) for i in range(1200)]
    found = balanced_shards(spark.createDataFrame(rows, DOCS), shards=4, rounds=8).collect()
    check(rows, found, 4)
    home = {r.doc_id: r.shard for r in found}
    assert sum(home[2 * i] == home[2 * i + 1] for i in range(600)) > 500  # 150 by chance


@pytest.mark.parametrize("n", [0, 1, 5, 16])
def test_few_rows(spark, n):
    rows = [(i, "same", None, None) for i in range(n)]
    check(rows, balanced_shards(spark.createDataFrame(rows, DOCS)).collect(), 16)
