"""Block-wise ordered operators against plain brute force, with one dominant key."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from driftline.operators.ordered import (
    average_ranks, exact_quantiles, has_duplicates_of, lag_in_order, row_sequence)


@pytest.fixture(scope="module")
def rows(spark):
    """One key has two thirds of the rows; many equal timestamps and values."""
    rng = random.Random(7)
    data = [("hot" if i % 3 else f"k{i % 17}", rng.randrange(0, 4000), i, float(rng.randrange(0, 60)))
            for i in range(6000)]
    data += [("constant", i, 10_000 + i, 5.0) for i in range(50)] + [("single", 3, 20_000, 1.5)]
    return spark.createDataFrame(data, "key string, ts long, seq long, value double").cache()


def test_lag_equals_plain_window(rows):
    plain = rows.withColumn("prev", F.lag("value").over(
        Window.partitionBy("key").orderBy("ts", "seq")))
    ours = lag_in_order(rows, ["key"], ["ts", "seq"], {"value": "prev"}, 37)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, ours.collect()), key=str)


def test_lag_crosses_empty_blocks(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1000, 2.0)], "key string, ts long, v double")
    got = lag_in_order(df, ["key"], ["ts"], {"v": "p"}, 10).orderBy("ts").collect()
    assert [r.p for r in got] == [None, 1.0]


def test_row_sequence_equals_row_number(rows):
    plain = rows.withColumn("n", F.row_number().over(
        Window.partitionBy("key").orderBy("ts", "seq")) - 1)
    ours = row_sequence(rows, ["key"], ["ts", "seq"], 37, "n")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, ours.collect()))


def test_exact_quantiles_equal_numpy(rows):
    got = {r.key: r for r in exact_quantiles(
        rows, ["key"], "value", {"a": 0.25, "b": 0.5, "c": 0.99}).collect()}
    for key, part in rows.toPandas().groupby("key"):
        want = np.quantile(part["value"], [0.25, 0.5, 0.99])
        assert np.allclose([got[key].a, got[key].b, got[key].c], want)


def test_exact_quantiles_many_distinct_values(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=5000) ** 3, [1e12, -1e12], np.zeros(2500)])
    df = spark.createDataFrame(pd.DataFrame({"key": "x", "value": values}))
    got = exact_quantiles(df, ["key"], "value", {"a": 0.1, "b": 0.5, "c": 0.75}).first()
    assert np.allclose([got.a, got.b, got.c], np.quantile(values, [0.1, 0.5, 0.75]))


def test_exact_quantiles_sort_only_what_the_brackets_hold(spark):
    """A sketch of 100 samples over keys of 60,000 values: exact, and few values are kept."""
    rng = np.random.default_rng(3)
    values = {"normal": rng.normal(size=60_000), "ties": rng.integers(0, 9, 60_000) * 1.0,
              "steps": np.repeat(rng.normal(size=600), 100), "few": rng.normal(size=90),
              "skewed": rng.pareto(0.5, 60_000)}
    df = spark.createDataFrame(pd.concat(
        pd.DataFrame({"key": k, "value": v}) for k, v in values.items()))
    wanted = {"z": 0.0, "a": 0.03, "b": 0.5, "c": 0.5001, "d": 0.995, "o": 1.0}
    got = {r.key: r for r in exact_quantiles(
        df, ["key"], "value", wanted, extent=True, accuracy=100).collect()}
    for key, v in values.items():
        assert np.allclose([got[key][n] for n in wanted], np.quantile(v, list(wanted.values())),
                           rtol=1e-14, atol=0)
        assert (got[key].row_count, got[key].minimum, got[key].maximum) == (len(v), v.min(), v.max())


def test_average_ranks_equal_pandas(rows):
    frame = rows.toPandas()
    frame["want"] = frame.groupby("key")["value"].rank(method="average")
    want = {(r.key, r.value): r.want for r in frame.itertuples()}
    got = {(r.key, r.value): r.average_rank for r in average_ranks(rows, ["key"], "value").collect()}
    assert got == want


def test_later_duplicates(spark):
    df = spark.createDataFrame([("e", 3, "s1"), ("e", 1, "s0"), ("f", 2, "s0"), ("e", 2, "s2")],
                               "id string, seq int, owner string")
    got = has_duplicates_of(df, ["id"], ["seq", "owner"]).orderBy("seq").collect()
    assert [(r.seq, r.owner, r.first_owner, r.occurrences) for r in got] == [
        (2, "s2", "s0", 3), (3, "s1", "s0", 3)]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_per_key_join_both_ways(rows, monkeypatch, limit):
    from driftline.operators import ordered

    monkeypatch.setattr(ordered, "BROADCAST_BYTES", limit)
    bounds = rows.filter("key <> 'single'").groupBy("key").agg(F.min("ts").alias("first"))
    joined = ordered.per_key_join(rows, bounds, ["key"], F.col("ts"), 50)
    want = rows.join(bounds, "key")
    assert sorted(map(tuple, joined.select(*want.columns).collect())) == sorted(
        map(tuple, want.collect()))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == (limit > 0) or limit == 0


def test_coalesced_intervals_span_blocks(spark):
    from driftline.operators.monitoring import coalesced_intervals, longest_exposure

    rng = random.Random(8)
    rows = [("hot", i, rng.randrange(0, 40_000)) for i in range(900)]
    rows += [("long", 2000 + i, 100 * i) for i in range(300)]  # one interval over 60 blocks
    rows += [("nested", 5000, 0), ("nested", 5001, 500), ("nested", 5002, 20_011), ("one", 6000, 7)]
    data = [(s, seq, at, at + (20_000 if seq == 5000 else rng.randrange(0, 120)
                               if s == "hot" else 90)) for s, seq, at in rows]
    df = spark.createDataFrame(
        data, "session_id string, seq long, start_timestamp long, end_timestamp long")
    want = []
    for session in {r[0] for r in data}:
        merged = []
        for _, _, a, b in sorted((r for r in data if r[0] == session), key=lambda r: (r[2], r[1])):
            if merged and a <= merged[-1][1] + 10:
                merged[-1] = [merged[-1][0], max(merged[-1][1], b), merged[-1][2] + 1]
            else:
                merged.append([a, b, 1])
        want += [(session, *m) for m in merged]
    for width in (500, 7, 10 ** 9):
        got = coalesced_intervals(df, 10, width)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    longest = {r.session_id: r for r in longest_exposure(got).collect()}
    assert longest["long"].longest_exposure_ms == 29_990 and longest["nested"].exposure_count == 2


def test_exact_quantiles_of_small_keys_need_no_sketch(spark):
    """Keys on both sides of the limit agree with numpy; null keys have no row; no sketch per small key."""
    rng = np.random.default_rng(4)
    values = {"small": rng.normal(size=40), "one": rng.normal(size=1), "large": rng.normal(size=900)}
    df = spark.createDataFrame(
        [(k, float(v)) for k, vs in values.items() for v in vs] + [(None, 1.0), ("none", None)],
        "key string, value double")
    got = {r.key: r for r in exact_quantiles(
        df, ["key"], "value", {"a": 0.25, "b": 0.9}, extent=True, accuracy=100).collect()}
    assert set(got) == set(values)
    for key, v in values.items():
        assert np.allclose([got[key].a, got[key].b], np.quantile(v, [0.25, 0.9]), rtol=1e-14, atol=0)
        assert (got[key].row_count, got[key].minimum, got[key].maximum) == (len(v), v.min(), v.max())
    plan = exact_quantiles(df, ["key"], "value", {"a": 0.25})._jdf.queryExecution().toString()
    assert "percentile_approx" not in plan and "Join" not in plan
