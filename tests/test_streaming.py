import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions.ordinal import ENGINEERING_MODEL
from driftline.operators.windows import WindowSpec
from driftline.streaming import scoring, windows

GEOMETRY = WindowSpec(window=20_000, stride=10_000, expected=None, minimum=15,
                      interval_low=500, interval_high=3000)
SPEC = scoring.ScoringSpec(GEOMETRY, baseline=10_000, delay=10_000, idle=60_000)
ROWS = "session string, at timestamp, value double"
CLOSE = [("z", 200)]  # moves the watermark past all windows


def stream_of(spark, folder, batches):
    """A stream whose micro-batches are the given lists of (session, second)."""
    os.makedirs(folder)
    for i, batch in enumerate(batches):
        rows = [(s, float(t), float(t) * 2 + len(s)) for s, t in batch]
        path = f"{folder}/part-{i}.parquet"
        spark.createDataFrame(rows, "session string, second double, value double").select(
            "session", F.timestamp_seconds(F.col("second") + 1000).alias("at"),
            "value").toPandas().to_parquet(path, coerce_timestamps="us", index=False)
        os.utime(path, (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(folder)


def scored(spark, folder, batches, spec=SPEC):
    found = scoring.score_available(stream_of(spark, folder, batches), ENGINEERING_MODEL, spec,
                                    "session", "at", "value", F.lit(True))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def seconds(a, b):
    return [("a", t) for t in range(a, b)]


@pytest.mark.parametrize("batches", [
    [seconds(5, 12), seconds(2, 5) + seconds(12, 80)],  # earlier rows come later
    [seconds(5, 30), seconds(22, 25), seconds(30, 80)],
    [seconds(20, 28), seconds(18, 20), [], seconds(28, 61), seconds(61, 80)]])
def test_borders_of_batches_do_not_show(spark, tmp_path, batches):
    given = [b for b in batches if b]
    once = scored(spark, str(tmp_path / "once"), [sum(given, []), CLOSE])
    cut = scored(spark, str(tmp_path / "cut"), [*given, CLOSE])
    assert cut == once
    assert len(once) >= 5 and once[0][2] == (1020 + min(t for _, t in sum(given, []))) * 1000


def by_hand(rows, spec, upto):
    """(session, window, end, count, reason, baseline, mean, range) of rows (session, second)."""
    out, g = [], spec.windows
    for session in {s for s, _ in rows}:
        at = np.array(sorted(round(1000 * (t + 1000)) for s, t in rows if s == session))
        value = (at / 1000 - 1000) * 2 + len(session)
        base = np.median(value[at < at[0] + spec.baseline])
        for k in range(10_000):
            end = at[0] + g.window + k * g.stride
            if end > min(at[-1], upto):
                break
            held = (at > end - g.window) & (at <= end)
            steps = np.diff(at[held])
            reason = ("DUPLICATE_TIMESTAMP" if (steps == 0).any() else
                      "PARTIAL_WINDOW" if held.sum() < g.minimum else
                      "TIMING_OUT_OF_TOLERANCE" if (
                          (steps < g.interval_low) | (steps > g.interval_high)).any() else "")
            v = value[held]
            out.append((session, k, int(end), int(held.sum()), reason, float(base),
                        *([None, None] if reason else [round(v.mean() - base, 6),
                                                       round(v.max() - v.min(), 6)])))
    return sorted(out, key=repr)


def test_validity_is_that_of_batch_windows_and_one_session_may_hold_a_third(spark, tmp_path):
    draw = np.random.default_rng(2)
    rows = [("busy", t / 4) for t in range(8, 800)] + [("busy", 60.25), ("busy", 91.0)]
    rows += [(f"s{i}", float(t)) for i in range(9) for t in range(i, 180)
             if not (i == 3 and 50 < t < 58) and not (i == 4 and t % 3)]
    rows += [("s5", 77.2), ("s6", 80.0)]
    rows.sort(key=lambda r: r[1] + draw.uniform(0, 9))  # late, but within the delay
    cuts = [0, 300, 310, 1500, len(rows)]
    got = scored(spark, str(tmp_path / "in"), [
        rows[a:b] for a, b in zip(cuts, cuts[1:])] + [[("z", 400)]])
    want = by_hand(rows, SPEC, 1_390_000)
    assert [(r[0], r[1], r[2], r[3], r[5], r[6]) for r in got] == [w[:6] for w in want]
    assert {w[4] for w in want} == {"", "DUPLICATE_TIMESTAMP", "PARTIAL_WINDOW",
                                    "TIMING_OUT_OF_TOLERANCE"}
    for g, w in zip(got, want):
        assert g[4] == (w[4] == "") and (g[12] is None) == (w[4] != "")
        assert (g[7], g[11]) == (w[6], w[7]) or (g[7], g[11]) == pytest.approx(w[6:], abs=2e-6)


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    scorer = scoring.SessionScoring(spark, ENGINEERING_MODEL, SPEC, str(tmp_path / "state"))
    made = [spark.createDataFrame([(s, (t + 1000) * 1000, 1.0 * t, False) for s, t in rows],
                                  scoring.ROWS)
            for rows in (seconds(0, 40), seconds(40, 80), CLOSE)]
    scorer.write(-1, spark.createDataFrame([], scoring.OUTPUT))
    for number, batch in enumerate(made):
        for _ in range(2):
            scorer.process(batch, number)
            again = sorted(tuple(r) for r in scorer.results().collect())
    assert [r[1] for r in again] == list(range(6))


def test_an_over_session_starts_anew_and_keeps_no_state(spark, tmp_path):
    later = [("a", t) for t in range(500, 540)]
    got = scored(spark, str(tmp_path / "in"), [seconds(0, 40), [("z", 300)], later, [("z", 900)]])
    assert [(r[0], r[1], r[2]) for r in got] == sorted(
        [("a", k, 1_020_000 + k * 10_000) for k in range(2)]
        + [("a", k, 1_520_000 + k * 10_000) for k in range(2)], key=repr)


def test_gaps_of_the_registered_geometry_do_not_end_a_session(spark, tmp_path):
    from driftline.catalog.live import SESSION_SPEC

    day, gap = 86_400, (3, 4, 8, 9, 10)
    days = [[(s, d * day + h * 3600 + len(s)) for s in ("a", "bb") for h in range(0, 24, 6)]
            for d in range(16) if d not in gap]
    close = [("z", 20 * day)]
    cuts = [sum(days[i:i + 4], []) for i in range(0, len(days), 4)]
    once = scored(spark, str(tmp_path / "once"), [sum(days, []), close], SESSION_SPEC)
    cut = scored(spark, str(tmp_path / "cut"), [*cuts, close], SESSION_SPEC)
    assert cut == once
    assert [r[:2] for r in once] == [(s, i) for s in ("a", "bb") for i in range(9)]


def test_idle_covers_baseline_and_window():
    with pytest.raises(ValueError):
        scoring.ScoringSpec(GEOMETRY, baseline=10_000, delay=0, idle=29_000)


SLIDING = WindowSpec(window=30_000, stride=20_000, expected=None, minimum=12,
                             interval_low=500, interval_high=4000)


def sliding(spark, folder, batches):
    """Windows of rows (session, millisecond, value) that come in the given micro-batches."""
    os.makedirs(folder)
    for i, batch in enumerate(batches):
        path = f"{folder}/part-{i}.parquet"
        spark.createDataFrame(batch, "session string, ms long, value double").select(
            "session", F.timestamp_millis("ms").alias("at"), "value").toPandas().to_parquet(
            path, coerce_timestamps="us", index=False)
        os.utime(path, (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(folder)
    found = windows.sliding_features(stream, ["session"], "at", "value", F.col("value") > 990.0,
                                     SLIDING, "10 seconds")
    out = windows.drain(found).withColumns({
        c: F.unix_millis(c) for c in ("window_start", "window_end")})
    return sorted((tuple(r) for r in out.collect() if r.session != "z"), key=repr)


def sliding_by_hand(rows):
    out = []
    for session in {r[0] for r in rows}:
        mine = sorted((ms, v) for s, ms, v in rows if s == session)
        for end in range(0, mine[-1][0] + 60_000, 20_000):
            for shift in (0, 10_000):  # windows end where the next 20 seconds, from 30, do
                if (end + shift - 30_000) % 20_000:
                    continue
                held = [(ms, v) for ms, v in mine if end + shift - 30_000 < ms <= end + shift]
                if not held:
                    continue
                t, v = np.array([ms / 1000 for ms, _ in held]), np.array([x for _, x in held])
                steps = np.diff(t) * 1000
                reason = ("DUPLICATE_TIMESTAMP" if (steps == 0).any() else
                          "PARTIAL_WINDOW" if len(held) < 12 else
                          "TIMING_OUT_OF_TOLERANCE" if ((steps < 500) | (steps > 4000)).any() else
                          "INVALID_CAP_QUALITY" if (v > 990).any() else "")
                features = [None] * 5 if reason else [
                    v.mean(), v[-1], np.polyfit(t - t.mean(), v, 1)[0], v.var(), v.max() - v.min()]
                out.append((session, end + shift - 30_000, end + shift, len(held), reason, features))
    return sorted(out, key=repr)


def test_sliding_windows_equal_batch_for_any_cut(spark, tmp_path):
    draw = np.random.default_rng(5)
    rows = [("busy", 1000 * i + int(draw.integers(-200, 200)), float(draw.normal(5, 2)))
            for i in range(1, 300)]
    rows += [("few", 7000 * i, float(i)) for i in range(1, 20)]
    rows += [("busy", 100_000, 3.0), ("busy", 100_000, 3.0), ("busy", 200_001, 995.0)]
    rows.sort(key=lambda r: r[1] + int(draw.integers(0, 9000)))  # late, but within the delay
    close = [("z", 1_000_000, 0.0)]
    want = sliding_by_hand(rows)
    for n, cuts in enumerate(([], [1, 40, 41, 150], list(range(30, 300, 60)))):
        cut = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        got = sliding(spark, str(tmp_path / str(n)), [*cut, close, close])
        assert [g[:5] for g in got] == [w[:5] for w in want]
        for g, w in zip(got, want):
            assert g[5:] == (None,) * 5 if w[5][0] is None else g[5:] == pytest.approx(w[5], abs=2e-6)


def test_samples_are_never_copied_into_windows(spark, tmp_path):
    os.makedirs(str(tmp_path / "in"))
    stream = spark.readStream.schema(ROWS).parquet(str(tmp_path / "in"))
    found = windows.sliding_features(stream, ["session"], "at", "value", F.lit(False), SLIDING,
                                     "10 seconds")
    plan = found._jdf.queryExecution().analyzed().toString()
    below_panes = plan[plan.rindex("Aggregate ["):]
    assert plan.count("Aggregate [") == 2 and "Expand" not in below_panes
