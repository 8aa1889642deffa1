"""Scoring, fitting and metrics: golden values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline import contract
from driftline.functions.ordinal import ENGINEERING_MODEL, OrdinalModel
from driftline.operators import metrics as me, model as mo

TOY = OrdinalModel(mean=(0.0,) * 5, scale=(1.0,) * 5, beta=(1.0, 0.0, 0.0, 0.0, 0.0),
                   theta=(-1.0, 0.0, 1.0))
FEATURES = contract.FEATURE_COLUMNS


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def test_toy_scores(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 5.0), (2, 800.0), (3, -800.0)], "i int, x double").select(
        "i", F.col("x").alias(FEATURES[0]), *[F.lit(0.0).alias(n) for n in FEATURES[1:]])
    rows = mo.ordinal_score(df, TOY).orderBy("i").collect()
    assert np.allclose([rows[0][n] for n in mo.probability_columns()],
                       [sigmoid(-1), .5 - sigmoid(-1), sigmoid(1) - .5, 1 - sigmoid(1)])
    assert [r.predicted_index for r in rows] == [0, 3, 3, 0]
    check = mo.probability_checks(mo.ordinal_score(df, TOY)).first()
    assert check.all_finite and check.all_in_range and check.all_sum_to_one


def test_float_parity(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(500, 5)) * np.array(ENGINEERING_MODEL.scale) + np.array(ENGINEERING_MODEL.mean)
    df = spark.createDataFrame(pd.DataFrame(z, columns=FEATURES))
    row = mo.float_score_parity(df, ENGINEERING_MODEL).first()
    assert row.within_tolerance and row.class_flips == 0 and row.row_count == 500


@pytest.fixture(scope="module")
def matrix(spark):
    """Classes 42/16/12/6 in development, plus validation rows."""
    rng = np.random.default_rng(11)
    rows = []
    for part, counts in (("development", (42, 16, 12, 6)), ("validation", (21, 8, 6, 3))):
        for c, n in enumerate(counts):
            for _ in range(n):
                level = c + rng.normal(scale=0.6)
                x = [level + rng.normal(scale=0.5) for _ in range(5)]
                rows.append((part, f"s{len(rows) % 6}", f"b{len(rows) % 3}", "n", c, *x))
    return spark.createDataFrame(pd.DataFrame(rows, columns=[
        "dataset_partition", "session_id", "bag_id", "sensor_id", "risk_label_index", *FEATURES])).cache()


def test_fit_starts_at_published_objective_and_reaches_the_minimum(matrix):
    train = matrix.filter("dataset_partition = 'development'")
    fit = mo.ordinal_fit(train)
    assert abs(fit.trace[0]["objective"] - 116.17971269354518) < 1e-9
    objectives = [t["objective"] for t in fit.trace]
    assert fit.converged and all(b <= a + 1e-9 for a, b in zip(objectives, objectives[1:]))

    frame = train.toPandas()
    x = frame[list(FEATURES)].to_numpy()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    y = frame["risk_label_index"].to_numpy()

    def objective(beta, theta):
        eta = z @ beta
        sign = np.where(y[:, None] <= np.arange(3)[None, :], 1.0, -1.0)
        return np.logaddexp(0, -sign * (theta[None, :] - eta[:, None])).sum() + 0.5 * beta @ beta

    beta, theta = np.array(fit.model.beta), np.array(fit.model.theta)
    best = objective(beta, theta)
    assert abs(best - objectives[-1]) < 1e-8
    rng = np.random.default_rng(0)
    for _ in range(200):
        assert objective(beta + rng.normal(scale=1e-3, size=5),
                         np.sort(theta + rng.normal(scale=1e-3, size=3))) >= best - 1e-10


def test_validation_rows_do_not_change_the_model(matrix):
    train = matrix.filter("dataset_partition = 'development'")
    shifted = train.unionByName(
        matrix.filter("dataset_partition = 'validation'").withColumn(FEATURES[0], F.lit(99.0)))
    a = mo.ordinal_fit(train).model
    b = mo.ordinal_fit(shifted.filter("dataset_partition = 'development'")).model
    assert np.allclose(a.beta, b.beta, atol=1e-9) and np.allclose(a.theta, b.theta, atol=1e-9)


def test_trace_and_comparators(matrix):
    train = matrix.filter("dataset_partition = 'development'")
    validation = matrix.filter("dataset_partition = 'validation'")
    fit = mo.ordinal_fit(train)
    trace = mo.fit_trace(fit, validation).orderBy("iteration").collect()
    assert len(trace) == len(fit.trace) and trace[-1].validation_accuracy > 0.6
    assert trace[0].normalised_objective == 1.0
    for method in (mo.logistic_comparator, mo.tree_comparator):
        scored = method(train, validation)
        hits = scored.filter("predicted_index = risk_label_index").count()
        assert scored.count() == 38 and hits > 22


def test_fit_guard(spark, matrix):
    assert mo.fit_partition_guard(matrix, matrix).count() == 0
    final = matrix.withColumn("dataset_partition", F.lit("final_test"))
    problems = [r.problem for r in mo.fit_partition_guard(
        matrix.filter("risk_label_index <> 2"), matrix.unionByName(final)).collect()]
    assert sorted(problems) == ["FORBIDDEN_PARTITION", "MISSING_CLASS"]


def predictions(spark, truth, predicted):
    return spark.createDataFrame(list(zip(truth, predicted)), "truth int, predicted int")


def test_golden_metrics(spark):
    df = predictions(spark, [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3], [0, 0, 0, 0, 1, 1, 2, 2, 3, 3, 3, 3])
    assert abs(me.macro_f1(df).first().macro_f1 - 29 / 35) < 1e-12
    assert abs(me.quadratic_weighted_kappa(df).first().quadratic_weighted_kappa - 16 / 17) < 1e-12
    assert me.confusion_matrix(df).count() == 16
    assert abs(me.adjacent_class_error_rate(df).first().adjacent_error_rate - 2 / 12) < 1e-12


def test_published_validation_matrix(spark):
    cells = [(0, 0, 21), (1, 0, 2), (1, 1, 6), (2, 2, 6), (3, 3, 3)]
    truth = [t for t, _, n in cells for _ in range(n)]
    predicted = [p for _, p, n in cells for _ in range(n)]
    df = predictions(spark, truth, predicted)
    assert abs(me.macro_f1(df).first().macro_f1 - 0.952922077922078) < 1e-12
    assert abs(me.quadratic_weighted_kappa(df).first().quadratic_weighted_kappa
               - 0.9732582688247713) < 1e-12
    assert abs(me.accuracy(df).first().accuracy - 0.947368421) < 1e-9


def test_absent_classes_and_single_class(spark):
    rows = {r.class_index: r for r in me.per_class_metrics(
        predictions(spark, [0, 0, 1, 1], [0, 1, 1, 1])).collect()}
    assert len(rows) == 4 and rows[2].f1 == 0.0 and rows[3].support == 0
    single = me.quadratic_weighted_kappa(predictions(spark, [1, 1], [1, 1])).first()
    assert single.quadratic_weighted_kappa is None


def test_guarded_fit_refuses_and_experiment_goes_on_to_metrics(spark, matrix):
    from driftline.plans.pipelines import Experiment, train

    candidates = matrix.select("dataset_partition")
    trained = train(Experiment(None, None, candidates, matrix))
    table = {r.dataset_partition: r for r in trained.metrics.collect()}
    assert set(table) == {"development", "validation"} and table["development"].accuracy > 0.6
    assert trained.predictions.count() == matrix.count()
    held = candidates.unionByName(spark.createDataFrame([("final_test",)], "dataset_partition string"))
    with pytest.raises(ValueError, match="FORBIDDEN_PARTITION"):
        mo.guarded_fit(matrix, held)
    with pytest.raises(ValueError, match="MISSING_CLASS"):
        mo.guarded_fit(matrix.filter("risk_label_index < 3"), candidates)
    with pytest.raises(ArithmeticError):
        mo.guarded_fit(matrix, candidates, max_iter=1)


def test_model_document_round_trip(spark, tmp_path):
    from driftline.sources.documents import read_model, write_model

    path = str(tmp_path / "model")
    write_model(spark, ENGINEERING_MODEL, path)
    assert read_model(spark, path) == ENGINEERING_MODEL
    with pytest.raises(Exception, match="exists"):
        write_model(spark, ENGINEERING_MODEL, path)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.json").write_text('{"beta": [1.0], "theta": [0.5], "class_order": ["x", "y"]}')
    with pytest.raises(ValueError):
        read_model(spark, str(tmp_path / "bad"))


def tree_by_hand(x, y, depth, leaf, node=0):
    """(node -> (feature, threshold)), (leaf -> counts) by trying every threshold."""
    counts = tuple(int((y == k).sum()) for k in range(4))
    best, score = None, sum(c * c for c in counts) / len(y)
    for f in range(x.shape[1]) if depth and sum(c > 0 for c in counts) > 1 else ():
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:]):
            left = x[:, f] <= a
            if min(left.sum(), (~left).sum()) < leaf:
                continue
            both = sum((np.bincount(y[side], minlength=4) ** 2).sum() / side.sum()
                       for side in (left, ~left))
            if both > score:
                best, score = (f, (a + b) / 2, left), both
    if best is None:
        return {}, {node: counts}
    f, threshold, left = best
    splits, leaves = {node: (FEATURES[f], threshold)}, {}
    for child, side in ((2 * node + 1, left), (2 * node + 2, ~left)):
        s, c = tree_by_hand(x[side], y[side], depth - 1, leaf, child)
        splits |= s
        leaves |= c
    return splits, leaves


@pytest.mark.parametrize("case", ["distinct", "ties", "pure", "hot"])
def test_tree_equals_brute_force(spark, case):
    rng = np.random.default_rng(4)
    n = 3000 if case == "distinct" else 400
    x = rng.normal(size=(n, 5))
    y = np.clip(np.round(x[:, 0] + 0.7 * x[:, 3] + rng.normal(scale=.4, size=n)) + 1, 0, 3).astype(int)
    if case == "ties":
        x = np.round(x)
    if case == "pure":
        y[:] = 2
    if case == "hot":  # one value has a third of all rows
        x[: n // 3] = 0.25
    frame = pd.DataFrame(x, columns=FEATURES).assign(risk_label_index=y)
    df = spark.createDataFrame(frame)
    tree = mo.tree_fit(df)
    splits, leaves = tree_by_hand(x, y, 3, 2)
    assert tree.splits == splits and {n: tree.counts[n] for n in tree.leaves()} == leaves
    counts = {(r.leaf, r.predicted_index): r["count"] for r in mo.tree_apply(df, tree).groupBy(
        "leaf", "predicted_index").count().collect()}
    assert counts == {(n, int(np.argmax(c))): sum(c) for n, c in leaves.items()}
    assert case != "distinct" or len(np.unique(x[:, 0])) > 256
