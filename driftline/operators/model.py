"""Fitting and scoring of the ordinal classifier, and two comparators.

Only parameters and scalar sums reach the driver.  A fit reads the matrix once
per Newton step from a reliable checkpoint.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from driftline import contract
from driftline.functions.ordinal import (
    OrdinalModel, argmax_lowest, class_probabilities, float_probabilities, linear_predictor)
from driftline.functions.parsing import is_finite
from driftline.functions.rounding import stable_round
from driftline.operators.ordered import running_sums
from driftline.session import materialise

FIT_PARTITION, FORBIDDEN_PARTITION = "development", "final_test"


def probability_columns(classes=contract.CLASS_NAMES) -> list[str]:
    return [f"prob_{name.lower()}" for name in classes]


def ordinal_score(rows: DataFrame, model: OrdinalModel) -> DataFrame:
    """Adds one probability per class, the predicted index and the predicted label."""
    names = probability_columns(model.classes)
    scored = rows.withColumn("_eta", linear_predictor(model))
    probabilities = class_probabilities(F.col("_eta"), model.theta)
    scored = scored.withColumns(dict(zip(names, probabilities))).drop("_eta")
    scored = scored.withColumn("predicted_index", argmax_lowest(F.array(*names)))
    labels = F.array(*[F.lit(name) for name in model.classes])
    return scored.withColumn("predicted_label", F.get(labels, F.col("predicted_index")))


def probability_checks(scored: DataFrame, classes=contract.CLASS_NAMES,
                       tolerance: float = 1e-9) -> DataFrame:
    """Whether all probabilities are finite, in range and sum to one."""
    names = probability_columns(classes)
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    finite = F.lit(True)
    inside = F.lit(True)
    for name in names:
        finite = finite & is_finite(F.col(name))
        inside = inside & F.col(name).between(-tolerance, 1.0 + tolerance)
    return scored.agg(
        F.count(F.lit(1)).alias("row_count"), F.bool_and(finite).alias("all_finite"),
        F.bool_and(inside).alias("all_in_range"),
        (F.max(F.abs(total - 1.0)) <= tolerance).alias("all_sum_to_one"))


def model_parameter_checks(models: DataFrame, dimensions: int = 5, thresholds: int = 3) -> DataFrame:
    """Broken rules per model row (arrays ``mean``, ``scale``, ``beta``, ``theta``)."""
    from driftline.functions.arrays import adjacent
    from driftline.operators.integrity import violations

    def vector(name, length):
        values = F.col(name)
        return values.isNull() | (F.size(values) != length) | ~F.forall(values, is_finite)

    return violations(models, {
        "mean": vector("mean", dimensions),
        "scale": vector("scale", dimensions),
        "scale_positive": F.exists("scale", lambda s: s <= 0),
        "beta": vector("beta", dimensions),
        "theta": vector("theta", thresholds),
        "theta_increasing": F.exists(
            adjacent(F.col("theta"), lambda a, b: b - a), lambda d: d <= 0),
    }, ["model_id"])


def float_score_parity(rows: DataFrame, model: OrdinalModel, tolerance: float = 1e-5) -> DataFrame:
    """Single against double precision: class flips and whether the gap is tolerable."""
    scored = ordinal_score(rows, model)
    names = probability_columns(model.classes)
    single = [f"_f{i}" for i in range(len(names))]
    scored = scored.withColumns(dict(zip(single, float_probabilities(model))))
    gap = F.greatest(*[F.abs(F.col(a) - F.col(b).cast("double")) for a, b in zip(names, single)])
    flipped = argmax_lowest(F.array(*single)) != F.col("predicted_index")
    return scored.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(flipped).alias("class_flips"),
        (F.max(gap) <= tolerance).alias("within_tolerance"))


# standardisation ---------------------------------------------------------------------

def standardise_fit(rows: DataFrame, features=contract.FEATURE_COLUMNS,
                    groups: list[str] | None = None) -> DataFrame:
    """Mean and population deviation per feature, as one row (per group)."""
    return rows.groupBy(*(groups or [])).agg(*[expr for name in features for expr in (
        F.avg(name).alias(f"{name}_mean"), F.stddev_pop(name).alias(f"{name}_std"))])


def standardise_apply(rows: DataFrame, mean, scale, features=contract.FEATURE_COLUMNS,
                      prefix: str = "z_") -> DataFrame:
    return rows.withColumns({
        f"{prefix}{name}": (F.col(name) - F.lit(float(m))) / F.lit(float(s))
        for name, m, s in zip(features, mean, scale)})


# fitting -----------------------------------------------------------------------------

def fit_partition_guard(matrix: DataFrame, candidates: DataFrame) -> DataFrame:
    """Why a fit must be refused; no rows means it may run.

    Forbidden-partition windows refuse the fit even when they are excluded
    candidates; every class must occur in the fit partition.
    """
    forbidden = candidates.filter(F.col("dataset_partition") == FORBIDDEN_PARTITION).groupBy().agg(
        F.count(F.lit(1)).alias("n")).filter("n > 0").select(
        F.lit("FORBIDDEN_PARTITION").alias("problem"), F.col("n").cast("string").alias("detail"))
    present = matrix.filter(F.col("dataset_partition") == FIT_PARTITION).groupBy().agg(*[
        F.count_if(F.col("risk_label_index") == i).alias(name)
        for i, name in enumerate(contract.CLASS_NAMES)])
    missing = present.unpivot([], list(contract.CLASS_NAMES), "detail", "n").filter("n = 0").select(
        F.lit("MISSING_CLASS").alias("problem"), "detail")
    return forbidden.unionByName(missing)


def fitted_population(matrix: DataFrame) -> DataFrame:
    """Rows, groups and classes per partition, and whether the fit uses it."""
    return matrix.groupBy("dataset_partition").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("session_id").alias("session_count"),
        F.count_distinct("bag_id").alias("bag_count"),
        F.count_distinct("sensor_id").alias("sensor_count"),
        *[F.count_if(F.col("risk_label_index") == i).alias(f"class_{name.lower()}")
          for i, name in enumerate(contract.CLASS_NAMES)],
    ).withColumn("fitted", F.col("dataset_partition") == FIT_PARTITION)


@dataclass(frozen=True)
class OrdinalFit:
    model: OrdinalModel
    trace: list[dict]
    converged: bool


def _loss_terms(target: Column, eta: Column, theta) -> tuple[Column, list[Column], list[Column]]:
    """Loss, signed residual and curvature per threshold."""
    loss, residuals, curvatures = F.lit(0.0), [], []
    for k, t in enumerate(theta):
        sign = F.when(target <= k, 1.0).otherwise(-1.0)
        margin = sign * (F.lit(float(t)) - eta)
        fault = F.lit(1.0) / (F.lit(1.0) + F.exp(margin))
        loss = loss + F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))
        residuals.append(-sign * fault)
        curvatures.append(fault * (F.lit(1.0) - fault))
    return loss, residuals, curvatures


def _pass(data: DataFrame, zs: list[str], target: str, beta, theta, alpha: float):
    """One distributed pass: objective, gradient and Hessian in (beta, theta)."""
    d, m = len(zs), len(theta)
    eta = sum((F.lit(float(b)) * F.col(z) for b, z in zip(beta[1:], zs[1:])),
              F.lit(float(beta[0])) * F.col(zs[0]))
    staged = data.select(*zs, target, eta.alias("_eta"))
    loss, residuals, curvatures = _loss_terms(F.col(target), F.col("_eta"), theta)
    staged = staged.select(
        *zs, loss.alias("_loss"), *[r.alias(f"_r{k}") for k, r in enumerate(residuals)],
        *[w.alias(f"_w{k}") for k, w in enumerate(curvatures)])
    r_sum = sum((F.col(f"_r{k}") for k in range(1, m)), F.col("_r0"))
    w_sum = sum((F.col(f"_w{k}") for k in range(1, m)), F.col("_w0"))
    sums = [F.sum("_loss").alias("loss")]
    sums += [F.sum(-r_sum * F.col(z)).alias(f"gb{i}") for i, z in enumerate(zs)]
    sums += [F.sum(f"_r{k}").alias(f"gt{k}") for k in range(m)]
    sums += [F.sum(w_sum * F.col(zs[i]) * F.col(zs[j])).alias(f"hb{i}_{j}")
             for i in range(d) for j in range(i, d)]
    sums += [F.sum(-F.col(f"_w{k}") * F.col(z)).alias(f"hx{i}_{k}")
             for i, z in enumerate(zs) for k in range(m)]
    sums += [F.sum(f"_w{k}").alias(f"ht{k}") for k in range(m)]
    row = staged.agg(*sums).first().asDict()
    gradient = np.array([row[f"gb{i}"] for i in range(d)] + [row[f"gt{k}"] for k in range(m)])
    hessian = np.zeros((d + m, d + m))
    for i in range(d):
        for j in range(i, d):
            hessian[i, j] = hessian[j, i] = row[f"hb{i}_{j}"]
        for k in range(m):
            hessian[i, d + k] = hessian[d + k, i] = row[f"hx{i}_{k}"]
    for k in range(m):
        hessian[d + k, d + k] = row[f"ht{k}"]
    beta = np.asarray(beta)
    gradient[:d] += alpha * beta
    hessian[:d, :d] += alpha * np.eye(d)
    return row["loss"] + 0.5 * alpha * float(beta @ beta), gradient, hessian


def ordinal_fit(matrix: DataFrame, features=contract.FEATURE_COLUMNS,
                target: str = "risk_label_index", classes=contract.CLASS_NAMES,
                alpha: float = 1.0, max_iter: int = 50, tolerance: float = 1e-9) -> OrdinalFit:
    """All-threshold ordinal logistic regression with an L2 penalty on beta.

    Features are standardised with their population deviation.  Thresholds are
    a running sum of increments, the later ones bounded below by zero, and the
    start is beta 0 with increments 0, 1, 2.  Projected Newton steps: each
    needs one aggregation over the data and solves a system of 8 unknowns.
    """
    d, m = len(features), len(classes) - 1
    parameters = standardise_fit(matrix, features).first()
    mean = [parameters[f"{name}_mean"] for name in features]
    scale = [parameters[f"{name}_std"] or 1.0 for name in features]
    zs = [f"z_{name}" for name in features]
    data = materialise(standardise_apply(matrix, mean, scale, features).select(*zs, target))
    lower = np.tril(np.ones((m, m)))
    to_theta = np.block([[np.eye(d), np.zeros((d, m))], [np.zeros((m, d)), lower]])
    bounded = np.array([False] * (d + 1) + [True] * (m - 1))
    state = np.concatenate([np.zeros(d), np.arange(m, dtype=float)])

    def evaluate(x):
        full = to_theta @ x
        value, gradient, hessian = _pass(data, zs, target, full[:d], full[d:], alpha)
        return value, to_theta.T @ gradient, to_theta.T @ hessian @ to_theta

    value, gradient, hessian = evaluate(state)
    trace, converged = [], False
    for iteration in range(max_iter + 1):
        full = to_theta @ state
        held = bounded & (state <= 0) & (gradient > 0)
        norm = float(np.max(np.abs(np.where(held, 0.0, gradient))))
        trace.append({"iteration": iteration, "objective": value, "gradient_norm": norm,
                      "beta": [float(v) for v in full[:d]], "theta": [float(v) for v in full[d:]]})
        if norm <= tolerance * max(1.0, abs(value)):
            converged = True
            break
        free = ~held
        step = np.zeros_like(state)
        step[free] = np.linalg.solve(hessian[np.ix_(free, free)], -gradient[free])
        size, accepted = 1.0, False
        while size > 1e-6:
            candidate = state + size * step
            candidate[bounded] = np.maximum(candidate[bounded], 0.0)
            trial = evaluate(candidate)
            if trial[0] <= value + 1e-4 * size * min(0.0, float(gradient @ step)) + 1e-12 * abs(value):
                state, accepted = candidate, True
                value, gradient, hessian = trial
                break
            size *= 0.5
        if not accepted:
            break
    full = to_theta @ state
    model = OrdinalModel(
        mean=tuple(float(v) for v in mean), scale=tuple(float(v) for v in scale),
        beta=tuple(float(v) for v in full[:d]), theta=tuple(float(v) for v in full[d:]),
        features=tuple(features), classes=tuple(classes))
    return OrdinalFit(model, trace, converged)


def guarded_fit(matrix: DataFrame, candidates: DataFrame, **settings) -> OrdinalFit:
    """`ordinal_fit` on the fit partition; refuses what `fit_partition_guard` finds, and a fit
    that does not converge."""
    problems = [f"{r.problem} {r.detail}" for r in fit_partition_guard(matrix, candidates).collect()]
    if problems:
        raise ValueError(f"fit refused: {', '.join(sorted(problems))}")
    return require_converged(ordinal_fit(
        matrix.filter(F.col("dataset_partition") == FIT_PARTITION), **settings))


def require_converged(fit: OrdinalFit) -> OrdinalFit:
    if not fit.converged:
        raise ArithmeticError(f"fit did not converge in {len(fit.trace) - 1} iterations")
    return fit


def fit_trace(fit: OrdinalFit, validation: DataFrame, target: str = "risk_label_index") -> DataFrame:
    """Objective per iteration with the validation accuracy and macro F1 it reached.

    Validation rows are scored by every iteration's parameters in one pass; the
    number of iterations is bounded by the fit.
    """
    from driftline.operators import metrics

    spark = validation.sparkSession
    features = fit.model.features
    z = standardise_apply(validation, fit.model.mean, fit.model.scale, features)

    def predicted(step):
        eta = sum((F.lit(b) * F.col(f"z_{n}") for b, n in zip(step["beta"][1:], features[1:])),
                  F.lit(step["beta"][0]) * F.col(f"z_{features[0]}"))
        return argmax_lowest(F.array(*class_probabilities(eta, step["theta"])))

    scored = z.select(F.col(target).cast("int").alias("truth"), F.explode(F.array(*[
        F.struct(F.lit(s["iteration"]).alias("iteration"), predicted(s).alias("predicted"))
        for s in fit.trace])).alias("_s")).select("truth", "_s.*")
    quality = metrics.metric_table(scored, ["iteration"], len(fit.model.classes)).select(
        "iteration", F.col("accuracy").alias("validation_accuracy"),
        F.col("macro_f1").alias("validation_macro_f1"))
    start = fit.trace[0]["objective"]
    history = spark.createDataFrame(
        [(s["iteration"], s["objective"], s["objective"] / start, s["gradient_norm"])
         for s in fit.trace],
        "iteration int, objective double, normalised_objective double, gradient_norm double")
    return history.join(quality, "iteration", "left")


def example_per_class(scored: DataFrame, order: list[str]) -> DataFrame:
    """First row of every predicted class: a mergeable minimum, no sort per class."""
    payload = F.struct(*[F.col(c) for c in scored.columns if c != "predicted_index"])
    return scored.groupBy("predicted_index").agg(
        F.min_by(payload, F.struct(*order)).alias("_row")).select("predicted_index", "_row.*")


# comparators -------------------------------------------------------------------------

def _assembled(matrix: DataFrame, zs: list[str], target: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=zs, outputCol="_vector").transform(matrix).withColumn(
        "_label", F.col(target).cast("double"))


def _standardised(train: DataFrame, rows: DataFrame, features):
    parameters = standardise_fit(train, features).first()
    mean = [parameters[f"{n}_mean"] for n in features]
    scale = [parameters[f"{n}_std"] or 1.0 for n in features]
    return (standardise_apply(train, mean, scale, features),
            standardise_apply(rows, mean, scale, features), [f"z_{n}" for n in features])


def logistic_comparator(train: DataFrame, rows: DataFrame, features=contract.FEATURE_COLUMNS,
                        target: str = "risk_label_index", c: float = 1.0) -> DataFrame:
    """Multinomial logistic regression on standardised features; adds ``predicted_index``."""
    from pyspark.ml.classification import LogisticRegression

    fit_rows, score_rows, zs = _standardised(train, rows, features)
    fit_rows = materialise(fit_rows)
    estimator = LogisticRegression(
        featuresCol="_vector", labelCol="_label", predictionCol="_prediction",
        family="multinomial", regParam=1.0 / (c * fit_rows.count()), standardization=False,
        maxIter=200, tol=1e-9)
    model = estimator.fit(_assembled(fit_rows, zs, target))
    return model.transform(_assembled(score_rows, zs, target)).select(
        *rows.columns, F.col("_prediction").cast("int").alias("predicted_index"))


@dataclass(frozen=True)
class Tree:
    """Splits ``node -> (feature, threshold)`` and class counts of every node; 0 is the root and
    the children of ``n`` are ``2n + 1`` (at most the threshold) and ``2n + 2``."""

    splits: dict[int, tuple[str, float]]
    counts: dict[int, tuple[int, ...]]

    def node(self) -> Column:
        """Leaf of a row."""
        def below(node: int) -> Column:
            if node not in self.splits:
                return F.lit(node)
            name, threshold = self.splits[node]
            return F.when(F.col(name) <= F.lit(threshold), below(2 * node + 1)).otherwise(
                below(2 * node + 2))

        return below(0)

    def leaves(self) -> list[int]:
        return [n for n in self.counts if n not in self.splits]


def tree_fit(train: DataFrame, features=contract.FEATURE_COLUMNS, target: str = "risk_label_index",
             classes: int = len(contract.CLASS_NAMES), depth: int = 3, leaf: int = 2) -> Tree:
    """Gini tree by exact search over all distinct values, one level at a time.

    Rows collapse to class counts per (node, feature, value); running sums over the sorted values
    give the counts on both sides of every possible threshold.  A node takes the split with the
    least weighted impurity (of equal ones the first feature, then the smallest value), at the middle
    of two neighbouring values, if both sides keep ``leaf`` rows and the impurity falls.  Null
    features go right.  The driver sees one row per node.
    """
    names = [f"c{k}" for k in range(classes)]
    data = materialise(train.select(*features, F.col(target).cast("int").alias("_class")))
    whole = data.agg(*[F.coalesce(F.count_if(F.col("_class") == k), F.lit(0)).alias(n)
                       for k, n in enumerate(names)]).first()
    tree, open_ = Tree({}, {0: tuple(whole)}), [0]
    for _ in range(depth):
        open_ = [n for n in open_ if sum(c > 0 for c in tree.counts[n]) > 1]
        if not open_:
            break
        melted = data.withColumn("_node", tree.node()).where(F.col("_node").isin(open_)).select(
            "_node", "_class", F.explode(F.array(*[
                F.struct(F.lit(i).alias("_feature"), F.col(f).cast("double").alias("_value"))
                for i, f in enumerate(features)])).alias("_m")).select("_node", "_class", "_m.*")
        counted = materialise(melted.where("_value is not null").groupBy(
            "_node", "_feature", "_value").agg(*[
                F.count_if(F.col("_class") == k).alias(n) for k, n in enumerate(names)]))
        summed = running_sums(counted, ["_node", "_feature"], "_value", names)
        # null features are on the right of every threshold
        totals = [F.coalesce(*[F.when(F.col("_node") == n, F.lit(tree.counts[n][k]))
                               for n in open_]) for k in range(classes)]
        left = [F.col(f"before_{n}") + F.col(n) for n in names]
        sides = summed.select("_node", "_feature", "_value", *[
            c.alias(f"l{k}") for k, c in enumerate(left)], *[
            (t - c).alias(f"r{k}") for k, (t, c) in enumerate(zip(totals, left))])

        def size(side):
            return sum((F.col(f"{side}{k}") for k in range(1, classes)), F.col(f"{side}0"))

        def purity(side):
            squares = sum((F.col(f"{side}{k}") * F.col(f"{side}{k}") for k in range(1, classes)),
                          F.col(f"{side}0") * F.col(f"{side}0"))
            return squares.cast("double") / size(side)

        candidates = sides.where((size("l") >= leaf) & (size("r") >= leaf)).select(
            "_node", "_feature", "_value", (purity("l") + purity("r")).alias("_purity"),
            F.array(*[f"l{k}" for k in range(classes)]).alias("_left"),
            F.array(*[f"r{k}" for k in range(classes)]).alias("_right"))
        best = candidates.groupBy("_node").agg(F.max_by(
            F.struct("_feature", "_value", "_left", "_right", "_purity"),
            F.struct("_purity", -F.col("_feature"), -F.col("_value"))).alias("_best")).select(
            "_node", "_best.*")
        chosen = [r for r in best.collect() if r["_purity"] > sum(
            c * c for c in tree.counts[r["_node"]]) / sum(tree.counts[r["_node"]])]
        if not chosen:
            break
        after = counted.agg(*[F.min(F.when(
            (F.col("_node") == r["_node"]) & (F.col("_feature") == r["_feature"])
            & (F.col("_value") > r["_value"]), F.col("_value"))).alias(f"n{r['_node']}")
            for r in chosen]).first()
        open_ = []
        for r in chosen:
            node, following = r["_node"], after[f"n{r['_node']}"]
            middle = r["_value"] if following is None else (r["_value"] + following) / 2.0
            tree.splits[node] = (features[r["_feature"]], middle)
            tree.counts[2 * node + 1], tree.counts[2 * node + 2] = (
                tuple(r["_left"]), tuple(r["_right"]))
            open_ += [2 * node + 1, 2 * node + 2]
    return tree


def tree_apply(rows: DataFrame, tree: Tree) -> DataFrame:
    """Adds ``leaf`` and its most frequent class (of equal ones the first) as ``predicted_index``."""
    majority = F.coalesce(*[
        F.when(F.col("leaf") == n, F.lit(max(range(len(c)), key=lambda k: (c[k], -k))))
        for n in tree.leaves() for c in [tree.counts[n]]])
    return rows.withColumn("leaf", tree.node()).withColumn(
        "predicted_index", majority.cast("int"))


def tree_comparator(train: DataFrame, rows: DataFrame, features=contract.FEATURE_COLUMNS,
                    target: str = "risk_label_index", depth: int = 3, leaf: int = 2) -> DataFrame:
    """Gini decision tree; adds ``leaf`` and ``predicted_index``."""
    return tree_apply(rows, tree_fit(train, features, target, depth=depth, leaf=leaf))


def rounded_probabilities(scored: DataFrame, decimals: int = 6) -> DataFrame:
    return scored.withColumns({
        name: stable_round(F.col(name), decimals)
        for name in scored.columns if name.startswith("prob_")})
