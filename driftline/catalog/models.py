"""Scoring, fitting, metrics and monitoring over the event stream."""

from pyspark.sql import functions as F

from driftline import contract
from driftline.catalog import outcomes as co, tables as t, windows as cw
from driftline.catalog.registry import query, rounded, with_tables
from driftline.functions.ordinal import OrdinalModel
from driftline.functions.rounding import stable_round
from driftline.operators import metrics as me, model as mo, monitoring as mn
from driftline.operators.ordered import exact_quantiles, lag_in_order

FEATURES = contract.FEATURE_COLUMNS
EVENT_MODEL = OrdinalModel(
    mean=(-20.0, -20.0, 0.0, 2500.0, 150.0), scale=(60.0, 80.0, 10.0, 3000.0, 80.0),
    beta=(0.8, 0.6, 0.5, 0.4, 0.7), theta=(-1.0, 0.2, 1.4))


def _double(value):
    return f"{float(value)!r}::DOUBLE"


def _eta():
    return " + ".join(
        f"{_double(b)} * (({n} - {_double(m)}) / {_double(s)})" for n, m, s, b in zip(
            FEATURES, EVENT_MODEL.mean, EVENT_MODEL.scale, EVENT_MODEL.beta))


def scored_sql(source, where="feature_valid", columns="*"):
    sigmoids = ", ".join(f"1.0e0 / (1.0e0 + exp(-({_double(th)} - eta))) AS s{i}"
                         for i, th in enumerate(EVENT_MODEL.theta))
    return f"""
  SELECT * EXCLUDE (eta, s0, s1, s2, best),
         CAST(CASE WHEN prob_safe = best THEN 0 WHEN prob_monitor = best THEN 1
                   WHEN prob_caution = best THEN 2 ELSE 3 END AS INTEGER) AS predicted_index,
         CASE WHEN prob_safe = best THEN 'Safe' WHEN prob_monitor = best THEN 'Monitor'
              WHEN prob_caution = best THEN 'Caution' ELSE 'Urgent' END AS predicted_label
  FROM (SELECT *, greatest(prob_safe, prob_monitor, prob_caution, prob_urgent) AS best FROM (
    SELECT *, s0 AS prob_safe, s1 - s0 AS prob_monitor, s2 - s1 AS prob_caution,
           1.0e0 - s2 AS prob_urgent
    FROM (SELECT *, {sigmoids} FROM (
      SELECT {columns}, {_eta()} AS eta FROM {source} WHERE {where}))))"""


SCORED = cw.FEATURES + ", scored AS (" + scored_sql("features") + ")"
PROBS = ", ".join(f"{rounded(p)} AS {p}" for p in mo.probability_columns())


def scored(spark, sf_dir):
    return mo.ordinal_score(cw.feature_table(spark, sf_dir).filter("feature_valid"), EVENT_MODEL)


@query("ordinal_score", with_tables(SCORED, body=f"""
SELECT window_id, {PROBS}, predicted_index, predicted_label FROM scored"""))
def ordinal_score(spark, sf_dir):
    return mo.rounded_probabilities(scored(spark, sf_dir)).select(
        "window_id", *mo.probability_columns(), "predicted_index", "predicted_label")


@query("argmax_lowest", """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax,
       CAST(CASE WHEN l_discount >= l_tax AND l_discount * 1e0 >= q THEN 0
                 WHEN l_tax >= q THEN 1 ELSE 2 END AS INTEGER) AS best_index
FROM (SELECT *, CASE WHEN l_quantity > 40 THEN 0.05e0 ELSE 0.0e0 END AS q FROM lineitem)""")
def argmax_lowest(spark, sf_dir):
    lines = t.table(spark, sf_dir, "lineitem")
    third = F.when(F.col("l_quantity") > 40, 0.05).otherwise(0.0)
    return lines.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
        mo.argmax_lowest(F.array("l_discount", "l_tax", third)).alias("best_index"))


@query("probability_checks", with_tables(SCORED, body="""
SELECT count(*) AS row_count, bool_and(isfinite(prob_safe) AND isfinite(prob_urgent)) AS all_finite,
       bool_and(least(prob_safe, prob_monitor, prob_caution, prob_urgent) >= -1e-9
            AND greatest(prob_safe, prob_monitor, prob_caution, prob_urgent) <= 1 + 1e-9) AS all_in_range,
       max(abs(prob_safe + prob_monitor + prob_caution + prob_urgent - 1)) <= 1e-9 AS all_sum_to_one
FROM scored"""))
def probability_checks(spark, sf_dir):
    return mo.probability_checks(scored(spark, sf_dir))


MODELS = cw.FEATURES + """, session_models AS (
  SELECT session_id AS model_id,
         least(stddev_pop(cap_delta_mean), stddev_pop(cap_delta_last), stddev_pop(cap_delta_slope_per_s),
               stddev_pop(cap_delta_variance), stddev_pop(cap_delta_range)) AS least_scale,
         quantile_cont(cap_delta_last, 0.25) AS t0, quantile_cont(cap_delta_last, 0.5) AS t1,
         quantile_cont(cap_delta_last, 0.75) AS t2
  FROM features WHERE feature_valid GROUP BY session_id)"""


@query("model_parameter_checks", with_tables(MODELS, body="""
SELECT model_id, 'scale_positive' AS rule FROM session_models WHERE least_scale <= 0
UNION ALL SELECT model_id, 'theta_increasing' FROM session_models WHERE t1 <= t0 OR t2 <= t1"""))
def model_parameter_checks(spark, sf_dir):
    valid = cw.feature_table(spark, sf_dir).filter("feature_valid")
    scaling = mo.standardise_fit(valid, FEATURES, ["session_id"])
    cuts = exact_quantiles(valid, ["session_id"], "cap_delta_last",
                           {"t0": 0.25, "t1": 0.5, "t2": 0.75})
    models = scaling.join(cuts, "session_id").select(
        F.col("session_id").alias("model_id"),
        F.array(*[F.col(f"{n}_mean") for n in FEATURES]).alias("mean"),
        F.array(*[F.col(f"{n}_std") for n in FEATURES]).alias("scale"),
        F.array(*[F.lit(b) for b in EVENT_MODEL.beta]).alias("beta"),
        F.array("t0", "t1", "t2").alias("theta"))
    return mo.model_parameter_checks(models)


def _float_sql():
    eta = "0::FLOAT"
    for n, m, s, b in zip(FEATURES, EVENT_MODEL.mean, EVENT_MODEL.scale, EVENT_MODEL.beta):
        term = f"(({n}::FLOAT - {m!r}::FLOAT) / {s!r}::FLOAT)"
        eta = f"({eta} + {b!r}::FLOAT * {term})"
    return eta


@query("float32_score_parity", with_tables(SCORED, body=f"""
SELECT count(*) AS row_count, count(*) FILTER (f_index <> predicted_index) AS class_flips,
       max(greatest(abs(prob_safe - f0), abs(prob_monitor - f1), abs(prob_caution - f2),
                    abs(prob_urgent - f3))) <= 1e-5 AS within_tolerance
FROM (SELECT *, CASE WHEN f0 >= f1 AND f0 >= f2 AND f0 >= f3 THEN 0 WHEN f1 >= f2 AND f1 >= f3 THEN 1
                     WHEN f2 >= f3 THEN 2 ELSE 3 END AS f_index
      FROM (SELECT *, c0 AS f0, c1 - c0 AS f1, c2 - c1 AS f2, 1::FLOAT - c2 AS f3
            FROM (SELECT *, {", ".join(
                f"(1 / (1 + exp(-({th!r}::FLOAT - eta32)::DOUBLE)))::FLOAT AS c{i}"
                for i, th in enumerate(EVENT_MODEL.theta))}
                  FROM (SELECT *, {_float_sql()} AS eta32 FROM scored))))"""))
def float32_score_parity(spark, sf_dir):
    return mo.float_score_parity(
        cw.feature_table(spark, sf_dir).filter("feature_valid"), EVENT_MODEL)


MATRIX = co.MATRIX


@query("standardise_fit", with_tables(MATRIX, body=f"""
SELECT dataset_partition, {", ".join(
    f"{rounded(f'avg({n})')} AS {n}_mean, {rounded(f'stddev_pop({n})', 4)} AS {n}_std" for n in FEATURES)}
FROM matrix GROUP BY dataset_partition"""))
def standardise_fit(spark, sf_dir):
    fit = mo.standardise_fit(co.matrix(spark, sf_dir), FEATURES, ["dataset_partition"])
    return fit.select("dataset_partition", *[expr for n in FEATURES for expr in (
        stable_round(F.col(f"{n}_mean")).alias(f"{n}_mean"),
        stable_round(F.col(f"{n}_std"), 4).alias(f"{n}_std"))])


@query("standardise_apply", with_tables(MATRIX, body=f"""
SELECT window_id, {", ".join(f"{rounded(f'({n} - m_{n}) / s_{n}', 5)} AS z_{n}" for n in FEATURES)}
FROM matrix, (SELECT {", ".join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for n in FEATURES)}
              FROM matrix WHERE dataset_partition = 'development')"""))
def standardise_apply(spark, sf_dir):
    matrix = co.matrix(spark, sf_dir)
    p = mo.standardise_fit(matrix.filter("dataset_partition = 'development'")).first()
    z = mo.standardise_apply(matrix, [p[f"{n}_mean"] for n in FEATURES],
                             [p[f"{n}_std"] for n in FEATURES])
    return z.select("window_id", *[stable_round(F.col(f"z_{n}"), 5).alias(f"z_{n}")
                                   for n in FEATURES])


@query("fit_partition_guard", with_tables(MATRIX, body="""
SELECT 'FORBIDDEN_PARTITION' AS problem, CAST(count(*) AS VARCHAR) AS detail FROM window_labels
WHERE dataset_partition = 'final_test' HAVING count(*) > 0
UNION ALL SELECT 'MISSING_CLASS', v.c FROM (VALUES ('Safe'), ('Monitor'), ('Caution'), ('Urgent')) v(c)
WHERE v.c NOT IN (SELECT risk_label FROM matrix WHERE dataset_partition = 'development')"""))
def fit_partition_guard(spark, sf_dir):
    run = co.experiment_of(spark, sf_dir)
    return mo.fit_partition_guard(run.matrix, run.labels)


@query("fitted_population", with_tables(MATRIX, body="""
SELECT dataset_partition, count(*) AS row_count, count(DISTINCT session_id) AS session_count,
       count(DISTINCT bag_id) AS bag_count, count(DISTINCT sensor_id) AS sensor_count,
       count(*) FILTER (risk_label_index = 0) AS class_safe,
       count(*) FILTER (risk_label_index = 1) AS class_monitor,
       count(*) FILTER (risk_label_index = 2) AS class_caution,
       count(*) FILTER (risk_label_index = 3) AS class_urgent,
       dataset_partition = 'development' AS fitted
FROM matrix GROUP BY dataset_partition"""))
def fitted_population(spark, sf_dir):
    return mo.fitted_population(co.matrix(spark, sf_dir))


def _newton_sql(name, source, terms, gradient, hessian, start, ridge, steps):
    """Newton's method as a recursive query: states ``x`` by ``iteration``, from ``start``.

    ``terms`` are columns per row of ``source`` and state ``s.x``; gradient and (lower) Hessian are
    sums over them, plus ``ridge`` times the state.  The linear system is solved by Gauss-Jordan
    steps on its rows as lists.
    """
    n = len(start)
    sums = ", ".join([f"sum({g}) AS g{i}" for i, g in enumerate(gradient)] + [
        f"sum({hessian(i, j)}) AS h{i}_{j}" for i in range(n) for j in range(i + 1)])
    cells = [[f"h{max(i, j)}_{min(i, j)}" + (f" + {ridge[i]!r}" if i == j and ridge[i] else "")
              for j in range(n)] + [f"-(g{i}" + (f" + {ridge[i]!r} * x[{i + 1}]" if ridge[i] else "") + ")"]
             for i in range(n)]
    system = "[" + ", ".join("[" + ", ".join(row) + "]" for row in cells) + "]"
    pivots = ", ".join(f"[[{p}.0e0]]" for p in range(1, n + 1))
    solved = f"""list_reduce([{system}, {pivots}], lambda m, e: list_transform(m, lambda row, i:
        CASE WHEN i = CAST(e[1][1] AS INTEGER)
             THEN list_transform(row, lambda v: v / row[CAST(e[1][1] AS INTEGER)])
             ELSE list_transform(row, lambda v, j: v - row[CAST(e[1][1] AS INTEGER)]
                  * m[CAST(e[1][1] AS INTEGER)][j]
                  / m[CAST(e[1][1] AS INTEGER)][CAST(e[1][1] AS INTEGER)]) END))"""
    return f"""{name} AS (
  SELECT 0 AS iteration, CAST({start!r} AS DOUBLE[]) AS x
  UNION ALL
  SELECT iteration + 1, list_transform({solved}, lambda row, i: row[{n + 1}] + x[i])
  FROM (SELECT iteration, x, {sums} FROM (
          SELECT s.iteration, s.x, {terms} FROM {name} s, {source})
        GROUP BY iteration, x)
  WHERE iteration < {steps})"""


SCALED = MATRIX + f""", scaling AS (
  SELECT {", ".join(f"avg({n}) AS m{i}, stddev_pop({n}) AS s{i}" for i, n in enumerate(FEATURES))}
  FROM matrix WHERE dataset_partition = 'development'),
scaled AS (
  SELECT window_id, dataset_partition, risk_label_index AS y,
         [{", ".join(f"({n} - m{i}) / CASE WHEN s{i} = 0 THEN 1 ELSE s{i} END" for i, n in enumerate(FEATURES))}] AS z
  FROM matrix, scaling)"""
# the parameters are beta and the increments of theta; a row meets each threshold k with the
# vector a for which a . x = theta[k] - beta . z
ORDINAL = SCALED + """, design AS (
  SELECT window_id, dataset_partition, y, k, CASE WHEN y <= k THEN 1.0e0 ELSE -1.0e0 END AS side,
         list_concat(list_transform(z, lambda v: -v),
                     [1.0e0, CASE WHEN k >= 1 THEN 1.0e0 ELSE 0.0e0 END,
                      CASE WHEN k >= 2 THEN 1.0e0 ELSE 0.0e0 END]) AS a
  FROM scaled, range(3) t(k)),
""" + _newton_sql(
    "states", "(SELECT * FROM design WHERE dataset_partition = 'development') d",
    "d.a, d.side, 1 / (1 + exp(d.side * list_dot_product(d.a, s.x))) AS fault",
    [f"-side * fault * a[{i + 1}]" for i in range(8)],
    lambda i, j: f"fault * (1 - fault) * a[{i + 1}] * a[{j + 1}]",
    [0.0] * 5 + [0.0, 1.0, 2.0], [1.0] * 5 + [0.0] * 3, 12) + """,
progress AS (
  SELECT iteration, x, loss + 0.5e0 * list_dot_product(x[1:5], x[1:5]) AS objective,
         list_max(list_transform(g, lambda v, i: abs(v + CASE WHEN i <= 5 THEN x[i] ELSE 0 END))) AS norm
  FROM (SELECT iteration, x, sum(greatest(-margin, 0) + ln(1 + exp(-abs(margin)))) AS loss,
               [""" + ", ".join(f"sum(-side * a[{i + 1}] / (1 + exp(margin)))" for i in range(8)) + """] AS g
        FROM (SELECT s.iteration, s.x, d.a, d.side, d.side * list_dot_product(d.a, s.x) AS margin
              FROM states s, design d WHERE d.dataset_partition = 'development')
        GROUP BY iteration, x)),
trace AS (
  SELECT iteration, objective, norm, x, [x[6], x[6] + x[7], x[6] + x[7] + x[8]] AS theta FROM progress
  WHERE iteration <= (SELECT min(iteration) FROM progress
                      WHERE norm <= 1e-9 * greatest(1, abs(objective))))"""


def _fit(spark, sf_dir):
    """A fit on the development windows; one that did not converge is no result."""
    from driftline.session import materialise

    matrix = materialise(co.matrix(spark, sf_dir))
    return mo.require_converged(mo.ordinal_fit(
        matrix.filter(F.col("dataset_partition") == mo.FIT_PARTITION))), matrix


@query("ordinal_fit", with_tables(ORDINAL, body=f"""
SELECT parameter, CAST(position AS INTEGER) AS position, {rounded('value', 5)} AS value FROM (
  SELECT 'mean' AS parameter, i AS position, [{", ".join(f"m{i}" for i in range(5))}][i + 1] AS value
  FROM scaling, range(5) r(i)
  UNION ALL SELECT 'scale', i, [{", ".join(f"s{i}" for i in range(5))}][i + 1] FROM scaling, range(5) r(i)
  UNION ALL SELECT 'beta', i, x[i + 1] FROM (SELECT * FROM trace ORDER BY iteration DESC LIMIT 1), range(5) r(i)
  UNION ALL SELECT 'theta', i, theta[i + 1]
  FROM (SELECT * FROM trace ORDER BY iteration DESC LIMIT 1), range(3) r(i))"""))
def ordinal_fit(spark, sf_dir):
    fit, _ = _fit(spark, sf_dir)
    m = fit.model
    rows = [(name, i, float(v)) for name in ("mean", "scale", "beta", "theta")
            for i, v in enumerate(getattr(m, name))]
    return spark.createDataFrame(rows, "parameter string, position int, value double").withColumn(
        "value", stable_round(F.col("value"), 5))


@query("fit_trace", with_tables(ORDINAL, body=f"""
, guesses AS (
  SELECT t.iteration, v.y AS truth, CASE WHEN p0 >= p1 AND p0 >= p2 AND p0 >= p3 THEN 0
         WHEN p1 >= p2 AND p1 >= p3 THEN 1 WHEN p2 >= p3 THEN 2 ELSE 3 END AS predicted
  FROM (SELECT iteration, window_id, c[1] AS p0, c[2] - c[1] AS p1, c[3] - c[2] AS p2, 1 - c[3] AS p3
        FROM (SELECT t.iteration, s.window_id, list_transform(t.theta, lambda th:
                1 / (1 + exp(-(th - list_dot_product(t.x[1:5], s.z))))) AS c
              FROM trace t, scaled s WHERE s.dataset_partition = 'validation')) t
  JOIN scaled v USING (window_id)),
quality AS (
  SELECT iteration, any_value(accuracy) AS accuracy, avg(f1) AS macro_f1 FROM (
    SELECT iteration, k, avg(CASE WHEN truth = predicted THEN 1.0e0 ELSE 0 END) AS accuracy,
           coalesce(2.0e0 * count(*) FILTER (truth = k AND predicted = k) / nullif(
             count(*) FILTER (truth = k) + count(*) FILTER (predicted = k), 0), 0) AS f1
    FROM guesses, range(4) c(k) GROUP BY iteration, k) GROUP BY iteration)
SELECT CAST(iteration AS INTEGER) AS iteration, {rounded('objective', 5)} AS objective,
       {rounded('objective / (SELECT objective FROM trace WHERE iteration = 0)')} AS normalised_objective,
       {rounded('norm', 5)} AS gradient_norm, {rounded('accuracy')} AS validation_accuracy,
       {rounded('macro_f1')} AS validation_macro_f1
FROM trace LEFT JOIN quality USING (iteration)"""))
def fit_trace(spark, sf_dir):
    fit, matrix = _fit(spark, sf_dir)
    trace = mo.fit_trace(fit, matrix.filter("dataset_partition = 'validation'"))
    digits = {"objective": 5, "gradient_norm": 5}
    return trace.select("iteration", *[
        stable_round(F.col(c), digits.get(c, 6)).alias(c) for c in trace.columns if c != "iteration"])


def _comparator(spark, sf_dir, method, *more):
    from driftline.session import materialise

    matrix = materialise(co.matrix(spark, sf_dir))
    train = matrix.filter("dataset_partition = 'development'")
    return method(train, matrix).select(
        "window_id", "dataset_partition", "risk_label_index", *more, "predicted_index")


# 24 weights: per class five features and the intercept; a shift of all intercepts changes no
# probability, so a small ridge holds them
LOGISTIC = SCALED + """, rows_ AS (
  SELECT window_id, dataset_partition, y, list_append(z, 1.0e0) AS a FROM scaled),
""" + _newton_sql(
    "states", "(SELECT * FROM rows_ WHERE dataset_partition = 'development') d",
    "d.a, d.y, list_transform([0, 1, 2, 3], lambda k: exp(list_dot_product(d.a, s.x[6 * k + 1:6 * k + 6]))"
    " / list_sum(list_transform([0, 1, 2, 3], lambda c: exp(list_dot_product(d.a, s.x[6 * c + 1:6 * c + 6]))))) AS p",
    [f"(p[{i // 6 + 1}] - CASE WHEN y = {i // 6} THEN 1 ELSE 0 END) * a[{i % 6 + 1}]" for i in range(24)],
    lambda i, j: (f"p[{i // 6 + 1}] * ({1 if i // 6 == j // 6 else 0} - p[{j // 6 + 1}])"
                  f" * a[{i % 6 + 1}] * a[{j % 6 + 1}]"),
    [0.0] * 24, ([1.0] * 5 + [1e-6]) * 4, 12)


@query("logistic_comparator", with_tables(LOGISTIC, body="""
SELECT window_id, dataset_partition, risk_label_index, CASE WHEN u[1] >= u[2] AND u[1] >= u[3] AND u[1] >= u[4]
         THEN 0 WHEN u[2] >= u[3] AND u[2] >= u[4] THEN 1 WHEN u[3] >= u[4] THEN 2 ELSE 3 END AS predicted_index
FROM (SELECT window_id, dataset_partition, y AS risk_label_index, list_transform([0, 1, 2, 3], lambda k:
               list_dot_product(a, x[6 * k + 1:6 * k + 6])) AS u
      FROM rows_, (SELECT x FROM states ORDER BY iteration DESC LIMIT 1))"""))
def logistic_comparator(spark, sf_dir):
    return _comparator(spark, sf_dir, mo.logistic_comparator)


def _tree_level(level):
    """Best split of every node of a level, by counts on both sides of each distinct value."""
    rows = "\n    UNION ALL ".join(
        f"SELECT node, {i} AS f, {n} AS v, risk_label_index AS c FROM tree{level} "
        "WHERE dataset_partition = 'development'" for i, n in enumerate(FEATURES))
    classes = range(4)
    left = ", ".join(f"CAST(sum(n{k}) OVER w AS DOUBLE) AS l{k}" for k in classes)
    total = ", ".join(f"CAST(sum(n{k}) OVER (PARTITION BY node, f) AS DOUBLE) AS t{k}" for k in classes)
    l_size, t_size = " + ".join(f"l{k}" for k in classes), " + ".join(f"t{k}" for k in classes)
    l_square = " + ".join(f"l{k} * l{k}" for k in classes)
    r_square = " + ".join(f"(t{k} - l{k}) * (t{k} - l{k})" for k in classes)
    t_square = " + ".join(f"t{k} * t{k}" for k in classes)
    case = " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(FEATURES))
    return f"""melted{level} AS (
    {rows}),
counted{level} AS (
  SELECT node, f, v, {", ".join(f"count(*) FILTER (c = {k}) AS n{k}" for k in classes)}
  FROM melted{level} GROUP BY node, f, v),
summed{level} AS (
  SELECT node, f, v, lead(v) OVER (PARTITION BY node, f ORDER BY v) AS following, {left}, {total}
  FROM counted{level} WINDOW w AS (PARTITION BY node, f ORDER BY v ROWS UNBOUNDED PRECEDING)),
best{level} AS (
  SELECT node, f, (v + following) / 2.0e0 AS threshold
  FROM (SELECT *, ({l_square}) / ({l_size}) + ({r_square}) / (({t_size}) - ({l_size})) AS purity
        FROM summed{level} WHERE {l_size} >= 2 AND ({t_size}) - ({l_size}) >= 2)
  WHERE purity > ({t_square}) / ({t_size})
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY purity DESC, f, v) = 1),
tree{level + 1} AS (
  SELECT t.* REPLACE (CASE WHEN b.node IS NULL THEN t.node
           WHEN CASE b.f {case} END <= b.threshold THEN 2 * t.node + 1 ELSE 2 * t.node + 2 END AS node)
  FROM tree{level} t LEFT JOIN best{level} b ON b.node = t.node AND t.node >= {2 ** level - 1})"""


TREE = MATRIX + """, tree0 AS (SELECT *, 0 AS node FROM matrix),
""" + ",\n".join(_tree_level(level) for level in range(3)) + """,
majority AS (
  SELECT node, c AS predicted_index FROM (
    SELECT node, risk_label_index AS c, count(*) AS n FROM tree3
    WHERE dataset_partition = 'development' GROUP BY node, risk_label_index)
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, c) = 1)"""


@query("tree_comparator", with_tables(TREE, body="""
SELECT window_id, dataset_partition, risk_label_index, CAST(t.node AS INTEGER) AS leaf,
       CAST(predicted_index AS INTEGER) AS predicted_index
FROM tree3 t JOIN majority USING (node)"""))
def tree_comparator(spark, sf_dir):
    return _comparator(spark, sf_dir, mo.tree_comparator, "leaf")


@query("example_per_class", with_tables(SCORED, body="""
SELECT predicted_index, window_id, session_id, predicted_label FROM (
  SELECT *, row_number() OVER (PARTITION BY predicted_index ORDER BY session_id, window_index) AS nth
  FROM scored) WHERE nth = 1"""))
def example_per_class(spark, sf_dir):
    return mo.example_per_class(scored(spark, sf_dir), ["session_id", "window_index"]).select(
        "predicted_index", "window_id", "session_id", "predicted_label")


# metrics --------------------------------------------------------------------------------

_bin = "CAST(CASE WHEN {0} < 15 THEN 0 WHEN {0} < 40 THEN 1 WHEN {0} < 80 THEN 2 ELSE 3 END AS INTEGER)"
PREDICTIONS = t.EV + ", " + t.PARTITION + f""", predictions AS (
  SELECT event_id, e.session_id, model, dataset_partition, {_bin.format('value')} AS truth,
         CASE WHEN guess IS NOT NULL THEN {_bin.format('guess')} END AS predicted
  FROM (SELECT event_id, session_id, value, model,
               CASE model WHEN 'previous' THEN before ELSE before * 1.5e0 END AS guess
        FROM (SELECT *, lag(value) OVER (PARTITION BY session_id ORDER BY event_id) AS before FROM ev),
             (VALUES ('previous'), ('scaled')) v(model)) e JOIN part_manifest USING (session_id)),
usable AS (SELECT * FROM predictions WHERE predicted IS NOT NULL)"""


def _value_class(value):
    return F.when(value < 15, 0).when(value < 40, 1).when(value < 80, 2).otherwise(3)


def predictions(spark, sf_dir):
    """Each event's value class against the class of the user's previous value."""
    lagged = lag_in_order(t.ev(spark, sf_dir), ["session_id"], ["event_id"],
                          {"value": "before"}, 1_000_000)
    before = F.col("before")
    guesses = F.explode(F.array(
        F.struct(F.lit("previous").alias("model"), before.alias("guess")),
        F.struct(F.lit("scaled").alias("model"), (before * 1.5).alias("guess"))))
    rows = lagged.select("event_id", "session_id", "value", guesses.alias("_g")).select(
        "event_id", "session_id", "_g.model", _value_class(F.col("value")).alias("truth"),
        F.when(F.col("_g.guess").isNotNull(), _value_class(F.col("_g.guess"))).alias("predicted"))
    partition = t.partition_manifest(spark, sf_dir).select("session_id", "dataset_partition")
    return rows.join(partition, "session_id")


def usable(spark, sf_dir):
    return predictions(spark, sf_dir).filter("predicted is not null")


CONFUSION = PREDICTIONS + """, cells AS (
  SELECT m.model, m.dataset_partition, CAST(i AS INTEGER) AS truth, CAST(j AS INTEGER) AS predicted,
         count(u.event_id) AS n
  FROM (SELECT DISTINCT model, dataset_partition FROM usable) m, range(4) a(i), range(4) b(j)
  LEFT JOIN usable u ON u.model = m.model AND u.dataset_partition = m.dataset_partition
       AND u.truth = i AND u.predicted = j GROUP BY ALL),
per_class AS (
  SELECT model, dataset_partition, c AS class_index, coalesce(hits / nullif(guessed, 0), 0) AS precision,
         coalesce(hits / nullif(support, 0), 0) AS recall,
         coalesce(2.0e0 * hits / nullif(support + guessed, 0), 0) AS f1, CAST(support AS BIGINT) AS support
  FROM (SELECT model, dataset_partition, CAST(c AS INTEGER) AS c,
               CAST(sum(n) FILTER (truth = c AND predicted = c) AS DOUBLE) AS hits,
               CAST(sum(n) FILTER (truth = c) AS DOUBLE) AS support,
               CAST(sum(n) FILTER (predicted = c) AS DOUBLE) AS guessed
        FROM cells, range(4) v(c) GROUP BY ALL)),
kappas AS (
  SELECT model, dataset_partition, 1 - observed / nullif(sum(w * r * c) / any_value(total), 0) AS kappa
  FROM (SELECT model, dataset_partition, truth, predicted, (truth - predicted) ** 2 AS w,
               CAST(sum(n) OVER (PARTITION BY model, dataset_partition, truth) AS DOUBLE) AS r,
               CAST(sum(n) OVER (PARTITION BY model, dataset_partition, predicted) AS DOUBLE) AS c,
               CAST(sum(n) OVER (PARTITION BY model, dataset_partition) AS DOUBLE) AS total,
               CAST(sum(n * (truth - predicted) ** 2) OVER (PARTITION BY model, dataset_partition) AS DOUBLE)
                 AS observed
        FROM cells) GROUP BY model, dataset_partition, observed),
hits AS (
  SELECT model, dataset_partition, count(*) AS row_count,
         avg(CASE WHEN truth = predicted THEN 1.0e0 ELSE 0.0e0 END) AS accuracy,
         avg(CASE WHEN abs(truth - predicted) = 1 THEN 1.0e0 ELSE 0.0e0 END) AS adjacent
  FROM usable GROUP BY model, dataset_partition)"""
GROUPS = ["model", "dataset_partition"]


@query("confusion_matrix", with_tables(CONFUSION, body="SELECT * FROM cells"))
def confusion_matrix(spark, sf_dir):
    return me.confusion_matrix(usable(spark, sf_dir), GROUPS)


@query("per_class_metrics", with_tables(CONFUSION, body=f"""
SELECT model, dataset_partition, class_index, {rounded('precision')} AS precision,
       {rounded('recall')} AS recall, {rounded('f1')} AS f1, support FROM per_class"""))
def per_class_metrics(spark, sf_dir):
    m = me.per_class_metrics(usable(spark, sf_dir), GROUPS)
    return m.withColumns({c: stable_round(F.col(c)) for c in ("precision", "recall", "f1")})


@query("macro_f1", with_tables(CONFUSION, body=f"""
SELECT model, dataset_partition, {rounded('sum(f1) / 4')} AS macro_f1 FROM per_class
GROUP BY model, dataset_partition"""))
def macro_f1(spark, sf_dir):
    return me.macro_f1(usable(spark, sf_dir), GROUPS).withColumn(
        "macro_f1", stable_round(F.col("macro_f1")))


@query("quadratic_weighted_kappa", with_tables(CONFUSION, body=f"""
SELECT model, dataset_partition, {rounded('kappa')} AS quadratic_weighted_kappa FROM kappas"""))
def quadratic_weighted_kappa(spark, sf_dir):
    return me.quadratic_weighted_kappa(usable(spark, sf_dir), GROUPS).withColumn(
        "quadratic_weighted_kappa", stable_round(F.col("quadratic_weighted_kappa")))


@query("accuracy", with_tables(CONFUSION, body=f"""
SELECT model, dataset_partition, row_count, {rounded('accuracy')} AS accuracy FROM hits"""))
def accuracy(spark, sf_dir):
    return me.accuracy(usable(spark, sf_dir), GROUPS).withColumn(
        "accuracy", stable_round(F.col("accuracy")))


@query("adjacent_class_error_rate", with_tables(CONFUSION, body=f"""
SELECT model, dataset_partition, {rounded('adjacent')} AS adjacent_error_rate FROM hits"""))
def adjacent_class_error_rate(spark, sf_dir):
    return me.adjacent_class_error_rate(usable(spark, sf_dir), GROUPS).withColumn(
        "adjacent_error_rate", stable_round(F.col("adjacent_error_rate")))


@query("validate_labels", with_tables(PREDICTIONS, body="""
SELECT count(*) AS row_count, 0::BIGINT AS truth_missing,
       count(*) FILTER (truth > 2) AS truth_out_of_range,
       count(*) FILTER (predicted IS NULL) AS predicted_missing,
       count(*) FILTER (predicted > 2) AS predicted_out_of_range FROM predictions"""))
def validate_labels(spark, sf_dir):
    return me.validate_labels(predictions(spark, sf_dir), classes=3)


def _metric_table(spark, sf_dir):
    table = me.metric_table(usable(spark, sf_dir), GROUPS)
    return table.withColumns({c: stable_round(F.col(c)) for c in (
        "accuracy", "macro_f1", "quadratic_weighted_kappa")})


METRICS = CONFUSION + f""", metric_table AS (
  SELECT h.model, h.dataset_partition, row_count, {rounded('accuracy')} AS accuracy,
         {rounded('f.macro')} AS macro_f1, {rounded('kappa')} AS quadratic_weighted_kappa
  FROM hits h JOIN (SELECT model, dataset_partition, sum(f1) / 4 AS macro FROM per_class
                    GROUP BY model, dataset_partition) f USING (model, dataset_partition)
  JOIN kappas USING (model, dataset_partition))"""
query("metrics_by_model_partition", with_tables(METRICS, body="SELECT * FROM metric_table"))(
    _metric_table)


@query("metric_snapshot_diff", with_tables(METRICS, body="""
, long AS (
  SELECT model, dataset_partition, 'accuracy' AS metric, accuracy AS v FROM metric_table
  UNION ALL SELECT model, dataset_partition, 'macro_f1', macro_f1 FROM metric_table)
SELECT a.model, a.dataset_partition, a.metric, b.v AS published, a.v AS recomputed
FROM long a LEFT JOIN (SELECT 'previous' AS model, * EXCLUDE (model) FROM long WHERE model = 'scaled'
                       UNION ALL SELECT * FROM long WHERE model = 'scaled') b
  ON a.model = b.model AND a.dataset_partition = b.dataset_partition AND a.metric = b.metric
WHERE abs(a.v - b.v) > 0.001"""))
def metric_snapshot_diff(spark, sf_dir):
    current = _metric_table(spark, sf_dir)
    scaled = current.filter("model = 'scaled'")
    published = scaled.withColumn("model", F.lit("previous")).unionByName(scaled)
    return me.metric_snapshot_diff(published, current, GROUPS, ["accuracy", "macro_f1"], 0.001)


@query("prediction_snapshot_diff", with_tables(PREDICTIONS, body="""
SELECT event_id, snapshot_class, current_class,
       CASE WHEN current_class IS NULL THEN 'snapshot_only' WHEN snapshot_class IS NULL
            THEN 'current_only' ELSE 'class_changed' END AS problem
FROM (SELECT event_id, predicted AS snapshot_class FROM usable
      WHERE model = 'previous' AND dataset_partition <> 'final_test') s
FULL JOIN (SELECT event_id, predicted AS current_class FROM usable
           WHERE model = 'scaled' AND dataset_partition <> 'development') c USING (event_id)
WHERE snapshot_class IS DISTINCT FROM current_class"""))
def prediction_snapshot_diff(spark, sf_dir):
    rows = usable(spark, sf_dir)
    snapshot = rows.filter("model = 'previous' and dataset_partition <> 'final_test'")
    current = rows.filter("model = 'scaled' and dataset_partition <> 'development'")
    return me.prediction_snapshot_diff(snapshot, current, "event_id")


@query("truth_support", with_tables(PREDICTIONS, body="""
SELECT m.dataset_partition, CAST(i AS INTEGER) AS truth, count(p.event_id) AS support,
       count(DISTINCT p.session_id) AS session_count
FROM (SELECT DISTINCT dataset_partition FROM usable) m, range(4) a(i)
LEFT JOIN usable p ON p.dataset_partition = m.dataset_partition AND p.truth = i
  AND p.model = 'previous' GROUP BY ALL"""))
def truth_support(spark, sf_dir):
    rows = usable(spark, sf_dir).filter("model = 'previous'")
    return me.truth_support(rows, groups=["dataset_partition"])


@query("prediction_table", with_tables(
    MATRIX + ", scored AS (" + scored_sql("matrix", "dataset_partition = 'validation'") + ")", body=f"""
SELECT window_id, session_id, bag_id, sensor_id, dataset_partition, risk_label, risk_label_index,
       predicted_label, predicted_index, {PROBS} FROM scored"""))
def prediction_table(spark, sf_dir):
    validation = co.matrix(spark, sf_dir).filter("dataset_partition = 'validation'")
    return mo.rounded_probabilities(mo.ordinal_score(validation, EVENT_MODEL)).select(
        "window_id", "session_id", "bag_id", "sensor_id", "dataset_partition", "risk_label",
        "risk_label_index", "predicted_label", "predicted_index", *mo.probability_columns())


# monitoring -----------------------------------------------------------------------------

MONITOR = co.OUTCOMES + ", scored AS (" + scored_sql("features") + """),
warnings AS (
  SELECT session_id, min(window_end) AS first_warning, count(*) AS warning_count
  FROM scored WHERE predicted_index >= 2 GROUP BY session_id),
lead AS (
  SELECT e.session_id, physical_leak, first_warning,
         coalesce(first_warning < physical_leak, false) AS warned,
         CASE WHEN first_warning < physical_leak THEN physical_leak - first_warning END AS lead_time_ms
  FROM event_summary e LEFT JOIN warnings USING (session_id) WHERE physical_leak IS NOT NULL)"""


def _lead(spark, sf_dir):
    leaks = co.lab.event_summary(co.outcome_events(spark, sf_dir), t.DAY).filter(
        "physical_leak is not null").select("session_id", "physical_leak")
    return mn.warning_lead_time(scored(spark, sf_dir), leaks)


query("warning_lead_time", with_tables(MONITOR, body="SELECT * FROM lead"))(_lead)


@query("event_detection_rate", with_tables(MONITOR, body=f"""
SELECT count(*) AS leak_sessions, count(*) FILTER (warned) AS warned_sessions,
       {rounded('count(*) FILTER (warned) / count(*)::DOUBLE')} AS detection_rate FROM lead"""))
def event_detection_rate(spark, sf_dir):
    return mn.event_detection_rate(_lead(spark, sf_dir)).withColumn(
        "detection_rate", stable_round(F.col("detection_rate")))


@query("false_alerts_per_hour", with_tables(MONITOR, body=f"""
SELECT session_id, coalesce(warning_count, 0) AS alert_count,
       {rounded('(end_timestamp - start_timestamp) / 3600000.0e0')} AS session_hours,
       {rounded('coalesce(warning_count, 0) / ((end_timestamp - start_timestamp) / 3600000.0e0)')}
         AS alerts_per_hour
FROM sessions LEFT JOIN warnings USING (session_id) WHERE arm = 'SAFE'"""))
def false_alerts_per_hour(spark, sf_dir):
    safe = t.sessions(spark, sf_dir).filter("arm = 'SAFE'").select(
        "session_id", "start_timestamp", "end_timestamp")
    alerts = mn.false_alerts_per_hour(scored(spark, sf_dir), safe)
    return alerts.withColumns({c: stable_round(F.col(c))
                               for c in ("session_hours", "alerts_per_hour")})


@query("direct_alarm_latency", with_tables(t.POINT_EVENTS, body="""
SELECT *, t_confirm - t_leak AS latency_ms FROM (
  SELECT session_id, min(timestamp) FILTER (event_type = 'PHYSICAL_LEAK_OBSERVED') AS t_leak,
         min(timestamp) FILTER (event_type = 'LEAK_FLAG_FIRST') AS t_flag,
         min(timestamp) FILTER (event_type = 'LEAK_FLAG_CONFIRMED') AS t_confirm
  FROM point_events GROUP BY session_id) WHERE t_leak IS NOT NULL AND t_confirm IS NOT NULL"""))
def direct_alarm_latency(spark, sf_dir):
    return mn.direct_alarm_latency(t.point_events(spark, sf_dir))


@query("status_transitions_per_hour", with_tables(MONITOR, body=f"""
SELECT session_id, count(*) AS window_count, count(*) FILTER (before <> predicted_index) AS transition_count,
       CASE WHEN max(window_end) > min(window_end) THEN
         {rounded('count(*) FILTER (before <> predicted_index) / '
                  '((max(window_end) - min(window_end)) / 3600000.0e0)')} END AS transitions_per_hour
FROM (SELECT *, lag(predicted_index) OVER (PARTITION BY session_id ORDER BY window_index) AS before
      FROM scored) GROUP BY session_id"""))
def status_transitions_per_hour(spark, sf_dir):
    return mn.status_transitions_per_hour(scored(spark, sf_dir)).withColumn(
        "transitions_per_hour", stable_round(F.col("transitions_per_hour")))


@query("result_freshness", with_tables(t.EV, body=f"""
, results AS (
  SELECT event_id AS result_id, 'd' || (user_id % 7) AS device_id,
         (timestamp // {t.HOUR}) * {t.HOUR} + CASE WHEN k < 5 THEN {2 * t.HOUR} ELSE 0 END AS window_end,
         timestamp AS received_at, timestamp + k * 10000 AS evaluated_at FROM ev)
SELECT result_id, device_id, window_end,
       CASE WHEN window_end > received_at THEN 'FUTURE' WHEN nth > 1 THEN 'REPLAYED'
            WHEN received_at - window_end > 1800000 THEN 'LATE'
            WHEN evaluated_at - window_end > 2000000 THEN 'STALE' ELSE 'FRESH' END AS freshness
FROM (SELECT *, row_number() OVER (PARTITION BY device_id, window_end
                                   ORDER BY received_at, result_id) AS nth FROM results)"""))
def result_freshness(spark, sf_dir):
    k, ts = F.col("k"), F.col("timestamp")
    results = t.ev(spark, sf_dir).select(
        F.col("event_id").alias("result_id"),
        F.concat(F.lit("d"), F.col("user_id") % 7).alias("device_id"),
        (F.floor(ts / t.HOUR) * t.HOUR + F.when(k < 5, 2 * t.HOUR).otherwise(0)).alias("window_end"),
        ts.alias("received_at"), (ts + k * 10_000).alias("evaluated_at"))
    return mn.result_freshness(results, stale_ms=2_000_000, late_ms=1_800_000)


@query("exposure_history", with_tables(t.POINT_EVENTS, body=f"""
SELECT session_id, seq, timestamp,
       count(*) FILTER (event_type = 'PHYSICAL_LEAK_OBSERVED') OVER w AS leaks,
       count(*) FILTER (event_type = 'ALERT_IGNORED') OVER w AS ignored_alerts
FROM point_events
WINDOW w AS (PARTITION BY session_id ORDER BY timestamp RANGE BETWEEN {3 * t.DAY} PRECEDING AND CURRENT ROW)
"""))
def exposure_history(spark, sf_dir):
    return mn.exposure_history(t.point_events(spark, sf_dir), 3 * t.DAY, {
        "leaks": "PHYSICAL_LEAK_OBSERVED", "ignored_alerts": "ALERT_IGNORED"})


WET = {"PHYSICAL_LEAK_OBSERVED": 3 * t.DAY, "LEAK_FLAG_CONFIRMED": t.DAY, "LEAK_FLAG_FIRST": t.DAY // 2}


@query("longest_exposure", with_tables(t.POINT_EVENTS, f"""wet AS (
  SELECT session_id, seq, timestamp AS start_timestamp, timestamp + CASE event_type {" ".join(
      f"WHEN '{kind}' THEN {ms}" for kind, ms in WET.items())} END AS end_timestamp
  FROM point_events WHERE event_type IN ({", ".join(f"'{kind}'" for kind in WET)})),
opened AS (
  SELECT *, start_timestamp > coalesce(max(end_timestamp) OVER (
           PARTITION BY session_id ORDER BY start_timestamp, seq
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + {t.HOUR} AS opens FROM wet),
numbered AS (
  SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (
           PARTITION BY session_id ORDER BY start_timestamp, seq) AS exposure FROM opened),
exposures AS (
  SELECT session_id, max(end_timestamp) - min(start_timestamp) AS ms FROM numbered
  GROUP BY session_id, exposure)""", body="""
SELECT session_id, count(*) AS exposure_count, CAST(sum(ms) AS BIGINT) AS total_exposure_ms,
       max(ms) AS longest_exposure_ms
FROM exposures GROUP BY session_id"""))
def longest_exposure(spark, sf_dir):
    """Wet times after leaks and leak flags, joined where less than an hour lies between them."""
    events = t.point_events(spark, sf_dir)
    wet = F.coalesce(*[F.when(F.col("event_type") == kind, F.lit(ms)) for kind, ms in WET.items()])
    intervals = events.where(wet.isNotNull()).select(
        "session_id", "seq", F.col("timestamp").alias("start_timestamp"),
        (F.col("timestamp") + wet).alias("end_timestamp"))
    return mn.longest_exposure(mn.coalesced_intervals(intervals, t.HOUR, block_ms=t.DAY))
