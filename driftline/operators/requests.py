"""Stateless evaluation of window requests (batch or stream).

A request carries its own bounded sample arrays, so every check and feature is
an array expression on one row: no shuffle, no state, and the same code runs
on a streaming DataFrame.  Intermediate results are staged as columns so that
each array is walked once per step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from driftline import contract
from driftline.functions.arrays import adjacent, has_duplicates, let, median, once
from driftline.functions.ordinal import (
    OrdinalModel, argmax_lowest, class_probabilities, linear_predictor)
from driftline.functions.parsing import is_finite
from driftline.functions.rounding import stable_round
from driftline.functions.rules import OUTPUT_STATES

MAX_SAFE_INTEGER = 2 ** 53 - 1


@dataclass(frozen=True)
class RequestSpec:
    rate: int = 10
    baseline_seconds: int = 60
    window_seconds: int = 120
    stride_ms: int = 10_000
    sample_low_ms: int = 80
    sample_high_ms: int = 120
    bin_low_ms: int = 800
    bin_high_ms: int = 1200
    max_text: int = 128
    request_version: str = "0.1.0"
    statuses: tuple = ("OK", "NOT_EVALUATED")
    decimals: int = 6

    @property
    def baseline_ms(self) -> int:
        return self.baseline_seconds * 1000

    @property
    def window_ms(self) -> int:
        return self.window_seconds * 1000


def parse_window_request(df: DataFrame, body: str = "body") -> DataFrame:
    """JSON text to request columns; ``parse_problem`` names a broken envelope.

    Field sets must match exactly, both of the request and of every sample.
    """
    expected = F.sort_array(F.array(*[F.lit(n) for n in contract.REQUEST_FIELDS]))
    sample_fields = F.sort_array(F.array(*[F.lit(f.name) for f in contract.REQUEST_SAMPLE]))

    def sample_shape(field):
        raw = F.from_json(F.get_json_object(body, f"$.{field}"), "array<map<string,string>>")
        return F.coalesce(F.forall(raw, lambda m: F.sort_array(F.map_keys(m)) == sample_fields),
                          F.lit(False))

    keys = F.json_object_keys(body)
    problem = (
        F.when(keys.isNull(), "NOT_AN_OBJECT")
        .when(F.sort_array(keys) != expected, "REQUEST_FIELDS")
        .when(~sample_shape("baseline_samples") | ~sample_shape("window_samples"), "SAMPLE_FIELDS"))
    parsed = df.withColumns({
        "_request": F.from_json(body, contract.REQUEST_SCHEMA), "parse_problem": problem})
    return parsed.select(*[c for c in df.columns if c != body], "parse_problem", "_request.*")


def request_problem(spec: RequestSpec) -> Column:
    """First structural fault of a parsed request; null when it is well formed."""
    def text(name):
        value = F.col(name)
        return value.isNull() | (F.trim(value) == "") | (F.length(value) > spec.max_text)

    def samples(name, limit):
        rows = F.col(name)

        def broken(r):
            integer = lambda v: v.isNull() | ~v.between(0, MAX_SAFE_INTEGER)
            reading = r["kap_7_raw"]
            return (integer(r["sample_no"]) | integer(r["elapsed_ms"])
                    | ~F.coalesce(is_finite(reading)
                                  & reading.between(0, contract.MAX_RAW_READING), F.lit(False))
                    | (F.coalesce(r["kap_7_status"], F.lit("")) == ""))

        return rows.isNull() | (F.size(rows) > limit) | F.exists(rows, broken)

    end = F.col("source_window_end_ms")
    return (
        F.when(~F.col("request_version").eqNullSafe(spec.request_version), "REQUEST_VERSION")
        .when(text("device_id"), "DEVICE_ID").when(text("session_id"), "SESSION_ID")
        .when(text("acquisition_id"), "ACQUISITION_ID")
        .when(F.col("operator_confirmed").isNull(), "OPERATOR_CONFIRMED")
        .when(end.isNull() | ~end.between(0, MAX_SAFE_INTEGER), "WINDOW_END")
        .when(end % spec.stride_ms != 0, "WINDOW_ALIGNMENT")
        .when(samples("baseline_samples", spec.baseline_seconds * spec.rate), "BASELINE_SAMPLES")
        .when(samples("window_samples", spec.window_seconds * spec.rate), "WINDOW_SAMPLES"))


def raw_window_reason(rows: Column, seconds: int, spec: RequestSpec) -> Column:
    """First failing raw check of a sample array, in the fixed order; null when clean."""
    def judge(v):
        steps, jumps = v["steps"], v["jumps"]
        return (
            F.when(F.size(v["times"]) != seconds * spec.rate, "INCOMPLETE_DATA")
            .when(has_duplicates(v["times"]) | has_duplicates(v["numbers"]), "DUPLICATE_SAMPLE")
            .when(F.exists(steps, lambda d: d <= 0), "OUT_OF_ORDER")
            .when(F.exists(jumps, lambda d: d != 1), "DATA_GAP")
            .when(F.exists(steps, lambda d: ~d.between(spec.sample_low_ms, spec.sample_high_ms)),
                  "TIMING_OUT_OF_TOLERANCE")
            .when(F.exists(v["statuses"], lambda s: ~s.isin(*spec.statuses)), "SENSOR_PROBLEM"))

    times = F.transform(rows, lambda r: r["elapsed_ms"])
    numbers = F.transform(rows, lambda r: r["sample_no"])
    return let(F.struct(
        times.alias("times"), numbers.alias("numbers"),
        adjacent(times, lambda a, b: b - a).alias("steps"),
        adjacent(numbers, lambda a, b: b - a).alias("jumps"),
        F.transform(rows, lambda r: r["kap_7_status"]).alias("statuses")), judge)


def time_bins(rows: Column, start: Column, seconds: int, spec: RequestSpec) -> Column:
    """One struct per second: index fit, last time, median reading, all-OK flag.

    Raw checks guarantee ascending times and ``seconds * rate`` rows, so each
    bin is complete exactly when every ``rate``-long slice lies in its second.
    """
    def reduce_bin(i, part):
        return F.struct(
            i.alias("bin"),
            F.forall(part, lambda r: F.floor((r["elapsed_ms"] - start) / 1000) == i)
            .alias("complete"),
            F.element_at(part, -1)["elapsed_ms"].alias("ts"),
            median(F.transform(part, lambda r: r["kap_7_raw"])).alias("value"),
            F.forall(part, lambda r: r["kap_7_status"] == "OK").alias("ok"))

    return let(rows, lambda all_rows: F.transform(
        F.sequence(F.lit(0), F.lit(seconds - 1)),
        lambda i: let(F.slice(all_rows, i * spec.rate + 1, F.lit(spec.rate)),
                      lambda part: reduce_bin(i, part))))


def _bin_reason(bins: Column, spec: RequestSpec) -> Column:
    steps = adjacent(bins, lambda a, b: b["ts"] - a["ts"])
    return (
        F.when(F.exists(bins, lambda b: ~b["complete"]), "INCOMPLETE_DATA")
        .when(F.exists(steps, lambda d: ~d.between(spec.bin_low_ms, spec.bin_high_ms)),
              "TIMING_OUT_OF_TOLERANCE"))


def _out_of_range(rows: Column, start: Column, length_ms: int) -> Column:
    return F.exists(rows, lambda r: ~(r["elapsed_ms"] - start).between(0, length_ms - 1))


def _overlap_conflicts(base: Column, window: Column, spec: RequestSpec) -> Column:
    """Number of different window samples of the baseline's time that the baseline does not hold.

    ``array_except`` compares all pairs of structs.  The overlap is laid on the baseline where its
    first time stands, and only samples that differ from the one beside them are compared.
    """
    times = F.transform(base, lambda r: r["elapsed_ms"])

    def unlike(v):
        at = F.array_position(times, F.get(v, F.lit(0))["elapsed_ms"])
        beside = F.slice(base, F.greatest(F.coalesce(at, F.lit(0)), F.lit(1)).cast("int"), F.size(v))
        pairs = F.zip_with(v, beside, lambda a, b: F.when(~a.eqNullSafe(b), a))
        return F.size(F.array_except(F.filter(pairs, lambda a: a.isNotNull()), base))

    return let(F.filter(window, lambda x: x["elapsed_ms"] < spec.baseline_ms), unlike)


def reduction(spec: RequestSpec) -> Column:
    """Struct of all checks and one-second bins of a parsed request.

    The steps are nested bindings inside one expression, so a filter on any
    derived column re-evaluates it at most once more when it is pushed down.
    """
    start = F.col("source_window_end_ms") - spec.window_ms
    zero = F.lit(0).cast("bigint")
    base, window = F.col("baseline_samples"), F.col("window_samples")
    raw = F.struct(
        request_problem(spec).alias("request_problem"),
        raw_window_reason(base, spec.baseline_seconds, spec).alias("base_raw"),
        raw_window_reason(window, spec.window_seconds, spec).alias("window_raw"),
        _out_of_range(base, zero, spec.baseline_ms).alias("base_outside"),
        _out_of_range(window, start, spec.window_ms).alias("window_outside"))

    def with_bins(r):
        bins = F.struct(
            F.when(r["base_raw"].isNull(), time_bins(base, zero, spec.baseline_seconds, spec))
            .alias("base"),
            F.when(r["window_raw"].isNull(), time_bins(window, start, spec.window_seconds, spec))
            .alias("window"))
        return let(bins, lambda b: F.struct(
            *[r[name].alias(name) for name in (
                "request_problem", "base_raw", "window_raw", "base_outside", "window_outside")],
            b["base"].alias("base_bins"), b["window"].alias("window_bins"),
            F.coalesce(r["base_raw"], _bin_reason(b["base"], spec)).alias("baseline_reason"),
            F.coalesce(r["window_raw"], _bin_reason(b["window"], spec)).alias("window_reason"),
            _overlap_conflicts(base, window, spec).cast("bigint").alias("overlap_conflicts")))

    return let(raw, with_bins)


def reduce_requests(requests: DataFrame, spec: RequestSpec) -> DataFrame:
    """Adds the reduction as column ``reduced``."""
    return requests.withColumn("reduced", once(reduction(spec)))


def availability(r: Column, spec: RequestSpec) -> Column:
    """Struct (problem, reason) of a reduction; the first matching reason wins.

    A malformed request has a problem and no reason.
    """
    end, confirmed = F.col("source_window_end_ms"), F.col("operator_confirmed")
    base_used = confirmed & (end >= spec.baseline_ms)
    window_used = base_used & r["baseline_reason"].isNull() & (end >= spec.window_ms)
    problem = (
        F.when(r["request_problem"].isNotNull(), r["request_problem"])
        .when(base_used & r["base_raw"].isNull() & r["base_outside"], "SAMPLE_OUT_OF_RANGE")
        .when(window_used & r["window_raw"].isNull() & r["window_outside"], "SAMPLE_OUT_OF_RANGE")
        .when(window_used & r["window_reason"].isNull() & (r["overlap_conflicts"] > 0),
              "OVERLAP_CONFLICT"))
    reason = (
        F.when(~confirmed, "OPERATOR_CONFIRMATION_REQUIRED")
        .when(end < spec.baseline_ms, "COLLECTING_BASELINE")
        .when(r["baseline_reason"].isNotNull(),
              F.concat(F.lit("BASELINE_"), r["baseline_reason"]))
        .when(end < spec.window_ms, "COLLECTING_WINDOW")
        .when(r["window_reason"].isNotNull(), r["window_reason"])
        .otherwise("READY"))
    return let(problem, lambda p: F.struct(
        p.alias("problem"), F.when(p.isNull(), reason).alias("reason")))


def array_features(bins: Column, baseline: Column, decimals: int = 6) -> Column:
    """The five window features of an array of (ts, value) bins, as one struct."""
    def total(array, term):
        return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + term(x))

    def centers(points):
        n = F.size(points).cast("double")
        return F.struct(points.alias("points"), n.alias("n"),
                        (total(points, lambda p: p["v"]) / n).alias("mv"),
                        (total(points, lambda p: p["t"]) / n).alias("mt"))

    def features(m):
        points, mv, mt = m["points"], m["mv"], m["mt"]
        s_vv = total(points, lambda p: (p["v"] - mv) * (p["v"] - mv))
        s_tt = total(points, lambda p: (p["t"] - mt) * (p["t"] - mt))
        s_tv = total(points, lambda p: (p["t"] - mt) * (p["v"] - mv))
        values = F.transform(points, lambda p: p["v"])
        raw = (mv, F.element_at(points, -1)["v"], F.try_divide(s_tv, s_tt), s_vv / m["n"],
               F.array_max(values) - F.array_min(values))
        return F.struct(*[stable_round(expr, decimals).alias(name)
                          for name, expr in zip(contract.FEATURE_COLUMNS, raw)])

    def points_of(c):
        return F.transform(c["bins"], lambda b: F.struct(
            ((b["ts"] - c["t0"]) / F.lit(1000.0)).alias("t"), (b["value"] - c["base"]).alias("v")))

    context = let(bins, lambda bs: F.struct(
        bs.alias("bins"), F.element_at(bs, 1)["ts"].alias("t0"), baseline.alias("base")))
    return let(context, lambda c: let(points_of(c), lambda p: let(centers(p), features)))


def evaluation(model: OrdinalModel, spec: RequestSpec) -> Column:
    """Struct: problem, reason, quality, baseline, the five features and the class index."""
    no_features = F.lit(None).cast(
        "struct<" + ",".join(f"{name}:double" for name in contract.FEATURE_COLUMNS) + ">")

    def finite(f):
        checks = [is_finite(f[name]) for name in contract.FEATURE_COLUMNS]
        return F.forall(F.array(*checks), lambda ok: ok)

    def answer(r, a, baseline, f):
        ready = F.coalesce(a["reason"] == "READY", F.lit(False))
        broken = ready & ~F.coalesce(finite(f), F.lit(False))
        automatic = F.forall(r["base_bins"], lambda b: b["ok"]) \
            & F.forall(r["window_bins"], lambda b: b["ok"])
        eta = linear_predictor(model, lambda name: f[name])
        index = let(eta, lambda e: argmax_lowest(F.array(*class_probabilities(e, model.theta))))
        return F.struct(
            a["problem"].alias("problem"),
            F.when(broken, "NUMERICAL_ERROR").otherwise(a["reason"]).alias("reason"),
            F.when(ready, F.when(automatic, "AUTOMATIC").otherwise("OPERATOR_ONLY"))
            .when(a["reason"].isNotNull(), "UNKNOWN").alias("quality"),
            F.when(ready & ~broken, baseline).alias("baseline"),
            *[F.when(~broken, f[name]).alias(name) for name in contract.FEATURE_COLUMNS],
            F.when(ready & ~broken, index).alias("class_index"))

    def judge(r):
        def with_availability(a):
            ready = a["reason"] == "READY"
            baseline = F.when(ready, median(F.transform(r["base_bins"], lambda b: b["value"])))
            return let(baseline, lambda base: let(
                F.when(ready, array_features(r["window_bins"], base, spec.decimals))
                .otherwise(no_features),
                lambda f: answer(r, a, base, f)))

        return let(availability(r, spec), with_availability)

    return let(reduction(spec), judge)


def evaluate_window_requests(requests: DataFrame, model: OrdinalModel, model_sha256: str,
                             spec: RequestSpec = RequestSpec(),
                             mode: str = "UNVALIDATED") -> DataFrame:
    """Response row per request: availability, quality, baseline, features and class.

    A malformed request keeps its row with ``problem`` set and everything else
    null; the class is null whenever no usable prediction exists.
    """
    e = F.col("_e")
    ready, answered = F.coalesce(e["reason"] == "READY", F.lit(False)), e["problem"].isNull()
    names = F.array(*[F.lit(c) for c in model.classes])
    on, off = OUTPUT_STATES[mode], OUTPUT_STATES["UNAVAILABLE"]

    def state(field):
        return F.when(ready, F.lit(on[field])).when(answered, F.lit(off[field])).alias(field)

    return requests.withColumn("_e", once(evaluation(model, spec))).select(
        *[c for c in requests.columns if c not in ("baseline_samples", "window_samples",
                                                   "source_window_end_ms")],
        F.col("source_window_end_ms").alias("requested_end_ms"),
        e["problem"].alias("problem"), e["reason"].alias("availability_reason"),
        e["quality"].alias("quality_verification"), e["baseline"].alias("baseline_value"),
        *[e[name].alias(name) for name in contract.FEATURE_COLUMNS],
        state("mode"), state("data_source"), state("model_status"),
        F.when(answered, ready).alias("prediction_available"),
        F.get(names, e["class_index"]).alias("risk_class"),
        e["class_index"].alias("risk_class_index"),
        F.when(ready, F.col("source_window_end_ms")).alias("source_window_end_ms"),
        state("model_input_channel"), state("model_artifact_version"),
        F.when(ready, F.lit(model_sha256)).alias("model_artifact_sha256"),
        state("evidence_scope"))


def feature_documents(responses: DataFrame, basis: str = "RAW_MINUS_SESSION_BASELINE",
                      version: str = "0.1.0") -> DataFrame:
    """The feature document of every usable response, as `feature_vector_rules` judges it."""
    names = contract.FEATURE_COLUMNS
    return responses.filter(F.col("prediction_available")).select(
        "session_id", F.lit(version).alias("feature_input_version"), "data_source",
        "model_input_channel", "source_window_end_ms", F.lit(basis).alias("feature_basis"),
        F.array(*[F.lit(name) for name in names]).alias("feature_order"),
        F.array(*names).alias("features"))
