"""Whole pipelines as single plans; small per-session tables are checkpointed once.

A stage is checkpointed where several later stages read it and it is much
smaller than its input: session facts, issue rows, one-second bins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from driftline.operators import (
    labels as lab, matrix as mx, metrics, model, qc, resample, stats, windows as w)
from driftline.session import materialise


@dataclass(frozen=True)
class QualityGate:
    facts: DataFrame
    issues: DataFrame
    status: DataFrame
    report: DataFrame
    rejects: DataFrame


def quality_gate(sessions: DataFrame, samples: DataFrame, events: DataFrame,
                 config: qc.QcConfig, plan: DataFrame | None = None) -> QualityGate:
    """Facts, issue rows, status and report of every session.

    ``sessions`` carries ``session_order``; ``plan`` is optional and decides
    whether protocol status can be PASS.  Rows of unknown sessions and repeated sessions are
    ``rejects``: they are contract errors in ``issues``, a repeated session fails, and the
    rest of the gate judges the rows that belong to a session.
    """
    sessions = materialise(sessions)
    plan = materialise(plan) if plan is not None else None
    events = materialise(events.select(*qc.HAPPENED))
    rejects = materialise(qc.intake_rejects(sessions, samples, events, plan))
    touched = {row.source for row in rejects.select("source").distinct().collect()}
    if "sessions" in touched:
        sessions = sessions.dropDuplicates(["session_id"])
    known = sessions.select("session_id")
    if "samples" in touched:
        samples = samples.join(known, "session_id", "left_semi")
    if "events" in touched:
        events = events.join(known, "session_id", "left_semi")
    if "plan" in touched:
        plan = plan.join(known, "session_id", "left_semi").dropDuplicates(["session_id"])
    intervals = qc.gate_intervals(samples, config)
    facts = materialise(qc.qc_facts(sessions, samples, events, config, plan, intervals))
    issues = qc.qc_issues(facts, samples, events, sessions, config, plan is not None,
                          intervals).unionByName(qc.reject_issues(rejects))
    status = qc.session_status(facts, issues, plan is not None)
    return QualityGate(facts, issues, status, qc.qc_session_report(facts, status), rejects)


@dataclass(frozen=True)
class Pilot:
    cadence: DataFrame
    one_hz: DataFrame
    baseline: DataFrame
    normalised: DataFrame
    windows: DataFrame
    report: DataFrame


def pilot(rows: DataFrame, channels: dict[str, str], model_channels: list[str], rate: int,
          baseline_s: int, spec: w.WindowSpec, arrival: str = "sample_no") -> Pilot:
    """High-rate logger rows to bins, baselines, normalised bins, grid windows and report.

    ``cadence`` lists the rows that break the logger's fixed cadence, in the order of ``arrival``;
    their bins are not what the sample numbers say, so callers refuse such sessions.
    """
    names = list(channels)
    cadence = resample.cadence_check(rows, 1000 // rate, arrival)
    one_hz = materialise(resample.count_bins_median(rows, channels, rate))
    baseline = resample.robust_baseline(one_hz, names, baseline_s)
    normalised = resample.normalised_delta(one_hz, baseline, names)
    windows = w.multichannel_windows(
        normalised, {c: f"{c}_delta_norm" for c in model_channels}, spec)
    report = resample.pilot_session_qc(
        rows, channels, baseline, rate, spec.window // 1000, spec.stride // 1000)
    return Pilot(cadence, one_hz, baseline, normalised, windows, report)


def pilot_correlations(one_hz: DataFrame, channels: list[str]) -> DataFrame:
    """Median and IQR over sessions of the within-session rank correlations."""
    by_session = stats.spearman_by_session(one_hz, ["session_id", "second_index"], channels)
    return stats.correlation_summary(by_session, channels)


@dataclass(frozen=True)
class Experiment:
    features: DataFrame
    malformed: DataFrame
    labels: DataFrame
    matrix: DataFrame


def experiment(samples: DataFrame, sessions: DataFrame, outcomes: DataFrame,
               spec: w.WindowSpec, boundary: lab.Boundary) -> Experiment:
    """Samples to features, labels and the leakage-safe matrix.

    ``outcomes``: one row per session with event summary, ``planned_horizon_s``,
    ``safe_anchor`` and ``dataset_partition``.  Sessions with malformed events
    are quarantined, not labelled.
    """
    judged = lab.protocol_deviation(lab.horizon_completion(outcomes))
    malformed = lab.malformed_events(judged)
    usable = judged.join(malformed.select("session_id").distinct(), "session_id", "left_anti")
    features = w.feature_table(samples, sessions, spec)
    labelled = lab.label_windows(features, usable, boundary)
    return Experiment(features, malformed, labelled, mx.model_matrix(features, labelled))


@dataclass(frozen=True)
class Trained:
    fit: model.OrdinalFit
    predictions: DataFrame
    metrics: DataFrame


def train(run: Experiment) -> Trained:
    """Guarded fit on the experiment's fit partition, scores of the matrix and metrics."""
    matrix = materialise(run.matrix)
    fit = model.guarded_fit(matrix, run.labels)
    scored = materialise(model.ordinal_score(matrix, fit.model))
    pairs = scored.select("dataset_partition", F.col("risk_label_index").cast("int").alias("truth"),
                          F.col("predicted_index").alias("predicted"))
    table = metrics.metric_table(pairs, ["dataset_partition"], len(fit.model.classes))
    return Trained(fit, scored, table)
