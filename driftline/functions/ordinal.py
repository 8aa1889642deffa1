"""Ordinal logistic scoring as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

from driftline import contract


@dataclass(frozen=True)
class OrdinalModel:
    """Cumulative-logit model: ``P(Y <= k) = sigmoid(theta[k] - beta . z)``."""

    mean: tuple
    scale: tuple
    beta: tuple
    theta: tuple
    features: tuple = contract.FEATURE_COLUMNS
    classes: tuple = contract.CLASS_NAMES
    version: str = contract.MODEL_ARTIFACT_VERSION


# Fixed values of the published engineering model.
ENGINEERING_MODEL = OrdinalModel(
    mean=(0.597351868421, 1.302531486842, 0.010110144737, 0.389870868421, 1.385563223684),
    scale=(1.041783500279, 1.879158047154, 0.014454470595, 0.600133085923, 1.577929035407),
    beta=(1.547331972308, 2.090303059602, 1.071518138674, 0.73999520027, 1.585757435299),
    theta=(-2.728372339698, 5.386336066551, 13.459127058322),
)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def linear_predictor(model: OrdinalModel, c=F.col) -> Column:
    terms = [F.lit(b) * ((c(name) - F.lit(m)) / F.lit(s))
             for name, m, s, b in zip(model.features, model.mean, model.scale, model.beta)]
    return reduce(lambda a, b: a + b, terms)


def class_probabilities(eta: Column, theta) -> list[Column]:
    cumulative = [sigmoid(F.lit(t) - eta) for t in theta]
    middle = [high - low for low, high in zip(cumulative, cumulative[1:])]
    return [cumulative[0], *middle, F.lit(1.0) - cumulative[-1]]


def argmax_lowest(values: Column) -> Column:
    """Index of the largest element; ties keep the lowest index."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def _as_float(x: Column) -> Column:
    return x.cast("float")


def float_probabilities(model: OrdinalModel, c=F.col) -> list[Column]:
    """The same forward pass in single precision, rounded after every operation."""
    def f(value):
        return F.lit(float(value)).cast("float")

    one = f(1.0)
    eta = f(0.0)
    for name, m, s, b in zip(model.features, model.mean, model.scale, model.beta):
        centered = _as_float(_as_float(c(name)) - f(m))
        eta = _as_float(eta + _as_float(f(b) * _as_float(centered.cast("double") / f(s).cast("double"))))
    cumulative = []
    for t in model.theta:
        x = _as_float(f(t) - eta)
        e = _as_float(F.exp(-F.abs(x).cast("double")))
        p = _as_float(F.when(x >= 0, one.cast("double")).otherwise(e.cast("double"))
                      / _as_float(one + e).cast("double"))
        cumulative.append(p)
    middle = [_as_float(high - low) for low, high in zip(cumulative, cumulative[1:])]
    return [cumulative[0], *middle, _as_float(one - cumulative[-1])]
