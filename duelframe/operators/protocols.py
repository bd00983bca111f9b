"""The three extension points: rating hooks, models and metric columns."""

from dataclasses import dataclass
from typing import Callable, Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.odds import expit


def expit_of(x):
    """The logistic function of a Column or of an array."""
    return expit(x) if isinstance(x, Column) else 1 / (1 + np.exp(-x))


@dataclass(frozen=True)
class RatingHook:
    """`predict(side, opp, offset)` and `delta(y, y_hat, alpha)`, both on Columns and, in tasks, on arrays (rows by cells).

    Arithmetic serves both; `expit_of` does, too. A missing target is null in a Column and NaN in an array."""
    predict: Callable
    delta: Callable


def rating_hook(predict, delta=None) -> RatingHook:
    return RatingHook(predict, delta or quarter_step)


def _step(share, y, y_hat, alpha):
    if isinstance(y_hat, Column):
        return F.coalesce(F.lit(share) * alpha * (y - y_hat), F.lit(0.0))
    return np.nan_to_num(share * alpha * (y - y_hat), nan=0.0)


def quarter_step(y, y_hat, alpha):
    """Each of the two rows of a contest moves both ratings by a quarter of the error; no target, no move."""
    return _step(0.25, y, y_hat, alpha)


def half_step(y, y_hat, alpha):
    return _step(0.5, y, y_hat, alpha)


REAL = rating_hook(lambda side, opp, offset: side - opp)
BINARY = rating_hook(lambda side, opp, offset: expit_of(side - opp))
BINARY_OFFSET = rating_hook(lambda side, opp, offset: expit_of(offset + side - opp))


class Model(Protocol):
    def fit_predict(self, train: DataFrame, test: DataFrame) -> DataFrame:
        """Rows of `test` with a `y_pred` column."""


class FunctionModel:
    """Wraps a function (train, test) -> predictions as a model."""

    def __init__(self, fn):
        self._fn = fn

    def fit_predict(self, train, test):
        return self._fn(train, test)


def model_protocol(model) -> Model:
    if hasattr(model, "fit_predict"):
        return model
    if callable(model):
        return FunctionModel(model)
    raise TypeError("a model needs fit_predict(train, test)")


def metric_columns(metrics: dict) -> list:
    """{name: aggregate Column} -> aliased aggregates."""
    return [column.alias(name) for name, column in metrics.items()]
