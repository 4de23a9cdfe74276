"""Monotone calibration: quality that never rises with an error, fitted on scores or on pairs.

Trained on the driver, on a row for each rated clip; predictions are an expression for Spark."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
from pyspark.sql import Column, functions as F


class MonotonicCalibrator:
    """A linear model of named errors with weights of one sign, by projected gradient steps.

    ``fit`` regresses ratings of 0 to 100; ``fit_pairwise`` takes the errors of winners and losers and fits the logistic loss of
    their difference, for which an intercept says nothing. Missing features count as 0."""

    def __init__(self, features: list[str]):
        self.features, self.kind = list(features), "rating"
        self.weights, self.bias = np.zeros(len(features)), 0.0

    def fit(self, errors: np.ndarray, ratings: np.ndarray, steps: int = 4000) -> MonotonicCalibrator:
        x, y = np.nan_to_num(np.asarray(errors, float)), np.asarray(ratings, float)
        w, b = np.zeros(x.shape[1]), float(y.mean())
        rate = 1.0 / (np.linalg.norm(np.column_stack((x, np.ones(len(x)))), 2) ** 2 / len(x))
        for _ in range(steps):
            miss = x @ w + b - y
            w = np.minimum(0, w - rate * (x.T @ miss) / len(x))
            b -= rate * miss.mean()
        self.weights, self.bias, self.kind = w, b, "rating"
        return self

    def fit_pairwise(self, winners: np.ndarray, losers: np.ndarray, steps: int = 2000, decay: float = 1e-3) -> MonotonicCalibrator:
        d = np.nan_to_num(np.asarray(winners, float)) - np.nan_to_num(np.asarray(losers, float))
        w = np.zeros(d.shape[1])
        rate = 1.0 / (0.25 * np.linalg.norm(d, 2) ** 2 / len(d) + decay)
        for _ in range(steps):
            p = 1 / (1 + np.exp(d @ w))  # the chance given to the wrong order
            w = np.minimum(0, w + rate * ((d.T @ p) / len(d) - decay * w))
        self.weights, self.bias, self.kind = w, 0.0, "pairwise"
        return self

    def predict(self, errors: dict[str, float]) -> float:
        raw = self.bias + sum(w * (errors.get(f) or 0.0) for f, w in zip(self.features, self.weights, strict=True))
        return float(np.clip(raw, 0, 100)) if self.kind == "rating" else float(100 / (1 + np.exp(-raw)))

    def column(self, errors: dict[str, Column]) -> Column:
        raw = sum((F.coalesce(errors[f], F.lit(0.0)) * float(w) for f, w in zip(self.features, self.weights, strict=True) if f in errors), F.lit(float(self.bias)))
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)) if self.kind == "rating" else 100.0 / (1.0 + F.exp(-raw))

    def save(self, path: str, meta: dict | None = None) -> None:
        Path(path).write_text(json.dumps({"features": self.features, "weights": self.weights.tolist(), "bias": self.bias, "kind": self.kind, "meta": meta or {}}))

    @classmethod
    def load(cls, path: str) -> MonotonicCalibrator:
        d = json.loads(Path(path).read_text())
        out = cls(d["features"])
        out.weights, out.bias, out.kind = np.array(d["weights"]), d["bias"], d["kind"]
        return out
