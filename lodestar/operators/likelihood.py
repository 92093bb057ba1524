"""Maximum likelihood of independent factors from what was observed of their conjunctions and disjunctions.

Rows are compressed to distinct three-valued patterns with counts in Spark; a group's patterns, 3^signals at most, are
then fitted in one task. Likelihood and gradient are sums over patterns and states; the fit is a bounded
quasi-Newton search from several starts, and says how it ended: whether the projected gradient vanished, whether the
starts agree, whether a factor stands at its bound.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_FACTORS, MOST_SIGNALS = 12, 12
EPSILON, STEPS, TOLERANCE = 1e-6, 500, 1e-7


@dataclass(frozen=True)
class FactorModel:
    """``signals`` gives each signal its clauses: it is true if all factors of one of its clauses are.

    ``retention`` is for traces that are lost more often when a factor is down: (factor, signals, kept when up, kept
    when down). A row that has any of the signals was kept, one without them was lost, and both count.
    """

    signals: dict[str, tuple[tuple[str, ...], ...]]
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    retention: tuple[str, tuple[str, ...], float, float] | None = None

    def __post_init__(self):
        if not 1 <= len(self.factors()) <= MOST_FACTORS or not 1 <= len(self.signals) <= MOST_SIGNALS:
            raise ValueError(f"1 to {MOST_FACTORS} factors and 1 to {MOST_SIGNALS} signals")
        if any(not 0 < low < high < 1 for low, high in self.bounds.values()):
            raise ValueError("bounds within 0 and 1, the lower one first")
        if self.retention and not (self.retention[0] in self.factors() and set(self.retention[1]) <= set(self.signals) and all(0 < r < 1 for r in self.retention[2:])):
            raise ValueError("retention names a factor and signals of the model, with rates within 0 and 1")

    def factors(self) -> list[str]:
        return sorted({f for clauses in self.signals.values() for clause in clauses for f in clause})


class Likelihood:
    """Negative log-likelihood of patterns and its gradient by the factors' logits."""

    def __init__(self, model: FactorModel, patterns: list[tuple], counts: np.ndarray):
        names, signals = model.factors(), list(model.signals)
        self.states = (np.arange(1 << len(names))[:, None] >> np.arange(len(names)) & 1).astype(float)
        holds = {s: np.any([self.states[:, [names.index(f) for f in clause]].all(axis=1) for clause in model.signals[s]], axis=0) for s in signals}
        self.weight = np.array([np.all([np.ones(len(self.states), bool) if v is None else holds[s] == v for s, v in zip(signals, p)], axis=0) for p in patterns], float).reshape(len(patterns), len(self.states))
        if model.retention:
            factor, traced, up, down = model.retention
            kept = np.array([any(v is not None for s, v in zip(signals, p) if s in traced) for p in patterns])
            rate = np.where(self.states[:, names.index(factor)] == 1, up, down)
            self.weight *= np.where(kept[:, None], rate, 1 - rate)
        self.counts = np.asarray(counts, float)

    def possible(self) -> bool:
        return bool(self.weight.any(axis=1).all())

    def __call__(self, logits: np.ndarray) -> tuple[float, np.ndarray]:
        p = 1 / (1 + np.exp(-logits))
        state = np.exp(self.states @ np.log(p) + (1 - self.states) @ np.log1p(-p))
        joint = self.weight * state
        total = joint.sum(axis=1)
        share = self.counts / total
        return -float(self.counts @ np.log(total)), -(share @ (joint @ (self.states - p)))


def minimised(objective: Likelihood, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, float, float, int]:
    """(place, value, projected gradient, steps) of a bounded BFGS search with backtracking."""
    x = np.clip(start, low, high)
    value, g = objective(x)
    inverse, scale = np.eye(len(x)), max(1.0, float(objective.counts.sum()))
    for step in range(STEPS):
        pushed = (x <= low) & (g > 0) | (x >= high) & (g < 0)
        free = ~pushed
        if not free.any() or np.abs(g[free]).max() <= TOLERANCE * scale:
            break
        h = inverse[np.ix_(free, free)]
        move = np.zeros(len(x))
        move[free] = -h @ g[free]
        if move @ g >= 0:
            inverse, move = np.eye(len(x)), np.where(free, -g, 0.0)
        move *= min(1.0, 4.0 / max(np.abs(move).max(), 1e-300))
        t = 1.0
        while True:
            there = np.clip(x + t * move, low, high)
            new, gradient = objective(there)
            if np.isfinite(new) and new <= value + 1e-4 * (g @ (there - x)) or t < 1e-12:
                break
            t /= 2
        s, y = there - x, gradient - g
        if not s.any() or t < 1e-12:
            break
        if s @ y > 1e-12:
            r = 1 / (s @ y)
            left = np.eye(len(x)) - r * np.outer(s, y)
            inverse = left @ inverse @ left.T + r * np.outer(s, s)
        x, value, g = there, new, gradient
    pushed = (x <= low) & (g > 0) | (x >= high) & (g < 0)
    return x, value, float(np.abs(np.where(pushed, 0.0, g)).max()), step + 1


def _logit(p):
    return np.log(p / (1 - p))


def fitted(model: FactorModel, patterns: list[tuple], counts: np.ndarray) -> dict:
    """Probabilities, value, status and how the starts ended."""
    names = model.factors()
    blank = dict(probabilities=[None] * len(names), value=None, gradient=None, steps=0, spread=None, boundary=0)
    if not any(v is not None for p in patterns for v in p):
        return blank | dict(status="no_observations")
    objective = Likelihood(model, patterns, counts)
    if not objective.possible():
        return blank | dict(status="impossible_pattern")
    low, high = (_logit(np.array([model.bounds.get(n, (EPSILON, 1 - EPSILON))[k] for n in names])) for k in (0, 1))
    spread_starts = [np.full(len(names), s) for s in (0.5, 0.8, 0.95)] + [0.35 + 0.5 * np.random.default_rng(k).random(len(names)) for k in (1, 2)]
    ends = [minimised(objective, _logit(s), low, high) for s in spread_starts]
    best = min(ends, key=lambda e: e[1])
    near = [1 / (1 + np.exp(-e[0])) for e in ends if e[1] - best[1] <= 1e-7 * max(1.0, abs(best[1]))]
    p, spread = 1 / (1 + np.exp(-best[0])), float(np.ptp(np.stack(near), axis=0).max())
    boundary = int((np.isclose(best[0], low) | np.isclose(best[0], high)).sum())
    settled = best[2] <= 1e-5 * max(1.0, float(np.sum(counts)))
    status = "not_converged" if not settled else "converged_nonunique" if spread > 1e-3 else "converged_boundary" if boundary else "converged"
    return dict(probabilities=p.tolist(), value=best[1], gradient=best[2], steps=best[3], spread=spread, boundary=boundary, status=status)


def patterns_of(rows: DataFrame, keys: list[str], model: FactorModel) -> DataFrame:
    """(keys, signals, n): distinct three-valued vectors and how often they occur."""
    return rows.groupBy(*keys, *model.signals).agg(F.count("*").alias("n"))


def fit_factors(rows: DataFrame, key: str, model: FactorModel) -> DataFrame:
    """(key, factor, probability, status, value, gradient, steps, spread, boundary) of every group of rows."""
    kind, names, signals = dict(rows.dtypes)[key], model.factors(), list(model.signals)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        patterns = [tuple(None if pd.isna(v) else bool(v) for v in r) for r in pdf[signals].astype(object).itertuples(index=False)]
        order = sorted(range(len(patterns)), key=lambda i: str(patterns[i]))
        f = fitted(model, [patterns[i] for i in order], pdf["n"].to_numpy()[order])
        n = len(names)
        return pd.DataFrame({key: [pdf[key].iloc[0]] * n, "factor": names, "probability": f["probabilities"], "status": [f["status"]] * n, "value": [f["value"]] * n, "gradient": [f["gradient"]] * n, "steps": [f["steps"]] * n, "spread": [f["spread"]] * n, "boundary": [f["boundary"]] * n})

    return patterns_of(rows, [key], model).groupBy(key).applyInPandas(fit, f"`{key}` {kind}, factor string, probability double, status string, value double, gradient double, steps long, spread double, boundary long")
