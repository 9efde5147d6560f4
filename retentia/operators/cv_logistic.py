"""Logistic regression of all cross-validation folds by Newton steps in shared passes (M4, M7).

One aggregation an iteration adds up the gradient and Hessian of every fold's
model: partial sums as matrix products inside the tasks, one ``groupBy``
across them. The moments for each fold's scaling come from one pass as well, as total
minus fold. The design is scaled once, by all rows; a fold's own
scaling then only changes its penalty and the value of its missing inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_code

MAX_STEPS = 50
TOLERANCE = 1e-10


@dataclass
class FoldModel:
    """Coefficients on the common scale; ``centre`` and ``spread`` are the common scaling, ``fill`` the fold's means."""

    beta: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    fill: np.ndarray

    def probability(self, inputs: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(_design(inputs, self.centre, self.spread, self.fill) @ self.beta)))


def _design(inputs: np.ndarray, centre: np.ndarray, spread: np.ndarray, fill: np.ndarray) -> np.ndarray:
    x = (inputs - centre) / spread
    x = np.where(np.isnan(x), fill, x)
    return np.column_stack([x, np.ones(len(x))])


def _newton_cells(batches, width, k, weights, betas, centre, spread, fills):
    """Partial (cell, value): per fold the gradient, then the upper triangle of the Hessian."""
    p = width + 1
    upper = np.triu_indices(p)
    total = np.zeros((k, p + len(upper[0])))
    seen = False
    for b in batches:
        seen = True
        flat = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, width)
        y, fold = np.asarray(b.column(0), float), np.asarray(b.column(1))
        for f in range(k):
            rows = fold != f
            x = _design(flat[rows], centre, spread, fills[f])
            prob = 1.0 / (1.0 + np.exp(-(x @ betas[f])))
            w = np.where(y[rows] == 1, weights[f][1], weights[f][0])
            total[f, :p] += x.T @ (w * (prob - y[rows]))
            total[f, p:] += ((x * (w * prob * (1 - prob))[:, None]).T @ x)[upper]
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "value"])


def fit_folds(rows: DataFrame, label: str, fold: str, inputs: str, width: int, numeric: int, k: int,
              weights: dict[int, tuple[float, float]], scale: bool = True, l2: float = 1.0) -> list[FoldModel]:
    """The k models; model f is fitted on the rows whose fold is not f. The loss
    is the weighted log-loss plus l2 / 2 times the squared coefficients of the
    fold's own scaled inputs (the intercept is free); a NULL numeric input is the fold's mean."""
    ship_code(rows.sparkSession)
    x = [F.col(inputs)[i] for i in range(numeric)]
    means = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)]).first()
    centre, spread = np.zeros(width), np.ones(width)
    if scale:
        centre[:numeric] = [means[f"m{i}"] or 0.0 for i in range(numeric)]
        spread[:numeric] = [(means[f"s{i}"] or 0.0) or 1.0 for i in range(numeric)]
    # moments of the scaled inputs by fold: a training set is the total minus its fold
    own = spread.copy() if scale else np.ones(width)
    z = [(c - float(centre[i])) / float(own[i]) for i, c in enumerate(x)]
    moments = {r[fold]: r for r in rows.groupBy(fold).agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(z)], *[F.sum(c).alias(f"a{i}") for i, c in enumerate(z)],
        *[F.sum(c * c).alias(f"q{i}") for i, c in enumerate(z)]).collect()}

    def of(f: int, name: str) -> np.ndarray:
        whole = np.array([sum(float(r[f"{name}{i}"] or 0) for r in moments.values()) for i in range(numeric)])
        return whole - (np.array([float(moments[f][f"{name}{i}"] or 0) for i in range(numeric)]) if f in moments else 0.0)

    fills, penalties = [], []
    for f in range(k):
        n = np.maximum(of(f, "n"), 1)
        mean = of(f, "a") / n
        deviation = np.sqrt(np.maximum(of(f, "q") / n - mean**2, 0.0))
        fill, sd = np.zeros(width), np.ones(width)
        if scale:
            fill[:numeric] = mean
            sd[:numeric] = np.where(deviation > 0, deviation, 1.0)
        fills.append(fill)
        penalties.append(l2 * np.append(sd**2, 0.0))
    design = rows.select(F.col(label).cast("int").alias("label"), F.col(fold).alias("fold"), F.col(inputs).alias("inputs"))
    p = width + 1
    upper = np.triu_indices(p)
    betas, open_folds = [np.zeros(p) for _ in range(k)], set(range(k))
    for _ in range(MAX_STEPS):
        parts = design.mapInArrow(lambda b, now=[x.copy() for x in betas]: _newton_cells(b, width, k, weights, now, centre, spread, fills), "cell long, value double")
        got = parts.groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
        flat = np.zeros(k * (p + len(upper[0])))
        flat[got["cell"].to_numpy(np.int64)] = got["value"].to_numpy()
        for f, sums in enumerate(flat.reshape(k, -1)):
            if f not in open_folds:
                continue
            hessian = np.zeros((p, p))
            hessian[upper] = sums[p:]
            hessian = hessian + np.triu(hessian, 1).T + np.diag(penalties[f])
            gradient = sums[:p] + penalties[f] * betas[f]
            step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            betas[f] = betas[f] - step
            if float(gradient @ step) < TOLERANCE:
                open_folds.discard(f)
        if not open_folds:
            break
    else:
        raise RuntimeError(f"logistic regression did not converge in {MAX_STEPS} steps")
    return [FoldModel(b, centre, spread, fills[f]) for f, b in enumerate(betas)]
