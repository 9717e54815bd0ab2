"""Support vector regression (nu form, RBF kernel) on a bounded sample, and scores of any number of rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Svr:
    mean: np.ndarray
    scale: np.ndarray
    vectors: np.ndarray
    weights: np.ndarray
    bias: float
    gamma: float
    #: Half the width of the tube that nu settled on.
    epsilon: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = (np.asarray(x, float) - self.mean) / self.scale
        return rbf(z, self.vectors, self.gamma) @ self.weights + self.bias if len(self.vectors) else np.full(len(z), self.bias)


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    gap = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(gap, 0))


def solve(kernel: np.ndarray, y: np.ndarray, nu: float, c: float, tolerance: float = 1e-3, rounds: int = 1_000_000) -> tuple[np.ndarray, float, float]:
    """(weights, bias, epsilon) of the dual: pushes up and pushes down, each between 0 and c and each summing to c * nu * n / 2.

    Each step moves weight between two pushes of one side, the pair that gains most: the one that wants
    up most, and of those that may give the one of the largest second-order gain. Done when no pair
    is out of order by more than the tolerance.
    """
    n = len(y)
    part = c * nu * n / 2
    start = np.minimum(c, np.maximum(0, part - c * np.arange(n)))
    push = np.stack([start, start])  # up, down
    pull = np.stack([-y, y]).astype(float)  # gradients; weights start at 0
    diagonal = np.diag(kernel)
    for _ in range(rounds):
        best = None
        for side in (0, 1):
            up, down = push[side] < c - 1e-12, push[side] > 1e-12
            if not up.any() or not down.any():
                continue
            i = int(np.where(up, pull[side], np.inf).argmin())
            gap = np.where(down, pull[side] - pull[side, i], -np.inf)
            if gap.max() <= tolerance:
                continue
            bend = np.maximum(diagonal[i] + diagonal - 2 * kernel[i], 1e-12)
            gain = np.where(gap > 0, gap**2 / bend, -np.inf)
            j = int(gain.argmax())
            if best is None or gain[j] > best[0]:
                best = (gain[j], side, i, j, gap[j] / bend[j])
        if best is None:
            break
        _, side, i, j, move = best
        move = min(move, c - push[side, i], push[side, j])
        push[side, i] += move
        push[side, j] -= move
        shift = move * (kernel[i] - kernel[j]) * (1 if side == 0 else -1)
        pull[0] += shift
        pull[1] -= shift
    level = []
    for side in (0, 1):
        free = (push[side] > 1e-9) & (push[side] < c - 1e-9)
        if free.any():
            level.append(float(pull[side][free].mean()))
        else:
            at_top, at_floor = pull[side][push[side] >= c - 1e-9], pull[side][push[side] <= 1e-9]
            level.append(float((at_top.max() + at_floor.min()) / 2) if len(at_top) and len(at_floor) else float(at_top.max() if len(at_top) else at_floor.min()))
    return push[0] - push[1], (level[1] - level[0]) / 2, -(level[0] + level[1]) / 2


def fit(df: DataFrame, key: str, features: str, target: str, most: int = 8000, nu: float = 0.7, c: float = 1.0, gamma: float | None = None) -> Svr:
    """A model of at most `most` rows, those with the smallest hash of their key (the kernel holds most * most numbers, on the driver).

    Features are standardised; gamma is 1 / (their number times their variance) unless given. Rows with a null are left out; without rows the model says 0.
    """
    whole = df.where(F.col(key).isNotNull() & F.col(target).isNotNull() & F.col(features).isNotNull() & ~F.exists(features, lambda v: v.isNull() | F.isnan(v.cast("double"))))
    rows = whole.select(F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"), F.md5(F.col(key).cast("string")).alias("h")).orderBy("h").limit(most).collect()  # bounded
    if not rows:
        return Svr(np.zeros(1), np.ones(1), np.zeros((0, 1)), np.zeros(0), 0.0, 1.0)
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-12] = 1.0
    z = (x - mean) / scale
    gamma = gamma or 1 / (z.shape[1] * max(z.var(), 1e-12))
    weights, bias, epsilon = solve(rbf(z, z, gamma), y, nu, c)
    used = np.abs(weights) > 1e-12
    return Svr(mean, scale, z[used], weights[used], bias, gamma, epsilon)


def predicted(df: DataFrame, features: str, model: Svr, name: str = "guess") -> DataFrame:
    """df with the model's guess, null where features are; tasks score their rows in batches."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    out, at = StructType([*df.schema.fields, StructField(name, DoubleType())]), df.columns.index(features)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(at)
            on = np.flatnonzero(np.asarray(column.is_valid()))
            got: list = [None] * batch.num_rows
            if len(on):
                x = np.array(column.take(pa.array(on)).to_pylist(), dtype=float)
                for k, v in zip(on.tolist(), model.predict(x).tolist(), strict=True):
                    got[k] = v
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], out.names)

    return df.mapInArrow(run, out)
