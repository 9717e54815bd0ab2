"""Linear heads from weighted sums by fold: one pass over the rows serves all folds, penalties and mixes of row groups."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Branches of the sum of what tasks hand on.
BRANCHES = 16


@dataclass
class Sums:
    """Weighted sums over rows: X'WX, X'WY, X'W1, Y'W1, and the weights' own; sums of groups of rows add up and can be taken off."""

    xx: np.ndarray
    xy: np.ndarray
    x: np.ndarray
    y: np.ndarray
    weight: float

    def __add__(self, other: Sums) -> Sums:
        return Sums(*(getattr(self, k) + getattr(other, k) for k in self.__dataclass_fields__))

    def __sub__(self, other: Sums) -> Sums:
        return self + other * -1.0

    def __mul__(self, by: float) -> Sums:
        """The same rows, each weighing so many times as much."""
        return Sums(*(getattr(self, k) * by for k in self.__dataclass_fields__))

    def packed(self) -> np.ndarray:
        return np.concatenate([self.xx.ravel(), self.xy.ravel(), self.x, self.y, [self.weight]])

    @staticmethod
    def unpacked(v: np.ndarray, f: int, t: int) -> Sums:
        cuts = np.cumsum([f * f, f * t, f, t])
        xx, xy, x, y, w = np.split(np.asarray(v), cuts)
        return Sums(xx.reshape(f, f), xy.reshape(f, t), x, y, float(w[0]))

    @staticmethod
    def of(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Sums:
        wx = x * w[:, None]
        return Sums(wx.T @ x, wx.T @ y, wx.sum(axis=0), (y * w[:, None]).sum(axis=0), float(w.sum()))

    def ridge(self, alpha: float, intercept: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(coefficients by feature and target, intercepts) of weighted ridge regression; the intercept isn't penalised. Zeros where there is no weight."""
        if self.weight <= 0:
            return np.zeros_like(self.xy), np.zeros_like(self.y)
        mx, my = (self.x / self.weight, self.y / self.weight) if intercept else (0 * self.x, 0 * self.y)
        xx = self.xx - self.weight * np.outer(mx, mx)
        coefficients = np.linalg.solve(xx + alpha * np.eye(len(xx)), self.xy - self.weight * np.outer(mx, my))
        return coefficients, my - mx @ coefficients


def fold_sums(df: DataFrame, by: list[str], features: str, targets: str, n_features: int, n_targets: int, weight: str | None = None) -> dict[tuple, Sums]:
    """Sums of the rows of each group (fold, kind of row, ...) in one pass.

    A task adds up its own rows and hands on one row of numbers for each group; these are added in two
    steps. What comes to the driver is one such row a group, whose size the features alone decide; by is
    meant for columns of a few values. Rows with a null in features, targets, weight or an array of another length are left out.
    """
    n_by = len(by)
    rows = df.select(*by, F.col(features).cast("array<double>").alias("__x"), F.col(targets).cast("array<double>").alias("__y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("__w"))
    whole = (F.size("__x") == n_features) & (F.size("__y") == n_targets) & F.col("__w").isNotNull() & ~F.exists("__x", lambda v: v.isNull()) & ~F.exists("__y", lambda v: v.isNull())
    rows = rows.where(whole)

    def add(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(n_by)), strict=True)) if n_by else [()] * batch.num_rows
            place = {k: n for n, k in enumerate(dict.fromkeys(keys))}
            of = np.array([place[k] for k in keys])
            x, y = (np.asarray(batch.column(n_by + c).flatten()).reshape(batch.num_rows, n) for c, n in ((0, n_features), (1, n_targets)))
            w = np.asarray(batch.column(n_by + 2))
            for key, n in place.items():
                on = of == n
                held[key] = held.get(key, 0) + Sums.of(x[on], y[on], w[on]).packed()
        yield from _rows(held)

    def again(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *key, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[tuple(key)] = held.get(tuple(key), 0) + np.array(v)
        yield from _rows(held)

    def _rows(held):
        import pyarrow as pa

        if held:
            columns = [pa.array([k[c] for k in held], t) for c, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(held.values()), pa.list_(pa.float64()))], [*by, "sums"])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(df.schema[c].dataType) for c in by]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), "sums array<double>"])
    local = rows.mapInArrow(add, schema)
    some = local.repartition(BRANCHES).mapInArrow(again, schema)
    got = some.coalesce(1).mapInArrow(again, schema).collect()  # a row for each group
    return {tuple(r[c] for c in by): Sums.unpacked(np.array(r["sums"]), n_features, n_targets) for r in got}


def without_each(sums: dict, folds: list) -> dict:
    """For each fold the sums of all others: the total less its own. Keys of sums begin with the fold."""
    total = None
    for v in sums.values():
        total = v if total is None else total + v
    own = {f: [v for k, v in sums.items() if k[0] == f] for f in folds}
    out = {}
    for f in folds:
        rest = total
        for v in own[f]:
            rest = rest - v
        out[f] = rest
    return out


def mixed(sums: dict[tuple, Sums], weights: dict) -> dict[tuple, Sums]:
    """Sums by (fold, kind of row, ...) as sums by fold, the rows of each kind weighing as weights says (kinds that it lacks: nothing)."""
    out: dict[tuple, Sums] = {}
    for (fold, kind, *_), v in sums.items():
        part = v * float(weights.get(kind, 0.0))
        out[(fold,)] = out[(fold,)] + part if (fold,) in out else part
    return out


def scored(df: DataFrame, features: str, fold: str, heads: dict, name: str = "scores") -> DataFrame:
    """df with an array of scores, one for each target, of the head of the row's fold (a value of heads: coefficients and intercepts); null where there is none, or the features are null or of another number."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    out = StructType([*df.schema.fields, StructField(name, ArrayType(DoubleType()))])
    at, of = df.columns.index(features), df.columns.index(fold)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got: list = [None] * batch.num_rows
            folds, sizes = batch.column(of).to_pylist(), batch.column(at).value_lengths().to_pylist()
            for f in dict.fromkeys(folds):
                if f not in heads:
                    continue
                coefficients, intercepts = heads[f]
                on = [k for k, v in enumerate(folds) if v == f and sizes[k] == len(coefficients)]
                if on:
                    x = np.array(batch.column(at).take(pa.array(on)).to_pylist(), dtype=float)
                    for k, row in zip(on, x @ coefficients + intercepts, strict=True):
                        got[k] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.float64()))], out.names)

    return df.mapInArrow(run, out)
