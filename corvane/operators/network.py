"""A network of dense layers that guesses bits, trained on all rows by shared steps, with a loss that ranks candidates.

A step reads one batch (a part of a stored table), each task adds up its rows' gradients, and what comes
to the driver are sums whose size the layers alone decide. Weights and the optimiser's state are
kept at the end of every so many steps, so that a run that was stopped goes on to the same weights.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.sinks import exists, settings_key
from .topk import shuffled

#: Rows of sums that the driver adds up after the tasks of a step have been added by branch.
BRANCHES = 16
VERSION = 1


@dataclass(frozen=True)
class Settings:
    hidden: tuple[int, ...] = (64,)
    epochs: int = 6
    #: Steps of an epoch: the table is dealt into as many batches.
    batches: int = 8
    rate: float = 1e-3
    decay: float = 1e-2
    #: Weight of the ranking loss beside the bits' cross entropy, and its temperature.
    rank: float = 1.0
    tau: float = 0.05
    #: The rate falls along half a cosine.
    cosine: bool = True
    #: Steps between two kept states (None: an epoch).
    keep_every: int | None = None
    seed: int = 0

    @property
    def steps(self) -> int:
        return self.epochs * self.batches


@dataclass
class Network:
    """Layers as (weights, biases), ReLU between them and a logistic function at the end."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    losses: list[float] = field(default_factory=list)

    @classmethod
    def fresh(cls, sizes: list[int], seed: int = 0) -> Network:
        draw = np.random.default_rng(seed)
        return cls([(draw.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)])

    def flat(self) -> np.ndarray:
        return np.concatenate([part.ravel() for layer in self.layers for part in layer])

    def filled(self, values: np.ndarray) -> Network:
        """The same layers with other numbers."""
        out, at = [], 0
        for layer in self.layers:
            parts = []
            for part in layer:
                parts.append(values[at : at + part.size].reshape(part.shape))
                at += part.size
            out.append(tuple(parts))
        return Network(out)

    def inner(self, x: np.ndarray) -> list[np.ndarray]:
        """The input of each layer, and the logits."""
        values = [x]
        for n, (w, b) in enumerate(self.layers):
            z = values[-1] @ w + b
            values.append(z if n + 1 == len(self.layers) else np.maximum(z, 0))
        return values

    def predict(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.inner(x)[-1])


def logistic(z: np.ndarray) -> np.ndarray:
    return np.where(z >= 0, 1, np.exp(-np.abs(z))) / (1 + np.exp(-np.abs(z)))


def ranking(p: np.ndarray, own: np.ndarray, others: np.ndarray, tau: float) -> tuple[float, np.ndarray]:
    """Loss and gradient by p of one row: cross entropy of its own bits among the candidates, by soft Tanimoto over tau."""
    c = np.vstack([own[None, :], others])
    met = c @ p
    whole = np.maximum(c.sum(axis=1) + p.sum() - met, 1e-9)
    s = met / whole / tau
    s = s - s.max()
    share = np.exp(s) / np.exp(s).sum()
    pull = share.copy()
    pull[0] -= 1
    slope = c / whole[:, None] - (met / whole**2)[:, None] * (1 - c)
    return float(-np.log(max(share[0], 1e-300))), pull / tau @ slope


def gradients(net: Network, x: np.ndarray, y: np.ndarray, pools: list[np.ndarray], rank: float, tau: float) -> tuple[float, np.ndarray]:
    """Summed loss and gradient (as Network.flat) of rows; pools: each row's other candidates, as rows of bits."""
    values = net.inner(x)
    z, p = values[-1], logistic(values[-1])
    loss = float((np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))).mean(axis=1).sum())
    back = (p - y) / y.shape[1]
    if rank:
        for n, others in enumerate(pools):
            if len(others):
                own, slope = ranking(p[n], y[n], others, tau)
                loss += rank * own
                back[n] += rank * slope * p[n] * (1 - p[n])
    parts = []
    for n in range(len(net.layers) - 1, -1, -1):
        parts += [back.sum(axis=0), (values[n].T @ back).ravel()]
        if n:
            back = back @ net.layers[n][0].T * (values[n] > 0)
    return loss, np.concatenate(parts[::-1])


def with_pools(rows: DataFrame, key: str, group: str, bits: str, most: int = 15, seed: str = "pool", name: str = "pool") -> DataFrame:
    """rows with an array of at most `most` other rows' bits of the same group: negatives to rank against, drawn anew for each row.

    Rows of a group are dealt into rings of most + 1 in an order that the seed and the keys decide; a row's negatives
    are the others of its ring. Negatives are a sample by purpose; each row is trained on, and no group meets itself in pairs.
    Keys are meant to be unique: rows of one key share a ring. Rows of a null group have an empty array.
    """
    alone = rows.where(F.col(group).isNull()).withColumn(name, F.array().cast(rows.select(F.array(bits)).schema[0].dataType))
    ring = Window.partitionBy(group, "__ring")
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / (most + 1)).alias("__rings"))
    dealt = rows.join(sizes, group).withColumn("__ring", F.pmod(F.xxhash64(F.lit(seed), key), "__rings"))
    # Hashing gives rings of about most + 1 rows; longer ones keep the first in the order.
    dealt = dealt.withColumn("__place", F.row_number().over(ring.orderBy(shuffled(seed, F.col(key)), key)))
    met = F.collect_list(F.when(F.col("__place") <= most + 1, F.struct(F.col(key).alias("k"), F.col(bits).alias("b")))).over(ring)
    others = F.slice(F.transform(F.filter(met, lambda o: o["k"] != F.col(key)), lambda o: o["b"]), 1, most)
    return dealt.withColumn(name, others).drop("__rings", "__ring", "__place").select(*rows.columns, name).unionByName(alone)


def _matrix(column, n: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, n)


def _summed(batch: DataFrame, net: Network, s: Settings) -> np.ndarray:
    """(loss, rows, gradient) over a batch as one array, added in one order whenever the same files are read."""
    n_in, n_out = net.layers[0][0].shape[0], net.layers[-1][0].shape[1]
    spread = batch.sparkSession.sparkContext.broadcast(net.layers)  # sizes depend on the layers alone

    def add(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        own, total = Network(spread.value), None
        for b in batches:
            if not b.num_rows:
                continue
            pools = [np.array(p or [], dtype=float).reshape(-1, n_out) for p in b.column(2).to_pylist()]
            loss, grad = gradients(own, _matrix(b.column(0), n_in), _matrix(b.column(1), n_out), pools, s.rank, s.tau)
            part = np.concatenate([[loss, b.num_rows], grad])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total], pa.list_(pa.float64()))], ["task", "sums"])

    def again(frame):
        import pandas as pd

        frame = frame.sort_values("task")
        return pd.DataFrame({"task": [int(frame["task"].iloc[0])], "sums": [np.sum(np.stack(frame["sums"].tolist()), axis=0)]})

    tasks = batch.mapInArrow(add, "task long, sums array<double>")
    branches = tasks.groupBy(F.col("task") % BRANCHES).applyInPandas(again, "task long, sums array<double>")
    got = sorted(branches.collect(), key=lambda r: r["task"])  # BRANCHES rows at most
    spread.destroy()
    return np.sum([np.array(r["sums"]) for r in got], axis=0) if got else np.zeros(0)


def _order(s: Settings, epoch: int) -> list[int]:
    return sorted(range(s.batches), key=lambda b: hashlib.md5(f"{s.seed}:{epoch}:{b}".encode()).hexdigest())


def fit(rows: DataFrame, key: str, x: str, y: str, folder: str, pool: str | None = None, settings: Settings | None = None, run: str = "run", watch: Callable[[int, float], None] | None = None) -> Network:
    """A network from x (array of numbers) to y (array of 0 and 1), trained with AdamW.

    Rows with a null array, a null inside one or an array of another length than most of the first row's are left out; a
    null or empty pool adds no ranking loss. folder is one that all executors share: the dealt rows and the
    states lie under run and the settings there, so a run with the same name and settings goes on from the last
    state that was written to its end, and a finished one is only read. watch(step, mean loss) is called after each
    step. Without usable rows it raises a ValueError.
    """
    s = settings or Settings()
    spark = rows.sparkSession
    root = f"{folder.rstrip('/')}/{run}-{settings_key(VERSION, **asdict(s))}"
    if not exists(spark, f"{root}/rows"):
        bits = F.col(pool).cast("array<array<double>>") if pool else F.array().cast("array<array<double>>")
        flat = rows.select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y"), bits.alias("pool"), F.pmod(F.xxhash64(F.col(key)), F.lit(s.batches)).cast("int").alias("batch"))
        full = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda v: v.isNull())
        flat.where(full("x") & full("y")).repartition("batch", F.rand(s.seed)).write.mode("overwrite").partitionBy("batch").parquet(f"{root}/rows")
    stored = spark.read.schema("x array<double>, y array<double>, pool array<array<double>>, batch int").parquet(f"{root}/rows")
    widths = stored.groupBy(F.size("x").alias("x"), F.size("y").alias("y")).count().orderBy(F.desc("count"), "x", "y").first()
    if widths is None:
        raise ValueError("no rows to train on")
    n_in, n_out = widths["x"], widths["y"]
    stored = stored.where((F.size("x") == n_in) & (F.size("y") == n_out))
    net = Network.fresh([n_in, *s.hidden, n_out], s.seed)
    step, weights, first, second, losses = _resumed(spark, root, s, net)
    every = s.keep_every or s.batches
    while step < s.steps:
        epoch, at = divmod(step, s.batches)
        sums = _summed(stored.where(F.col("batch") == _order(s, epoch)[at]).select("x", "y", "pool"), net.filled(weights), s)
        step += 1
        if len(sums):
            grad = sums[2:] / sums[1]
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
            rate = s.rate * (0.5 * (1 + np.cos(np.pi * (step - 1) / s.steps)) if s.cosine else 1)
            move = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            weights = weights * (1 - rate * s.decay) - rate * move
            losses.append(float(sums[0] / sums[1]))
        if step % every == 0 or step == s.steps:
            _keep(spark, root, step, weights, first, second, losses)
        if watch and len(sums):
            watch(step, losses[-1])
    done = net.filled(weights)
    done.losses = losses
    return done


def _keep(spark: SparkSession, root: str, step: int, *state) -> None:
    rows = [(step, *[np.asarray(v).tolist() for v in state])]
    spark.createDataFrame(rows, "step int, weights array<double>, first array<double>, second array<double>, losses array<double>").coalesce(1).write.mode("overwrite").parquet(f"{root}/state-{step:07d}")


def _resumed(spark: SparkSession, root: str, s: Settings, net: Network):
    """The last state that was written to its end; a new run's, where there is none."""
    every = s.keep_every or s.batches
    for step in sorted({s.steps, *range(every, s.steps, every)}, reverse=True):
        if exists(spark, f"{root}/state-{step:07d}"):
            r = spark.read.parquet(f"{root}/state-{step:07d}").first()
            return r["step"], np.array(r["weights"]), np.array(r["first"]), np.array(r["second"]), list(r["losses"])
    start = net.flat()
    return 0, start, np.zeros_like(start), np.zeros_like(start), []


def predicted(df: DataFrame, x: str, net: Network, name: str = "probabilities") -> DataFrame:
    """df with an array of the network's probabilities, worked out by batch; null where x is null, of another length or has a null inside."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    out = StructType([*df.schema.fields, StructField(name, ArrayType(DoubleType()))])
    at, n_in, layers, schema = df.columns.index(x), net.layers[0][0].shape[0], net.layers, to_arrow_schema(out)

    def work(batches):
        import pyarrow as pa

        own = Network(layers)
        for b in batches:
            lists = b.column(at).to_pylist()
            good = [n for n, v in enumerate(lists) if v is not None and len(v) == n_in and None not in v]
            probabilities: list = [None] * len(lists)
            if good:
                for n, p in zip(good, own.predict(np.array([lists[n] for n in good], dtype=float)).tolist(), strict=True):
                    probabilities[n] = p
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(probabilities, pa.list_(pa.float64()))], schema=schema)

    return df.mapInArrow(work, out)
