"""Dense networks for a 0/1 label, trained by mini-batch Adam.

Hidden layers are ReLU units with inverted dropout, the output is one sigmoid
unit, the loss is binary cross-entropy. An epoch visits ``steps`` mini-batches;
a row's batch is a hash of its key, the order of the batches is drawn anew for
every epoch. A step is one job: the tasks back-propagate their rows of the batch
in slices, their gradients are added on the executors, and the driver, which
holds the weights alone, takes one Adam step. Rows are sorted by batch inside
the cached partitions, so the cache's statistics skip the other batches.

Sums do not depend on partitioning. Activations and errors are rounded to
multiples of 2^-12 and 2^-20 before they are multiplied, so that the products
of a slice add up without rounding (for inputs below about 2,000, as scaled ones
are) and go on as integers in two halves. Dropout is a hash of (seed, key,
step, layer, unit), weights start from hash-drawn Glorot uniforms.

Several networks share the jobs: with ``fold`` one is trained without each fold,
and one on all rows.

Rows with a null label, feature or weight, or a non-finite feature, take no
part; rows of equal keys are in the same batch with the same dropout. Without
rows the weights stay as drawn. A row with a null feature vector scores null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstat.operators.trees import draw
from tabstat.session import materialize, ship_package

#: Rows of a slice; bits after the point of activations and errors; the low
#: half of an integer sum.
SLICE, ACTIVATION_BITS, ERROR_BITS, HALF = 1024, 12, 20, 24

Layers = list[tuple[np.ndarray, np.ndarray]]


def initial(widths: Sequence[int], seed: int) -> Layers:
    """Glorot uniform weights by hash, biases of zero."""
    layers = []
    for k, (n, m) in enumerate(zip(widths, widths[1:])):
        bound = np.sqrt(6.0 / (n + m))
        layers.append((bound * (2 * draw(seed, k, np.arange(n * m), 4).reshape(n, m) - 1), np.zeros(m)))
    return layers


def forward(layers: Layers, x: np.ndarray) -> np.ndarray:
    """The probability of label 1, without dropout."""
    for w, b in layers[:-1]:
        x = np.maximum(x @ w + b, 0.0)
    w, b = layers[-1]
    return 1 / (1 + np.exp(-np.clip((x @ w + b)[:, 0], -500, 500)))


def _rounded(a: np.ndarray, bits: int) -> np.ndarray:
    return np.rint(a * (1 << bits))


def gradient(layers: Layers, x: np.ndarray, y: np.ndarray, weight: np.ndarray, kept: Sequence[np.ndarray] = ()) -> np.ndarray:
    """Gradient of the weighted sum of losses over the rows of a slice, flat, as
    integers in units of 2^-(ACTIVATION_BITS + ERROR_BITS); the last entry is
    the sum of weights. ``kept`` holds a hidden layer's dropout factors each."""
    inputs = [x]
    for k, (w, b) in enumerate(layers[:-1]):
        x = np.maximum(x @ w + b, 0.0)
        x = x * kept[k] if kept else x
        inputs.append(x)
    w, b = layers[-1]
    p = 1 / (1 + np.exp(-np.clip((inputs[-1] @ w + b)[:, 0], -500, 500)))
    error = (weight * (p - y))[:, None]
    one = np.int64(1 << ACTIVATION_BITS)
    parts = [np.array([_rounded(weight, ERROR_BITS).sum()]).astype(np.int64) * one]
    for k in range(len(layers) - 1, -1, -1):
        e = _rounded(error, ERROR_BITS)
        parts += [e.sum(axis=0).astype(np.int64) * one, (_rounded(inputs[k], ACTIVATION_BITS).T @ e).astype(np.int64).ravel()]
        if k:
            error = (error @ layers[k][0].T) * (inputs[k] > 0) * (kept[k - 1] if kept else 1.0)
    return np.concatenate(parts[::-1])


def _flat(layers: Layers) -> np.ndarray:
    return np.concatenate([v.ravel() for layer in layers for v in layer])


def _shaped(flat: np.ndarray, widths: Sequence[int]) -> Layers:
    layers, at = [], 0
    for n, m in zip(widths, widths[1:]):
        layers.append((flat[at:at + n * m].reshape(n, m), flat[at + n * m:at + n * m + m]))
        at += n * m + m
    return layers


@dataclass
class Network:
    """Weights by layer; ``epochs`` has those after every epoch."""

    layers: Layers
    epochs: list[Layers] = field(default_factory=list)

    def score(self, df: DataFrame, features: str = "features", out: str = "score") -> DataFrame:
        """Adds the probability of label 1."""
        layers = self.layers

        @F.pandas_udf("double")
        def probability(v: pd.Series) -> pd.Series:
            done = pd.Series(np.nan, index=v.index, dtype=float)
            known = v.notna()
            if known.any():
                done[known] = forward(layers, np.vstack(v[known].to_numpy()))
            return done

        p = probability(_vector(df, features))
        return df.withColumn(out, F.when(~F.isnan(p), p))


def _vector(df: DataFrame, features: str) -> Column:
    x = F.col(features)
    if not dict(df.dtypes)[features].startswith("array"):
        x = F.when(x.isNotNull(), vector_to_array(x))
    return x.cast("array<double>")


def _clean(df: DataFrame, features: str, label: str, **others: Column) -> DataFrame:
    rows = df.select(_vector(df, features).alias("x"), F.col(label).cast("double").alias("y"), *(c.alias(k) for k, c in others.items())).na.drop()
    return rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))


def fit(train: DataFrame, key: str, label: str = "label", features: str = "features", hidden: Sequence[int] = (64, 32), epochs: int = 50, steps: int = 8,
        dropout: float = 0.5, learning_rate: float = 1e-3, weight: str | None = None, fold: str | None = None, seed: int = 1729) -> dict[int | None, Network]:
    """Networks by the fold they have not seen; ``None`` is the one of all rows
    (the only one without ``fold``)."""
    ship_package(train.sparkSession)
    u = F.xxhash64(key, F.lit(seed))
    rows = _clean(train, features, label, w=F.col(weight).cast("double") if weight else F.lit(1.0), f=F.col(fold).cast("int") if fold else F.lit(-1), u=u)
    rows = materialize(rows.withColumn("batch", F.pmod(F.xxhash64("u"), F.lit(steps)).cast("int")).sortWithinPartitions("batch"), "persist")
    try:
        seen = rows.groupBy("f").agg(F.first(F.size("x")).alias("d")).collect()  # a row per fold
        names = [None, *sorted(r["f"] for r in seen if fold)]
        widths = [seen[0]["d"] if seen else 1, *hidden, 1]
        start = _flat(initial(widths, seed))
        state = {name: (start.copy(), np.zeros(len(start)), np.zeros(len(start))) for name in names}
        done = {name: [] for name in names}
        t = 0
        for epoch in range(epochs if seen else 0):
            for batch in np.argsort(draw(seed, epoch, np.arange(steps), 5), kind="stable"):
                t += 1
                sums = _step(rows.where(F.col("batch") == int(batch)), {n: s[0] for n, s in state.items()}, widths, dropout, seed, t)
                for name, total in sums.items():
                    if total[-1] > 0:
                        state[name] = _adam(state[name], total[:-1] / total[-1], t, learning_rate)
            for name in names:
                done[name].append(_shaped(state[name][0], widths))
    finally:
        rows.unpersist()
    return {name: Network(_shaped(state[name][0], widths), done[name]) for name in names}


def _adam(state, g: np.ndarray, t: int, rate: float):
    # fixed values: the method's usual decay rates and epsilon
    w, m, v = state
    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
    return w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-7), m, v


def _step(rows: DataFrame, weights: Mapping[int | None, np.ndarray], widths: Sequence[int], dropout: float, seed: int, t: int) -> dict:
    """Summed gradient (and weight, last) of each network over the rows."""
    names = list(weights)
    flats = [weights[n] for n in names]

    def part(batches):
        nets = [_shaped(f, widths) for f in flats]
        total = np.zeros((len(nets), len(flats[0]) + 1), np.int64)
        for b in batches:
            for at in range(0, len(b), SLICE):
                s = b.iloc[at:at + SLICE]
                x, y, w, f = np.vstack(s["x"].to_numpy()), s["y"].to_numpy(), s["w"].to_numpy(), s["f"].to_numpy()
                u = s["u"].to_numpy().view(np.uint64)[:, None]
                kept = [(draw(seed, u, np.arange(width) + (k << 32), 6 + t) >= dropout) / (1 - dropout) for k, width in enumerate(widths[1:-1])] if dropout else []
                for k, (name, net) in enumerate(zip(names, nets)):
                    own = slice(None) if name is None else np.flatnonzero(f != name)
                    total[k] += gradient(net, x[own], y[own], w[own], [m[own] for m in kept])
        if total[:, -1].any():
            yield pd.DataFrame({"net": range(len(nets)), "high": list(total >> HALF), "low": list(total & ((1 << HALF) - 1))})

    sums = (rows.mapInPandas(part, "net int, high array<long>, low array<long>").select("net", F.posexplode(F.arrays_zip("high", "low")).alias("at", "v"))
            .groupBy("net", "at").agg(F.sum("v.high").alias("high"), F.sum("v.low").alias("low")).toPandas())
    out = {}
    for k, own in sums.groupby("net"):
        own = own.sort_values("at")
        out[names[k]] = (own["high"].to_numpy().astype(float) * (1 << HALF) + own["low"].to_numpy()) / 2.0 ** (ACTIVATION_BITS + ERROR_BITS)
    return out


def learning_curve(net: Network, frames: Mapping[str, DataFrame], label: str = "label", features: str = "features") -> DataFrame:
    """(epoch, dataset, accuracy, loss) after every epoch, without dropout, from
    one scan of each frame; a frame without rows has no lines."""
    epochs = net.epochs

    def part(batches):
        total = np.zeros((len(epochs), 2))
        n = 0
        for b in batches:
            if not len(b):
                continue
            x, y = np.vstack(b["x"].to_numpy()), b["y"].to_numpy()
            n += len(b)
            for k, layers in enumerate(epochs):
                p = forward(layers, x)
                q = np.clip(np.where(y == 1, p, 1 - p), 1e-7, 1.0)
                total[k] += ((p >= 0.5) == (y == 1)).sum(), -np.log(q).sum()
        if n:
            yield pd.DataFrame({"epoch": range(1, len(epochs) + 1), "n": n, "right": total[:, 0], "loss": total[:, 1]})

    out = None
    for name, df in frames.items():
        sums = _clean(df, features, label).mapInPandas(part, "epoch int, n long, right double, loss double").groupBy("epoch").agg(F.sum("n").alias("n"), F.sum("right").alias("right"), F.sum("loss").alias("loss"))
        own = sums.select("epoch", F.lit(name).alias("dataset"), (F.col("right") / F.col("n")).alias("accuracy"), (F.col("loss") / F.col("n")).alias("loss"))
        out = own if out is None else out.unionByName(own)
    return out
