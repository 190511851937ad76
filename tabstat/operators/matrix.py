"""M1-M5: Gramian, singular values, condition number, PCA.

``gramian`` reduces a table of any width to the p×p moment matrices in two
scans: the column means first, then the cross products of the columns shifted
by those means, formed block by block with numpy inside Arrow batches and
summed by a grouped aggregate. Shifted columns are centred up to the rounding
of the means, so nothing cancels however large the means are. The raw moments
follow from the centred ones. Only the p×p matrices reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Gram:
    cols: list
    n: int
    mean: np.ndarray       # (p,)
    raw: np.ndarray        # XᵀX, uncentred (p, p)
    centred: np.ndarray    # Σ (x - x̄)(x - x̄)ᵀ (p, p)

    def index(self, names: Sequence[str]) -> list[int]:
        return [self.cols.index(c) for c in names]

    def sub(self, names: Sequence[str]) -> Gram:
        ix = self.index(names)
        return Gram(list(names), self.n, self.mean[ix], self.raw[np.ix_(ix, ix)], self.centred[np.ix_(ix, ix)])


def gramian(df: DataFrame, cols: Sequence[str]) -> Gram:
    """M1: n, means, XᵀX and centred co-moments (rows with a NULL or NaN in
    any column are dropped first)."""
    cols = list(cols)
    p = len(cols)
    names = [f"x{i}" for i in range(p)]
    sel = df.select(*[F.col(c).cast("double").alias(x) for c, x in zip(cols, names)]).na.drop()
    row = sel.agg(*[F.avg(x).alias(x) for x in names]).first()
    shift = np.array([row[x] or 0.0 for x in names])
    ii, jj = np.triu_indices(p)

    def block(batches):
        n, s, xx = 0, np.zeros(p), np.zeros((p, p))
        for pdf in batches:
            a = pdf[names].to_numpy(dtype=float) - shift
            n += a.shape[0]
            s += a.sum(axis=0)
            xx += a.T @ a
        yield pd.DataFrame({"i": np.r_[ii, np.full(p, -1), [-2]], "j": np.r_[jj, np.arange(p), [-2]],
                            "v": np.r_[xx[ii, jj], s, [float(n)]]})

    tot = sel.mapInPandas(block, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    about, s, n = np.zeros((p, p)), np.zeros(p), 0
    for r in tot:
        if r["i"] == -2:
            n = int(r["v"])
        elif r["i"] == -1:
            s[r["j"]] = r["v"]
        else:
            about[r["i"], r["j"]] = about[r["j"], r["i"]] = r["v"]
    off = s / n if n else s
    centred = about - n * np.outer(off, off)
    mean = shift + off
    return Gram(cols, n, mean, centred + n * np.outer(mean, mean), centred)


def cross_products(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M1 as a table: (x, y, value) of XᵀX by plain sums of products, and the
    row count as ('n', 'n'). One aggregate of p²/2 sums, for narrow tables;
    ``gramian`` is the one for fits."""
    cols = list(cols)
    sel = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).na.drop()
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    wide = sel.agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in pairs])
    cells = [F.struct(F.lit("n").alias("x"), F.lit("n").alias("y"), F.col("n").alias("value"))]
    for i, j in pairs:
        for a, b in {(i, j), (j, i)}:
            cells.append(F.struct(F.lit(cols[a]).alias("x"), F.lit(cols[b]).alias("y"), F.col(f"s{i}_{j}").alias("value")))
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def scaled(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """A moment matrix at unit diagonal, the scale of its columns, its rank.

    The rank of columns with very different units is judged on the scaled
    matrix; a column without any variation counts as dependent.
    """
    d = np.sqrt(np.clip(np.diag(a), 0.0, None))
    d = np.where(d > 0, d, 1.0)
    unit = a / np.outer(d, d)
    ev = np.linalg.eigvalsh(unit) if len(a) else np.zeros(0)
    rank = int((ev > len(a) * np.finfo(float).eps * max(ev.max(initial=0.0), 1.0)).sum())
    return unit, d, rank


#: Triangles merged in one task before the driver merges the rest.
MERGE = 64


def triangle(df: DataFrame, cols: Sequence[str], intercept: bool = False) -> np.ndarray:
    """The R of X = QR (p x p; rows with a NULL or NaN are dropped first), with
    a column of ones in front if ``intercept`` is set.

    Every task keeps the R of what it has read and reads on; the tasks' R are
    merged MERGE ways by a shuffle, then on the driver. X is never squared, so
    the singular values of R are those of X to working precision, where the
    Gramian's are lost below 1e-8 of the largest.
    """
    names = [f"x{i}" for i in range(len(cols))]
    sel = df.select(*[F.col(c).cast("double").alias(x) for c, x in zip(cols, names)]).na.drop()
    p = len(cols) + intercept

    def reduced(batches):
        r = np.zeros((0, p))
        for b in batches:
            a = np.hstack([np.ones((len(b), 1)), b[names].to_numpy(float)]) if intercept else b[names].to_numpy(float)
            r = np.linalg.qr(np.vstack([r, a]), mode="r")
        yield pd.DataFrame({"r": [r.ravel()]})

    def merged(own: pd.DataFrame) -> pd.DataFrame:
        r = np.vstack([np.asarray(v).reshape(-1, p) for v in own["r"]])
        return pd.DataFrame({"r": [np.linalg.qr(r, mode="r").ravel()]})

    parts = sel.mapInPandas(reduced, "r array<double>").withColumn("k", F.pmod(F.spark_partition_id(), F.lit(MERGE)))
    rows = parts.groupBy("k").applyInPandas(lambda own: merged(own[["r"]]), "r array<double>").collect()
    r = np.vstack([np.zeros((0, p)), *[np.array(x["r"]).reshape(-1, p) for x in rows]])
    return np.linalg.qr(r, mode="r") if len(r) else np.zeros((0, p))


def singular_values(x: Gram | np.ndarray) -> np.ndarray:
    """M2: singular values of the uncentred matrix X (descending), from its
    ``triangle``, or from a Gramian with half the digits."""
    if isinstance(x, Gram):
        return np.sqrt(np.clip(np.linalg.eigvalsh(x.raw)[::-1], 0.0, None))
    s = np.linalg.svd(x, compute_uv=False)
    return np.concatenate([s, np.zeros(x.shape[1] - len(s))])


def condition_number(x: Gram | np.ndarray) -> float:
    """M3: σmax/σmin; infinite when σmin is within rounding of 0 (p · eps · σmax
    for a triangle, its square root for a Gramian)."""
    s = singular_values(x)
    if s.size == 0:
        return float("inf")
    tiny = len(s) * np.finfo(float).eps
    if s[-1] <= (np.sqrt(tiny) if isinstance(x, Gram) else tiny) * s[0]:
        return float("inf")
    return float(s[0] / s[-1])


#: Loadings up to which projections are column expressions; more of them make
#: plans that take the driver's memory.
PLAN_TERMS = 512


@dataclass
class PCAModel:
    cols: list
    mean: np.ndarray
    components: np.ndarray   # (k, p), rows are unit loadings
    explained_variance: np.ndarray
    explained_ratio: np.ndarray

    @property
    def k(self) -> int:
        return self.components.shape[0]

    def score_columns(self, prefix: str = "pc") -> list[Column]:
        """Centred projections as Column expressions (no Python in the plan)."""
        out = []
        for a in range(self.k):
            expr = None
            for j, c in enumerate(self.cols):
                term = (F.col(c).cast("double") - F.lit(float(self.mean[j]))) * F.lit(float(self.components[a, j]))
                expr = term if expr is None else expr + term
            out.append(expr.alias(f"{prefix}{a + 1}"))
        return out

    def transform(self, df: DataFrame, keep: Sequence[str] = (), prefix: str = "pc") -> DataFrame:
        if self.components.size <= PLAN_TERMS:
            return df.select(*keep, *self.score_columns(prefix))
        mean, loadings = self.mean, self.components.T

        @F.pandas_udf("array<double>")
        def projected(col: pd.Series) -> pd.Series:
            some = col.notna()
            done = iter((np.vstack(col[some].to_numpy()) - mean) @ loadings if some.any() else ())
            return pd.Series([next(done) if x else None for x in some], dtype=object)

        x = F.array(*[F.col(c).cast("double") for c in self.cols])
        scores = projected(F.when(~F.exists(x, lambda v: v.isNull()), x))
        return df.select(*keep, scores.alias("_ts_pc")).select(*keep, *[F.col("_ts_pc")[a].alias(f"{prefix}{a + 1}") for a in range(self.k)])


def pca_fit(df: DataFrame | Gram, cols: Sequence[str] | None = None, k: int | None = None,
            variance: float | None = 0.95) -> PCAModel:
    """M4: centred PCA from the covariance (n-1) matrix.

    k = given, or the first k whose cumulative explained ratio is strictly
    above ``variance``. Signs: each component's largest |loading| positive.
    """
    g = df if isinstance(df, Gram) else gramian(df, cols)
    cov = g.centred / max(g.n - 1, 1)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    vals = np.clip(vals[order], 0.0, None)
    vecs = vecs[:, order].T
    for a in range(vecs.shape[0]):
        j = np.argmax(np.abs(vecs[a]))
        if vecs[a, j] < 0:
            vecs[a] = -vecs[a]
    total = vals.sum()
    ratio = vals / total if total > 0 else np.zeros_like(vals)
    if k is None:
        if variance is None:
            k = len(vals)
        else:
            cum = np.cumsum(ratio)
            above = np.nonzero(cum > variance)[0]
            k = int(above[0]) + 1 if above.size else len(vals)
    return PCAModel(list(g.cols), g.mean, vecs[:k], vals[:k], ratio[:k])


def cumulative_variance(df: DataFrame | Gram, cols: Sequence[str] | None = None) -> pd.DataFrame:
    """M5: (k, ratio, cumulative) for all components."""
    m = pca_fit(df, cols, k=None, variance=None)
    return pd.DataFrame({"k": np.arange(1, m.k + 1), "ratio": m.explained_ratio,
                         "cumulative": np.cumsum(m.explained_ratio)})
