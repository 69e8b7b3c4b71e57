"""Cross-product aggregate: counts, sums and products of several columns in one scan.

A task adds up the products of its rows, shifted by a point near the means, and gives the
matrix once; Spark adds the matrices by place. Regressions, instrumental variables and principal
components of any number of rows are then algebra on a columns x columns matrix.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .kmeans import FIELDS, _rows, _table


@dataclass
class Gram:
    """Number of rows, their mean, and the sums of products of the columns' differences from it."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    def columns(self, which: Sequence[int]) -> "Gram":
        i = list(which)
        return Gram(self.n, self.mean[i], self.products[np.ix_(i, i)])


def gram(df: DataFrame, cols: Sequence[str]) -> Gram:
    """Of the rows without a null or nan in ``cols``; two scans, one for the shift."""
    ship_package(df.sparkSession)
    x = df.select(*[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(cols)])
    for j in range(len(cols)):
        x = x.where(F.col(f"x{j}").isNotNull() & ~F.isnan(f"x{j}"))
    shift = x.agg(*[F.avg(f"x{j}") for j in range(len(cols))]).first()
    origin = np.array([v or 0.0 for v in shift])

    def run(batches):
        total = np.zeros((len(cols) + 1, len(cols) + 1))
        for b in batches:
            v = np.column_stack([b.column(j).to_numpy() for j in range(len(cols))]) - origin
            wide = np.column_stack([np.ones(len(v)), v])
            total += wide.T @ wide
        yield _rows(total)

    got = x.mapInArrow(run, FIELDS).groupBy("slot", "place").agg(F.sum("value").alias("value")).toPandas()
    total = _table(got, len(cols) + 1, len(cols) + 1)
    n = int(round(total[0, 0]))
    if not n:
        return Gram(0, np.full(len(cols), np.nan), np.zeros((len(cols), len(cols))))
    off = total[0, 1:] / n
    return Gram(n, origin + off, total[1:, 1:] - n * np.outer(off, off))


def two_stage(g: Gram, instrument: int, treatment: int, outcome: int, controls: Sequence[int] = ()) -> dict[str, float] | None:
    """2SLS of ``outcome`` on ``treatment`` and ``controls`` with an intercept: estimate, standard error (equal variances, n - k
    degrees of freedom), and the first stage's slope on the instrument. None if the instrument doesn't tell."""
    x, z = [treatment, *controls], [instrument, *controls]
    zz, zx, zy = g.products[np.ix_(z, z)], g.products[np.ix_(z, x)], g.products[z, outcome]
    if g.n <= len(x) + 1 or np.linalg.matrix_rank(zx) < len(x) or np.linalg.matrix_rank(zz) < len(z):
        return None
    beta = np.linalg.solve(zx, zy)
    first = np.linalg.solve(zz, zx[:, 0])
    xx, xy, yy = g.products[np.ix_(x, x)], g.products[x, outcome], g.products[outcome, outcome]
    residual = max(yy - 2 * beta @ xy + beta @ xx @ beta, 0.0)
    df = g.n - len(x) - 1
    fitted = zx.T @ np.linalg.solve(zz, zx)  # products of the fitted columns
    se = float(np.sqrt(residual / df * np.linalg.inv(fitted)[0, 0])) if df > 0 else float("nan")
    return {"iv_estimate": float(beta[0]), "standard_error": se, "first_stage": float(first[0]), "df": df}


def principal_axes(g: Gram, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` axes (columns; the largest part of each is positive) and their shares of the variance."""
    value, vector = np.linalg.eigh(g.products)
    order = np.argsort(-value, kind="stable")[:k]
    axes = vector[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    total = value.sum()
    return axes, value[order] / total if total > 0 else np.full(len(order), np.nan)
