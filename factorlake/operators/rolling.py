"""Rolling multivariate regressions from prefix sums of products.

Every row gets the sums over its window of all products of (1, x1, ..., y), as the difference of two running sums of its series; so
no row is copied into the windows that hold it. What goes to numpy is one such array for each row of output, in batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorlake.functions.timeseries import Keys, running, scanned


def products(xs: list[str], y: str) -> list[Column]:
    """The products of all pairs of (1, xs, y), row by row of the upper triangle."""
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in (*xs, y)]]
    return [a * b for i, a in enumerate(terms) for b in terms[i:]]


class Windowed:
    """Sums over the `rows` rows that end `end` rows before each one, of series that may go on from batch to batch: differences of two running
    sums, of which the last rows + end are carried."""

    def __init__(self, rows: int, end: int) -> None:
        self.rows, self.end, self.tail = rows, end, None

    def __call__(self, number: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.tail is None:
            self.tail = np.zeros((self.rows + self.end, x.shape[1]))
        sums = np.vstack([self.tail, running(x, number == 1, 1.0, self.tail[-1])])
        here = np.arange(len(x)) + len(self.tail)
        upper = sums[here - self.end] * (number > self.end)[:, None]
        lower = sums[here - self.end - self.rows] * (number > self.end + self.rows)[:, None]
        self.tail = sums[-len(self.tail) :]
        return upper - lower


def multiplied(x: np.ndarray) -> np.ndarray:
    """Rows (xs..., y) to what products() gives."""
    terms = np.column_stack([np.ones(len(x)), x])
    i, j = np.triu_indices(terms.shape[1])
    return terms[:, i] * terms[:, j]


def with_gram(df: DataFrame, xs: list[str], y: str, by: Keys, order: Keys, rows: int, end: int = 0, name: str = "gram") -> DataFrame:
    """Adds the array of the products' sums over the `rows` rows that end `end` rows before the current one (0: with it)."""

    def make() -> Callable:
        window = Windowed(rows, end)

        def each(number: np.ndarray, x: np.ndarray, there: np.ndarray) -> list[pa.Array]:
            sums = window(number, multiplied(x) * multiplied(there.astype(float)))
            return [pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1]), pa.array(sums.ravel()))]

        return each

    return scanned(df, by, order, {c: F.col(c) for c in (*xs, y)}, make, {name: "array<double>"})


def gram(xs: list[str], y: str) -> Column:
    """Aggregate: the products' sums of a group."""
    return F.array(*[F.coalesce(F.sum(p), F.lit(0.0)) for p in products(xs, y)])


def solved(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of upper triangles to (coefficients with the intercept first, sums of squared residuals); directions
    that the window doesn't vary in get 0, as the least solution has them."""
    k = int((np.sqrt(8 * sums.shape[1] + 1) - 1) / 2)
    full = np.zeros((len(sums), k, k))
    i, j = np.triu_indices(k)
    full[:, i, j] = full[:, j, i] = sums
    a, b, yy = full[:, :-1, :-1], full[:, :-1, -1], full[:, -1, -1]
    # Columns of one size, so that one cut for all serves factors of any scale.
    scale = np.sqrt(np.maximum(np.einsum("nii->ni", a), 1e-300))
    beta = np.einsum("nij,nj->ni", np.linalg.pinv(a / scale[:, :, None] / scale[:, None, :], rcond=1e-12, hermitian=True), b / scale) / scale
    left = yy - 2 * np.einsum("ni,ni->n", beta, b) + np.einsum("ni,nij,nj->n", beta, a, beta)
    return beta, np.maximum(left, 0)


def stacked(values) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return np.stack(values.to_numpy()).astype(float)
