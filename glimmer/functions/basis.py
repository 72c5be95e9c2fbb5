"""B-spline bases, and the least-squares fit of a trace on a fixed basis as array expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from glimmer.functions import arrays as A


def b_splines(n: int, knots: int, order: int = 4) -> np.ndarray:
    """Values at 1..n of the B-splines of an order over evenly spaced breaks: a column for each (Cox-de Boor)."""
    x, breaks = np.arange(1.0, n + 1), np.linspace(1, n, knots)
    t = np.concatenate([[breaks[0]] * (order - 1), breaks, [breaks[-1]] * (order - 1)])
    b = ((x[:, None] >= t[:-1]) & (x[:, None] < t[1:])).astype(float)
    b[-1] = 0
    b[-1, len(t) - order - 1] = 1  # the last break belongs to the last interval
    for k in range(2, order + 1):
        left, right = t[k - 1 : -1] - t[: -k], t[k:] - t[1 : len(t) - k + 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            rise = np.where(left > 0, (x[:, None] - t[: -k]) / left, 0)
            fall = np.where(right > 0, (t[k:] - x[:, None]) / right, 0)
        b = rise * b[:, :-1] + fall * b[:, 1:]
    return b


def without_trend(y: Column, basis: np.ndarray) -> Column:
    """y less its least-squares fit on the columns of basis; y has as many values as basis has rows."""
    solve = np.linalg.pinv(basis)
    array = lambda v: F.array(*[F.lit(float(x)) for x in v])
    weights = F.array(*[A.dot(y, array(row)) for row in solve])
    rows = F.array(*[array(row) for row in basis])
    return A.given(weights, lambda w: F.zip_with(y, rows, lambda v, b: v - A.dot(w, b)))
