"""Traces with known spikes, made by Spark: for tests and for trying parameters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def traces(spark: SparkSession, n: int = 20, g: tuple[float, ...] = (0.95,), noise: float = 0.3, frames: int = 3000, rate: float = 30, spikes: float = 0.5, b: float = 0.0, seed: int = 13, wave: bool = False) -> DataFrame:
    """(trace_id, y, true_c, true_s): spikes at `spikes` a second of `rate` frames, through an AR model, with noise.

    Each trace has a random stream of its own, so the result does not depend on how rows are dealt. wave: the rate goes
    up and down with the cube of a sine.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k in batch["id"]:
                rng = np.random.default_rng([seed, int(k)])
                chance = spikes / rate * (np.sin(np.arange(1, frames + 1) / 50) ** 3 + 1 if wave else 1.0)
                s = (rng.random(frames) < chance) * 1.0
                c = s.copy()
                for t in range(frames):
                    c[t] += sum(a * c[t - 1 - i] for i, a in enumerate(g) if t > i)
                rows.append((int(k) + 1, b + c + noise * rng.standard_normal(frames), c, s))
            yield pd.DataFrame(rows, columns=["trace_id", "y", "true_c", "true_s"])

    return spark.range(n).mapInPandas(make, "trace_id long, y array<double>, true_c array<double>, true_s array<double>")
