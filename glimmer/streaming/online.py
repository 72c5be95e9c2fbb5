"""Deconvolution of a stream of samples: only the pools of a series that are still open can change."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def online_calcium(samples: DataFrame, g: float, smin: float = 0.0, look_back: int | None = None) -> DataFrame:
    """(user_id, t, c, spike) of the frames that are final, from a stream of (user_id, t, y) in time order per series.

    The state of a series is its open pools, four numbers each, and its frame count. A row without t ends its series: all
    its pools are final then, and the result is that of the whole trace. With look_back, a pool that many pools back is
    final as it stands; that bounds the state and the delay, but a sample that would reach further back no longer does.
    """

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count, values, weights, starts, lengths, before = state.get if state.exists else (0, [], [], [], [], 0.0)
        pools = [list(p) for p in zip(values, weights, starts, lengths, strict=True)]
        rows = []

        def leave() -> None:
            nonlocal before
            v, w, t, n = pools.pop(0)
            c = max(0.0, v / w)
            for i in range(n):
                rows.append((key[0], t + i + 1, c * g**i, max(0.0, c - g * before) if i == 0 and t else 0.0))
            before = c * g ** (n - 1)

        parts = list(frames)
        at, values = (np.concatenate([p[k].to_numpy(float) for p in parts]) for k in ("t", "y"))
        ends = bool(np.isnan(at).any())
        for y in values[np.argsort(at)][: int(np.isfinite(at).sum())].tolist():
            pools.append([y, 1.0, count, 1])
            count += 1
            while len(pools) > 1:
                v, w, t, n = pools[-2]
                if pools[-1][0] / pools[-1][1] >= max(0.0, v / w) * g**n + smin:
                    break
                v2, w2, _, n2 = pools.pop()
                pools[-1] = [v + v2 * g**n, w + w2 * g ** (2 * n), t, n + n2]
            while look_back is not None and len(pools) > look_back:
                leave()
        if ends:
            while pools:
                leave()
            if state.exists:
                state.remove()
        else:
            columns = [list(x) for x in zip(*pools, strict=True)]
            state.update((count, *columns, before))
        if rows:  # most series end in one call; an empty table for each of the others costs as much as its samples
            yield pd.DataFrame(dict(zip(("user_id", "t", "c", "spike"), map(list, zip(*rows, strict=True)), strict=True)))

    out = "user_id long, t long, c double, spike double"
    held = "count long, v array<double>, w array<double>, t array<long>, l array<long>, before double"
    return samples.groupBy("user_id").applyInPandasWithState(update, out, held, "append", "NoTimeout")


def running_footprints(samples: DataFrame) -> DataFrame:
    """Sums from which the mean footprint over all batches follows: a stream of (neuron, pix, a, e) to its totals."""
    return samples.selectExpr("neuron", "pix", "a * e as ae", "e").groupBy("neuron", "pix").agg({"ae": "sum", "e": "sum"}).withColumnsRenamed({"sum(ae)": "ae", "sum(e)": "e"})
