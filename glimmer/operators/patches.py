"""Kernels that need the pixels of one patch together: seeding, ring regression, background and factor updates.

A patch with its halo is the unit of work; its size is fixed when the movie is laid out, whatever the movie's size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.functions import images as I  # noqa: E741
from glimmer.functions import kernels as K
from glimmer.operators.layout import block_members, patch_of
from glimmer.operators.shared import apart


def blocks(pixels: DataFrame, height: int, size: int, halo: int) -> DataFrame:
    """A row for each pixel of each block: (patch, inside, pix, r, c, y). The halo is dealt once, at this shuffle."""
    return block_members(pixels, height, size, halo).join(pixels.select("pix", "r", "c", "y"), "pix")


def _image(group: pd.DataFrame):
    group = group.sort_values(["c", "r"])
    return group, np.nan_to_num(np.vstack(group["y"].to_list()))


def _stack(group: pd.DataFrame):
    """The group's rows with the movie of their rectangle (r, c, frame); pixels that are not there are 0."""
    group, y = _image(group)
    r, c = group["r"].to_numpy() - group["r"].min(), group["c"].to_numpy() - group["c"].min()
    stack = np.zeros((int(r.max()) + 1, int(c.max()) + 1, y.shape[1]))
    stack[r, c] = y
    return group, stack, r, c


def _grid(group: pd.DataFrame, column: str, r, c, stack: np.ndarray) -> np.ndarray:
    values = group[column].to_numpy()
    out = np.full(stack.shape[:2], False if values.dtype == bool else -1)
    out[r, c] = values
    return out


def _whole(batches, key: str):
    """(key, rows) of each group of a partition that is sorted by key; a group may lie in several batches."""
    parts, last = [], None
    for batch in batches:
        names = batch[key].to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]])) if len(names) else np.zeros(0, int)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if parts and names[a] != last:
                yield last, pd.concat(parts) if len(parts) > 1 else parts[0]
                parts = []
            last = names[a]
            parts.append(batch.iloc[a:b])
    if parts:
        yield last, pd.concat(parts) if len(parts) > 1 else parts[0]


def smoothed(blocks: DataFrame, sigma: float, decay: float = 0.0) -> DataFrame:
    """(pix, r, c, y): each frame blurred by a Gaussian; of a frame the part `decay` goes on into the next."""
    x = np.arange(2 * int(np.ceil(2 * sigma)) + 1) - int(np.ceil(2 * sigma))
    g = np.exp(-(x[:, None] ** 2 + x**2) / (2 * sigma**2))

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group, stack, r, c = _stack(group)
        stack = I.filtered(stack, g / g.sum())
        for t in range(1, stack.shape[-1]):
            stack[..., t] += decay * stack[..., t - 1]
        out = stack[r, c]
        return pd.DataFrame({"pix": group["pix"], "r": group["r"], "c": group["c"], "y": list(out)})[group["inside"].to_numpy()]

    return blocks.groupBy("patch").applyInPandas(run, "pix long, r long, c long, y array<double>")


def screened(stack: np.ndarray, sigma: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(filtered movie about its median, local correlation over three deviations of noise, peak-to-noise ratio, noise)."""
    hy = I.filtered(stack, I.centred_psf(sigma)) if sigma else stack.copy()
    hy -= np.median(hy, -1, keepdims=True)
    sn = K.noise_level(hy.reshape(-1, hy.shape[-1])).reshape(hy.shape[:2])
    pnr = hy.max(-1) / np.where(sn > 0, sn, np.inf)
    return hy, I.neighbour_correlation(np.where(hy < 3 * sn[..., None], 0.0, hy)), pnr, sn


def correlation_pnr(blocks: DataFrame, sigma: float | None) -> DataFrame:
    """(pix, cn, pnr) by the filtered movie of each patch; where patches overlap, the larger value counts."""

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group, stack, r, c = _stack(group)
        _, cn, pnr, _ = screened(stack, sigma)
        return pd.DataFrame({"pix": group["pix"], "cn": cn[r, c], "pnr": pnr[r, c]})[group["inside"].to_numpy()]

    found = blocks.groupBy("patch").applyInPandas(run, "pix long, cn double, pnr double")
    return found.groupBy("pix").agg(F.round(F.max("cn"), 6).alias("cn"), F.round(F.max("pnr"), 6).alias("pnr"))


def _extracted(hy: np.ndarray, y: np.ndarray, at: tuple[int, int]):
    """(footprint, trace) of the source at a pixel of a box: the trace of what goes with the pixel in the filtered movie,
    the footprint by regression on it and on the box's background; None if there is no such source."""
    flat = hy.reshape(-1, hy.shape[-1])
    z = flat - flat.mean(-1, keepdims=True)
    own = z[at[0] * hy.shape[1] + at[1]]
    scale = np.sqrt(np.einsum("ij,ij->i", z, z) * (own @ own))
    corr = z @ own / np.where(scale > 0, scale, np.inf)
    trace = flat[corr > 0.9].mean(0)
    if not trace.any():
        return None
    rows = y.reshape(-1, y.shape[-1])
    far = rows[corr < 0.3]
    background = np.median(far, 0) if len(far) else np.zeros(y.shape[-1])
    x = np.vstack([np.ones(y.shape[-1]), background, trace])
    a = np.maximum(0.0, np.linalg.lstsq(x @ x.T, x @ rows.T, rcond=None)[0][2]).reshape(y.shape[:2])
    if not a.any():
        return None
    a = I.convex(a)
    a = I.connected(a) if a.any() else a
    if (a > 0).sum() < 5:
        return None
    return a, trace


def _risen(traces: np.ndarray) -> np.ndarray:
    """The traces (rows) less their baselines: the histogram's peak, or the middle of small rises where it is wide."""
    b, sn = K.histogram_baselines(traces)
    psd = K.noise_level(traces)
    for i in np.flatnonzero(sn > psd):
        trace = traces[i]
        rise = np.diff(trace, prepend=trace[0] + 1)
        flat = trace[(rise >= 0) & (rise < psd[i])]
        b[i] = float(np.median(flat)) if len(flat) else 0.0
    return traces - b[:, None]


#: Samples of the patches that a task seeds side by side.
SEEDED_AT_ONCE = 1 << 22


def _side_by_side(begin):
    """A function for mapInPandas on rows sorted by patch: begin(patch, rows) is a generator that yields the trace of a
    source and is sent that trace above its baseline and its calcium; it returns the patch's rows.

    The patches of a task, some SEEDED_AT_ONCE samples at a time, go step by step together, so that the traces they
    yield are deconvolved together; a patch's rows do not depend on the patches beside it.
    """

    def finished(groups: list[tuple[int, pd.DataFrame]], columns: list[str]) -> pd.DataFrame:
        waiting, rows = [(begin(k, g), None) for k, g in groups], []
        while waiting:
            asked = []
            for patch, answer in waiting:
                try:
                    asked.append((patch, patch.send(answer)))
                except StopIteration as end:
                    rows += end.value
            waiting = []
            if asked:
                risen = _risen(np.array([t for _, t in asked]))
                waiting = [(patch, found) for (patch, _), *found in zip(asked, risen, K.calcium_ar1(risen), strict=True)]
        return pd.DataFrame(rows, columns=columns, dtype=None if rows else object)

    def run(batches, columns: list[str]):
        groups, samples = [], 0
        for patch, rows in _whole(batches, "patch"):
            groups.append((int(patch), rows))
            samples += len(rows) * len(rows["y"].iloc[0])
            if samples >= SEEDED_AT_ONCE:
                yield finished(groups, columns)
                groups, samples = [], 0
        if groups:
            yield finished(groups, columns)

    return run


def sources(blocks: DataFrame, sigma: float | None, size: int, min_corr: float, min_pnr: float, min_pixel: int = 5, border: int = 0, most: int | None = None) -> DataFrame:
    """Seeding with background: (patch, pix, score, pixels, weights, trace) of the sources whose seed is in the patch.

    The movie is filtered by a centred Gaussian; from the best local maximum of correlation times peak-to-noise ratio on,
    a source is extracted, subtracted from the movie and, filtered, from the filtered movie, and the scores around it are
    made anew. It ends when no maximum is over both thresholds, or after `most` sources.
    """
    psf = I.centred_psf(sigma) if sigma else None

    def seeded(patch: int, group: pd.DataFrame):
        group, y, r, c = _stack(group)
        pix, inside = _grid(group, "pix", r, c, y), _grid(group, "inside", r, c, y)
        hy, cn, pnr, sn = screened(y, sigma)
        free = pix >= 0
        if border:
            free[:border] = free[-border:] = free[:, :border] = free[:, -border:] = False
        tie = 1e-10 * (10 * np.arange(y.shape[1])[None, :] + np.arange(y.shape[0])[:, None])
        rows, done = [], 0
        while most is None or done < most:
            score = np.where((cn < min_corr) | (pnr < min_pnr), 0.0, cn * pnr)
            v = np.where(free, I.median3(score) + tie, 0.0)
            top = (v >= I.largest(v, max(1, round(size / 8)))) & (v > min_corr * min_pnr)
            if not top.any():
                break
            k = tuple(np.unravel_index(np.argmax(np.where(top, v, -1)), v.shape))
            free[k] = False
            rise = np.diff(hy[k])
            if rise.max(initial=0) < 3 * rise.std():
                continue
            box = tuple(slice(max(0, x - size), x + size + 1) for x in k)
            found = _extracted(hy[box], y[box], tuple(x - b.start for x, b in zip(k, box, strict=True)))
            if not found or found[0].sum() <= min_pixel or (found[0] > 0).sum() < min_pixel:
                continue
            a = found[0]
            trace, calcium = yield found[1]
            calcium = calcium if calcium.any() else np.maximum(trace, 0.0)
            done += 1
            free[box] &= a <= 0.5 * a.max()
            if inside[k]:
                on = a > 0
                rows.append((patch, int(pix[k]), round(float(v[k]), 6), pix[box][on].tolist(), a[on].tolist(), trace.tolist()))
            y[box] -= a[..., None] * calcium
            wide = tuple(slice(max(0, x - 2 * size), x + 2 * size + 1) for x in k)
            image = np.zeros(y.shape[:2])
            image[box] = a
            hy[wide] -= (I.filtered(image[wide][..., None], psf)[..., 0] if sigma else image[wide])[..., None] * calcium
            cn[wide] = I.neighbour_correlation(np.where(hy[wide] < 3 * sn[wide][..., None], 0.0, hy[wide]))
            pnr[wide] = hy[wide].max(-1) / np.where(sn[wide] > 0, sn[wide], np.inf)
        return rows

    columns, run = ["patch", "pix", "score", "pixels", "weights", "trace"], _side_by_side(seeded)
    rows = blocks.repartition("patch").sortWithinPartitions("patch")
    return rows.mapInPandas(lambda batches: run(batches, columns), "patch long, pix long, score double, pixels array<long>, weights array<double>, trace array<double>")


def seeds(blocks: DataFrame, radius: int, min_score: float, most: int | None = None) -> DataFrame:
    """Greedy seeding: (patch, rank, pix, score, trace).

    Takes the pixel of the best correlation with its neighbours times peak-to-noise ratio, explains the pixels within
    the radius by its trace, subtracts that, and looks again, until no score is min_score or, if it is given, `most`
    seeds are found. A seed in the halo belongs to another patch and is left out.
    """

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group, stack, r, c = _stack(group)
        pix, inside, left, rows = _grid(group, "pix", r, c, stack), _grid(group, "inside", r, c, stack), np.ones(stack.shape[:2], bool), []
        left[pix < 0] = False
        stack = stack - np.median(stack, -1, keepdims=True)
        for rank in range(1, (left.sum() if most is None else most) + 1):  # a pixel is a seed once at most
            sd = stack.std(-1)
            score = np.where(left, I.neighbour_correlation(stack) * stack.max(-1) / np.where(sd > 0, sd, np.inf), -np.inf)
            k = min(np.argwhere(score == score.max()).tolist(), key=lambda x: (x[1], x[0]))  # of equals the first down the columns
            if not score[*k] >= min_score:
                break
            left[*k] = False
            box = slice(max(0, k[0] - radius), k[0] + radius + 1), slice(max(0, k[1] - radius), k[1] + radius + 1)
            trace = stack[*k].copy()
            a = np.maximum(0.0, stack[box] @ trace / max(trace @ trace, 1e-300))
            stack[box] -= a[..., None] * trace
            if inside[*k]:
                rows.append((int(key[0]), rank, int(pix[*k]), round(float(score[*k]), 6), trace))
        return pd.DataFrame(rows, columns=["patch", "rank", "pix", "score", "trace"], dtype=None if rows else object)

    return blocks.groupBy("patch").applyInPandas(run, "patch long, rank int, pix long, score double, trace array<double>")


def ring_weights(blocks: DataFrame, inner: float, outer: float, ridge: float = 1e-5) -> DataFrame:
    """(patch, pix, nbr_pix, w): each inner pixel regressed on its ring with a small ridge, with an intercept."""

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group, y = _image(group)
        y = y - y.mean(1, keepdims=True)
        r, c, pix, out = group["r"].to_numpy(), group["c"].to_numpy(), group["pix"].to_numpy(), []
        for i in np.flatnonzero(group["inside"].to_numpy()):
            d = (r - r[i]) ** 2 + (c - c[i]) ** 2
            ring = np.flatnonzero((d >= inner * inner) & (d < outer * outer))
            if len(ring):
                x = np.vstack([y[ring], np.ones(y.shape[1])])
                g = x @ x.T
                w = np.linalg.solve(g + ridge * np.trace(g) * np.eye(len(g)), x @ y[i])[:-1]
                out += [(int(key[0]), int(pix[i]), int(q), round(float(v), 6)) for q, v in zip(pix[ring], w, strict=True)]
        return pd.DataFrame(out, columns=["patch", "pix", "nbr_pix", "w"])

    return blocks.groupBy("patch").applyInPandas(run, "patch long, pix long, nbr_pix long, w double")


def fitted_ring_weights(blocks: DataFrame, weights: DataFrame, clip: float | None = None, noise: DataFrame | None = None, most: int = 100, ridge: float = 1e-5) -> DataFrame:
    """(patch, pix, nbr_pix, w): the weights (pix, nbr_pix, w) of each pixel's neighbours fitted anew, where they were not 0.

    blocks: Y - A C by patch, with a halo that holds all neighbours. clip: a value over what the old weights say by so
    many deviations of the noise (pix, sn) counts as what they say; then, of a movie of over `most` frames a weight, only
    those with the fewest such values are used.
    """
    w = weights.select("pix", "nbr_pix", "w")
    w = w.join(blocks.where("inside").select("patch", "pix"), "pix")
    given = noise is not None
    if given:
        blocks = blocks.join(noise.select("pix", "sn"), "pix", "left")

    def run(key, group: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
        group, y = _image(group)
        y = y - y.mean(1, keepdims=True)
        place = {p: i for i, p in enumerate(group["pix"].tolist())}
        inside, rings, out = group["inside"].to_numpy(), {}, []
        for p, part in weights[weights["w"] != 0].groupby("pix"):
            at = [(q, place[q], v) for q, v in zip(part["nbr_pix"].tolist(), part["w"].tolist(), strict=True) if q in place]
            if at:
                rings[place[p]] = at
        x, frames = y.copy(), np.ones(y.shape[1], bool)
        if clip is not None:
            over = np.zeros(y.shape[1])
            sn = np.nan_to_num(group["sn"].to_numpy(float)) if given else K.noise_level(y)
            for i, ring in rings.items():
                told = np.array([v for _, _, v in ring]) @ y[[j for _, j, _ in ring]]
                high = y[i] > told + clip * sn[i]
                x[i] = np.where(high, told, y[i])
                over += high
            limit = most * max((len(r) for r in rings.values()), default=0)
            if limit < y.shape[1]:
                frames = over <= np.quantile(over, limit / y.shape[1], method="hazen")
        x = x[:, frames]
        for i, ring in rings.items():
            if inside[i]:
                z = np.vstack([x[[j for _, j, _ in ring]], np.ones(x.shape[1])])
                g = z @ z.T
                fit = np.linalg.solve(g + max(ridge * np.trace(g), 1e-300) * np.eye(len(g)), z @ x[i])[:-1]
                out += [(int(key[0]), int(group["pix"].iloc[i]), int(q), float(v)) for (q, _, _), v in zip(ring, fit, strict=True)]
        return pd.DataFrame(out, columns=["patch", "pix", "nbr_pix", "w"])

    return blocks.groupBy("patch").cogroup(apart(w).groupBy("patch")).applyInPandas(run, "patch long, pix long, nbr_pix long, w double")


def ring_product(blocks: DataFrame, weights: DataFrame) -> DataFrame:
    """(pix, b): W (Y - mean) + mean for weights (pix, nbr_pix, w) and blocks whose halo holds all neighbours.

    The movie is dealt to patches once; a join of traces on nbr_pix would send each of them once for every neighbour.
    Pixels without weights keep their mean.
    """
    w = weights.select("pix", "nbr_pix", "w").join(blocks.where("inside").select("patch", "pix"), "pix")

    def run(key, group: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
        group, y = _image(group)
        mean = y.mean(1, keepdims=True)
        y = y - mean
        pix, inside = group["pix"].to_numpy(), group["inside"].to_numpy()
        place, b = {p: i for i, p in enumerate(pix.tolist())}, np.repeat(mean, y.shape[1], 1)
        for p, part in weights.groupby("pix"):
            at = [(place[q], v) for q, v in zip(part["nbr_pix"].tolist(), part["w"].tolist(), strict=True) if q in place]
            b[place[p]] += np.array([v for _, v in at]) @ y[[j for j, _ in at]] if at else 0.0
        return pd.DataFrame({"pix": pix[inside], "b": pd.Series(list(b[inside]), dtype=object)})

    return blocks.groupBy("patch").cogroup(apart(w).groupBy("patch")).applyInPandas(run, "pix long, b array<double>")


def known_background(blocks: DataFrame, footprints: DataFrame, background: DataFrame, method: str = "svd", rounds: int = 10) -> DataFrame:
    """(pix, b): the background of known spatial components, their traces fitted together with those of the footprints.

    blocks: without halo; footprints (neuron, pix, val); background (pix, j, val) of each patch. method: svd, by least
    squares about the pixels' means, which are part of the background, or nmf, by non-negative descent on the values.
    """
    rows = blocks.select("patch", "pix")
    parts = footprints.select(F.lit(0).alias("kind"), F.col("neuron").cast("long").alias("k"), "pix", "val").unionByName(background.select(F.lit(1).alias("kind"), F.col("j").cast("long").alias("k"), "pix", "val")).join(rows, "pix")

    def run(key, group: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        group, y = _image(group)
        pix = group["pix"].to_numpy()
        place = {p: i for i, p in enumerate(pix.tolist())}
        mean = y.mean(1, keepdims=True) if method == "svd" else np.zeros((len(y), 1))
        names = sorted(set(zip(parts["kind"].tolist(), parts["k"].tolist(), strict=True)))
        a = np.zeros((len(y), len(names)))
        at = {n: i for i, n in enumerate(names)}
        for kind, k, p, v in zip(parts["kind"].tolist(), parts["k"].tolist(), parts["pix"].tolist(), parts["val"].tolist(), strict=True):
            a[place[p], at[kind, k]] = v
        back = np.array([kind == 1 for kind, _ in names], bool)
        if method == "svd":
            c = np.linalg.lstsq(a.T @ a, a.T @ (y - mean), rcond=None)[0] if len(names) else np.zeros((0, y.shape[1]))
        else:
            c = K.hals(a.T @ y, a.T @ a, np.zeros((len(names), y.shape[1])), rounds)
        return pd.DataFrame({"pix": pix, "b": pd.Series(list(a[:, back] @ c[back] + mean), dtype=object)})

    return blocks.groupBy("patch").cogroup(apart(parts).groupBy("patch")).applyInPandas(run, "pix long, b array<double>")


def neighbour_weights(blocks: DataFrame, inner: float, outer: float, gamma: float = 1e-3) -> DataFrame:
    """(patch, pix, nbr_pix, w): each inner pixel as a mean of its ring's pixels with weights that add up to 1 (locally linear)."""

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group, y = _image(group)
        r, c, pix, out = group["r"].to_numpy(), group["c"].to_numpy(), group["pix"].to_numpy(), []
        for i in np.flatnonzero(group["inside"].to_numpy()):
            d = (r - r[i]) ** 2 + (c - c[i]) ** 2
            ring = np.flatnonzero((d >= inner * inner) & (d < outer * outer))
            if len(ring):
                z = y[ring] - y[i]
                g = z @ z.T
                w = np.linalg.solve(g + max(gamma * np.trace(g), 1e-300) * np.eye(len(g)), np.ones(len(g)))
                out += [(int(key[0]), int(pix[i]), int(q), round(float(v), 6)) for q, v in zip(pix[ring], w / w.sum(), strict=True)]
        return pd.DataFrame(out, columns=["patch", "pix", "nbr_pix", "w"])

    return blocks.groupBy("patch").applyInPandas(run, "patch long, pix long, nbr_pix long, w double")


def rank_one_sources(blocks: DataFrame, sigma: float, size: int, k: int, score: str = "energy", rounds: int = 5) -> DataFrame:
    """k sources of each patch: (patch, rank, pix, pixels, weights, trace), those whose seed is in the patch.

    The movie is blurred by a Gaussian; where it has most energy (or, by score "corr", where peak-to-noise ratio times
    local correlation is largest), the box around is explained by one non-negative footprint and a trace, by turns, and
    taken off.
    """
    x = np.arange(2 * int(np.ceil(2 * sigma)) + 1) - int(np.ceil(2 * sigma))
    g = np.exp(-(x[:, None] ** 2 + x**2) / (2 * sigma**2))
    g /= np.sqrt((g**2).sum())

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group, y, r, c = _stack(group)
        pix, inside, rows = _grid(group, "pix", r, c, y), _grid(group, "inside", r, c, y), []
        y -= np.median(y, -1, keepdims=True)
        free = pix >= 0
        for rank in range(1, min(k, int(free.sum())) + 1):
            blurred = I.filtered(y, g)
            if score == "corr":
                sn = K.noise_level(y.reshape(-1, y.shape[-1])).reshape(y.shape[:2])
                v = I.neighbour_correlation(y) * y.max(-1) / np.where(sn > 0, sn, np.inf)
            else:
                v = (blurred**2).sum(-1)
            at = tuple(np.unravel_index(np.argmax(np.where(free, v, -np.inf)), v.shape))
            free[at] = False
            box = tuple(slice(max(0, p - size), p + size + 1) for p in at)
            trace = blurred[at]
            for _ in range(rounds):
                a = np.maximum(0.0, y[box] @ trace / max(trace @ trace, 1e-300))
                trace = np.tensordot(a, y[box], 2) / max((a * a).sum(), 1e-300)
            y[box] -= a[..., None] * trace
            if inside[at]:
                on = a > 0
                rows.append((int(key[0]), rank, int(pix[at]), pix[box][on].tolist(), a[on].tolist(), trace.tolist()))
        return pd.DataFrame(rows, columns=["patch", "rank", "pix", "pixels", "weights", "trace"], dtype=None if rows else object)

    return blocks.groupBy("patch").applyInPandas(run, "patch long, rank int, pix long, pixels array<long>, weights array<double>, trace array<double>")


def ring_background(blocks: DataFrame, inner: float, outer: float, ridge: float = 1e-5, clip: float | None = None) -> DataFrame:
    """(pix, b): each inner pixel's trace as its ring tells it, about its own mean.

    clip: frames in which a pixel is over its ring's mean by so many deviations count as that mean in the regression.
    """

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group, y = _image(group)
        mean = y.mean(1, keepdims=True)
        y = y - mean
        r, c, out = group["r"].to_numpy(), group["c"].to_numpy(), []
        inside = np.flatnonzero(group["inside"].to_numpy())
        for i in inside:
            d = (r - r[i]) ** 2 + (c - c[i]) ** 2
            ring = np.flatnonzero((d >= inner * inner) & (d < outer * outer))
            if not len(ring):
                out.append(np.full(y.shape[1], mean[i, 0]))
                continue
            x, target = np.vstack([y[ring], np.ones(y.shape[1])]), y[i]
            if clip is not None:
                around = y[ring].mean(0)
                target = np.where(target - around > clip * np.std(target - around), around, target)
            g = x @ x.T
            w = np.linalg.solve(g + max(ridge * np.trace(g), 1e-300) * np.eye(len(g)), x @ target)[:-1]
            out.append(w @ y[ring] + mean[i, 0])
        return pd.DataFrame({"pix": group["pix"].to_numpy()[inside], "b": pd.Series(out, dtype=object)})

    return blocks.groupBy("patch").applyInPandas(run, "pix long, b array<double>")


def low_rank(blocks: DataFrame, rank: int, method: str = "svd") -> DataFrame:
    """(patch, pix, share, b): what a patch's leading components say of an inner pixel, and their share of its variance.

    method: svd about the pixels' means, or nmf by multiplicative updates that begin with a seed of the patch.
    """

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group, y = _image(group)
        mean = y.mean(1, keepdims=True)
        z = y - mean
        if rank <= 0:
            b = np.repeat(mean, y.shape[1], 1)
        elif method == "nmf":
            w, h = _multiplied(y, rank, int(key[0]))
            b = w @ h
        else:
            _, vectors = np.linalg.eigh(z @ z.T if len(z) <= z.shape[1] else z.T @ z)
            top = vectors[:, -rank:]
            b = (top @ (top.T @ z) if len(z) <= z.shape[1] else (z @ top) @ top.T) + mean
        share = 1 - ((y - b) ** 2).sum(1) / np.maximum((z**2).sum(1), 1e-300)
        inside = group["inside"].to_numpy()
        return pd.DataFrame({"patch": int(key[0]), "pix": group["pix"].to_numpy()[inside], "share": np.round(share[inside], 6), "b": pd.Series(list(b[inside]), dtype=object)})

    return blocks.groupBy("patch").applyInPandas(run, "patch long, pix long, share double, b array<double>")


def _multiplied(data: np.ndarray, rank: int, seed: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative factors of data by multiplicative updates."""
    data, rng = np.maximum(data, 0.0), np.random.default_rng(seed)
    w, h = rng.random((len(data), rank)) + 0.1, rng.random((rank, data.shape[1])) + 0.1
    for _ in range(rounds):
        h *= (w.T @ data) / np.maximum(w.T @ w @ h, 1e-12)
        w *= (data @ h.T) / np.maximum(w @ (h @ h.T), 1e-12)
    return w, h


def factors(blocks: DataFrame, rank: int) -> DataFrame:
    """(patch, k, pixels, weights, trace): the non-negative factors of each patch; k is patch * rank + which."""

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group, y = _image(group)
        w, h = _multiplied(y, rank, int(key[0]))
        rows = [(int(key[0]), int(key[0]) * rank + j, group["pix"].tolist(), w[:, j].tolist(), h[j].tolist()) for j in range(rank)]
        return pd.DataFrame(rows, columns=["patch", "k", "pixels", "weights", "trace"])

    return blocks.groupBy("patch").applyInPandas(run, "patch long, k long, pixels array<long>, weights array<double>, trace array<double>")


def low_rank_background(blocks: DataFrame, rank: int) -> DataFrame:
    """(patch, pix, share): how much of an inner pixel's variance the patch's leading components hold."""
    return low_rank(blocks, rank).drop("b")


def spatial_update(sums: DataFrame, gram: DataFrame, method: str = "nnls", most: int | None = 5, noise: DataFrame | None = None, start: DataFrame | None = None) -> DataFrame:
    """Non-negative footprints pixel by pixel: (pix, label, a) from U (pix, label, u) and V (a, b, v).

    A pixel gets the part of V that its own labels have, by a join on label pairs. method: nnls (at most `most` labels a
    pixel), clamped (least squares, with what is below 0 set to 0), hals (sweeps from `start` (pix, label, a), or from 0),
    or nnls or hals with _thresh, by which weights under three
    deviations of the noise (pix, sn) over the root of V's diagonal become 0; lars adds labels until the residual energy
    is within the noise, noise then being (pix, sn, energy, frames).
    """
    mine = sums.select("pix", F.col("label").alias("a"), "u")
    pairs = mine.join(sums.select("pix", F.col("label").alias("b")), "pix").join(gram, ["a", "b"])
    rows = pairs.groupBy("pix", F.col("a").alias("label")).agg(F.first("u").alias("u"), F.sort_array(F.collect_list(F.struct("b", "v"))).alias("row"))
    if start is not None:
        rows = rows.join(start.select("pix", "label", F.col("a").alias("a0")), ["pix", "label"], "left")
    rows = rows.withColumn("a0", F.coalesce("a0", F.lit(0.0)) if start is not None else F.lit(0.0))
    wide = rows.groupBy("pix").agg(F.sort_array(F.collect_list(F.struct("label", "u", F.transform("row", lambda x: x["v"]).alias("v"), "a0"))).alias("x"))
    if noise is not None:
        wide = wide.join(noise, "pix", "left")
    extra = [c for c in ("sn", "energy", "frames") if c in wide.columns]

    @F.pandas_udf("array<double>")
    def solve(x: pd.Series, *more: pd.Series) -> pd.Series:
        out = []
        for i, items in enumerate(x):
            u, v = np.array([e["u"] for e in items], float), np.array([e["v"] for e in items], float)
            given = {c: float(m.iloc[i]) for c, m in zip(extra, more, strict=True)}
            if method == "lars":
                for k in range(1, len(u) + 1):
                    a = K.nnls(v, u, 1e-9, k)
                    if given["energy"] - 2 * a @ u + a @ v @ a <= given["sn"] ** 2 * given["frames"]:
                        break
            elif method == "clamped":
                a = np.maximum(np.linalg.lstsq(v, u, rcond=None)[0], 0.0)
            elif method.startswith("hals"):
                a = K.hals(u[:, None], v, np.array([[e["a0"]] for e in items], float))[:, 0]
            else:
                a = K.nnls(v, u, 1e-9, most)
            if method.endswith("_thresh"):
                a[a < 3 * given.get("sn", 0.0) / np.sqrt(np.maximum(np.diag(v), 1e-300))] = 0
            out.append(np.round(a, 6))
        return pd.Series(out)

    solved = wide.select("pix", F.arrays_zip(F.transform("x", lambda e: e["label"]).alias("label"), solve("x", *extra).alias("a")).alias("z"))
    return solved.select("pix", F.inline("z")).where("a > 0")


def _descended(group: pd.DataFrame, names: np.ndarray, traces: np.ndarray, mask: np.ndarray, rounds: int) -> pd.DataFrame:
    """(pix, label, a) of a patch's pixels, with labels and starts in their rows; mask: where a name (a row) may be."""
    pix, c, y = group["pix"].to_numpy(), traces - traces.mean(1, keepdims=True), np.vstack(group["y"].to_list())
    y = y - y.mean(1, keepdims=True)
    x = np.zeros(mask.shape)
    sizes = [0 if labels is None else len(labels) for labels in group["labels"]]
    if any(sizes):
        label, value = (np.concatenate([v for v, n in zip(group[k], sizes, strict=True) if n]) for k in ("labels", "starts"))
        i, at = np.repeat(np.arange(len(pix)), sizes), np.minimum(np.searchsorted(names, label), len(names) - 1)
        given = (names[at] == label) & mask[at, i]
        x[at[given], i[given]] = value[given]
    a = np.round(K.hals(c @ y.T, c @ c.T, x, rounds, mask), 6)
    k, i = np.nonzero(a > 0)
    return pd.DataFrame({"pix": pix[i], "label": names[k], "a": a[k, i]})


def _started(pixels: DataFrame, start: DataFrame, height: int, size: int) -> DataFrame:
    """(patch, pix, r, c, y, labels, starts): the pixels with the weights that they begin with."""
    own = start.groupBy("pix").agg(F.collect_list(F.struct(F.col("label").cast("long").alias("label"), "a")).alias("own"))
    return pixels.join(own, "pix", "left").select("pix", patch_of(F.col("r"), F.col("c"), height, size).alias("patch"), "r", "c", "y", F.col("own.label").alias("labels"), F.col("own.a").alias("starts"))


def spatial_descent(pixels: DataFrame, region: DataFrame, traces: DataFrame, start: DataFrame, height: int, size: int, rounds: int = 3) -> DataFrame:
    """spatial_update by hals with the sums and Gram matrix of each patch formed in place: (pix, label, a).

    pixels: (pix, r, c, y), region: (pix, label), traces: (label, trace), start: (pix, label, a). Where many regions meet in
    a pixel, rows for the pairs of its labels grow with their square; a patch needs each of its traces once.
    """
    where = pixels.select("pix", patch_of(F.col("r"), F.col("c"), height, size).alias("patch"))
    there = region.join(where, "pix").groupBy("patch", "label").agg(F.collect_list("pix").alias("pixels"))
    there = there.join(traces.select("label", "trace"), "label").select("patch", F.col("label").cast("long").alias("label"), "trace", "pixels")

    def run(key, group: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("label")
        if not len(group) or not len(parts):
            return pd.DataFrame({"pix": [], "label": [], "a": []}, dtype=object)
        mask = np.array([np.isin(group["pix"].to_numpy(), pixels) for pixels in parts["pixels"]])
        return _descended(group, parts["label"].to_numpy(), np.vstack(parts["trace"].to_list()), mask, rounds)

    rows = _started(pixels, start, height, size)
    return rows.groupBy("patch").cogroup(apart(there).groupBy("patch")).applyInPandas(run, "pix long, label long, a double")


def spatial_descent_in_ellipses(pixels: DataFrame, ellipses: DataFrame, dist: float, traces: DataFrame, start: DataFrame, height: int, size: int, rounds: int = 3) -> DataFrame:
    """spatial_descent with each label's region given by its ellipse (label, cr, cc, a, b, angle), dist times as large.

    A patch gets the ellipses that may reach it, a row each, and no row for each of their pixels.
    """
    reach = F.greatest(F.col("a"), F.col("b")) * dist + 1
    side = lambda x: F.explode(F.sequence(F.floor((F.col(x) - reach) / size), F.floor((F.col(x) + reach) / size)))
    rows = -(-height // size)
    there = ellipses.withColumn("pr", side("cr")).where(F.col("pr").between(0, rows - 1)).withColumn("pc", side("cc")).where("pc >= 0")
    there = there.select((F.col("pc") * rows + F.col("pr")).alias("patch"), F.col("label").cast("long").alias("label"), "cr", "cc", "a", "b", "angle").join(traces.select("label", "trace"), "label")

    def run(key, group: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(parts):
            return pd.DataFrame({"pix": [], "label": [], "a": []}, dtype=object)
        parts = parts.sort_values("label")
        cr, cc, a, b, angle = parts[["cr", "cc", "a", "b", "angle"]].to_numpy(float).T[:, :, None]
        r, c = group["r"].to_numpy() - cr, group["c"].to_numpy() - cc
        along, across = r * np.cos(angle) + c * np.sin(angle), c * np.cos(angle) - r * np.sin(angle)
        mask = (along / a) ** 2 + (across / b) ** 2 <= dist * dist
        some = mask.any(1)
        if not some.any():
            return pd.DataFrame({"pix": [], "label": [], "a": []}, dtype=object)
        return _descended(group, parts["label"].to_numpy()[some], np.vstack(parts["trace"][some].to_list()), mask[some], rounds)

    movie = _started(pixels, start, height, size)
    return movie.groupBy("patch").cogroup(apart(there).groupBy("patch")).applyInPandas(run, "pix long, label long, a double")


def temporal_update(members: DataFrame, rounds: int = 3, deconvolve: bool = False) -> DataFrame:
    """(neuron, weight, trace): traces by coordinate descent, patch by patch; weight is the footprint's energy there.

    members: rows of a patch, its pixels (patch, pix, y) and its components (patch, neuron, pixels, weights, trace), the
    columns of the other kind being null.
    """

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        parts, rows = group[group["neuron"].notna()].sort_values("neuron"), group[group["pix"].notna()]
        place = {int(p): i for i, p in enumerate(rows["pix"])}
        if not len(parts) or not len(place):
            return pd.DataFrame({"neuron": [], "weight": [], "trace": []}, dtype=object)
        a = np.zeros((len(place), len(parts)))
        for k, (pixels, weights) in enumerate(zip(parts["pixels"], parts["weights"], strict=True)):
            for p, w in zip(pixels, weights, strict=True):
                if int(p) in place:
                    a[place[int(p)], k] = w
        y, c = np.vstack(rows["y"].to_list()), np.nan_to_num(np.vstack(parts["trace"].to_list()))
        u, v = a.T @ y, a.T @ a
        for _ in range(rounds):
            for k in np.flatnonzero(np.diag(v) > 0):
                raw = c[k] + (u[k] - v[k] @ c) / v[k, k]
                if deconvolve:
                    raw -= raw[raw < np.median(raw)].mean() if (raw < np.median(raw)).any() else 0.0
                    c[k] = K.deconvolve_ar1(raw)["c"]
                else:
                    c[k] = raw - raw.min()
        raw = c + (u - v @ c) / np.maximum(np.diag(v), 1e-300)[:, None]
        return pd.DataFrame({"neuron": parts["neuron"].astype("int64").to_list(), "weight": np.diag(v), "trace": pd.Series(list(raw), dtype=object)})

    return members.groupBy("patch").applyInPandas(run, "neuron long, weight double, trace array<double>")


def shaped(footprints: DataFrame, method: str = "convex", share: float = 0.99) -> DataFrame:
    """(neuron, pix, val) of each footprint in order: connected with its peak, convex, or the region of most energy.

    footprints: (neuron, pix, r, c, val). One footprint's rectangle is the unit of work.
    """
    kinds = {"connected": lambda x: I.connected(x), "convex": lambda x: I.convex(I.connected(x)), "energy": lambda x: I.most_energy(x, share)}

    def run(batches):
        for neuron, group in _whole(batches, "neuron"):
            r, c, pix = (group[k].to_numpy() for k in ("r", "c", "pix"))
            r, c = r - r.min(), c - c.min()
            image = np.zeros((int(r.max()) + 1, int(c.max()) + 1))
            image[r, c] = group["val"]
            out = kinds[method](image)[r, c]
            on = out > 0
            yield pd.DataFrame({"neuron": np.full(int(on.sum()), int(neuron)), "pix": pix[on], "val": out[on]})

    return footprints.repartition("neuron").sortWithinPartitions("neuron").mapInPandas(run, "neuron long, pix long, val double")
