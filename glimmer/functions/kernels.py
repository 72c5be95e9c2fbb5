"""Small numpy kernels for one trace or one patch; Spark deals the traces and patches to tasks."""

from __future__ import annotations

from functools import lru_cache
from statistics import NormalDist

import numpy as np


def welch_density(y: np.ndarray, segments: int = 8, size: int | None = None, points: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density of the rows of y over half-overlapping Hamming windows, by frequency in cycles a sample."""
    y = np.atleast_2d(np.asarray(y, float))
    size = max(int(2 * y.shape[1] / (segments + 1)) if size is None else size, 2)
    step = max(size - size // 2, 1)
    window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(size) / (size - 1))
    n = points or max(256, 1 << (size - 1).bit_length())
    starts = range(0, y.shape[1] - size + 1, step)
    power = sum(np.abs(np.fft.rfft(y[:, a : a + size] * window, n)) ** 2 for a in starts) / len(starts) / (window @ window)
    power[:, 1:-1] *= 2
    return np.fft.rfftfreq(n), power


def noise_level(y: np.ndarray, band: tuple[float, float] = (0.25, 0.5), method: str = "logmexp") -> np.ndarray:
    """Standard deviation of the noise of each row, from the power in the band."""
    f, power = welch_density(y)
    half = power[:, (f >= band[0]) & (f <= band[1])] / 2
    if method == "mean":
        return np.sqrt(half.mean(1))
    if method == "median":
        return np.sqrt(np.median(half, 1))
    return np.sqrt(np.exp(np.log(np.maximum(half, 1e-300)).mean(1)))


def short_window_noise(y: np.ndarray, band: tuple[float, float] = (0.25, 0.5)) -> np.ndarray:
    """As noise_level, from windows of an eighth of the trace and 1000 points; the band is open below."""
    f, power = welch_density(y, size=max(round(np.shape(y)[-1] / 8), 2), points=max(1000, round(np.shape(y)[-1] / 8)))
    half = power[:, (f > band[0]) & (f <= band[1])] / 2
    return np.sqrt(np.exp(np.log(np.maximum(half, 1e-300)).mean(1)))


def periodogram_noise(y: np.ndarray, band: tuple[float, float] = (0.25, 0.5)) -> np.ndarray:
    """As noise_level, from one plain periodogram; the band is open below."""
    y = np.atleast_2d(np.asarray(y, float))
    n = y.shape[1]
    f = np.fft.rfftfreq(n)
    power = np.abs(np.fft.rfft(y)) ** 2 / n
    power[:, 1 : (n + 1) // 2] *= 2
    half = power[:, (f > band[0]) & (f <= band[1])] / 2
    return np.sqrt(np.exp(np.log(np.maximum(half, 1e-300)).mean(1)))


def histogram_baseline(y: np.ndarray, rounds: int = 3) -> tuple[float, float]:
    """(baseline, noise): a Gaussian fitted to the main peak of the histogram, by a parabola on its logarithm."""
    y = np.asarray(y, float)
    deciles = np.quantile(y, np.arange(1, 10) / 10, method="hazen")
    width = max(np.min(np.diff(deciles)) / 3, np.ptp(y) / 1000)
    if not width > 0:
        return float(np.median(y)), 0.0
    edges = np.arange(y.min() - width / 2, y.max() + width, width)
    count, _ = np.histogram(y, edges)
    x = (edges[:-1] + edges[1:]) / 2
    keep = count > 0.3 * count.max()
    mean, sd = float(np.median(y)), float(np.std(y))
    for _ in range(rounds):
        if keep.sum() < 3:
            break
        p = np.polyfit(x[keep], np.log(count[keep]), 2, w=count[keep])
        if p[0] >= 0:
            break
        mean, sd = float(-p[1] / (2 * p[0])), float(np.sqrt(-0.5 / p[0]))
        keep = (count > 0) & (np.abs(x - mean) <= 1.5 * sd)
    return mean, sd


def histogram_baselines(y: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """histogram_baseline of each row of y: (baselines, noises), the parabolas of all rows together."""
    y = np.asarray(y, float)
    deciles = np.quantile(y, np.arange(1, 10) / 10, axis=1, method="hazen")
    low, high = y.min(1), y.max(1)
    width = np.maximum(np.diff(deciles, axis=0).min(0) / 3, (high - low) / 1000)
    mean, sd = np.median(y, 1), np.std(y, axis=1)
    sd[~(width > 0)] = 0.0
    left = np.flatnonzero(width > 0)
    if not len(left):
        return mean, sd
    edges = [np.arange(a - w / 2, b + w, w) for a, b, w in zip(low[left], high[left], width[left], strict=True)]
    m = max(map(len, edges)) - 1
    count, x = np.zeros((len(left), m)), np.zeros((len(left), m))
    for i, (k, e) in enumerate(zip(left, edges, strict=True)):
        at = np.searchsorted(e, y[k], "right") - 1
        at[y[k] == e[-1]] = len(e) - 2
        count[i, : len(e) - 1], x[i, : len(e) - 1] = np.bincount(at, minlength=len(e))[: len(e) - 1], (e[:-1] + e[1:]) / 2
    keep, scale = count > 0.3 * count.max(1, keepdims=True), np.maximum(high - low, 1e-300)[left, None]
    u, logs = (x - mean[left, None]) / scale, np.log(np.maximum(count, 1.0))
    powers = u[None] ** np.arange(5)[:, None, None]
    for _ in range(rounds):
        more = keep.sum(1) >= 3
        left, keep, count, x, u, logs, powers, scale = left[more], keep[more], count[more], x[more], u[more], logs[more], powers[:, more], scale[more]
        if not len(left):
            break
        w = np.where(keep, count, 0.0) ** 2
        sums, right = (powers * w).sum(2), (powers[:3] * (w * logs)).sum(2)
        p = np.linalg.solve(sums[np.arange(3)[:, None] + np.arange(3)].transpose(2, 0, 1), right.T[:, :, None])[:, :, 0]
        down = p[:, 2] < 0
        left, keep, count, x, u, logs, powers, scale, p = left[down], keep[down], count[down], x[down], u[down], logs[down], powers[:, down], scale[down], p[down]
        middle = np.median(y[left], 1)
        mean[left], sd[left] = middle - scale[:, 0] * p[:, 1] / (2 * p[:, 2]), scale[:, 0] * np.sqrt(-0.5 / p[:, 2])
        keep = (count > 0) & (np.abs(x - mean[left, None]) <= 1.5 * sd[left, None])
    return mean, sd


def density_mode(y: np.ndarray, points: int = 1 << 10) -> tuple[float, float]:
    """(mode, bandwidth) of a Gaussian kernel density, the bandwidth by the fixed point of Botev, Grotowski and Kroese (2010)."""
    y = np.asarray(y, float)
    span = np.ptp(y)
    if not span > 0:
        return float(y[0]), 0.0
    low, width = y.min() - span / 10, 1.2 * span
    n = len(np.unique(y))
    count = np.histogram(y, np.linspace(low, low + width, points + 1))[0] / len(y)
    # Cosine transform of the histogram, by the transform of it and its mirror image.
    k = np.arange(points)
    a = np.real(np.exp(-0.5j * np.pi * k / points) * np.fft.fft(np.concatenate([count, count[::-1]]))[:points])
    i2, a2 = k[1:].astype(float) ** 2, (a[1:] / 2) ** 2

    def step(t: float) -> float:
        f = 2 * np.pi**14 * np.sum(i2**7 * a2 * np.exp(-i2 * np.pi**2 * t))
        for s in range(6, 1, -1):
            k0 = np.prod(np.arange(1, 2 * s, 2)) / np.sqrt(2 * np.pi)
            time = (2 * (1 + 0.5 ** (s + 0.5)) / 3 * k0 / (n * f)) ** (2 / (3 + 2 * s))
            f = 2 * np.pi ** (2 * s) * np.sum(i2**s * a2 * np.exp(-i2 * np.pi**2 * time))
        return (2 * n * np.sqrt(np.pi) * f) ** -0.4

    grid = np.geomspace(1e-7, 0.1, 60)
    value = np.array([t - step(t) for t in grid])
    at = np.flatnonzero((value[:-1] < 0) & (value[1:] >= 0))
    t = 0.28 * n**-0.4 if not len(at) else _crossing(lambda x: x - step(x), grid[at[0]], grid[at[0] + 1])
    smooth = np.fft.irfft(np.fft.rfft(np.concatenate([count, count[::-1]])) * np.exp(-(np.arange(points + 1) ** 2) * np.pi**2 * t / 2))[:points]
    return float(low + (np.argmax(smooth) + 0.5) * width / points), float(np.sqrt(t) * width)


def _crossing(f, low: float, high: float) -> float:
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def density_modes(traces: list[np.ndarray], points: int = 1 << 10) -> list[tuple[float, float]]:
    """density_mode of each trace: the sums of all traces together, each as far as its terms are not lost in rounding."""
    out: list[tuple[float, float] | None] = [(float(y[0]), 0.0) if not np.ptp(y) > 0 else None for y in traces]
    live = [i for i, found in enumerate(out) if found is None]
    for a in range(0, len(live), 256):
        rows = live[a : a + 256]
        for i, found in zip(rows, _modes_together([np.asarray(traces[i], float) for i in rows], points), strict=True):
            out[i] = found
    return out


def _modes_together(traces: list[np.ndarray], points: int) -> list[tuple[float, float]]:
    span = np.array([np.ptp(y) for y in traces])
    low, width = np.array([y.min() for y in traces]) - span / 10, 1.2 * span
    n = np.array([len(np.unique(y)) for y in traces], float)
    count = np.array([np.histogram(y, np.linspace(at, at + w, points + 1))[0] / len(y) for y, at, w in zip(traces, low, width, strict=True)])
    both, k = np.concatenate([count, count[:, ::-1]], 1), np.arange(points)
    a = np.real(np.exp(-0.5j * np.pi * k / points) * np.fft.fft(both)[:, :points])
    i2 = k[1:].astype(float) ** 2
    a2 = (a[:, 1:] / 2) ** 2
    weights = {s: i2**s * a2 for s in range(2, 8)}
    grid = np.geomspace(1e-7, 0.1, 60)
    on_grid = weights[7] @ np.exp(-np.pi**2 * grid * i2[:, None])

    def sums(rows: np.ndarray, s: int, t: np.ndarray) -> np.ndarray:
        """The sum of i ** 2s a2 exp(-(pi i) ** 2 t); terms whose exponent is over 80 are lost in rounding."""
        with np.errstate(divide="ignore"):
            terms = np.minimum(np.sqrt(80 / np.pi**2 / t) + 1, len(i2))
        out = np.empty(len(rows))
        size = 1 << np.ceil(np.log2(np.maximum(terms, 8))).astype(int)
        for m in np.unique(size):
            j = np.flatnonzero(size == m)
            out[j] = np.einsum("ij,ij->i", weights[s][rows[j], :m], np.exp(-np.pi**2 * t[j, None] * i2[:m]))
        return out

    def gap(rows: np.ndarray, t: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        f = 2 * np.pi**14 * (sums(rows, 7, t) if first is None else first)
        for s in range(6, 1, -1):
            k0 = np.prod(np.arange(1, 2 * s, 2)) / np.sqrt(2 * np.pi)
            time = (2 * (1 + 0.5 ** (s + 0.5)) / 3 * k0 / (n[rows] * f)) ** (2 / (3 + 2 * s))
            f = 2 * np.pi ** (2 * s) * sums(rows, s, time)
        return t - (2 * n[rows] * np.sqrt(np.pi) * f) ** -0.4

    t, left, last = 0.28 * n**-0.4, np.arange(len(n)), np.full(len(n), np.inf)
    first, ends = np.full(len(n), np.nan), np.full(len(n), np.nan)
    for j, end in enumerate(grid):
        value = gap(left, np.full(len(left), end), on_grid[left, j])
        hit = (last[left] < 0) & (value >= 0)
        first[left[hit]], ends[left[hit]], last[left] = grid[j - 1], end, value
        left = left[~hit]
    crossed = np.flatnonzero(~np.isnan(first))
    bottom, top = first[crossed], ends[crossed]
    open_ = np.arange(len(crossed))
    for k in range(100):
        if not len(open_):
            break
        # Halvings, and then by turns secants of both ends and halvings.
        x, y = bottom[open_], top[open_]
        mid = (x + y) / 2
        if k == 8:
            at_bottom, at_top = gap(crossed, bottom), gap(crossed, top)
        if k >= 8 and k % 4 != 3:
            u, v = at_bottom[open_], at_top[open_]
            secant = (x * v - y * u) / np.where(v > u, v - u, 1.0)
            # A little to the far side, so that the nearer end moves up to the crossing as well.
            aside = np.where(k % 2, 1, -1) * 1e-4 * (y - x) if k % 4 else 0.0
            mid = np.clip(secant + aside, x + 1e-17, y - 1e-17)
        value = gap(crossed[open_], mid)
        under = value < 0
        bottom[open_], top[open_] = np.where(under, mid, x), np.where(under, y, mid)
        if k >= 8:
            at_bottom[open_], at_top[open_] = np.where(under, value, at_bottom[open_]), np.where(under, at_top[open_], value)
        open_ = open_[top[open_] - bottom[open_] > 4e-15 * top[open_]]
    t[crossed] = (bottom + top) / 2
    smooth = np.fft.irfft(np.fft.rfft(both) * np.exp(-(np.arange(points + 1) ** 2) * np.pi**2 * t[:, None] / 2))[:, :points]
    return [(float(x), float(y)) for x, y in zip(low + (np.argmax(smooth, 1) + 0.5) * width / points, np.sqrt(t) * width, strict=True)]


# What roots above 1 and below 0 become, and the order from which on there is no model.
ROOT_ABOVE, ROOT_BELOW, NO_ORDER = 0.95, 0.15, 5
# End of fixed values.


def ar_coefficients(y: np.ndarray, p: int, sn: float, lags: int = 5, fudge: float = 1.0) -> np.ndarray:
    """AR(p) coefficients by the Yule-Walker equations with the noise taken off lag 0.

    With an unstable root the order goes up by one, and from NO_ORDER on there is no model (0). Of complex roots the real
    part counts.
    """
    y = np.asarray(y, float) - np.mean(y)
    for order in range(p, NO_ORDER):
        lags += order
        ac = np.array([y[k:] @ y[: max(len(y) - k, 0)] / len(y) for k in range(lags + 1)])
        a = ac[np.abs(np.arange(lags)[:, None] - np.arange(order))] - sn**2 * np.eye(lags, order)
        if order == 1:  # a root is the coefficient itself
            roots = np.array([a[:, 0] @ ac[1:] / max(a[:, 0] @ a[:, 0], 1e-300)])
        else:
            roots = np.roots(np.concatenate([[1.0], -(np.linalg.pinv(a) @ ac[1:])]))
        if (np.abs(roots) <= 1).all():
            roots = np.real(roots)
            roots = np.where(roots > 1, ROOT_ABOVE, np.where(roots < 0, ROOT_BELOW, roots))
            return -np.poly(fudge * roots)[1:]
    return np.zeros(1)


def ar_kernel(g: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(n)
    h[0] = 1.0
    for i in range(1, n):
        h[i] = sum(g[k] * h[i - 1 - k] for k in range(min(len(g), i)))
    return h


def smallest_spike(g: np.ndarray, sn: float, p: float = 0.9999, n: int = 200) -> float:
    """A spike under this size is noise with probability p."""
    return sn / np.linalg.norm(ar_kernel(np.atleast_1d(g), n)) * NormalDist().inv_cdf(p)


@lru_cache(16)
def _powers(g: float, n: int) -> list[float]:
    return [g**i for i in range(n + 1)]


def pools_ar1(y: np.ndarray, g: float, lam: float = 0.0, smin: float = 0.0) -> list[list[float]]:
    """[value, weight, start, length] of the pools: each decays from value / weight, and jumps by smin or more to the next."""
    last, less = len(y) - 1, lam * (1 - g)
    x, powers = (np.asarray(y, float) - less).tolist(), _powers(float(g), 2 * len(y))
    if last >= 0:
        x[last] = float(y[last]) - lam
    if last < 0:
        return []
    values, weights, heads, starts = [], [], [], []  # of the pools before the one that grows; heads: what a pool begins with
    value, weight, head, start = x[0], 1.0, x[0], 0
    for t in range(1, last + 1):
        v, p = x[t], powers[t - start]
        if v >= head * p + smin if head > 0.0 else v >= smin:
            values.append(value)
            weights.append(weight)
            heads.append(head)
            starts.append(start)
            value, weight, head, start = v, 1.0, v, t
            continue
        value, weight = value + v * p, weight + powers[2 * (t - start)]
        head = value / weight
        while starts:
            before, length = heads[-1], start - starts[-1]
            p = powers[length]
            if head >= before * p + smin if before > 0.0 else head >= smin:
                break
            heads.pop()
            start = starts.pop()
            value, weight = values.pop() + value * p, weights.pop() + weight * powers[2 * length]
            head = value / weight
    values.append(value)
    weights.append(weight)
    starts.append(start)
    return [[v, w, t, n - t] for v, w, t, n in zip(values, weights, starts, [*starts[1:], len(y)], strict=True)]


def decay(pools: list[list[float]], g: float, n: int) -> np.ndarray:
    if not len(pools):
        return np.zeros(n)
    v, w, start, length = np.array(pools).T
    length = length.astype(int)
    return np.repeat(np.maximum(0.0, v / w), length) * (g ** np.arange(n))[np.arange(n) - np.repeat(start.astype(int), length)]


def _pools_at_once(z: np.ndarray, g: np.ndarray, lam: np.ndarray, smin: np.ndarray, powers: np.ndarray, shrunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(c, slope) of many traces, the columns of z: pools_ar1 and decay frame by frame, and what c loses for a unit of lam.

    powers: g ** k by row k up to 2 n. A step touches the traces whose last pool still grows; the arithmetic is that of
    pools_ar1 and decay to the last bit, so that s is 0 or rounding at the same frames.
    """
    n, m = z.shape
    values, weights, heads, starts = np.empty((n, m)), np.empty((n, m)), np.empty((n, m)), np.empty((n, m), int)
    depth, every = np.zeros(m, int), np.arange(m)
    for t in range(n):
        v = z[t] - lam * ((1 - g) if t < n - 1 else 1.0)
        w, head, start = np.ones(m), v.copy(), np.full(m, t)
        i = every if t else every[:0]
        while len(i):
            k = depth[i] - 1
            before = starts[k, i]
            p = powers[start[i] - before, i]
            less = head[i] < np.maximum(heads[k, i], 0.0) * p + smin[i]
            i, k, before, p = i[less], k[less], before[less], p[less]
            v[i] = values[k, i] + v[i] * p
            w[i] = weights[k, i] + w[i] * powers[2 * (start[i] - before), i]
            head[i] = v[i] / w[i]
            start[i], depth[i] = before, k
            i = i[k > 0]
        values[depth, every], weights[depth, every], heads[depth, every], starts[depth, every] = v, w, head, start
        depth += 1
    k, i = np.nonzero(np.arange(n)[:, None] < depth)
    start, last = starts[k, i], k == depth[i] - 1
    length = np.where(last, n, starts[np.minimum(k + 1, n - 1), i]) - start
    head = heads[k, i]
    lost = np.where(head > 0, np.where(last, 1.0, 1 - powers[length, i]) / weights[k, i], 0.0)
    # Pools in the order of trace and frame, each repeated over its frames.
    order = np.lexsort((start, i))
    over = lambda x: np.repeat(x[order], length[order]).reshape(m, n).T
    decayed = np.take_along_axis(shrunk, np.arange(n)[:, None] - over(start), 0)
    return over(np.maximum(0.0, head)) * decayed, over(lost) * decayed


def spikes_ar1(c: np.ndarray, g: float) -> np.ndarray:
    s = np.zeros(len(c))
    s[1:] = np.maximum(c[1:] - g * c[:-1], 0.0)
    return s


def _golden(f, low: float, high: float, rounds: int = 24) -> float:
    k = (5**0.5 - 1) / 2
    a, b = low, high
    x, y = b - k * (b - a), a + k * (b - a)
    fx, fy = f(x), f(y)
    for _ in range(rounds):
        if fx < fy:
            b, y, fy = y, x, fx
            x = b - k * (b - a)
            fx = f(x)
        else:
            a, x, fx = x, y, fy
            y = a + k * (b - a)
            fy = f(y)
    return (a + b) / 2


def _bisected(low: float, high: float, top: float, rounds: int) -> float:
    """The lower end after `rounds` halvings of (low, high) towards `top`."""
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if mid <= top else (low, mid)
    return low


def _reach(at, goal: float, low: float, high: float) -> float:
    """Where in (low, high) the residual's energy, which grows with x, reaches goal; high if it does not.

    at(x) gives (energy, slope, curve): as long as the same variables are positive, the energy at x + d is
    energy + 2 d slope + d**2 curve. Each step goes where that reaches goal, or halves what is left.
    """
    x, bottom, top = low, low, None
    for _ in range(100):
        energy, slope, curve = at(x)
        if abs(energy - goal) <= 1e-13 * goal:
            return x
        bottom, top = (x, top) if energy <= goal else (bottom, x)
        if bottom == high:
            return high
        inside = slope * slope + curve * (goal - energy)
        step = x + (np.sqrt(inside) - slope) / curve if curve > 0 and inside >= 0 else np.inf
        end = high if top is None else top
        before, x = x, step if bottom < step < end else end if top is None else (bottom + end) / 2
        if x == before or end - bottom <= 1e-15 * high:
            break
    return bottom


def _shrinking(pools: list[list[float]], g: float, rest: np.ndarray):
    """What _reach asks for at a penalty, from the pools without one and what they leave of each sample.

    A penalty takes more off a pool's head than off the end of the pool before, so pools only merge as it grows: those
    without a penalty are where each look begins, and sums over pools, of nothing below 0, stand for sums over frames.
    """
    # By pool: sum and weight without penalty, what a unit of penalty takes off the sum, decay over it, energy about it.
    first, last = [], len(pools) - 1
    for i, ((v, w, _, length), e) in enumerate(zip(pools, np.add.reduceat(rest * rest, [start for _, _, start, _ in pools]).tolist(), strict=True)):
        p = g**length
        first.append((v, w, 1.0 if i == last else 1 - p, p, e if v > 0.0 else max(e - v * v / w, 0.0)))

    def at(lam: float) -> tuple[float, float, float]:
        stack: list[tuple[float, float, float, float, float]] = []
        heads: list[float] = []
        for v, w, lost, p, e in first:
            head = (v - lam * lost) / w
            while stack:
                before = heads[-1]
                if head >= before * stack[-1][3] if before > 0.0 else head >= 0.0:
                    break
                v0, w0, lost0, p0, e0 = stack.pop()
                heads.pop()
                more = w * p0 * p0
                e += e0 + w0 * w / (w0 + more) * (p0 * v0 / w0 - v / w) ** 2
                v, w, lost, p = v0 + v * p0, w0 + more, lost0 + lost * p0, p0 * p
                head = (v - lam * lost) / w
            stack.append((v, w, lost, p, e))
            heads.append(head)
        energy, curve = 0.0, 0.0
        for (v, w, lost, _, e), head in zip(stack, heads, strict=True):
            energy += e
            if head > 0.0:
                curve += lost * lost / w
            else:
                energy += v * v / w
        return energy + lam * lam * curve, lam * curve, curve

    return at


def deconvolve_ar1(y: np.ndarray, method: str = "constrained", g: float | None = None, sn: float | None = None, lam: float = 0.0, smin: float = 0.0, baseline: bool = True, fit_g: bool = False) -> dict:
    """Calcium c, spikes s, baseline b and the parameters of one trace.

    foopsi: a penalty lam on spikes. constrained: the largest lam whose residual stays within the noise. thresholded:
    the largest smin whose residual does, from the size that noise seldom reaches. NaN counts as 0.
    """
    y = np.nan_to_num(np.asarray(y, float))
    n = len(y)
    sn = float(noise_level(y)[0]) if sn is None else sn
    g = float(ar_coefficients(y, 1, sn)[0]) if g is None else g
    if not 0 < g < 1 or n < 3:
        return {"c": np.zeros(n), "s": np.zeros(n), "b": 0.0, "g": g, "sn": sn, "lam": lam, "smin": smin}
    b = float(np.quantile(y, 0.15, method="hazen")) if baseline else 0.0

    def solve(b, g, lam, smin):
        c = decay(pools_ar1(y - b, g, lam, smin), g, n)
        return c, float(((y - b - c) ** 2).sum())

    goal = sn**2 * n
    for _ in range(6):
        if method == "foopsi":
            c, rss = solve(b, g, lam, smin)
        else:
            first = smallest_spike(np.array([g]), sn) if method == "thresholded" else 0.0
            low, high = first, max(first, float(np.max(y - b))) + 1e-9
            at = (lambda x: solve(b, g, 0.0, x)) if method == "thresholded" else (lambda x: solve(b, g, x, smin))
            z = y - b
            pools = pools_ar1(z, g, 0.0, low if method == "thresholded" else smin)
            c = decay(pools, g, n)
            rss = float(((z - c) ** 2).sum())
            if rss < goal and method != "thresholded" and smin <= 0:
                low = _bisected(low, high, _reach(_shrinking(pools, g, z - c), goal, low, high), 30)
                c, rss = at(low)
            elif rss < goal:
                for _ in range(30):
                    mid = (low + high) / 2
                    c2, rss2 = at(mid)
                    low, high = (mid, high) if rss2 <= goal else (low, mid)
                    if rss2 <= goal:
                        c, rss = c2, rss2
            lam, smin = (lam, low) if method == "thresholded" else (low, smin)
        new = float(np.mean(y - c)) if baseline else b
        if fit_g:
            g = _golden(lambda x: solve(new, x, lam, smin)[1], max(0.01, g - 0.1), min(0.999, g + 0.1))  # noqa: B023
        if abs(new - b) < 1e-4 * max(sn, 1e-12) and not fit_g:
            break
        b = new
    return {"c": c, "s": spikes_ar1(c, g), "b": b, "g": g, "sn": sn, "lam": lam, "smin": smin}


#: Samples that are deconvolved at once.
AT_ONCE = 1 << 18


def deconvolve_ar1_all(traces: list[np.ndarray], method: str = "constrained", g: float | None = None, **options) -> list[dict]:
    """deconvolve_ar1 of each trace; those of one length go through the pools together, some AT_ONCE samples at a time."""
    if options.get("fit_g") or (method == "constrained" and options.get("smin", 0.0) > 0):
        return [deconvolve_ar1(y, method, g, **options) for y in traces]
    out, lengths = [None] * len(traces), np.array([len(y) for y in traces], int)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        for part in np.array_split(rows, max(1, -(-len(rows) * int(n) // AT_ONCE))):
            few = len(part) < 8 or n < 3
            found = [deconvolve_ar1(traces[i], method, g, **options) for i in part] if few else _deconvolved_together(np.nan_to_num(np.array([traces[i] for i in part], float)), method, g, **options)
            for i, d in zip(part, found, strict=True):
                out[i] = d
    return out


def _deconvolved_together(y: np.ndarray, method: str, g: float | None, sn: float | None = None, lam: float = 0.0, smin: float = 0.0, baseline: bool = True, fit_g: bool = False) -> list[dict]:
    """deconvolve_ar1 of the rows of y, step by step as there, for the rows that are not done."""
    m, n = y.shape
    # One by one: an estimated g is to have the bits that it has alone.
    sn = np.array([noise_level(x)[0] for x in y]) if sn is None else np.full(m, float(sn))
    g = np.array([ar_coefficients(x, 1, s)[0] for x, s in zip(y, sn, strict=True)], float) if g is None else np.full(m, float(g))
    b = np.quantile(y, 0.15, axis=1, method="hazen") if baseline else np.zeros(m)
    c, lam, smin, goal = np.zeros((n, m)), np.full(m, float(lam)), np.full(m, float(smin)), sn**2 * n
    good = (g > 0) & (g < 1)
    b[~good] = 0.0
    left, y = np.flatnonzero(good), np.ascontiguousarray(y.T)
    kinds, which = np.unique(np.where(good, g, 0.0), return_inverse=True)
    powers = np.array([_powers(float(x), 2 * n) for x in kinds]).T[:, which]
    shrunk = np.array([x ** np.arange(n) for x in kinds]).T[:, which]
    norm = [smallest_spike(np.array([x]), 1.0) if method == "thresholded" and ok else 0.0 for x, ok in zip(g, good, strict=True)]
    first = sn * np.array(norm)

    def at(i, lam, smin):
        z = y[:, i] - b[i]
        x, slope = _pools_at_once(z, g[i], lam, smin, powers[:, i], shrunk[:, i])
        z -= x
        return x, slope, z, (z * z).sum(0)

    for _ in range(6):
        if not len(left):
            break
        if method == "foopsi":
            c[:, left] = at(left, lam[left], smin[left])[0]
        else:
            low = first[left].copy()
            high = np.maximum(low, (y[:, left] - b[left]).max(0)) + 1e-9
            zero = np.zeros(len(left))
            x, slope, z, rss = at(left, *((zero, low) if method == "thresholded" else (low, zero)))
            c[:, left] = x
            k = np.flatnonzero(rss < goal[left])
            if method == "thresholded":
                for _ in range(30 if len(k) else 0):
                    mid = (low[k] + high[k]) / 2
                    x, _, _, rss = at(left[k], zero[k], mid)
                    up = rss <= goal[left[k]]
                    low[k], high[k] = np.where(up, mid, low[k]), np.where(up, high[k], mid)
                    c[:, left[k[up]]] = x[:, up]
                smin[left] = low
            else:
                if len(k):
                    low[k] = _reached_together(lambda i, x: at(left[i], x, zero[i])[1:], goal[left], k, low, high, (slope[:, k], z[:, k], rss[k]))  # noqa: B023
                    c[:, left[k]] = at(left[k], low[k], zero[k])[0]
                lam[left] = low
        new = np.ascontiguousarray((y[:, left] - c[:, left]).T).mean(1) if baseline else b[left]
        moved = np.abs(new - b[left]) >= 1e-4 * np.maximum(sn[left], 1e-12)
        b[left[moved]] = new[moved]
        left = left[moved]
    c = c.T
    s = np.zeros((m, n))
    s[:, 1:] = np.where(good[:, None], np.maximum(c[:, 1:] - g[:, None] * c[:, :-1], 0.0), 0.0)
    return [{"c": c[i], "s": s[i], "b": float(b[i]), "g": float(g[i]), "sn": float(sn[i]), "lam": float(lam[i]), "smin": float(smin[i])} for i in range(m)]


def _reached_together(at, goal: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, known: tuple) -> np.ndarray:
    """For each of the rows, what _bisected finds towards _reach, at(rows, x) giving (slope of c, residual, energy)."""
    low, high, goal = low[rows], high[rows], goal[rows]
    x, bottom, top, open_ = low.copy(), low.copy(), np.full(len(rows), np.inf), np.arange(len(rows))
    for _ in range(100):
        slope, rest, energy = known
        near = np.abs(energy - goal[open_]) <= 1e-13 * goal[open_]
        under = near | (energy <= goal[open_])
        bottom[open_[under]], top[open_[~under]] = x[open_[under]], x[open_[~under]]
        a, q = (rest * slope).sum(0), (slope * slope).sum(0)
        inside = a * a + q * (goal[open_] - energy)
        with np.errstate(invalid="ignore", divide="ignore"):
            step = np.where((q > 0) & (inside >= 0), x[open_] + (np.sqrt(inside) - a) / q, np.inf)
        none = np.isinf(top[open_])
        end = np.where(none, high[open_], top[open_])
        new = np.where((bottom[open_] < step) & (step < end), step, np.where(none, end, (bottom[open_] + end) / 2))
        done = near | (bottom[open_] == high[open_]) | (new == x[open_]) | (end - bottom[open_] <= 1e-15 * high[open_])
        x[open_] = new
        open_ = open_[~done]
        if not len(open_):
            break
        known = at(rows[open_], x[open_])
    for _ in range(30):
        mid = (low + high) / 2
        up = mid <= bottom
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return low


def _pooled(pools: tuple[np.ndarray, ...], powers: np.ndarray, lam: np.ndarray) -> tuple[np.ndarray, ...]:
    """(trace, start, length, v, w, lost, e, head): the pools of many traces, merged until each begins where the one before ends, or over it.

    pools: the same without head, in the order of trace and start; e is the energy about a pool without penalty. Pools next
    to each other that break the rule are of one pool in the end, so all of a round's runs are merged at once.
    """
    trace, start, length, v, w, lost, e = pools
    while True:
        head = (v - lam[trace] * lost) / w
        low = np.zeros(len(v), bool)
        low[1:] = (trace[1:] == trace[:-1]) & (head[1:] < np.maximum(head[:-1], 0.0) * powers[trace[:-1], length[:-1]])
        if not low.any():
            return trace, start, length, v, w, lost, e, head
        first = np.flatnonzero(~low)
        of = np.cumsum(~low) - 1
        q = powers[trace, start - start[first][of]]
        v1, w1 = np.add.reduceat(v * q, first), np.add.reduceat(w * q * q, first)
        e = np.add.reduceat(e + w * (v / w - q * (v1 / w1)[of]) ** 2, first)
        lost, length = np.add.reduceat(lost * q, first), np.add.reduceat(length, first)
        trace, start, v, w = trace[first], start[first], v1, w1


def calcium_ar1(y: np.ndarray) -> np.ndarray:
    """The calcium of deconvolve_ar1 (constrained) for each row of y, but for rounding: all pools of all rows together."""
    y = np.nan_to_num(np.asarray(y, float))
    m, n = y.shape
    out = np.zeros((m, n))
    if n < 3 or not m:
        return out
    sn, z, lags = noise_level(y), y - y.mean(1, keepdims=True), 6
    ac = np.array([(z[:, k:] * z[:, : max(n - k, 0)]).sum(1) / n if k < n else np.zeros(m) for k in range(lags + 1)])
    a = ac[:lags].copy()
    a[0] -= sn**2
    g = (a * ac[1:]).sum(0) / np.maximum((a * a).sum(0), 1e-300)
    g = np.where(g < 0, np.where(g >= -1, ROOT_BELOW, g), g)
    for i in np.flatnonzero(np.abs(g) > 1):
        g[i] = ar_coefficients(y[i], 1, sn[i])[0]
    rows = np.flatnonzero((g > 0) & (g < 1))
    y, g, sn = y[rows], g[rows], sn[rows]
    goal, b, powers = sn**2 * n, np.quantile(y, 0.15, axis=1, method="hazen"), g[:, None] ** np.arange(n + 1)
    c, left = np.zeros_like(y), np.arange(len(rows))
    for _ in range(6):
        if not len(left):
            break
        z, many = y[left] - b[left, None], len(left)
        own, target, lam = powers[left], goal[left], np.zeros(many)
        lost = np.repeat(1 - g[left][:, None], n, 1)
        lost[:, -1] = 1.0
        trace, start = np.divmod(np.arange(many * n), n)
        pools = _pooled((trace, start, np.ones(many * n, int), z.ravel(), np.ones(many * n), lost.ravel(), np.zeros(many * n)), own, lam)

        def at(k: np.ndarray, lam: np.ndarray, pools=pools, own=own, many=many) -> tuple[np.ndarray, np.ndarray]:
            """(energy of the residual, its curve) of the traces k at their penalties."""
            chosen = np.zeros(many, bool)
            chosen[k] = True
            of, _, _, v, w, lost, e, head = _pooled(tuple(x[chosen[pools[0]]] for x in pools[:7]), own, lam)
            up = head > 0
            curve = np.bincount(of, np.where(up, lost * lost / w, 0.0), many)
            return (np.bincount(of, e + np.where(up, 0.0, v * v / w), many) + lam * lam * curve)[k], curve[k]

        k = np.arange(many)
        known = at(k, lam)
        k = np.flatnonzero(known[0] < target)
        if len(k):
            high = np.maximum(z.max(1), 0.0) + 1e-9
            x, bottom, top, open_, known = lam.copy(), np.zeros(many), np.full(many, np.inf), k, (known[0][k], known[1][k])
            for _ in range(100):
                energy, curve = known
                near = np.abs(energy - target[open_]) <= 1e-13 * target[open_]
                under = near | (energy <= target[open_])
                bottom[open_[under]], top[open_[~under]] = x[open_[under]], x[open_[~under]]
                slope = x[open_] * curve
                inside = slope * slope + curve * (target[open_] - energy)
                with np.errstate(invalid="ignore", divide="ignore"):
                    step = np.where((curve > 0) & (inside >= 0), x[open_] + (np.sqrt(inside) - slope) / curve, np.inf)
                none = np.isinf(top[open_])
                end = np.where(none, high[open_], top[open_])
                new = np.where((bottom[open_] < step) & (step < end), step, np.where(none, end, (bottom[open_] + end) / 2))
                done = near | (bottom[open_] == high[open_]) | (new == x[open_]) | (end - bottom[open_] <= 1e-15 * high[open_])
                x[open_] = new
                open_ = open_[~done]
                if not len(open_):
                    break
                known = at(open_, x)
            low, high, goals = np.zeros(len(k)), high[k], bottom[k]
            for _ in range(30):
                mid = (low + high) / 2
                up = mid <= goals
                low, high = np.where(up, mid, low), np.where(up, high, mid)
            lam[k] = low
            pools = _pooled(pools[:7], own, lam)
        trace, start, length, *_, head = pools
        frames = np.tile(np.arange(n), many) - np.repeat(start, length)
        c[left] = np.repeat(np.maximum(head, 0.0), length).reshape(many, n) * own[np.arange(many)[:, None], frames.reshape(many, n)]
        new = (y[left] - c[left]).mean(1)
        moved = np.abs(new - b[left]) >= 1e-4 * np.maximum(sn[left], 1e-12)
        b[left[moved]] = new[moved]
        left = left[moved]
    out[rows] = c
    return out


def _solved(gram: np.ndarray, target: np.ndarray, regular: bool) -> np.ndarray:
    if regular:
        try:
            return np.linalg.solve(gram, target)
        except np.linalg.LinAlgError:
            pass
    return np.linalg.lstsq(gram, target, rcond=None)[0]


def nnls(gram: np.ndarray, target: np.ndarray, tol: float = 1e-9, most: int | None = None, start: np.ndarray | None = None, regular: bool = False) -> np.ndarray:
    """x >= 0 that minimises x'Gx - 2 x'target, by active sets; at most `most` variables become positive.

    start: any x >= 0 to begin with, such as the solution for a target near by. regular: G is known to have an inverse.
    """
    n = len(target)
    x = np.zeros(n) if start is None else np.array(start, float)
    free = x > tol
    x[~free] = 0
    begun = free.any()
    for _ in range(3 * n + 10 if n else 0):
        if not begun:
            slope = target - gram @ x
            slope[free] = -np.inf
            k = int(np.argmax(slope))
            if slope[k] <= tol or (most is not None and free.sum() >= most):
                break
            free[k] = True
        begun = False
        while True:
            i = np.flatnonzero(free)
            s = _solved(gram[np.ix_(i, i)], target[i], regular)
            if (s > tol).all() or not len(i):
                x[:] = 0
                x[i] = s
                break
            bad = s <= tol
            step = np.min(x[i][bad] / np.maximum(x[i][bad] - s[bad], 1e-300))
            x[i] += min(step, 1.0) * (s - x[i])
            free[i[(x[i] <= tol)]] = False
            x[~free] = 0
    return x


def _responses(kernel: np.ndarray, m: int) -> np.ndarray:
    """What a spike at each of m frames, a column each, does to the m frames."""
    k, length = np.zeros((m, m)), min(len(kernel), m)
    for i in range(length):
        k[np.arange(i, m), np.arange(m - i)] = kernel[i]
    return k


def sliding_nnls(y: np.ndarray, kernel: np.ndarray, window: int = 200, shift: int = 100, lam: float = 0.0, allowed: np.ndarray | None = None, starts: dict | None = None, known: dict | None = None) -> np.ndarray:
    """Non-negative spikes for any kernel, window by window; what a window's first `shift` spikes explain is taken off.

    lam is a penalty on spikes; if allowed is given, spikes may stand only there. starts: the windows' last solutions,
    from which the next begin; known: the responses of windows of a length and their Gram matrix. Both are filled.
    """
    y, n = np.array(y, float), len(y)
    s, known = np.zeros(n), {} if known is None else known
    for a in range(0, n, shift):
        m = min(window, n - a)
        if m not in known:
            k = _responses(kernel, m)
            known[m] = k, k.T @ k
        k, gram = known[m]
        free = np.ones(m, bool) if allowed is None else allowed[a : a + m]
        x = np.zeros(m)
        begin = starts.get(a) if starts is not None else None
        x[free] = nnls(gram if free.all() else gram[np.ix_(free, free)], k[:, free].T @ y[a : a + m] - lam, start=None if begin is None else begin[free], regular=kernel[0] != 0)
        if starts is not None:
            starts[a] = x
        keep = m if a + m >= n else min(shift, m)
        s[a : a + keep] = x[:keep]
        for j in np.flatnonzero(x[:keep]):
            h = kernel[: n - a - j]
            y[a + j : a + j + len(h)] -= x[j] * h
        if a + m >= n:
            break
    return s


def exp2_kernel(decay: float, rise: float, n: int) -> np.ndarray:
    """(d**t - r**t) / (d - r) with d and r the decay of a frame, t = 1 .. n; its limit t d**(t-1) if they are equal."""
    d, r, t = np.exp(-1 / decay), np.exp(-1 / rise), np.arange(1, n + 1)
    return t * d ** (t - 1.0) if abs(d - r) < 1e-9 else (d**t - r**t) / (d - r)


def deconvolve_kernel(y: np.ndarray, kernel: np.ndarray, method: str = "foopsi", sn: float | None = None, lam: float = 0.0, smin: float = 0.0, baseline: bool = True, known: dict | None = None) -> dict:
    """As deconvolve_ar1 for the response `kernel` to one spike: of an AR(2) model, of two exponentials or any other.

    known: see sliding_nnls; calls with the same kernel may share it.
    """
    y = np.nan_to_num(np.asarray(y, float))
    n, sn = len(y), float(noise_level(y)[0]) if sn is None else sn
    b = float(np.quantile(y, 0.15, method="hazen")) if baseline else 0.0

    known, starts = {} if known is None else known, {}

    def solve(lam: float, smin: float):
        s = sliding_nnls(y - b, kernel, lam=lam, starts=starts, known=known)
        if smin > 0:  # spikes under smin go, and the others are fitted again
            s = sliding_nnls(y - b, kernel, lam=lam, allowed=s >= smin, known=known)
        c = np.convolve(s, kernel)[:n]
        return s, c, float(((y - b - c) ** 2).sum())

    def tangent(lam: float):
        s, c, rss = solve(lam, 0.0)
        k, gram = known[n]
        i = np.flatnonzero(s)
        d = k[:, i] @ _solved(gram[np.ix_(i, i)], np.ones(len(i)), kernel[0] != 0)
        return rss, float((y - b - c) @ d), float(d @ d)

    norm = float(np.linalg.norm(kernel))
    for _ in range(2 if baseline else 1):
        if method == "foopsi":
            s, c, _ = solve(lam, smin)
        else:
            low = sn / norm * NormalDist().inv_cdf(0.9999) if method == "thresholded" else 0.0
            high = max(low, float(np.max(kernel[: n] @ kernel[: n] if method == "thresholded" else norm) * np.ptp(y))) + 1e-9
            at = (lambda x: solve(0.0, x)) if method == "thresholded" else (lambda x: solve(x, smin))
            s, c, rss = at(low)
            if rss < sn**2 * n and method != "thresholded" and smin <= 0 and n <= 200:  # one window
                low = _bisected(low, high, _reach(tangent, sn**2 * n, low, high), 12)
                s, c, _ = at(low)
            else:
                for _ in range(12 if rss < sn**2 * n else 0):
                    mid = (low + high) / 2
                    found = at(mid)
                    low, high = (mid, high) if found[2] <= sn**2 * n else (low, mid)
                    s, c = found[:2] if found[2] <= sn**2 * n else (s, c)
            lam, smin = (lam, low) if method == "thresholded" else (low, smin)
        b = float(np.mean(y - c)) if baseline else b
    return {"c": c, "s": s, "b": b, "g": float("nan"), "sn": sn, "lam": lam, "smin": smin}


def hals(u: np.ndarray, v: np.ndarray, x: np.ndarray, rounds: int = 3, mask: np.ndarray | None = None) -> np.ndarray:
    """x >= 0 (rows k) for sums u = sum(data * factor) and v = factor's Gram matrix, one row after another."""
    x = x.copy()
    for _ in range(rounds):
        for k in range(len(x)):
            if v[k, k] > 0:
                x[k] = np.maximum(0.0, x[k] + (u[k] - v[k] @ x) / v[k, k])
                if mask is not None:
                    x[k] *= mask[k]
    return x
