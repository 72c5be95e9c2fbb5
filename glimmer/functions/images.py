"""Small numpy kernels for the image of one patch or one footprint."""

from __future__ import annotations

import numpy as np


def centred_psf(sigma: float) -> np.ndarray:
    """A Gaussian of ceil(4 sigma + 1) pixels less its mean over a disk, and 0 outside: it takes off what is smooth."""
    n = int(np.ceil(4 * sigma + 1))
    x = np.arange(n) - (n - 1) / 2
    g = np.exp(-(x[:, None] ** 2 + x**2) / (2 * sigma**2))
    g /= g.sum()
    disk = g >= g[:, 0].max()
    return np.where(disk, g - g[disk].mean(), 0.0)


def filtered(stack: np.ndarray, psf: np.ndarray) -> np.ndarray:
    """Each frame (the last axis) filtered, with the border pixels going on outside."""
    h, w = stack.shape[:2]
    n, m = psf.shape
    pad = np.pad(stack, ((n // 2, n - 1 - n // 2), (m // 2, m - 1 - m // 2), (0, 0)), mode="edge")
    out = np.zeros(stack.shape)
    for i, j in zip(*np.nonzero(psf), strict=True):
        out += psf[i, j] * pad[i : i + h, j : j + w]
    return out


def shifted(image: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """image moved by (dr, dc), with 0 where nothing moves in."""
    out = np.zeros_like(image)
    h, w = image.shape[:2]
    out[max(0, dr) : h + min(0, dr), max(0, dc) : w + min(0, dc)] = image[max(0, -dr) : h + min(0, -dr), max(0, -dc) : w + min(0, -dc)]
    return out


_AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def neighbour_correlation(stack: np.ndarray) -> np.ndarray:
    """Mean over frames of a standardised pixel times the mean of its eight neighbours: eight shifts of the stack."""
    z = stack - stack.mean(-1, keepdims=True)
    sd = np.sqrt((z**2).mean(-1, keepdims=True))
    z /= np.where(sd > 0, sd, 1)
    near, (h, w) = np.zeros_like(z), z.shape[:2]
    for i, j in _AROUND:
        near[max(0, i) : h + min(0, i), max(0, j) : w + min(0, j)] += z[max(0, -i) : h + min(0, -i), max(0, -j) : w + min(0, -j)]
    beside = lambda n: 3 - (np.arange(n) == 0) - (np.arange(n) == n - 1)  # noqa: E731  rows or columns about each, its own with them
    return (near * z).mean(-1) / np.maximum(np.outer(beside(h), beside(w)) - 1, 1)


def _square(image: np.ndarray, reach: int, pick) -> np.ndarray:
    """pick of the values at each place of the square around a pixel, 0 outside."""
    h, w = image.shape
    wide = np.zeros((h + 2 * reach, w + 2 * reach), image.dtype)
    wide[reach : reach + h, reach : reach + w] = image
    return pick([wide[i : i + h, j : j + w] for i in range(2 * reach, -1, -1) for j in range(2 * reach, -1, -1)])


def median3(image: np.ndarray) -> np.ndarray:
    """3 by 3 median, 0 outside."""
    return _square(image, 1, lambda x: np.partition(x, 4, 0)[4])


def _extreme(image: np.ndarray, reach: int, pick) -> np.ndarray:
    """np.maximum or np.minimum over the square around each pixel, 0 outside: along one axis and then the other."""
    for axis in (0, 1):
        n = image.shape[axis]
        wide = np.zeros((n + 2 * reach, image.shape[1]) if axis == 0 else (len(image), n + 2 * reach), image.dtype)
        parts = [wide[i : i + n] if axis == 0 else wide[:, i : i + n] for i in range(2 * reach + 1)]
        parts[reach][...] = image
        image = parts[0] if reach else image
        for part in parts[1:]:
            image = pick(image, part)
    return image


def largest(image: np.ndarray, reach: int) -> np.ndarray:
    """The largest value of the square around each pixel."""
    return _extreme(image, reach, np.maximum)


def opened(image: np.ndarray, reach: int) -> np.ndarray:
    """Grey opening by a square: the smallest value around, and then the largest of those."""
    h, w = image.shape
    padded = np.full((h + 2 * reach, w + 2 * reach), image.max(initial=0), image.dtype)
    padded[reach : reach + h, reach : reach + w] = image
    return largest(_extreme(padded, reach, np.minimum)[reach : reach + h, reach : reach + w], reach)


def closed(mask: np.ndarray, reach: int = 1) -> np.ndarray:
    wide = _extreme(np.pad(mask, 2 * reach), reach, np.maximum)
    return _extreme(wide, reach, np.minimum)[2 * reach : -2 * reach, 2 * reach : -2 * reach]


def regions(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """A number for each connected region of the mask, 0 outside."""
    (h, w), on = mask.shape, np.asarray(mask) != 0
    label = np.where(on, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    steps = _AROUND if diagonal else [(-1, 0), (1, 0), (0, -1), (0, 1)]
    # Each shift goes on from the one before; the largest number of a region is where all of them end.
    places = [((slice(max(0, i), h + min(0, i)), slice(max(0, j), w + min(0, j))), (slice(max(0, -i), h + min(0, -i)), slice(max(0, -j), w + min(0, -j)))) for i, j in steps]
    while True:
        before = label.copy()
        for to, of in places:
            label[to] = np.maximum(label[to], label[of] * on[to])
        if (label == before).all():
            return label


def region_of(mask: np.ndarray, at: tuple[int, int]) -> np.ndarray:
    """The connected region of the mask that holds a place; what is outside the mask if the place is.

    The mask is a whole number, a bit a pixel and one between rows; the region grows from the place by shifts of it.
    """
    if not mask[at]:
        return ~mask
    h, w = mask.shape
    wide = np.zeros((h, w + 1), bool)
    wide[:, :w] = mask
    bits = int.from_bytes(np.packbits(wide, bitorder="little").tobytes(), "little")
    found, before = 1 << (int(at[0]) * (w + 1) + int(at[1])), 0
    while found != before:
        before = found
        found = (found | found << 1 | found >> 1 | found << w + 1 | found >> w + 1) & bits
    out = np.frombuffer(found.to_bytes(-(-h * (w + 1) // 8), "little"), np.uint8)
    return np.unpackbits(out, bitorder="little")[: h * (w + 1)].reshape(h, w + 1)[:, :w].astype(bool)


def _slopes(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.gradient of an image of two lines or more each way."""
    out = np.empty_like(image), np.empty_like(image)
    for to, of in zip((out[0], out[1].T), (image, image.T), strict=True):
        to[1:-1] = (of[2:] - of[:-2]) / 2
        to[0], to[-1] = of[1] - of[0], of[-1] - of[-2]
    return out


def connected(image: np.ndarray, share: float = 0.01, reach: int = 2) -> np.ndarray:
    """Only what the opened image connects with the peak."""
    peak = np.unravel_index(np.argmax(image), image.shape)
    return np.where(region_of(opened(image, reach) > image.max() * share, peak), image, 0.0)


def convex(image: np.ndarray) -> np.ndarray:
    """Without weak pixels whose gradient leads away from the peak, and without what does not touch the peak's region."""
    r, c = np.nonzero(image)
    if not len(r) or np.ptp(r) < 1 or np.ptp(c) < 1:
        return image
    box = slice(r.min(), r.max() + 1), slice(c.min(), c.max() + 1)
    part = image[box].copy()
    peak = np.unravel_index(np.argmax(part), part.shape)
    gr, gc = _slopes(part)
    away = gr * (peak[0] - np.arange(part.shape[0]))[:, None] + gc * (peak[1] - np.arange(part.shape[1]))
    part[(away < 0) & (part < part[peak] / 3)] = 0
    part[~largest(region_of(part > 0, peak), 1)] = 0
    out = np.zeros_like(image)
    out[box] = median3(part)
    return out


def most_energy(image: np.ndarray, share: float) -> np.ndarray:
    """Median, the brightest pixels that hold `share` of the energy, gaps closed, and of the regions the one of most energy."""
    image = median3(image)
    order = np.argsort(image, axis=None, kind="stable")
    energy = np.cumsum(image.ravel()[order] ** 2)
    keep = np.zeros(image.size, bool)
    keep[order[np.searchsorted(energy, (1 - share) * energy[-1], "right") :]] = True
    label = regions(closed(keep.reshape(image.shape)), diagonal=True)
    total = np.bincount(label.ravel(), image.ravel() ** 2)
    total[0] = -1
    return np.where(label == np.argmax(total), image, 0.0) if len(total) > 1 else np.zeros_like(image)
