"""Neighbourhoods on the pixel grid: equi joins on shifted positions, never a join on distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.functions import arrays as A


def ring(inner: float, outer: float, k: int | None = None) -> list[tuple[int, int]]:
    """Offsets (dr, dc) with inner <= distance < outer; k of them at about even angles if given."""
    reach = math.ceil(outer)
    found = [(dr, dc) for dr in range(-reach, reach + 1) for dc in range(-reach, reach + 1) if inner * inner <= dr * dr + dc * dc < outer * outer]
    if k and k < len(found):
        found.sort(key=lambda o: (math.atan2(o[1], o[0]), o))
        found = [found[int(i * len(found) / k)] for i in range(k)]
    return found


def _offsets(offsets: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets])


def neighbour_pairs(pixels: DataFrame, offsets: list[tuple[int, int]], *columns: str) -> DataFrame:
    """(pix, columns, n_pix, n_columns) for each pixel and each of its neighbours in the image."""
    other = pixels.select(F.col("pix").alias("n_pix"), F.col("r").alias("n_r"), F.col("c").alias("n_c"), *[F.col(x).alias(f"n_{x}") for x in columns])
    here = pixels.select("pix", "r", "c", *columns, F.explode(_offsets(offsets)).alias("o")).withColumns({"n_r": F.col("r") + F.col("o.dr"), "n_c": F.col("c") + F.col("o.dc")})
    return here.join(other, ["n_r", "n_c"]).drop("o")


def correlation_image(pixels: DataFrame, offsets: list[tuple[int, int]] | None = None) -> DataFrame:
    """Mean over time of a standardised pixel times the mean of its neighbours in the image: (pix, cn, n_neighbours).

    Where offsets come with their opposites, as those around a pixel do, a trace is sent along one half of them and each
    product counts for both pixels.
    """
    centred = A.given(A.mean(F.col("y")), lambda m: F.transform("y", lambda x: x - m))
    p = pixels.select("pix", "r", "c", centred.alias("z"))
    p = p.select("pix", "r", "c", A.given(F.sqrt(A.dot(F.col("z"), F.col("z")) / F.size("z")), lambda s: F.transform("z", lambda x: x / F.when(s == 0, 1.0).otherwise(s))).alias("z"))
    offsets = offsets or ring(1, 2)
    mutual = (0, 0) not in offsets and all((-a, -b) in offsets for a, b in offsets)
    pairs = neighbour_pairs(p, [o for o in offsets if o > (0, 0)] if mutual else offsets, "z")
    found = pairs.select("pix", "n_pix", (A.dot(F.col("z"), F.col("n_z")) / F.size("z")).alias("x"))
    if mutual:
        found = found.select(F.explode(F.array("pix", "n_pix")).alias("pix"), "x")
    return found.groupBy("pix").agg(A.rounded(F.avg("x")).alias("cn"), F.count("*").alias("n_neighbours"))


def ring_background(pixels: DataFrame, inner: float, outer: float, k: int | None = None) -> DataFrame:
    """Mean of the ring around each pixel, frame by frame: (pix, n_ring, level), level the mean over frames."""
    p = pixels.withColumn("m", A.mean(F.col("y")))
    pairs = neighbour_pairs(p.drop("y", "label"), ring(inner, outer, k), "m")
    return pairs.groupBy("pix").agg(F.count("*").alias("n_ring"), A.rounded(F.avg("n_m")).alias("level"))


def ring_weights(pixels: DataFrame, inner: float, outer: float) -> DataFrame:
    """(pix, nbr_pix, w): weights of a pixel's ring, which add up to 1."""
    pairs = neighbour_pairs(pixels.select("pix", "r", "c"), ring(inner, outer))
    size = pairs.groupBy("pix").agg(F.count("*").alias("n"))
    return pairs.join(size, "pix").select("pix", F.col("n_pix").alias("nbr_pix"), (1 / F.col("n")).alias("w"))


def weighted_background(weights: DataFrame, samples: DataFrame) -> DataFrame:
    """The sparse product W * Y: (pix, t, b)."""
    return weights.join(samples.select(F.col("pix").alias("nbr_pix"), "t", "y"), "nbr_pix").groupBy("pix", "t").agg(A.rounded(F.sum(F.col("w") * F.col("y"))).alias("b"))


def border_excluded(pixels: DataFrame, bd: int | tuple[int, int, int, int]) -> DataFrame:
    """Pixels that lie bd or more from all four sides of the image, or so far from each: (top, bottom, left, right)."""
    top, bottom, left, right = (bd,) * 4 if isinstance(bd, int) else bd
    edge = pixels.agg(F.max("r").alias("r1"), F.max("c").alias("c1"))  # one row
    return pixels.join(F.broadcast(edge)).where((F.col("r") >= top) & (F.col("c") >= left) & (F.col("r") <= F.col("r1") - bottom) & (F.col("c") <= F.col("c1") - right)).select("pix", "r", "c")


def dilated(footprints: DataFrame, pixels: DataFrame, reach: int) -> DataFrame:
    """(neuron, pix): the pixels within a disk around any pixel of a component's footprint (neuron, r, c).

    Each task drops the positions that its own pixels share before anything is shuffled.
    """
    disk = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if i * i + j * j <= reach * reach]
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in disk])
    near = footprints.select("neuron", "r", "c", F.explode(steps).alias("s")).select("neuron", (F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c")).distinct()
    return near.join(pixels.select("pix", "r", "c"), ["r", "c"]).select("neuron", "pix")


def median_filtered(pixels: DataFrame, column: str, reach: int = 1) -> DataFrame:
    """Median of the square around each pixel, as far as it lies in the image: (pix, m, n)."""
    square = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]
    pairs = neighbour_pairs(pixels.select("pix", "r", "c", column), square, column)
    return pairs.groupBy("pix").agg(A.rounded(F.expr(f"percentile(n_{column}, 0.5)")).alias("m"), F.count("*").alias("n"))


def filtered(pixels: DataFrame, column: str, taps: list[tuple[int, int, float]]) -> DataFrame:
    """(pix, column): an image filtered by (dr, dc, weight); outside of it the border pixels go on."""
    edge = pixels.agg(F.max("r").alias("h"), F.max("c").alias("w"))  # one row
    kernel = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(v).alias("v")) for a, b, v in taps])
    inside = lambda x, n: F.least(F.greatest(x, F.lit(0).cast("long")), n)
    here = pixels.select("pix", "r", "c", F.explode(kernel).alias("k")).join(F.broadcast(edge))
    here = here.select("pix", inside(F.col("r") + F.col("k.dr"), F.col("h")).alias("n_r"), inside(F.col("c") + F.col("k.dc"), F.col("w")).alias("n_c"), "k.v")
    other = pixels.select(F.col("r").alias("n_r"), F.col("c").alias("n_c"), F.col(column).alias("x"))
    return here.join(other, ["n_r", "n_c"]).groupBy("pix").agg(A.rounded(F.sum(F.col("v") * F.col("x")), 8).alias(column))
