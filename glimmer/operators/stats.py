"""Per-pixel statistics, on traces as arrays (pix, r, c, label, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.functions import arrays as A
from glimmer.operators.shared import cut


def median_centred_peak(pixels: DataFrame) -> DataFrame:
    return pixels.select("pix", A.rounded(F.array_max("y") - A.median(F.col("y"))).alias("peak"))


def peak_to_noise(pixels: DataFrame) -> DataFrame:
    """Peak over the median in units of the standard deviation."""
    y = F.col("y")
    return pixels.select("pix", A.rounded((F.array_max(y) - A.median(y)) / A.deviation(y)).alias("snr"))


def mean_image(pixels: DataFrame) -> DataFrame:
    return pixels.select("pix", A.rounded(A.mean(F.col("y"))).alias("ymean"))


def noise_threshold(pixels: DataFrame, factor: float) -> DataFrame:
    """Values under factor times the pixel's deviation become 0: (pix, n_kept, kept_sum)."""
    kept = A.given(A.deviation(F.col("y")), lambda s: F.filter("y", lambda x: ~(x < factor * s)))
    return pixels.select("pix", kept.alias("k")).select("pix", F.size("k").alias("n_kept"), A.rounded(A.total(F.col("k"))).alias("kept_sum"))


def nan_to_zero(pixels: DataFrame) -> DataFrame:
    """Missing frames (NaN) count as 0."""
    y = F.transform(F.col("y"), lambda x: F.nanvl(F.sqrt(x), F.lit(0.0)))
    return pixels.select("pix", A.rounded(A.total(y)).alias("root_sum"))


def saturated_share(pixels: DataFrame, level: float, share: float) -> DataFrame:
    """Pixels that are at `level` or above in less than `share` of the frames."""
    part = F.size(F.filter("y", lambda x: x >= level)) / F.size("y")
    return pixels.select("pix", A.rounded(part).alias("share")).withColumn("unsaturated", F.col("share") < share)


def normalised(pixels: DataFrame) -> DataFrame:
    """Less the minimum, over the 99th percentile: (pix, mean of the result)."""
    low = A.given(F.array_min("y"), lambda m: F.transform("y", lambda x: x - m))
    return pixels.select("pix", low.alias("z")).select("pix", A.rounded(A.mean(F.col("z")) / A.quantile(F.col("z"), 0.99)).alias("level"))


def peak_frame(pixels: DataFrame) -> DataFrame:
    """The frame of the maximum, the first of equals."""
    return pixels.select("pix", F.array_position("y", F.array_max("y")).alias("t"), A.rounded(F.array_max("y")).alias("peak"))


def ar_difference(pixels: DataFrame, g: float) -> DataFrame:
    """s = c_t - g * c_(t-1): (pix, sum of s, number of s over 0)."""
    s = F.transform("y", lambda x, i: x - g * F.when(i > 0, F.get("y", i - 1)).otherwise(0.0))
    return pixels.select("pix", s.alias("s")).select("pix", A.rounded(A.total(F.col("s"))).alias("s_sum"), F.size(F.filter("s", lambda x: x > 0)).alias("n_up"))


def detrended_by_block_minimum(pixels: DataFrame, width: int) -> DataFrame:
    """Each frame less the minimum of its block of `width` frames: (pix, t, z)."""
    z = F.transform("y", lambda x, i: x - F.array_min(F.slice("y", (F.floor(i / width) * width + 1).cast("int"), width)))
    return pixels.select("pix", F.posexplode(z).alias("t", "z")).select("pix", (F.col("t") + 1).alias("t"), A.rounded(F.col("z")).alias("z"))


def downsampled(pixels: DataFrame, by: int) -> DataFrame:
    """Means of whole blocks of `by` frames: (pix, block, y)."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size("y") / by).cast("int") - 1), lambda b: A.total(F.slice("y", b * by + 1, by)) / by)
    return pixels.select("pix", F.posexplode(blocks).alias("block", "y")).select("pix", "block", A.rounded(F.col("y")).alias("y"))


def frame_slice(samples: DataFrame, first: int, last: int) -> DataFrame:
    return samples.where(F.col("t").between(first, last)).groupBy("t").agg(A.rounded(F.sum("y")).alias("total"))


def frame_outliers(pixels: DataFrame, factor: float, most: float) -> DataFrame:
    """Frames in which no more than `most` of the pixels are over factor deviations: (t, n_out, kept)."""
    out = F.transform("y", lambda x: (F.abs(x - F.col("m")) > factor * F.col("s")).cast("int"))
    p = pixels.select("y", A.mean(F.col("y")).alias("m"), A.deviation(F.col("y")).alias("s")).select(F.posexplode(out).alias("t", "o"))
    return p.groupBy((F.col("t") + 1).alias("t")).agg(F.sum("o").alias("n_out"), (F.sum("o") <= most * F.count("*")).alias("kept"))


def decayed(pixels: DataFrame, g: float) -> DataFrame:
    """c_t = g * c_(t-1) + y_t, the response to a trace of spikes: (pix, t, c)."""
    c = F.aggregate("y", F.array().cast("array<double>"), lambda s, x: F.concat(s, F.array(x + g * F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)))))
    return pixels.select("pix", F.posexplode(c).alias("t", "c")).select("pix", (F.col("t") + 1).alias("t"), A.rounded(F.col("c")).alias("c"))


def two_means(rows: DataFrame, column: str, bins: int, rounds: int = 50) -> DataFrame:
    """rows with cluster: 0 and 1 by the nearer of two means of an array column of `bins` values; ties and equal rows are 0.

    The means start from the rows whose upper half of values adds up to no more than all rows' mean, and from the others,
    so the outcome does not depend on how rows lie. Only the two means come to the driver.
    """
    rows = cut(rows)
    level = A.total(F.slice(column, bins // 2 + 1, bins - bins // 2))
    middle = rows.agg(F.avg(level)).head()[0]
    cluster = (level > F.lit(middle if middle is not None else 0.0)).cast("int")
    before: dict[int, list[float]] = {}
    for _ in range(rounds):
        sums = rows.groupBy(cluster.alias("cluster")).agg(F.array(*[F.avg(F.get(column, F.lit(i))) for i in range(bins)]).alias("mean"))
        means = {r["cluster"]: [round(x, 9) for x in r["mean"]] for r in sums.collect()}  # two rows
        if len(means) < 2 or means == before:
            break
        before = means
        far = [sum(((F.get(column, F.lit(i)) - F.lit(m)) * (F.get(column, F.lit(i)) - F.lit(m)) for i, m in enumerate(means[k])), F.lit(0.0)) for k in (0, 1)]
        cluster = (far[1] < far[0]).cast("int")
    return rows.withColumn("cluster", cluster)
