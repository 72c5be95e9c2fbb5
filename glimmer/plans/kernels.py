"""Queries that SQL cannot express: deconvolution, seeding, regressions, merging and streaming over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.functions import arrays as A
from glimmer.operators import components as C
from glimmer.operators import deconvolution, graph, patches, stats
from glimmer.operators.shared import cut, shared_folder
from glimmer.sources.adapters import HEIGHT, pixels, samples, table, traces


def _dealt(spark: SparkSession, d: str) -> DataFrame:
    """The pixels of a small file, dealt to all cores."""
    return deconvolution.spread(pixels(spark, d))


def _summary(d: DataFrame, key: str) -> DataFrame:
    return d.select(key, F.size("c").alias("n"), *[A.rounded(F.col(x), 5).alias(x) for x in ("b", "g", "sn")], A.rounded(A.total(F.col("c")), 4).alias("c_sum"), F.size(F.filter("s", lambda x: x > 0)).alias("n_spikes"))


def noise_psd(spark: SparkSession, d: str) -> DataFrame:
    return deconvolution.noise(_dealt(spark, d), "pix")


def noise_histogram(spark: SparkSession, d: str) -> DataFrame:
    return deconvolution.histogram_noise(_dealt(spark, d), "pix")


def ar_time_constants(spark: SparkSession, d: str) -> DataFrame:
    return deconvolution.time_constants(_dealt(spark, d), "pix", 2)


def noise_short_windows(spark: SparkSession, d: str) -> DataFrame:
    """Noise by windows of an eighth of the trace."""
    return deconvolution.noise(_dealt(spark, d), "pix", "short")


def deconvolved_ar1(spark: SparkSession, d: str) -> DataFrame:
    """Whole calcium and spike traces, with time constants and noise from the traces themselves."""
    found = deconvolution.deconvolved(_dealt(spark, d), "pix", "constrained")
    short = lambda x: F.transform(x, lambda v: A.rounded(v, 5)).alias(x)
    return found.select("pix", short("c"), short("s"), *[A.rounded(F.col(x), 5).alias(x) for x in ("b", "g", "sn", "lam")])


def foopsi_ar2(spark: SparkSession, d: str) -> DataFrame:
    return _summary(deconvolution.deconvolved(_dealt(spark, d), "pix", "foopsi", "ar2", g2=[1.4, -0.48], lam=0.05), "pix")


def thresholded_ar2(spark: SparkSession, d: str) -> DataFrame:
    return _summary(deconvolution.deconvolved(_dealt(spark, d), "pix", "thresholded", "ar2", g2=[1.4, -0.48]), "pix")


def constrained_exp2(spark: SparkSession, d: str) -> DataFrame:
    return _summary(deconvolution.deconvolved(_dealt(spark, d), "pix", "constrained", "exp2", decay=6.0, rise=1.0), "pix")


def foopsi_ar1(spark: SparkSession, d: str) -> DataFrame:
    return _summary(deconvolution.deconvolved(_dealt(spark, d), "pix", "foopsi", g=0.9, lam=0.05), "pix")


def constrained_ar1(spark: SparkSession, d: str) -> DataFrame:
    return _summary(deconvolution.deconvolved(_dealt(spark, d), "pix", "constrained", g=0.9), "pix")


def thresholded_ar1(spark: SparkSession, d: str) -> DataFrame:
    return _summary(deconvolution.deconvolved(_dealt(spark, d), "pix", "thresholded", g=0.9), "pix")


def kernel_nnls(spark: SparkSession, d: str) -> DataFrame:
    kernel = [0.9**i - 0.5**i for i in range(1, 30)]
    s = deconvolution.kernel_spikes(_dealt(spark, d), "pix", kernel, 32, 16)
    return s.select("pix", A.rounded(A.total(F.col("s")), 4).alias("s_sum"), F.size(F.filter("s", lambda x: x > 1e-6)).alias("n_spikes"))


def greedy_seeds(spark: SparkSession, d: str) -> DataFrame:
    found = patches.seeds(patches.blocks(pixels(spark, d), HEIGHT, 8, 2), 2, 0.2)
    return found.select("patch", "rank", "pix", "score")


def ring_regression(spark: SparkSession, d: str) -> DataFrame:
    return patches.ring_weights(patches.blocks(pixels(spark, d), HEIGHT, 8, 3), 2, 3)


def low_rank_background(spark: SparkSession, d: str) -> DataFrame:
    return patches.low_rank_background(patches.blocks(pixels(spark, d), HEIGHT, 8, 2), 2)


def nnls_spatial(spark: SparkSession, d: str) -> DataFrame:
    p = pixels(spark, d)
    region, t = C.label_region(p), C.label_traces(samples(p))
    return patches.spatial_update(C.spatial_sums(p, region, t), C.gram(t, C.region_pairs(region)))


def merge_components(spark: SparkSession, d: str) -> DataFrame:
    """Components (labels) that touch and have similar traces become one: the connected groups and their rank-one traces."""
    p = pixels(spark, d)
    t = C.label_traces(samples(p))
    groups = graph.connected_components(C.trace_correlation(t, C.adjacent_labels(p), 0.15)).withColumn("id", F.col("id").cast("long"))
    footprints = p.select(F.col("label").cast("long").alias("id"), "pix", A.mean(F.col("y")).alias("val"))
    merged = graph.merged_traces(t.select(F.col("label").cast("long").alias("id"), "trace"), footprints, groups)
    return merged.select("label", "members", A.rounded(A.mean(F.col("trace")), 5).alias("level"))


def streamed_calcium(spark: SparkSession, d: str) -> DataFrame:
    """The series of the events table as a stream: every frame, after its files and a closing row for each series."""
    from glimmer.streaming.online import online_calcium

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    traces(spark, d).select(F.col("user_id").cast("long").alias("user_id"), "t", "y").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("user_id long, t int, y double").parquet(f"{base}/in")
    out = online_calcium(stream, 0.9)
    run = lambda: out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    run()
    closing = spark.read.parquet(f"{base}/in").select("user_id", F.lit(None).cast("int").alias("t"), F.lit(None).cast("double").alias("y")).distinct()
    closing.write.parquet(f"{base}/closing")
    spark.read.parquet(f"{base}/closing").write.mode("append").parquet(f"{base}/in")
    run()
    done = spark.read.schema(out.schema).parquet(f"{base}/out")
    return done.select("user_id", "t", A.rounded(F.col("c")).alias("c"), A.rounded(F.col("spike")).alias("spike"))


def event_types(spark: SparkSession, d: str) -> DataFrame:
    """Two-means on the logarithm of each pixel's spectrum; active is the cluster of less power at high frequencies."""
    found = cut(stats.two_means(deconvolution.spectra(_dealt(spark, d), "pix", 8), "power", 8))
    high = A.total(F.slice("power", 5, 4))
    active = found.groupBy("cluster").agg(F.avg(high).alias("high")).agg(F.min_by("cluster", F.struct("high", "cluster")).alias("least"))  # one row
    return found.join(F.broadcast(active)).select("pix", "cluster", (F.col("cluster") == F.col("least")).alias("active"))


def pnr_psd(spark: SparkSession, d: str) -> DataFrame:
    """Peak over the median in units of the noise by the spectrum."""
    p = pixels(spark, d)
    return stats.median_centred_peak(p).join(deconvolution.noise(p, "pix"), "pix").select("pix", A.rounded(F.col("peak") / F.col("sn"), 4).alias("pnr"))


def density_modes(spark: SparkSession, d: str) -> DataFrame:
    return deconvolution.modes(_dealt(spark, d), "pix")


def preprocessed(spark: SparkSession, d: str) -> DataFrame:
    """What is known of a pixel before the first seed: unsaturated, noise, active by its spectrum, and the movie's common AR(1) coefficient.

    The coefficient is a sum over all pixels: lag-1 products over squares less the noise.
    """
    p = pixels(spark, d)
    sn = deconvolution.histogram_noise(p, "pix").select("pix", "sn_plain")
    z = p.select("pix", C.centred(F.col("y")).alias("z")).join(sn, "pix")
    n = F.size("z")
    lag = A.dot(F.slice("z", 1, n - 1), F.slice("z", 2, n - 1))
    common = z.agg(A.rounded(F.sum(lag) / F.sum(A.dot(F.col("z"), F.col("z")) - n * F.pow("sn_plain", 2))).alias("g"))  # one row
    d1 = stats.saturated_share(p, 0.2, 0.05).select("pix", "unsaturated").join(sn, "pix").join(event_types(spark, d).select("pix", "active"), "pix")
    return d1.join(F.broadcast(common)).select("pix", "unsaturated", F.col("sn_plain").alias("sn"), "active", "g")


QUERIES = {f.__name__: f for f in (noise_psd, noise_short_windows, noise_histogram, ar_time_constants, deconvolved_ar1, foopsi_ar1, constrained_ar1, thresholded_ar1, foopsi_ar2, thresholded_ar2, constrained_exp2, kernel_nnls, greedy_seeds, ring_regression, low_rank_background, nnls_spatial, merge_components, streamed_calcium, event_types, pnr_psd, density_modes, preprocessed)}
