"""Noise, time constants and deconvolution of traces that are array columns: one pass, no shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.functions import kernels as K


def spread(traces: DataFrame, tasks: int | None = None) -> DataFrame:
    """Traces dealt to `tasks` tasks (all cores, if not given), for a table whose small files would be one task.

    What the functions below do for a trace takes long, so a caller who knows that the table is small deals it out; a
    large one has partitions enough, and none of them deals its rows anew.
    """
    return traces.repartition(tasks or traces.sparkSession.sparkContext.defaultParallelism)


def noise(traces: DataFrame, key: str, method: str = "logmexp") -> DataFrame:
    """(key, sn): noise level by the power of the upper half of the spectrum; method: logmexp, mean, median or short (windows)."""
    estimate = K.short_window_noise if method == "short" else lambda y: K.noise_level(y, method=method)

    @F.pandas_udf("double")
    def level(y: pd.Series) -> pd.Series:
        return pd.Series([float(estimate(np.nan_to_num(np.asarray(x, float)))[0]) if x is not None and len(x) > 3 else None for x in y], dtype="float64")

    return traces.select(key, F.round(level("y"), 6).alias("sn"))


def histogram_noise(traces: DataFrame, key: str) -> DataFrame:
    """(key, baseline, sn, sn_plain): by the histogram's peak, and the noise by a plain periodogram."""

    @F.pandas_udf("struct<baseline: double, sn: double, sn_plain: double>")
    def fit(y: pd.Series) -> pd.DataFrame:
        rows = [(*K.histogram_baseline(x), float(K.periodogram_noise(x)[0])) for x in (np.nan_to_num(np.asarray(x, float)) for x in y)]
        return pd.DataFrame(rows, columns=["baseline", "sn", "sn_plain"])

    return traces.where(F.size("y") > 3).select(key, fit("y").alias("f")).select(key, *[F.round(f"f.{x}", 6).alias(x) for x in ("baseline", "sn", "sn_plain")])


def time_constants(traces: DataFrame, key: str, p: int = 2) -> DataFrame:
    """(key, sn, g): AR coefficients of each trace."""

    @F.pandas_udf("struct<sn: double, g: array<double>>")
    def fit(y: pd.Series) -> pd.DataFrame:
        rows = []
        for x in y:
            x = np.nan_to_num(np.asarray(x, float))
            sn = float(K.noise_level(x)[0])
            rows.append((sn, K.ar_coefficients(x, p, sn)))
        return pd.DataFrame(rows, columns=["sn", "g"])

    return traces.where(F.size("y") > 3).select(key, fit("y").alias("f")).select(key, F.round("f.sn", 6).alias("sn"), F.transform("f.g", lambda x: F.round(x, 6)).alias("g"))


def deconvolved(traces: DataFrame, key: str, method: str = "constrained", model: str = "ar1", **options) -> DataFrame:
    """(key, c, s, b, g, sn, lam, smin) of each trace.

    method: foopsi, constrained or thresholded. model: ar1; ar2, whose coefficients are estimated from the trace; exp2
    with the options decay and rise, in frames; kernel with the option kernel.
    """
    schema = "struct<c: array<double>, s: array<double>, b: double, g: double, sn: double, lam: double, smin: double>"
    shape = {k: options.pop(k) for k in ("decay", "rise", "kernel", "g2") if k in options}

    def all_(ys: list[np.ndarray]) -> list[dict]:
        if model == "ar1":
            return K.deconvolve_ar1_all(ys, method, **options)
        known = {}  # a kernel that all traces of a length share has its Gram matrices made once
        return [one(y, known) for y in ys]

    def one(y: np.ndarray, known: dict) -> dict:
        n = min(len(y), 200)
        if model == "kernel":
            h = np.asarray(shape["kernel"], float)
        elif model == "exp2":
            h = K.exp2_kernel(shape["decay"], shape["rise"], n)
        else:
            x = np.nan_to_num(y)
            g = np.asarray(shape["g2"]) if "g2" in shape else K.ar_coefficients(x, 2, float(K.noise_level(x)[0]))
            h = K.ar_kernel(g, n)
        shared = model != "ar2" or "g2" in shape
        return K.deconvolve_kernel(y, h, method, known=known.setdefault(len(h), {}) if shared else None, **options)

    @F.pandas_udf(schema)
    def run(y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(all_([np.asarray(x, float) for x in y]), columns=["c", "s", "b", "g", "sn", "lam", "smin"])

    return traces.where(F.size("y") > 3).select(key, run("y").alias("d")).select(key, "d.*")


def deconvolved_components(traces: DataFrame, **options) -> DataFrame:
    """(neuron, c_raw, c, s, b, g, sn) from (neuron, trace): c_raw is the trace less its baseline; where nothing was found, c is c_raw."""
    # Components are few and each takes long: they are dealt out, as a table of them may be one small file.
    found = deconvolved(spread(traces.withColumnRenamed("trace", "y")), "neuron", **options).join(traces, "neuron")
    d = found.withColumn("c_raw", F.transform("trace", lambda x: F.nanvl(x, F.lit(0.0)) - F.col("b")))
    return d.select("neuron", "c_raw", F.when(F.exists("c", lambda x: x != 0), F.col("c")).otherwise(F.col("c_raw")).alias("c"), "s", "b", "g", "sn")


def modes(traces: DataFrame, key: str) -> DataFrame:
    """(key, mode, bandwidth): where a trace's values are densest."""

    @F.pandas_udf("struct<mode: double, bandwidth: double>")
    def run(y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(K.density_modes([np.nan_to_num(np.asarray(x, float)) for x in y]), columns=["mode", "bandwidth"])

    return traces.where(F.size("y") > 3).select(key, run("y").alias("m")).select(key, F.round("m.mode", 6).alias("mode"), F.round("m.bandwidth", 6).alias("bandwidth"))


def spectra(traces: DataFrame, key: str, bins: int = 8) -> DataFrame:
    """(key, power): the logarithm of each trace's power in even bands of frequency."""

    @F.pandas_udf("array<double>")
    def run(y: pd.Series) -> pd.Series:
        rows = (K.welch_density(np.nan_to_num(np.asarray(x, float)))[1][0] for x in y)
        return pd.Series([[float(np.log(part.mean() + 1e-300)) for part in np.array_split(p, bins)] for p in rows])

    return traces.where(F.size("y") > 3).select(key, run("y").alias("power"))


def kernel_spikes(traces: DataFrame, key: str, kernel: list[float], window: int = 200, shift: int = 100) -> DataFrame:
    """(key, s): non-negative spikes for a given kernel."""

    @F.pandas_udf("array<double>")
    def run(y: pd.Series) -> pd.Series:
        return pd.Series([K.sliding_nnls(np.nan_to_num(np.asarray(x, float)), np.asarray(kernel), window, shift) for x in y])

    return traces.select(key, run("y").alias("s"))
