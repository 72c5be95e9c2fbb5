"""Operators along a trace in rows (user_id, t, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.functions import arrays as A



def _time():
    return Window.partitionBy("user_id").orderBy("t")


def running_median(traces: DataFrame, reach: int) -> DataFrame:
    """Centred median over 2 * reach + 1 samples, fewer at the ends."""
    return traces.select("user_id", "t", A.rounded(F.expr("percentile(y, 0.5)").over(_time().rowsBetween(-reach, reach))).alias("m"))


def first_difference(traces: DataFrame) -> DataFrame:
    return traces.select("user_id", "t", A.rounded(F.col("y") - F.lag("y").over(_time())).alias("d")).where("d is not null")


def conditional_baseline(traces: DataFrame) -> DataFrame:
    """Median of the samples that rise by less than a deviation: (user_id, baseline)."""
    d = traces.select("user_id", "y", (F.col("y") - F.lag("y").over(_time())).alias("d"), F.stddev_samp("y").over(Window.partitionBy("user_id")).alias("s"))
    return d.where("d >= 0 and d < s").groupBy("user_id").agg(A.rounded(F.expr("percentile(y, 0.5)")).alias("baseline"))


def events(traces: DataFrame, reach: int, factor: float) -> DataFrame:
    """Local maxima that rise over the local minimum by factor deviations or more."""
    near = _time().rowsBetween(-reach, reach)
    d = traces.select("user_id", "t", "y", F.max("y").over(near).alias("top"), F.min("y").over(near).alias("low"), F.stddev_samp("y").over(Window.partitionBy("user_id")).alias("s"))
    return d.where((F.col("y") == F.col("top")) & (F.col("y") - F.col("low") >= factor * F.col("s"))).select("user_id", "t", A.rounded(F.col("y")).alias("y"))


def runs_over(traces: DataFrame, level: float, least: int) -> DataFrame:
    """Runs of `least` or more samples in a row over the level: (user_id, first, n)."""
    over = traces.where(F.col("y") > level).select("user_id", "t", (F.col("t") - F.row_number().over(_time())).alias("island"))
    return over.groupBy("user_id", "island").agg(F.min("t").alias("first"), F.count("*").alias("n")).where(F.col("n") >= least).select("user_id", "first", "n")


def percentile_dff(traces: DataFrame, q: float) -> DataFrame:
    """(y - F) / F with F the trace's q-quantile."""
    f = F.expr(f"percentile(y, {q})").over(Window.partitionBy("user_id"))
    return traces.select("user_id", "t", "y", f.alias("f")).select("user_id", "t", A.rounded((F.col("y") - F.col("f")) / F.when(F.col("f") != 0, F.col("f"))).alias("dff"))


def running_dff(traces: DataFrame, reach: int) -> DataFrame:
    """(y - F) / F with F the running median."""
    f = F.expr("percentile(y, 0.5)").over(_time().rowsBetween(-reach, reach))
    return traces.select("user_id", "t", "y", f.alias("f")).select("user_id", "t", A.rounded((F.col("y") - F.col("f")) / F.when(F.col("f") != 0, F.col("f"))).alias("dff"))


def background_dff(traces: DataFrame, background: DataFrame, q: float, reach: int | None = None) -> DataFrame:
    """(neuron, t, base, dff): traces (neuron, t, x) over the q-quantile of what the background (neuron, t, b) has at their components.

    The quantile is that of the whole trace, or with `reach` that of so many frames before and after each.
    """
    w = Window.partitionBy("neuron") if reach is None else Window.partitionBy("neuron").orderBy("t").rowsBetween(-reach, reach)
    base = background.select("neuron", "t", F.expr(f"percentile(b, {q})").over(w).alias("base"))
    d = traces.join(base, ["neuron", "t"])
    return d.select("neuron", "t", A.rounded("base").alias("base"), A.rounded(F.col("x") / F.when(F.col("base") != 0, F.col("base"))).alias("dff"))


def interpolated(traces: DataFrame) -> DataFrame:
    """Missing samples (null) on the line through their neighbours; at the ends, through the first or last two samples."""
    known = F.when(F.col("y").isNotNull(), F.struct("t", "y"))
    ends = traces.where("y is not null").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("t", "y"))).alias("k")).select("user_id", F.slice("k", 1, 2).alias("first"), F.slice("k", F.greatest(F.size("k") - 1, F.lit(1)), 2).alias("last"))
    d = traces.select("user_id", "t", "y", F.last(known, True).over(_time().rowsBetween(Window.unboundedPreceding, 0)).alias("p"), F.first(known, True).over(_time().rowsBetween(0, Window.unboundedFollowing)).alias("n")).join(ends, "user_id", "left")
    a = F.when(F.col("p").isNull(), F.get("first", F.lit(0))).when(F.col("n").isNull(), F.get("last", F.lit(0))).otherwise(F.col("p"))
    b = F.when(F.col("p").isNull(), F.get("first", F.lit(1))).when(F.col("n").isNull(), F.get("last", F.lit(1))).otherwise(F.col("n"))
    line = F.coalesce(a["y"] + (b["y"] - a["y"]) * (F.col("t") - a["t"]) / F.nullif(b["t"] - a["t"], F.lit(0)), a["y"])
    return d.select("user_id", "t", A.rounded(F.coalesce("y", line)).alias("y"))


def lagged_regression(traces: DataFrame) -> DataFrame:
    """Sums for y_t on y_(t-1) and y_(t-2) over all series: the normal equations of one AR(2) model."""
    d = traces.select("y", F.lag("y", 1).over(_time()).alias("a"), F.lag("y", 2).over(_time()).alias("b")).where("b is not null")
    s = lambda x: A.rounded(F.sum(x), 2)
    a, b, y = F.col("a"), F.col("b"), F.col("y")
    return d.agg(F.count("*").alias("n"), s(a * a).alias("aa"), s(a * b).alias("ab"), s(b * b).alias("bb"), s(a * y).alias("ay"), s(b * y).alias("yb"))


def mirrored_percentile(traces: DataFrame, reach: int, q: float) -> DataFrame:
    """Centred running percentile with the trace mirrored at its ends."""
    n = traces.withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    # A sample within reach of an end comes again on the other side of it; traces shorter than the reach are not mirrored beyond.
    places = F.filter(F.array(F.col("t"), F.when(F.col("t") <= reach, 1 - F.col("t")), F.when(F.col("t") > F.col("n") - reach, 2 * F.col("n") + 1 - F.col("t"))), lambda x: x.isNotNull())
    d = n.select("user_id", "n", "y", F.explode(places).alias("t"))
    return d.select("user_id", "t", "n", A.rounded(F.expr(f"percentile(y, {q})").over(_time().rowsBetween(-reach, reach))).alias("p")).where("t between 1 and n").select("user_id", "t", "p")
