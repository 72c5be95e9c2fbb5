"""Separable resampling of a movie: weights of source lines for each new line, joined along rows and then columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.functions import arrays as A


def _cubic(x: Column) -> Column:
    """Keys' kernel with parameter -1/2."""
    a = F.abs(x)
    near = 1.5 * a * a * a - 2.5 * a * a + 1
    far = -0.5 * a * a * a + 2.5 * a * a - 4 * a + 2
    return F.when(a <= 1, near).when(a <= 2, far).otherwise(0.0)


def taps(lines: DataFrame, method: str = "cubic") -> DataFrame:
    """(o, i, w): new line o is the sum of w times the old lines i, for lines (n, m): n old ones become m.

    Centres of lines go to centres: o lies at (o + 1/2) n / m - 1/2. cubic reaches two lines to each side, or, when lines
    get fewer, two new lines (so that nothing is aliased); nearest takes one line. Outside, lines are mirrored, and a new
    line's weights add up to 1.
    """
    ratio = F.col("n") / F.col("m")
    d = lines.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    d = d.withColumns({"u": (F.col("o") + 0.5) * ratio - 0.5, "wide": F.greatest(ratio, F.lit(1.0)) if method == "cubic" else F.lit(1.0)})
    reach = F.lit(2.0) if method == "cubic" else F.lit(0.5)
    first = F.floor(F.col("u") - reach * F.col("wide"))
    d = d.withColumn("i", F.explode(F.sequence(first, first + F.ceil(2 * reach * F.col("wide")) + 1)))
    x = (F.col("u") - F.col("i")) / F.col("wide")
    d = d.withColumn("w", _cubic(x) if method == "cubic" else ((x >= -0.5) & (x < 0.5)).cast("double")).where("w <> 0")
    turned = F.pmod(F.col("i"), 2 * F.col("n"))
    d = d.withColumn("i", F.when(turned < F.col("n"), turned).otherwise(2 * F.col("n") - 1 - turned))
    d = d.groupBy("o", "i").agg(F.sum("w").alias("w"))
    all_ = d.groupBy("o").agg(F.sum("w").alias("all"))
    return d.join(all_, "o").select("o", "i", (F.col("w") / F.col("all")).alias("w"))


def resized(movie: DataFrame, rows: tuple[int, int], columns: tuple[int, int], method: str = "cubic") -> DataFrame:
    """(r, c, y) with rows[0] x columns[0] pixels made rows[1] x columns[1]; movie: (r, c, y), y an array of frames.

    A new pixel gathers a few rows and then a few columns, so each trace is sent some eight times in all, not sixty-four.
    """
    spark = movie.sparkSession

    def along(d: DataFrame, axis: str, other: str, size: tuple[int, int]) -> DataFrame:
        t = taps(spark.createDataFrame([size], "n long, m long"), method)
        d = d.join(t, d[axis] == t["i"]).groupBy("o", other).agg(A.weighted_sum(F.collect_list(F.struct("w", "y")), "w", "y").alias("y"))
        return d.withColumnRenamed("o", axis)

    d = movie.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "y")
    return along(along(d, "r", "c", rows), "c", "r", columns).select("r", "c", "y")
