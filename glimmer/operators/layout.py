"""Patches, halos and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.functions import arrays as A


def patches(spark: SparkSession, height: int, width: int, size: int, halo: int) -> DataFrame:
    """(patch, r0, r1, c0, c1, br0, br1, bc0, bc1): the patches of an image and the blocks with their halo."""
    rows = spark.range(0, height, size).withColumnRenamed("id", "r0")
    d = rows.join(spark.range(0, width, size).withColumnRenamed("id", "c0"))  # a grid, as large as the image has patches
    d = d.withColumns({"r1": F.least(F.col("r0") + size, F.lit(height)) - 1, "c1": F.least(F.col("c0") + size, F.lit(width)) - 1})
    patch = (F.col("c0") / size).cast("long") * -(-height // size) + (F.col("r0") / size).cast("long")
    low = lambda x: F.greatest(F.col(x) - halo, F.lit(0))
    return d.select(patch.alias("patch"), "r0", "r1", "c0", "c1", low("r0").alias("br0"), F.least(F.col("r1") + halo, F.lit(height - 1)).alias("br1"), low("c0").alias("bc0"), F.least(F.col("c1") + halo, F.lit(width - 1)).alias("bc1"))


def patch_of(r: Column, c: Column, height: int, size: int) -> Column:
    return F.floor(c / size) * -(-height // size) + F.floor(r / size)


def block_members(pixels: DataFrame, height: int, size: int, halo: int) -> DataFrame:
    """A row for each pixel and block that holds it: (patch, pix, inside). A pixel knows its blocks; nothing is joined.

    The halo may not be wider than a patch.
    """
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    d = pixels.select("pix", "r", "c", F.explode(steps).alias("s"), F.lit(height).alias("h"))
    d = d.withColumns({"pr": F.floor(F.col("r") / size) + F.col("s.i"), "pc": F.floor(F.col("c") / size) + F.col("s.j")})
    near = lambda x, p: (F.col(x) >= F.col(p) * size - halo) & (F.col(x) < (F.col(p) + 1) * size + halo)
    rows = -(-height // size)
    d = d.where(F.col("pr").between(0, rows - 1) & (F.col("pc") >= 0) & near("r", "pr") & near("c", "pc"))
    return d.select((F.col("pc") * rows + F.col("pr")).alias("patch"), "pix", ((F.col("s.i") == 0) & (F.col("s.j") == 0)).alias("inside"))


def in_patch(pixels: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    return pixels.where(F.col("r").between(r0, r1) & F.col("c").between(c0, c1))


def batches(lengths: DataFrame, frames: int) -> DataFrame:
    """(file, batch, t0, t1): each file's frames in round(T / frames) even ranges."""
    n = F.greatest(F.round(F.col("n") / frames), F.lit(1)).cast("int")
    edge = lambda i: F.round(1 + (F.col("n") - 1) * i / F.col("k")).cast("int")
    d = lengths.withColumn("k", n).select("file", "n", "k", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("batch"))
    return d.select("file", "batch", edge(F.col("batch") - 1).alias("t0"), (edge(F.col("batch")) - F.when(F.col("batch") < F.col("k"), 1).otherwise(0)).alias("t1"))


def coverage_mean(values: DataFrame) -> DataFrame:
    """Where blocks overlap, the mean of what they say: (pix, v, n) from (patch, pix, v)."""
    return values.groupBy("pix").agg(A.rounded(F.avg("v")).alias("v"), F.count("*").alias("n"))


def distribute(pixels: DataFrame, path: str, height: int, size: int, halo: int) -> DataFrame:
    """The pixels by block, written once under path with a folder for each patch: (patch, inside, pix, r, c, y).

    A later call with the same path reads what is there. Reading a patch prunes all other folders.
    """
    spark = pixels.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        blocks = block_members(pixels, height, size, halo).join(pixels.select("pix", "r", "c", "y"), "pix")
        blocks.repartition("patch").write.mode("overwrite").partitionBy("patch").parquet(path)
    return spark.read.parquet(path)


def downsampled_image(pixels: DataFrame, by: int) -> DataFrame:
    """Means of by * by pixels, frame by frame: (r, c, t, y) with r and c of the small image."""
    box = lambda x: F.floor(F.col(x) / by)
    d = pixels.select(box("r").alias("r"), box("c").alias("c"), F.posexplode("y").alias("t", "y"))
    return d.groupBy("r", "c", (F.col("t") + 1).alias("t")).agg(A.rounded(F.avg("y")).alias("y"))


def nearest(small: DataFrame, pixels: DataFrame, by: int, column: str) -> DataFrame:
    """(pix, column): a small image (r, c, column) at full size, each pixel as the small one that it lies in."""
    s = small.select(F.col("r").alias("sr"), F.col("c").alias("sc"), column)
    d = pixels.select("pix", F.floor(F.col("r") / by).alias("sr"), F.floor(F.col("c") / by).alias("sc"))
    return d.join(s, ["sr", "sc"]).select("pix", A.rounded(F.col(column)).alias(column))


def sliding_boxes(sizes: DataFrame, size: int, overlap: int, least: int) -> DataFrame:
    """(r0, r1, c0, c1) of boxes that slide by size - overlap over an image (h, w); a rest under `least` joins the last box."""
    step = size - overlap

    def edges(n: str, name: str) -> DataFrame:
        start = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(n) - least, F.lit(0)), F.lit(step).cast("long")))
        d = sizes.select(F.col(n), start.alias(f"{name}0"))
        end = F.when(F.col(f"{name}0") + step + least > F.col(n) - 1, F.col(n) - 1).otherwise(F.least(F.col(f"{name}0") + size, F.col(n)) - 1)
        return d.select(f"{name}0", end.alias(f"{name}1"))

    return edges("h", "r").join(edges("w", "c"))  # a grid, as large as the image has boxes


def name_hash(name: Column) -> Column:
    """h = 33 h + c modulo 2**32 - 1 over a name's characters, from 5381."""
    codes = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.ascii(F.substring(name, i, F.lit(1))).cast("long"))
    return F.aggregate(codes, F.lit(5381).cast("long"), lambda h, x: (h * 33 + x) % F.lit(4294967295))
