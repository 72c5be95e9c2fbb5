"""The given tables seen as movies and traces.

pixels: one row per pixel with its trace as an array (pix, r, c, label, y); samples: the same, one row per frame.
traces: one row per sample of a user's series (user_id, t, y, event_type).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pixels in a column of the image that the embeddings are laid out as.
HEIGHT = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    pix = F.col("vec_id")
    return e.select(pix.alias("pix"), (pix % HEIGHT).alias("r"), F.floor(pix / HEIGHT).alias("c"), "label", F.col("embedding").cast("array<double>").alias("y"))


def samples(pixels: DataFrame) -> DataFrame:
    """A row per pixel and frame; frames count from 1."""
    return pixels.select(*[c for c in pixels.columns if c != "y"], F.posexplode("y").alias("t", "y")).withColumn("t", F.col("t") + 1)


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", F.row_number().over(order).alias("t"), F.col("value").alias("y"), "event_type")
