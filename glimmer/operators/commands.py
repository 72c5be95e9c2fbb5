"""Edits of a set of components by explicit commands, on footprints (neuron, pix, val) or any table by neuron."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delete(table: DataFrame, ids: list[int]) -> DataFrame:
    return table.where(~F.col("neuron").isin(ids))


def merge(footprints: DataFrame, ids: list[int]) -> DataFrame:
    """The footprints of ids add up under the first of them."""
    joined = footprints.withColumn("neuron", F.when(F.col("neuron").isin(ids), ids[0]).otherwise(F.col("neuron")))
    return joined.groupBy("neuron", "pix").agg(F.sum("val").alias("val"))


def trim(footprints: DataFrame, neuron: int, mask: DataFrame) -> DataFrame:
    """The neuron keeps only the pixels of the mask (pix)."""
    mine = F.col("neuron") == neuron
    return footprints.where(~mine).unionByName(footprints.where(mine).join(mask.select("pix"), "pix", "left_semi"))


def split(footprints: DataFrame, neuron: int, mask: DataFrame, fresh: int) -> DataFrame:
    """The neuron's pixels of the mask (pix) become a component of their own, with the id fresh."""
    marked = footprints.join(mask.select("pix", F.lit(True).alias("out")).distinct(), "pix", "left")
    moved = F.when((F.col("neuron") == neuron) & F.col("out"), F.lit(fresh)).otherwise(F.col("neuron"))
    return marked.select(moved.cast(footprints.schema["neuron"].dataType).alias("neuron"), "pix", "val")
