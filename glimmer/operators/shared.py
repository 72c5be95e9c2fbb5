"""Tables that outlive a stage: checkpoints in the folder that the driver and all executors share, and ranks over all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a cluster without it stops here, a local master gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, with its lineage cut.

    A table and no checkpoint: a checkpoint hands on all that the planner has inferred of its columns, which in loops
    grows with every round until planning takes longer than the work.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """df with columns of their own, so that it can be grouped together with a table that it comes from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


#: A side is broadcast only below so many measured bytes; beyond, both sides are shuffled.
BROADCAST_BYTES = 8 << 20


def sized(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its rows, and what its arrays hold, are measured to be small; df should be cut before."""
    bytes_ = sum((16 + 8 * F.coalesce(F.size(f.name), F.lit(0)) if isinstance(f.dataType, T.ArrayType) else F.lit(16) for f in df.schema), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(bytes_.cast("long"))).head()[0] or 0) <= BROADCAST_BYTES else df


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with its rank 1, 2, ... in an order without ties: sorted in ranges, each after the rows of those before it.

    No task sees more than a range; a window without partitions would send all rows to one.
    """
    place = F.monotonically_increasing_id()  # the range, and the row's number in it
    rows = cut(df.orderBy(*order).withColumn("_range", F.shiftright(place, 33)).withColumn("_row", place.bitwiseAND(F.lit((1 << 33) - 1))))
    before = rows.groupBy("_range").agg(F.count("*").alias("n")).select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))  # a row for each range
    return rows.join(F.broadcast(before), "_range").withColumn("rank", (F.col("_before") + F.col("_row") + 1).cast("int")).drop("_range", "_row", "_before")
