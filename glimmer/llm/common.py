"""What the operators of this package share: tables in the shared folder, keys and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of the contracts: \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side of a join is broadcast only below so many measured bytes; beyond, both sides are shuffled.
BROADCAST_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or on a local master one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> str:
    """The path of a new table in the shared folder with the rows of df."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: the lineage is cut, and a lost executor costs no recomputation."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that `written` made and nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ranked(df: DataFrame, *order: Column, name: str = "ranked") -> DataFrame:
    """df with rank (1, 2, ...): sorted in ranges, each after the rows of the ranges before it, so no task sees all rows.

    Rows that are equal in the whole order are dealt to ranges by their place, however many they are.
    """
    place = F.monotonically_increasing_id()
    rows = df.withColumn("_tie", place).orderBy(*order, "_tie").withColumn("_place", place)
    rows = stored(rows.withColumn("_range", F.shiftright("_place", 33)).withColumn("_row", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_tie", "_place"), name)
    before = rows.groupBy("_range").agg(F.count("*").alias("n")).select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))  # a row for each range
    return rows.join(F.broadcast(before), "_range").withColumn("rank", F.col("_before") + F.col("_row") + 1).drop("_range", "_row", "_before")


def sized(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is small: its rows and the bytes in them are counted, so df must be a stored table."""

    def size(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType):
            each = F.aggregate(F.transform(column, lambda x: size(x, kind.elementType)), F.lit(0).cast("long"), lambda s, x: s + x) if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType)) else 8 * F.size(column)
            return F.coalesce(each, F.lit(0)) + 16
        if isinstance(kind, T.StructType):
            return sum((size(column[f.name], f.dataType) for f in kind), F.lit(0))
        return (F.coalesce(F.octet_length(column), F.lit(0)) if isinstance(kind, (T.StringType, T.BinaryType)) else F.lit(0)) + 16

    bytes_ = df.agg(F.sum(sum((size(F.col(f.name), f.dataType) for f in df.schema), F.lit(0)).cast("long"))).head()[0] or 0
    return F.broadcast(df) if bytes_ <= BROADCAST_BYTES else df


def whole(text: str | Column = "text") -> Column:
    """The text, a null text being empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def pieces_of(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text (one row at least), so that what a task holds stays small.

    A column `text` of whole numbers says how many bytes each row counts for.
    """
    for batch in batches:
        n, start, held = batch.num_rows, 0, 0
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pc.fill_null(column if pa.types.is_integer(column.type) else pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        for i in range(n):
            if i > start and held + lengths[i] > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += lengths[i]
        if n > start:
            yield batch.slice(start, n - start)


def connected(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(node, label) for edges (a, b) of strings: the label is the smallest node that a path leads to.

    Each round passes the smallest label along every edge and then looks up the label's own label (pointer jumping),
    so the rounds grow with the logarithm of the longest path. Every round is stored, and no edges come to the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), name)
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = stored(step, f"{name}-step")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = stored(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), name)
        if not new.where("label <> old").head(1):
            return new.select("node", "label")
        labels = new.select("node", "label")
