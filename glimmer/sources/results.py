"""Results of a run: tables under one folder, a folder of its own for each batch where asked, and parts of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(path: str, tables: dict[str, DataFrame], by: dict[str, str] | None = None) -> None:
    """Each table as Parquet under path/name; by names the column whose values become folders (a batch, a patch)."""
    for name, df in tables.items():
        writer = df.repartition(by[name]).write.partitionBy(by[name]) if by and name in by else df.write
        writer.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{name}")


def compressed(values: DataFrame) -> DataFrame:
    """(..., val) without zeros: a sparse matrix by its entries."""
    return values.where("val <> 0")


def subset(tables: dict[str, DataFrame], neurons: DataFrame) -> dict[str, DataFrame]:
    """Every table that has neurons, reduced to those of `neurons` (neuron)."""
    keep = neurons.select("neuron").distinct()
    return {k: t.join(keep, "neuron", "left_semi") if "neuron" in t.columns else t for k, t in tables.items()}


def audit(path: str, step: str, merges: DataFrame) -> None:
    """Appends what a step has merged to the run's audit table."""
    merges.withColumns({"step": F.lit(step), "at": F.current_timestamp()}).write.mode("append").parquet(f"{path.rstrip('/')}/audit")


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The given paths that exist, each once; in any file system that Spark knows."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = [jvm.org.apache.hadoop.fs.Path(p) for p in dict.fromkeys(paths)]
    return [p.toString() for p in found if p.getFileSystem(conf).exists(p)]
