"""TIFF movies as rows of frames, and frames as rows of pixels."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Tags and field types of the TIFF format.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, SIZES, FORMAT = 256, 257, 258, 259, 273, 277, 279, 339
FIELD = {1: "B", 3: "H", 4: "I", 16: "Q"}
# End of fixed values.


def pages(data: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(height, width, values) of each page of an uncompressed grey TIFF, 8 to 64 bits, either byte order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    version = struct.unpack_from(f"{order}H", data, 2)[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    # Files of the large kind have counts and offsets of 8 bytes.
    size_of_offset, count_kind, entry = (4, "H", 12) if version == 42 else (8, "Q", 20)
    offset_kind = "I" if version == 42 else "Q"
    at = struct.unpack_from(f"{order}{offset_kind}", data, 4 if version == 42 else 8)[0]
    while at:
        n = struct.unpack_from(f"{order}{count_kind}", data, at)[0]
        first = at + struct.calcsize(count_kind)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HH{offset_kind}", data, first + entry * i)
            if kind in FIELD:
                value = first + entry * i + 4 + size_of_offset
                size = struct.calcsize(FIELD[kind]) * count
                place = value if size <= size_of_offset else struct.unpack_from(f"{order}{offset_kind}", data, value)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{FIELD[kind]}", data, place)
        if tags.get(COMPRESSION, (1,))[0] != 1 or tags.get(SAMPLES, (1,))[0] != 1:
            raise ValueError("compressed and colour pages are not read")
        kind = {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]]
        height, width = tags[HEIGHT][0], tags[WIDTH][0]
        raw = b"".join(data[a : a + b] for a, b in zip(tags[OFFSETS], tags[SIZES], strict=True))
        yield height, width, np.frombuffer(raw, f"{order}{kind}{tags.get(BITS, (8,))[0] // 8}")[: height * width].astype(float)
        at = struct.unpack_from(f"{order}{offset_kind}", data, first + entry * n)[0]


def read_frames(spark: SparkSession, path: str, first: int = 1, count: int | None = None) -> DataFrame:
    """(path, t, height, width, y) of the frames first, first + 1, ... of each file; files in a folder are one movie each.

    Spark reads the files, so the path may be in any store that it knows; a file is the unit of work.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                for t, (height, width, y) in enumerate(pages(bytes(data)), 1):
                    if t >= first and (count is None or t < first + count):
                        yield pd.DataFrame({"path": [name], "t": [t], "height": [height], "width": [width], "y": [y]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tif*").load(path)
    return files.select("path", "content").mapInPandas(parse, "path string, t int, height int, width int, y array<double>")


def written(frames: DataFrame) -> DataFrame:
    """(path, content): each movie's frames as the bytes of a TIFF file of one strip a page, 64-bit floats."""

    def pack(key, group: pd.DataFrame) -> pd.DataFrame:
        out, place = bytearray(struct.pack("<2sHI", b"II", 42, 8)), 8
        group = group.sort_values("t")
        for k, (height, width, y) in enumerate(zip(group["height"], group["width"], group["y"], strict=True)):
            data = np.asarray(y, "<f8").tobytes()
            tags = [(WIDTH, width), (HEIGHT, height), (BITS, 64), (COMPRESSION, 1), (OFFSETS, place + 2 + 12 * 8 + 4), (SAMPLES, 1), (SIZES, len(data)), (FORMAT, 3)]
            place += 2 + 12 * len(tags) + 4 + len(data)
            out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", tag, 4, 1, int(value)) for tag, value in tags)
            out += struct.pack("<I", place if k + 1 < len(group) else 0) + data
        return pd.DataFrame({"path": [key[0]], "content": [bytes(out)]})

    return frames.groupBy("path").applyInPandas(pack, "path string, content binary")


def one_movie(frames: DataFrame) -> DataFrame:
    """The files of a folder one after another in time, by name: t goes on from file to file."""
    lengths = frames.groupBy("path").agg(F.max("t").alias("n"))
    before = lengths.select("path", (F.sum("n").over(Window.orderBy("path")) - F.col("n")).cast("int").alias("before"))  # a row for each file
    return frames.join(before, "path").withColumn("t", F.col("t") + F.col("before")).drop("before", "path")


def to_pixels(frames: DataFrame) -> DataFrame:
    """(pix, r, c, y): one row per pixel with its trace in time order. pix counts down the columns."""
    place = F.posexplode("y").alias("i", "v")
    d = frames.select("t", "height", "width", place)
    r, c = F.floor(F.col("i") / F.col("width")), F.col("i") % F.col("width")
    d = d.select((c * F.col("height") + r).alias("pix"), r.alias("r"), c.alias("c"), "t", F.nanvl("v", F.lit(0.0)).alias("v"))
    return d.groupBy("pix", "r", "c").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda x: x["v"]).alias("y"))


def size_of(frames: DataFrame) -> DataFrame:
    """(path, height, width, frames)."""
    return frames.groupBy("path").agg(F.max("height").alias("height"), F.max("width").alias("width"), F.count("*").alias("frames"))


def ingest(spark: SparkSession, path: str, out: str) -> DataFrame:
    """A folder of TIFF files as one movie in a table of pixels under out, written once; (pix, r, c, y, least) with the movie's least value."""
    from glimmer.sources.results import existing

    if not existing(spark, [f"{out}/_SUCCESS"]):
        to_pixels(one_movie(read_frames(spark, path))).write.mode("overwrite").parquet(out)
    pixels = spark.read.parquet(out)
    return pixels.join(F.broadcast(pixels.agg(F.min(F.array_min("y")).alias("least"))))  # one row


def unfinished(spark: SparkSession, path: str, done: DataFrame) -> DataFrame:
    """(path) of the TIFF files below a folder that are not in done (path)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tif*").load(path)
    return files.select("path").join(done.select("path"), "path", "left_anti")
