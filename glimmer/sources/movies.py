"""A data source for TIFF movies of any size: `tiff_movie` reads ranges of frames and writes a file a task.

read: (path, t, height, width, y), a row a frame, with the options path (a file or a folder) and frames_per_task. A task
has a range of one file's frames and reads the bytes of those alone; filters on t and path are taken into the plan.
write: rows (t, height, width, y), a file for each task, named after its first frame.
"""

from __future__ import annotations

import itertools
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from glimmer.sources.tiff import BITS, COMPRESSION, FIELD, FORMAT, HEIGHT, OFFSETS, SAMPLES, SIZES, WIDTH

SCHEMA = "path string, t int, height int, width int, y array<double>"
#: Bytes of values that a task puts into one Arrow batch, one frame at least.
BATCH_BYTES = 4 << 20
LAST = (1 << 31) - 1


def _place(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


@dataclass
class Layout:
    """How a file's directories are written: byte order, and the widths of its counts and offsets."""

    order: str
    large: bool
    first: int

    @classmethod
    def of(cls, file) -> Layout:
        head = file.read_at(16, 0)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack_from(f"{order}H", head, 2)[0] if order else 0
        if version not in (42, 43):
            raise ValueError("not a TIFF file")
        large = version == 43
        return cls(order, large, struct.unpack_from(f"{order}{'Q' if large else 'I'}", head, 8 if large else 4)[0])

    def directory(self, file, at: int) -> tuple[bytes, int, int]:
        """(entries, how many, where the next directory is): two reads, whatever the page's size."""
        count, entry, offset = ("Q", 20, "Q") if self.large else ("H", 12, "I")
        n = struct.unpack(f"{self.order}{count}", file.read_at(struct.calcsize(count), at))[0]
        data = file.read_at(entry * n + struct.calcsize(offset), at + struct.calcsize(count))
        return data, n, struct.unpack_from(f"{self.order}{offset}", data, entry * n)[0]

    def page(self, file, data: bytes, n: int) -> tuple[int, int, np.ndarray]:
        """(height, width, values) of an uncompressed grey page."""
        entry, offset, width = (20, "Q", 8) if self.large else (12, "I", 4)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{self.order}HH{offset}", data, entry * i)
            if kind in FIELD:
                size = struct.calcsize(FIELD[kind]) * count
                at = entry * i + 4 + width
                raw = data[at : at + size] if size <= width else file.read_at(size, struct.unpack_from(f"{self.order}{offset}", data, at)[0])
                tags[tag] = struct.unpack_from(f"{self.order}{count}{FIELD[kind]}", raw)
        if tags.get(COMPRESSION, (1,))[0] != 1 or tags.get(SAMPLES, (1,))[0] != 1:
            raise ValueError("compressed and colour pages are not read")
        kind = {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]]
        raw = b"".join(file.read_at(b, a) for a, b in zip(tags[OFFSETS], tags[SIZES], strict=True))
        height, wide = tags[HEIGHT][0], tags[WIDTH][0]
        return height, wide, np.frombuffer(raw, f"{self.order}{kind}{tags.get(BITS, (8,))[0] // 8}")[: height * wide].astype(float)


@dataclass
class Frames(InputPartition):
    path: str
    first: int
    count: int
    at: int


class MovieReader(DataSourceReader):
    """Plans a task for each range of frames that the filters leave; the directories alone are read for that."""

    def __init__(self, path: str, frames_per_task: int):
        self.path, self.frames_per_task, self.low, self.high, self.names = path, frames_per_task, 1, LAST, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("t",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high = min(self.high, value - isinstance(f, LessThan))
            elif column == ("path",) and isinstance(f, EqualTo | In):
                names = {value} if isinstance(f, EqualTo) else set(value)
                self.names = names if self.names is None else self.names & names
            else:
                yield f

    def partitions(self) -> list[Frames]:
        fs, path = _place(self.path)
        info = fs.get_file_info(path)
        files = [info] if info.is_file else fs.get_file_info(pa.fs.FileSelector(path, recursive=True))
        found = []
        for f in sorted((f for f in files if f.is_file and ".tif" in f.base_name and not any(p[:1] in "._" for p in f.path.removeprefix(path).split("/") if p)), key=lambda f: f.path):
            if self.names is not None and f.path not in self.names:
                continue
            with fs.open_input_file(f.path) as file:
                layout = Layout.of(file)
                at, t = layout.first, 1
                while at and t <= self.high:
                    if t >= self.low:
                        if not found or found[-1].path != f.path or found[-1].count == self.frames_per_task:
                            found.append(Frames(f.path, t, 0, at))
                        found[-1].count += 1
                    at, t = layout.directory(file, at)[2], t + 1
        return [*found] or [Frames(path, 1, 0, 0)]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        fs, _ = _place(self.path)
        with fs.open_input_file(partition.path) as file:
            layout, at, rows = Layout.of(file), partition.at, []
            for t in range(partition.first, partition.first + partition.count):
                data, n, at = layout.directory(file, at)
                rows.append((t, *layout.page(file, data, n)))
                if sum(r[3].nbytes for r in rows) >= BATCH_BYTES:
                    yield _batch(partition.path, rows)
                    rows = []
            if rows:
                yield _batch(partition.path, rows)


def _batch(path: str, rows: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
    t, height, width, y = zip(*rows, strict=True)
    ends = np.cumsum([0, *map(len, y)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *(pa.array(x, pa.int32()) for x in (t, height, width)), pa.ListArray.from_arrays(ends, np.concatenate(y))], ["path", "t", "height", "width", "y"])


@dataclass
class Part(WriterCommitMessage):
    name: str | None


class MovieWriter(DataSourceArrowWriter):
    """A file of the large kind for each task, 64-bit floats, a strip a page; at the end all are moved into the folder.

    A page is written when the next is known, so a task holds one frame and one batch.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.attempt = path, overwrite, uuid.uuid4().hex

    def _temporary(self) -> tuple[pa.fs.FileSystem, str, str]:
        fs, path = _place(self.path)
        return fs, path, f"{path}/_temporary-{self.attempt}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        frames = ((t.as_py(), h.as_py(), w.as_py(), np.asarray(y.values if y.values is not None else [], "<f8")) for b in iterator for t, h, w, y in zip(*(b.column(b.schema.get_field_index(c)) for c in ("t", "height", "width", "y")), strict=True))
        first = next(frames, None)
        if first is None:
            return Part(None)
        fs, _, folder = self._temporary()
        context = TaskContext.get()
        name = f"frames-{first[0]:010d}-{context.partitionId() if context else 0:05d}.tif"
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{name}.{context.taskAttemptId() if context else 0}") as out:
            out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16))
            place, before = 16, first[0]
            for (t, height, width, y), more in _with_next(itertools.chain([first], frames)):
                if t < before:
                    raise ValueError("the frames of a task must come in time order")
                before, data = t, y.tobytes()
                tags = [(WIDTH, width), (HEIGHT, height), (BITS, 64), (COMPRESSION, 1), (OFFSETS, place + 8 + 20 * 8 + 8), (SAMPLES, 1), (SIZES, len(data)), (FORMAT, 3)]
                place += 8 + 20 * len(tags) + 8 + len(data)
                out.write(struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", tag, 16, 1, v) for tag, v in tags) + struct.pack("<Q", place if more else 0) + data)
        return Part(f"{name}.{context.taskAttemptId() if context else 0}")

    def commit(self, messages: list[Part | None]) -> None:
        fs, path, folder = self._temporary()
        fs.create_dir(path, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(pa.fs.FileSelector(path)):
                if f.is_file and f.base_name.endswith(".tif"):
                    fs.delete_file(f.path)
        for m in messages:
            if m and m.name:
                fs.move(f"{folder}/{m.name}", f"{path}/{m.name.rpartition('.')[0]}")
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        fs, _, folder = self._temporary()
        if fs.get_file_info(folder).type == pa.fs.FileType.Directory:
            fs.delete_dir(folder)


def _with_next(items):
    """Each item, and whether another follows."""
    before = next(items, None)
    for item in items:
        yield before, True
        before = item
    if before is not None:
        yield before, False


class TiffMovie(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff_movie"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MovieReader:
        return MovieReader(self.options["path"], int(self.options.get("frames_per_task", 64)))

    def writer(self, schema, overwrite: bool) -> MovieWriter:
        return MovieWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffMovie)


def read(spark: SparkSession, path: str, frames_per_task: int = 64) -> DataFrame:
    """(path, t, height, width, y): the frames of a TIFF file, or of all below a folder, each file from frame 1 on."""
    register(spark)
    return spark.read.format("tiff_movie").option("frames_per_task", frames_per_task).load(path)


def write(frames: DataFrame, path: str, parts: int) -> None:
    """The frames (t, height, width, y) as a movie of `parts` files, each of a range of frames, in time order by name."""
    register(frames.sparkSession)
    rows = frames.select(F.col("t").cast("int").alias("t"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), F.col("y").cast("array<double>").alias("y"))
    rows.repartitionByRange(parts, "t").sortWithinPartitions("t").write.format("tiff_movie").mode("overwrite").save(path)


def as_one(frames: DataFrame) -> DataFrame:
    """The files of a folder, in the order of their names, as one movie: t goes on from file to file."""
    from glimmer.sources import tiff

    return tiff.one_movie(frames)
