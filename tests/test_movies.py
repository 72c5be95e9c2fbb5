"""The data source for movies, and batches as a stream."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.options import Options
from glimmer.plans import updates
from glimmer.sources import movies, tiff
from tests.test_extraction import one_photon, written


def test_frames_are_read_by_ranges(spark, tmp_path):
    frames = np.random.default_rng(0).integers(0, 60000, (23, 3, 4))
    (tmp_path / "a.tif").write_bytes(written(frames[:13]))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.tiff").write_bytes(written(frames[13:], ">"))
    d = movies.read(spark, str(tmp_path), 5)
    assert d.rdd.getNumPartitions() == 5
    got = {(r["path"].rpartition("/")[2], r["t"]): (r["height"], r["width"], r["y"]) for r in d.collect()}
    want = {("a.tif" if k < 13 else "b.tiff", k + 1 if k < 13 else k - 12): (3, 4, frames[k].ravel().tolist()) for k in range(23)}
    assert got == want
    one = {r["t"]: r["y"] for r in movies.as_one(d).collect()}
    assert one == {k + 1: frames[k].ravel().tolist() for k in range(23)}
    pixels = tiff.to_pixels(movies.as_one(d)).collect()
    assert all(r["y"] == frames[:, r["r"], r["c"]].tolist() for r in pixels)


def test_filters_on_frames_reach_the_source(spark, tmp_path):
    frames = np.arange(40 * 6).reshape(40, 2, 3)
    (tmp_path / "a.tif").write_bytes(written(frames))
    d = movies.read(spark, str(tmp_path / "a.tif"), 4)
    some = d.where((F.col("t") >= 10) & (F.col("t") < 15))
    assert sorted(r["t"] for r in some.collect()) == list(range(10, 15))
    assert some.rdd.getNumPartitions() == 2  # frames 10 to 13, and 14
    assert d.where("t = 7").rdd.getNumPartitions() == 1
    assert sorted(r["t"] for r in d.where("t > 38 and height = 2").collect()) == [39, 40]
    assert d.where("t > 100").count() == 0
    assert d.where(F.col("path") == str(tmp_path / "a.tif")).count() == 40
    assert d.where("path = 'other'").count() == 0


@pytest.mark.parametrize(("low", "high", "rest"), [(3, 9, 0), (1, 4, 1)])
def test_pushed_filters(low, high, rest):
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, LessThanOrEqual

    reader = movies.MovieReader("x", 4)
    filters = [GreaterThan(("t",), low - 1), LessThanOrEqual(("t",), high), *([IsNotNull(("t",)), EqualTo(("height",), 3)][: 2 * rest])]
    assert len(list(reader.pushFilters(filters))) == 2 * rest
    assert (reader.low, reader.high) == (low, high)


def test_a_file_over_two_gigabytes(spark, tmp_path):
    """Sparse: directories and strips lie hundreds of megabytes apart."""
    frames = np.random.default_rng(1).integers(0, 60000, (6, 2, 5))
    path, step = tmp_path / "large.tif", 600 << 20
    with open(path, "wb") as out:
        out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, step))
        for k, f in enumerate(frames):
            data, at = f.astype("<u2").tobytes(), step * (k + 1)
            tags = [(256, 5), (257, 2), (258, 16), (259, 1), (273, at + 1000), (277, 1), (279, len(data))]
            out.seek(at)
            out.write(struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", t, 16, 1, v) for t, v in tags) + struct.pack("<Q", at + step if k < 5 else 0))
            out.seek(at + 1000)
            out.write(data)
    assert path.stat().st_size > 3 << 30
    d = movies.read(spark, str(path), 2)
    assert {r["t"]: r["y"] for r in d.collect()} == {k + 1: f.ravel().tolist() for k, f in enumerate(frames)}
    assert [r["y"] for r in d.where("t = 5").collect()] == [frames[4].ravel().tolist()]
    path.unlink()


def test_a_movie_is_written_by_all_tasks(spark, tmp_path):
    frames = np.random.default_rng(2).standard_normal((30, 3, 4))
    d = spark.createDataFrame([(k + 1, 3, 4, frames[k].ravel().tolist()) for k in range(30)], "t int, height int, width int, y array<double>").repartition(5)
    path = str(tmp_path / "movie")
    for _ in range(2):  # the second replaces the first
        movies.write(d, path, 4)
    files = sorted(p.name for p in (tmp_path / "movie").iterdir())
    assert len(files) == 4
    assert all(f.startswith("frames-") for f in files)
    back = {r["t"]: r["y"] for r in movies.as_one(movies.read(spark, path, 3)).collect()}
    assert back == {k + 1: frames[k].ravel().tolist() for k in range(30)}
    # The other reader knows them too.
    assert tiff.read_frames(spark, path).count() == 30


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "movie")
    good = spark.createDataFrame([(1, 1, 1, [5.0])], "t int, height int, width int, y array<double>")
    movies.write(good, path, 1)
    bad = spark.createDataFrame([(2, 1, 1, [1.0]), (1, 1, 1, [1.0])], "t int, height int, width int, y array<double>").coalesce(1)
    with pytest.raises(Exception, match="time order"):
        bad.write.format("tiff_movie").mode("overwrite").save(path)
    assert [r["y"] for r in movies.read(spark, path).collect()] == [[5.0]]
    assert [p.name for p in (tmp_path / "movie").iterdir()] == [p.name for p in (tmp_path / "movie").glob("*.tif")]


def test_empty_and_wrong_files(spark, tmp_path):
    movies.write(spark.createDataFrame([], "t int, height int, width int, y array<double>"), str(tmp_path / "none"), 2)
    assert movies.read(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "x.tif").write_bytes(b"no movie at all.")
    with pytest.raises(Exception, match="not a TIFF file"):
        movies.read(spark, str(tmp_path / "x.tif")).count()


# Batches as a stream


def test_a_stopped_stream_goes_on_to_the_same_tables(spark, tmp_path, monkeypatch):
    from glimmer.streaming import batches

    movie, _, _ = one_photon(spark, frames=200)
    movie = movie.cache()
    o = Options(gSiz=7, patch=24, min_corr=0.5, min_pnr=5, min_pixel=5, ring_radius=8, background_model="ring", nb=1, merge_thr=0.7)
    part = lambda k: movie.withColumn("y", F.slice("y", 1 + 100 * k, 100))
    once = updates.demix_batches(part, [0, 1], 24, str(tmp_path / "once"), o, 2.0)
    want = {n: {tuple(r[:-1]): r[-1] for r in once[n].select(*k).collect()} for n, k in (("footprints", ("neuron", "pix", "val")), ("traces", ("batch", "neuron", "trace")))}

    def arrive(k):
        part(k).withColumn("batch", F.lit(k)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    (tmp_path / "in").mkdir()
    source = lambda: spark.readStream.schema("pix long, r long, c long, y array<double>, batch int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda: batches.demix_stream(source(), 24, str(tmp_path / "state"), o, 2.0).awaitTermination()
    arrive(0)
    run()
    assert updates.done_batches(spark, str(tmp_path / "state")) == [0]
    arrive(1)
    # It stops half way through the second batch: some tables are there, the mark is not.
    real = updates.update_spatial

    def stops(*args, **options):
        raise RuntimeError("stopped")

    monkeypatch.setattr(updates, "update_spatial", stops)
    with pytest.raises(Exception, match="stopped"):
        run()
    assert updates.done_batches(spark, str(tmp_path / "state")) == [0]
    monkeypatch.setattr(updates, "update_spatial", real)
    run()
    run()  # nothing new
    # A batch that comes again changes nothing.
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "state").rglob("*.parquet")}
    assert not updates.demix_batch(part(1), 1, 24, str(tmp_path / "state"), o, 2.0)
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "state").rglob("*.parquet")}
    got = updates.batch_results(spark, str(tmp_path / "state"))
    for name, keys in (("footprints", ("neuron", "pix", "val")), ("traces", ("batch", "neuron", "trace"))):
        found = {tuple(r[:-1]): r[-1] for r in got[name].select(*keys).collect()}
        assert found.keys() == want[name].keys()
        assert all(found[k] == pytest.approx(want[name][k], abs=1e-6) for k in found)
    born = {r["neuron"]: r["since"] for r in updates.batch_state(spark, str(tmp_path / "state"), "neurons", 1).collect()}
    assert set(born) == {r["neuron"] for r in got["traces"].select("neuron").distinct().collect()} | {k for k, s in born.items() if s == 0}
    movie.unpersist()


def test_streamed_batches_arrive_in_several_files(spark, monkeypatch):
    from pathlib import Path

    from glimmer.plans import descents, updates
    from glimmer.streaming import batches

    blurred = spark.range(0, 90, 1, 3).selectExpr("id AS pix", "id % 9 AS r", "id DIV 9 AS c", "array_repeat(1D, 64) AS y")
    monkeypatch.setattr(updates, "_blurred", lambda *a: blurred)
    monkeypatch.setattr(updates, "batch_state", lambda spark, path, name, batch: (name, batch))
    seen = []

    class Ended:
        def awaitTermination(self):
            pass

    def arrived(stream, height, path, *_, **__):
        files = list(Path(path).parent.glob("in/*.parquet"))
        seen.append((len(files), sorted(r["batch"] for r in spark.read.parquet(str(Path(path).parent / "in")).select("batch").distinct().collect())))
        return Ended()

    monkeypatch.setattr(batches, "demix_stream", arrived)
    assert descents.QUERIES["streamed_batches"](spark, "") == ("neurons", 1)
    assert seen == [(3, [0]), (6, [0, 1])]
