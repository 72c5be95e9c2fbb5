import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.operators import commands, patches
from glimmer.operators import components as C
from glimmer.options import Options, updated
from glimmer.plans.extraction import extract
from glimmer.sources import tiff
from tests.test_kernels import movie


def test_extraction_finds_planted_sources(spark):
    pixels, centres = movie(spark, 16, 200)
    out = extract(pixels, 16, Options(gSiz=4, patch=8, min_corr=0.3, min_pnr=3.0, seeds_per_patch=2, merge_thr=0.7))
    neurons = out["neurons"].toPandas()
    near = lambda n, m: abs(n // 16 - m // 16) <= 1 and abs(n % 16 - m % 16) <= 1
    truth = {r["pix"]: np.array(r["y"]) for r in pixels.collect()}
    traces = {r["neuron"]: r["trace"] for r in out["traces"].collect()}
    for centre in centres:
        found = [n for n in neurons["neuron"] if near(n, centre)]
        assert len(found) == 1
        assert np.corrcoef(traces[found[0]], truth[centre])[0, 1] > 0.9


def test_options():
    o = updated(Options(), "MIN_C", 0.8, "gsig", 3, ring_radius=18)
    assert (o.min_corr, o.gSig, o.ring_radius) == (0.8, 3, 18)
    for bad in (("min", 1), ("nothing", 1), ("gSig",)):
        with pytest.raises(ValueError):
            updated(Options(), *bad)


def written(frames, order="<"):
    """A TIFF file of one strip a page."""
    out, place = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 8)), 8
    for k, f in enumerate(frames):
        data = f.astype(f"{order}u2").tobytes()
        tags = [(256, 3, f.shape[1]), (257, 3, f.shape[0]), (258, 3, 16), (259, 3, 1), (273, 4, place + 2 + 12 * 7 + 4), (277, 3, 1), (279, 4, len(data))]
        out += struct.pack(f"{order}H", len(tags))
        for tag, kind, value in tags:
            out += struct.pack(f"{order}HHI", tag, kind, 1) + (struct.pack(f"{order}HH", value, 0) if kind == 3 else struct.pack(f"{order}I", value))
        place += 2 + 12 * 7 + 4 + len(data)
        out += struct.pack(f"{order}I", place if k + 1 < len(frames) else 0) + data
    return bytes(out)


def test_tiff_movies(spark, tmp_path):
    rng = np.random.default_rng(0)
    frames = rng.integers(0, 60000, (7, 3, 4))
    (tmp_path / "a.tif").write_bytes(written(frames[:4]))
    (tmp_path / "b.tif").write_bytes(written(frames[4:], ">"))
    d = tiff.read_frames(spark, str(tmp_path))
    assert sorted((r["height"], r["width"], r["frames"]) for r in tiff.size_of(d).collect()) == [(3, 4, 3), (3, 4, 4)]
    got = {(r["r"], r["c"], r["pix"]): r["y"] for r in tiff.to_pixels(tiff.one_movie(d)).collect()}
    assert got == {(r, c, c * 3 + r): frames[:, r, c].tolist() for r in range(3) for c in range(4)}
    assert sorted(r["t"] for r in tiff.read_frames(spark, str(tmp_path / "a.tif"), 2, 2).collect()) == [2, 3]


def test_commands(spark):
    f = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 2, 3.0), (3, 9, 1.0)], "neuron long, pix long, val double")
    mask = spark.createDataFrame([(2,)], "pix long")
    rows = lambda d: sorted(tuple(r) for r in d.select("neuron", "pix", "val").collect())
    assert rows(commands.delete(f, [1, 3])) == [(2, 2, 3.0)]
    assert rows(commands.merge(f, [1, 2])) == [(1, 1, 1.0), (1, 2, 5.0), (3, 9, 1.0)]
    assert rows(commands.trim(f, 1, mask)) == [(1, 2, 2.0), (2, 2, 3.0), (3, 9, 1.0)]
    assert rows(commands.split(f, 1, mask, 7)) == [(1, 1, 1.0), (2, 2, 3.0), (3, 9, 1.0), (7, 2, 2.0)]


def test_blocks_are_written_once_and_pruned(spark, tmp_path):
    from glimmer.operators import layout

    pixels, _ = movie(spark, 16, 5)
    d = layout.distribute(pixels, str(tmp_path / "m"), 16, 8, 2).where("patch < 4")
    assert d.count() == 400
    again = layout.distribute(pixels.limit(0), str(tmp_path / "m"), 16, 8, 2)
    assert again.where("patch = 1 and inside").count() == 64
    assert "PartitionFilters: [isnotnull(patch" in again.where("patch = 1")._jdf.queryExecution().toString()


def test_histogram_baseline_and_periodogram_noise():
    from glimmer.functions import kernels as K

    y = 3 + 0.5 * np.random.default_rng(1).standard_normal(4000)
    y[::40] += 8
    assert K.histogram_baseline(y) == pytest.approx((3, 0.5), abs=0.08)
    assert K.periodogram_noise(np.random.default_rng(0).standard_normal(4096))[0] == pytest.approx(np.exp(-0.5772 / 2), abs=0.05)


def test_splines_add_up_to_one():
    from glimmer.functions.basis import b_splines

    b = b_splines(50, 6)
    assert b.shape == (50, 8)
    assert b.sum(1) == pytest.approx(np.ones(50))


def test_large_tiff_and_written_tiff(spark, tmp_path):
    frames = np.random.default_rng(0).integers(0, 60000, (3, 2, 5))
    out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16))
    for k, f in enumerate(frames):
        data = f.astype("<u2").tobytes()
        place = len(out)
        tags = [(256, 5), (257, 2), (258, 16), (259, 1), (273, place + 8 + 20 * 7 + 8), (277, 1), (279, len(data))]
        out += struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", t, 16, 1, v) for t, v in tags)
        out += struct.pack("<Q", len(out) + 8 + len(data) if k < 2 else 0) + data
    assert [p[2].reshape(2, 5).tolist() for p in tiff.pages(bytes(out))] == frames.tolist()
    (tmp_path / "a.tif").write_bytes(bytes(out))
    again = tiff.written(tiff.read_frames(spark, str(tmp_path))).collect()[0]["content"]
    assert [p[2].reshape(2, 5).tolist() for p in tiff.pages(bytes(again))] == frames.tolist()


def test_synthetic_traces_are_deconvolved(spark):
    from glimmer.operators import deconvolution
    from glimmer.sources import synthetic

    one = synthetic.traces(spark, 3, frames=600, noise=0.2)
    two = synthetic.traces(spark, 3, (1.5, -0.55), 0.1, 400, wave=True)
    for d, options in ((one, {"g": 0.95}), (two, {"model": "ar2", "g2": [1.5, -0.55]})):
        got = deconvolution.deconvolved(d, "trace_id", "constrained", **options).join(d, "trace_id").collect()
        for r in got:
            assert np.corrcoef(r["c"], r["true_c"])[0, 1] > 0.9
    assert sorted(r["trace_id"] for r in synthetic.traces(spark, 5, frames=10).repartition(3).collect()) == [1, 2, 3, 4, 5]


def one_photon(spark, size=24, frames=300):
    """Sources on a wide, slowly changing background, with a second image of one of them."""
    rng = np.random.default_rng(8)
    centres = [(6, 6), (6, 17), (17, 8), (16, 17)]
    traces = [3 * np.array(np.convolve(rng.random(frames) < 0.03, 0.9 ** np.arange(60))[:frames]) for _ in centres]
    drift = 5 + 2 * np.sin(np.arange(frames) / 30)
    rows = []
    for c in range(size):
        for r in range(size):
            y = drift * (1 + 0.01 * r + 0.02 * c) + 0.1 * rng.standard_normal(frames)
            for (a, b), t in zip(centres, traces, strict=True):
                y += np.exp(-((r - a) ** 2 + (c - b) ** 2) / 8) * t
            rows.append((c * size + r, r, c, y.tolist()))
    return spark.createDataFrame(rows, "pix long, r long, c long, y array<double>"), centres, traces


def test_seeds_of_a_one_photon_movie(spark):
    from glimmer.operators import patches

    movie_, centres, traces = one_photon(spark)
    found = patches.sources(patches.blocks(movie_, 24, 12, 8), 2.0, 7, 0.5, 5).collect()
    for (a, b), t in zip(centres, traces, strict=True):
        near = [r for r in found if abs(r["pix"] % 24 - a) <= 2 and abs(r["pix"] // 24 - b) <= 2]
        assert near
        assert max(np.corrcoef(r["trace"], t)[0, 1] for r in near) > 0.9


@pytest.mark.parametrize("model", ["ring", "svd"])
def test_demixing_finds_footprints_and_traces(spark, model):
    from glimmer.plans import updates

    movie_, centres, traces = one_photon(spark)
    o = Options(gSiz=7, patch=12, min_corr=0.5, min_pnr=5, min_pixel=5, ring_radius=8, background_model=model, nb=1, merge_thr=0.7)
    out = updates.demix(movie_, 24, o, 2.0, rounds=2)
    f, t = out["footprints"].toPandas(), {r["neuron"]: np.array(r["trace"]) for r in out["traces"].collect()}
    assert len(centres) <= len(t) <= 2 * len(centres)
    for (a, b), want in zip(centres, traces, strict=True):
        best = max(t, key=lambda k: np.corrcoef(t[k], want)[0, 1])
        assert np.corrcoef(t[best], want)[0, 1] > 0.9
        mine = f[f["neuron"] == best]
        peak = mine.loc[mine["val"].idxmax(), "pix"]
        assert abs(peak % 24 - a) <= 1 and abs(peak // 24 - b) <= 1
    first = out["background"].toPandas().set_index("pix")["b"]
    assert np.corrcoef(first[0], 5 + 2 * np.sin(np.arange(300) / 30))[0, 1] > 0.9


def test_batches_go_on_from_their_tables(spark, tmp_path):
    from glimmer.plans import updates

    movie_, centres, _ = one_photon(spark)
    o = Options(gSiz=7, patch=24, min_corr=0.5, min_pnr=5, min_pixel=5, ring_radius=8, background_model="svd", nb=1, merge_thr=0.7)
    part = lambda k: movie_.withColumn("y", F.slice("y", 1 + 150 * k, 150))
    one = updates.demix_batches(part, [0], 24, str(tmp_path), o, 2.0)
    n = one["traces"].count()
    assert n >= 3
    both = updates.demix_batches(part, [0, 1], 24, str(tmp_path), o, 2.0)
    assert both["traces"].where("batch = 0").count() == n
    assert {r["neuron"] for r in one["traces"].collect()} <= {r["neuron"] for r in both["traces"].where("batch = 1").collect()} | {r["neuron"] for r in one["traces"].collect()}
    assert both["footprints"].count() > 0


def test_results_and_their_parts(spark, tmp_path):
    from glimmer.sources import results

    f = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.0), (2, 2, 3.0)], "neuron long, pix long, val double")
    results.write(str(tmp_path / "run"), {"footprints": f}, by={"footprints": "neuron"})
    back = results.read(spark, str(tmp_path / "run"), "footprints")
    assert sorted((r["neuron"], r["pix"], r["val"]) for r in back.collect()) == [(1, 1, 1.0), (1, 2, 0.0), (2, 2, 3.0)]
    assert results.compressed(f).count() == 2
    assert results.subset({"f": f, "other": f.select("pix")}, f.where("neuron = 2"))["f"].count() == 1
    for k in range(2):
        results.audit(str(tmp_path / "run"), "merge", spark.createDataFrame([(k, "1,2")], "label long, members string"))
    assert results.read(spark, str(tmp_path / "run"), "audit").count() == 2
    assert results.existing(spark, [str(tmp_path), str(tmp_path), str(tmp_path / "no")]) == [str(tmp_path)]


def test_images():
    from glimmer.functions import images

    stack = np.random.default_rng(0).standard_normal((9, 8, 50))
    z = (stack - stack.mean(-1, keepdims=True)) / stack.std(-1, keepdims=True)
    want = np.mean([(z[4, 4] * z[4 + i, 4 + j]).mean() for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    assert images.neighbour_correlation(stack)[4, 4] == pytest.approx(want)
    psf = images.centred_psf(1.0)
    assert psf.sum() == pytest.approx(0, abs=1e-12)
    flat = images.filtered(np.ones((7, 7, 2)), psf)
    assert flat == pytest.approx(np.zeros((7, 7, 2)), abs=1e-12)
    mask = np.zeros((8, 8), bool)
    mask[0:2, 0:2] = mask[5:8, 5:8] = mask[2, 2] = True
    assert len(np.unique(images.regions(mask))) == 4
    assert len(np.unique(images.regions(mask, diagonal=True))) == 3
    r, c = np.mgrid[:15, :15]
    spot = np.exp(-((r - 7) ** 2 + (c - 7) ** 2) / 8)
    other = spot + 0.8 * ((r == 1) & (c == 13))
    assert images.connected(other)[1, 13] == 0
    assert images.connected(other)[7, 7] == other[7, 7]
    assert images.convex(np.where(spot > 0.05, other, 0))[1, 13] == 0
    assert images.most_energy(other, 0.9)[1, 13] == 0


@pytest.mark.parametrize("score", ["energy", "corr"])
def test_rank_one_sources_are_the_planted_ones(spark, score):
    from glimmer.operators import patches

    pixels, centres = movie(spark, 16, 200)
    truth = {r["pix"]: np.array(r["y"]) for r in pixels.collect()}
    found = patches.rank_one_sources(patches.blocks(pixels, 16, 16, 0), 1.5, 4, 2, score).collect()
    assert len(found) == 2
    for centre in centres:
        best = max(np.corrcoef(r["trace"], truth[centre])[0, 1] for r in found)
        assert best > 0.9


def test_neighbour_weights_add_up_to_one(spark):
    from glimmer.operators import patches

    t = np.sin(np.arange(60) / 5)
    rows = [(c * 12 + r, r, c, ((1 + 0.05 * r + 0.02 * c) * t).tolist()) for c in range(12) for r in range(12)]
    w = patches.neighbour_weights(patches.blocks(spark.createDataFrame(rows, "pix long, r long, c long, y array<double>"), 12, 12, 0), 2, 3).toPandas()
    assert w.groupby("pix")["w"].sum().to_numpy() == pytest.approx(np.ones(144), abs=1e-4)
    one, y = w[w["pix"] == 65], {r[0]: np.array(r[3]) for r in rows}
    assert sum(v * y[q] for q, v in zip(one["nbr_pix"], one["w"], strict=True)) == pytest.approx(y[65], abs=0.05)


def test_footprints_of_patches_are_those_pixel_by_pixel(spark):
    # Many regions meet in each pixel: rows for pairs of labels grew with the square of their number.
    rng = np.random.default_rng(8)
    t = rng.standard_normal((12, 40)).cumsum(1)
    movie = spark.createDataFrame([(int(c * 9 + r), int(r), int(c), [float(v) for v in rng.standard_normal(40) + t[(r + c) % 12]]) for c in range(13) for r in range(9)], "pix long, r long, c long, y array<double>")
    traces = spark.createDataFrame([(k, [float(v) for v in t[k]]) for k in range(12)], "label long, trace array<double>")
    near = [(p, k) for p in range(117) for k in range(12) if (p * 7 + k * 5) % 4]
    region = spark.createDataFrame(near, "pix long, label long")
    start = spark.createDataFrame([(p, k, 0.5) for p, k in near if (p + k) % 3 == 0], "pix long, label long, a double")
    got = patches.spatial_descent(movie, region, traces, start, 9, 4)
    want = patches.spatial_update(C.spatial_sums(movie, region, traces), C.gram(traces, C.region_pairs(region)), "hals", start=start)
    values = lambda d: {(r["pix"], r["label"]): r["a"] for r in d.collect()}
    got, want = values(got), values(want)
    assert {k for k, v in want.items() if v > 2e-6} <= got.keys() and {k for k, v in got.items() if v > 2e-6} <= want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in got.keys() & want.keys())


def test_footprints_in_ellipses_are_those_of_the_search_region(spark):
    from glimmer.plans.updates import search_region

    rng = np.random.default_rng(9)
    movie = spark.createDataFrame([(int(c * 21 + r), int(r), int(c), [float(v) for v in rng.standard_normal(30).cumsum()]) for c in range(40) for r in range(21)], "pix long, r long, c long, y array<double>")
    found = [(k, int(c * 21 + r), int(r), int(c), float(rng.random() + 0.1)) for k in range(15) for r, c in {(int(min(20, k + a)), int(min(39, 2 * k + b))) for a, b in rng.integers(0, 4, (6, 2))}]
    footprints = spark.createDataFrame(found, "neuron long, pix long, r long, c long, val double")
    traces = spark.createDataFrame([(k, [float(v) for v in rng.standard_normal(30).cumsum()]) for k in range(15)], "label long, trace array<double>")
    start = footprints.select("pix", F.col("neuron").alias("label"), F.col("val").alias("a"))
    want = patches.spatial_descent(movie, search_region(footprints, movie, 1, 2, 3), traces, start, 21, 4)
    got = patches.spatial_descent_in_ellipses(movie, C.search_ellipses(footprints, 1, 2).withColumnRenamed("neuron", "label"), 3, traces, start, 21, 4)
    values = lambda d: {(r["pix"], r["label"]): r["a"] for r in d.collect()}
    got, want = values(got), values(want)
    assert len(want) > 100 and got == pytest.approx(want, abs=2e-6)


def test_footprints_take_no_row_for_each_pixel_of_a_region(spark, monkeypatch):
    from glimmer.plans import updates

    monkeypatch.setattr(updates, "search_region", lambda *a: pytest.fail("a row for each pixel and region"))
    movie = spark.createDataFrame([(int(c * 9 + r), int(r), int(c), [float(r + c), 0.0, 1.0, float(c)]) for c in range(9) for r in range(9)], "pix long, r long, c long, y array<double>")
    footprints = spark.createDataFrame([(7, 40 + k, 1.0) for k in (-9, -1, 0, 1, 9)], "neuron long, pix long, val double")
    traces = spark.createDataFrame([(7, [8.0, 0.0, 1.0, 4.0])], "neuron long, trace array<double>")
    found = updates.update_spatial(movie, footprints, traces, 9, Options(patch=4), shape=None)
    assert found.count() > 50
