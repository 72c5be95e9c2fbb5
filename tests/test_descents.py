"""Products with ring weights, descent by turns, known footprints, merges: against plain matrices and planted movies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.functions import kernels as K
from glimmer.operators import deconvolution, descent, neighbours, patches
from glimmer.operators.shared import cut
from glimmer.options import Options
from glimmer.plans import descents, updates
from tests.sql import DATA, differences, views
from tests.test_extraction import one_photon

SF = f"{DATA}/sf0.001"
O = Options(patch=6, ring_radius=3)
FOOT, PIX = "neuron long, pix long, val double", "pix long, r long, c long, y array<double>"


def small_movie(spark, size=12, frames=50, seed=2):
    rng = np.random.default_rng(seed)
    y = rng.random((size * size, frames))
    rows = [(c * size + r, r, c, y[c * size + r].tolist()) for c in range(size) for r in range(size)]
    return spark.createDataFrame(rows, PIX).repartition(3), y


def spots(size=12, centres=((2, 2), (3, 4), (8, 8), (9, 6), (2, 9))):
    a = np.zeros((size * size, len(centres)))
    for k, (r0, c0) in enumerate(centres):
        for c in range(size):
            for r in range(size):
                d = (r - r0) ** 2 + (c - c0) ** 2
                if d <= 8:
                    a[c * size + r, k] = np.exp(-d / 4)
    return a


def table_of(spark, a, schema=FOOT):
    return spark.createDataFrame([(int(k), int(p), float(a[p, k])) for p, k in zip(*np.nonzero(a), strict=True)], schema)


def matrix(rows, shape):
    out = np.zeros(shape)
    for k, p, v in rows:
        out[p, k] = v
    return out


@pytest.mark.parametrize("name", sorted(descents.SQL))
def test_query_agrees_with_sql(spark, name):
    _, only, types = differences(views(SF), descents.QUERIES[name](spark, SF), descents.SQL[name])
    assert not only
    assert types


@pytest.mark.parametrize("name", sorted(set(descents.QUERIES) - set(descents.SQL)))
def test_query_without_sql(spark, name):
    rows = descents.QUERIES[name](spark, SF).collect()
    assert rows
    if name == "hals_whole":
        values = [r["value"] for r in sorted(rows, key=lambda r: r["round"])]
        assert values == sorted(values, reverse=True)
        assert values[-1] < values[0]


def test_products_agree_with_matrices(spark):
    movie, y = small_movie(spark)
    a = spots()
    f, w = table_of(spark, a), neighbours.ring_weights(movie, 3, 4)
    full = np.zeros((144, 144))
    for r in w.collect():
        full[r["pix"], r["nbr_pix"]] = r["w"]
    left = descent.without_ring(f, w)
    assert matrix([tuple(r) for r in left.collect()], a.shape) == pytest.approx(a - full @ a)
    right = descent.without_ring_transposed(left, w)
    want = (np.eye(144) - full).T @ (a - full @ a)
    assert matrix([tuple(r) for r in right.collect()], a.shape) == pytest.approx(want)
    u = {r["neuron"]: r["u"] for r in descent.projected(movie, right, 12, 6, frames=7).collect()}
    assert np.array([u[k] for k in range(5)]) == pytest.approx((a - full @ a).T @ (y - full @ y))
    g = {(r["a"], r["b"]): r["v"] for r in descent.footprint_gram(left).collect()}
    v = (a - full @ a).T @ (a - full @ a)
    assert all(g.get((i, j), 0.0) == pytest.approx(v[i, j], abs=1e-12) for i in range(5) for j in range(5))


def serial(u, v, order, rounds, rule):
    c, seen = np.zeros_like(u), []
    for _ in range(rounds):
        for k in order:
            c[k] += (u[k] - v[k] @ c) / v[k, k]
            c[k] = np.maximum(c[k], 0) if rule == "clip" else c[k] - c[k].min() if rule == "shift" else c[k]
        seen.append(float((c * (v @ c)).sum() - 2 * (u * c).sum()))
    return c, seen


@pytest.mark.parametrize(("rule", "links"), [("clip", 0), ("shift", 0), ("clip", 1000), ("shift", 1000), ("free", 1000)])
def test_turns_give_what_a_serial_sweep_gives(spark, monkeypatch, rule, links):
    movie, y = small_movie(spark)
    a = spots()
    f = table_of(spark, a)
    gram = descent.footprint_gram(f)
    turns = descent.turns_of(gram)
    order = [r["id"] for r in sorted(turns.collect(), key=lambda r: (r["turn"], r["id"]))]
    assert turns.agg(F.max("turn")).head()[0] < 5  # some move together
    monkeypatch.setattr(descent, "FRAME_VALUES", 35)  # seven frames a task
    got = descent.temporal_sweeps(descent.projected(movie, f, 12, 6), gram, rounds=3, rule=rule, most_links=links)
    want, seen = serial(a.T @ (y - 0), a.T @ a, order, 3, rule)
    found = {r["neuron"]: r["trace"] for r in got.collect()}
    assert np.array([found[k] for k in range(5)]) == pytest.approx(want)
    if rule != "shift":
        assert seen == sorted(seen, reverse=True)


def test_a_component_without_energy_is_left_out(spark):
    movie, _ = small_movie(spark, frames=5)
    f = spark.createDataFrame([(1, 5, 1.0), (2, 7, 0.0)], FOOT)
    gram = descent.footprint_gram(f)
    for links in (0, 1000):
        got = descent.temporal_sweeps(descent.projected(movie, f, 12, 6), gram, rounds=1, most_links=links)
        assert [r["neuron"] for r in got.collect()] == [1]
    nothing = f.limit(0)
    assert descent.temporal_sweeps(descent.projected(movie, nothing, 12, 6), descent.footprint_gram(nothing), rounds=1).count() == 0


def test_sweeps_end_by_themselves_at_the_same_place(spark):
    rng = np.random.default_rng(3)
    a, frames = spots(), 40
    y = a @ np.maximum(0, rng.standard_normal((5, frames))) + 0.1 * rng.standard_normal((144, frames))
    movie = spark.createDataFrame([(q * 12 + r, r, q, y[q * 12 + r].tolist()) for q in range(12) for r in range(12)], PIX)
    foot = table_of(spark, a)
    u, v = cut(descent.projected(movie, foot, 12, 6)), cut(descent.footprint_gram(foot))
    far = spark.createDataFrame([(k, (10 * rng.random(frames)).tolist()) for k in range(4)], "neuron long, trace array<double>")
    ends = []
    for start in (None, far):
        traces, changes = descent.converged_sweeps(u, v, start, tolerance=1e-6)
        change = [r["change"] for r in changes.orderBy("sweep").collect()]
        assert change[-1] <= 1e-6 < min(change[:-1]) and len(change) < 100
        ends.append(np.array([r["trace"] for r in traces.orderBy("neuron").collect()]))
    assert ends[0] == pytest.approx(ends[1], abs=1e-4)
    slope = a.T @ (a @ ends[0] - y)  # the conditions of the optimum
    assert (slope > -1e-3).all() and (np.abs(slope[ends[0] > 1e-6]) < 1e-3).all()
    few, changes = descent.converged_sweeps(u, v, tolerance=0.0, most=2)
    assert changes.count() == 2
    assert descent.converged_sweeps(u.limit(0), v.limit(0))[0].count() == 0


def test_turns_of_a_small_matrix_are_those_of_the_joins(spark):
    gram = descent.footprint_gram(table_of(spark, spots()))
    rows = gram.select("a", "b", "v", F.xxhash64("a").alias("h")).collect()
    assert descent._turns_here(rows) == {r["id"]: r["turn"] for r in descent.turns_of(gram).collect()}


def test_alternation_falls_and_drops_what_is_empty(spark):
    rng = np.random.default_rng(0)
    a, frames = spots(), 60
    c = np.array([np.convolve(rng.random(frames) < 0.1, 0.8 ** np.arange(20))[:frames] for _ in range(5)])
    b, f = 1 + 0.3 * rng.random(144), 2 + np.sin(np.arange(frames) / 9)
    y = a @ c + np.outer(b, f) + 0.02 * rng.standard_normal((144, frames))
    rows = [(q * 12 + r, r, q, y[q * 12 + r].tolist()) for q in range(12) for r in range(12)]
    movie = spark.createDataFrame(rows, PIX)
    rough = np.where(a > 0, 0.5 + 0.5 * a, 0)
    more = np.hstack([rough, np.zeros((144, 1))])
    more[100, 5] = 0.0
    foot = table_of(spark, more).unionByName(spark.createDataFrame([(5, 100, 0.0)], FOOT))
    traces = spark.createDataFrame([(k, np.maximum(0, c[k] + 0.3).tolist()) for k in range(5)] + [(5, [1.0] * frames)], "neuron long, trace array<double>")
    back = spark.createDataFrame([(0, p, 1.0) for p in range(144)], "j long, pix long, val double")
    out = descents.alternate(movie, foot, traces, back, spark.createDataFrame([(0, [2.0] * frames)], "j long, trace array<double>"), 12, O, rounds=2, sweeps=3)
    values = [r["value"] for r in out["objective"].orderBy("round").collect()]
    assert values == sorted(values, reverse=True)
    assert values[-1] < 0.05 * values[0]
    # The same, one component and one pixel after the other.
    order = [r["id"] for r in sorted(descent.turns_of(descent.footprint_gram(table_of(spark, rough))).collect(), key=lambda r: (r["turn"], r["id"]))]
    pa, pc, pb, pf = rough.copy(), np.maximum(0, c + 0.3), np.ones(144), np.full(frames, 2.0)
    want = [((y - pa @ np.maximum(0, c + 0.3) - np.outer(pb, pf)) ** 2).sum()]
    for _ in range(2):
        pc = swept(pa.T @ (y - np.outer(pb, pf)), pa.T @ pa, pc, order, 3)
        rest = y - np.outer(pb, pf)
        for p in range(144):
            k = np.flatnonzero(rough[p])
            if len(k):
                pa[p, k] = np.round(K.hals((pc[k] @ rest[p])[:, None], pc[k] @ pc[k].T, pa[p, k][:, None])[:, 0], 6)
        rest = y - pa @ pc
        pf = swept((pb @ rest)[None], np.array([[pb @ pb]]), pf[None], [0], 3)[0]
        pb = np.round(np.maximum(0, rest @ pf / (pf @ pf)), 6)
        want.append(((y - pa @ pc - np.outer(pb, pf)) ** 2).sum())
    assert values[1:] == pytest.approx(want[1:], rel=1e-3)
    found = {r["neuron"]: np.array(r["trace"]) for r in out["traces"].collect()}
    assert set(found) == set(range(5))
    assert np.array([found[k] for k in range(5)]) == pytest.approx(pc, abs=1e-2)
    assert np.array(out["factors"].head()["trace"]) == pytest.approx(pf, rel=1e-2)
    assert np.corrcoef(pf, f)[0, 1] > 0.95


def swept(u, v, c, order, rounds):
    c = c.copy()
    for _ in range(rounds):
        for k in order:
            c[k] = np.maximum(0, c[k] + (u[k] - v[k] @ c) / v[k, k])
    return c


def planted(spark):
    """Known footprints on a background that the ring model holds."""
    movie, centres, traces = one_photon(spark)
    rows = [(k, c * 24 + r, float(np.exp(-((r - a) ** 2 + (c - b) ** 2) / 8))) for k, (a, b) in enumerate(centres) for c in range(24) for r in range(24) if (r - a) ** 2 + (c - b) ** 2 <= 49]
    return movie, spark.createDataFrame(rows, FOOT), traces


def test_known_footprints_through_ring_weights_give_planted_traces(spark):
    movie, f, traces = planted(spark)
    o = Options(patch=12, ring_radius=8)
    start = spark.createDataFrame([], "neuron long, trace array<double>")
    w = neighbours.ring_weights(movie, 8, 9)
    for weights in (w, descents.fit_ring(movie, f, start, 24, o, w, clip=3.0)[0]):
        got = descents.initial_traces(movie, f, 24, o, weights, rounds=5).collect()
        for r in got:
            assert np.corrcoef(r["c_raw"], traces[r["neuron"]])[0, 1] > 0.95
            assert np.polyfit(traces[r["neuron"]], r["c_raw"], 1)[0] == pytest.approx(1, abs=0.15)
        assert len(got) == 4


@pytest.mark.parametrize("method", ["svd", "nmf"])
def test_known_footprints_with_known_background_components(spark, method):
    movie, f, traces = planted(spark)
    level = movie.select(F.lit(0).alias("j"), "pix", (1 + 0.01 * F.col("r") + 0.02 * F.col("c")).alias("val"))
    got = descents.known_footprints(movie, f, 24, Options(patch=12), background=level, method=method, rounds=4).collect()
    for r in got:
        assert np.corrcoef(r["trace"], traces[r["neuron"]])[0, 1] > 0.97
    assert len(got) == 4


def test_ring_product_and_reconstruction_agree_with_matrices(spark):
    movie, y = small_movie(spark)
    w = neighbours.ring_weights(movie, 3, 4)
    full = np.zeros((144, 144))
    for r in w.collect():
        full[r["pix"], r["nbr_pix"]] = r["w"]
    a = spots()
    c = np.random.default_rng(1).random((5, 50))
    traces = spark.createDataFrame([(k, c[k].tolist()) for k in range(5)], "neuron long, trace array<double>")
    got = {r["pix"]: r["b"] for r in descents.reconstructed_background(movie, table_of(spark, a), traces, w, 12, O).collect()}
    rest = y - a @ c
    b0 = rest.mean(1, keepdims=True)
    assert np.array([got[p] for p in range(144)]) == pytest.approx(full @ (rest - b0) + b0)


def test_clipped_ring_fit_is_not_led_by_events(spark):
    """A pixel follows its ring but for large events, which the plain fit gives to some neighbours."""
    rng = np.random.default_rng(3)
    drift = np.cumsum(rng.standard_normal(400)) * 0.1
    rows, truth = [], {}
    for c in range(12):
        for r in range(12):
            y = drift + 0.05 * rng.standard_normal(400)
            truth[c * 12 + r] = y.copy()
            if (r, c) == (6, 6):
                y = y + 6.0 * (rng.random(400) < 0.04)
            rows.append((c * 12 + r, r, c, y.tolist()))
    movie = spark.createDataFrame(rows, PIX)
    blocks = patches.blocks(movie, 12, 12, 0)
    w = neighbours.ring_weights(movie, 3, 4)
    fits = {}
    for clip in (None, 3.0):
        fitted = patches.fitted_ring_weights(blocks, w, clip, deconvolution.noise(movie, "pix"), most=5)
        back = {r["pix"]: np.array(r["b"]) for r in patches.ring_product(blocks, fitted).where("pix = 78").collect()}[78]
        z = truth[78] - truth[78].mean()
        fits[clip] = float(((back - back.mean() - z) ** 2).mean())
        assert fitted.where("pix = 78").count() == w.where("pix = 78").count()
    assert fits[3.0] < fits[None]
    assert fits[3.0] < 0.01


def test_merged_parts_keep_the_model(spark):
    """Two overlapping parts of one trace, one ten times as bright: the sum of what they explain stays."""
    rng = np.random.default_rng(1)
    c = np.convolve(rng.random(200) < 0.05, 0.9 ** np.arange(40))[:200]
    one, two = np.zeros(30), np.zeros(30)
    one[5:15], two[10:20] = 10.0, 1.0
    f = spark.createDataFrame([(k, int(p), float(v[p])) for k, v in ((1, one), (2, two), (3, np.roll(one, 15))) for p in np.flatnonzero(v)], FOOT)
    other = rng.random(200)
    t = spark.createDataFrame([(1, c.tolist()), (2, (c + 0.01 * rng.standard_normal(200)).tolist()), (3, other.tolist())], "neuron long, trace array<double>")
    nf, nt = updates.merged(f, t, Options(merge_thr=0.8))
    found = {r["neuron"]: np.array(r["trace"]) for r in nt.collect()}
    assert set(found) == {1, 3}
    got = {r["pix"]: r["val"] * found[1] for r in nf.where("neuron = 1").collect()}
    for p in range(5, 20):
        assert got[p] == pytest.approx((one[p] + two[p]) * c, abs=0.2)
    assert {tuple(r) for r in nf.where("neuron = 3").collect()} == {tuple(r) for r in f.where("neuron = 3").collect()}
    assert found[3].tolist() == other.tolist()


def test_demixing_keeps_the_scale_of_a_split_source(spark):
    """A long source whose far part is ten times as weak: what the components say of a pixel is what was planted."""
    rng = np.random.default_rng(4)
    size, frames = 20, 250
    c = 4 * np.convolve(rng.random(frames) < 0.04, 0.9 ** np.arange(50))[:frames]
    a = np.zeros((size * size,))
    rows = []
    for col in range(size):
        for r in range(size):
            a[col * size + r] = np.exp(-((r - 8) ** 2 + (col - 8) ** 2) / 6) + 0.1 * np.exp(-((r - 12) ** 2 + (col - 12) ** 2) / 6)
            rows.append((col * size + r, r, col, (a[col * size + r] * c + 2 + 0.02 * rng.standard_normal(frames)).tolist()))
    o = Options(gSiz=6, patch=20, min_corr=0.5, min_pnr=4, min_pixel=5, background_model="svd", nb=0, merge_thr=0.7)
    out = updates.demix(spark.createDataFrame(rows, PIX), size, o, 1.8, rounds=1)
    said = {r["pix"]: np.array(r["ac"]) for r in updates.model(out["footprints"], out["traces"]).collect()}
    peak = int(a.argmax())
    assert np.polyfit(c, said[peak], 1)[0] == pytest.approx(a[peak], rel=0.15)
    weak = 12 * size + 12
    if weak in said:
        assert np.polyfit(c, said[weak], 1)[0] == pytest.approx(a[weak], abs=0.1)
    energy = sum(float(x @ x) for x in said.values())
    assert energy == pytest.approx(float((a @ a) * (c @ c)), rel=0.25)


# Resampling


def plain_taps(n, m, method):
    out = np.zeros((m, n))
    for o in range(m):
        u, wide = (o + 0.5) * n / m - 0.5, max(n / m, 1.0) if method == "cubic" else 1.0
        for i in range(-4 * n, 5 * n):
            x = (u - i) / wide
            if method == "nearest":
                w = float(-0.5 <= x < 0.5)
            else:
                x = abs(x)
                w = 1.5 * x**3 - 2.5 * x**2 + 1 if x <= 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x <= 2 else 0.0
            k = i % (2 * n)
            out[o, k if k < n else 2 * n - 1 - k] += w
    return out / out.sum(1, keepdims=True)


@pytest.mark.parametrize("method", ["cubic", "nearest"])
@pytest.mark.parametrize(("n", "m"), [(10, 5), (9, 5), (5, 9), (4, 4), (3, 1), (1, 3), (7, 2)])
def test_taps(spark, n, m, method):
    from glimmer.operators import resampling

    got = np.zeros((m, n))
    for r in resampling.taps(spark.createDataFrame([(n, m)], "n long, m long"), method).collect():
        got[r["o"], r["i"]] = r["w"]
    assert got == pytest.approx(plain_taps(n, m, method), abs=1e-12)


def test_resizing_agrees_with_matrices_and_keeps_a_smooth_image(spark):
    from glimmer.operators import resampling

    r, c = np.mgrid[:12, :10]
    image = np.stack([np.sin(r / 5) + np.cos(c / 6), r + 2.0 * c], -1)
    d = spark.createDataFrame([(int(i), int(j), image[i, j].tolist()) for i in range(12) for j in range(10)], "r long, c long, y array<double>")
    small = resampling.resized(d, (12, 6), (10, 5))
    got = np.zeros((6, 5, 2))
    for x in small.collect():
        got[x["r"], x["c"]] = x["y"]
    want = np.einsum("ai,bj,ijt->abt", plain_taps(12, 6, "cubic"), plain_taps(10, 5, "cubic"), image)
    assert got == pytest.approx(want)
    back = np.zeros(image.shape)
    for x in resampling.resized(small, (6, 12), (5, 10)).collect():
        back[x["r"], x["c"]] = x["y"]
    assert back[3:-3, 3:-3] == pytest.approx(image[3:-3, 3:-3], abs=0.05)


def test_coarse_background_agrees_with_the_fine_one_where_it_is_smooth(spark):
    rng = np.random.default_rng(5)
    frames, size = 150, 24
    drift = np.cumsum(rng.standard_normal((2, frames)), 1) * 0.2
    rows = []
    for c in range(size):
        for r in range(size):
            y = 5 + drift[0] * (1 + 0.3 * np.sin(r / 9)) + drift[1] * np.cos(c / 8) + 0.02 * rng.standard_normal(frames)
            rows.append((c * size + r, r, c, y.tolist()))
    movie = spark.createDataFrame(rows, PIX)
    f, t = spark.createDataFrame([], FOOT), spark.createDataFrame([], "neuron long, trace array<double>")
    found = {}
    for by in (1, 2):
        o = Options(patch=12, ring_radius=6, background_model="ring", bg_ssub=by)
        w, b0 = descents.fit_ring(movie, f, t, size, o)
        w = w.cache()
        found[by] = {r["pix"]: np.array(r["b"]) for r in descents.reconstructed_background(movie, f, t, w, size, o).collect()}
        assert w.select("pix").distinct().count() == (size // by) ** 2
        assert len(found[by]) == size * size
        assert {tuple(r) for r in updates.update_background(movie, f, t, size, o).select("pix").collect()} == {(p,) for p in range(size * size)}
    fine, coarse = (np.array([found[k][p] for p in range(size * size)]) for k in (1, 2))
    assert np.abs(fine - coarse).mean() < 0.1 * fine.std(1).mean()
    # Weights of another grid are not gone on with.
    again, _ = descents.fit_ring(movie, f, t, size, Options(patch=12, ring_radius=6, bg_ssub=1), w)
    assert again.select("pix").distinct().count() == size * size


# Merges to the end, and the background of all patches


def test_merges_go_on_to_the_end(spark):
    """A chain of parts: neighbours alike, and what a merge makes like the next."""
    rng = np.random.default_rng(6)
    c = np.convolve(rng.random(300) < 0.05, 0.9 ** np.arange(40))[:300]
    other = np.convolve(rng.random(300) < 0.05, 0.9 ** np.arange(40))[:300]
    a = np.zeros((40, 5))
    for k in range(4):
        a[4 * k : 4 * k + 8, k] = 1.0
    a[30:38, 4] = 2.0
    traces = [c + 0.02 * rng.standard_normal(300) for _ in range(4)] + [other]
    t = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(traces)], "neuron long, trace array<double>")
    from glimmer.plans import extraction

    f, t = extraction.merged_to_the_end(table_of(spark, a), t, Options(merge_thr=0.8))
    found = {r["neuron"]: np.array(r["trace"]) for r in t.collect()}
    assert set(found) == {0, 4}
    said = np.zeros((40, 300))
    for r in f.collect():
        said[r["pix"]] += r["val"] * found[r["neuron"]]
    assert said == pytest.approx(a @ np.array([c, c, c, c, other]), abs=0.4)


def test_rank_one_background_of_patches(spark):
    from glimmer.plans import extraction

    rng = np.random.default_rng(7)
    b, f = 1 + rng.random(40), 2 + np.sin(np.arange(80) / 7)
    scales = [1.0, 3.0, 0.5, 2.0]
    back = spark.createDataFrame([(k, 10 * k + i, float(b[10 * k + i] * s)) for k, s in enumerate(scales) for i in range(10)], "k long, pix long, val double")
    factors = spark.createDataFrame([(k, (f / s).tolist()) for k, s in enumerate(scales)], "k long, trace array<double>")
    got, factor = extraction.rank_one_background(back, factors, 4)
    g = np.array(factor.head()["trace"])
    assert np.outer([r["val"] for r in sorted(got.collect(), key=lambda r: r["pix"])], g) == pytest.approx(np.outer(b, f))


def test_extraction_by_patches_finds_sources_and_background(spark):
    from glimmer.plans import extraction

    movie, centres, traces = one_photon(spark)
    o = Options(gSiz=7, patch=12, min_corr=0.5, min_pnr=5, min_pixel=5, background_model="svd", nb=1, merge_thr=0.7)
    out = extraction.by_patches(movie, 24, o, 2.0)
    found = {r["neuron"]: np.array(r["trace"]) for r in out["traces"].collect()}
    assert len(centres) <= len(found) <= len(centres) + 2
    for want in traces:
        assert max(np.corrcoef(x, want)[0, 1] for x in found.values()) > 0.9
    assert np.corrcoef(out["factor"].head()["trace"], 5 + 2 * np.sin(np.arange(300) / 30))[0, 1] > 0.95
    assert out["background"].count() == 576
