import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glimmer.functions import kernels as K
from glimmer.operators import deconvolution, graph, layout, patches, stats
from glimmer.plans import kernels as plans
from tests.sql import DATA


def planted(n=400, g=0.95, noise=0.1, seed=1):
    rng = np.random.default_rng(seed)
    s = (rng.random(n) < 0.02) * 1.0
    c = np.zeros(n)
    for t in range(n):
        c[t] = (g * c[t - 1] if t else 0) + s[t]
    return c, s, c + noise * rng.standard_normal(n)


@given(st.lists(st.floats(-3, 3), min_size=1, max_size=60), st.floats(0.1, 0.98), st.floats(0, 1))
@settings(max_examples=60, deadline=None)
def test_pools_obey_the_constraint(y, g, smin):
    c = K.decay(K.pools_ar1(np.array(y), g, 0.0, smin), g, len(y))
    jump = c[1:] - g * c[:-1]
    assert (jump > -1e-9).all()
    assert (c >= 0).all()


def test_pools_reach_the_least_squares_optimum():
    _, _, y = planted(40, 0.9)
    h = np.array([[0.9 ** (i - j) if i >= j else 0 for j in range(40)] for i in range(40)])
    s = K.nnls(h.T @ h, h.T @ y)
    c = K.decay(K.pools_ar1(y, 0.9), 0.9, 40)
    assert ((y - c) ** 2).sum() == pytest.approx(((y - h @ s) ** 2).sum(), rel=1e-6)


@pytest.mark.parametrize("method", ["constrained", "thresholded"])
def test_deconvolution_finds_planted_calcium(method):
    c, s, y = planted()
    d = K.deconvolve_ar1(y, method, g=0.95, sn=0.1)
    assert np.corrcoef(d["c"], c)[0, 1] > 0.95
    assert ((y - d["b"] - d["c"]) ** 2).sum() <= 0.1**2 * len(y) * 1.1


def test_noise_level():
    y = np.random.default_rng(0).standard_normal((3, 4000)) * np.array([[0.5], [1], [2]])
    assert K.noise_level(y, method="mean") == pytest.approx([0.5, 1, 2], rel=0.1)


def test_time_constant_of_a_planted_trace():
    _, _, y = planted(20000, 0.95, 0.05)
    assert K.ar_coefficients(y, 1, 0.05)[0] == pytest.approx(0.95, abs=0.03)


def test_sliding_nnls_finds_spikes():
    kernel = np.array([0.9**i for i in range(40)])
    s = np.zeros(300)
    s[[20, 90, 150, 240]] = 1, 2, 1, 3
    y = np.convolve(s, kernel)[:300]
    assert K.sliding_nnls(y, kernel, 100, 50) == pytest.approx(s, abs=1e-4)


def test_hals_does_not_increase_the_objective():
    rng = np.random.default_rng(3)
    a, x = rng.random((30, 4)), rng.random((4, 50))
    y = a @ x + 0.01 * rng.standard_normal((30, 50))
    x0 = np.ones((4, 50))
    f = lambda x: ((y - a @ x) ** 2).sum()
    x1 = K.hals(a.T @ y, a.T @ a, x0, 1)
    x3 = K.hals(a.T @ y, a.T @ a, x0, 5)
    assert f(x3) <= f(x1) <= f(x0)
    assert (x3 >= 0).all()


def movie(spark, size=16, frames=120):
    rng = np.random.default_rng(2)
    centres = [(4, 4), (11, 10)]
    traces = [planted(frames, 0.9, 0, seed=k + 5)[0] for k in range(2)]
    rows = []
    for c in range(size):
        for r in range(size):
            y = 0.05 * rng.standard_normal(frames)
            for (r0, c0), t in zip(centres, traces, strict=True):
                y += np.exp(-((r - r0) ** 2 + (c - c0) ** 2) / 4) * t
            rows.append((c * size + r, r, c, y.tolist()))
    return spark.createDataFrame(rows, "pix long, r long, c long, y array<double>"), [c * size + r for r, c in centres]


def test_greedy_seeds_find_planted_sources(spark):
    pixels, centres = movie(spark)
    found = patches.seeds(patches.blocks(pixels, 16, 8, 2), 5, 1.0, 1).toPandas()
    assert set(centres) <= set(found["pix"])


def test_greedy_seeds_go_on_until_the_score_is_low(spark):
    rng = np.random.default_rng(7)
    rows = []
    spots = [(r, c) for r in range(1, 24, 3) for c in range(1, 24, 3)]
    traces = [planted(200, 0.8, 0, seed=100 + k)[0] for k in range(len(spots))]
    for c in range(24):
        for r in range(24):
            y = 0.02 * rng.standard_normal(200)
            k = spots.index((r // 3 * 3 + 1, c // 3 * 3 + 1))
            rows.append((c * 24 + r, r, c, (y + traces[k]).tolist()))
    pixels = spark.createDataFrame(rows, "pix long, r long, c long, y array<double>")
    blocks = patches.blocks(pixels, 24, 8, 2)
    found = patches.seeds(blocks, 2, 1.0).toPandas()
    places = {(p % 24 // 3 * 3 + 1, p // 24 // 3 * 3 + 1) for p in found["pix"]}
    assert len(places) >= 0.9 * len(spots)  # 64 sources in 9 blocks


def test_blocks_hold_each_pixel_inside_once(spark):
    pixels, _ = movie(spark, frames=2)
    m = layout.block_members(pixels, 16, 8, 2).where("patch < 4").toPandas()
    assert sorted(m[m["inside"]]["pix"]) == list(range(256))
    assert len(m) == 4 * 10 * 10
    assert layout.patches(spark, 16, 16, 8, 2).count() == 4


def test_ring_regression_explains_a_smooth_background(spark):
    t = np.sin(np.arange(60) / 5)
    rows = [(c * 12 + r, r, c, ((1 + 0.05 * r + 0.02 * c) * t).tolist()) for c in range(12) for r in range(12)]
    pixels = spark.createDataFrame(rows, "pix long, r long, c long, y array<double>")
    w = patches.ring_weights(patches.blocks(pixels, 12, 12, 0), 2, 3).toPandas()
    y = {r[0]: np.array(r[3]) for r in rows}
    one = w[w["pix"] == 65]
    assert sum(v * y[q] for q, v in zip(one["nbr_pix"], one["w"], strict=True)) == pytest.approx(y[65], abs=0.02)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 51), (60, 60)]
    got = {r["id"]: r["label"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 50: 50, 51: 50}


def test_streamed_frames_agree_with_the_whole_trace(spark):
    got = plans.streamed_calcium(spark, f"{DATA}/sf0.001").toPandas()
    whole = {}
    from glimmer.sources.adapters import traces

    for u, y in traces(spark, f"{DATA}/sf0.001").toPandas().sort_values("t").groupby("user_id")["y"]:
        whole[u] = K.decay(K.pools_ar1(y.to_numpy(), 0.9), 0.9, len(y))
    assert len(got) == sum(map(len, whole.values()))
    assert all(abs(whole[u][t - 1] - c) < 1e-4 for u, t, c in zip(got["user_id"], got["t"], got["c"], strict=True))


def test_streamed_frames_are_all_there(spark):
    from glimmer.sources.adapters import traces

    got = sorted((r["user_id"], r["t"]) for r in plans.streamed_calcium(spark, f"{DATA}/sf0.001").collect())
    assert got == sorted((r["user_id"], r["t"]) for r in traces(spark, f"{DATA}/sf0.001").collect())


@pytest.fixture(scope="module")
def rows(spark):
    from glimmer.sources.adapters import pixels

    return {r["pix"]: np.array(r["y"]) for r in pixels(spark, f"{DATA}/sf0.001").collect()}


def found(spark, name):
    return plans.QUERIES[name](spark, f"{DATA}/sf0.001").collect()


def test_noise_queries_agree_with_plain_periodograms(spark, rows):
    def density(y, size, points):
        w = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(size) / (size - 1))
        parts = [y[a : a + size] * w for a in range(0, len(y) - size + 1, size - size // 2)]
        k = np.arange(points // 2 + 1)
        power = np.mean([np.abs(np.array([np.sum(p * np.exp(-2j * np.pi * j * np.arange(size) / points)) for j in k])) ** 2 for p in parts], 0) / (w @ w)
        return k / points, np.where((k > 0) & (k < points / 2), 2 * power, power)

    got = {r["pix"]: r["sn"] for r in found(spark, "noise_psd")}
    short = {r["pix"]: r["sn"] for r in found(spark, "noise_short_windows")}
    assert len(got) == len(short) == len(rows)
    for pix in list(rows)[:5]:
        f, p = density(rows[pix], 14, 256)
        assert got[pix] == pytest.approx(np.sqrt(np.exp(np.mean(np.log(p[f >= 0.25] / 2)))), abs=2e-6)
        f, p = density(rows[pix], 8, 1000)
        assert short[pix] == pytest.approx(np.sqrt(np.exp(np.mean(np.log(p[f > 0.25] / 2)))), abs=2e-6)


def test_histogram_noise_query(spark, rows):
    got = {r["pix"]: r for r in found(spark, "noise_histogram")}
    for pix, y in rows.items():
        assert got[pix]["baseline"] == pytest.approx(K.histogram_baseline(y)[0], abs=2e-6)
        p = np.abs(np.fft.fft(y)) ** 2 / 64
        f = np.arange(17, 33)  # above a quarter, the last frequency once
        assert got[pix]["sn_plain"] == pytest.approx(np.sqrt(np.exp(np.mean(np.log(np.where(f < 32, 2, 1) * p[f] / 2)))), abs=2e-6)


def test_time_constants_follow_the_rule_for_roots(spark, rows):
    rng = np.random.default_rng(4)
    y = np.zeros(20000)
    for t in range(2, len(y)):
        y[t] = 1.2 * y[t - 1] - 0.52 * y[t - 2] + rng.standard_normal()  # complex stable roots 0.6 +- 0.4i
    g = K.ar_coefficients(y, 2, 0.0)
    assert g == pytest.approx([1.2, -0.36], abs=0.05)  # their real parts, twice
    assert len(K.ar_coefficients(1.01 ** np.arange(300.0), 1, 0.0)) >= 1
    for r in found(spark, "ar_time_constants"):
        roots = np.roots([1, *[-x for x in r["g"]]])
        assert (np.abs(roots) <= 1 + 1e-6).all()


def best(y, kernel, lam):
    """Penalised spikes by projected gradient: another way to the same optimum."""
    n = len(y)
    k = np.array([[kernel[i - j] if 0 <= i - j < len(kernel) else 0 for j in range(n)] for i in range(n)])
    s, step = np.zeros(n), 1 / np.linalg.norm(k.T @ k, 2)
    z, t = s, 1.0
    for _ in range(4000):
        new = np.maximum(0, z - step * (k.T @ (k @ z - y) + lam))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, s, t = new + (t - 1) / t2 * (new - s), new, t2
    return k @ s


def test_foopsi_queries_reach_the_optimum(spark, rows):
    got = {r["pix"]: r for r in found(spark, "foopsi_ar1")}
    two = {r["pix"]: r for r in found(spark, "foopsi_ar2")}
    for pix in list(rows)[:4]:
        d = K.deconvolve_ar1(rows[pix], "foopsi", g=0.9, lam=0.05)
        assert got[pix]["c_sum"] == pytest.approx(d["c"].sum(), abs=1e-3)
        lam = np.full(64, 0.05 * 0.1)
        lam[-1] = 0.05  # lam on spikes is lam * (1 - g) on calcium, and lam on its last frame
        y = rows[pix] - d["b"]
        k = np.array([[0.9 ** (i - j) if i >= j else 0 for j in range(64)] for i in range(64)])
        value = lambda c: 0.5 * ((y - c) ** 2).sum() + lam @ c  # noqa: B023, E731
        first = K.decay(K.pools_ar1(y, 0.9, 0.05), 0.9, 64)
        s = K.nnls(k.T @ k, k.T @ (y - lam))
        assert value(first) == pytest.approx(value(k @ s), abs=1e-6)
        c = np.convolve(K.sliding_nnls(rows[pix], K.ar_kernel(np.array([1.4, -0.48]), 64), lam=0.05), K.ar_kernel(np.array([1.4, -0.48]), 64))[:64]
        assert c == pytest.approx(best(rows[pix], K.ar_kernel(np.array([1.4, -0.48]), 64), 0.05), abs=2e-3)
        assert two[pix]["n"] == 64


@pytest.mark.parametrize("name", ["deconvolved_ar1", "constrained_ar1", "thresholded_ar1", "constrained_exp2", "thresholded_ar2"])
def test_deconvolution_queries_stay_within_the_noise(spark, rows, name):
    got = {r["pix"]: r for r in found(spark, name)}
    assert set(got) == set(rows)
    if name == "deconvolved_ar1":
        for pix, r in got.items():
            assert min(r["c"]) >= 0 and len(r["s"]) == 64
            assert 0 <= r["g"] <= 1 or not any(r["c"])
            if any(r["c"]):
                assert ((rows[pix] - r["b"] - np.array(r["c"])) ** 2).sum() <= 64 * max(r["sn"] ** 2 * 1.2, rows[pix].var() * 1.01)


def test_deconvolution_by_other_kernels_finds_planted_spikes():
    h = K.exp2_kernel(10, 2, 100)
    s = np.zeros(400)
    s[[30, 120, 200, 330]] = 2, 1, 3, 1.5
    c = np.convolve(s, h)[:400]
    y = c + 0.05 * np.random.default_rng(0).standard_normal(400)
    for method in ("foopsi", "constrained", "thresholded"):
        d = K.deconvolve_kernel(y, h, method, sn=0.05, lam=0.1)
        assert np.corrcoef(d["c"], c)[0, 1] > 0.98
    assert np.flatnonzero(d["s"] > 0.3).size <= 12


def test_kernel_nnls_query(spark, rows):
    got = {r["pix"]: r for r in found(spark, "kernel_nnls")}
    kernel = np.array([0.9**i - 0.5**i for i in range(1, 30)])
    for pix in list(rows)[:3]:
        s = K.sliding_nnls(rows[pix], kernel, 32, 16)
        assert (s >= 0).all()
        assert got[pix]["s_sum"] == pytest.approx(s.sum(), abs=1e-3)


def test_background_queries(spark, rows):
    from glimmer.sources.adapters import HEIGHT

    at = {pix: (pix % HEIGHT, pix // HEIGHT) for pix in rows}
    w = {}
    for r in found(spark, "ring_regression"):
        w.setdefault(r["pix"], {})[r["nbr_pix"]] = r["w"]
    pix = 210
    ring = [q for q in rows if 4 <= (at[q][0] - at[pix][0]) ** 2 + (at[q][1] - at[pix][1]) ** 2 < 9]
    x = np.vstack([*(rows[q] - rows[q].mean() for q in ring), np.ones(64)])
    want = np.linalg.solve(x @ x.T + 1e-5 * np.trace(x @ x.T) * np.eye(len(x)), x @ (rows[pix] - rows[pix].mean()))[:-1]
    assert {q: pytest.approx(v, abs=2e-6) for q, v in zip(ring, want, strict=True)} == w[pix]
    share = {r["pix"]: r["share"] for r in found(spark, "low_rank_background")}
    patch = [q for q in rows if -2 <= at[q][0] < 10 and -2 <= at[q][1] < 10]
    z = np.vstack([rows[q] - rows[q].mean() for q in patch])
    u, s, v = np.linalg.svd(z, full_matrices=False)
    b = u[:, :2] * s[:2] @ v[:2]
    for i, q in enumerate(patch):
        if at[q][0] < 8 and at[q][1] < 8:
            assert share[q] == pytest.approx((b[i] ** 2).sum() / (z[i] ** 2).sum(), abs=2e-6)


def test_spatial_queries_solve_each_pixel(spark, rows):
    from glimmer.operators import components as C
    from glimmer.sources.adapters import pixels, samples

    p = pixels(spark, f"{DATA}/sf0.001")
    t = {r["label"]: np.array(r["trace"]) - np.mean(r["trace"]) for r in C.label_traces(samples(p)).collect()}
    region = {}
    for r in C.label_region(p).collect():
        region.setdefault(r["pix"], []).append(r["label"])
    a = {}
    for r in found(spark, "nnls_spatial"):
        a.setdefault(r["pix"], {})[r["label"]] = r["a"]
    for pix in list(rows)[:20]:
        labels = sorted(region[pix])
        x = np.vstack([t[k] for k in labels])
        y = rows[pix] - rows[pix].mean()
        got = np.array([a.get(pix, {}).get(k, 0.0) for k in labels])
        slope = x @ (y - got @ x)
        if (got > 0).sum() < 5:  # at most five labels a pixel
            assert (slope <= 1e-2).all() and (np.abs(slope[got > 0]) < 1e-2).all()


def test_greedy_seed_query_begins_with_the_best_pixel(spark, rows):
    from glimmer.sources.adapters import HEIGHT

    got = found(spark, "greedy_seeds")
    assert got
    block = [q for q in rows if q % HEIGHT < 10 and q // HEIGHT < 10]
    z = {q: (rows[q] - rows[q].mean()) / rows[q].std() for q in block}

    def score(q):
        near = [p for p in block if p != q and abs(p % HEIGHT - q % HEIGHT) <= 1 and abs(p // HEIGHT - q // HEIGHT) <= 1]
        y = rows[q] - np.median(rows[q])
        return np.mean([z[p] @ z[q] / 64 for p in near]) * y.max() / y.std()

    best = max(block, key=score)
    first = [r for r in got if r["patch"] == 0 and r["rank"] == 1]
    assert not first or (first[0]["pix"] == best and first[0]["score"] == pytest.approx(score(best), abs=1e-5))


def test_merged_traces_are_of_rank_one(spark):
    rng = np.random.default_rng(0)
    a, c = rng.random((6, 3)), rng.random((3, 40))
    traces = spark.createDataFrame([(k, c[k].tolist()) for k in range(3)], "id long, trace array<double>")
    f = spark.createDataFrame([(k, p, float(a[p, k])) for k in range(3) for p in range(6)], "id long, pix long, val double")
    groups = spark.createDataFrame([(k, 0) for k in range(3)], "id long, label long")
    got = graph.merged_traces(traces, f, groups, 60).collect()[0]
    _, _, v = np.linalg.svd(a @ c)
    assert abs(np.corrcoef(got["trace"], v[0])[0, 1]) > 0.9999
    assert len(found(spark, "merge_components")) >= 1


def test_two_classes_by_the_spectrum(spark):
    got = found(spark, "event_types")
    assert len(got) == 500
    assert len({r["cluster"] for r in got}) == 2
    assert len({r["cluster"] for r in got if r["active"]}) == 1


@pytest.mark.parametrize("seed", range(3))
def test_two_means_are_those_of_a_plain_loop(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(0, 1, (60, 4)), rng.normal(1.5, 1, (40, 4))]).round(3)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "pix long, power array<double>")
    high = x[:, 2:].sum(1)
    want = high > high.mean()
    while True:
        means = [x[want == k].mean(0) for k in (False, True)]
        new = ((x - means[1]) ** 2).sum(1) < ((x - means[0]) ** 2).sum(1)
        if (new == want).all():
            break
        want = new
    for d in (rows, rows.repartition(7)):
        got = {r["pix"]: r["cluster"] for r in stats.two_means(d, "power", 4).collect()}
        assert got == {i: int(k) for i, k in enumerate(want)}


def test_two_means_of_equal_and_of_no_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "pix long, power array<double>")
    assert {r["cluster"] for r in stats.two_means(same, "power", 2).collect()} == {0}
    assert stats.two_means(same.limit(0), "power", 2).count() == 0


def test_deconvolution_of_short_and_missing_traces(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0]), (2, [float("nan")] * 20), (3, [0.0] * 20)], "pix long, y array<double>")
    got = deconvolution.deconvolved(d, "pix").collect()
    assert {r["pix"] for r in got} == {2, 3}
    assert all(x == 0 for r in got for x in r["c"])


def test_density_modes(spark):
    rng = np.random.default_rng(0)
    y = np.concatenate([rng.normal(2, 0.5, 3000), rng.normal(9, 1, 500)])
    mode, width = K.density_mode(y)
    assert mode == pytest.approx(2, abs=0.15)
    assert 0.05 < width < 0.6
    assert len(found(spark, "density_modes")) == 500
    assert K.density_mode(np.ones(9)) == (1.0, 0.0)


def test_preprocessing(spark, rows):
    got = {r["pix"]: r for r in found(spark, "preprocessed")}
    assert set(got) == set(rows)
    z = {p: y - y.mean() for p, y in rows.items()}
    g = sum(v[1:] @ v[:-1] for v in z.values()) / sum(v @ v - 64 * got[p]["sn"] ** 2 for p, v in z.items())
    assert all(r["g"] == pytest.approx(g, rel=1e-3) for r in got.values())


def test_update_queries_agree_with_plain_solutions(spark, rows):
    """Least squares, descent and thresholds of a pixel's labels, and turns of overlapping components."""
    from glimmer.operators import components as C
    from glimmer.plans import updates
    from glimmer.sources.adapters import pixels, samples

    sf = f"{DATA}/sf0.001"
    p = pixels(spark, sf)
    t = {r["label"]: np.array(r["trace"]) - np.mean(r["trace"]) for r in C.label_traces(samples(p)).collect()}
    region = {}
    for r in C.label_region(p).collect():
        region.setdefault(r["pix"], []).append(r["label"])

    def answers(name):
        a = {}
        for r in updates.QUERIES[name](spark, sf).collect():
            a.setdefault(r["pix"], {})[r["label"]] = r["a"]
        return a

    hals, thresh, clamped = answers("hals_spatial"), answers("hals_spatial_thresh"), answers("clamped_spatial")
    for pix in list(rows)[:15]:
        labels = sorted(region[pix])
        x = np.vstack([t[k] for k in labels])
        y = rows[pix] - rows[pix].mean()
        u, v = x @ y, x @ x.T
        want = K.hals(u[:, None], v, np.zeros((len(u), 1)))[:, 0]
        assert [hals.get(pix, {}).get(k, 0.0) for k in labels] == pytest.approx(want, abs=2e-3)
        sn = float(K.noise_level(rows[pix])[0])
        cut = np.where(want < 3 * sn / np.sqrt(np.diag(v)), 0, want)
        assert [thresh.get(pix, {}).get(k, 0.0) for k in labels] == pytest.approx(cut, abs=2e-3)
        assert [clamped.get(pix, {}).get(k, 0.0) for k in labels] == pytest.approx(np.maximum(np.linalg.solve(v, u), 0), abs=2e-3)
    f = C.footprints(samples(p), 0.15)
    turn = {r["id"]: r["turn"] for r in updates.update_order(spark, sf).collect()}
    assert set(turn) == {r["neuron"] for r in f.select("neuron").distinct().collect()}
    assert all(turn[r["a"]] != turn[r["b"]] for r in C.overlap_cosine(f, 0.2).collect())


@pytest.mark.parametrize("model", ["ring", "svd", "nmf"])
def test_background_update_queries(spark, rows, model):
    from glimmer.plans import updates

    got = {r["pix"]: r for r in updates.QUERIES[f"update_background_{model}"](spark, f"{DATA}/sf0.001").collect()}
    assert set(got) == set(rows)
    rest = {r["pix"]: r for r in updates.QUERIES["background_model_residual"](spark, f"{DATA}/sf0.001").collect()}
    if model != "nmf":  # the models are about the mean
        assert all(got[p]["level"] == pytest.approx(rest[p]["level"], abs=2e-5) for p in rows)


def test_peak_to_noise_by_the_spectrum(spark, rows):
    for r in found(spark, "pnr_psd"):
        y = rows[r["pix"]]
        assert r["pnr"] == pytest.approx((y.max() - np.median(y)) / K.noise_level(y)[0], rel=1e-3)


def test_components_keep_their_trace_where_nothing_is_found(spark):
    c, _, y = planted(300, 0.9, 0.05)
    d = spark.createDataFrame([(1, y.tolist()), (2, [0.0, float("nan")] * 50)], "neuron long, trace array<double>")
    got = {r["neuron"]: r for r in deconvolution.deconvolved_components(d).collect()}
    assert np.corrcoef(got[1]["c"], c)[0, 1] > 0.9
    assert got[1]["c_raw"] == pytest.approx(y - got[1]["b"])
    assert got[2]["c"] == got[2]["c_raw"]


def test_running_footprints_add_up_over_a_stream(spark, tmp_path):
    from glimmer.streaming.online import running_footprints

    parts = [[(1, 5, 2.0, 1.0), (1, 6, 1.0, 1.0)], [(1, 5, 4.0, 3.0)]]
    schema = "neuron long, pix long, a double, e double"
    for k, rows_ in enumerate(parts):
        spark.createDataFrame(rows_, schema).write.mode("append").parquet(str(tmp_path / "in"))
        sums = running_footprints(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        sums.writeStream.format("memory").queryName(f"sums{k}").outputMode("complete").option("checkpointLocation", str(tmp_path / f"state{k}")).trigger(availableNow=True).start().awaitTermination()
        got = {(r["neuron"], r["pix"]): r["ae"] / r["e"] for r in spark.table(f"sums{k}").collect()}
        assert got == ({(1, 5): 2.0, (1, 6): 1.0}, {(1, 5): 3.5, (1, 6): 1.0})[k]


@pytest.mark.parametrize("method", ["foopsi", "constrained", "thresholded"])
@pytest.mark.parametrize("g", [None, 0.9])
def test_traces_deconvolved_together_and_alone_agree(method, g):
    rng = np.random.default_rng(4)
    traces = [planted(64, 0.9, 0.3, k)[2] for k in range(20)] + [planted(40, 0.8, 0.2, k)[2] for k in range(9)]
    traces += [np.zeros(64), np.full(64, np.nan), rng.standard_normal(64), np.ones(2), np.arange(64.0)]
    together = K.deconvolve_ar1_all(traces, method, g, sn=0.3, lam=0.05)
    for y, d in zip(traces, together, strict=True):
        if len(y):
            alone = K.deconvolve_ar1(y, method, g, sn=0.3, lam=0.05)
            for k in ("c", "s", "b", "lam", "smin", "sn"):
                assert d[k] == pytest.approx(alone[k], abs=1e-9), k
            assert ((d["s"] > 0) == (alone["s"] > 0)).all()


def halved(energy, goal, low, high, rounds):
    """The plain search: the largest of the halvings whose energy is within goal."""
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if energy(mid) <= goal else (low, mid)
    return low


@given(st.lists(st.floats(-3, 3), min_size=3, max_size=50), st.floats(0.2, 0.97), st.floats(0.05, 1))
@settings(max_examples=60, deadline=None)
def test_the_penalty_is_that_of_plain_halving(y, g, sn):
    y = np.array(y)
    d = K.deconvolve_ar1(y, "constrained", g, sn, baseline=False)
    energy = lambda x: ((y - K.decay(K.pools_ar1(y, g, x), g, len(y))) ** 2).sum()
    high = max(0.0, y.max()) + 1e-9
    want = halved(energy, sn**2 * len(y), 0.0, high, 30) if energy(0.0) < sn**2 * len(y) else 0.0
    assert energy(d["lam"]) == pytest.approx(energy(want), abs=1e-6)


def test_the_penalty_of_a_kernel_is_that_of_plain_halving():
    h = K.exp2_kernel(6.0, 1.0, 64)
    for seed in range(6):
        y = planted(64, 0.9, 0.2, seed)[2]
        d = K.deconvolve_kernel(y, h, "constrained", sn=0.3, baseline=False)
        spikes = lambda x: K.sliding_nnls(y, h, lam=x)  # noqa: B023, E731
        energy = lambda x: ((y - np.convolve(spikes(x), h)[:64]) ** 2).sum()  # noqa: B023, E731
        want = halved(energy, 0.3**2 * 64, 0.0, float(np.linalg.norm(h) * np.ptp(y)) + 1e-9, 12) if energy(0.0) < 0.3**2 * 64 else 0.0
        assert d["lam"] == pytest.approx(want, abs=1e-12)
        assert d["s"] == pytest.approx(spikes(want), abs=1e-9)


def test_density_modes_of_many_traces_are_those_of_each():
    rng = np.random.default_rng(5)
    traces = [rng.standard_normal(64) * s for s in (0.1, 1, 30)] + [np.round(rng.standard_normal(200), 1), np.ones(5), np.concatenate([rng.normal(0, 1, 300), rng.normal(8, 0.3, 500)]), np.array([0.0, 1.0, 1.0, 1.0])]
    for got, y in zip(K.density_modes(traces), traces, strict=True):
        assert got == pytest.approx(K.density_mode(y), abs=1e-9)


def test_searches_evaluate_few_penalties(monkeypatch):
    # One trace took 150 evaluations and more of the pools; a query over many traces grew by that.
    calls = []
    plain = K.pools_ar1
    monkeypatch.setattr(K, "pools_ar1", lambda *a: calls.append(1) or plain(*a))
    K.deconvolve_ar1(planted(64, 0.9, 0.3)[2], "constrained", 0.9, 0.3)
    assert len(calls) < 80


def test_a_series_that_goes_on_yields_no_empty_table():
    import pandas as pd

    from glimmer.streaming.online import online_calcium

    class Samples:
        def groupBy(self, key):
            return self

        def applyInPandasWithState(self, update, *_):
            return update

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists = False

    update, state = online_calcium(Samples(), 0.9), State()
    parts = [pd.DataFrame({"user_id": 1, "t": [3.0, 1.0], "y": [0.5, 1.0]}), pd.DataFrame({"user_id": 1, "t": [2.0], "y": [2.0]})]
    assert list(update((1,), iter(parts), state)) == []
    (done,) = update((1,), iter([pd.DataFrame({"user_id": [1], "t": [np.nan], "y": [np.nan]})]), state)
    assert done["t"].tolist() == [1, 2, 3] and not state.exists
    assert done["c"].tolist() == pytest.approx(K.decay(K.pools_ar1(np.array([1.0, 2.0, 0.5]), 0.9), 0.9, 3))


def test_penalties_are_looked_up_on_pools(monkeypatch):
    # Each look at a penalty solved the whole trace anew: 26 times and more for one trace.
    _, _, y = planted(300)
    solved, pools_ar1 = [], K.pools_ar1
    monkeypatch.setattr(K, "pools_ar1", lambda *a: solved.append(a) or pools_ar1(*a))
    assert K.deconvolve_ar1(y)["c"].any()
    assert len(solved) <= 12  # two for each of the baselines


@pytest.mark.parametrize("g", [0.05, 0.6, 0.95])
def test_energy_on_merging_pools_is_that_of_the_whole_trace(g):
    for n in (3, 40, 300):
        y = planted(n, seed=n)[2] - 0.1
        pools = K.pools_ar1(y, g)
        at = K._shrinking(pools, g, y - K.decay(pools, g, n))
        rest = lambda x: float(((y - K.decay(K.pools_ar1(y, g, x), g, n)) ** 2).sum())  # noqa: B023, E731
        for x in (0.0, 0.01, 0.1, 0.5, 2.0):
            energy, slope, _ = at(x)
            assert energy == pytest.approx(rest(x), rel=1e-9)
            if x:
                assert 2 * slope == pytest.approx((rest(x + 1e-6) - rest(x - 1e-6)) / 2e-6, rel=1e-3, abs=1e-5)


@pytest.mark.parametrize("n", [2, 7, 64, 200])
def test_calcium_of_all_rows_is_that_of_each(n):
    rng = np.random.default_rng(4)
    y = (rng.random((60, n)) < 0.1) * rng.random((60, n)) * 3
    for t in range(1, n):
        y[:, t] += 0.85 * y[:, t - 1]
    y += rng.standard_normal(y.shape) * 0.3 + 1
    y[0], y[1], y[2, n // 2] = 0, np.arange(n), np.nan
    assert K.calcium_ar1(y) == pytest.approx(np.array([K.deconvolve_ar1(x)["c"] for x in y]), abs=1e-12)
    assert K.calcium_ar1(y[:0]).shape == (0, n)


def test_baselines_of_all_rows_are_those_of_each():
    rng = np.random.default_rng(5)
    y = rng.standard_normal((50, 64)) * rng.random((50, 1)) * 10 + rng.standard_normal((50, 1))
    y[:20] += 5 * (rng.random((20, 64)) < 0.2)
    y[0], y[1], y[2] = 3, np.repeat([1.0, 2.0], 32), 0
    b, sn = K.histogram_baselines(y)
    assert np.column_stack([b, sn]) == pytest.approx(np.array([K.histogram_baseline(x) for x in y]), rel=1e-7, abs=1e-9)


def test_patches_that_are_seeded_side_by_side_are_deconvolved_together(monkeypatch):
    import pandas as pd

    def seeding(patch, rows):  # as many sources as the patch's number says
        out = []
        for k in range(patch):
            trace, calcium = yield rows["y"].iloc[0] * (k + 1)
            out.append((patch, k, float(trace.sum()), float(calcium.sum())))
        return out

    rng, calls, whole = np.random.default_rng(6), [], K.calcium_ar1
    rows = pd.DataFrame({"patch": np.repeat(np.arange(5), 3), "y": list(rng.standard_normal((15, 40)).cumsum(1))})
    columns = ["patch", "k", "trace", "calcium"]
    alone = pd.concat(patches._side_by_side(seeding)(iter([rows[rows["patch"] == k]]), columns).__next__() for k in range(5))
    monkeypatch.setattr(patches.K, "calcium_ar1", lambda y: calls.append(len(y)) or whole(y))
    beside = pd.concat(patches._side_by_side(seeding)(iter([rows[:4], rows[4:4], rows[4:]]), columns))
    assert calls == [4, 3, 2, 1]
    by = lambda d: d.sort_values(["patch", "k"])[columns].to_numpy(float)
    assert by(beside) == pytest.approx(by(alone), abs=1e-9) and len(beside) == 10
    monkeypatch.setattr(patches, "SEEDED_AT_ONCE", 200)  # two patches of 3 pixels and 40 frames
    assert by(pd.concat(patches._side_by_side(seeding)(iter([rows]), columns))) == pytest.approx(by(alone), abs=1e-9)


def test_the_region_of_a_place_is_the_one_that_labels_give():
    from glimmer.functions import images as I  # noqa: E741

    rng = np.random.default_rng(7)
    for _ in range(200):
        mask = rng.random(rng.integers(1, 12, 2)) < 0.6
        at, label = tuple(rng.integers(0, mask.shape)), I.regions(mask)
        assert np.array_equal(I.region_of(mask, at), label == label[at])
