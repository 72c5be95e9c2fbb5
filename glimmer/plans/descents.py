"""Known footprints, and the alternation of footprints, traces and background factors over a whole movie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.functions import arrays as A
from glimmer.operators import components as C
from glimmer.operators import deconvolution, descent, neighbours, patches, resampling
from glimmer.operators.shared import cut
from glimmer.options import Options
from glimmer.plans import updates
from glimmer.plans.catalogue import _PX, _RING3, r
from glimmer.sources.adapters import HEIGHT, pixels, samples

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _grid(pixels: DataFrame, height: int, by: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """((rows, of the coarse grid), (columns, of the coarse grid)): of the image, one aggregated number."""
    width = int(pixels.agg(F.coalesce(F.max("c"), F.lit(-1))).head()[0]) + 1
    return (height, -(-height // by)), (width, -(-width // by))


def _coarse(movie: DataFrame, height: int, by: int, method: str) -> tuple[DataFrame, int]:
    """A movie (pix, r, c, y) on the coarse grid, and the rows that it has there."""
    rows, columns = _grid(movie, height, by)
    d = resampling.resized(movie, rows, columns, method)
    return d.select((F.col("c") * rows[1] + F.col("r")).alias("pix"), "r", "c", "y"), rows[1]


def _ring_radius(o: Options) -> int:
    return -(-o.ring_radius // o.bg_ssub)


def fit_ring(pixels: DataFrame, footprints: DataFrame, traces: DataFrame, height: int, o: Options, weights: DataFrame | None = None, clip: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(weights (patch, pix, nbr_pix, w, ssub), offset (pix, b0)) of the ring model of Y - A C.

    weights: those of an earlier fit; else, or if they are for another bg_ssub, each pixel's ring counts evenly. With
    bg_ssub over 1, the model is that of every so many rows and columns, on a ring as much smaller. clip: see
    patches.fitted_ring_weights.
    """
    rest = updates.residual(pixels, footprints, traces)
    rows = height
    if o.bg_ssub > 1:
        rest, rows = _coarse(rest, height, o.bg_ssub, "nearest")
        rest = cut(rest)
    radius = _ring_radius(o)
    if weights is None or ("ssub" in weights.columns and weights.where(F.col("ssub") != o.bg_ssub).head(1)):
        weights = neighbours.ring_weights(rest, radius, radius + 1)
    blocks = patches.blocks(rest, rows, o.patch, min(radius + 1, o.patch))
    noise = deconvolution.noise(rest, "pix") if clip is not None else None
    fitted = patches.fitted_ring_weights(blocks, weights, clip, noise).withColumn("ssub", F.lit(o.bg_ssub))
    return fitted, updates.updated_offset(pixels, footprints, traces)


def reconstructed_background(pixels: DataFrame, footprints: DataFrame, traces: DataFrame, weights: DataFrame, height: int, o: Options) -> DataFrame:
    """(pix, b): W (Y - A C - b0) + b0, with b0 the mean of Y - A C, for weights of an earlier fit.

    With bg_ssub over 1, what is about the mean goes to the coarse grid and W times it comes back by cubic weights.
    """
    rest = updates.residual(pixels, footprints, traces)
    reach = min(_ring_radius(o) + 1, o.patch)
    if o.bg_ssub <= 1:
        return patches.ring_product(patches.blocks(rest, height, o.patch, reach), weights)
    rest = cut(rest)
    rows, columns = _grid(rest, height, o.bg_ssub)
    small, n_rows = _coarse(rest.select("pix", "r", "c", C.centred(F.col("y")).alias("y")), height, o.bg_ssub, "cubic")
    small = cut(small)
    found = patches.ring_product(patches.blocks(small, n_rows, o.patch, reach), weights).join(small.select("pix", "r", "c"), "pix")
    large = resampling.resized(found.select("r", "c", F.col("b").alias("y")), rows[::-1], columns[::-1])
    d = rest.select("pix", "r", "c", A.mean(F.col("y")).alias("b0")).join(large, ["r", "c"])
    return d.select("pix", F.transform("y", lambda x: x + F.col("b0")).alias("b"))


def _system(clean: DataFrame, left: DataFrame, right: DataFrame, height: int, o: Options) -> tuple[DataFrame, DataFrame]:
    """(U, V) of footprints `left`, whose product with the movie is that of `right`."""
    return descent.projected(clean, right, height, o.patch), cut(descent.footprint_gram(left))


def _about_mean(pixels: DataFrame) -> DataFrame:
    return pixels.select("pix", "r", "c", C.centred(F.transform("y", lambda x: F.nanvl(x, F.lit(0.0)))).alias("y"))


def known_footprints(pixels: DataFrame, footprints: DataFrame, height: int, o: Options, weights: DataFrame | None = None, background: DataFrame | None = None, method: str = "svd", rounds: int = 10) -> DataFrame:
    """(neuron, trace): traces of given footprints through a given background, their least value being 0.

    With ring weights, both the movie and the footprints are taken through (I - W), pixels being about their means; with
    spatial components (pix, j, val), their traces are fitted first, together with those of the footprints; with
    neither, the pixels' means are the background.
    """
    f = cut(footprints.groupBy("neuron", "pix").agg(F.sum("val").alias("val")).where("val <> 0"))
    if weights is not None:
        w = cut(weights.select("pix", "nbr_pix", "w"))
        left = cut(descent.without_ring(f, w))
        u, v = _system(_about_mean(pixels), left, descent.without_ring_transposed(left, w), height, o)
    else:
        clean = _about_mean(pixels)
        if background is not None:
            blocks = patches.blocks(pixels, height, o.patch, 0).where("inside")
            clean = updates.without_background(pixels, patches.known_background(blocks, f, background, method))
        u, v = _system(clean, f, f, height, o)
    return descent.temporal_sweeps(u, v, rounds=rounds, rule="shift")


def initial_traces(*args, **options) -> DataFrame:
    """known_footprints, deconvolved: (neuron, c_raw, c, s, b, g, sn)."""
    return deconvolution.deconvolved_components(cut(known_footprints(*args, **options)))


# Alternation


def _alive(footprints: DataFrame, traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components with a footprint and a trace that varies."""
    t = traces.where(F.array_max("trace") > F.array_min("trace"))
    f = footprints.where("val <> 0")
    return f.join(t.select("neuron"), "neuron", "left_semi"), t.join(f.select("neuron").distinct(), "neuron", "left_semi")


def _less(sums: DataFrame, links: DataFrame, traces: DataFrame, key: str) -> DataFrame:
    """U (key, u) less what `links` (k, neuron, v) bring of other traces."""
    other = descent.combined(links, traces).withColumnRenamed("k", key)
    d = sums.join(other, key, "left")
    return d.select(key, F.when(F.col("s").isNull(), F.col("u")).otherwise(F.zip_with("u", "s", lambda a, b: a - b)).alias("u"))


def _spatial(pixels: DataFrame, region: DataFrame, own: DataFrame, start: DataFrame, others: DataFrame, other_traces: DataFrame) -> DataFrame:
    """Sweeps over the weights of a region (pix, label) for traces `own` (label, trace), other components being fixed.

    others: (pix, k, val), whose traces are other_traces (k, trace).
    """
    u = descent.dots(region, pixels, own)
    pairs = cut(region.join(others.select("pix", "k"), "pix").select("label", "k").distinct())
    g = pairs.join(own.select("label", F.col("trace").alias("x")), "label").join(other_traces.select("k", F.col("trace").alias("z")), "k").select("label", "k", A.dot(F.col("x"), F.col("z")).alias("g"))
    known = region.join(others, "pix").join(g, ["label", "k"]).groupBy("pix", "label").agg(F.sum(F.col("val") * F.col("g")).alias("s"))
    u = u.join(known, ["pix", "label"], "left").select("pix", "label", (F.col("u") - F.coalesce("s", F.lit(0.0))).alias("u"))
    mates = cut(C.region_pairs(region))
    t = own.select("label", "trace")
    v = mates.join(t.select(F.col("label").alias("a"), F.col("trace").alias("x")), "a").join(t.select(F.col("label").alias("b"), F.col("trace").alias("z")), "b").select("a", "b", A.dot(F.col("x"), F.col("z")).alias("v"))
    return patches.spatial_update(u, v, "hals", start=start)


def alternate(pixels: DataFrame, footprints: DataFrame, traces: DataFrame, background: DataFrame, factors: DataFrame, height: int, o: Options, rounds: int = 5, sweeps: int = 5) -> dict[str, DataFrame]:
    """Footprints, traces, background (j, pix, val) and its factors (j, trace) that bring |Y - A C - b f| down.

    Each round sweeps over the traces, the footprints within their first support, the factors and the background's
    weights, all non-negative; components without a footprint or a trace that varies are dropped. The traces move turn
    by turn (descent.temporal_sweeps), the weights pixel by pixel, so nothing but sums is shuffled and no task has more
    than a patch of the movie. The objective of each round is in "objective" (round, value).
    """
    y = cut(pixels.select("pix", "r", "c", F.transform("y", lambda x: F.nanvl(x, F.lit(0.0))).alias("y")))
    f = cut(footprints.select(F.col("neuron").cast("long").alias("neuron"), "pix", "val"))
    t = cut(traces.select(F.col("neuron").cast("long").alias("neuron"), "trace"))
    region = cut(f.select("pix", F.col("neuron").alias("label")).distinct())
    b, factors = cut(background.select(F.col("j").cast("long").alias("j"), "pix", "val")), cut(factors.select(F.col("j").cast("long").alias("j"), "trace"))
    as_neurons = lambda d: d.withColumnRenamed("j", "neuron")
    everywhere = cut(b.select("pix", F.col("j").alias("label")).distinct())
    values = [objective(y, f, t, b, factors)]
    for _ in range(rounds):
        f, t = map(cut, _alive(f, t))
        u, v = _system(y, f, f, height, o)
        links = descent.cross_gram(f, b).select(F.col("neuron").alias("k"), F.col("j").alias("neuron"), "v")
        t = descent.temporal_sweeps(_less(u, links, as_neurons(factors), "neuron"), v, t, sweeps)
        f, t = map(cut, _alive(f, t))
        live = cut(region.join(t.select(F.col("neuron").alias("label")), "label", "left_semi"))
        start = f.select("pix", F.col("neuron").alias("label"), F.col("val").alias("a"))
        f = cut(_spatial(y, live, t.withColumnRenamed("neuron", "label"), start, b.withColumnRenamed("j", "k"), factors.withColumnRenamed("j", "k")).select(F.col("label").alias("neuron"), "pix", F.col("a").alias("val")))
        u, v = _system(y, as_neurons(b), as_neurons(b), height, o)
        links = descent.cross_gram(f, b).select(F.col("j").alias("k"), "neuron", "v")
        factors = cut(descent.temporal_sweeps(_less(u, links, t, "neuron"), v, as_neurons(factors), sweeps).withColumnRenamed("neuron", "j"))
        start = b.select("pix", F.col("j").alias("label"), F.col("val").alias("a"))
        b = cut(_spatial(y, everywhere, factors.withColumnRenamed("j", "label"), start, f.withColumnRenamed("neuron", "k"), t.withColumnRenamed("neuron", "k")).select(F.col("label").alias("j"), "pix", F.col("a").alias("val")))
        values.append(objective(y, f, t, b, factors))
    spark = pixels.sparkSession
    return {"footprints": f, "traces": t, "background": b, "factors": factors, "objective": spark.createDataFrame(list(enumerate(values)), "round int, value double")}


def objective(pixels: DataFrame, footprints: DataFrame, traces: DataFrame, background: DataFrame, factors: DataFrame) -> float:
    """The sum of squares of Y - A C - b f: one number."""
    rest = updates.residual(updates.residual(pixels, footprints, traces), background.withColumnRenamed("j", "neuron"), factors.withColumnRenamed("j", "neuron"))
    return float(rest.agg(F.sum(A.dot(F.col("y"), F.col("y")))).head()[0] or 0.0)


# Queries on the given tables: labels are components, with the pixels of the label; each pixel's ring counts evenly.

_OPTIONS = Options(gSiz=4, patch=8, ring_radius=3, background_model="ring")
_KNOWN = f"""{_PX}, w AS (SELECT a.pix, b.pix AS q, 1.0 / count(*) OVER (PARTITION BY a.pix) AS w FROM p a, {_RING3} o, p b WHERE b.r = a.r + o.dr AND b.c = a.c + o.dc),
f AS (SELECT pix, CAST(label AS BIGINT) AS neuron, avg(abs(y)) AS val FROM px GROUP BY pix, label),
wa AS (SELECT neuron, w.pix, sum(w * val) AS val FROM w JOIN f ON f.pix = w.q GROUP BY neuron, w.pix),
a AS (SELECT coalesce(f.neuron, wa.neuron) AS neuron, coalesce(f.pix, wa.pix) AS pix, coalesce(f.val, 0) - coalesce(wa.val, 0) AS val FROM f FULL JOIN wa ON f.neuron = wa.neuron AND f.pix = wa.pix)"""


def _known(spark, d):
    p, f, _ = updates._first(spark, d)
    return _about_mean(p), f, neighbours.ring_weights(p, 3, 4)


@query(f"{_KNOWN}, z AS (SELECT pix, t, y - avg(y) OVER (PARTITION BY pix) AS y FROM px), wy AS (SELECT w.pix, t, sum(w * y) AS y FROM w JOIN z ON z.pix = w.q GROUP BY w.pix, t), c AS (SELECT z.pix, z.t, z.y - coalesce(wy.y, 0) AS y FROM z LEFT JOIN wy ON wy.pix = z.pix AND wy.t = z.t) SELECT neuron, CAST(t AS INT) AS t, {r('sum(val * y)', 5)} AS u FROM a JOIN c USING (pix) GROUP BY neuron, t")
def known_footprints_projection(spark, d):
    """((I - W) A)' (I - W) Y: what known footprints see of the movie through the ring background."""
    p, f, w = _known(spark, d)
    right = descent.without_ring_transposed(descent.without_ring(f, w), w)
    u = descent.projected(p, right, HEIGHT, 8, 40).select("neuron", F.posexplode("u").alias("t", "u"))
    return u.select("neuron", (F.col("t") + 1).alias("t"), A.rounded(F.col("u"), 5).alias("u"))


@query(f"{_KNOWN} SELECT x.neuron AS a, y.neuron AS b, {r('sum(x.val * y.val)')} AS v FROM a x JOIN a y USING (pix) GROUP BY x.neuron, y.neuron")
def known_footprints_gram(spark, d):
    _, f, w = _known(spark, d)
    return descent.footprint_gram(descent.without_ring(f, w)).select("a", "b", A.rounded(F.col("v")).alias("v"))


@query()
def known_footprints_temporal(spark, d):
    """Traces of known footprints through the ring background, with their events."""
    p, f, _ = updates._first(spark, d)
    out = initial_traces(p, f, HEIGHT, _OPTIONS, neighbours.ring_weights(p, 3, 4), rounds=2)
    return out.select("neuron", A.rounded(A.mean(F.col("c_raw")), 5).alias("level"), F.size(F.filter("s", lambda x: x > 0)).alias("n_events"))


@query()
def converged_traces(spark, d):
    """Traces of the labels' footprints, swept until a sweep moves them by a thousandth."""
    p, f, _ = updates._first(spark, d)
    traces, _ = descent.converged_sweeps(descent.projected(p, f, HEIGHT, 8), descent.footprint_gram(f))
    return traces.select("neuron", F.posexplode("trace").alias("t", "x")).select("neuron", (F.col("t") + 1).alias("t"), A.rounded(F.col("x"), 5).alias("x"))


@query(f"{updates._MODEL}, w AS (SELECT a.pix, b.pix AS q, 1.0 / count(*) OVER (PARTITION BY a.pix) AS w FROM p a, {_RING3} o, p b WHERE b.r = a.r + o.dr AND b.c = a.c + o.dc), e AS (SELECT px.pix, px.t, y - val * x AS y FROM px JOIN f ON f.pix = px.pix JOIN ct ON ct.neuron = f.neuron AND ct.t = px.t), m AS (SELECT pix, avg(y) AS b0 FROM e GROUP BY pix) SELECT w.pix, CAST(e.t AS INT) AS t, {r('sum(w * (e.y - m.b0)) + any_value(o.b0)')} AS b FROM w JOIN e ON e.pix = w.q JOIN m ON m.pix = w.q JOIN m o ON o.pix = w.pix GROUP BY w.pix, e.t")
def ring_reconstruction(spark, d):
    """W (Y - A C - b0) + b0 by pixel and frame."""
    p, f, t = updates._first(spark, d)
    b = reconstructed_background(p, f, t, neighbours.ring_weights(p, 3, 4), HEIGHT, _OPTIONS)
    return samples(b.withColumnRenamed("b", "y")).select("pix", "t", A.rounded(F.col("y")).alias("b"))


@query()
def ring_fit_clipped(spark, d):
    """Ring weights fitted without the values over what even weights say by more than three deviations of the noise."""
    p, f, t = updates._first(spark, d)
    w, _ = fit_ring(p, f, t, HEIGHT, _OPTIONS, clip=3.0)
    return w.groupBy("pix").agg(F.count("*").alias("n"), A.rounded(F.sum("w"), 5).alias("w"))


@query()
def hals_whole(spark, d):
    """Two rounds of the alternation over the blurred movie, with the mean image and frame as background: the objective falls."""
    p = updates._blurred(spark, d)
    p = cut(p.withColumn("y", F.transform("y", lambda x: F.greatest(x, F.lit(0.0)))))
    label = F.floor(F.col("pix") / 50)
    f = p.select(label.alias("neuron"), "pix", F.lit(1.0).alias("val"))
    traces = C.label_traces(samples(p.withColumn("label", label))).withColumnRenamed("label", "neuron")
    b = p.select(F.lit(0).alias("j"), "pix", A.mean(F.col("y")).alias("val"))
    mean = samples(p).groupBy("t").agg(F.avg("y").alias("x")).select(F.lit(0).alias("j"), "t", "x")
    out = alternate(p, f, traces, b, descent.array_of(mean, "j", "x", "trace"), HEIGHT, _OPTIONS, rounds=1, sweeps=1)
    return out["objective"].select("round", A.rounded(F.col("value"), 3).alias("value"))


def _tap_sql(name: str, old: str, new: str) -> str:
    """Taps for `old` lines made `new`, by the definition: cubic, stretched when lines get fewer, mirrored, adding up to 1."""
    return f"""{name}_u AS (SELECT o, (o + 0.5) * n / m - 0.5 AS u, greatest(n / m, 1.0) AS wide, n FROM (SELECT {old} AS n, {new} AS m), range(0, 1000) AS g(o) WHERE o < m),
{name}_x AS (SELECT o, i, n, abs(u - i) / wide AS x FROM {name}_u, range(-20, 1020) AS g(i) WHERE abs(u - i) / wide <= 2),
{name}_w AS (SELECT o, CASE WHEN i < 0 THEN -i - 1 WHEN i >= n THEN 2 * n - 1 - i ELSE i END AS i, CASE WHEN x <= 1 THEN 1.5 * x * x * x - 2.5 * x * x + 1 ELSE -0.5 * x * x * x + 2.5 * x * x - 4 * x + 2 END AS w FROM {name}_x),
{name} AS (SELECT o, i, sum(w) / any_value(s) AS w FROM {name}_w JOIN (SELECT o, sum(w) AS s FROM {name}_w GROUP BY o) USING (o) GROUP BY o, i)"""


_WIDTH = "(SELECT max(c) + 1 FROM p)"


@query(f"{_PX}, {_tap_sql('t', _WIDTH, f'(SELECT (max(c) + 2) // 2 FROM p)')} SELECT o, i, {r('w', 9)} AS w FROM t WHERE abs(w) > 1e-12")
def resample_taps(spark, d):
    """The weights that halve the number of the image's columns."""
    lines = pixels(spark, d).agg((F.max("c") + 1).alias("n")).select("n", F.ceil(F.col("n") / 2).alias("m"))
    return resampling.taps(lines).where(F.abs("w") > 1e-12).select("o", "i", A.rounded(F.col("w"), 9).alias("w"))


@query(f"{_PX}, {_tap_sql('rows', str(HEIGHT), str(-(-HEIGHT // 2)))}, {_tap_sql('cols', _WIDTH, '(SELECT (max(c) + 2) // 2 FROM p)')}, m AS (SELECT r, c, avg(y) AS y FROM px GROUP BY r, c) SELECT CAST(rows.o AS BIGINT) AS r, CAST(cols.o AS BIGINT) AS c, {r('sum(rows.w * cols.w * m.y)', 8)} AS y FROM m JOIN rows ON rows.i = m.r JOIN cols ON cols.i = m.c GROUP BY rows.o, cols.o")
def cubic_half(spark, d):
    """The mean image on a grid half as fine, by cubic weights that do not alias."""
    p = pixels(spark, d).select("r", "c", F.array(A.mean(F.col("y"))).alias("y"))
    rows, columns = _grid(p, HEIGHT, 2)
    return resampling.resized(p, rows, columns).select("r", "c", A.rounded(F.col("y")[0], 8).alias("y"))


@query()
def update_background_coarse(spark, d):
    """The ring background fitted on a grid half as fine."""
    from dataclasses import replace

    o = replace(_OPTIONS, bg_ssub=2, ring_radius=4)
    p, f, t = updates._first(spark, d)
    w, _ = fit_ring(p, f, t, HEIGHT, o)
    return updates._levels(reconstructed_background(p, f, t, cut(w), HEIGHT, o))


# The background of all patches, movies in files, batches as a stream

_R1 = f"""{updates._MODEL}, f0 AS (SELECT t, avg(x) AS x FROM ct GROUP BY t)""" + "".join(
    f""", e{k} AS (SELECT greatest(sum(x * x), 1e-300) AS e FROM f{k}), g{k} AS (SELECT neuron, sum(ct.x * f{k}.x) / any_value(e) AS g FROM ct JOIN f{k} USING (t), e{k} GROUP BY neuron), b{k} AS (SELECT pix, greatest(sum(val * g), 0) AS b FROM f JOIN g{k} USING (neuron) GROUP BY pix), v{k} AS (SELECT neuron, sum(val * b) AS v FROM f JOIN b{k} USING (pix) GROUP BY neuron), f{k + 1} AS (SELECT t, greatest(sum(v * x) / (SELECT greatest(sum(b * b), 1e-300) FROM b{k}), 0) AS x FROM ct JOIN v{k} USING (neuron) GROUP BY t)"""
    for k in range(2)
)


@query(f"{_R1} SELECT CAST(t AS INT) AS t, {r('x')} AS x FROM f2")
def rank_one_factor(spark, d):
    """Two rounds of the rank-one fit to the labels' model."""
    from glimmer.plans.extraction import rank_one_background

    _, f, t = updates._first(spark, d)
    _, g = rank_one_background(f.withColumnRenamed("neuron", "k"), t.withColumnRenamed("neuron", "k"), 2)
    return g.select(F.posexplode("trace").alias("t", "x")).select((F.col("t") + 1).alias("t"), A.rounded(F.col("x")).alias("x"))


@query()
def extracted_by_patches(spark, d):
    """Sources of each patch, merged to the end, over one background."""
    from glimmer.plans.extraction import by_patches

    out = by_patches(updates._blurred(spark, d), HEIGHT, updates._OPTIONS, 1.0)
    return out["footprints"].groupBy("neuron").agg(F.count("*").alias("n_pixels"))


@query(f"{_PX} SELECT CAST(t AS INT) AS t, CAST(count(*) AS INT) AS n, {r('sum(y)', 5)} AS total FROM px WHERE t BETWEEN 20 AND 40 GROUP BY t")
def movie_file_frames(spark, d):
    """The movie written as TIFF files by several tasks, and the frames from 20 to 40 read again by their ranges."""
    import uuid

    from glimmer.operators.shared import shared_folder
    from glimmer.sources import movies

    path = f"{shared_folder(spark)}/movie-{uuid.uuid4().hex}"
    s = samples(pixels(spark, d)).groupBy("t").agg(F.transform(F.sort_array(F.collect_list(F.struct("pix", "y"))), lambda x: x["y"]).alias("y"))
    movies.write(s.select("t", F.lit(1).alias("height"), F.size("y").alias("width"), "y"), path, 4)
    back = movies.as_one(movies.read(spark, path, 8)).where(F.col("t").between(20, 40))
    return back.select("t", (F.col("height") * F.col("width")).alias("n"), A.rounded(A.total(F.col("y")), 5).alias("total"))


@query()
def streamed_batches(spark, d):
    """The loop over two batches of frames that arrive as a stream: components with the batch that they came in."""
    import uuid
    from dataclasses import replace

    from glimmer.operators.shared import shared_folder
    from glimmer.streaming.batches import demix_stream

    base = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}"
    p = updates._blurred(spark, d)
    for k in range(2):
        # A batch arrives as as many files as it has tasks, and the stream takes what has arrived in one micro-batch.
        p.select("pix", "r", "c", F.slice("y", 1 + 32 * k, 32).alias("y"), F.lit(k).alias("batch")).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("pix long, r long, c long, y array<double>, batch int").parquet(f"{base}/in")
        demix_stream(stream, HEIGHT, f"{base}/state", replace(updates._OPTIONS, background_model="svd"), 1.0).awaitTermination()
    return updates.batch_state(spark, f"{base}/state", "neurons", 1)
