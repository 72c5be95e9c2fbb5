"""The factorisation loop: background, footprints and traces in turn, on whole movies or batch by batch; and its queries."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.functions import arrays as A
from glimmer.functions import images as I  # noqa: E741
from glimmer.operators import components as C
from glimmer.operators import deconvolution, graph, neighbours, patches
from glimmer.operators.layout import block_members
from glimmer.operators.shared import cut, shared_folder
from glimmer.options import Options
from glimmer.plans.catalogue import _PX, r
from glimmer.sources import results
from glimmer.sources.adapters import HEIGHT, pixels, samples

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# Steps. footprints: (neuron, pix, val); traces: (neuron, trace); pixels: (pix, r, c, y).


def model(footprints: DataFrame, traces: DataFrame) -> DataFrame:
    """A C by pixel: (pix, ac). The few components of a pixel add up in its row."""
    d = footprints.select("neuron", "pix", "val").join(traces.select("neuron", "trace"), "neuron")
    return d.groupBy("pix").agg(A.weighted_sum(F.collect_list(F.struct(F.col("val").alias("w"), F.col("trace").alias("x")))).alias("ac"))


def residual(pixels: DataFrame, footprints: DataFrame, traces: DataFrame) -> DataFrame:
    """Y - A C: pixels with y less the model."""
    d = pixels.select("pix", "r", "c", "y").join(model(footprints, traces), "pix", "left")
    return d.select("pix", "r", "c", F.when(F.col("ac").isNull(), F.col("y")).otherwise(F.zip_with("y", "ac", lambda a, b: a - b)).alias("y"))


def update_background(pixels: DataFrame, footprints: DataFrame, traces: DataFrame, height: int, o: Options) -> DataFrame:
    """(pix, b): the background of what the components leave, by the ring, svd or nmf model of each patch."""
    if o.background_model == "ring" and o.bg_ssub > 1:
        from glimmer.plans import descents

        weights, _ = descents.fit_ring(pixels, footprints, traces, height, o)
        return descents.reconstructed_background(pixels, footprints, traces, cut(weights), height, o)
    rest = residual(pixels, footprints, traces)
    halo = min(o.ring_radius + 1, o.patch) if o.background_model == "ring" else 0
    blocks = patches.blocks(rest, height, o.patch, halo)
    if o.background_model == "ring":
        return patches.ring_background(blocks, o.ring_radius, o.ring_radius + 1)
    return patches.low_rank(blocks, o.nb, o.background_model).select("pix", "b")


def without_background(pixels: DataFrame, background: DataFrame) -> DataFrame:
    """Y - B."""
    return pixels.select("pix", "r", "c", "y").join(background, "pix").select("pix", "r", "c", F.zip_with("y", "b", lambda a, b: a - b).alias("y"))


def search_region(footprints: DataFrame, pixels: DataFrame, smallest: float, largest: float, dist: float) -> DataFrame:
    """(pix, label): the pixels in each component's search ellipse, by grid cells of the largest reach.

    footprints: (neuron, pix, r, c, val).
    """
    reach = math.ceil(largest * dist) + 1
    e = C.search_ellipses(footprints, smallest, largest)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    e = e.withColumn("s", F.explode(steps)).withColumns({"gr": F.floor(F.col("cr") / reach) + F.col("s.i"), "gc": F.floor(F.col("cc") / reach) + F.col("s.j")})
    d = pixels.select("pix", "r", "c", F.floor(F.col("r") / reach).alias("gr"), F.floor(F.col("c") / reach).alias("gc")).join(e, ["gr", "gc"])
    along = (F.col("r") - F.col("cr")) * F.cos("angle") + (F.col("c") - F.col("cc")) * F.sin("angle")
    across = (F.col("c") - F.col("cc")) * F.cos("angle") - (F.col("r") - F.col("cr")) * F.sin("angle")
    return d.where(F.pow(along / F.col("a"), 2) + F.pow(across / F.col("b"), 2) <= dist * dist).select("pix", F.col("neuron").alias("label"))


def update_spatial(clean: DataFrame, footprints: DataFrame, traces: DataFrame, height: int, o: Options, method: str = "hals", shape: str | None = "convex") -> DataFrame:
    """New footprints (neuron, pix, val) from Y - B: regressions within the search region, and their shapes put in order."""
    placed = footprints.select("neuron", "pix", "val").join(clean.select("pix", "r", "c"), "pix")
    t = traces.select(F.col("neuron").alias("label"), "trace")
    start = footprints.select("pix", F.col("neuron").alias("label"), F.col("val").alias("a")) if method.startswith("hals") else None
    if method == "hals":
        a = patches.spatial_descent_in_ellipses(clean, C.search_ellipses(placed, 3, 8).withColumnRenamed("neuron", "label"), 3, t, start, height, o.patch)
    else:
        region = cut(search_region(placed, clean, 3, 8, 3))
        noise = deconvolution.noise(clean, "pix") if method.endswith("_thresh") else None
        a = patches.spatial_update(C.spatial_sums(clean, region, t), C.gram(t, C.region_pairs(region)), method, noise=noise, start=start)
    a = a.select(F.col("label").alias("neuron"), "pix", F.col("a").alias("val"))
    return patches.shaped(a.join(clean.select("pix", "r", "c"), "pix"), shape) if shape else a


def updated_offset(pixels: DataFrame, footprints: DataFrame, traces: DataFrame) -> DataFrame:
    """(pix, b0): mean of Y less that of A C."""
    mean = traces.select("neuron", A.mean(F.col("trace")).alias("m"))
    ac = footprints.join(mean, "neuron").groupBy("pix").agg(F.sum(F.col("val") * F.col("m")).alias("ac"))
    return pixels.select("pix", A.mean(F.col("y")).alias("y")).join(ac, "pix", "left").select("pix", A.rounded(F.col("y") - F.coalesce("ac", F.lit(0.0))).alias("b0"))


def update_temporal(clean: DataFrame, footprints: DataFrame, traces: DataFrame, height: int, o: Options, rounds: int = 2) -> DataFrame:
    """New traces (neuron, trace) from Y - B: descent in each patch, then the mean over patches by the footprints' energy."""
    members = block_members(clean, height, o.patch, 0).where("inside").select("patch", "pix")
    parts = footprints.join(members, "pix").groupBy("patch", "neuron").agg(F.collect_list(F.struct("pix", "val")).alias("f")).join(traces.select("neuron", "trace"), "neuron")
    parts = parts.select("patch", F.lit(None).cast("long").alias("pix"), F.lit(None).cast("array<double>").alias("y"), F.col("neuron").cast("long").alias("neuron"), F.col("f.pix").alias("pixels"), F.col("f.val").alias("weights"), "trace")
    rows = members.join(clean.select("pix", "y"), "pix").select("patch", "pix", "y", F.lit(None).cast("long").alias("neuron"), F.lit(None).cast("array<long>").alias("pixels"), F.lit(None).cast("array<double>").alias("weights"), F.lit(None).cast("array<double>").alias("trace"))
    found = patches.temporal_update(rows.unionByName(parts), rounds)
    d = found.groupBy("neuron").agg(A.weighted_sum(F.collect_list(F.struct(F.col("weight").alias("w"), F.col("trace").alias("x")))).alias("x"), F.sum("weight").alias("w"))
    return d.select("neuron", F.transform("x", lambda v: v / F.when(F.col("w") > 0, F.col("w")).otherwise(1.0)).alias("trace"))


def merged(footprints: DataFrame, traces: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """Components that overlap and have similar traces become one: the footprint and trace of rank one that are nearest to
    what they add up to, so that the model keeps its scale."""
    pairs = cut(C.overlap_cosine(footprints, 0.1).join(traces.select(F.col("neuron").alias("a"), F.col("trace").alias("x")), "a").join(traces.select(F.col("neuron").alias("b"), F.col("trace").alias("z")), "b").where(A.correlation(F.col("x"), F.col("z")) >= o.merge_thr).select("a", "b"))
    if not pairs.head(1):
        return footprints, traces
    groups = graph.connected_components(pairs)
    named = lambda d: d.withColumnRenamed("neuron", "id")
    fit = cut(graph.merged_traces(named(traces.select("neuron", "trace")), named(footprints.select("neuron", "pix", "val")), groups))
    parts = fit.select("label", F.inline("parts")).withColumnRenamed("id", "neuron")
    f = footprints.join(parts, "neuron").groupBy(F.col("label").alias("neuron"), "pix").agg(F.sum(F.col("val") * F.col("part")).alias("val")).where("val > 0")
    gone = groups.select(F.col("id").alias("neuron"))
    return (
        footprints.select("neuron", "pix", "val").join(gone, "neuron", "left_anti").unionByName(f),
        traces.select("neuron", "trace").join(gone, "neuron", "left_anti").unionByName(fit.select(F.col("label").alias("neuron"), "trace")),
    )


def seeded(pixels: DataFrame, height: int, o: Options, sigma: float | None) -> tuple[DataFrame, DataFrame]:
    """(footprints, traces) of the sources of all patches; the seed's pixel is the component's id."""
    size = o.gSiz or int(2 * o.gSig)
    found = cut(patches.sources(patches.blocks(pixels, height, o.patch, min(size, o.patch)), sigma, size, o.min_corr, o.min_pnr, o.min_pixel))
    f = found.select(F.col("pix").alias("neuron"), F.explode(F.arrays_zip("pixels", "weights")).alias("z")).select("neuron", F.col("z.pixels").alias("pix"), F.col("z.weights").alias("val"))
    return f, found.select(F.col("pix").alias("neuron"), "trace")


def residual_seeds(clean: DataFrame, footprints: DataFrame, traces: DataFrame, height: int, o: Options, sigma: float | None) -> tuple[DataFrame, DataFrame]:
    """The components and, with fresh ids, those that the residual still has."""
    f, t = seeded(residual(clean, footprints, traces), height, o, sigma)
    last = footprints.agg(F.coalesce(F.max("neuron"), F.lit(0)).alias("last"))  # one row
    fresh = C.ranked(t.select("neuron"), "neuron").join(F.broadcast(last)).select("neuron", (F.col("last") + F.col("rank")).alias("fresh"))
    name = lambda d: d.join(fresh, "neuron").drop("neuron").withColumnRenamed("fresh", "neuron")
    return footprints.select("neuron", "pix", "val").unionByName(name(f)), traces.select("neuron", "trace").unionByName(name(t))


def demix(pixels: DataFrame, height: int, options: Options | None = None, sigma: float | None = None, rounds: int = 2, more: bool = True) -> dict[str, DataFrame]:
    """Footprints, traces, background and events of a movie: seeds, then background, footprints and traces in turn.

    Each step's result is cut from its history in the shared folder. After the first round, the residual is seeded too.
    """
    o = options or Options()
    pixels = cut(pixels.select("pix", "r", "c", F.transform("y", lambda x: F.nanvl(x, F.lit(0.0))).alias("y")))
    f, t = seeded(pixels, height, o, sigma)
    for k in range(rounds):
        background = cut(update_background(pixels, f, t, height, o))
        clean = cut(without_background(pixels, background))
        f = cut(update_spatial(clean, f, t, height, o))
        t = cut(update_temporal(clean, f, t.join(f.select("neuron").distinct(), "neuron", "left_semi"), height, o))
        f, t = merged(f, t, o)
        if more and k == 0:
            f, t = residual_seeds(clean, f, t, height, o, sigma)
        f, t = cut(f), cut(t)
    # Traces that fit the merged footprints, and the new ones, together.
    t = cut(update_temporal(clean, f, t, height, o))
    return {"footprints": f, "traces": t, "background": background, "events": cut(deconvolution.deconvolved_components(t))}


# Batches of frames. The state is a folder for each table and batch under one path, and a mark when all of them are there.

STATE = ("footprints", "traces", "weights", "offset", "neurons")


def done_batches(spark: SparkSession, path: str) -> list[int]:
    """The batches whose state is complete, in order."""
    marks = f"{path.rstrip('/')}/done"
    if not results.existing(spark, [marks]):
        return []
    return sorted(r["batch"] for r in spark.read.schema("batch int").option("recursiveFileLookup", "true").parquet(marks).select("batch").distinct().collect())


def batch_state(spark: SparkSession, path: str, name: str, batch: int | None = None) -> DataFrame:
    """A table of the state of one batch, or of all that are complete, with their number in `batch`: one read."""
    d = spark.read.parquet(f"{path.rstrip('/')}/{name}")
    return d.where(F.col("batch") == batch).drop("batch") if batch is not None else d.where(F.col("batch").isin(done_batches(spark, path)))


def demix_batch(pixels: DataFrame, batch: int, height: int, path: str, options: Options | None = None, sigma: float | None = None) -> bool:
    """Takes one batch of frames into the state; False, and nothing changes, if the state has it already.

    The first batch is seeded from nothing. A later one starts with the footprints of the batch before and their traces
    through its ring weights, then fits its background and seeds the residual; ids of earlier components stay, new ones
    go on after the largest. The state of a batch that was not finished is written anew.
    """
    from glimmer.plans import descents

    o, spark = options or Options(), pixels.sparkSession
    done = done_batches(spark, path)
    if batch in done:
        return False
    before = max((k for k in done if k < batch), default=None)
    p = cut(pixels.select("pix", "r", "c", F.transform("y", lambda x: F.nanvl(x, F.lit(0.0))).alias("y")))
    ring = o.background_model == "ring"
    if before is None:
        f, t = seeded(p, height, o, sigma)
        old, weights = f.select("neuron").limit(0), None
    else:
        f = cut(batch_state(spark, path, "footprints", before))
        old = cut(batch_state(spark, path, "neurons", before))
        weights = cut(batch_state(spark, path, "weights", before)) if ring else None
        t = cut(descents.known_footprints(p, f, height, o, weights, rounds=2))
        clean = cut(without_background(p, update_background(p, f, t, height, o)))
        f, t = residual_seeds(clean, f, t, height, o, sigma)
    f, t = cut(f), cut(t)
    if ring:
        weights, offset = descents.fit_ring(p, f, t, height, o, weights)
        weights = cut(weights)
        background = descents.reconstructed_background(p, f, t, weights, height, o)
    else:
        background, offset = update_background(p, f, t, height, o), updated_offset(p, f, t)
        weights = spark.createDataFrame([], "patch long, pix long, nbr_pix long, w double, ssub int")
    clean = cut(without_background(p, background))
    t = cut(update_temporal(clean, f, t, height, o))
    f = cut(update_spatial(clean, f, t, height, o))
    born = f.select(F.col("neuron").cast("long").alias("neuron")).distinct().join(old.select("neuron"), "neuron", "left_anti").withColumn("since", F.lit(batch))
    neurons = born if before is None else old.unionByName(born)
    tables = {"footprints": f.select(F.col("neuron").cast("long").alias("neuron"), "pix", "val"), "traces": t.select(F.col("neuron").cast("long").alias("neuron"), "trace"), "weights": weights, "offset": offset, "neurons": neurons}
    for name in STATE:
        tables[name].write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}/batch={batch}")
    # The mark comes last, under its own name, so that marking a batch again changes nothing.
    spark.createDataFrame([(batch,)], "batch int").write.mode("overwrite").parquet(f"{path.rstrip('/')}/done/{batch}")
    return True


def batch_results(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Footprints of all batches, averaged by the energy of their traces in each, and the traces with their batch."""
    traces = batch_state(spark, path, "traces")
    energy = traces.select("neuron", "batch", A.dot(F.col("trace"), F.col("trace")).alias("e"))
    parts = batch_state(spark, path, "footprints").join(energy, ["neuron", "batch"])
    mean = parts.groupBy("neuron", "pix").agg((F.sum(F.col("val") * F.col("e")) / F.sum("e")).alias("val"))
    return {"footprints": mean, "traces": traces}


def demix_batches(movie, ids: list[int], height: int, path: str, options: Options | None = None, sigma: float | None = None) -> dict[str, DataFrame]:
    """Batch after batch (see demix_batch): movie(batch) gives the pixels of a batch. A run that stopped goes on where it was."""
    spark = None
    for k in ids:
        p = movie(k)
        spark = p.sparkSession
        demix_batch(p, k, height, path, options, sigma)
    return batch_results(spark, path)


# Queries on the given tables

_OPTIONS = Options(gSiz=4, patch=8, min_corr=0.1, min_pnr=1.5, min_pixel=0, ring_radius=4, background_model="ring", nb=1)


def _first(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pixels, and the labels seen as components: each has the pixels of its label, and their mean trace."""
    p = pixels(spark, d)
    traces = C.label_traces(samples(p)).select(F.col("label").cast("long").alias("neuron"), "trace")
    return p, p.select(F.col("label").cast("long").alias("neuron"), "pix", A.mean(F.transform("y", F.abs)).alias("val")), traces


_MODEL = f"{_PX}, f AS (SELECT pix, CAST(label AS BIGINT) AS neuron, avg(abs(y)) AS val FROM px GROUP BY pix, label), ct AS (SELECT label AS neuron, t, avg(y) AS x FROM px GROUP BY label, t)"


@query
def background_model_residual(spark, d):
    """Y - A C of the labels' model: its mean and energy by pixel."""
    rest = residual(*_first(spark, d))
    return rest.select("pix", A.rounded(A.mean(F.col("y"))).alias("level"), A.rounded(A.dot(F.col("y"), F.col("y"))).alias("energy"))


SQL["background_model_residual"] = f"{_MODEL} SELECT px.pix, {r('avg(y - val * x)')} AS level, {r('sum(pow(y - val * x, 2))')} AS energy FROM px JOIN f ON f.pix = px.pix JOIN ct ON ct.neuron = f.neuron AND ct.t = px.t GROUP BY px.pix"


@query
def baseline_offset(spark, d):
    """b0: mean of Y less that of A C."""
    return updated_offset(*_first(spark, d))


SQL["baseline_offset"] = f"{_MODEL}, m AS (SELECT neuron, avg(x) AS m FROM ct GROUP BY neuron) SELECT px.pix, {r('avg(y) - any_value(val * m)')} AS b0 FROM px JOIN f ON f.pix = px.pix JOIN m ON m.neuron = f.neuron GROUP BY px.pix"


@query
def search_regions(spark, d):
    """The pixels in the search ellipse of each component of a frame."""
    p = pixels(spark, d)
    f = C.footprints(samples(p), 0.3)
    return search_region(f, p, 1, 3, 1).select(F.col("label").alias("neuron"), "pix")


SQL["search_regions"] = f"{_PX}, f AS (SELECT t AS neuron, pix, y AS val, r, c FROM px WHERE y > 0.3), m AS (SELECT neuron, sum(val * r) / sum(val) AS cr, sum(val * c) / sum(val) AS cc, sum(val * r * r) / sum(val) AS rr, sum(val * r * c) / sum(val) AS rc, sum(val * c * c) / sum(val) AS ccc FROM f GROUP BY neuron), v AS (SELECT neuron, cr, cc, rr - cr * cr AS vr, ccc - cc * cc AS vc, rc - cr * cc AS cov FROM m), e AS (SELECT neuron, {r('cr')} AS cr, {r('cc')} AS cc, {r('sqrt(least(greatest((vr + vc) / 2 + sqrt(pow((vr - vc) / 2, 2) + cov * cov), 1), 9))')} AS a, {r('sqrt(least(greatest((vr + vc) / 2 - sqrt(pow((vr - vc) / 2, 2) + cov * cov), 1), 9))')} AS b, {r('atan2(2 * cov, vr - vc) / 2')} AS w FROM v) SELECT CAST(neuron AS INT) AS neuron, pix FROM e, p WHERE pow(((r - cr) * cos(w) + (c - cc) * sin(w)) / a, 2) + pow(((c - cc) * cos(w) - (r - cr) * sin(w)) / b, 2) <= 1"


_PSF = I.centred_psf(0.8)
_TAPS = ", ".join(f"({i - len(_PSF) // 2}, {j - len(_PSF) // 2}, CAST({float(_PSF[i, j])!r} AS DOUBLE))" for i in range(len(_PSF)) for j in range(len(_PSF)) if _PSF[i, j])


@query
def psf_filter(spark, d):
    """The mean image filtered by a centred Gaussian, border pixels going on outside: joins on clamped positions."""
    p = pixels(spark, d).select("pix", "r", "c", A.mean(F.col("y")).alias("m"))
    return neighbours.filtered(p, "m", [(i - len(_PSF) // 2, j - len(_PSF) // 2, float(_PSF[i, j])) for i in range(len(_PSF)) for j in range(len(_PSF)) if _PSF[i, j]])


SQL["psf_filter"] = f"{_PX}, m AS (SELECT pix, r, c, avg(y) AS m FROM px GROUP BY pix, r, c), s AS (SELECT max(r) AS h, max(c) AS w FROM p), k(dr, dc, v) AS (VALUES {_TAPS}) SELECT a.pix, {r('sum(k.v * b.m)', 8)} AS m FROM m a, s, k, m b WHERE b.r = least(greatest(a.r + dr, 0), h) AND b.c = least(greatest(a.c + dc, 0), w) GROUP BY a.pix"


def _blurred(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as a movie of sources: large values are events that spread over their neighbours and decay in time."""
    events = pixels(spark, d).withColumn("y", F.transform("y", lambda x: F.when(x > 0.3, 10 * x).otherwise(x)))
    return cut(patches.smoothed(patches.blocks(events, HEIGHT, 8, 6), 1.5, 0.8))


@query
def endoscope_screen(spark, d):
    """Local correlation and peak-to-noise ratio of the filtered movie, patch by patch."""
    return patches.correlation_pnr(patches.blocks(_blurred(spark, d), HEIGHT, 8, 5), 1.0)


@query
def endoscope_screen_batches(spark, d):
    """The same for each half of the frames, batch by batch."""
    p, out = _blurred(spark, d), None
    for k in range(2):
        part = p.withColumn("y", F.slice("y", 1 + 32 * k, 32))
        found = patches.correlation_pnr(patches.blocks(part, HEIGHT, 8, 5), 1.0).withColumn("batch", F.lit(k))
        out = found if out is None else out.unionByName(found)
    return out


@query
def endoscope_sources(spark, d):
    """Seeding with local background and a filtered movie."""
    found = patches.sources(patches.blocks(_blurred(spark, d), HEIGHT, 8, 6), 1.0, 4, 0.1, 1.5, 0)
    return found.select("patch", "pix", "score", F.size("pixels").alias("n_pixels"), A.rounded(A.total(F.col("weights")), 4).alias("mass"))


def _masses(found: DataFrame) -> DataFrame:
    return found.select("patch", "rank", "pix", F.size("pixels").alias("n_pixels"), A.rounded(A.total(F.col("weights")), 4).alias("mass"))


@query
def rank_one_sources(spark, d):
    """The three sources of most energy in each patch."""
    return _masses(patches.rank_one_sources(patches.blocks(_blurred(spark, d), HEIGHT, 8, 4), 1.5, 3, 3))


@query
def rank_one_sources_corr(spark, d):
    """The three sources of each patch that are most like their neighbours and stand out most."""
    return _masses(patches.rank_one_sources(patches.blocks(_blurred(spark, d), HEIGHT, 8, 4), 1.5, 3, 3, "corr"))


@query
def neighbour_weights(spark, d):
    return patches.neighbour_weights(patches.blocks(pixels(spark, d), HEIGHT, 8, 3), 2, 3)


def _levels(d: DataFrame) -> DataFrame:
    return d.select("pix", A.rounded(A.mean(F.col("b")), 5).alias("level"), A.rounded(A.deviation(F.col("b")), 5).alias("spread"))


@query
def update_background_ring(spark, d):
    return _levels(update_background(*_first(spark, d), HEIGHT, _OPTIONS))


@query
def update_background_svd(spark, d):
    from dataclasses import replace

    return _levels(update_background(*_first(spark, d), HEIGHT, replace(_OPTIONS, background_model="svd")))


@query
def update_background_nmf(spark, d):
    from dataclasses import replace

    return _levels(update_background(*_first(spark, d), HEIGHT, replace(_OPTIONS, background_model="nmf")))


def _spatial(spark, d, method: str) -> DataFrame:
    p, f, t = _first(spark, d)
    region = C.label_region(p)
    c = t.select(F.col("neuron").cast("int").alias("label"), "trace")
    noise = deconvolution.noise(p, "pix")
    if method == "lars":
        noise = noise.join(p.select("pix", A.dot(C.centred(F.col("y")), C.centred(F.col("y"))).alias("energy"), F.size("y").cast("double").alias("frames")), "pix")
    return patches.spatial_update(C.spatial_sums(p, region, c), C.gram(c, C.region_pairs(region)), method, noise=noise if method not in ("nnls", "hals", "clamped") else None)


@query
def hals_spatial(spark, d):
    return _spatial(spark, d, "hals")


@query
def hals_spatial_thresh(spark, d):
    return _spatial(spark, d, "hals_thresh")


@query
def nnls_spatial_thresh(spark, d):
    return _spatial(spark, d, "nnls_thresh")


@query
def clamped_spatial(spark, d):
    return _spatial(spark, d, "clamped")


@query
def lars_spatial(spark, d):
    return _spatial(spark, d, "lars")


def _spots(spark: SparkSession, d: str) -> DataFrame:
    """The bright pixels of each frame of the blurred movie as the footprint of a component."""
    s = samples(_blurred(spark, d)).where("y > 0")
    return s.select(F.col("t").cast("long").alias("neuron"), "pix", "r", "c", F.col("y").alias("val"))


@query
def post_processed(spark, d):
    """Footprints in order: what their opened image connects with the peak, without weak outer pixels."""
    return patches.shaped(_spots(spark, d), "convex").withColumn("val", A.rounded(F.col("val"), 5))


@query
def thresholded_components(spark, d):
    return patches.shaped(_spots(spark, d), "energy", 0.9).withColumn("val", A.rounded(F.col("val"), 5))


@query
def hals_temporal(spark, d):
    p, f, t = _first(spark, d)
    new = update_temporal(p, f, t, HEIGHT, _OPTIONS)
    return new.select("neuron", A.rounded(A.mean(F.col("trace")), 5).alias("level"), A.rounded(A.deviation(F.col("trace")), 5).alias("spread"))


@query
def update_order(spark, d):
    """Turns in which overlapping components may be updated: no two of one turn overlap much."""
    f = C.footprints(samples(pixels(spark, d)), 0.15)
    pairs = C.overlap_cosine(f, 0.2)
    return graph.update_order(pairs, f.select(F.col("neuron").alias("id")))


@query
def demixed(spark, d):
    """The whole loop over the embeddings as a movie: components with their size, level and events."""
    out = demix(_blurred(spark, d), HEIGHT, _OPTIONS, 1.0, rounds=1)
    n = out["footprints"].groupBy("neuron").agg(F.count("*").alias("n_pixels"))
    return out["events"].join(n, "neuron").select("neuron", "n_pixels", F.size(F.filter("s", lambda x: x > 0)).alias("n_events"))


@query
def demixed_batches(spark, d):
    """The loop over two batches of frames, with the footprints going on."""
    p = _blurred(spark, d)
    path = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}"
    out = demix_batches(lambda k: p.withColumn("y", F.slice("y", 1 + 32 * k, 32)), [0, 1], HEIGHT, path, _OPTIONS, 1.0)
    return out["footprints"].groupBy("neuron").agg(F.count("*").alias("n_pixels"), A.rounded(F.sum("val"), 4).alias("mass"))
