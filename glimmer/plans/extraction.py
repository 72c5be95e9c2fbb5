"""Extraction of sources from a movie: seeds, footprints, traces, merges, events, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.functions import arrays as A
from glimmer.operators import components as C
from glimmer.operators import deconvolution, descent, graph, patches
from glimmer.operators.shared import cut
from glimmer.options import Options
from glimmer.plans import updates


def extract(pixels: DataFrame, height: int, options: Options | None = None) -> dict[str, DataFrame]:
    """Tables footprints (neuron, pix, val), traces (neuron, trace) and neurons (neuron, n_pixels, tag, snr, events).

    pixels: (pix, r, c, y), one row per pixel. Patches with their halo are independent; a component that two patches
    have found is merged by its overlap and its trace. Everything but the seeding is a sum by pixel or by component.
    """
    o = options or Options()
    radius = o.gSiz or int(2 * o.gSig)
    centred = pixels.withColumn("y", A.given(A.median(F.col("y")), lambda m: F.transform("y", lambda x: F.nanvl(x, F.lit(0.0)) - m)))
    centred = cut(centred)
    found = patches.seeds(patches.blocks(centred, height, o.patch, min(radius, o.patch)), radius, o.min_corr * o.min_pnr, o.seeds_per_patch)
    seeds = found.join(pixels.select("pix", "r", "c"), "pix").select(F.col("pix").alias("neuron"), "r", "c", "trace", "score")

    # Footprint: each pixel near a seed regressed on the trace of each seed near it.
    near = _near(centred, seeds, radius)
    val = F.greatest(A.dot(F.col("y"), F.col("trace")) / A.dot(F.col("trace"), F.col("trace")), F.lit(0.0))
    footprints = near.select("neuron", "pix", "r", "c", val.alias("val"))
    footprints = footprints.withColumn("top", F.max("val").over(Window.partitionBy("neuron"))).where("val > 0.1 * top").drop("top")

    pairs = C.overlap_cosine(footprints, 0.1).join(seeds.select(F.col("neuron").alias("a"), F.col("trace").alias("x")), "a").join(seeds.select(F.col("neuron").alias("b"), F.col("trace").alias("z")), "b")
    pairs = pairs.where(A.correlation(F.col("x"), F.col("z")) >= o.merge_thr).select("a", "b")
    if pairs.head(1):
        groups = graph.connected_components(pairs)
        named = footprints.join(groups.withColumnRenamed("id", "neuron"), "neuron", "left").withColumn("neuron", F.coalesce("label", "neuron"))
        footprints = named.groupBy("neuron", "pix", "r", "c").agg(F.max("val").alias("val"))

    bright = footprints.withColumn("top", F.max("val").over(Window.partitionBy("neuron"))).where("val >= 0.5 * top").select("neuron", "pix", "val")
    frames = centred.select("pix", "y").join(bright, "pix").select("neuron", "val", F.posexplode("y").alias("t", "y"))
    sums = frames.groupBy("neuron", "t").agg((F.sum(F.col("val") * F.col("y")) / F.sum(F.col("val") * F.col("val"))).alias("y"))
    traces = sums.groupBy("neuron").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "y"))), lambda x: x["y"]).alias("y"))

    events = deconvolution.deconvolved(traces, "neuron")
    size = footprints.where("val > 0").groupBy("neuron").agg(F.count("*").alias("n_pixels"))
    d = events.join(size, "neuron").join(traces, "neuron")
    rest = F.zip_with("y", "c", lambda a, b: a - b)
    d = d.select("neuron", "n_pixels", "c", "s", "sn", F.size(F.filter(F.slice("s", 2, F.size("s")), lambda x: x > 0)).alias("n_events"), A.deviation(rest).alias("residual"), F.col("sn").alias("noise"), F.array_max("c").alias("peak"), A.deviation(F.col("c")).alias("spread"))
    neurons = d.join(C.tags(d, o.min_pixel), "neuron").select("neuron", "n_pixels", "tag", (F.col("spread") / F.col("residual")).alias("snr"), F.col("n_events").alias("events"))
    return {"footprints": footprints.select("neuron", "pix", "val"), "traces": traces.withColumnRenamed("y", "trace"), "neurons": neurons}


def merged_to_the_end(footprints: DataFrame, traces: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """Merges (updates.merged) until no two components are left that overlap and have similar traces.

    What a merge makes may be like another component that its parts were not like. The rounds end with the number of
    components, which falls; the tables of a round are cut from those before.
    """
    count = lambda t: t.agg(F.count("*")).head()[0]
    f, t = cut(footprints.select("neuron", "pix", "val")), cut(traces.select("neuron", "trace"))
    before, n = None, count(t)
    while n != before:
        f, t = map(cut, updates.merged(f, t, o))
        before, n = n, count(t)
    return f, t


def rank_one_background(background: DataFrame, factors: DataFrame, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """(b (pix, val), f (trace), one row): the non-negative rank-one fit to what the backgrounds of all patches add up to.

    background: (k, pix, val), factors: (k, trace), k being a component of a patch. The fit never forms their product: b
    needs each factor's product with f, and f the backgrounds' products with b, both sums by k or pix; only f, a trace,
    meets all rows, as one row.
    """
    back, factors = cut(background.select("k", "pix", "val")), cut(factors.select("k", "trace"))
    one = lambda d: F.broadcast(d)  # noqa: E731  a single row
    mean = factors.select(F.posexplode("trace").alias("t", "x")).groupBy("t").agg(F.avg("x").alias("x"))
    f = cut(descent.array_of(mean.withColumn("one", F.lit(1)), "one", "x", "f").select("f"))
    b = None
    for _ in range(rounds):
        part = factors.join(one(f)).select("k", (A.dot(F.col("trace"), F.col("f")) / F.greatest(A.dot(F.col("f"), F.col("f")), F.lit(1e-300))).alias("g"))
        b = cut(back.join(part, "k").groupBy("pix").agg(F.greatest(F.sum(F.col("val") * F.col("g")), F.lit(0.0)).alias("val")))
        energy = b.agg(F.greatest(F.sum(F.col("val") * F.col("val")), F.lit(1e-300)).alias("e"))
        links = back.join(b.withColumnRenamed("val", "b"), "pix").groupBy(F.col("k").alias("neuron")).agg(F.sum(F.col("val") * F.col("b")).alias("v"))
        s = descent.combined(links.withColumn("k", F.lit(1)), factors.withColumnRenamed("k", "neuron"))
        f = cut(s.join(one(energy)).select(F.transform("s", lambda x: F.greatest(x / F.col("e"), F.lit(0.0))).alias("f")))
    return b, f.withColumnRenamed("f", "trace")


def by_patches(pixels: DataFrame, height: int, options: Options | None = None, sigma: float | None = None) -> dict[str, DataFrame]:
    """Extraction in which patches meet once: sources and background of each, merges to the end, one background of all.

    Tables footprints, traces, background (pix, val) and factor (trace, one row).
    """
    o = options or Options()
    y = cut(pixels.select("pix", "r", "c", F.transform("y", lambda x: F.nanvl(x, F.lit(0.0))).alias("y")))
    f, t = merged_to_the_end(*updates.seeded(y, height, o, sigma), o)
    t = cut(updates.update_temporal(cut(updates.without_background(y, updates.update_background(y, f, t, height, o))), f, t, height, o))
    parts = cut(patches.factors(patches.blocks(updates.residual(y, f, t), height, o.patch, 0), max(o.nb, 1)))
    b, g = rank_one_background(parts.select("k", F.inline(F.arrays_zip(F.col("pixels").alias("pix"), F.col("weights").alias("val")))), parts.select("k", "trace"))
    return {"footprints": f, "traces": t, "background": b, "factor": g}


def _near(pixels: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """Pixels and the seeds within the radius, by an equi join on grid cells of that size."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    s = seeds.select("neuron", "trace", "score", F.col("r").alias("sr"), F.col("c").alias("sc"), F.explode(steps).alias("x"))
    s = s.withColumns({"gr": F.floor(F.col("sr") / radius) + F.col("x.i"), "gc": F.floor(F.col("sc") / radius) + F.col("x.j")}).drop("x")
    p = pixels.withColumns({"gr": F.floor(F.col("r") / radius), "gc": F.floor(F.col("c") / radius)})
    return p.join(s, ["gr", "gc"]).where((F.abs(F.col("r") - F.col("sr")) <= radius) & (F.abs(F.col("c") - F.col("sc")) <= radius))
