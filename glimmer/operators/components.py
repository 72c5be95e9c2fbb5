"""Components (neurons): footprints (neuron, pix, val) and traces, compared, merged, tagged and ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.functions import arrays as A
from glimmer.operators.neighbours import neighbour_pairs, ring
from glimmer.operators.shared import ranked


def footprints(samples: DataFrame, level: float) -> DataFrame:
    """(neuron, pix, val) of the values over a level: the frame number stands in for the neuron."""
    return samples.where(F.col("y") > level).select(F.col("t").alias("neuron"), "pix", F.col("y").alias("val"), "r", "c")


def centre_of_mass(footprints: DataFrame) -> DataFrame:
    mass = lambda x: A.rounded(F.sum(F.col(x) * F.col("val")) / F.sum("val"))
    return footprints.groupBy("neuron").agg(mass("r").alias("cr"), mass("c").alias("cc"), F.count("*").alias("n_pixels"))


def overlap_cosine(footprints: DataFrame, least: float, support: bool = False) -> DataFrame:
    """(a, b, cosine) of pairs whose footprints (or their supports) overlap: a sparse Gram matrix by a join on pix."""
    f = footprints.select("neuron", "pix", (F.lit(1.0) if support else F.col("val")).alias("v"))
    norm = f.groupBy("neuron").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    other = f.select(F.col("neuron").alias("b"), "pix", F.col("v").alias("w"))
    gram = f.join(other, "pix").where("neuron < b").groupBy(F.col("neuron").alias("a"), "b").agg(F.sum(F.col("v") * F.col("w")).alias("g"))
    gram = gram.join(norm.select(F.col("neuron").alias("a"), F.col("norm").alias("na")), "a").join(norm.select(F.col("neuron").alias("b"), F.col("norm").alias("nb")), "b")
    return gram.select("a", "b", A.rounded(F.col("g") / (F.col("na") * F.col("nb"))).alias("cosine")).where(F.col("cosine") >= least)


def label_traces(samples: DataFrame) -> DataFrame:
    """(label, trace): the mean trace of each label's pixels, in time order."""
    mean = samples.groupBy("label", "t").agg(F.avg("y").alias("y"))
    return mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "y"))), lambda x: x["y"]).alias("trace"))


def adjacent_labels(pixels: DataFrame) -> DataFrame:
    """(a, b) of the labels that touch each other in the image, a < b: an equi join on shifted positions."""
    pairs = neighbour_pairs(pixels.select("pix", "r", "c", "label"), ring(1, 2), "label")
    return pairs.where("label < n_label").select(F.col("label").alias("a"), F.col("n_label").alias("b")).distinct()


def trace_correlation(components: DataFrame, pairs: DataFrame, least: float, key: str = "label") -> DataFrame:
    """(a, b, corr) of the given pairs whose traces are similar."""
    a, b = components.select(F.col(key).alias("a"), F.col("trace").alias("x")), components.select(F.col(key).alias("b"), F.col("trace").alias("z"))
    d = pairs.select("a", "b").join(a, "a").join(b, "b")
    return d.select("a", "b", A.rounded(A.correlation(F.col("x"), F.col("z"))).alias("corr")).where(F.col("corr") >= least)


def trace_cosine(components: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity): the cosine of the traces (neuron, trace) of the given pairs (a, b)."""
    x, z = F.col("x"), F.col("z")
    a, b = components.select(F.col("neuron").alias("a"), F.col("trace").alias("x")), components.select(F.col("neuron").alias("b"), F.col("trace").alias("z"))
    d = pairs.select("a", "b").join(a, "a").join(b, "b")
    return d.select("a", "b", A.rounded(A.dot(x, z) / F.sqrt(A.dot(x, x) * A.dot(z, z))).alias("similarity"))


def spikes(trace: Column, g: float) -> Column:
    """What a trace rises over its own decay, from its second frame on."""
    return F.transform(trace, lambda x, i: F.when(i > 0, F.greatest(x - g * F.get(trace, i - 1), F.lit(0.0))).otherwise(0.0))


def decay_time(trace: Column) -> Column:
    """-1 / ln(g) with g the correlation of a trace with itself a frame later, between 0.01 and 0.99."""
    n = F.size(trace) - 1
    g = A.correlation(F.slice(trace, 1, n), F.slice(trace, 2, n))
    return -1 / F.ln(F.least(F.greatest(g, F.lit(0.01)), F.lit(0.99)))


def overlapping_and_similar(footprints: DataFrame, traces: DataFrame, overlap: float, corr: float, spike_corr: float, g: float) -> DataFrame:
    """Merge candidates (a, b, cosine, corr, spike_corr): footprints, traces and spikes are all alike.

    traces: (neuron, trace). Pairs come from a join on pix; a trace that does not vary is like no other.
    """
    t = traces.select("neuron", "trace", spikes(F.col("trace"), g).alias("s"))
    side = lambda k: t.select(F.col("neuron").alias(k), F.col("trace").alias(f"c{k}"), F.col("s").alias(f"s{k}"))
    d = overlap_cosine(footprints, overlap).join(side("a"), "a").join(side("b"), "b")
    d = d.select("a", "b", "cosine", A.rounded(A.correlation(F.col("ca"), F.col("cb"))).alias("corr"), A.rounded(A.correlation(F.col("sa"), F.col("sb"))).alias("spike_corr"))
    return d.where((F.col("corr") >= corr) & (F.col("spike_corr") >= spike_corr))


def near_and_similar(footprints: DataFrame, traces: DataFrame, reach: float, corr: float, most_delta: float) -> DataFrame:
    """Merge candidates (a, b, dist, corr, delta_tau): centres within reach, traces alike, decay times within most_delta."""
    mass = lambda x: (F.sum(F.col(x) * F.col("val")) / F.sum("val")).alias(x)
    centres = footprints.groupBy(F.col("neuron").alias("id")).agg(mass("r"), mass("c"))
    t = traces.select("neuron", "trace", decay_time(F.col("trace")).alias("tau"))
    side = lambda k: t.select(F.col("neuron").alias(k), F.col("trace").alias(f"c{k}"), F.col("tau").alias(f"t{k}"))
    d = near_pairs(centres, reach).join(side("a"), "a").join(side("b"), "b")
    d = d.select("a", "b", "dist", A.rounded(A.correlation(F.col("ca"), F.col("cb"))).alias("corr"), A.rounded(F.abs(F.col("ta") - F.col("tb")), 4).alias("delta_tau"))
    return d.where((F.col("corr") >= corr) & (F.col("delta_tau") < most_delta))


def near_pairs(points: DataFrame, reach: float) -> DataFrame:
    """(a, b, dist) of points within reach, by an equi join on grid cells of that size and the cells around."""
    cell = lambda x: F.floor(F.col(x) / reach)
    a = points.select(F.col("id").alias("a"), "r", "c", cell("r").alias("gr"), cell("c").alias("gc"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = points.select(F.col("id").alias("b"), F.col("r").alias("r2"), F.col("c").alias("c2"), F.explode(steps).alias("s")).withColumns({"gr": F.floor(F.col("r2") / reach) + F.col("s.i"), "gc": F.floor(F.col("c2") / reach) + F.col("s.j")})
    dist = F.sqrt(F.pow(F.col("r") - F.col("r2"), 2) + F.pow(F.col("c") - F.col("c2"), 2))
    return a.join(b, ["gr", "gc"]).where("a < b").select("a", "b", A.rounded(dist).alias("dist")).where(F.col("dist") <= reach)


def weighted_partial_mean(parts: DataFrame) -> DataFrame:
    """Traces of components that several patches estimate, weighted by their share: (neuron, t, y) from (neuron, t, y, w)."""
    return parts.groupBy("neuron", "t").agg(A.rounded(F.sum(F.col("w") * F.col("y")) / F.when(F.sum("w") != 0, F.sum("w")).otherwise(1.0)).alias("y"))


def energy_pixels(footprints: DataFrame, share: float) -> DataFrame:
    """The pixels that hold `share` of a footprint's energy, the brightest first: (neuron, pix)."""
    w = Window.partitionBy("neuron")
    up = w.orderBy(F.col("e"), F.desc("pix")).rowsBetween(Window.unboundedPreceding, 0)
    f = footprints.withColumn("e", F.round(F.col("val") * F.col("val"), 9).cast("decimal(30,9)"))
    f = f.select("neuron", "pix", F.sum("e").over(up).alias("below"), F.sum("e").over(w).alias("all"))
    return f.where(F.col("below") > F.col("all") * F.lit(1 - share).cast("decimal(10,4)")).select("neuron", "pix")


def explained_by(footprints: DataFrame) -> DataFrame:
    """The component that holds most of each pixel, by its share of the component's mass; the smallest id of equals."""
    w = Window.partitionBy("pix").orderBy(F.desc("share"), "neuron")
    f = footprints.withColumn("share", F.round(F.col("val") / F.sum("val").over(Window.partitionBy("neuron")), 9))
    return f.withColumn("k", F.row_number().over(w)).where("k = 1").select("pix", "neuron", A.rounded(F.col("share")).alias("share"))


def top_seeds(scores: DataFrame, k: int) -> DataFrame:
    """The k best seeds of each label: (label, pix, rank) from (label, pix, score)."""
    w = Window.partitionBy("label").orderBy(F.desc("score"), "pix")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("label", "pix", "rank", "score")


def mutual_best(pairs: DataFrame) -> DataFrame:
    """One-to-one matches: pairs (a, b, s) that are each other's best."""
    best = lambda x, other: F.row_number().over(Window.partitionBy(x).orderBy(F.desc("s"), other))
    return pairs.select("a", "b", "s", best("a", "b").alias("ka"), best("b", "a").alias("kb")).where("ka = 1 and kb = 1").select("a", "b", A.rounded(F.col("s")).alias("s"))


def tags(neurons: DataFrame, min_pixel: int) -> DataFrame:
    """Bits of what speaks against a component: 1 few pixels, 2 no event, 4 residual below the noise, 8 a weak peak."""
    bit = lambda condition, value: F.when(condition, value).otherwise(0)
    tag = bit(F.col("n_pixels") < min_pixel, 1) + bit(F.col("n_events") == 0, 2) + bit(F.col("residual") / F.col("noise") < 0.1, 4) + bit(F.col("peak") / F.col("spread") < 3, 8)
    return neurons.select("neuron", tag.alias("tag"))


def without_false_positives(neurons: DataFrame, tagged: DataFrame) -> DataFrame:
    return neurons.join(tagged.where("tag > 0"), "neuron", "left_anti")


def residual_energy(samples: DataFrame) -> DataFrame:
    """Sum of squares about the pixel's mean, per label and in all (label null): (label, is_total, rss)."""
    d = samples.withColumn("m", F.avg("y").over(Window.partitionBy("pix")))
    return d.rollup("label").agg(F.grouping("label").cast("int").alias("is_total"), A.rounded(F.sum(F.pow(F.col("y") - F.col("m"), 2)), 4).alias("rss"))


def label_region(pixels: DataFrame) -> DataFrame:
    """(pix, label): where a label may have weight, its own pixels and those next to them."""
    pairs = neighbour_pairs(pixels.select("pix", "r", "c", "label"), ring(0, 2), "label")
    return pairs.select("pix", F.col("n_label").alias("label")).distinct()


def centred(y: Column) -> Column:
    return A.given(A.mean(y), lambda m: F.transform(y, lambda x: x - m))


def spatial_sums(pixels: DataFrame, region: DataFrame, traces: DataFrame) -> DataFrame:
    """U = Y C' without the means, within the search region: (pix, label, u) from pixels, (pix, label) and (label, trace)."""
    y = pixels.select("pix", centred(F.col("y")).alias("y"))
    d = region.join(traces.select("label", centred(F.col("trace")).alias("x")), "label").join(y, "pix")
    return d.select("pix", "label", A.dot(F.col("y"), F.col("x")).alias("u"))


def gram(traces: DataFrame, pairs: DataFrame) -> DataFrame:
    """V = C C' without the means for the given pairs, each component with itself among them: (a, b, v)."""
    t = traces.select("label", centred(F.col("trace")).alias("x"))
    d = pairs.select("a", "b").join(t.select(F.col("label").alias("a"), F.col("x").alias("xa")), "a").join(t.select(F.col("label").alias("b"), F.col("x").alias("xb")), "b")
    return d.select("a", "b", A.dot(F.col("xa"), F.col("xb")).alias("v"))


def region_pairs(region: DataFrame) -> DataFrame:
    """(a, b) of the labels that meet in a pixel, each with itself too."""
    other = region.select("pix", F.col("label").alias("b"))
    return region.select("pix", F.col("label").alias("a")).join(other, "pix").select("a", "b").distinct()


def fast_projection(footprints: DataFrame, samples: DataFrame) -> DataFrame:
    """sum(a y) / sum(a a) over the pixels of half the peak or more: (neuron, t, y)."""
    bright = footprints.withColumn("top", F.max("val").over(Window.partitionBy("neuron"))).where("val >= 0.5 * top").select("neuron", "pix", "val")
    return samples.select("pix", "t", "y").join(bright, "pix").groupBy("neuron", "t").agg(A.rounded(F.sum(F.col("val") * F.col("y")) / F.sum(F.col("val") * F.col("val"))).alias("y"))


def projected(footprints: DataFrame, pixels: DataFrame) -> DataFrame:
    """(neuron, t, b): the traces y of pixels (pix, y) on each footprint, sum(a y) / sum(a a) over its pixels; frames count from 1.

    Sums by neuron and frame are partial before they are shuffled, so no task holds the traces of a footprint.
    """
    d = footprints.select("neuron", "pix", "val").join(pixels.select("pix", "y"), "pix").select("neuron", "val", F.posexplode("y").alias("t", "y"))
    s = d.groupBy("neuron", "t").agg(F.sum(F.col("val") * F.col("y")).alias("s"), F.sum(F.col("val") * F.col("val")).alias("e"))
    return s.select("neuron", (F.col("t") + 1).alias("t"), (F.col("s") / F.col("e")).alias("b"))


def order_by_snr(neurons: DataFrame) -> DataFrame:
    """(neuron, snr, rank): variance of the trace over that of the rest, largest first."""
    return ranked(neurons.select("neuron", A.rounded(F.col("signal") / F.when(F.col("rest") != 0, F.col("rest"))).alias("snr")), F.desc("snr"), "neuron")


def order_keys(footprints: DataFrame, traces: DataFrame) -> DataFrame:
    """What components may be ordered by: (neuron, decay_time, mean, sparsity_spatial, sparsity_temporal, circularity, pnr, l4).

    Sparsity is the norm of order 1 over that of order 2; circularity the ratio of the footprint's axes; l4 the peak of
    the trace times the norm of order 4 of the footprint at unit norm.
    """
    v, r, c = F.col("val"), F.col("r"), F.col("c")
    f = footprints.groupBy("neuron").agg(F.sum(v).alias("s"), F.sum(v * v).alias("s2"), F.sum(F.pow(v, F.lit(4))).alias("s4"), F.sum(v * r).alias("vr"), F.sum(v * c).alias("vc"), F.sum(v * r * r).alias("vrr"), F.sum(v * c * c).alias("vcc"), F.sum(v * r * c).alias("vrc"))
    f = f.select("neuron", "s", "s2", "s4", (F.col("vrr") / F.col("s") - F.pow(F.col("vr") / F.col("s"), 2)).alias("a"), (F.col("vcc") / F.col("s") - F.pow(F.col("vc") / F.col("s"), 2)).alias("b"), (F.col("vrc") / F.col("s") - F.col("vr") * F.col("vc") / F.col("s") / F.col("s")).alias("k"))
    half, spread = (F.col("a") + F.col("b")) / 2, F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, 2) + F.pow("k", 2))
    x = F.col("trace")
    t = traces.select("neuron", A.rounded(decay_time(x), 4).alias("decay_time"), A.rounded(A.mean(x)).alias("mean"), A.rounded(A.total(F.transform(x, F.abs)) / F.sqrt(A.dot(x, x))).alias("sparsity_temporal"), A.rounded((F.array_max(x) - A.median(x)) / A.deviation(x)).alias("pnr"), F.array_max(x).alias("peak"))
    d = f.join(t, "neuron")
    return d.select("neuron", "decay_time", "mean", A.rounded(F.col("s") / F.sqrt("s2")).alias("sparsity_spatial"), "sparsity_temporal", A.rounded((half - spread) / (half + spread), 5).alias("circularity"), "pnr", A.rounded(F.col("peak") * F.pow("s4", F.lit(0.25)) / F.sqrt("s2")).alias("l4"))


def ordered(keys: DataFrame, by: str) -> DataFrame:
    """(neuron, key, rank) by one of order_keys: decay_time, sparsity_spatial and circularity rise, the others fall."""
    up = by in ("decay_time", "sparsity_spatial", "circularity")
    return ranked(keys.select("neuron", F.col(by).alias("key")), F.col("key") if up else F.desc("key"), "neuron")


def active_share(footprints: DataFrame, active: DataFrame, least: float) -> DataFrame:
    """(neuron, share, is_active): the part of a footprint's energy on the pixels (pix) that are active."""
    e = F.col("val") * F.col("val")
    d = footprints.join(active.select("pix", F.lit(1.0).alias("on")).distinct(), "pix", "left").groupBy("neuron").agg(A.rounded(F.sum(e * F.coalesce("on", F.lit(0.0))) / F.sum(e)).alias("share"))
    return d.withColumn("is_active", F.col("share") >= least * least)


def modelled(footprints: DataFrame, traces: DataFrame) -> DataFrame:
    """A C: (pix, t, ac) from (neuron, pix, val) and (neuron, t, x)."""
    return footprints.select("neuron", "pix", "val").join(traces, "neuron").groupBy("pix", "t").agg(F.sum(F.col("val") * F.col("x")).alias("ac"))


def merge_audit(groups: DataFrame, footprints: DataFrame) -> DataFrame:
    """What a merge does: (label, members, n_members, pixels_before, pixels_after) of each group (id, label)."""
    d = groups.withColumnRenamed("id", "neuron").join(footprints.select("neuron", "pix"), "neuron")
    return d.groupBy("label").agg(F.array_join(F.transform(F.sort_array(F.collect_set("neuron")), lambda x: x.cast("string")), ",").alias("members"), F.countDistinct("neuron").alias("n_members"), F.count("*").alias("pixels_before"), F.countDistinct("pix").alias("pixels_after"))


def contours(footprints: DataFrame, share: float) -> DataFrame:
    """(neuron, contour): the pixels that hold `share` of the energy, as a JSON text {"neuron":..,"pixels":[..]}."""
    d = energy_pixels(footprints, share).groupBy("neuron").agg(F.sort_array(F.collect_list("pix")).alias("pixels"))
    return d.select("neuron", F.to_json(F.struct("neuron", "pixels")).alias("contour"))


def spike_competition(footprints: DataFrame, traces: DataFrame, reach: float, width: int, g: float) -> DataFrame:
    """(neuron, t, z): the spikes, in deviations, that no neighbour within reach outdoes in the `width` frames around.

    Neighbours come from grid cells; a spike is only compared with those of the same frames.
    """
    mass = lambda x: (F.sum(F.col(x) * F.col("val")) / F.sum("val")).alias(x)
    near = near_pairs(footprints.groupBy(F.col("neuron").alias("id")).agg(mass("r"), mass("c")), reach)
    both = near.select(F.col("a").alias("neuron"), "b").union(near.select(F.col("b").alias("neuron"), F.col("a").alias("b")))
    s = traces.select("neuron", spikes(F.col("trace"), g).alias("s"))
    z = s.select("neuron", F.posexplode(F.transform("s", lambda x: F.round(x / A.deviation(F.col("s")), 9))).alias("t", "z")).select("neuron", (F.col("t") + 1).alias("t"), "z").where("z > 0")
    other = z.select(F.col("neuron").alias("b"), F.explode(F.sequence(F.col("t") - width, F.col("t") + width)).alias("t"), F.col("z").alias("other"))
    top = both.join(other, "b").groupBy("neuron", "t").agg(F.max("other").alias("top"))
    return z.join(top, ["neuron", "t"], "left").where(F.col("top").isNull() | (F.col("z") >= F.col("top"))).select("neuron", "t", A.rounded(F.col("z")).alias("z"))


def search_ellipses(footprints: DataFrame, smallest: float, largest: float) -> DataFrame:
    """(neuron, cr, cc, a, b, angle): centre, clamped half axes and direction of each footprint's weighted covariance."""
    w, r, c = F.col("val"), F.col("r"), F.col("c")
    m = footprints.groupBy("neuron").agg((F.sum(w * r) / F.sum(w)).alias("cr"), (F.sum(w * c) / F.sum(w)).alias("cc"), (F.sum(w * r * r) / F.sum(w)).alias("rr"), (F.sum(w * r * c) / F.sum(w)).alias("rc"), (F.sum(w * c * c) / F.sum(w)).alias("ccc"))
    m = m.withColumns({"vr": F.col("rr") - F.pow("cr", 2), "vc": F.col("ccc") - F.pow("cc", 2), "cov": F.col("rc") - F.col("cr") * F.col("cc")})
    half, spread = (F.col("vr") + F.col("vc")) / 2, F.sqrt(F.pow((F.col("vr") - F.col("vc")) / 2, 2) + F.pow("cov", 2))
    axis = lambda v: F.sqrt(F.least(F.greatest(v, F.lit(smallest**2)), F.lit(largest**2)))
    return m.select("neuron", A.rounded(F.col("cr")).alias("cr"), A.rounded(F.col("cc")).alias("cc"), A.rounded(axis(half + spread)).alias("a"), A.rounded(axis(half - spread)).alias("b"), A.rounded(F.atan2(2 * F.col("cov"), F.col("vr") - F.col("vc")) / 2).alias("angle"))


def appended(footprints: DataFrame, more: DataFrame) -> DataFrame:
    """footprints and more, whose components get fresh ids after the largest there is."""
    last = footprints.agg(F.coalesce(F.max("neuron"), F.lit(0)).alias("last"))  # one row
    fresh = ranked(more.select("neuron").distinct(), "neuron").join(F.broadcast(last)).select(F.col("neuron").alias("old"), (F.col("last") + F.col("rank")).cast(footprints.schema["neuron"].dataType).alias("fresh"))
    named = more.join(fresh, F.col("neuron") == F.col("old")).select(F.col("fresh").alias("neuron"), *[c for c in footprints.columns if c != "neuron"])
    return footprints.unionByName(named)


def merged_replace(footprints: DataFrame, groups: DataFrame) -> DataFrame:
    """The components of each group (id, label) replaced by their sum under the group's label."""
    g = groups.select(F.col("id").alias("neuron"), "label")
    merged = footprints.join(g, "neuron").groupBy(F.col("label").alias("neuron"), "pix").agg(F.sum("val").alias("val"))
    return footprints.join(g, "neuron", "left_anti").select("neuron", "pix", "val").unionByName(merged.select(F.col("neuron").cast(footprints.schema["neuron"].dataType).alias("neuron"), "pix", "val"))
