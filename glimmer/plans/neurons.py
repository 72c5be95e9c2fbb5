"""Queries on components with traces, on ordering, results and resampling, and their SQL.

The components are those of catalogue: what is over a level in a frame, with the frame's number for a name; their traces
are the projections of the movie on their bright pixels.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.functions import arrays as A
from glimmer.operators import components as C
from glimmer.operators import clusters, graph, layout, neighbours, stats, windows
from glimmer.operators.shared import cut, shared_folder
from glimmer.plans import catalogue, updates
from glimmer.plans.catalogue import _CC, _CN, _FP, _PX, _TR, _footprints, query, r
from glimmer.sources import results
from glimmer.sources.adapters import HEIGHT, pixels, samples, table, traces

_NT = f"""{_FP}, b AS (SELECT neuron, pix, val FROM (SELECT *, max(val) OVER (PARTITION BY neuron) AS top FROM f) WHERE val >= 0.5 * top),
nt AS (SELECT neuron, t, sum(val * y) / sum(val * val) AS x FROM b JOIN px USING (pix) GROUP BY neuron, t),
st AS (SELECT neuron, t, x, coalesce(greatest(x - 0.9 * lag(x) OVER (PARTITION BY neuron ORDER BY t), 0), 0) AS s FROM nt)"""
_CENTRES = "m AS (SELECT neuron AS id, sum(r * val) / sum(val) AS r, sum(c * val) / sum(val) AS c FROM f GROUP BY neuron)"
_TAU = "tau AS (SELECT neuron, -1 / ln(least(greatest(corr(x, n), 0.01), 0.99)) AS tau FROM (SELECT neuron, x, lead(x) OVER (PARTITION BY neuron ORDER BY t) AS n FROM nt) GROUP BY neuron)"


def neuron_traces(spark, d) -> DataFrame:
    """(neuron, trace): projections on the bright pixels, in array form; only sums by neuron and frame are shuffled."""
    bright = _bright(_footprints(spark, d))
    norm = bright.groupBy("neuron").agg(F.sum(F.col("val") * F.col("val")).alias("e"))
    s = samples(pixels(spark, d)).select("pix", "t", "y").join(bright, "pix").groupBy("neuron", "t").agg(F.sum(F.col("val") * F.col("y")).alias("x"))
    t = s.groupBy("neuron").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "x"))), lambda v: v["x"]).alias("x")).join(norm, "neuron")
    return t.select("neuron", F.transform("x", lambda v: v / F.col("e")).alias("trace"))


def _bright(f: DataFrame) -> DataFrame:
    top = f.groupBy("neuron").agg(F.max("val").alias("top"))
    return f.join(top, "neuron").where("val >= 0.5 * top").select("neuron", "pix", "val")


def _long(t: DataFrame) -> DataFrame:
    return t.select("neuron", F.posexplode("trace").alias("t", "x")).select("neuron", (F.col("t") + 1).alias("t"), "x")


# Pairs


@query(f"{_NT}, {_CC.split(', s AS')[0]}, n AS (SELECT x AS a, y AS b, {r('g / (p.n * q.n)')} AS cosine FROM g JOIN norms p ON p.neuron = x JOIN norms q ON q.neuron = y), k AS (SELECT n.a, n.b, cosine, {r('corr(i.x, j.x)')} AS corr, {r('corr(i.s, j.s)')} AS spike_corr FROM n JOIN st i ON i.neuron = n.a JOIN st j ON j.neuron = n.b AND i.t = j.t WHERE cosine >= 0.12 GROUP BY ALL) SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, cosine, corr, spike_corr FROM k WHERE corr >= 0.1 AND spike_corr >= 0.05")
def merge_pairs_overlap(spark, d):
    """Candidates for a merge: footprints overlap, traces and spikes are alike."""
    return C.overlapping_and_similar(_footprints(spark, d), neuron_traces(spark, d), 0.12, 0.1, 0.05, 0.9)


@query(f"{_NT}, {_CENTRES}, {_TAU}, n AS (SELECT a.id AS a, b.id AS b, {r('sqrt(pow(a.r - b.r, 2) + pow(a.c - b.c, 2))')} AS dist FROM m a, m b WHERE a.id < b.id), k AS (SELECT n.a, n.b, dist, {r('corr(i.x, j.x)')} AS corr FROM n JOIN nt i ON i.neuron = n.a JOIN nt j ON j.neuron = n.b AND i.t = j.t WHERE dist <= 0.8 GROUP BY ALL) SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, dist, corr, {r('abs(u.tau - v.tau)', 4)} AS delta_tau FROM k JOIN tau u ON u.neuron = a JOIN tau v ON v.neuron = b WHERE corr >= -0.1 AND {r('abs(u.tau - v.tau)', 4)} < 0.5")
def merge_pairs_near(spark, d):
    """Candidates for a merge: centres near, traces alike, decay times alike."""
    return C.near_and_similar(_footprints(spark, d), neuron_traces(spark, d), 0.8, -0.1, 0.5)


@query(f"{_FP}, {_CC} SELECT CAST(label AS INT) AS label, string_agg(DISTINCT id, ',' ORDER BY id) AS members, count(DISTINCT id) AS n_members, count(*) AS pixels_before, count(DISTINCT pix) AS pixels_after FROM cc JOIN f ON f.neuron = cc.id GROUP BY label")
def merge_audit(spark, d):
    f = _footprints(spark, d)
    return C.merge_audit(graph.connected_components(C.overlap_cosine(f, 0.24)), f)


@query(f"{_NT}, {_CENTRES}, near AS (SELECT a.id AS a, b.id AS b FROM m a, m b WHERE a.id <> b.id AND {r('sqrt(pow(a.r - b.r, 2) + pow(a.c - b.c, 2))')} <= 0.8), z AS (SELECT neuron, t, round(s / stddev_samp(s) OVER (PARTITION BY neuron), 9) AS z FROM st), w AS (SELECT neuron, t, z FROM z WHERE z > 0), top AS (SELECT w.neuron, w.t, max(v.z) AS top FROM w JOIN near ON near.a = w.neuron JOIN w v ON v.neuron = near.b AND v.t BETWEEN w.t - 1 AND w.t + 1 GROUP BY 1, 2) SELECT CAST(neuron AS INT) AS neuron, CAST(t AS INT) AS t, {r('z')} AS z FROM w LEFT JOIN top USING (neuron, t) WHERE top IS NULL OR z >= top")
def spike_competition(spark, d):
    return C.spike_competition(_footprints(spark, d), neuron_traces(spark, d), 0.8, 1, 0.9)


# Order

_KEYS = f"""{_NT}, {_TAU},
q AS (SELECT neuron, sum(val) AS s, sum(val * val) AS s2, sum(pow(val, 4)) AS s4, sum(val * r * r) / sum(val) - pow(sum(val * r) / sum(val), 2) AS a, sum(val * c * c) / sum(val) - pow(sum(val * c) / sum(val), 2) AS b, sum(val * r * c) / sum(val) - sum(val * r) / sum(val) * sum(val * c) / sum(val) AS k FROM f GROUP BY neuron),
h AS (SELECT *, (a + b) / 2 AS half, sqrt(pow((a - b) / 2, 2) + k * k) AS spread FROM q),
w AS (SELECT neuron, {r('avg(x)')} AS mean, {r('sum(abs(x)) / sqrt(sum(x * x))')} AS sparsity_temporal, {r('(max(x) - quantile_cont(x, 0.5)) / stddev_samp(x)')} AS pnr, max(x) AS peak FROM nt GROUP BY neuron),
keys AS (SELECT CAST(neuron AS INT) AS neuron, {r('tau', 4)} AS decay_time, mean, {r('s / sqrt(s2)')} AS sparsity_spatial, sparsity_temporal, {r('(half - spread) / (half + spread)', 5)} AS circularity, pnr, {r('peak * pow(s4, 0.25) / sqrt(s2)')} AS l4 FROM h JOIN w USING (neuron) JOIN tau USING (neuron))"""


@query(f"{_KEYS} SELECT * FROM keys")
def order_keys(spark, d):
    return C.order_keys(_footprints(spark, d), neuron_traces(spark, d))


@query(f"{_KEYS} SELECT neuron, pnr AS key, CAST(row_number() OVER (ORDER BY pnr DESC, neuron) AS INT) AS rank FROM keys")
def order_pnr(spark, d):
    return C.ordered(C.order_keys(_footprints(spark, d), neuron_traces(spark, d)), "pnr")


@query(f"{_KEYS} SELECT neuron, circularity AS key, CAST(row_number() OVER (ORDER BY circularity, neuron) AS INT) AS rank FROM keys")
def order_circularity(spark, d):
    return C.ordered(C.order_keys(_footprints(spark, d), neuron_traces(spark, d)), "circularity")


@query(f"{_TR}, x AS (SELECT user_id, t, t - row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM tr WHERE y > 40), n AS (SELECT user_id, count(*) AS n FROM (SELECT user_id, i FROM x GROUP BY user_id, i HAVING count(*) >= 2) GROUP BY user_id) SELECT user_id, n, CAST(row_number() OVER (ORDER BY n DESC, user_id) AS INT) AS rank FROM n")
def order_events(spark, d):
    """Series by their number of events: runs of two samples or more over the level."""
    n = windows.runs_over(traces(spark, d), 40, 2).groupBy("user_id").agg(F.count("*").alias("n"))
    return C.ranked(n, F.desc("n"), "user_id")


@query(None)
def order_spatial_cluster(spark, d):
    """By clusters of footprints (cosine, complete linkage), starting from the order by peak-to-noise ratio."""
    f = _footprints(spark, d)
    ranks = C.ordered(C.order_keys(f, neuron_traces(spark, d)), "pnr")
    return clusters.order_by_clusters(ranks, C.overlap_cosine(f, 0.0).select("a", "b", F.col("cosine").alias("similarity")))


@query(None)
def order_temporal_cluster(spark, d):
    """By clusters of traces (cosine, complete linkage) of components that share pixels, starting as order_spatial_cluster does."""
    f, t = _footprints(spark, d), cut(neuron_traces(spark, d))
    ranks = C.ordered(C.order_keys(f, t), "pnr")
    return clusters.order_by_clusters(ranks, C.trace_cosine(t, C.overlap_cosine(f, 0.0)))


# Model, residual, classes


@query(f"{_NT}, ac AS (SELECT f.pix, t, sum(val * x) AS ac FROM f JOIN nt USING (neuron) GROUP BY 1, 2), m AS (SELECT px.pix, px.label, px.t, y - coalesce(ac, 0) AS e FROM px LEFT JOIN ac ON ac.pix = px.pix AND ac.t = px.t), res AS (SELECT label, e - avg(e) OVER (PARTITION BY pix) AS e FROM m) SELECT label, CAST(grouping(label) AS INT) AS is_total, {r('sum(e * e)', 4)} AS rss FROM res GROUP BY ROLLUP (label)")
def rss_model(spark, d):
    """Sum of squares of Y - AC - b0, per label and in all."""
    model = C.modelled(_footprints(spark, d), _long(neuron_traces(spark, d)))
    s = samples(pixels(spark, d)).join(model, ["pix", "t"], "left")
    return C.residual_energy(s.select("pix", "label", (F.col("y") - F.coalesce("ac", F.lit(0.0))).alias("y")))


@query(f"{_NT}, ac AS (SELECT f.pix, t, sum(val * x) AS ac FROM f JOIN nt USING (neuron) GROUP BY 1, 2), g AS (SELECT pix, avg(y) AS b FROM px GROUP BY pix) SELECT CAST(px.t AS INT) AS t, {r('sum(y)', 4)} AS raw, {r('sum(b)', 4)} AS background, {r('sum(y - b)', 4)} AS clean, {r('sum(coalesce(ac, 0))', 4)} AS model, {r('sum(y - b - coalesce(ac, 0))', 4)} AS residual FROM px JOIN g USING (pix) LEFT JOIN ac ON ac.pix = px.pix AND ac.t = px.t GROUP BY px.t")
def demixed_panels(spark, d):
    """What a demixed movie shows, added up by frame: raw, background, raw less background, model, residual."""
    p = pixels(spark, d)
    model = C.modelled(_footprints(spark, d), _long(neuron_traces(spark, d)))
    s = samples(p.withColumn("b", A.mean(F.col("y")))).join(model, ["pix", "t"], "left").withColumn("ac", F.coalesce("ac", F.lit(0.0)))
    add = lambda x, name: A.rounded(F.sum(x), 4).alias(name)
    return s.groupBy("t").agg(add(F.col("y"), "raw"), add(F.col("b"), "background"), add(F.col("y") - F.col("b"), "clean"), add(F.col("ac"), "model"), add(F.col("y") - F.col("b") - F.col("ac"), "residual"))


@query(f"{_FP}, a AS (SELECT pix FROM px GROUP BY pix HAVING max(y) > 0.3), s AS (SELECT neuron, {r('sum(CASE WHEN a.pix IS NULL THEN 0 ELSE val * val END) / sum(val * val)')} AS share FROM f LEFT JOIN a USING (pix) GROUP BY neuron) SELECT CAST(neuron AS INT) AS neuron, share, share >= 0.25 AS is_active FROM s")
def active_components(spark, d):
    return C.active_share(_footprints(spark, d), pixels(spark, d).where(F.array_max("y") > 0.3), 0.5)


@query(f"{_FP}, e AS (SELECT neuron, pix, CAST(round(val * val, 9) AS DECIMAL(30, 9)) AS e FROM f), s AS (SELECT neuron, pix, sum(e) OVER (PARTITION BY neuron ORDER BY e, pix DESC ROWS UNBOUNDED PRECEDING) AS below, sum(e) OVER (PARTITION BY neuron) AS total FROM e) SELECT CAST(neuron AS INT) AS neuron, '{{\"neuron\":' || neuron || ',\"pixels\":[' || string_agg(pix, ',' ORDER BY pix) || ']}}' AS contour FROM s WHERE below > total * CAST(0.1 AS DECIMAL(10, 4)) GROUP BY neuron")
def contour_json(spark, d):
    return C.contours(_footprints(spark, d), 0.9)


@query(f"{_CN}, v AS (SELECT pix, {r('(max(y) - quantile_cont(y, 0.5)) / stddev_samp(y)')} AS pnr FROM px GROUP BY pix) SELECT pix, CASE WHEN cn < 0.02 OR pnr < 2.2 THEN 0 ELSE {r('cn * pnr')} END AS score FROM cn JOIN v USING (pix)")
def seed_screen(spark, d):
    """Correlation times peak-to-noise ratio, 0 where either is under its own threshold."""
    p = pixels(spark, d)
    s = neighbours.correlation_image(p).join(stats.peak_to_noise(p), "pix")
    return s.select("pix", F.when((F.col("cn") < 0.02) | (F.col("snr") < 2.2), F.lit(0.0)).otherwise(A.rounded(F.col("cn") * F.col("snr"))).alias("score"))


# Traces in rows


@query(f"{_TR}, x AS (SELECT *, quantile_cont(y, 0.5) OVER (PARTITION BY user_id) AS f FROM tr) SELECT user_id, t, {r('(y - f) / CASE WHEN f <> 0 THEN f END')} AS dff FROM x")
def dff_median(spark, d):
    return windows.percentile_dff(traces(spark, d), 0.5)


@query(f"{_TR}, x AS (SELECT *, quantile_cont(y, 0.5) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS f FROM tr) SELECT user_id, t, {r('(y - f) / CASE WHEN f <> 0 THEN f END')} AS dff FROM x")
def dff_running(spark, d):
    return windows.running_dff(traces(spark, d), 7)


_BACK = f"""{_NT}, ac AS (SELECT f.pix, t, sum(val * x) AS ac FROM f JOIN nt USING (neuron) GROUP BY 1, 2),
e AS (SELECT px.pix, px.t, y - coalesce(ac, 0) AS e FROM px LEFT JOIN ac ON ac.pix = px.pix AND ac.t = px.t),
bg AS (SELECT neuron, t, sum(val * e) / sum(val * val) AS b FROM f JOIN e USING (pix) GROUP BY 1, 2)"""


def _background(spark, d):
    """(neuron, t, b): what the components leave of the movie, seen through each footprint."""
    f, t = _footprints(spark, d), neuron_traces(spark, d)
    left = updates.residual(pixels(spark, d), f, t)
    return C.projected(f, left), _long(t)


@query(f"{_BACK}, q AS (SELECT neuron, t, quantile_cont(b, 0.5) OVER (PARTITION BY neuron) AS base FROM bg) SELECT CAST(neuron AS INT) AS neuron, CAST(t AS INT) AS t, {r('base')} AS base, {r('x / CASE WHEN base <> 0 THEN base END')} AS dff FROM q JOIN nt USING (neuron, t)")
def dff_background(spark, d):
    """Traces over the median of the background at their footprints."""
    background, long = _background(spark, d)
    return windows.background_dff(long, background, 0.5)


@query(f"{_BACK}, q AS (SELECT neuron, t, quantile_cont(b, 0.2) OVER (PARTITION BY neuron ORDER BY t ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS base FROM bg) SELECT CAST(neuron AS INT) AS neuron, CAST(t AS INT) AS t, {r('base')} AS base, {r('x / CASE WHEN base <> 0 THEN base END')} AS dff FROM q JOIN nt USING (neuron, t)")
def dff_background_running(spark, d):
    """Traces over a running quantile of the background at their footprints."""
    background, long = _background(spark, d)
    return windows.background_dff(long, background, 0.2, 7)


@query(f"{_FP}, n AS (SELECT neuron, r, c FROM f), s AS (SELECT DISTINCT neuron, n.r + i AS r, n.c + j AS c FROM n, (SELECT unnest(range(-2, 3)) AS i) a, (SELECT unnest(range(-2, 3)) AS j) b WHERE i * i + j * j <= 4) SELECT CAST(neuron AS INT) AS neuron, p.pix FROM s JOIN p ON p.r = s.r AND p.c = s.c")
def dilated_regions(spark, d):
    """Search regions by dilation: the pixels within two of a component's footprint."""
    return neighbours.dilated(_footprints(spark, d), pixels(spark, d), 2)


@query(f"{_TR}, g AS (SELECT user_id, t, CASE WHEN y <= avg(y) OVER (PARTITION BY user_id) + stddev_samp(y) OVER (PARTITION BY user_id) THEN y END AS y FROM tr), e AS (SELECT user_id, list(t ORDER BY t) AS ts, list(y ORDER BY t) AS ys FROM g WHERE y IS NOT NULL GROUP BY user_id), w AS (SELECT user_id, t, y, last_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS pt, first_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt FROM g), k AS (SELECT w.*, ts, ys, CASE WHEN pt IS NULL THEN 1 WHEN nt IS NULL THEN greatest(len(ts) - 1, 1) ELSE list_position(ts, pt) END AS i, CASE WHEN pt IS NULL THEN 2 WHEN nt IS NULL THEN len(ts) ELSE list_position(ts, nt) END AS j FROM w LEFT JOIN e USING (user_id)) SELECT user_id, t, {r('coalesce(y, ys[i] + (ys[j] - ys[i]) * (t - ts[i]) / nullif(ts[j] - ts[i], 0), ys[i])')} AS y FROM k")
def interpolated(spark, d):
    """Samples over the mean by a deviation count as missing and are interpolated."""
    w = "PARTITION BY user_id"
    return windows.interpolated(traces(spark, d).select("user_id", "t", F.expr(f"CASE WHEN y <= avg(y) OVER ({w}) + stddev_samp(y) OVER ({w}) THEN y END").alias("y")))


@query(f"{_PX}, s AS (SELECT pix, list_sort(list(y)) AS s, count(*) AS n FROM px GROUP BY pix), q AS (SELECT pix, s, least(greatest(n * 0.15 - 0.5, 0), n - 1) AS k, n FROM s) SELECT pix, {r('s[CAST(floor(k) AS INT) + 1] + (s[least(CAST(floor(k) AS INT) + 2, n)] - s[CAST(floor(k) AS INT) + 1]) * (k - floor(k))')} AS q FROM q")
def hazen_quantile(spark, d):
    """The quantile rule of baselines: sample k at (k - 1/2) / n."""
    return pixels(spark, d).select("pix", A.rounded(A.hazen(F.col("y"), 0.15)).alias("q"))


@query(f"{_PX} SELECT pix, CAST(t AS INT) AS t, {r('pow(0.9, t) * sum(y * pow(0.9, -t)) OVER (PARTITION BY pix ORDER BY t ROWS UNBOUNDED PRECEDING)')} AS c FROM px")
def decayed(spark, d):
    """A trace through the decay of one frame into the next."""
    return stats.decayed(pixels(spark, d), 0.9)


# Resampling, layout, names


@query(f"{_PX} SELECT r // 2 AS r, c // 2 AS c, CAST(t AS INT) AS t, {r('avg(y)')} AS y FROM px GROUP BY ALL")
def ssub_mean(spark, d):
    """Means of 2 by 2 pixels, frame by frame."""
    return layout.downsampled_image(pixels(spark, d), 2)


@query(f"{_PX}, h AS (SELECT r // 2 AS r, c // 2 AS c, avg(y) AS m FROM px GROUP BY 1, 2) SELECT pix, {r('m')} AS m FROM p JOIN h ON h.r = p.r // 2 AND h.c = p.c // 2")
def nearest_resize(spark, d):
    """An image at half size, brought back to full size by the nearest pixel."""
    p = pixels(spark, d)
    small = p.groupBy(F.floor(F.col("r") / 2).alias("r"), F.floor(F.col("c") / 2).alias("c")).agg(F.avg(A.mean(F.col("y"))).alias("m"))
    return layout.nearest(small, p, 2, "m")


@query(f"{_PX}, s AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM p), g AS (SELECT h, w, unnest(generate_series(0, greatest(h - 8, 0), 6)) AS r0, unnest(generate_series(0, greatest(w - 8, 0), 6)) AS c0 FROM s), rr AS (SELECT DISTINCT h, r0, CASE WHEN r0 + 12 > h - 1 THEN h - 1 ELSE r0 + 7 END AS r1 FROM (SELECT h, unnest(generate_series(0, greatest(h - 6, 0), 6)) AS r0 FROM s)), cc AS (SELECT DISTINCT w, c0, CASE WHEN c0 + 12 > w - 1 THEN w - 1 ELSE c0 + 7 END AS c1 FROM (SELECT w, unnest(generate_series(0, greatest(w - 6, 0), 6)) AS c0 FROM s)) SELECT r0, least(r1, h - 1) AS r1, c0, least(c1, w - 1) AS c1 FROM rr, cc")
def sliding_patches(spark, d):
    """Boxes of 8 with an overlap of 2; what would be left under 6 at an end joins the last box."""
    edge = pixels(spark, d).agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))  # one row
    return layout.sliding_boxes(edge, 8, 2, 6)


@query("SELECT source, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(source, ''), lambda x: ascii(x)::BIGINT)), lambda h, x: (h * 33 + x) % 4294967295) AS hash FROM (SELECT DISTINCT source FROM documents WHERE source <> '')")
def string_hash(spark, d):
    """A name's hash: h = 33 h + c modulo 2**32 - 1, from 5381."""
    return table(spark, d, "documents").where("source <> ''").select("source").distinct().select("source", layout.name_hash(F.col("source")).alias("hash"))


@query("SELECT event_type, strftime(min(ts), '%d-%b_%H_%M_%S') AS first_log, strftime(max(ts), '%d-%b_%H_%M_%S') AS last_log FROM events GROUP BY event_type")
def log_names(spark, d):
    """The stamp that a log folder has in its name."""
    stamp = lambda x: F.date_format(x, "dd-MMM_HH_mm_ss")
    return table(spark, d, "events").groupBy("event_type").agg(stamp(F.min("ts")).alias("first_log"), stamp(F.max("ts")).alias("last_log"))


# Results


@query(f"{_FP} SELECT CAST(neuron AS INT) AS neuron, pix, {r('val')} AS val, CAST(neuron // 16 AS BIGINT) AS batch_id FROM f")
def written_results(spark, d):
    """Footprints of all batches written as results, a folder for each batch, and read again."""
    f = _footprints(spark, d).select("neuron", "pix", A.rounded(F.col("val")).alias("val"), F.floor(F.col("neuron") / 16).alias("batch_id"))
    path = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    results.write(path, {"footprints": f}, by={"footprints": "batch_id"})
    return results.read(spark, path, "footprints").select("neuron", "pix", "val", F.col("batch_id").cast("long").alias("batch_id"))


@query(f"{_PX} SELECT pix, CAST(t AS INT) AS t, {r('greatest(y - 0.1, 0)')} AS val FROM px WHERE y > 0.1 AND {r('greatest(y - 0.1, 0)')} <> 0")
def compressed(spark, d):
    """Only what is not 0 is kept."""
    return results.compressed(samples(pixels(spark, d)).select("pix", "t", A.rounded(F.greatest(F.col("y") - 0.1, F.lit(0.0))).alias("val")))


QUERIES, SQL = catalogue.QUERIES, catalogue.SQL
