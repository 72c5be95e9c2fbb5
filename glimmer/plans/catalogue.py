"""Queries over the given tables, one for each operator that SQL can check, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmer.functions import arrays as A
from glimmer.functions import basis
from glimmer.operators import components as C
from glimmer.operators import graph, layout, neighbours, stats, windows
from glimmer.sources.adapters import HEIGHT, pixels, samples, traces

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_PX = f"WITH p AS (SELECT vec_id AS pix, vec_id % {HEIGHT} AS r, vec_id // {HEIGHT} AS c, label, embedding FROM embeddings), px AS (SELECT pix, r, c, label, t, CAST(embedding[t] AS DOUBLE) AS y FROM p, range(1, 65) AS g(t))"
_TR = "WITH tr AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS t, value AS y FROM events)"
_FP = f"{_PX}, f AS (SELECT t AS neuron, pix, y AS val, r, c FROM px WHERE y > 0.15)"
_LT = f"{_PX}, lt AS (SELECT label AS k, t, avg(y) AS x FROM px GROUP BY label, t)"
_NEAR = "(SELECT dr, dc FROM range(-1, 2) a(dr), range(-1, 2) b(dc))"
_RING1 = "(SELECT dr, dc FROM range(-1, 2) a(dr), range(-1, 2) b(dc) WHERE dr * dr + dc * dc >= 1)"
_RING3 = "(SELECT dr, dc FROM range(-4, 5) a(dr), range(-4, 5) b(dc) WHERE dr * dr + dc * dc >= 9 AND dr * dr + dc * dc < 16)"


def r(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0)"


def query(sql: str | None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def _labels(spark, d) -> DataFrame:
    return C.label_traces(samples(pixels(spark, d)))


def _label_samples(spark, d) -> DataFrame:
    return samples(pixels(spark, d)).groupBy(F.col("label").alias("k"), "t").agg(F.avg("y").alias("x"))


_ADJ = f"adj AS (SELECT DISTINCT a.label AS a, b.label AS b FROM p a, {_RING1} o, p b WHERE b.r = a.r + o.dr AND b.c = a.c + o.dc AND a.label < b.label)"
_REG = f"reg AS (SELECT DISTINCT a.pix, b.label FROM p a, {_NEAR} o, p b WHERE b.r = a.r + o.dr AND b.c = a.c + o.dc)"


def _footprints(spark, d) -> DataFrame:
    return C.footprints(samples(pixels(spark, d)), 0.15)


# Statistics of pixels


@query(f"{_PX} SELECT pix, {r('max(y) - quantile_cont(y, 0.5)')} AS peak FROM px GROUP BY pix")
def median_center_max(spark, d):
    return stats.median_centred_peak(pixels(spark, d))


@query(f"{_PX} SELECT pix, {r('(max(y) - quantile_cont(y, 0.5)) / stddev_samp(y)')} AS snr FROM px GROUP BY pix")
def snr_std(spark, d):
    return stats.peak_to_noise(pixels(spark, d))


@query(f"{_PX} SELECT pix, {r('avg(y)')} AS ymean FROM px GROUP BY pix")
def mean_image(spark, d):
    return stats.mean_image(pixels(spark, d))


@query(f"{_PX} SELECT pix, CAST(count(*) FILTER (WHERE NOT y < 0.5 * s) AS INT) AS n_kept, {r('coalesce(sum(y) FILTER (WHERE NOT y < 0.5 * s), 0)')} AS kept_sum FROM (SELECT *, stddev_samp(y) OVER (PARTITION BY pix) AS s FROM px) GROUP BY pix")
def noise_threshold(spark, d):
    return stats.noise_threshold(pixels(spark, d), 0.5)


@query(f"{_PX} SELECT pix, {r('sum(CASE WHEN y >= 0 THEN sqrt(y) ELSE 0 END)')} AS root_sum FROM px GROUP BY pix")
def nan_to_zero(spark, d):
    return stats.nan_to_zero(pixels(spark, d))


@query(f"{_PX}, s AS (SELECT pix, {r('avg(CAST(y >= 0.2 AS INT))')} AS share FROM px GROUP BY pix) SELECT pix, share, share < 0.05 AS unsaturated FROM s")
def saturated_share(spark, d):
    return stats.saturated_share(pixels(spark, d), 0.2, 0.05)


@query(f"{_PX}, z AS (SELECT pix, y - min(y) OVER (PARTITION BY pix) AS z FROM px) SELECT pix, {r('avg(z) / quantile_cont(z, 0.99)')} AS level FROM z GROUP BY pix")
def normalised_level(spark, d):
    return stats.normalised(pixels(spark, d))


@query(f"{_PX}, m AS (SELECT *, max(y) OVER (PARTITION BY pix) AS top FROM px) SELECT pix, min(t) AS t, {r('any_value(top)')} AS peak FROM m WHERE y = top GROUP BY pix")
def peak_frame(spark, d):
    return stats.peak_frame(pixels(spark, d))


@query(f"{_PX}, s AS (SELECT pix, y - 0.95 * coalesce(lag(y) OVER (PARTITION BY pix ORDER BY t), 0) AS s FROM px) SELECT pix, {r('sum(s)')} AS s_sum, CAST(count(*) FILTER (WHERE s > 0) AS INT) AS n_up FROM s GROUP BY pix")
def ar_difference(spark, d):
    return stats.ar_difference(pixels(spark, d), 0.95)


@query(f"{_PX} SELECT pix, CAST(t AS INT) AS t, {r('y - min(y) OVER (PARTITION BY pix, (t - 1) // 16)')} AS z FROM px")
def local_min_detrend(spark, d):
    return stats.detrended_by_block_minimum(pixels(spark, d), 16)


@query(f"{_PX} SELECT pix, CAST((t - 1) // 4 AS INT) AS block, {r('avg(y)')} AS y FROM px GROUP BY pix, (t - 1) // 4 HAVING count(*) = 4")
def tsub_mean(spark, d):
    return stats.downsampled(pixels(spark, d), 4)


@query(f"{_PX} SELECT CAST(t AS INT) AS t, {r('sum(y)')} AS total FROM px WHERE t BETWEEN 11 AND 30 GROUP BY t")
def frame_slice(spark, d):
    return stats.frame_slice(samples(pixels(spark, d)), 11, 30)


@query(f"{_PX}, m AS (SELECT t, abs(y - avg(y) OVER (PARTITION BY pix)) > 2 * stddev_samp(y) OVER (PARTITION BY pix) AS o FROM px) SELECT CAST(t AS INT) AS t, count(*) FILTER (WHERE o) AS n_out, count(*) FILTER (WHERE o) <= 0.05 * count(*) AS kept FROM m GROUP BY t")
def frame_outliers(spark, d):
    return stats.frame_outliers(pixels(spark, d), 2, 0.05)


# Neighbourhoods

_CN = f"""{_PX}, z AS (SELECT pix, r, c, t, (y - avg(y) OVER w) / CASE WHEN stddev_pop(y) OVER w = 0 THEN 1 ELSE stddev_pop(y) OVER w END AS z FROM px WINDOW w AS (PARTITION BY pix)),
cn AS (SELECT a.pix, {r('avg(a.z * b.z)')} AS cn, count(DISTINCT b.pix) AS n_neighbours FROM z a, {_RING1} o, z b WHERE b.r = a.r + o.dr AND b.c = a.c + o.dc AND b.t = a.t GROUP BY a.pix)"""


@query(f"{_CN} SELECT * FROM cn")
def corr_image(spark, d):
    return neighbours.correlation_image(pixels(spark, d))


@query(f"{_PX}, m AS (SELECT pix, r, c, avg(y) AS m FROM px GROUP BY pix, r, c) SELECT a.pix, count(*) AS n_ring, {r('avg(b.m)')} AS level FROM m a, {_RING3} o, m b WHERE b.r = a.r + o.dr AND b.c = a.c + o.dc GROUP BY a.pix")
def ring_mean_bg(spark, d):
    return neighbours.ring_background(pixels(spark, d), 3, 4)


@query(f"{_PX}, w AS (SELECT a.pix, b.pix AS q, 1.0 / count(*) OVER (PARTITION BY a.pix) AS w FROM p a, {_RING3} o, p b WHERE b.r = a.r + o.dr AND b.c = a.c + o.dc) SELECT w.pix, CAST(x.t AS INT) AS t, {r('sum(w.w * x.y)')} AS b FROM w JOIN px x ON x.pix = w.q GROUP BY w.pix, x.t")
def ring_background_product(spark, d):
    p = pixels(spark, d)
    return neighbours.weighted_background(neighbours.ring_weights(p, 3, 4), samples(p))


@query(f"{_PX} SELECT pix, r, c FROM p WHERE r >= 2 AND c >= 2 AND r <= (SELECT max(r) FROM p) - 2 AND c <= (SELECT max(c) FROM p) - 2")
def border_exclusion(spark, d):
    return neighbours.border_excluded(pixels(spark, d), 2)


@query(f"{_PX} SELECT pix, r, c FROM p WHERE r >= 1 AND c >= 3 AND r <= (SELECT max(r) FROM p) - 2 AND c <= (SELECT max(c) FROM p)")
def border_of_four_widths(spark, d):
    """A patch that lies inside of the movie on one side keeps that side's pixels."""
    return neighbours.border_excluded(pixels(spark, d), (1, 2, 3, 0))


_SEEDS = f"{_CN}, pnr AS (SELECT pix, label, (max(y) - quantile_cont(y, 0.5)) / stddev_samp(y) AS v FROM px GROUP BY pix, label), s AS (SELECT pnr.label, pix, {r('cn.cn * ' + r('pnr.v'))} AS score FROM pnr JOIN cn USING (pix))"


def seed_scores(spark, d) -> DataFrame:
    """Local correlation times peak-to-noise ratio: (label, pix, score)."""
    p = pixels(spark, d)
    joined = neighbours.correlation_image(p).join(stats.peak_to_noise(p), "pix").join(p.select("pix", "label"), "pix")
    return joined.select("label", "pix", A.rounded(F.col("cn") * F.col("snr")).alias("score"))


@query(f"{_SEEDS} SELECT label, pix, CAST(rank AS INT) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, pix) AS rank FROM s) WHERE rank <= 3")
def topk_seeds(spark, d):
    return C.top_seeds(seed_scores(spark, d), 3)


@query(f"{_SEEDS}, m AS (SELECT a.pix, a.r, a.c, s.score FROM p a JOIN s USING (pix)) SELECT a.pix, a.score FROM m a, {_RING1} o JOIN m b ON b.r = a.r + o.dr AND b.c = a.c + o.dc GROUP BY a.pix, a.score HAVING a.score > max(b.score)")
def local_maxima(spark, d):
    p = pixels(spark, d).drop("y").join(seed_scores(spark, d).drop("label"), "pix")
    pairs = neighbours.neighbour_pairs(p, neighbours.ring(1, 2), "score")
    return pairs.groupBy("pix", "score").agg(F.max("n_score").alias("top")).where("score > top").select("pix", "score")


# Traces in rows


@query(f"{_TR} SELECT user_id, t, {r('quantile_cont(y, 0.5) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS m FROM tr")
def running_median(spark, d):
    return windows.running_median(traces(spark, d), 2)


@query(f"{_TR}, x AS (SELECT user_id, t, y - lag(y) OVER (PARTITION BY user_id ORDER BY t) AS d FROM tr) SELECT user_id, t, {r('d')} AS d FROM x WHERE d IS NOT NULL")
def first_difference(spark, d):
    return windows.first_difference(traces(spark, d))


@query(f"{_TR}, x AS (SELECT user_id, y, y - lag(y) OVER (PARTITION BY user_id ORDER BY t) AS d, stddev_samp(y) OVER (PARTITION BY user_id) AS s FROM tr) SELECT user_id, {r('quantile_cont(y, 0.5)')} AS baseline FROM x WHERE d >= 0 AND d < s GROUP BY user_id")
def remove_baseline(spark, d):
    return windows.conditional_baseline(traces(spark, d))


@query(f"{_TR}, x AS (SELECT *, max(y) OVER w AS top, min(y) OVER w AS low, stddev_samp(y) OVER (PARTITION BY user_id) AS s FROM tr WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) SELECT user_id, t, {r('y')} AS y FROM x WHERE y = top AND y - low >= 2 * s")
def event_detect(spark, d):
    return windows.events(traces(spark, d), 3, 2)


@query(f"{_TR}, x AS (SELECT user_id, t, t - row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM tr WHERE y > 40) SELECT user_id, min(t) AS first, count(*) AS n FROM x GROUP BY user_id, i HAVING count(*) >= 3")
def run_length(spark, d):
    return windows.runs_over(traces(spark, d), 40, 3)


@query(f"{_TR}, x AS (SELECT *, quantile_cont(y, 0.1) OVER (PARTITION BY user_id) AS f FROM tr) SELECT user_id, t, {r('(y - f) / CASE WHEN f <> 0 THEN f END')} AS dff FROM x")
def dff_percentile(spark, d):
    return windows.percentile_dff(traces(spark, d), 0.1)


@query(f"{_TR}, x AS (SELECT y, lag(y, 1) OVER w AS a, lag(y, 2) OVER w AS b FROM tr WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT count(*) AS n, {r('sum(a * a)', 2)} AS aa, {r('sum(a * b)', 2)} AS ab, {r('sum(b * b)', 2)} AS bb, {r('sum(a * y)', 2)} AS ay, {r('sum(b * y)', 2)} AS yb FROM x WHERE b IS NOT NULL")
def normal_equations(spark, d):
    return windows.lagged_regression(traces(spark, d))


@query(f"{_TR}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM tr), x AS (SELECT user_id, n, t, y FROM n UNION ALL SELECT user_id, n, 1 - t, y FROM n WHERE t <= 5 UNION ALL SELECT user_id, n, 2 * n + 1 - t, y FROM n WHERE t > n - 5), q AS (SELECT user_id, n, t, quantile_cont(y, 0.2) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS p FROM x) SELECT user_id, t, {r('p')} AS p FROM q WHERE t BETWEEN 1 AND n")
def running_percentile(spark, d):
    return windows.mirrored_percentile(traces(spark, d), 5, 0.2)


@query(f"{_TR}, x AS (SELECT user_id, t, y, lag(y) OVER (PARTITION BY user_id ORDER BY t) AS x FROM tr) SELECT user_id, {r('regr_slope(y, x)')} AS slope, {r('regr_intercept(y, x)')} AS intercept, CAST(regr_count(y, x) AS BIGINT) AS n FROM x GROUP BY user_id")
def ols_extract(spark, d):
    x = traces(spark, d).withColumn("x", F.lag("y").over(Window.partitionBy("user_id").orderBy("t")))
    return x.groupBy("user_id").agg(A.rounded(F.regr_slope("y", "x")).alias("slope"), A.rounded(F.regr_intercept("y", "x")).alias("intercept"), F.regr_count("y", "x").alias("n"))


_BASIS = basis.b_splines(64, 5)


def _list(rows) -> str:
    return "[" + ", ".join(f"CAST({float(x)!r} AS DOUBLE)" for x in rows) + "]"


_FIT = ", ".join(f"list_dot_product(v, {_list(row)})" for row in np.linalg.pinv(_BASIS))
_ROWS = ", ".join(_list(row) for row in _BASIS)


@query(f"{_PX}, v AS (SELECT pix, CAST(embedding AS DOUBLE[]) AS v FROM p), w AS (SELECT pix, v, [{_FIT}] AS w FROM v) SELECT pix, CAST(t AS INT) AS t, {r('v[t] - list_dot_product(w, ([' + _ROWS + '])[t])')} AS z FROM w, range(1, 65) AS g(t)")
def spline_detrend(spark, d):
    z = pixels(spark, d).select("pix", basis.without_trend(F.col("y"), _BASIS).alias("z"))
    return z.select("pix", F.posexplode("z").alias("t", "z")).select("pix", (F.col("t") + 1).alias("t"), A.rounded(F.col("z")).alias("z"))


@query(f"{_PX}, m AS (SELECT pix, r, c, avg(y) AS m FROM px GROUP BY pix, r, c) SELECT a.pix, {r('quantile_cont(b.m, 0.5)')} AS m, count(*) AS n FROM m a JOIN m b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.pix")
def median_filter(spark, d):
    return neighbours.median_filtered(pixels(spark, d).withColumn("m", A.mean(F.col("y"))), "m")


@query(f"{_PX}, m AS (SELECT pix, r, c, avg(y) AS m FROM px GROUP BY pix, r, c), g AS (SELECT i, j FROM range(0, 4) a(i), range(0, 100000) b(j) WHERE j <= (SELECT max(c) // 8 FROM p)), v AS (SELECT pix, m * (1 + (j * 4 + i) % 3) AS v FROM g JOIN m ON r BETWEEN i * 8 - 2 AND i * 8 + 9 AND c BETWEEN j * 8 - 2 AND j * 8 + 9) SELECT pix, {r('avg(v)')} AS v, count(*) AS n FROM v GROUP BY pix")
def coverage_mean(spark, d):
    p = pixels(spark, d)
    last = p.agg(F.floor(F.max("c") / 8).alias("last"))  # one row
    m = layout.block_members(p, HEIGHT, 8, 2).join(F.broadcast(last)).where(F.floor(F.col("patch") / 4) <= F.col("last"))
    v = m.join(p.select("pix", A.mean(F.col("y")).alias("m")), "pix")
    return layout.coverage_mean(v.select("patch", "pix", (F.col("m") * (1 + F.col("patch") % 3)).alias("v")))


# Components


@query(f"{_FP}, m AS (SELECT neuron, sum(val * r) / sum(val) AS cr, sum(val * c) / sum(val) AS cc, sum(val * r * r) / sum(val) AS rr, sum(val * r * c) / sum(val) AS rc, sum(val * c * c) / sum(val) AS ccc FROM f GROUP BY neuron), v AS (SELECT neuron, cr, cc, rr - cr * cr AS vr, ccc - cc * cc AS vc, rc - cr * cc AS cov FROM m), e AS (SELECT *, (vr + vc) / 2 AS h, sqrt(pow((vr - vc) / 2, 2) + cov * cov) AS s FROM v) SELECT CAST(neuron AS INT) AS neuron, {r('cr')} AS cr, {r('cc')} AS cc, {r('sqrt(least(greatest(h + s, 9), 64))')} AS a, {r('sqrt(least(greatest(h - s, 9), 64))')} AS b, {r('atan2(2 * cov, vr - vc) / 2')} AS angle FROM e")
def search_ellipse(spark, d):
    return C.search_ellipses(_footprints(spark, d), 3, 8)


@query(f"{_FP} SELECT CAST(neuron AS INT) AS neuron, {r('sum(r * val) / sum(val)')} AS cr, {r('sum(c * val) / sum(val)')} AS cc, count(*) AS n_pixels FROM f GROUP BY neuron")
def center_of_mass(spark, d):
    return C.centre_of_mass(_footprints(spark, d))


_GRAM = "{fp}, n AS (SELECT neuron, sqrt(sum({v} * {v})) AS norm FROM f GROUP BY neuron), g AS (SELECT a.neuron AS a, b.neuron AS b, sum({av} * {bv}) AS g FROM f a JOIN f b USING (pix) WHERE a.neuron < b.neuron GROUP BY 1, 2), s AS (SELECT a, b, {c} AS cosine FROM g JOIN n x ON x.neuron = a JOIN n y ON y.neuron = b) SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, cosine FROM s WHERE cosine >= {least}"


@query(_GRAM.format(fp=_FP, v="val", av="a.val", bv="b.val", c=r("g / (x.norm * y.norm)"), least=0.2))
def cosine_gram(spark, d):
    return C.overlap_cosine(_footprints(spark, d), 0.2)


@query(_GRAM.format(fp=_FP, v="1.0", av="1.0", bv="1.0", c=r("g / (x.norm * y.norm)"), least=0.2))
def support_overlap(spark, d):
    return C.overlap_cosine(_footprints(spark, d), 0.2, support=True)


@query(f"{_LT}, {_ADJ}, s AS (SELECT a.k AS a, b.k AS b, {r('corr(a.x, b.x)')} AS corr FROM lt a JOIN lt b USING (t) JOIN adj ON adj.a = a.k AND adj.b = b.k GROUP BY 1, 2) SELECT * FROM s WHERE corr >= 0.1")
def trace_corr(spark, d):
    return C.trace_correlation(_labels(spark, d), C.adjacent_labels(pixels(spark, d)), 0.1)


@query(f"{_FP}, x AS (SELECT neuron AS id, sum(r * val) / sum(val) AS r, sum(c * val) / sum(val) AS c FROM f GROUP BY neuron), s AS (SELECT a.id AS a, b.id AS b, {r('sqrt(pow(a.r - b.r, 2) + pow(a.c - b.c, 2))')} AS dist FROM x a, x b WHERE a.id < b.id) SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, dist FROM s WHERE dist <= 0.8")
def near_pairs(spark, d):
    mass = lambda x: (F.sum(F.col(x) * F.col("val")) / F.sum("val")).alias(x)
    return C.near_pairs(_footprints(spark, d).groupBy(F.col("neuron").alias("id")).agg(mass("r"), mass("c")), 0.8)


@query(f"{_PX}, x AS (SELECT label AS neuron, t, y, CAST(embedding[1] AS DOUBLE) * CAST(embedding[1] AS DOUBLE) AS w FROM px JOIN p USING (pix, label)) SELECT neuron, CAST(t AS INT) AS t, {r('sum(w * y) / CASE WHEN sum(w) <> 0 THEN sum(w) ELSE 1 END')} AS y FROM x GROUP BY neuron, t")
def weighted_partial_mean(spark, d):
    p = pixels(spark, d).withColumn("w", F.get("y", F.lit(0)) * F.get("y", F.lit(0)))
    return C.weighted_partial_mean(samples(p).select(F.col("label").alias("neuron"), "t", "y", "w"))


@query(f"{_FP}, e AS (SELECT neuron, pix, CAST(round(val * val, 9) AS DECIMAL(30, 9)) AS e FROM f), s AS (SELECT neuron, pix, sum(e) OVER (PARTITION BY neuron ORDER BY e, pix DESC ROWS UNBOUNDED PRECEDING) AS below, sum(e) OVER (PARTITION BY neuron) AS total FROM e) SELECT CAST(neuron AS INT) AS neuron, pix FROM s WHERE below > total * CAST(0.1 AS DECIMAL(10, 4))")
def energy_threshold(spark, d):
    return C.energy_pixels(_footprints(spark, d), 0.9)


@query(f"{_FP}, s AS (SELECT pix, neuron, round(val / sum(val) OVER (PARTITION BY neuron), 9) AS share FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY pix ORDER BY share DESC, neuron) AS k FROM s) SELECT pix, CAST(neuron AS INT) AS neuron, {r('share')} AS share FROM k WHERE k = 1")
def explained_by(spark, d):
    return C.explained_by(_footprints(spark, d))


@query(f"{_LT}, {_REG}, s AS (SELECT px.pix AS a, k AS b, round(sum(y * x), 9) AS s FROM px JOIN reg ON reg.pix = px.pix JOIN lt ON lt.t = px.t AND lt.k = reg.label GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS ka, row_number() OVER (PARTITION BY b ORDER BY s DESC, a) AS kb FROM s) SELECT a, b, {r('s')} AS s FROM k WHERE ka = 1 AND kb = 1")
def mutual_best(spark, d):
    p = pixels(spark, d)
    j = C.label_region(p).join(_labels(spark, d), "label").join(p.select("pix", "y"), "pix")
    return C.mutual_best(j.select(F.col("pix").alias("a"), F.col("label").alias("b"), F.round(A.dot(F.col("y"), F.col("trace")), 9).alias("s")))


_NEURONS = f"{_PX}, n AS (SELECT pix AS neuron, count(*) FILTER (WHERE y > 0.1) AS n_pixels, count(*) FILTER (WHERE y > 0.25 AND t > 1) AS n_events, stddev_samp(y) AS residual, CAST(10 AS DOUBLE) AS noise, max(y) AS peak, stddev_samp(y) AS spread FROM px GROUP BY pix), g AS (SELECT neuron, CASE WHEN n_pixels < 12 THEN 1 ELSE 0 END + CASE WHEN n_events = 0 THEN 2 ELSE 0 END + CASE WHEN residual / noise < 0.0125 THEN 4 ELSE 0 END + CASE WHEN peak / spread < 3 THEN 8 ELSE 0 END AS tag FROM n)"


def _neurons(spark, d) -> DataFrame:
    y = F.col("y")
    n = samples(pixels(spark, d)).groupBy(F.col("pix").alias("neuron")).agg(F.count_if(y > 0.1).alias("n_pixels"), F.count_if((y > 0.25) & (F.col("t") > 1)).alias("n_events"), (8 * F.stddev_samp("y")).alias("residual"), F.lit(10.0).alias("noise"), F.max("y").alias("peak"), F.stddev_samp("y").alias("spread"))
    return n


@query(f"{_NEURONS.replace('residual / noise < 0.0125', '8 * residual / noise < 0.1')} SELECT * FROM g")
def tag_bits(spark, d):
    return C.tags(_neurons(spark, d), 12)


@query(f"{_NEURONS.replace('residual / noise < 0.0125', '8 * residual / noise < 0.1')} SELECT n.neuron, n_pixels, {r('peak')} AS peak FROM n JOIN g USING (neuron) WHERE tag = 0")
def without_false_positives(spark, d):
    n = _neurons(spark, d)
    return C.without_false_positives(n, C.tags(n, 12)).select("neuron", "n_pixels", A.rounded(F.col("peak")).alias("peak"))


@query(f"{_PX}, m AS (SELECT label, y - avg(y) OVER (PARTITION BY pix) AS e FROM px) SELECT label, CAST(grouping(label) AS INT) AS is_total, {r('sum(e * e)', 4)} AS rss FROM m GROUP BY ROLLUP (label)")
def rss_rollup(spark, d):
    return C.residual_energy(samples(pixels(spark, d)))


@query(f"{_LT}, {_REG} SELECT px.pix, k AS label, {r('sum(y * x) - sum(y) * sum(x) / count(*)', 4)} AS u FROM px JOIN reg ON reg.pix = px.pix JOIN lt ON lt.t = px.t AND lt.k = reg.label GROUP BY px.pix, k")
def spatial_sums(spark, d):
    p = pixels(spark, d)
    return C.spatial_sums(p, C.label_region(p), _labels(spark, d)).withColumn("u", A.rounded(F.col("u"), 4))


@query(f"{_LT}, {_REG}, m AS (SELECT DISTINCT x.label AS a, y.label AS b FROM reg x JOIN reg y USING (pix)) SELECT a.k AS a, b.k AS b, {r('sum(a.x * b.x) - sum(a.x) * sum(b.x) / count(*)', 4)} AS v FROM lt a JOIN lt b USING (t) JOIN m ON m.a = a.k AND m.b = b.k GROUP BY 1, 2")
def trace_gram(spark, d):
    return C.gram(_labels(spark, d), C.region_pairs(C.label_region(pixels(spark, d)))).withColumn("v", A.rounded(F.col("v"), 4))


@query(f"{_FP}, b AS (SELECT * FROM (SELECT *, max(val) OVER (PARTITION BY neuron) AS top FROM f) WHERE val >= 0.5 * top) SELECT CAST(neuron AS INT) AS neuron, CAST(t AS INT) AS t, {r('sum(val * y) / sum(val * val)')} AS y FROM b JOIN px USING (pix) GROUP BY neuron, t")
def fast_projection(spark, d):
    return C.fast_projection(_footprints(spark, d), samples(pixels(spark, d)))


@query(f"{_PX}, m AS (SELECT label, max(greatest(y, 0)) AS top FROM px GROUP BY label) SELECT pix, CAST(t AS INT) AS t, {r('greatest(y, 0) / top')} AS y FROM px JOIN m USING (label)")
def nonneg_clip_norm(spark, d):
    p = pixels(spark, d)
    top = p.groupBy("label").agg(F.greatest(F.max(F.array_max("y")), F.lit(0.0)).alias("top"))
    return samples(p.join(top, "label")).select("pix", "t", A.rounded(F.greatest("y", F.lit(0.0)) / F.col("top")).alias("y"))


@query(f"{_PX}, s AS (SELECT pix AS neuron, {r('var_pop(y) / CASE WHEN avg(abs(y)) <> 0 THEN avg(abs(y)) END')} AS snr FROM px GROUP BY pix) SELECT neuron, snr, CAST(row_number() OVER (ORDER BY snr DESC, neuron) AS INT) AS rank FROM s")
def order_snr(spark, d):
    n = samples(pixels(spark, d)).groupBy(F.col("pix").alias("neuron")).agg(F.var_pop("y").alias("signal"), F.avg(F.abs("y")).alias("rest"))
    return C.order_by_snr(n)


@query(f"{_FP}, n AS (SELECT pix, count(*) AS n FROM f GROUP BY pix) SELECT CAST(neuron AS INT) AS neuron, mode(label ORDER BY label) AS label, count(*) AS n FROM f JOIN p USING (pix) GROUP BY neuron")
def footprint_label(spark, d):
    j = _footprints(spark, d).join(pixels(spark, d).select("pix", "label"), "pix")
    return j.groupBy("neuron").agg(F.mode("label", deterministic=True).alias("label"), F.count("*").alias("n"))


@query(f"{_FP}, e AS (SELECT DISTINCT a.neuron AS a, b.neuron AS b FROM (SELECT a.neuron AS x, b.neuron AS y, sum(a.val * b.val) AS g FROM f a JOIN f b USING (pix) WHERE a.neuron < b.neuron GROUP BY 1, 2) p JOIN (SELECT neuron, sqrt(sum(val * val)) AS n FROM f GROUP BY neuron) a ON a.neuron = x JOIN (SELECT neuron, sqrt(sum(val * val)) AS n FROM f GROUP BY neuron) b ON b.neuron = y WHERE {r('g / (a.n * b.n)')} >= 0.24), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e) SELECT CAST(id AS INT) AS id, CAST(min(label) AS INT) AS label FROM (WITH RECURSIVE t(id, label) AS (SELECT a, a FROM s UNION SELECT s.b, t.label FROM t JOIN s ON s.a = t.id) SELECT * FROM t) GROUP BY id")
def components(spark, d):
    return graph.connected_components(C.overlap_cosine(_footprints(spark, d), 0.24))


# Sets of components


@query(f"{_FP}, h AS (SELECT t AS neuron, pix, -y AS val FROM px WHERE y < -0.15), k AS (SELECT neuron, (SELECT max(neuron) FROM f) + row_number() OVER (ORDER BY neuron) AS fresh FROM (SELECT DISTINCT neuron FROM h)) SELECT CAST(neuron AS INT) AS neuron, pix, {r('val')} AS val FROM f UNION ALL SELECT CAST(fresh AS INT), pix, {r('val')} FROM h JOIN k USING (neuron)")
def append_residual(spark, d):
    """The components of what is over the level, and with fresh ids those of what is under it."""
    old = _footprints(spark, d)
    s = samples(pixels(spark, d))
    return C.appended(old.select("neuron", "pix", "val"), C.footprints(s.withColumn("y", -F.col("y")), 0.15).select("neuron", "pix", "val")).withColumn("val", A.rounded(F.col("val")))


_CC = f"""g AS (SELECT a.neuron AS x, b.neuron AS y, sum(a.val * b.val) AS g FROM f a JOIN f b USING (pix) WHERE a.neuron < b.neuron GROUP BY 1, 2), norms AS (SELECT neuron, sqrt(sum(val * val)) AS n FROM f GROUP BY neuron),
e AS (SELECT x AS a, y AS b FROM g JOIN norms a ON a.neuron = x JOIN norms b ON b.neuron = y WHERE {r('g / (a.n * b.n)')} >= 0.24), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
cc AS (SELECT id, min(label) AS label FROM (WITH RECURSIVE t(id, label) AS (SELECT a, a FROM s UNION SELECT s.b, t.label FROM t JOIN s ON s.a = t.id) SELECT * FROM t) GROUP BY id)"""


@query(f"{_FP}, {_CC} SELECT CAST(coalesce(label, neuron) AS INT) AS neuron, pix, {r('sum(val)')} AS val FROM f LEFT JOIN cc ON cc.id = f.neuron GROUP BY 1, 2")
def merged_replace(spark, d):
    """Overlapping components are replaced by their sum, under the smallest id."""
    f = _footprints(spark, d).select("neuron", "pix", "val")
    return C.merged_replace(f, graph.connected_components(C.overlap_cosine(f, 0.24))).withColumn("val", A.rounded(F.col("val")))


@query(f"{_PX} SELECT pix FROM px WHERE y > 0.2 EXCEPT SELECT pix FROM px WHERE y < -0.2")
def set_difference(spark, d):
    s = samples(pixels(spark, d))
    return s.where("y > 0.2").select("pix").subtract(s.where("y < -0.2").select("pix"))


@query(f"{_LT}, {_ADJ}, e AS (SELECT a.k AS a, b.k AS b, {r('corr(a.x, b.x)')} AS v FROM lt a JOIN lt b USING (t) JOIN adj ON adj.a = a.k AND adj.b = b.k GROUP BY 1, 2), u AS (SELECT a AS id FROM e UNION SELECT b FROM e) SELECT id AS a, CAST(row_number() OVER (ORDER BY s DESC, id) AS INT) AS rank, s FROM (SELECT id, {r('sum(v)')} AS s FROM u JOIN e ON id = a OR id = b GROUP BY id) ORDER BY rank LIMIT 50")
def merge_rank(spark, d):
    """The 50 components that are most like those around them."""
    e = C.trace_correlation(_labels(spark, d), C.adjacent_labels(pixels(spark, d)), -1.0)
    s = e.select("a", "corr").unionByName(e.select(F.col("b").alias("a"), "corr")).groupBy("a").agg(A.rounded(F.sum("corr")).alias("s"))
    top = s.orderBy(F.desc("s"), "a").limit(50)  # a top-k: the window sees 50 rows
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("s"), "a"))).select("a", "rank", "s")


# Layout


@query(f"{_PX}, g AS (SELECT i, j FROM range(0, 4) a(i), range(0, (SELECT CAST(max(c) // 8 + 1 AS BIGINT) FROM p)) b(j)) SELECT j * 4 + i AS patch, pix, r // 8 = i AND c // 8 = j AS inside FROM g JOIN p ON r BETWEEN i * 8 - 2 AND i * 8 + 9 AND c BETWEEN j * 8 - 2 AND j * 8 + 9")
def halo_members(spark, d):
    p = pixels(spark, d)
    last = p.agg(F.floor(F.max("c") / 8).alias("last"))  # one row
    m = layout.block_members(p, HEIGHT, 8, 2)
    return m.join(F.broadcast(last)).where(F.floor(F.col("patch") / 4) <= F.col("last")).drop("last")


@query(f"{_PX} SELECT pix, r, c FROM p WHERE r BETWEEN 3 AND 12 AND c BETWEEN 2 AND 9")
def patch_slice(spark, d):
    return layout.in_patch(pixels(spark, d), 3, 12, 2, 9).select("pix", "r", "c")


@query(f"{_FP} SELECT DISTINCT CAST(neuron AS INT) AS neuron, c // 8 * 4 + r // 8 AS patch FROM f")
def neuron_patch(spark, d):
    return _footprints(spark, d).select("neuron", layout.patch_of(F.col("r"), F.col("c"), HEIGHT, 8).alias("patch")).distinct()


@query(f"{_TR}, n AS (SELECT user_id AS file, count(*) AS n FROM tr GROUP BY user_id), k AS (SELECT file, n, CAST(greatest(round(n / 20), 1) AS INT) AS k FROM n) SELECT file, CAST(b AS INT) AS batch, CAST(round(1 + (n - 1) * (b - 1) / k) AS INT) AS t0, CAST(round(1 + (n - 1) * b / k) AS INT) - CASE WHEN b < k THEN 1 ELSE 0 END AS t1 FROM k, range(1, 100000) x(b) WHERE b <= k")
def batch_edges(spark, d):
    return layout.batches(traces(spark, d).groupBy(F.col("user_id").alias("file")).agg(F.count("*").alias("n")), 20)


@query(f"{_FP}, w AS (SELECT t // 16 AS batch, pix, avg(y) AS a, sum(y * y) AS e FROM px GROUP BY 1, 2) SELECT pix, {r('sum(a * e) / sum(e)')} AS a FROM w GROUP BY pix")
def batch_weighted_footprint(spark, d):
    b = samples(pixels(spark, d)).groupBy(F.floor(F.col("t") / 16).alias("batch"), "pix").agg(F.avg("y").alias("a"), F.sum(F.col("y") * F.col("y")).alias("e"))
    return b.groupBy("pix").agg(A.rounded(F.sum(F.col("a") * F.col("e")) / F.sum("e")).alias("a"))


@query(f"{_PX} SELECT label, CAST(count(*) AS BIGINT) AS n, {r('sum(y) FILTER (WHERE t <= 32)', 4)} AS first_half, {r('sum(y) FILTER (WHERE t > 32)', 4)} AS second_half FROM px GROUP BY label")
def batch_concat(spark, d):
    p = pixels(spark, d)
    a, b = p.select("pix", "label", F.slice("y", 1, 32).alias("a")), p.select("pix", F.slice("y", 33, 32).alias("b"))
    joined = a.join(b, "pix").select("label", F.concat("a", "b").alias("y"))  # batches of a neuron, in order of time
    return joined.groupBy("label").agg(F.sum(F.size("y")).alias("n"), A.rounded(F.sum(A.total(F.slice("y", 1, 32))), 4).alias("first_half"), A.rounded(F.sum(A.total(F.slice("y", 33, 32))), 4).alias("second_half"))


@query(f"{_TR}, g AS (SELECT user_id, least(greatest(corr(y, x), 0.01), 0.99) AS g FROM (SELECT *, lag(y) OVER (PARTITION BY user_id ORDER BY t) AS x FROM tr) GROUP BY user_id) SELECT user_id, {r('-1 / ln(g)')} AS tau_decay, {r('-1 / ln(g * 0.5)')} AS tau_rise, {r('g + g * 0.5')} AS g1, {r('-g * g * 0.5')} AS g2, {r('list_max([(pow(g, i) - pow(g * 0.5, i)) / (g - g * 0.5) for i in range(1, 21)])')} AS peak FROM g")
def kernel_parameters(spark, d):
    """Decay and rise times to AR(2) coefficients and the kernel's peak; the lag-1 correlation stands in for the decay."""
    x = traces(spark, d).withColumn("x", F.lag("y").over(Window.partitionBy("user_id").orderBy("t")))
    g = x.groupBy("user_id").agg(F.least(F.greatest(F.corr("y", "x"), F.lit(0.01)), F.lit(0.99)).alias("g")).withColumn("h", F.col("g") * 0.5)
    kernel = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: (F.pow("g", i) - F.pow("h", i)) / (F.col("g") - F.col("h")))
    return g.select("user_id", A.rounded(-1 / F.ln("g")).alias("tau_decay"), A.rounded(-1 / F.ln("h")).alias("tau_rise"), A.rounded(F.col("g") + F.col("h")).alias("g1"), A.rounded(-F.col("g") * F.col("h")).alias("g2"), A.rounded(F.array_max(kernel)).alias("peak"))
