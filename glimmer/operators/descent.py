"""Coordinate descent over a whole movie: sparse products, and turns of components that do not overlap.

Footprints are (neuron, pix, val), ring weights (pix, nbr_pix, w), traces (neuron, trace). No product but A'Y touches
the movie: (I - W) is moved to the footprints, which have no frames, so ((I - W) A)' (I - W) Y is one product with Y.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.functions import arrays as A
from glimmer.operators import graph
from glimmer.operators.layout import patch_of
from glimmer.operators.shared import apart, cut, sized

#: Frames of a patch that one task holds at a time.
FRAMES = 1024
#: Rows of V, some 24 bytes each, that may go to all tasks; and values of a range of frames that a task then holds.
LINKS = 1 << 18
FRAME_VALUES = 1 << 22


def _difference(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("neuron", "pix", "val").unionByName(b.select("neuron", "pix", (-F.col("val")).alias("val")))
    return both.groupBy("neuron", "pix").agg(F.sum("val").alias("val"))


def without_ring(footprints: DataFrame, weights: DataFrame) -> DataFrame:
    """(I - W) A: a join on nbr_pix, and sums by component and pixel, partial before they are shuffled."""
    w = weights.select("pix", F.col("nbr_pix").alias("q"), "w")
    around = footprints.select("neuron", F.col("pix").alias("q"), "val").join(w, "q").select("neuron", "pix", (F.col("w") * F.col("val")).alias("val"))
    return _difference(footprints, around)


def without_ring_transposed(footprints: DataFrame, weights: DataFrame) -> DataFrame:
    """(I - W)' A: the same along the weights' other side."""
    around = footprints.select("neuron", "pix", "val").join(weights.select("pix", "nbr_pix", "w"), "pix").select("neuron", F.col("nbr_pix").alias("pix"), (F.col("w") * F.col("val")).alias("val"))
    return _difference(footprints, around)


def footprint_gram(footprints: DataFrame) -> DataFrame:
    """A'A: (a, b, v) of the components that share pixels, each with itself too."""
    other = footprints.select(F.col("neuron").alias("b"), "pix", F.col("val").alias("w"))
    return footprints.join(other, "pix").groupBy(F.col("neuron").alias("a"), "b").agg(F.sum(F.col("val") * F.col("w")).alias("v"))


def array_of(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name) with the values of (key, t, value) in time order."""
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", value))), lambda x: x[value]).alias(name))


def projected(pixels: DataFrame, footprints: DataFrame, height: int, size: int, frames: int = FRAMES) -> DataFrame:
    """A'Y: (neuron, u). A task has a patch and `frames` frames of it; its sums are added up by component and frame."""
    n = F.size("y")
    slices = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / frames) - 1, F.lit(0)).cast("int")))
    rows = pixels.select("pix", patch_of(F.col("r"), F.col("c"), height, size).alias("patch"), "y", slices.alias("part"))
    rows = rows.select("pix", "patch", "part", F.slice("y", F.col("part") * frames + 1, frames).alias("y"))
    where = pixels.select("pix", patch_of(F.col("r"), F.col("c"), height, size).alias("patch"), slices.alias("part"))
    parts = footprints.select(F.col("neuron").cast("long").alias("neuron"), "pix", "val").join(where, "pix")

    def run(key, group: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(parts):
            return pd.DataFrame({"neuron": [], "part": [], "u": []}, dtype=object)
        place = {p: i for i, p in enumerate(group["pix"].tolist())}
        names, k = np.unique(parts["neuron"].to_numpy(), return_inverse=True)
        a = np.zeros((len(names), len(group)))
        np.add.at(a, (k, [place[p] for p in parts["pix"].tolist()]), parts["val"].to_numpy())
        u = a @ np.nan_to_num(np.vstack(group["y"].to_list()))
        return pd.DataFrame({"neuron": names, "part": int(key[1]), "u": list(u)})

    found = rows.groupBy("patch", "part").cogroup(apart(parts).groupBy("patch", "part")).applyInPandas(run, "neuron long, part int, u array<double>")
    each = found.select("neuron", "part", F.posexplode("u").alias("at", "u")).select("neuron", (F.col("part") * frames + F.col("at")).alias("t"), "u")
    return array_of(each.groupBy("neuron", "t").agg(F.sum("u").alias("u")), "neuron", "u", "u")


def turns_of(gram: DataFrame) -> DataFrame:
    """(id, turn): components of one turn share no pixel."""
    return graph.update_order(gram.where("a < b").select("a", "b"), gram.select(F.col("a").alias("id")))


def _turns_here(rows: list) -> dict[int, int]:
    """The turns of turns_of for the rows (a, b, v, h) of a small Gram matrix, h being the hash of a."""
    key = {r["a"]: (r["h"], r["a"]) for r in rows}
    near: dict[int, set[int]] = {k: set() for k in key}
    for r in rows:
        if r["a"] != r["b"]:
            near[r["a"]].add(r["b"])
    turns, left, turn = {}, set(key), 0
    while left:
        turn += 1
        mine = [k for k in left if all(key[k] > key[n] for n in near[k] & left)]
        turns.update(dict.fromkeys(mine, turn))
        left.difference_update(mine)
    return turns


def temporal_sweeps(sums: DataFrame, gram: DataFrame, start: DataFrame | None = None, rounds: int = 5, rule: str = "clip", most_links: int = LINKS) -> DataFrame:
    """(neuron, trace) that minimise |Y - A C|, by sweeps over U (neuron, u) and V (a, b, v), turn by turn.

    Components of one turn share no pixel, so they move together, and a sweep gives what a serial sweep in the order of
    the turns gives. rule: clip, values below 0 become 0; shift, the trace's least value becomes 0 (for traces on an
    unknown baseline); free, as it comes. Components without energy are left out.

    V has no frames. If its rows are counted to be few (most_links), it goes to all tasks, each of which sweeps over a
    range of frames of all components, as frames do not see each other; U is shuffled twice in all. Else a turn is a join,
    in which a task has a component with the traces of those that overlap it. Both give the same.
    """
    # A shift adds a constant to a trace, which others answer with constants: the frames go as if there were none.
    inner = "free" if rule == "shift" else rule
    size = gram.where("a = b and v > 0").select(F.col("a").alias("neuron"), F.col("v").alias("d"))
    zero = F.transform("u", lambda x: F.lit(0.0))
    state = sums.select("neuron", "u").join(size, "neuron")
    state = state.join(start.select("neuron", F.col("trace").alias("c")), "neuron", "left").withColumn("c", F.coalesce("c", zero)) if start is not None else state.withColumn("c", zero)
    few = gram.select("a", "b", "v", F.xxhash64("a").alias("h")).limit(most_links + 1).collect()
    found = _swept_by_frames(state, few, rounds, inner) if len(few) <= most_links else _swept_by_turns(state, gram, rounds, inner)
    return found.select("neuron", F.transform("trace", lambda x: x - F.array_min("trace")).alias("trace")) if rule == "shift" else found


def converged_sweeps(sums: DataFrame, gram: DataFrame, start: DataFrame | None = None, tolerance: float = 1e-3, most: int = 100, rule: str = "clip") -> tuple[DataFrame, DataFrame]:
    """(traces (neuron, trace), changes (sweep, change)): temporal_sweeps, one at a time, until the traces stay.

    The change of a sweep is the norm of what it moved over the norm of the traces after it; it ends once that is at the
    tolerance or below, or after `most` sweeps. Each sweep's traces are a table, and the change is one number.
    """
    sums, gram = cut(sums), cut(gram)
    before, changes = start, []
    while len(changes) < most:
        after = cut(temporal_sweeps(sums, gram, before, 1, rule))
        old = before.select("neuron", F.col("trace").alias("old")) if before is not None else after.select("neuron", F.transform("trace", lambda x: F.lit(0.0)).alias("old"))
        d = after.join(apart(old), "neuron", "left").withColumn("old", F.coalesce("old", F.transform("trace", lambda x: F.lit(0.0))))
        moved = F.zip_with("trace", "old", lambda x, z: x - z)
        sizes = d.agg(F.sum(A.dot(moved, moved)).alias("moved"), F.sum(A.dot(F.col("trace"), F.col("trace"))).alias("all")).head()
        before = after
        changes.append(math.sqrt((sizes["moved"] or 0.0) / sizes["all"]) if sizes["all"] else 0.0)
        if changes[-1] <= tolerance:
            break
    return before, sums.sparkSession.createDataFrame(list(enumerate(changes, 1)), "sweep int, change double")


def _swept_by_frames(state: DataFrame, links: list, rounds: int, rule: str) -> DataFrame:
    turns = _turns_here(links)
    order = sorted(turns, key=lambda k: (turns[k], k))
    frames = min(FRAMES, max(1, FRAME_VALUES // max(len(order), 1)))
    rows = {k: ([], []) for k in order}
    for r in links:
        rows[r["a"]][0].append(r["b"])
        rows[r["a"]][1].append(r["v"])
    known = state.sparkSession.sparkContext.broadcast((order, {k: (i, np.array(v)) for k, (i, v) in rows.items()}))
    parts = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("u") / frames) - 1, F.lit(0)).cast("int")))
    cut_ = lambda x: F.slice(x, F.col("part") * frames + 1, frames).alias(x)
    d = state.select(F.col("neuron").cast("long").alias("neuron"), "u", "c", parts.alias("part")).select("part", "neuron", cut_("u"), cut_("c"))

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        order, rows = known.value
        place = {k: i for i, k in enumerate(group["neuron"].tolist())}
        u, c = np.vstack(group["u"].to_list()), np.vstack(group["c"].to_list())
        todo = []
        for k in order:
            if k in place:
                at = np.array([j in place for j in rows[k][0]])
                others = np.array([place[j] for j in rows[k][0] if j in place])
                todo.append((place[k], others, rows[k][1][at]))
        for _ in range(rounds):
            for i, others, v in todo:
                c[i] += (u[i] - v @ c[others]) / v[others == i][0]
                if rule == "clip":
                    np.maximum(c[i], 0.0, out=c[i])
        return pd.DataFrame({"neuron": group["neuron"], "part": int(key[0]), "c": list(c)})

    found = d.groupBy("part").applyInPandas(run, "neuron long, part int, c array<double>")
    return found.groupBy("neuron").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "c"))), lambda x: x["c"])).alias("trace"))


def _swept_by_turns(state: DataFrame, gram: DataFrame, rounds: int, rule: str) -> DataFrame:
    turns = turns_of(gram)
    state, links = cut(state.join(turns.select(F.col("id").alias("neuron"), "turn"), "neuron")), cut(gram.where("a <> b"))
    last = turns.agg(F.max("turn")).head()[0] or 0
    for _ in range(rounds):
        for turn in range(1, last + 1):
            mine = state.where(F.col("turn") == turn).select(F.col("neuron").alias("a"))
            others = links.join(mine, "a").join(state.select(F.col("neuron").alias("b"), "c"), "b")
            others = others.groupBy(F.col("a").alias("neuron")).agg(A.weighted_sum(F.collect_list(F.struct("v", "c")), "v", "c").alias("s"))
            # A join and no union of both parts, whose partitions would add up turn by turn.
            state = cut(state.join(others, "neuron", "left").withColumn("c", F.when(F.col("turn") == turn, _moved(rule)).otherwise(F.col("c"))).drop("s"))
    return state.select("neuron", F.col("c").alias("trace"))


def _moved(rule: str) -> Column:
    rest = F.when(F.col("s").isNull(), F.col("u")).otherwise(F.zip_with("u", "s", lambda u, s: u - s))
    raw = F.transform(rest, lambda x: x / F.col("d"))
    return F.transform(raw, lambda x: F.greatest(x, F.lit(0.0))) if rule == "clip" else raw


def cross_gram(a: DataFrame, b: DataFrame) -> DataFrame:
    """A'B: (neuron, j, v) of footprints (neuron, pix, val) and (j, pix, val)."""
    return a.join(b.select("j", "pix", F.col("val").alias("w")), "pix").groupBy("neuron", "j").agg(F.sum(F.col("val") * F.col("w")).alias("v"))


def combined(links: DataFrame, traces: DataFrame) -> DataFrame:
    """(k, s): the sum of v times the traces (neuron, trace) for links (k, neuron, v), however many a k has: by frame."""
    rows = links.join(traces.select("neuron", "trace"), "neuron").select("k", "v", F.posexplode("trace").alias("t", "x"))
    return array_of(rows.groupBy("k", "t").agg(F.sum(F.col("v") * F.col("x")).alias("s")), "k", "s", "s")


def dots(region: DataFrame, pixels: DataFrame, traces: DataFrame) -> DataFrame:
    """(pix, label, u): Y C' in a region (pix, label), for traces (label, trace)."""
    d = region.join(sized(cut(traces.select("label", "trace"))), "label").join(pixels.select("pix", "y"), "pix")
    return d.select("pix", "label", A.dot(F.col("y"), F.col("trace")).alias("u"))
