"""Connected components of pairs, and the merge of what they connect."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.functions import kernels as K
from glimmer.operators.shared import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label) for edges (a, b): the label is the smallest id that a path leads to.

    Smallest neighbouring labels and then the labels' labels, round by round; each round is checkpointed.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = cut(labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        far = step.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = cut(step.join(far, "label").select("id", "old", F.least("label", "far").alias("label")))
        if not new.where("old <> label").head(1):
            return new.select("id", "label")
        labels = new.select("id", "label")


def merged_traces(traces: DataFrame, footprints: DataFrame, groups: DataFrame, rounds: int = 10) -> DataFrame:
    """(label, members, trace, parts): the rank-one trace of each group (id, label), by power iterations on what its members add up to.

    parts (id, part): the footprint that goes with the trace is the sum of the members' footprints in these parts.

    traces: (id, trace); footprints: (id, pix, val). The iterations need the members' traces and the Gram matrix of their
    footprints alone, which a join on pix sums up; so a group is a handful of rows, however many pixels it has.
    """
    named = groups.select("id", F.col("label").cast("long").alias("label"))
    f = footprints.join(named, "id")
    other = f.select("label", "pix", F.col("id").alias("id2"), F.col("val").alias("val2"))
    gram = f.join(other, ["label", "pix"]).groupBy("label", "id", "id2").agg(F.sum(F.col("val") * F.col("val2")).alias("v"))
    rows = gram.groupBy("label", "id").agg(F.collect_list(F.struct("id2", "v")).alias("row")).join(traces, "id")

    def refit(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id").reset_index(drop=True)
        place = {k: i for i, k in enumerate(group["id"])}
        traces, v = np.vstack(group["trace"].to_list()), np.zeros((len(group), len(group)))
        for i, row in enumerate(group["row"]):
            for e in row:
                v[i, place[e["id2"]]] = e["v"]
        c = np.sqrt(np.maximum(np.diag(v), 0.0)) @ traces
        for _ in range(rounds):
            part = traces @ c / max(c @ c, 1e-300)
            c = part @ v @ traces / max(part @ v @ part, 1e-300)
        parts = [{"id": i, "part": float(p)} for i, p in zip(group["id"], traces @ c / max(c @ c, 1e-300), strict=True)]
        return pd.DataFrame({"label": [key[0]], "members": [len(group)], "trace": [c], "parts": [parts]})

    kind = footprints.schema["id"].dataType.simpleString()
    return rows.groupBy("label").applyInPandas(refit, f"label long, members long, trace array<double>, parts array<struct<id: {kind}, part: double>>")


def updated_traces(sums: DataFrame, rounds: int = 3) -> DataFrame:
    """Non-negative updates (HALS) from sums: (patch, k, x) from (patch, u array, v array<array>, x array<array>)."""

    @F.pandas_udf("array<array<double>>")
    def run(u: pd.Series, v: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([K.hals(np.vstack(a), np.vstack(b), np.vstack(c), rounds).tolist() for a, b, c in zip(u, v, x, strict=True)])

    return sums.select("patch", run("u", "v", "x").alias("x"))


def update_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, turn): components that overlap have different turns, so those of one turn may be updated together.

    Round by round, a component whose hash is the largest among its neighbours without a turn gets the next one.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    left, done, turn = cut(nodes.select("id").distinct()), None, 0
    while left.head(1):
        turn += 1
        key = F.struct(F.xxhash64("id"), "id")
        high = both.join(left.select(F.col("id").alias("a")), "a").join(left.select(F.col("id").alias("b"), key.alias("key")), "b").groupBy(F.col("a").alias("id")).agg(F.max("key").alias("most"))
        mine = left.join(high, "id", "left").where(F.col("most").isNull() | (key > F.col("most"))).select("id", F.lit(turn).alias("turn"))
        done = cut(mine if done is None else done.unionByName(mine))
        left = cut(left.join(done, "id", "left_anti"))
    return done if done is not None else nodes.select("id", F.lit(1).alias("turn"))
