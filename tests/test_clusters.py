"""Clusters by complete linkage against a plain one, one merge at a time."""

import math
import random

import pytest

from glimmer.operators import clusters
from glimmer.plans import neurons
from tests.sql import DATA


def plain(n, w):
    """(merges, leaves) from similarities w[a, b], a < b: the most similar pair of clusters first, zero pairs never."""
    groups = {i: [i] for i in range(n)}
    merges = []

    def near(x, y):
        return min(w.get((min(i, j), max(i, j)), 0.0) for i in groups[x] for j in groups[y])

    while True:
        pairs = [(-near(x, y), x, y) for x in groups for y in groups if x < y]
        found = min((p for p in pairs if p[0] < 0), default=None)
        if not found:
            return sorted(merges), groups
        s, x, y = found
        a, b = groups[x], groups.pop(y)
        ways = [(a[::-1] if k >= 2 else a, b[::-1] if k % 2 else b) for k in range(4)]
        beside = [w.get((min(p[-1], q[0]), max(p[-1], q[0])), 0.0) for p, q in ways]
        p, q = ways[max(range(4), key=lambda k: (beside[k], -k))]
        groups[x] = p + q
        merges.append((x, y, -s))


@pytest.mark.parametrize("seed,share", [(0, 1.0), (1, 0.6), (2, 0.2)])
def test_complete_linkage_and_leaves_are_those_of_one_merge_at_a_time(spark, seed, share):
    r = random.Random(seed)
    w = {(a, b): r.random() for a in range(24) for b in range(a + 1, 24) if r.random() < share}
    edges = [(*((a, b) if r.random() < 0.5 else (b, a)), s) for (a, b), s in w.items()] + [(3, 3, 1.0), (5, 6, -0.5)]
    w.setdefault((5, 6), 0.0)
    leaves, merges = clusters.complete_linkage(spark.range(24), spark.createDataFrame(edges, "a long, b long, similarity double"))
    want, groups = plain(24, w)
    assert sorted((m["a"], m["b"], m["similarity"]) for m in merges.collect()) == want
    got = {}
    for x in sorted(leaves.collect(), key=lambda x: x["place"]):
        got.setdefault(x["label"], []).append(x["id"])
    assert got == groups


def test_equal_similarities_no_edges_and_no_nodes(spark):
    same = [(a, b, 0.5) for a in range(6) for b in range(a + 1, 6)]
    leaves, merges = clusters.complete_linkage(spark.range(8), spark.createDataFrame(same, "a long, b long, similarity double"))
    assert {(x["id"], x["label"]) for x in leaves.collect()} == {(i, 0 if i < 6 else i) for i in range(8)}
    assert merges.count() == 5
    none = spark.createDataFrame([], "a long, b long, similarity double")
    assert clusters.complete_linkage(spark.range(3), none)[0].count() == 3
    assert clusters.complete_linkage(spark.range(0), none)[0].count() == 0


@pytest.mark.parametrize("name", ["order_spatial_cluster", "order_temporal_cluster"])
def test_orders_by_cluster_of_the_table(spark, name):
    from glimmer.operators import components as C

    got = sorted(neurons.QUERIES[name](spark, f"{DATA}/sf0.001").collect(), key=lambda x: x["rank"])
    f, t = neurons._footprints(spark, f"{DATA}/sf0.001"), neurons.neuron_traces(spark, f"{DATA}/sf0.001")
    ids = {x["neuron"]: x["rank"] - 1 for x in C.ordered(C.order_keys(f, t), "pnr").collect()}
    names = {i: k for k, i in ids.items()}
    prints, traces = {}, {x["neuron"]: x["trace"] for x in t.collect()}
    for x in f.collect():
        prints.setdefault(x["neuron"], {})[x["pix"]] = x["val"]
    w = {}
    for a in ids:
        for b in ids:
            if ids[a] < ids[b] and (both := prints[a].keys() & prints[b].keys()):
                if name == "order_spatial_cluster":
                    x, z = (list(prints[k].values()) for k in (a, b))
                    y = sum(prints[a][p] * prints[b][p] for p in both)
                else:
                    x, z = traces[a], traces[b]
                    y = sum(u * v for u, v in zip(x, z, strict=True))
                s = round(y / math.sqrt(sum(u * u for u in x) * sum(v * v for v in z)), 9)
                if s > 0:
                    w[ids[a], ids[b]] = s
    _, groups = plain(len(ids), w)
    assert [x["neuron"] for x in got] == [names[i] for label in sorted(groups) for i in groups[label]]
    assert [x["rank"] for x in got] == list(range(1, len(ids) + 1))
    assert any(x["place"] > 0 for x in got)
