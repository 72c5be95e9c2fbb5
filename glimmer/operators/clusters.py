"""Agglomerative clusters by complete linkage on a sparse graph, and the order of their leaves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glimmer.operators.shared import apart, cut, ranked, shared_folder


def _mutual(pairs: DataFrame) -> DataFrame:
    """(a, b, w), a < b: the pairs that are each other's most similar; of equally similar ones the smaller ids first."""
    both = pairs.select("a", "b", "w").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    order = F.struct((-F.col("w")).alias("w"), F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    best = both.groupBy("a").agg(F.min(order).alias("o")).select("a", F.when(F.col("a") == F.col("o.low"), F.col("o.high")).otherwise(F.col("o.low")).alias("b"), (-F.col("o.w")).alias("w"))
    other = apart(best).select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("too"))
    return best.where("a < b").join(other, ["a", "b"]).select("a", "b", "w")


def _turned(merges: DataFrame, leaves: DataFrame, links: DataFrame) -> DataFrame:
    """The merges with how either side is turned, so that the leaves that come to lie beside each other are most similar.

    turn_a, turn_b: whether a side's leaves go backwards; n_a and n_b: how many leaves it has.
    """
    ends = leaves.groupBy("label").agg(F.count("*").alias("n"), F.min_by("id", "place").alias("first"), F.max_by("id", "place").alias("last"))
    side = lambda x: ends.select(F.col("label").alias(x), F.col("n").alias(f"n_{x}"), F.col("first").alias(f"first_{x}"), F.col("last").alias(f"last_{x}"))
    d = merges.join(side("a"), "a").join(side("b"), "b")
    ways = [F.struct(F.lit(k).alias("k"), F.lit(k >= 2).alias("turn_a"), F.lit(k % 2 == 1).alias("turn_b"), F.col("first_a" if k >= 2 else "last_a").alias("p"), F.col("last_b" if k % 2 else "first_b").alias("q")) for k in range(4)]
    d = d.withColumn("way", F.explode(F.array(*ways))).withColumns({"low": F.least("way.p", "way.q"), "high": F.greatest("way.p", "way.q")})
    beside = links.select(F.col("a").alias("low"), F.col("b").alias("high"), F.col("w").alias("beside"))
    d = d.join(beside, ["low", "high"], "left")
    best = F.min(F.struct((-F.coalesce("beside", F.lit(0.0))).alias("beside"), F.col("way.k").alias("k"), F.col("way.turn_a").alias("turn_a"), F.col("way.turn_b").alias("turn_b"))).alias("best")
    d = d.groupBy("a", "b").agg(best, *[F.first(c).alias(c) for c in ("w", "n_a", "n_b")])
    return d.select("a", "b", "w", "n_a", "n_b", "best.turn_a", "best.turn_b")


def complete_linkage(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves, merges) of the ids in nodes (id) by the similarities in edges (a, b, similarity), those over 0.

    Two clusters are as similar as the two of their members that are least so; members without an edge are not similar,
    and clusters with such a pair stay apart. Each round merges all pairs of clusters that are each other's most similar,
    which under complete linkage gives the tree of one merge at a time; of equal similarities the smaller ids go first.
    A cluster has the smallest id in it for a label.

    merges: (round, a, b, similarity), b becoming part of a. leaves: (id, label, place), the place counting from 0 in the
    cluster, after each merge has turned its sides so that the leaves that meet are most similar.

    A pair of clusters is one row, the smallest of its pairs' similarities; it goes on only if each part of one meets each
    part of the other. No task holds a cluster, and rows become fewer with every round.
    """
    spark = nodes.sparkSession
    named = edges.where((F.col("a") != F.col("b")) & (F.col("similarity") > 0)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("similarity").cast("double").alias("w"))
    links = pairs = cut(named.groupBy("a", "b").agg(F.max("w").alias("w")))
    leaves = cut(nodes.select("id").distinct().select("id", F.col("id").alias("label"), F.lit(0).cast("long").alias("place")))
    found, turn = f"{shared_folder(spark)}/merges-{uuid.uuid4().hex}", 0
    while True:
        turn += 1
        merged = _turned(_mutual(pairs), leaves, links)
        merged.write.parquet(f"{found}/round={turn}")
        merged = spark.read.schema(merged.schema).parquet(f"{found}/round={turn}")
        if not merged.head(1):
            every = spark.read.schema(T.StructType([*merged.schema, T.StructField("round", T.IntegerType())])).parquet(found)
            return leaves, every.select("round", "a", "b", F.col("w").alias("similarity"))
        moves = merged.select(F.explode(F.array(
            F.struct(F.col("a").alias("label"), F.col("a").alias("to"), F.col("turn_a").alias("back"), F.col("n_a").alias("n_own"), F.lit(0).cast("long").alias("shift")),
            F.struct(F.col("b").alias("label"), F.col("a").alias("to"), F.col("turn_b").alias("back"), F.col("n_b").alias("n_own"), F.col("n_a").alias("shift")),
        )).alias("m")).select("m.*")
        place = F.col("shift") + F.when(F.col("back"), F.col("n_own") - 1 - F.col("place")).otherwise(F.col("place"))
        leaves = cut(leaves.join(moves, "label", "left").select("id", F.coalesce("to", "label").alias("label"), F.coalesce(place, "place").alias("place")))
        to = lambda x: moves.select(F.col("label").alias(x), F.col("to").alias(f"to_{x}"))
        moved = pairs.join(to("a"), "a", "left").join(to("b"), "b", "left")
        parts = F.when(F.col("to_a").isNull(), 1).otherwise(2) * F.when(F.col("to_b").isNull(), 1).otherwise(2)
        moved = moved.select(F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y"), "w", parts.alias("parts")).where("x <> y")
        pairs = cut(moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("w").alias("w"), F.count("*").alias("met"), F.max("parts").alias("parts")).where("met = parts").select("a", "b", "w"))


def order_by_clusters(ranks: DataFrame, similar: DataFrame) -> DataFrame:
    """(neuron, cluster, place, rank): components in the order of their clusters' leaves.

    ranks (neuron, rank) is the order that the clusters start from: a cluster comes where its first component would, and
    cluster is that component. similar: (a, b, similarity) of pairs of components; pairs that are not there are not alike.
    """
    own = cut(ranks.select("neuron", F.col("rank").cast("long").alias("id")))
    name = lambda x: own.select(F.col("neuron").alias(x), F.col("id").alias(f"id_{x}"))
    edges = similar.join(name("a"), "a").join(name("b"), "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "similarity")
    leaves, _ = complete_linkage(own.select("id"), edges)
    first = own.select(F.col("neuron").alias("cluster"), F.col("id").alias("label"))
    return ranked(leaves.join(own, "id").join(first, "label"), "label", "place").select("neuron", "cluster", "place", "rank")
