"""A mix of sources by target weights: exact quotas of blocks, split among shards by hypergeometric draws."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glimmer.llm.common import ranked, sized, stored, whole

WEIGHTS = (1, 2, 3)
#: A source is taken so many times over at most.
MOST_PASSES = 3
BLOCK_WORDS = 1 << 14
SHARD_BLOCKS = 1 << 8
SEED = 13
#: The draws need populations below 10**9; blocks of a larger corpus hold more words in proportion.
MOST_BLOCKS = 1 << 28
#: Parts of a node of the splitting tree that one group makes.
FAN_OUT = 64


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """(source, number, source_size, target) for sizes (source, source_size).

    Sources in the order of their code points, null last, weigh `weights` in turn and share the sum of all sizes; none
    gets over `most` times its size, and what is above is shared anew by weight. A round of sharing is one aggregate,
    of which four numbers come to the driver; sources that reached their bound keep it.
    """
    s = stored(ranked(sizes, F.asc_nulls_last("source"), name="mixing-sources").select("source", "source_size", F.col("rank").alias("number"), F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).alias("w")), "mixing-weights")
    bound = most * F.col("source_size")
    full, share = F.lit(False), F.lit(0.0)
    n_full = -1
    while True:
        r = s.agg(F.sum("source_size").alias("total"), F.sum(F.when(full, bound).otherwise(0)).alias("fixed"), F.sum(F.when(full, 0).otherwise(F.col("w"))).alias("w"), F.sum(full.cast("long")).alias("n")).head()
        if r["n"] is None or r["n"] == n_full:
            return s.select("source", "number", "source_size", F.when(full, bound.cast("double")).otherwise(share).alias("target"))
        n_full = r["n"]
        share = F.lit(float((r["total"] or 0) - r["fixed"])) * F.col("w") / F.lit(float(r["w"] or 1))
        full = full | (bound < share)


def _placed(batches: Iterator[pa.RecordBatch]):
    """Rows of a range in order, with the words of their source that stand before them in it."""
    part, now, before = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        number, size = (batch.column(c).to_numpy() for c in ("number", "size"))
        start = np.zeros(len(size), np.int64)
        for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]])), strict=True) if len(number) else []:
            if number[a] != now:
                now, before = number[a], 0
            start[a:b] = before + np.cumsum(size[a:b]) - size[a:b]
            before += int(size[a:b].sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start), pa.array(np.full(len(size), part, np.int32))], [*batch.schema.names, "start", "range"])


def lines(rows: DataFrame) -> DataFrame:
    """rows (.., number, order, size) with start: the words of its source before a row, sources being put in the order of `order`.

    Sorted in ranges, so that a source of any size is many tasks' work.
    """
    schema = T.StructType([*rows.schema, T.StructField("start", T.LongType()), T.StructField("range", T.IntegerType())])
    ranged = stored(rows.orderBy("number", "order", F.monotonically_increasing_id()).mapInArrow(_placed, schema), "mixing-lines")
    by_range = ranged.groupBy("number", "range").agg(F.sum("size").alias("n"))
    before = stored(by_range.select("number", "range", (F.sum("n").over(Window.partitionBy("number").orderBy("range")) - F.col("n")).alias("before")), "mixing-ranges")
    return ranged.join(sized(before), ["number", "range"]).withColumn("start", F.col("start") + F.col("before")).drop("before", "range")


def _bounds(n_blocks: int, n_shards: int, shard: int) -> int:
    return shard * n_blocks // n_shards


def _parts(first: int, end: int) -> int:
    """Where a node of the tree over the shards from first to before end is split."""
    return (first + end) // 2


def split_node(number: np.ndarray, quota: np.ndarray, first: int, end: int, n_blocks: int, n_shards: int, seed: int, leaf: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, numbers, quotas) of the nodes of at most `leaf` shards below a node with these quotas of the sources.

    The left half of a node gets a multivariate hypergeometric draw of as many blocks as its shards hold, the right
    half the rest, so quotas of sources and sizes of shards are both kept exactly. A draw depends on the node alone.
    """
    if end - first <= leaf:
        yield first, end, number, quota
        return
    mid = _parts(first, end)
    n_left = _bounds(n_blocks, n_shards, mid) - _bounds(n_blocks, n_shards, first)
    left = np.random.default_rng([seed, first, end]).multivariate_hypergeometric(quota, n_left, method="marginals")
    for a, b, q in ((first, mid, left), (mid, end, quota - left)):
        there = q > 0
        yield from split_node(number[there], q[there], a, b, n_blocks, n_shards, seed, leaf)


def shard_quotas(quotas: DataFrame, n_blocks: int, n_shards: int, seed: int = SEED) -> DataFrame:
    """(shard, number, n): blocks of each source for each shard, from the sources' quotas (number, n).

    The tree goes down by FAN_OUT shards a level of jobs; a group holds a node's sources, one row each.
    """

    def down(leaf: int):
        def run(key, group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("number")
            nodes = split_node(group["number"].to_numpy(), group["n"].to_numpy(), int(key[0]), int(key[1]), n_blocks, n_shards, seed, leaf)
            return pd.concat([pd.DataFrame({"first": a, "end": b, "number": number, "n": n}) for a, b, number, n in nodes])

        return run

    rows = quotas.select(F.lit(0).cast("long").alias("first"), F.lit(n_shards).cast("long").alias("end"), "number", "n").where("n > 0")
    leaf = n_shards
    while leaf > 1:
        leaf = -(-leaf // FAN_OUT)
        rows = rows.groupBy("first", "end").applyInPandas(down(leaf), "first long, end long, number long, n long")
    return rows.select(F.col("first").alias("shard"), "number", "n")


def permuted(j: np.ndarray, n: int, key: int) -> np.ndarray:
    """A bijection of 0..n-1: a Feistel network over the next even number of bits, walked until it falls below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([key, n]).integers(0, 1 << 63, 4, np.uint64) | np.uint64(1)
    x = np.array(j, np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            left, right = right, left ^ ((mixed * k >> np.uint64(31)) & mask)
        x[todo] = left << np.uint64(half) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def _drawn(seed: int):
    """(number, block, shard) for rows (shard, number, first, n, quota): the blocks at n places of the source's permutation."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for r in batch.to_pylist():
                for a in range(0, r["n"], 1 << 16):
                    j = np.arange(r["first"] + a, r["first"] + min(a + (1 << 16), r["n"]))
                    block = permuted(j, r["quota"], (seed << 32) + r["number"])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), r["number"])), pa.array(block), pa.array(np.full(len(j), r["shard"]))], ["number", "block", "shard"])

    return run


def mix(docs: DataFrame, texts: bool = False, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, mix). rows: (row, doc_id, size, source_size, target) for every row of docs; mix: (row, pass, words, shard,
    position), with doc_id and the text if `texts`: what each output shard takes, in its order.

    The documents of a source stand in the order of their hash, and a mix of T words takes the first T words of that
    line, again from its start where T is more than the source has (never over MOST_PASSES times). So a source gives its
    rounded target to the word; only the last copy of a document may be cut. A line is cut into blocks of whole
    documents by the words before them. The sources' quotas of blocks are split among the shards (`shard_quotas`), each
    shard draws its blocks of a source from a permutation, disjoint from other shards', and orders its rows by hash.
    Nothing depends on how rows lie, so reruns agree.

    Null texts have size 0 and are never taken, null sources are one source and the last, null ids stay, repeated rows
    are taken each on their own account, an empty table gives none; other columns are ignored.
    """
    text = whole()
    keep = [text.alias("text")] if texts else []
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    own = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", words.alias("size"), F.xxhash64(F.lit(seed), "doc_id", text).alias("order"), *keep), "mixing-rows")
    rows = own.drop("text")
    goals = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "mixing-targets")
    total = goals.agg(F.sum("source_size")).head()[0] or 0
    per_block = max(block_words, -(-total // MOST_BLOCKS))
    known = rows.alias("a").join(sized(goals).alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("row", "doc_id", "size", "order", "number", "source_size", "target")

    taken = F.round("target").cast("long")
    quotas = goals.select("number", F.ceil(taken / per_block).alias("n"))
    n_blocks = quotas.agg(F.sum("n")).head()[0] or 0
    n_shards = max(1, -(-n_blocks // shard_blocks))
    by_source = Window.partitionBy("number").orderBy("shard")  # a row a shard
    spans = shard_quotas(quotas, n_blocks, n_shards, seed).withColumn("first", F.sum("n").over(by_source) - F.col("n"))
    spans = spans.join(quotas.withColumnRenamed("n", "quota"), "number").select("shard", "number", "first", "n", "quota")
    blocks = sized(stored(spans.mapInArrow(_drawn(seed), "number long, block long, shard long"), "mixing-blocks"))

    copies = lines(known.where("size > 0")).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MOST_PASSES - 1))))
    copies = copies.withColumn("at", F.col("pass") * F.col("source_size") + F.col("start")).where(F.col("at") < taken)
    copies = copies.select("row", "doc_id", "number", "pass", "order", F.least("size", taken - F.col("at")).alias("words"), F.floor(F.col("at") / per_block).alias("block"))
    mixed = copies.join(blocks, ["number", "block"])
    position = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "order", "pass"), "order", "pass", "row"))  # a shard holds shard_blocks blocks
    mixed = mixed.select("row", "doc_id", "pass", "words", "shard", position.alias("position"))
    if texts:
        mixed = mixed.join(own.select("row", "text"), "row")
    return known.select("row", "doc_id", "size", "source_size", "target"), mixed


def taken_words(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of docs; edge cases as in mix."""
    rows, mixed = mix(docs)
    both = rows.select("row", "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("words"), F.lit(0).alias("copy"))
    none = {c: F.lit(None).cast(t) for c, t in (("size", "long"), ("source_size", "long"), ("target", "double"))}
    both = both.unionByName(mixed.select("row", "doc_id", "words", F.lit(1).alias("copy")).withColumns(none))
    each = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.max(c).alias(c) for c in none), F.sum("words").alias("taken"), F.sum("copy").alias("copies"))
    return each.drop("row")
