"""Importance resampling towards a target: hashed n-gram features, gains by bucket, Gumbel noise, the highest scores."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import pieces_of, ranked, stored, whole

BUCKETS = 10_000
ORDER = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: What parts words, after A-Z have been lower-cased.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def features(texts: pa.Array, order: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(words of each text, for each length of run (owner, key, buckets of keys)): a feature is a run of 1 to `order` words.

    Words are dictionary indices; a run's key is that of the run one word shorter and the index shifted to its last
    word. Each distinct pair of the two gets its CRC once, going on from the CRC of the shorter run.
    """
    split = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=_BETWEEN)
    words, owner = pc.list_flatten(split), pc.list_parent_indices(split)
    filled = pc.greater(pc.binary_length(words), 0)
    coded = pc.dictionary_encode(pc.filter(words, filled))
    owner = pc.filter(owner, filled).to_numpy(zero_copy_only=False)
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = [w.encode() for w in coded.dictionary.to_pylist()]
    crc = np.fromiter(map(zlib.crc32, names), np.int64, len(names))
    key, found = index, [(owner, index, crc % buckets)]
    for k in range(1, order):
        whole_run = owner[k:] == owner[:-k] if len(owner) > k else np.zeros(0, bool)
        pairs, key_of = np.unique(key[: len(whole_run)][whole_run] * max(len(names), 1) + index[k:][whole_run], return_inverse=True)
        before, word = np.divmod(pairs, max(len(names), 1))
        crc = np.array([zlib.crc32(b" " + names[w], int(crc[b])) for b, w in zip(before.tolist(), word.tolist(), strict=True)], np.int64)
        # Runs that would reach into the next text keep a place, so that places and words stay in step.
        key = np.zeros(len(whole_run), np.int64)
        key[whole_run] = key_of
        found.append((np.where(whole_run, owner[: len(whole_run)], -1), key, crc % buckets))
    return np.bincount(owner, minlength=len(texts)), found


def bucket_counts(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket: counted by task, then summed; `buckets` numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]):
        n = np.zeros(buckets, np.int64)
        for batch in pieces_of(batches):
            for owner, key, bucket in features(batch.column(0), order, buckets)[1]:
                n += np.bincount(bucket[key[owner >= 0]], minlength=buckets)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(n[there])], ["bucket", "n"])

    counted = texts.select(whole().alias("text")).mapInArrow(run, "bucket int, n long")
    total = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        total[r["bucket"]] = r["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    n, big_s, big_t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (big_s + n) / ((s + 1.0) * (big_t + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 x) of a Gumbel variable x by the hash of the id; a null id is the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, rank) for every row of docs; rank is null for those that are not drawn.

    A text's weight is the floored mean of its features' gains, its score the weight plus noise by its id. Of the rows
    with `least_words` words or more, `percent` of a hundred are drawn: those of the highest scores, of equal ones those
    of the smallest id (null ids last). The lowest score drawn comes from counts by score, which are bounded: gains and
    noise are logarithms of 64-bit numbers, so there are fewer than 150,000 whole scores whatever the input. Only rows
    from that score on are ranked.

    Null texts are empty and have weight 0; repeated rows are drawn each; without rows or without target texts the gains
    are those of empty counts; other columns are ignored.
    """
    spark = docs.sparkSession
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs, order, buckets), bucket_counts(target, order, buckets)))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in pieces_of(batches):
            n_words, found = features(batch.column(1), order, buckets)
            n = np.zeros(batch.num_rows, np.int64)
            total = np.zeros(batch.num_rows, np.int64)
            for owner, key, bucket in found:
                real = owner >= 0
                owner, key = owner[real], key[real]
                if len(owner):
                    each = gain.value[bucket].take(key)
                    first = np.flatnonzero(np.diff(owner, prepend=-1))  # a text's features stand together
                    total[owner[first]] += np.add.reduceat(each, first)
                n += np.bincount(owner, minlength=batch.num_rows)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            score = weight + np.fromiter((noise(d, seed) for d in batch.column(0).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, n_words.astype(np.int64), weight, score))], ["doc_id", "n_features", "n_words", "weight", "score"])

    scored = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).mapInArrow(run, "doc_id long, n_features long, n_words long, weight long, score long"), "resampling-scores")
    may = F.col("n_words") >= least_words
    by_score = sorted(scored.where(may).groupBy("score").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["score"])
    draw = percent * sum(r["n"] for r in by_score) // 100
    least, before = None, 0
    for r in by_score:
        if before >= draw:
            break
        least, before = r["score"], before + r["n"]
    drawn = may & (F.col("score") >= least) if least is not None else F.lit(False)
    order_by = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features"))
    top = ranked(scored.where(drawn), *order_by, name="resampling-ranks").withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return top.unionByName(scored.where(~drawn).withColumn("rank", F.lit(None).cast("long")))
