"""Toxicity: a linear classifier whose score may not change when identity terms are swapped."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import pieces_of, stored, whole

#: Labelled rows that the classifier is fitted on: at most so many of each label, those of the smallest hash.
SAMPLE = 4000
#: Hash buckets of the features.
BUCKETS = 1 << 18
#: Weight of the squared score change under a swap.
COUNTERFACTUAL = 4.0
#: A feature takes part if so many rows have it and its toxic share is so many standard deviations from the mean.
MIN_ROWS = 4
MIN_DEVIATION = 4.0
PREFIXES = (3, 4, 5, 6)
# Terms that name groups of people; those of one line may stand for each other.
IDENTITY = (
    "men women man woman boys girls male female trans",
    "gay straight lesbian bisexual queer heterosexual",
    "black white asian latino african european arab hispanic",
    "christian muslim jewish hindu buddhist atheist catholic protestant",
    "disabled blind deaf old young elderly",
    "immigrant refugee foreigner native migrant",
    "hommes femmes homme femme", "musulman chrétien juif hindou",
    "männer frauen mann frau", "muslim christ jude hindu",
    "hombres mujeres hombre mujer", "musulmán cristiano judío hindú",
)
# End of fixed values.
_SWAPS = {w: line.split() for line in IDENTITY for w in line.split()}
_MEMO = 300_000


def _core(raw: str) -> str:
    return re.sub(r"\W+", "", raw.lower())


def _features(word: str) -> list[int]:
    """Buckets of a word: itself and its beginnings, so that inflected and compound forms share weight."""
    names = [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(x.encode()) % BUCKETS for x in names]


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, how many of the text's distinct words have each)."""
    found = [f for w in {_core(raw) for raw in set(text.split())} - {""} for f in _features(w)]
    return np.unique(np.array(found, np.int64), return_counts=True)


def swapped(text: str) -> str | None:
    """The text with each identity term replaced by the next of its line; None if there is none."""
    found = False

    def other(raw: str) -> str:
        nonlocal found
        word = _core(raw)
        if word not in _SWAPS:
            return raw
        found = True
        line = _SWAPS[word]
        return line[(line.index(word) + 1) % len(line)]

    out = " ".join(map(other, text.split()))
    return out if found else None


def telling(rows: DataFrame) -> np.ndarray:
    """Boolean per bucket: the feature is in MIN_ROWS rows or more, and more or less often toxic than chance explains."""
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).head()
    share = total["toxic"] / max(total["n"], 1)
    seen = rows.select(F.explode("x.f").alias("f"), "toxic").groupBy("f").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).where(F.col("n") >= MIN_ROWS)
    spread = F.sqrt(F.greatest(F.col("n") * share * (1 - share), F.lit(1e-9)))
    told = np.zeros(BUCKETS, bool)
    for r in seen.where(F.abs(F.col("t") - F.col("n") * share) >= MIN_DEVIATION * spread).select("f").collect():  # at most BUCKETS
        told[r["f"]] = True
    return told


Counted = tuple[np.ndarray, np.ndarray]


def fit(rows: list[tuple[Counted, Counted | None, int]], epochs: int = 8, l1: float = 0.5, alpha: float = 0.3, penalty: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """(weights, bias) by follow-the-regularised-leader on the log loss plus penalty * (score - swapped score)**2.

    rows: (buckets and counts, those after the swap or None, label). Both labels weigh the same.
    """
    z, n = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    bias_z, bias_n, beta = 0.0, 1e-8, 1.0
    share = {v: sum(r[2] == v for r in rows) for v in (0, 1)}
    gain = {v: len(rows) / (2 * c) if c else 1.0 for v, c in share.items()}
    data = [(*x, s, y) for x, s, y in rows]
    rng = np.random.default_rng(5)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + 1e-3)
        return np.where(np.abs(z[i]) <= l1, 0.0, w)

    def learn(i, g):
        sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
        z[i] += g - sigma * weights(i)
        n[i] += g * g

    def sigmoid(v):
        return 1 / (1 + np.exp(-np.clip(v, -30, 30)))

    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            i, x, swap, y = data[k]
            bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
            p = sigmoid(bias + weights(i) @ x)
            g = gain[y] * (p - y)
            extra = 0.0
            if swap is not None:
                j, u = swap
                q = sigmoid(bias + weights(j) @ u)
                extra = 2 * penalty * (p - q)
                both = extra * p * (1 - p), -extra * q * (1 - q)
                learn(j, both[1] * u)
                g += both[0]
                extra = both[1]
            learn(i, g * x)
            gb = g + extra
            bias_z += gb - (np.sqrt(bias_n + gb * gb) - np.sqrt(bias_n)) / alpha * bias
            bias_n += gb * gb
    every = np.arange(BUCKETS)
    return weights(every), float(-bias_z / ((beta + np.sqrt(bias_n)) / alpha))


class WordScores(dict):
    """raw word -> summed weight of its features (0 for a word that has been counted in another spelling is the caller's)."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, raw: str) -> tuple[str, float]:
        if len(self) >= _MEMO:
            self.clear()
        word = _core(raw)
        value = (word, float(self.weights[_features(word)].sum()) if word else 0.0)
        if len(raw) <= 64:
            self[raw] = value
        return value

    def total(self, text: str) -> float:
        # Summed in the words' order, so that equal texts get equal scores anywhere.
        return sum(v for _, v in sorted({self[raw] for raw in set(text.split())}) if v)


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


_COUNTED = "struct<f:array<int>,n:array<int>>"


def _featured(batches: Iterator[pa.RecordBatch]):
    kind = pa.struct([("f", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])
    for batch in pieces_of(batches):
        xs, ss = [], []
        for text in batch.column(1).to_pylist():
            swap = swapped(text)
            xs.append(dict(zip("fn", map(np.ndarray.tolist, document_features(text)), strict=True)))
            ss.append(None if swap is None else dict(zip("fn", map(np.ndarray.tolist, document_features(swap)), strict=True)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(xs, kind), pa.array(ss, kind), batch.column(2)], ["doc_id", "x", "s", "toxic"])


def _restricted(told):
    """Rows with the telling features alone: what is sent to the driver does not grow with the texts."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            columns = [batch.column(0)]
            for name in ("x", "s"):
                out = []
                for x in batch.column(name).to_pylist():
                    if x is not None:
                        f, n = np.array(x["f"], np.int64), np.array(x["n"], np.int64)
                        keep = told.value[f]
                        x = {"f": f[keep].tolist(), "n": n[keep].tolist()}
                    out.append(x)
                columns.append(pa.array(out, batch.column(name).type))
            yield pa.RecordBatch.from_arrays([*columns, batch.column(3)], ["doc_id", "x", "s", "toxic"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    The classifier is fitted on labelled documents outside the held-out fold, at most `sample` of each label. Sentences
    with identity terms count with and without a swap of the terms. Null texts are empty and get the bias alone; a null
    id is in no fold's remainder (held_out is false) and has no label; ids with labels of both kinds are left out of the
    fit, repeated rows count once there and are scored each; without any labels all scores are 0.5; other columns are
    ignored.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").where(~held_out()).select("doc_id", "toxic")
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)

    picked = docs.select("doc_id", whole().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most 2 * sample rows
    rows = picked.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_featured, f"doc_id long, x {_COUNTED}, s {_COUNTED}, toxic int")
    # Of several rows of an id one, whichever way they are dealt.
    rows = stored(rows.groupBy("doc_id").agg(F.min(F.struct("x", "s", "toxic")).alias("r")).select("doc_id", "r.*"), "toxicity-rows")
    told = spark.sparkContext.broadcast(telling(rows))
    got = rows.mapInArrow(_restricted(told), rows.schema).orderBy("doc_id").collect()
    pair = lambda x: None if x is None else (np.array(x["f"], np.int64), np.array(x["n"], np.float64))
    weights, bias = fit([(pair(r["x"]), pair(r["s"]), r["toxic"]) for r in got]) if got else (np.zeros(BUCKETS), 0.0)
    model = spark.sparkContext.broadcast((weights.astype(np.float32), bias))

    def score(batches: Iterator[pa.RecordBatch]):
        scores = WordScores(model.value[0])
        for batch in pieces_of(batches):
            raw = np.array([model.value[1] + scores.total(t) for t in batch.column(2).to_pylist()], float)
            p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    d = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), whole().alias("text"))
    return d.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
