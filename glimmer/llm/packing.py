"""Packing by non-negative least squares over the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import pieces_of, stored, whole
from glimmer.llm.tokens import word_ids

WINDOW = 4096
END_ID = 2
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def _cut(path: str, end_id: int, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches):
        ids_of, part, seen = word_ids(path), TaskContext.get().partitionId(), defaultdict(int)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in pieces_of(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of.of(text) + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    rows.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, part, seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.int32(), pa.int64()], strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])

    return cut


def combinations(histogram: np.ndarray, window: int, common: int = 48) -> list[tuple[tuple[int, int], ...]]:
    """Shallow combinations ((length, copies), ...) that fill the window to the last token.

    k copies of a length and one piece of what is left; and for the commonest lengths a third length between them.
    """
    present = np.flatnonzero(histogram)
    found = set()
    most = present[np.argsort(-histogram[present], kind="stable")][:common]

    def fill(parts: dict[int, int], rest: int) -> None:
        if rest == 0 or (0 < rest and histogram[rest]):
            parts = dict(parts)
            if rest:
                parts[rest] = parts.get(rest, 0) + 1
            found.add(tuple(sorted(parts.items(), reverse=True)))

    for a in present.tolist():
        for k in range(1, window // a + 1):
            fill({a: k}, window - k * a)
        for b in most.tolist():
            if a != b and a + b < window:
                fill({a: 1, b: 1}, window - a - b)
    return sorted(found)


def non_negative_least_squares(columns: list[tuple[tuple[int, int], ...]], target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that makes the sum of x times each column's copies close to target, by accelerated projected gradient."""
    if not columns:
        return np.zeros(0)
    col = np.concatenate([np.full(len(c), j) for j, c in enumerate(columns)])
    row = np.array([n for c in columns for n, _ in c])
    val = np.array([k for c in columns for _, k in c], float)
    # Columns of unit norm: a combination of many copies takes steps like one of few.
    norm = np.sqrt(np.bincount(col, val * val, len(columns)))
    val = val / norm[col]
    gram_bound = np.max(np.bincount(col, val * np.bincount(row, val, len(target))[row], len(columns)))
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        residual = np.bincount(row, val * y[col], len(target)) - target
        new = np.maximum(0, y - np.bincount(col, val * residual[row], len(columns)) / gram_bound)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (before - 1) / t * (new - x)
    return x / norm


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(combination, repeats)] that uses every piece of the histogram exactly once.

    Non-negative least squares gives repeats of combinations without padding; they are rounded down to what is there.
    The pieces left are packed greedily, the longest first and then always the longest that still fits. The histogram
    and so the plan are bounded by the window, whatever the input.
    """
    left = histogram.astype(np.int64).copy()
    made = []
    columns = combinations(left, window)
    repeats = non_negative_least_squares(columns, left.astype(float))
    for j in np.argsort(-repeats, kind="stable").tolist():
        n = min([int(round(repeats[j])), *(int(left[a]) // k for a, k in columns[j])])
        if n > 0:
            made.append((columns[j], n))
            for a, k in columns[j]:
                left[a] -= n * k
    there = np.flatnonzero(left)
    while len(there):
        parts, rest, top = [], window, len(there)
        while rest and top:
            top = int(np.searchsorted(there[:top], rest, "right"))
            if top:
                a = int(there[top - 1])
                k = min(int(left[a]), rest // a)
                parts.append((a, k))
                rest -= a * k
                top -= 1
        n = min(int(left[a]) // k for a, k in parts)
        made.append((tuple(parts), n))
        for a, k in parts:
            left[a] -= n * k
        there = there[left[there] > 0]
    return made


def _slots(made: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> arrays over the combinations that use it: first rank, copies, first sequence, offset of the first copy."""
    rows, ranks, sequence = defaultdict(list), defaultdict(int), 0
    for parts, n in made:
        offset = 0
        for a, k in parts:
            rows[a].append((ranks[a], k, sequence, offset))
            ranks[a] += n * k
            offset += a * k
        sequence += n
    return {a: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for a, r in rows.items()}


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of the documents, each with its sequence and offset there.

    tokenizer: the path of a tokenizers file that drops white space. A document's ids end with end_id; documents of over
    `window` ids are cut into whole windows and a rest. Null texts are empty (one end id), null ids stay null, repeated
    rows are packed each, an empty table gives no pieces; other columns are ignored.
    """
    spark = docs.sparkSession
    cut = docs.select("doc_id", whole().alias("text")).mapInArrow(_cut(tokenizer, end_id, window), _PIECES)
    pieces = stored(cut, "packing-pieces")
    counts = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        histogram[r["length"]] = r["n"]
    slots = spark.sparkContext.broadcast(_slots(plan(histogram, window)))
    # Before a task's pieces of a length stand those of the tasks before it.
    before = counts.selectExpr("part", "length", "sum(n) over (partition by length order by part) - n as before")

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, copies, base, at = slots.value[int(length[rows[0]])]
                j = np.searchsorted(first, rank[rows], "right") - 1
                nth = rank[rows] - first[j]
                sequence[rows] = base[j] + nth // copies[j]
                offset[rows] = at[j] + nth % copies[j] * length[rows]
            out = [batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = pieces.join(before, ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
