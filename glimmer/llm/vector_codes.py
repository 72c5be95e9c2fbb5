"""Product codes of vectors by ball k-means: radii find neighbours, stable cores stay, rings bound the candidates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import discard, sized, stored, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Scaled components beyond it count as it, so that squared distances of whole vectors stay exact in 64 bits.
MOST = 1 << 26
_SUMS = "part int, entry int, item int, value long"
_KIND = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("q", pa.list_(pa.int32())), ("code", pa.binary()), ("error", pa.int64()), ("part", pa.int32()), ("entry", pa.int32()), ("item", pa.int32()), ("value", pa.int64())])
_TABLE = f"vec_id long, label string, q array<int>, code binary, error long, {_SUMS}"


@dataclass
class Balls:
    """One part position's codebook and what is known of its balls."""

    entries: np.ndarray
    #: No part of an entry's ball lies further from it (infinite before the first round).
    radius: np.ndarray
    moved: np.ndarray

    def neighbours(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(the entries that a part of ball i may belong to, nearest first; the squared distances to i).

        A part at distance d from i is nearer to j, or as near, only if j is within 2 d of i.
        """
        gaps = ((self.entries - self.entries[i]) ** 2).sum(1)
        near = np.flatnonzero((gaps <= 4 * (self.radius[i] * (1 + 1e-9) + 1) ** 2) & (np.arange(len(gaps)) != i))
        near = near[np.argsort(gaps[near], kind="stable")]
        return near, gaps[near]

    def assign(self, x: np.ndarray, ball: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entries, squared distances) of parts x that were in `ball` before; ties go to the lower index."""
        code, error = ball.copy(), np.zeros(len(x), np.int64)
        for i in range(len(self.entries)):
            rows = np.flatnonzero(ball == i)
            if not len(rows):
                continue
            best = ((x[rows] - self.entries[i]) ** 2).sum(1)
            error[rows] = best
            near, gaps = self.neighbours(i)
            if not (self.moved[i] or self.moved[near].any()):  # nothing that could take a part of this ball has moved
                continue
            # In ring k a part has k candidates; in ring 0, the stable core, none.
            ring = np.searchsorted(-(-gaps // 4), best, "right")
            own = np.full(len(rows), i)
            for k, j in enumerate(near.tolist()):
                at = np.flatnonzero(ring > k)
                if not len(at):
                    break
                d = ((x[rows[at]] - self.entries[j]) ** 2).sum(1)
                better = (d < best[at]) | ((d == best[at]) & (j < own[at]))
                best[at[better]], own[at[better]] = d[better], j
            code[rows], error[rows] = own, best
        return code, error

    def updated(self, sums: dict[tuple[int, int], int], width: int) -> Balls:
        """The codebook of means rounded down; sums: (entry, item) -> value, items being components, count and farthest."""
        entries, far = self.entries.copy(), np.zeros(len(self.entries))
        for i in range(len(entries)):
            if n := sums.get((i, width), 0):
                entries[i] = [sums[i, k] // n for k in range(width)]
                far[i] = np.sqrt(float(sums[i, width + 1]))
        step = np.sqrt(((entries - self.entries) ** 2).sum(1).astype(float))
        return Balls(entries, far + step, step > 0)


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """(rows, PARTS, width) of a batch's vectors, short ones continued by zeros."""
    q = batch.column("q")
    flat, ends = q.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(q.offsets.to_numpy())
    if len(flat) != batch.num_rows * PARTS * width:
        full = np.zeros((batch.num_rows, PARTS * width), np.int64)
        full[np.arange(PARTS * width) < ends[:, None]] = flat
        flat = full
    return flat.reshape(batch.num_rows, PARTS, width)


def _assigned(model, width: int, last: bool):
    """The rows with new codes, and at the end of a task its sums: components, count and farthest distance by entry."""

    def run(batches: Iterator[pa.RecordBatch]):
        balls: list[Balls] = model.value
        n_entries = len(balls[0].entries)
        sums = np.zeros((PARTS, n_entries, width + 1), np.int64)
        far = np.zeros((PARTS, n_entries), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _rows(batch, width)
            before = batch.column("code")
            code = np.frombuffer(b"".join(before.to_pylist()), np.uint8).reshape(n, PARTS).astype(np.int64) if not before.null_count else np.zeros((n, PARTS), np.int64)
            error = np.zeros(n, np.int64)
            for p in range(PARTS):
                code[:, p], own = balls[p].assign(x[:, p], code[:, p])
                error += own
                np.add.at(sums[p, :, :width], code[:, p], x[:, p])
                sums[p, :, width] += np.bincount(code[:, p], minlength=n_entries)
                np.maximum.at(far[p], code[:, p], own)
            codes = pa.array([r.tobytes() for r in code.astype(np.uint8)], pa.binary())
            q = pa.nulls(n, _KIND.field("q").type) if last else batch.column("q")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), q, codes, pa.array(error), *(pa.nulls(n, _KIND.field(k).type) for k in ("part", "entry", "item", "value"))], schema=_KIND)
        if not last:
            values = np.concatenate([sums, far[:, :, None]], 2)
            part, entry, item = np.nonzero(np.broadcast_to(sums[:, :, width:] > 0, values.shape))
            out = [*(pa.nulls(len(part), _KIND.field(k).type) for k in ("vec_id", "label", "q", "code", "error")), pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(item.astype(np.int32)), pa.array(values[part, entry, item])]
            yield pa.RecordBatch.from_arrays(out, schema=_KIND)

    return run


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error), the final codebooks): code is a byte a part, error the summed squared distances.

    Components are scaled and rounded down, vectors cut into PARTS parts, and each part position has a codebook of the
    parts of the smallest vec_ids (null ids last, equal ids in the vectors' order), refined by `rounds` rounds of
    k-means and rounded means. All of it is in whole numbers, so the result is exact and the same for any order of
    rows. A round reads the table of the round before, with the codes, and writes the next with its tasks' sums; then
    the older one is deleted. What comes to the driver is the codebooks and their sums, which no input makes larger.

    Rows whose vector is null or has null or non-finite components are dropped. Vectors shorter than the longest, or of
    a length that PARTS does not divide, are continued by zeros; scaled components beyond MOST count as MOST. Repeated
    rows are coded each, an empty table gives no rows and empty codebooks, other columns are ignored.
    """
    spark = vectors.sparkSession
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    scaled = F.transform(x, lambda v: F.least(F.greatest(F.floor(v.cast("double") * SCALE), F.lit(-MOST)), F.lit(MOST)).cast("int"))
    kept = vectors.where(x.isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), scaled.alias("q"), F.lit(None).cast("binary").alias("code"))
    path = written(kept, "vectors")
    table = spark.read.schema(kept.schema).parquet(path)
    longest = table.agg(F.max(F.size("q"))).head()[0] or 0
    width = -(-longest // PARTS)
    first = table.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    start = np.zeros((len(first), PARTS * width), np.int64)
    for i, r in enumerate(first):
        start[i, : len(r["q"])] = r["q"]
    start = start.reshape(len(first), PARTS, width)
    balls = [Balls(start[:, p], np.full(len(first), np.inf), np.ones(len(first), bool)) for p in range(PARTS)]
    for k in range(rounds + 1):
        last = k == rounds
        new = written(table.mapInArrow(_assigned(spark.sparkContext.broadcast(balls), width, last), _TABLE), "vector-codes")
        discard(spark, path)
        path, every = new, spark.read.schema(_TABLE).parquet(new)
        table = every.where("part is null").select("vec_id", "label", "q", "code", "error")
        if not last:
            total = every.where("part is not null").groupBy("part", "entry", "item").agg(F.when(F.col("item") > width, F.max("value")).otherwise(F.sum("value")).alias("value")).collect()  # PARTS * entries * (width + 2)
            sums = [{(r["entry"], r["item"]): r["value"] for r in total if r["part"] == p} for p in range(PARTS)]
            balls = [b.updated(s, width) for b, s in zip(balls, sums, strict=True)]
    return table.select("vec_id", "label", "code", "error"), [b.entries for b in balls]


def coded(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): the codes in hex, with the error of all rows of the label.

    Edge cases as in vector_codes; null labels are one label.
    """
    codes, books = vector_codes(vectors)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    by_label = sized(stored(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors"))
    # A row a label: broadcast if measured small, else joined with skewed labels split.
    found = codes.alias("a").join(by_label.alias("b"), F.col("a.label").eqNullSafe(F.col("b.label")))
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
