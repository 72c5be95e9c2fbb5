"""Substring dedup: chunks cut by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import pieces_of, stored, whole

#: A cut falls where BITS bits of the gear hash of the last WINDOW bytes are 0: chunks have MIN + 2**BITS bytes on average.
BITS = 4
WINDOW = 16
MIN_CHUNK = 8
MAX_CHUNK = 1024
#: Repeated chunks go only in runs of so many bytes: less than is left of a passage of 50 words between its first and last cut.
MIN_RUN = 96
_GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)
_SPAN = 1 << 22
#: Digests are compared in so many parts, one after another, so that only a part of the chunks is shuffled at once.
SLICES = 4


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear[data[i - j]] << j over the last WINDOW bytes, modulo 2**32, by doubling the span."""
    h = _GEAR[data]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def _quiet_cut(data: bytes, last: int) -> int:
    """The end of a chunk from `last` where the hash never asks for a cut: after the last byte of the smallest hash within MAX_CHUNK.

    In text that repeats itself, like one word over and over, the hashes repeat too, so cuts fall at the same point of each
    repetition wherever the text began.
    """
    least = last + MIN_CHUNK - 1
    b = max(0, least - WINDOW + 1)
    h = gear_hashes(np.frombuffer(data[b : last + MAX_CHUNK], np.uint8))[least - b :]
    return last + MAX_CHUNK - int(np.argmin(h[::-1]))


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data: content decides, so bytes put in before a passage move its cuts along."""
    n, ends, last = len(data), [], 0
    mask = np.uint32((1 << BITS) - 1) << np.uint32(WINDOW - BITS)  # the highest bits that all bytes of the window reach from below
    for a in range(0, n, _SPAN):  # the bytes before the span give it its hashes
        b = max(0, a - WINDOW + 1)
        at = np.flatnonzero((gear_hashes(np.frombuffer(data[b : a + _SPAN], np.uint8)) & mask) == 0) + b
        for i in at[at >= a].tolist():
            end = i + 1
            if end - last < MIN_CHUNK:
                continue
            while end - last > MAX_CHUNK:
                last = _quiet_cut(data, last)
                ends.append(last)
            if end - last >= MIN_CHUNK:
                ends.append(end)
                last = end
    while n - last > MAX_CHUNK:
        last = _quiet_cut(data, last)
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def _chunk_rows(batches: Iterator[pa.RecordBatch]):
    import xxhash

    digest = xxhash.xxh3_128_intdigest
    for batch in pieces_of(batches):
        keys, ids, highs, lows, starts, lengths = [], [], [], [], [], []
        for doc, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = text.encode()
            last = 0
            for end in cuts(data):
                d = digest(data[last:end])
                keys.append(key)
                ids.append(doc)
                highs.append((d >> 64) - (1 << 63))
                lows.append((d & ((1 << 64) - 1)) - (1 << 63))
                starts.append(last)
                lengths.append(end - last)
                last = end
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(highs, pa.int64()), pa.array(lows, pa.int64()), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32())], ["doc_id", "k", "high", "low", "start", "length"])


def _row_key():
    return F.xxhash64("doc_id", whole())


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, k, parts): per document the places (start, length) of its chunks that an earlier chunk equals.

    A chunk is a repeat if an equal one (by 128-bit digest) stands in a document of smaller id, or earlier in its own.
    k tells the texts of one id apart.
    """
    chunks = docs.select("doc_id", _row_key().alias("k"), whole().alias("text")).mapInArrow(_chunk_rows, "doc_id long, k long, high long, low long, start int, length int")
    chunks = stored(chunks, "chunks")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k", "start")
    found = []
    for i in range(SLICES):
        some = chunks.where(F.pmod("low", F.lit(SLICES)) == i)
        first = stored(some.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("high", "low", "first"), "chunk-repeats")
        found.append(stored(some.join(first, ["high", "low"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "k", "start", "length"), "chunk-later"))
    later = reduce(DataFrame.union, found)
    return later.groupBy("doc_id", "k").agg(F.collect_set(F.struct("start", "length")).alias("parts"))


def runs_of(parts: list[dict] | None, min_run: int = MIN_RUN) -> list[tuple[int, int]]:
    """(start, length) of the runs that touching parts make, if of min_run bytes or more."""
    runs: list[tuple[int, int]] = []
    for start, length in sorted((p["start"], p["length"]) for p in parts or ()):
        if runs and sum(runs[-1]) == start:
            runs[-1] = (runs[-1][0], runs[-1][1] + length)
        else:
            runs.append((start, length))
    return [r for r in runs if r[1] >= min_run]


def cut_out(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """data without the spans; a character is kept or goes as a whole, with the span that its first byte is in."""
    kept, last = [], 0

    def edge(i: int) -> int:
        while 0 < i < len(data) and data[i] & 0xC0 == 0x80:
            i += 1
        return i

    for start, length in spans:
        kept.append(data[last : edge(start)])
        last = edge(start + length)
    kept.append(data[last:])
    return b"".join(kept)


def _with_parts(docs: DataFrame) -> DataFrame:
    """(row, parts): the rows of docs as structs, so that no column of theirs clashes with ours, and their repeated chunks."""
    parts = stored(repeated_chunks(docs).withColumnsRenamed({"doc_id": "id2", "k": "k2"}), "chunk-parts")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id1"), _row_key().alias("k1"))
    return keyed.join(parts, F.col("k1").eqNullSafe(F.col("k2")) & F.col("id1").eqNullSafe(F.col("id2")), "left").select("row", "parts")


def _digests(min_run: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in pieces_of(batches):
            rows = []
            for doc, text, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, spans = text.encode(), runs_of(parts, min_run)
                kept = cut_out(data, spans)
                rows.append((doc, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "length": n} for a, n in spans]))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def substring_dedup(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row of docs.

    Repeats side by side make a run, and runs of min_run bytes or more are removed. Texts are UTF-8 bytes, a null text
    being empty. A chunk stays where it stands first, by id and place; documents without an id come last. Rows with the
    same id and text are one document and get the same result each. Empty texts lose nothing, an empty table gives an
    empty result, other columns are ignored.
    """
    d = _with_parts(docs.select("doc_id", "text"))
    return d.select("row.doc_id", whole("row.text").alias("text"), "parts").mapInArrow(_digests(min_run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,length:int>>")


def without_repeats(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """docs with the repeated runs cut out of their texts; n_chars follows the text, documents left empty stay.

    Every row and column comes back. A null text is empty then; a null id comes last in the order of first places;
    rows with the same id and text lose the same; an empty table gives an empty one.
    """

    def kept(batches: Iterator[pa.RecordBatch]):
        for batch in pieces_of(batches):
            at = batch.schema.get_field_index("text")
            spans = [runs_of(p, min_run) for p in batch.column(batch.num_columns - 1).to_pylist()]
            texts = [t if not s else cut_out(t.encode(), s).decode() for t, s in zip(batch.column(at).to_pylist(), spans, strict=True)]
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, docs_columns)

    docs_columns = docs.columns
    parts = F.col("parts").alias("_" + "_".join(docs_columns))  # the last column, of a name that docs cannot have
    out = _with_parts(docs).select("row.*", parts).mapInArrow(kept, docs.schema)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
