"""Suffix dedup: every byte of a 200-byte string that starts elsewhere too, by sampled suffixes.

The scheme of the difference-cover construction, with a sample that content chooses. A difference cover makes any two
suffixes meet in a sampled position at the same distance; the residues 1 and 2 modulo 3 do so, but keep two thirds of all
suffixes, and sorting those as rows moves some thirty times the input. Only common prefixes of 200 bytes matter here, so
the sample may be thinner: in each 200-byte string, the place of the smallest hash of 80 bytes. Equal strings have it at
the same distance, and about one position in sixty is in the sample.

1. Sample: each sampled position stands for the strings it is the smallest place of, and is named by its 80 bytes.
2. Sort by name: suffixes are dealt and sorted by name, then by the digest of all the bytes that they stand for. Equal
   neighbours repeat as a whole; a name alone repeats nowhere. Neither goes further.
3. Merge what remains, a suffix that is not sampled being the bytes before a sampled one and its name: within a name,
   the strings around the sampled position are compared, and those that have an equal neighbour are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import pieces_of, sized, stored, whole

LENGTH = 200
NAME = 80
_WIDTH = LENGTH - NAME + 1
#: A name with more different contexts than a task should hold is compared string by string, which Spark spreads over tasks.
LARGE = 20_000
_P = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPAN = 1 << 22


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` bytes at each position, from those of powers of two."""
    h, width = _BYTES[data], 1
    out, done = None, 0
    while True:
        if length & width:
            if out is None:
                out = h
            else:  # out covers the first `done` bytes, h the next `width`
                n = len(data) - done - width + 1
                out = out[:n] * np.uint64(pow(_P, width, 2**64)) + h[done : done + n]
            done += width
        if done == length:
            return _mixed(out[: max(len(data) - length + 1, 0)])
        n = len(h) - width
        h = h[:n] * np.uint64(pow(_P, width, 2**64)) + h[width:]
        width *= 2


def sampled(data: bytes, base: int = 0) -> list[tuple[int, int, int, int]]:
    """(name, at, first, last): the sampled position and the strings, by their starts, that it stands for."""
    n = len(data)
    if n < LENGTH:
        return []
    named = string_hashes(np.frombuffer(data, np.uint8), NAME)
    low = (named & ~np.uint64((1 << 24) - 1)) | np.arange(len(named), dtype=np.uint64)
    width = 1
    while 2 * width <= _WIDTH:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < _WIDTH:
        low = np.minimum(low[: len(low) - (_WIDTH - width)], low[_WIDTH - width :])
    at = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    last = np.append(first[1:], len(at)) - 1
    at = at[first]
    return list(zip(named[at].view(np.int64).tolist(), (at + base).tolist(), (first + base).tolist(), (last + base).tolist(), strict=True))


_SAMPLE = "doc_id long, k long, name long, high long, low long, first int, n int, times int"


def _sample(batches: Iterator[pa.RecordBatch]):
    """A row for each different context of a text; times: 2 if it is there more often (its other places come as times 0: they repeat for sure and need no sorting)."""
    import xxhash

    digest = xxhash.xxh3_128_intdigest
    for batch in pieces_of(batches):
        rows: list[tuple] = []
        for doc, k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = text.encode()
            seen: dict[tuple[int, int], int] = {}
            for a in range(0, max(len(data) - LENGTH + 1, 0), _SPAN):
                for name, at, first, last in sampled(data[a : a + _SPAN + LENGTH - 1], a):
                    d = digest(data[first : last + LENGTH], at - first)
                    if (name, d) in seen:
                        old = rows[seen[name, d]]
                        rows[seen[name, d]] = (*old[:7], 2)
                        times = 0
                    else:
                        seen[name, d] = len(rows)
                        times = 1
                    rows.append((doc, k, name, (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63), first, last - first + 1, times))
        yield _batch(rows, [("doc_id", pa.int64()), ("k", pa.int64()), ("name", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("times", pa.int32())])


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


_CONTEXT = "doc_id long, k long, name long, first int, n int, open boolean, part int, string_hash long, context binary"


def _contexts(batches: Iterator[pa.RecordBatch]):
    """The bytes around sampled positions; for large names a row for each string instead (part: its place)."""
    fields = [("doc_id", pa.int64()), ("k", pa.int64()), ("name", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("open", pa.bool_()), ("part", pa.int32()), ("string_hash", pa.int64()), ("context", pa.binary())]
    for batch in pieces_of(batches):
        rows: list[tuple] = []
        held = 0
        for doc, k, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = text.encode()
            for w in wanted:
                context = data[w["first"] : w["first"] + w["n"] + LENGTH - 1]
                head = (doc, k, w["name"], w["first"], w["n"], w["open"])
                if w["large"]:
                    hashes = string_hashes(np.frombuffer(context, np.uint8), LENGTH).view(np.int64).tolist()
                    rows += [(*head, i, x, None) for i, x in enumerate(hashes)]
                else:
                    rows.append((*head, -1, 0, context))
                held += len(context)
                if held > 1 << 22 or len(rows) > 20_000:
                    yield _batch(rows, fields)
                    rows, held = [], 0
        yield _batch(rows, fields)


def _compare(batches: Iterator[pa.RecordBatch]):
    """Contexts sorted by name in, spans of the repeated strings of the open ones out."""
    carry: list[dict] = []

    def judged(rows: list[dict]) -> pa.RecordBatch:
        out: list[tuple] = []
        if rows:
            hashes = string_hashes(np.frombuffer(b"".join(r["context"] for r in rows), np.uint8), LENGTH)
            offsets = np.concatenate([[0], np.cumsum([len(r["context"]) for r in rows])])[:-1]
            counts = np.array([r["n"] for r in rows])
            at = np.repeat(offsets - np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + np.arange(counts.sum())
            names = np.repeat(np.array([r["name"] for r in rows], np.int64).view(np.uint64), counts)
            _, place, often = np.unique(_mixed(hashes[at] + names * np.uint64(_P)), return_inverse=True, return_counts=True)
            twice = np.split(often[place] > 1, np.cumsum(counts)[:-1])
            for r, t in zip(rows, twice, strict=True):
                if r["open"] and t.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], t.view(np.int8), [0]])))
                    out += [(r["doc_id"], r["k"], r["first"] + a, b - a - 1 + LENGTH) for a, b in edge.reshape(-1, 2).tolist()]
        return _batch(out, [("doc_id", pa.int64()), ("k", pa.int64()), ("start", pa.int32()), ("length", pa.int32())])

    for batch in batches:
        carry += batch.to_pylist()
        end = len(carry)
        while end and carry[end - 1]["name"] == carry[-1]["name"]:  # the last name may go on
            end -= 1
        if end:
            yield from map(judged, _whole_names(carry[:end]))
            carry = carry[end:]
    yield from map(judged, _whole_names(carry))


def _whole_names(rows: list[dict], about: int = 4000) -> Iterator[list[dict]]:
    start = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or (i - start >= about and rows[i]["name"] != rows[i - 1]["name"]):
            yield rows[start:i]
            start = i


def _row_key():
    return F.xxhash64("doc_id", whole())


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, k, start, length): spans that cover the bytes of each 200-byte string found elsewhere too.

    k tells the texts of an id apart. Of equal texts only the first takes part; its copies are told by copied_texts.
    """
    keyed = docs.select("doc_id", _row_key().alias("k"), F.md5(whole()).alias("th"), whole().alias("text")).where(F.octet_length("text") >= LENGTH)
    copied = copied_texts(docs).select("th", "first_id")
    # A row of a copied text takes part if it has the text's first id.
    once = keyed.join(sized(copied), "th", "left").where(F.col("first_id").isNull() | F.col("doc_id").eqNullSafe(F.col("first_id")))
    sample = stored(once.select("doc_id", "k", "text").mapInArrow(_sample, _SAMPLE), "repeats-sample")

    # Names that come once go no further. Those that come again are few, and of these, equal contexts are added up before
    # anything is told of a name, so that a passage of many documents is few rows.
    places = sample.where("times > 0")
    names = stored(places.groupBy("name").agg(F.sum("times").alias("all")).where(F.col("all") > 1).select("name"), "repeats-names")
    places = stored(places.join(names, "name"), "repeats-places")
    first = F.struct((-F.col("times")).alias("order"), "doc_id", "k", "first", "n")
    equal = stored(places.groupBy("name", "high", "low").agg(F.sum("times").alias("all"), F.min(first).alias("at")), "repeats-equal")
    again = places.join(equal.where(F.col("all") > 1).select("name", "high", "low"), ["name", "high", "low"]).select("doc_id", "k", "first", "n")
    several = stored(equal.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name"), "repeats-several")
    compare = stored(equal.join(several, "name").select("at.doc_id", "at.k", "name", "at.first", "at.n", (F.col("all") > 1).alias("again")), "repeats-compare")
    large = compare.groupBy("name").agg(F.count("*").alias("c")).where(F.col("c") > LARGE).select("name", F.lit(True).alias("large"))
    compare = compare.join(large, "name", "left").select("doc_id", "k", F.struct("name", "first", "n", (~F.col("again")).alias("open"), F.coalesce("large", F.lit(False)).alias("large")).alias("w"))
    wanted = stored(compare.groupBy("doc_id", "k").agg(F.collect_list("w").alias("wanted")).withColumnsRenamed({"doc_id": "_id", "k": "_k"}), "repeats-wanted")
    texts = keyed.join(wanted, keyed["k"].eqNullSafe(F.col("_k")) & keyed["doc_id"].eqNullSafe(F.col("_id")))
    # Rows repeated whole meet as copies: one of them is enough here, and more do no harm but work.
    around = stored(texts.select("doc_id", "k", "text", "wanted").mapInArrow(_contexts, _CONTEXT), "repeats-contexts")
    spans = "doc_id long, k long, start int, length int"
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = around.where("part < 0").select("doc_id", "k", "name", "first", "n", "open", "context").repartition(parts, "name").sortWithinPartitions("name").mapInArrow(_compare, spans)
    strings = around.where("part >= 0")
    far = strings.join(strings.groupBy("name", "string_hash").agg(F.count("*").alias("c")).where("c > 1"), ["name", "string_hash"]).where("open").select("doc_id", "k", (F.col("first") + F.col("part")).cast("int").alias("start"), F.lit(LENGTH).alias("length"))
    sure = again.unionByName(sample.where("times = 0").select("doc_id", "k", "first", "n"))
    return sure.select("doc_id", "k", F.col("first").alias("start"), (F.col("n") + LENGTH - 1).cast("int").alias("length")).unionByName(near).unionByName(far)


def copied_texts(docs: DataFrame) -> DataFrame:
    """(th, first_id) of the texts of 200 bytes or more that several rows have; th is the MD5."""
    rows = docs.select("doc_id", F.md5(whole()).alias("th"), F.octet_length(whole()).alias("size"))
    found = rows.where(F.col("size") >= LENGTH).groupBy("th").agg(F.count("*").alias("c"), F.min("doc_id").alias("first_id"))
    return stored(found.where("c > 1").select("th", "first_id"), "repeats-copies")


def _digests(batches: Iterator[pa.RecordBatch]):
    for batch in pieces_of(batches):
        rows = []
        for doc, text, copied, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = text.encode()
            runs: list[list[int]] = []
            for start, length in sorted((s["start"], s["length"]) for s in spans or ()) if not copied else [(0, len(data))]:
                if runs and start <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], start + length)
                else:
                    runs.append([start, start + length])
            kept, last = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(data[last:a])
                last = b
            kept.update(data[last:])
            rows.append((doc, len(data), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
        yield _batch(rows, [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs.

    A byte goes if a 200-byte string over it starts anywhere else too, in this document or another; overlapping places
    count, and the input's strings are what counts. Texts are UTF-8, a null text is empty; texts under 200 bytes keep
    everything. Rows repeated whole are documents of their own, so all of their bytes go; null ids stay, an empty table
    gives an empty result, other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    spans = repeated_spans(docs).groupBy("doc_id", "k").agg(F.collect_list(F.struct("start", "length")).alias("spans")).withColumnsRenamed({"doc_id": "_id", "k": "_k"})
    spans = stored(spans, "repeats-spans")
    keyed = docs.select("doc_id", _row_key().alias("k"), F.md5(whole()).alias("th"), whole().alias("text"))
    marked = keyed.join(sized(copied_texts(docs).select("th", F.lit(True).alias("copied"))), "th", "left")
    marked = marked.join(spans, marked["k"].eqNullSafe(F.col("_k")) & marked["doc_id"].eqNullSafe(F.col("_id")), "left")
    return marked.select("doc_id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "spans").mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
