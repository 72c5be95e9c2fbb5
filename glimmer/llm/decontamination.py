"""Benchmark decontamination: pigeonhole pieces found exactly, then bit-parallel edit distance."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import pieces_of, sized, stored, whole

#: Edits allowed, as a share of the item's characters.
MAX_EDITS = 0.08
#: Characters of items whose pieces are searched for in one pass; larger benchmarks take several.
BLOCK_CHARS = 8_000_000
_FOUND = "_rid long, doc_id long, item_id long, distance int, first_char long, last_char long"


def normal(text: str) -> str:
    """Lower case, single spaces."""
    return " ".join(text.lower().split())


def places(pattern: str) -> dict[str, int]:
    """character -> bits of its places in the pattern."""
    masks: dict[str, int] = defaultdict(int)
    for j, c in enumerate(pattern):
        masks[c] |= 1 << j
    return dict(masks)


def best_match(masks: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """(distance, end) of the substring of text that is nearest to a pattern of m characters (Myers 1999); the first of equals.

    anchored: the substring begins where text does. masks: character -> bits of the places where the pattern has it. Python's integers hold any pattern in one word.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, at = m, 0
    get = masks.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(xh | up))
        minus = up & xh
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best, at = score, j
        plus = ((plus << 1) | anchored) & full  # a match may start anywhere: no 1 is carried in
        up = ((minus << 1) & full) | (full & ~(xv | plus))
        down = plus & xv
    return best, at


def _matcher(items: list[tuple[int, str]], max_edits: float):
    """Finds items in a normalised text: yields (item_id, distance, first, last) with the best place of each."""
    import ahocorasick

    patterns, pieces = [], defaultdict(list)  # pieces: text -> [(pattern, end of the piece in it)]
    for item_id, raw in items:
        text = normal(raw)
        if text:
            m = len(text)
            k = int(max_edits * m)
            patterns.append((item_id, text, k, places(text)))
            for j in range(k + 1):  # k edits leave one of k + 1 pieces whole
                a, b = j * m // (k + 1), (j + 1) * m // (k + 1)
                pieces[text[a:b]].append((len(patterns) - 1, b))
    automaton = ahocorasick.Automaton()
    for piece, found in pieces.items():
        automaton.add_word(piece, found)
    if pieces:
        automaton.make_automaton()

    def find(text: str):
        starts = defaultdict(set)
        for end, hits in automaton.iter(text) if pieces else ():
            for p, b in hits:
                starts[p].add(end + 1 - b)
        for p, found in starts.items():
            item_id, pattern, k, masks = patterns[p]
            m, best = len(pattern), None
            for s in found:
                if text.startswith(pattern, max(s, 0)) and s >= 0:
                    best = (0, s, s + m) if best is None else min(best, (0, s, s + m))
            if best is None and k:
                reach = None
                for s in sorted(found):  # windows that overlap are searched as one
                    a, b = max(0, s - k), min(len(text), s + m + k)
                    if reach and a <= reach[1] and b - reach[0] <= 4 * m:
                        reach = (reach[0], b)
                        continue
                    if reach:
                        best = _searched(masks, m, k, text, reach, best)
                    reach = (a, b)
                best = _searched(masks, m, k, text, reach, best)
            if best:
                distance, first, last = best
                if distance:  # run backwards from the end, the match tells its start
                    first = last - best_match(places(pattern[::-1]), m, text[max(0, last - m - k) : last][::-1], anchored=True)[1]
                yield item_id, distance, first, last

    return find


def _searched(masks, m, k, text, reach, best):
    distance, end = best_match(masks, m, text[reach[0] : reach[1]])
    if distance <= k:
        last = reach[0] + end
        found = (distance, max(0, last - m), last)  # the start is found once the best end is known
        return found if best is None else min(best, found)
    return best


def _search(items: list[tuple[int, str]], max_edits: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches):
        find = _matcher(items, max_edits)
        for batch in pieces_of(batches):
            rows = [(rid, doc, *x) for rid, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in find(normal(text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 2)], ["_rid", "doc_id", "item_id", "distance", "first_char", "last_char"])

    return search


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(_rid, doc_id, item_id, distance, first_char, last_char) for each document and item within max_edits of its length.

    Texts are compared lower-cased with single spaces, and places count characters of that form; of places of the same
    distance the first end counts, of starts that reach it the last. An item is looked for in every document, whole: the items are broadcast in
    blocks of bounded size, and every block is searched for over all documents. _rid tells repeated rows apart; rows
    without text (null, empty) match nothing, items without text are no items, null ids are carried, and an empty table
    on either side gives no rows. Other columns are ignored.
    """
    items = benchmark.select("item_id", whole().alias("text"))
    chars = items.agg(F.sum(F.length("text"))).head()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    # A place in the table, so that a repeated row is a row of its own.
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), "doc_id", whole().alias("text"))
    found = None
    for b in range(blocks):
        block = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        part = rows.mapInArrow(_search(block, max_edits), _FOUND)
        found = part if found is None else found.unionByName(part)
    return found


def without_benchmark(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns.

    Null ids are judged by their own text, null and empty texts stay, repeated rows stay or go together, and an empty
    table or benchmark leaves everything as it is.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", whole()).alias("k"))  # no column of theirs clashes with ours
    found = benchmark_matches(rows.select(F.col("k").alias("doc_id"), "row.text"), benchmark, **limits)
    bad = stored(found.select(F.col("doc_id").alias("k")).distinct(), "contaminated")
    return rows.join(sized(bad), "k", "left_anti").select("row.*")
