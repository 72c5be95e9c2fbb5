"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import connected, pieces_of, sized, stored, whole

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
#: n-grams that a block holds, a text counting for LEAST or more: so a task's two blocks are bounded in bytes and in texts.
BLOCK = 1 << 18
LEAST = 1 << 10
_MEMO = 500_000
_P = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows, and then the fewest bands, that find a pair at the threshold with the target recall."""
    for rows in range(most, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold**rows < 1 else 1
        if bands * rows <= most:
            return bands, rows
    return most, 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """raw word -> 64-bit hash of its letters and digits in lower case, 0 if there are none."""

    def __missing__(self, raw: str) -> int:
        import xxhash

        if len(self) >= _MEMO:
            self.clear()
        word = re.sub(r"\W+", "", raw.lower())
        value = (xxhash.xxh3_64_intdigest(word.encode()) or 1) if word else 0
        if len(raw) <= 64:
            self[raw] = value
        return value


def shingles(text: str, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams; a text of fewer words is one n-gram, one of none has none."""
    split = text.split()
    w = np.fromiter(map(hashes.__getitem__, split), np.uint64, len(split))
    w = w[w != 0]
    if not len(w):
        return w
    n = max(len(w) - words + 1, 1)
    s = np.zeros(n, np.uint64)
    for j in range(min(words, len(w))):
        s = _mixed(s * _P + w[j : j + n])
    return np.unique(s)


def _signatures(bands: int, rows: int, words: int):
    rng = np.random.default_rng(7)
    factors = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    step = np.array([pow(int(_P), r + 1, 2**64) for r in range(rows)], np.uint64)
    salt = _mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]):
        hashes = WordHashes()
        for batch in pieces_of(batches):
            out, sizes = [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text, hashes, words)
                sizes.append(len(s))
                if not len(s):
                    out.append(None)
                    continue
                least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                for a in range(0, len(s), 2048):
                    np.minimum(least, (s[a : a + 2048, None] * factors).min(0), out=least)
                band = _mixed((_mixed(least.reshape(bands, rows)) * step).sum(1, dtype=np.uint64) + salt)
                out.append(band.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["doc_id", "th", "bands", "size"])

    return run


def text_hash(text: Column) -> Column:
    return F.md5(text)


_MEMBER = ("label", "th", "copies", "blocks", "block", "others")


def _shingle_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]):
        hashes = WordHashes()
        for batch in pieces_of(batches):
            sets = [shingles(t, hashes, words).view(np.int64) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in _MEMBER), pa.array(sets, pa.list_(pa.int64()))], [*_MEMBER, "shingles"])

    return run


def similar(sets: list[np.ndarray], threshold: float, few: int = 24) -> np.ndarray:
    """Boolean matrix: Jaccard similarity of two sets at the threshold or above."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float32)
    owner = np.repeat(np.arange(n), sizes.astype(np.int64))
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(values)))
    shared = np.zeros(n * n, np.float32)
    # n-grams of a few sets: all their pairs, one distance in the sorted list after another.
    column = np.repeat(np.arange(len(first)), count)
    part = (count[column] > 1) & (count[column] <= few)
    own, col = owner[part], column[part]
    for d in range(1, few):
        same = col[d:] == col[:-d]
        if not same.any():
            break
        shared += np.bincount(own[:-d][same] * n + own[d:][same], minlength=n * n)
    shared = shared.reshape(n, n)
    shared += shared.T
    # n-grams of many sets: products of their membership, some columns at a time.
    many = np.flatnonzero(count > few)
    rank = np.full(len(first), -1)
    rank[many] = np.arange(len(many))
    width = 4096
    for a in range(0, len(many), width):
        rows = np.flatnonzero((rank[column] >= a) & (rank[column] < a + width))
        x = np.zeros((n, min(width, len(many) - a)), np.float32)
        x[owner[rows], rank[column[rows]] - a] = 1
        shared += x @ x.T
    return shared >= threshold * (sizes[:, None] + sizes - shared) - 1e-4


def _verify(threshold: float):
    def run(key, group):
        _, i, j = (k.as_py() for k in key)
        group = group.take(np.unique(np.array(group["th"].to_pylist()), return_index=True)[1])  # a row repeated whole is one text
        th, copies, block = group["th"].to_pylist(), group["copies"].to_numpy(), group["block"].to_numpy()
        sets = [np.asarray(x.values).view(np.uint64) for x in group["shingles"]]
        near = similar(sets, threshold)
        np.fill_diagonal(near, False)
        if i != j:
            near &= block[:, None] != block  # pairs within a block belong to the block's own task
        root = np.arange(len(th))
        order = np.argsort(np.array(th))
        while True:  # the smallest text that links lead to
            rank = np.empty(len(th), int)
            rank[order] = np.arange(len(th))
            low = np.where(near, rank[root][None, :], len(th)).min(1, initial=len(th))
            new = order[np.minimum(rank[root], low)]
            if (new == root).all():
                break
            root = new
        return pa.table({"th": th, "links": (near * copies).sum(1), "root": [th[r] for r in root], "alone": [i == j and bool(key[0].as_py()) and int(group["blocks"][0].as_py()) == 1] * len(th)}, pa.schema([("th", pa.string()), ("links", pa.int64()), ("root", pa.string()), ("alone", pa.bool_())]))

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(th, class_id, class_th, n_links, copies, first_id) for each different text; th is the text's MD5.

    Texts are split at white space; words are compared by their letters and digits in lower case. Equal texts are one
    text with copies. Texts that share a band are candidates. What candidates connect is a group; a group is cut into
    blocks of about `block` n-grams, texts of one large bucket together, and two blocks are compared, on full sets of
    n-grams, if a bucket has texts of both. n_links counts the rows of other texts at the threshold or above, and the
    text's other copies. A class is what links connect; class_id is its smallest doc_id, class_th the text that has it.
    Texts without words link to nothing and keep a class of their own.
    """
    bands, rows = choose_bands(threshold, recall)
    keyed = docs.select("doc_id", whole().alias("text")).select("doc_id", text_hash(F.col("text")).alias("th"), "text")
    signed = keyed.mapInArrow(_signatures(bands, rows, words), "doc_id long, th string, bands array<long>, size long")
    texts = stored(signed.groupBy("th").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("size").alias("size")), "jaccard-texts")

    bucket = texts.select("th", F.greatest("size", F.lit(LEAST)).alias("size"), F.posexplode("bands").alias("band", "h")).select("th", "size", "h")  # the hash is salted by band
    shared = stored(bucket.groupBy("h").agg(F.min("th").alias("root"), F.count("*").alias("n"), F.sum("size").alias("weight")).where("n > 1"), "jaccard-buckets")
    places = stored(bucket.join(sized(shared), "h"), "jaccard-places")
    edges = places.where("th <> root").select(F.col("th").alias("a"), F.col("root").alias("b"))
    groups = connected(edges, "jaccard-candidates").withColumnsRenamed({"node": "th"})
    # A text's home is its largest bucket, so that texts of one class mostly meet in a block.
    homes = places.groupBy("th").agg(F.max(F.struct("n", "h", "weight")).alias("home"), F.first("size").alias("size"))
    homed = stored(groups.join(homes, "th").select("th", "label", "home", "size"), "jaccard-homes")
    sizes = stored(homed.groupBy("label").agg(F.ceil(F.sum("size") / F.lit(float(block))).cast("int").alias("blocks")), "jaccard-sizes")
    part = F.pmod(F.xxhash64("th"), F.ceil(F.col("home.weight") / F.lit(float(block))))
    placed = homed.join(sized(sizes), "label").select("th", "label", "blocks", F.pmod(F.xxhash64("home.h", part), F.col("blocks")).cast("int").alias("block"))
    # For each block, the later ones that it shares a bucket with; it is compared with itself too.
    large = stored(placed.where("blocks > 1"), "jaccard-large")
    met = places.select("th", "h").join(large, "th").groupBy("label", "h").agg(F.array_sort(F.collect_set("block")).alias("met"))
    met = met.select("label", F.explode("met").alias("block"), "met").groupBy("label", "block").agg(F.array_distinct(F.flatten(F.collect_set("met"))).alias("others"))
    met = stored(met, "jaccard-met").withColumnsRenamed({"label": "label2", "block": "block2"})
    members = placed.join(sized(met), (F.col("label") == F.col("label2")) & (F.col("block") == F.col("block2")), "left")
    members = members.select("th", "label", "blocks", "block", F.array_distinct(F.array_append(F.coalesce("others", F.array().cast("array<int>")), F.col("block"))).alias("others"))
    members = stored(members.join(texts.select("th", "copies", "first_id"), "th"), "jaccard-members")

    # Of equal texts the row of the first id alone is read again.
    once = keyed.join(sized(members), "th").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    full = once.select("text", *_MEMBER).mapInArrow(_shingle_rows(words), "label string, th string, copies long, blocks int, block int, others array<int>, shingles array<long>")
    pairs = full.withColumn("other", F.explode("others")).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("others")
    checked = stored(pairs.groupBy("label", "i", "j").applyInArrow(_verify(threshold), "th string, links long, root string, alone boolean"), "jaccard-links")

    links = checked.groupBy("th").agg(F.sum("links").alias("links"))
    whole_groups = checked.where("alone").select("th", "root")
    between = checked.where("not alone and th <> root")
    if between.head(1):
        joined = connected(between.select(F.col("th").alias("a"), F.col("root").alias("b")), "jaccard-classes").select(F.col("node").alias("th"), F.col("label").alias("root"))
        whole_groups = whole_groups.unionByName(joined)
    every = stored(texts.join(links, "th", "left").join(whole_groups, "th", "left").select("th", "copies", "first_id", F.col("bands").isNotNull().alias("has_words"), (F.coalesce("links", F.lit(0)) + F.when(F.col("bands").isNotNull(), F.col("copies") - 1).otherwise(0)).alias("n_links"), F.coalesce("root", "th").alias("root")), "jaccard-every")
    classes = every.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("n"), "first_id", "th")).alias("least"))
    return every.join(classes, "root").select("th", "copies", "first_id", "has_words", "n_links", F.col("least.first_id").alias("class_id"), F.col("least.th").alias("class_th"))


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, n_links) for every row of docs.

    Null texts are empty; texts without words have themselves for a class and no links. Rows repeated whole, ids shared by
    texts and null ids are fine: a class without any id has a null class_id. An empty table gives an empty result, and
    columns besides doc_id and text are ignored.
    """
    found = near_duplicates(docs, **options)
    rows = docs.select("doc_id", text_hash(whole()).alias("th"))
    return rows.join(found, "th").select("doc_id", F.when(F.col("has_words"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "n_links")


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each class: the row with its class_id (of repeated rows one). Texts without words all stay.

    All columns come back. Null and empty texts have no words, so they stay; a class whose rows have null ids alone keeps
    one of them; an empty table gives an empty one.
    """
    found = stored(near_duplicates(docs, **options), "jaccard-found")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), text_hash(whole()).alias("th"))  # no column of theirs clashes with ours
    # Rows are counted by id and text before their text's class is looked up, so a text of many copies is in many groups.
    counted = keyed.groupBy("id", "th").agg(F.count("*").alias("rows"))
    several = found.where("has_words and (copies > 1 or th <> class_th)").select("th", "class_th", "class_id")
    first = stored(counted.join(several, "th").select(F.col("th").alias("th2"), F.col("id").alias("id2"), "rows", ((F.col("th") == F.col("class_th")) & F.col("id").eqNullSafe(F.col("class_id"))).alias("here")), "jaccard-rows")
    # What goes: other texts of a class, and copies of its first text under another id. Copies under the same id: all but one.
    gone, twice = first.where("not here").select("th2", "id2"), first.where("here and rows > 1").select("th2", "id2")
    same = (F.col("th") == F.col("th2")) & F.col("id").eqNullSafe(F.col("id2"))
    kept = keyed.join(sized(gone), same, "left_anti")
    if twice.head(1):
        kept = kept.join(sized(twice), same, "left_anti").unionByName(kept.join(sized(twice), same, "left_semi").dropDuplicates(["th", "id"]))
    return kept.select("row.*")
