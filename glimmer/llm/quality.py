"""Quality rules: cross-document line frequency over base rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import BLANKS, sized, stored, whole

#: A line is above the limit if more than so many different documents of a host have it,
MAX_DOCUMENTS = 30
#: or, for a large host, more than this share of its different documents.
MAX_SHARE = 0.001
#: A document is depleted if less than this share of its words is left.
MIN_LEFT = 0.3
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
_BREAK = "[ \\t-\\r]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _BREAK), "")


def _given(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _covered(h: Column) -> Column:
    """Words in a window whose hash is in h twice or more: sorting the windows by hash puts equals side by side."""

    def positions(s: Column) -> Column:
        twice = lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])
        return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))

    def length(p: Column) -> Column:
        return F.aggregate(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(F.lit(3), b - a)), F.lit(3).cast("long"), lambda x, y: x + y)

    ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return _given(ordered, lambda s: _given(positions(s), length))


def line_hash(line: Column) -> Column:
    """60 bits of the MD5 of a line (lower-cased, with single spaces), which SQL engines agree on."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def line_features(docs: DataFrame, host: str = "source") -> DataFrame:
    """Per document: rid, the columns doc_id and host, the base counts, and lines: (hash, words) of each line with a word."""
    # Only named columns are kept, so further columns of docs cannot clash.
    d = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col(host).alias("host"), whole().alias("text"))
    bare = F.col("text")
    for symbol in SYMBOLS:
        bare = F.replace(bare, F.lit(symbol), F.lit(""))
    # Each step is a projection of its own, and what a step uses twice is a column: nothing is computed twice.
    d = d.select("rid", "doc_id", "host", F.split("text", "\n").alias("raw"), (F.length("text") - F.length(bare)).cast("long").alias("n_symbols"))
    d = d.withColumn("parts", F.filter(F.transform("raw", _words), lambda w: F.size(w) > 0))
    d = d.select(
        "rid", "doc_id", "host", "n_symbols", F.flatten("parts").alias("w"),
        F.transform("parts", lambda w: F.struct(line_hash(F.lower(F.array_join(w, " "))).alias("h"), F.size(w).alias("n"))).alias("lines"),
        _given(F.filter("raw", lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    d = d.select("rid", "doc_id", "host", "n_symbols", "lines", "n_dup_lines", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), F.transform("w", lambda x: F.xxhash64(x)).alias("one"))
    threes = F.transform(F.slice("one", 1, F.size("one") - 2), lambda x, i: F.xxhash64(x, F.get("one", i + 1), F.get("one", i + 2)))
    d = d.withColumn("windows", F.when(F.col("n_words") < 3, F.array().cast("array<bigint>")).otherwise(threes))
    repeated = F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0)).otherwise(_covered(F.col("windows"))).cast("long")
    return d.select("rid", "doc_id", "host", "lines", "word_chars", "n_symbols", "n_dup_lines", "n_words", repeated.alias("n_repeat_words"))


def frequent_lines(features: DataFrame, max_documents: int = MAX_DOCUMENTS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, h, n_documents) of the lines in more different documents of a host than its limit.

    Documents of the same lines are one document, so that exact copies do not make their own lines frequent. The limit is
    max_documents, or max_share of the host's different documents where that is more.
    """
    text = F.xxhash64(F.transform("lines", lambda x: x["h"])).alias("text")
    sizes = features.groupBy(F.col("host").alias("shost")).agg(F.countDistinct(text).alias("size"))
    d = features.select("host", text, F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    # Distinct (line, text) pairs are made before they are counted, so a line that all documents have is no single group.
    often = d.groupBy("host", "h").agg(F.countDistinct("text").alias("n_documents")).where(F.col("n_documents") > max_documents)
    large = sized(stored(sizes.where(F.col("size") * max_share > max_documents), "quality-sizes"))
    found = often.join(large, F.col("host").eqNullSafe(F.col("shost")), "left")
    return found.where(F.col("size").isNull() | (F.col("n_documents") > F.col("size") * max_share)).select("host", "h", "n_documents")


def quality_rules(docs: DataFrame, host: str = "source", max_documents: int = MAX_DOCUMENTS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per row of docs: the base counts, n_removed_words, removed_lines (hashes) and kept.

    The words of a text are split at white space; lines are split at \\n, lower-cased and given single spaces. A line in
    more than max_documents different documents of its host, and in more than max_share of them, is removed. kept is false for base failures (fewer than 50
    words, or over half of them in repeated 3-word windows) and for documents with less than min_left of their words
    left. Null texts count as empty (no words: not kept), a null host is a host like others, repeated rows give repeated
    results, an empty table gives an empty result; other columns are ignored.
    """
    features = stored(line_features(docs, host), "quality-features")
    frequent = sized(stored(frequent_lines(features, max_documents, max_share).select("host", "h"), "quality-lines"))
    lines = features.select("rid", "host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    hits = lines.join(frequent.select(F.col("host").alias("fhost"), F.col("h").alias("fh")), F.col("host").eqNullSafe(F.col("fhost")) & (F.col("h") == F.col("fh"))).groupBy("rid").agg(F.collect_set("h").alias("removed_lines"))
    d = features.join(hits, "rid", "left").withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<bigint>")))
    gone = F.aggregate(F.filter("lines", lambda x: F.array_contains("removed_lines", x["h"])), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    d = d.withColumn("n_removed_words", F.when(F.size("removed_lines") == 0, F.lit(0).cast("long")).otherwise(gone))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words") >= min_left * F.col("n_words")
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & left).alias("kept"), "n_removed_words", "removed_lines")


def clean_documents(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The documents that quality_rules keeps, without their lines above the limit; n_chars follows the text.

    All columns come back. Null and empty texts have no words and go; a null host is a host like others, null ids are
    kept, repeated rows stay repeated, an empty table gives an empty one.
    """
    # Rows with the same id, text and host get the same judgement, so one of each is enough to look it up.
    key = F.xxhash64("doc_id", whole(), host)
    judged = quality_rules(docs.select(key.alias("doc_id"), "text", F.col(host).alias("source")), **limits)
    judged = judged.where("kept").groupBy(F.col("doc_id").alias("k")).agg(F.first("removed_lines").alias("gone"))
    is_gone = lambda line: F.array_contains("gone", line_hash(F.lower(F.array_join(_words(line), " "))))
    text = F.when(F.size("gone") == 0, F.col("row.text")).otherwise(F.array_join(F.filter(F.split("row.text", "\n"), lambda x: ~is_gone(x)), "\n"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("k"))  # as structs: no column of theirs clashes with ours
    out = rows.join(judged, "k").select("row", text.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
