"""LM scoring: a causal self-attention model beside a word unigram."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.llm import attention
from glimmer.llm.common import pieces_of, stored, whole
from glimmer.llm.tokens import word_ids

#: The commonest words, at most so many, travel to the texts; the occurrences of the others travel to their counts.
COMMON_WORDS = 400_000
#: The training texts are dealt over so many rounds, so that every text is learnt from once at every size. A task trains
#: on about TASK_WORDS words; then the tasks' weights are averaged.
ROUNDS = 2
TASK_WORDS = 800_000
TOKENS, BEGIN, END = 49_408, 49_406, 49_407
_ROWS_A_PART = 4096
#: Texts are encoded about so many bytes at a time: each different word of them is looked up once.
_ENCODE_BYTES = 4 << 20
#: Encoded words that a worker remembers: those that are asked for are different or rare, so that few come again.
_MEMO_WORDS = 100_000


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2


def words(text: str) -> list[bytes]:
    """The words between white space with A-Z lower-cased: bytes know no other letters and no other blanks."""
    return text.encode().lower().split()


def _count(batches: Iterator[pa.RecordBatch]):
    counts: Counter[bytes] = Counter()

    def rows():
        batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "c"])
        counts.clear()
        return batch

    for batch in pieces_of(batches):
        for text in batch.column(0).to_pylist():
            counts.update(words(text))
        if len(counts) > 400_000:
            yield rows()
    yield rows()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): how often each word comes in docs; a word is bytes."""
    return docs.select(whole().alias("text")).mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _of_words(words: list[bytes], ids_of) -> pa.Array:
    """The ids of each word as 16-bit numbers, a binary a word."""
    if len(ids_of) > _MEMO_WORDS:
        ids_of.clear()
    ids = [ids_of[word.decode()] for word in words]
    data = np.frombuffer(b"".join(ids), "<u4").astype("<u2")
    ends = np.cumsum([0] + [len(x) // 2 for x in ids]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _word_ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _of_words(batch.column(0).to_pylist(), word_ids(path))], ["word", "c", "ids"])

    return run


def _token_counts(batches: Iterator[pa.RecordBatch]):
    total = np.zeros(TOKENS)
    for batch in batches:
        ids = batch.column(1).to_pylist()
        times = np.repeat(batch.column(0).to_numpy(), [len(x) // 2 for x in ids])
        total += np.bincount(np.frombuffer(b"".join(ids), "<u2"), times, TOKENS)
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there].astype(np.int64))], ["token", "c"])


_TEXTS = "rid long, doc_id long, held_out boolean, order long, size int, n_tokens long, n_known long, base_score double, rare array<binary>, ids binary"


def _encode(path: str, common, base: float):
    """base: log10 of the unigram's denominator."""

    def run(batches: Iterator[pa.RecordBatch]):
        known, logs, known_ids = common.value
        logs = np.append(logs, 0.0)  # of every other word
        for batch in pieces_of(batches, limit=_ENCODE_BYTES):
            n = batch.num_rows
            # Arrow's kernels lower and split as `words` does, but give an empty word at a blank end.
            split = pc.ascii_split_whitespace(pc.ascii_lower(batch.column(batch.num_columns - 1)))
            flat, owner = pc.list_flatten(split), pc.list_parent_indices(split)
            filled = pc.greater(pc.binary_length(flat), 0)
            flat, owner = pc.filter(flat, filled).cast(pa.binary()), pc.filter(owner, filled).to_numpy(zero_copy_only=False)
            place = pc.fill_null(pc.index_in(flat, value_set=known), len(known)).to_numpy(zero_copy_only=False)
            other = place == len(known)
            rest = pc.filter(flat, pa.array(other))
            coded = pc.dictionary_encode(rest)
            n_words, n_known = np.bincount(owner, minlength=n), np.bincount(owner[~other], minlength=n)
            base_score = np.bincount(owner, logs[place], n) - base * n_known
            rare = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(n_words - n_known)]), pa.int32()), rest)

            ids_at = place.copy()
            ids_at[other] += coded.indices.to_numpy(zero_copy_only=False)
            # The words' ids, one after another, are those of the texts.
            ids = pa.concat_arrays([known_ids, _of_words(coded.dictionary.to_pylist(), word_ids(path))]).take(pa.array(ids_at))
            ends = np.frombuffer(ids.buffers()[1], np.int32)[np.cumsum([0, *n_words])]
            ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), ids.buffers()[2]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(n_words + 1), pa.array(n_known), pa.array(base_score), rare, ids], ["rid", "doc_id", "held_out", "order", "size", "n_tokens", "n_known", "base_score", "rare", "ids"])

    return run


def _ids(texts: list[str] | list[bytes], path: str | None = None) -> list[np.ndarray]:
    """The ids of each text with its end; texts that are bytes are encoded already, but for the end."""
    return [np.append(np.frombuffer(t, "<u2") if isinstance(t, bytes) else np.frombuffer(word_ids(path).of(t), "<u4"), END).astype(np.int64) for t in texts]


def _train(path: str, model):
    def run(batches: Iterator[pa.RecordBatch]):
        weights, of, _ = model.value
        learner, n = attention.Learner(weights), 0
        rng = np.random.default_rng(1)
        for batch in pieces_of(batches, "size"):
            x, y, _ = attention.windows_of(_ids(batch.column(0).to_pylist(), path), BEGIN)
            order = rng.permutation(len(x))
            for a in range(0, len(order), 256):
                learner.learn(x[order[a : a + 256]], y[order[a : a + 256]], of)
            n += len(x)
        if n:
            names, parts, totals, shares = [], [], [], []
            for name, value in learner.w.items():
                step = _ROWS_A_PART if name == "e" else len(value)
                for i in range(0, len(value), step):
                    # An embedding counts as often as the task has met its token.
                    share = learner.seen[i : i + step] if name == "e" else np.full(1, n, np.float32)
                    names.append(name)
                    parts.append(i)
                    totals.append((value[i : i + step].reshape(len(share), -1) * share[:, None]).tobytes())
                    shares.append(share.tobytes())
            task = pa.array([TaskContext.get().partitionId()] * len(names), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(parts, pa.int32()), task, pa.array(totals, pa.binary()), pa.array(shares, pa.binary())], ["name", "part", "task", "total", "share"])

    return run


_SHARE = "name string, part int, task int, total binary, share binary"
#: Tasks whose weights are added up at once.
FAN_IN = 64


def _added(group):
    """Weighted weights and their shares, added up over tasks in an order that does not depend on which came first."""
    rows = sorted(zip(group["total"].to_pylist(), group["share"].to_pylist(), strict=True))
    total, share = ([np.frombuffer(row[i], np.float32) for row in rows] for i in (0, 1))
    out = {n: [group[n][0].as_py()] for n in ("name", "part", "task")}
    out |= {n: [np.sum(x, 0, np.float64).astype(np.float32).tobytes()] for n, x in (("total", total), ("share", share))}
    return pa.table(out, pa.schema([("name", pa.string()), ("part", pa.int32()), ("task", pa.int32()), ("total", pa.binary()), ("share", pa.binary())]))


def averaged(trained: DataFrame, tasks: int) -> DataFrame:
    """One row for each part of the weights: tasks are added up FAN_IN at a time, level by level."""
    while True:
        trained = trained.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("name", "part", "task").applyInArrow(_added, _SHARE)
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            return trained


def _by_text() -> list[Column]:
    """What decides where a text is learnt: its place in the order, and the bytes that fill a task's pieces."""
    return [F.xxhash64(whole(), "doc_id").alias("order"), F.octet_length(whole()).alias("size")]


def train(docs: DataFrame, path: str, counts: np.ndarray, n_words: int, rounds: int = ROUNDS):
    """A broadcast (weights, class of each token, log10 probability in the class), trained once on every row of docs, of n_words words.

    docs: (doc_id, text), or (doc_id, order, size, ids) with the texts encoded already.
    """
    if "ids" not in docs.columns:
        docs = docs.select("doc_id", *_by_text(), whole().alias("ids"))
    spark = docs.sparkSession
    tasks = max(1, round(n_words / rounds / TASK_WORDS))
    of, within = attention.token_classes(counts)
    weights = attention.first_weights(TOKENS, of, counts)
    model = spark.sparkContext.broadcast((weights, of, within))
    for r in range(rounds):
        # Dealt and sorted by what the rows say: a task that runs again, or on other partitions, learns in the same order.
        part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r).select("ids", "size", "order")
        # By number and not by key: a cluster with more partitions than tasks would train, and send, weights for each of them.
        part = part.repartitionById(tasks, F.pmod(F.hash("order"), F.lit(tasks))).sortWithinPartitions("order", "ids").select("ids", "size")
        rows = averaged(part.mapInArrow(_train(path, model), _SHARE), tasks).collect()  # one set of weights
        weights = {n: x.copy() for n, x in weights.items()}
        for row in rows:
            share = np.frombuffer(row["share"], np.float32)[:, None]
            old = weights[row["name"]].reshape(len(weights[row["name"]]), -1) if row["name"] == "e" else weights[row["name"]].reshape(1, -1)
            new = np.frombuffer(row["total"], np.float32).reshape(len(share), -1)
            place = slice(row["part"], row["part"] + len(share)) if row["name"] == "e" else slice(None)
            old[place] = np.where(share > 0, new / np.maximum(share, np.float32(1e-9)), old[place])
        model = spark.sparkContext.broadcast((weights, of, within))
    return model


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]):
        weights, of, within = model.value
        for batch in pieces_of(batches, "ids"):
            ids = _ids(batch.column(batch.num_columns - 1).to_pylist())
            x, y, owner = attention.windows_of(ids, BEGIN)
            score = np.bincount(owner, attention.class_log10(weights, x, y, of).sum(1, dtype=np.float64), len(ids))
            score += [within[i].sum() for i in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def lm_scores(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Counts and weights come from the rows outside the held-out fold. score is the log10 probability of the text by the
    attention model: the probability of each subword's class, given the subwords before it in its window, times the
    subword's share in its class over all training texts; the end of the text is a subword. Null texts are empty (the
    end only), null ids are training rows (held_out false), repeated rows count and are scored each, an empty table
    gives an empty result, other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    training = docs.where(~F.coalesce(held_out(), F.lit(False)))
    counts = stored(word_counts(training).mapInArrow(_word_ids(tokenizer), "word binary, c long, ids binary"), "lm-words")
    n_docs = training.count()
    n_words, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    n, v = n_words + n_docs, n_distinct + (n_docs > 0)
    base = math.log10(n + v + 1)

    subwords = np.zeros(TOKENS)
    for r in counts.select("c", "ids").mapInArrow(_token_counts, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).collect():  # as many rows as the tokenizer has ids
        subwords[r["token"]] = r["c"]
    subwords[END] += n_docs

    # Words above the smallest count that COMMON_WORDS of them or fewer exceed; counts are met in bins of a 16th of an octave.
    bins = sorted(((r["b"], r["n"]) for r in counts.groupBy(F.floor(16 * F.log2("c")).alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = math.inf, 0
    for b, size in bins:
        if (total := total + size) > COMMON_WORDS:
            break
        least = b
    common = counts.where(F.floor(16 * F.log2("c")) >= least) if bins and least < math.inf else counts.limit(0)
    table = common.toArrow()
    known = spark.sparkContext.broadcast((table["word"].combine_chunks(), np.log10(table["c"].to_numpy() + 1.0), table["ids"].combine_chunks()))

    # Texts are encoded once, for training and scoring.
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), *_by_text(), whole().alias("text"))
    texts = stored(rows.mapInArrow(_encode(tokenizer, known, base), _TEXTS), "lm-texts")
    model = train(texts.where(~F.col("held_out")).select("doc_id", "order", "size", "ids"), tokenizer, subwords, n_words)
    kept = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double"
    scored = stored(texts.select("rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "ids").mapInArrow(_scores(model), f"{kept}, score double"), "lm-scores")
    rare = texts.select("rid", F.explode("rare").alias("word")).join(counts.select("word", "c"), "word", "left")
    # Decimals add up to the same in any order.
    rare = rare.groupBy("rid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1).cast("decimal(20,14)")).cast("double").alias("logs"), F.count("*").alias("more"), F.count("c").alias("found"))
    end = math.log10(n_docs + 1) - base
    d = scored.join(rare, "rid", "left")
    return d.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0)) + (1 if n_docs else 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce(F.col("logs") - base * F.col("more"), F.lit(0.0)) + end).alias("base_score"), "score",
    )
