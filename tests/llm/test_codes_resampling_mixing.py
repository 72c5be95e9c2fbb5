import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.llm import common, mixing, queries, resampling, vector_codes
from tests.llm.conftest import CLASHES, prose
from tests.sql import DATA

SF = f"{DATA}/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, " + ", ".join(f"{c} string" for c in [*CLASHES, "q", "code", "error", "part", "entry"] if c != "label")
ORDERED = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def vectors(spark, rows):
    return spark.createDataFrame([(*r, *["z"] * (len(CLASHES) + 4)) for r in rows], VECTORS)


# Vector codes


def plain_codes(rows, entries=16, rounds=6):
    """Every entry against every part, in whole numbers of any size."""
    kept = [(i, [min(max(math.floor(4096 * float(np.float32(x))), -vector_codes.MOST), vector_codes.MOST) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 8)
    short = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    parts = lambda v: [tuple((v + [0] * (8 * width - len(v)))[p * width : (p + 1) * width]) for p in range(8)]
    books = [[parts(v)[p] for _, v, _ in short] for p in range(8)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            got = collections.defaultdict(list)
            for _, v, _ in kept:
                got[nearest(parts(v)[p], book)[1]].append(parts(v)[p])
            for k, members in got.items():
                book[k] = tuple(sum(m[j] for m in members) // len(members) for j in range(width))
    coded = [(i, label, *zip(*[nearest(x, b) for x, b in zip(parts(v), books, strict=True)], strict=True)) for i, v, label in kept]
    by_label = collections.Counter()
    for _, label, d, _ in coded:
        by_label[label] += sum(d)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return collections.Counter((i, "".join(f"{c:02x}" for c in codes), sum(d), by_label[label], digest) for i, label, d, codes in coded)


def codes_of(d):
    return collections.Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.coded(d).collect())


def odd_vectors():
    rng = random.Random(3)
    some = [(i, [rng.choice([-0.25, 0.0, 0.25, rng.gauss(0, 0.2)]) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(120)]
    same = [(200 + i, [0.125] * 16, 7) for i in range(60)]  # a large group of copies
    return [*some, *same, (3, some[3][1], 1), (3, some[4][1], None), (None, some[5][1], 1), (None, some[5][1], 1), (500, None, 1), (501, [], None), (502, [None] * 16, 1), (503, [float("nan")] * 16, 1), (504, [float("inf")] + [0.0] * 15, 1), (505, [0.5] * 5, 2), (506, [1e9, -1e9] * 8, 2), (-4, [0.3] * 19, 2)]


def test_codes_agree_with_brute_force(spark):
    rows = odd_vectors()
    assert codes_of(vectors(spark, rows)) == plain_codes(rows)


def test_codes_do_not_depend_on_how_rows_lie(spark):
    rows = odd_vectors()
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    assert codes_of(vectors(spark, shuffled).repartition(7)) == codes_of(vectors(spark, rows).coalesce(1))


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, [], 1), (2, [], None)], [(9, [0.5] * 8, None)]])
def test_codes_of_few_vectors(spark, rows):
    assert codes_of(vectors(spark, rows)) == plain_codes(rows)


@pytest.mark.parametrize("seed", range(6))
def test_balls_assign_as_all_entries_do_and_skip_work(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-4, 5, (400, 3)) + 40 * rng.integers(0, 3, (400, 1))
    entries, ball = x[:16].copy(), np.zeros(400, np.int64)
    balls = vector_codes.Balls(entries, np.full(16, np.inf), np.ones(16, bool))
    for _ in range(5):
        ball, error = balls.assign(x, ball)
        d = ((x[:, None] - balls.entries) ** 2).sum(2)
        assert (ball == d.argmin(1)).all()
        assert (error == d.min(1)).all()
        sums = {}
        for e in set(ball.tolist()):
            mine = x[ball == e]
            sums |= {(e, k): int(mine[:, k].sum()) for k in range(3)} | {(e, 3): len(mine), (e, 4): int(error[ball == e].max())}
        balls = balls.updated(sums, 3)
    near = [len(balls.neighbours(i)[0]) for i in range(16)]
    assert max(near) < 15  # far groups are nobody's candidates


def test_old_rounds_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    assert vector_codes.vector_codes(vectors(spark, odd_vectors()))[0].count() > 180
    assert len(list(tmp_path.glob("vector*"))) == 1


# Importance resampling


def plain_resampling(docs, target, order=1, buckets=10000, least=20, percent=10, seed=2024):
    def words(text):
        return ORDERED.findall(common.pc.ascii_lower(text or "").as_py())

    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(w) - n + 1)]

    s, t = (collections.Counter(b for text in texts for b in features(text)) for texts in ([x for _, x in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(text))))
    may = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    ranks = collections.defaultdict(list)
    for k, r in enumerate(may[: percent * len(may) // 100]):
        ranks[r].append(k + 1)
    return collections.Counter((*r[:4], ranks[r].pop(0) if ranks.get(r) else None) for r in rows)


def drawn(d):
    return collections.Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in d.collect())


@pytest.mark.parametrize(("order", "percent", "least"), [(1, 10, 20), (2, 55, 20), (3, 100, 0)])
def test_resampling_agrees_with_brute_force(spark, odd, order, percent, least):
    target = [prose(30, 4), None, "", "one one ONE", "a" * 300, prose(60, 3)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(2000 + i, prose(5 + i, i % 7)) for i in range(60)] + [(8, None), (77, "É É é Straße 中文 中文 " * 8)] + [(300, prose(25, 1))] * 9, "doc_id long, text string"))
    got = resampling.resample(docs.repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), percent, least, order)
    assert drawn(got) == plain_resampling([tuple(r) for r in docs.collect()], target, order, percent=percent, least=least)


def test_resampling_of_odd_tables(spark, odd, nothing):
    assert resampling.resample(nothing, odd).count() == 0
    got = resampling.resample(odd, nothing)
    assert drawn(got) == plain_resampling([tuple(r) for r in odd.select("doc_id", "text").collect()], [])
    assert {"doc_id", "n_features", "weight", "score", "rank"} <= set(got.columns)


def test_resampling_prefers_what_is_like_the_target(spark):
    """A tenth of all is drawn; of ten texts in the target's words more than half. The noise has a deviation of 1283."""
    like = prose(80, 5)
    rows = [(i, prose(100, 100 + i)) for i in range(300)] + [(1000 + i, " ".join(random.Random(i).sample(like.split(), 60))) for i in range(10)]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(like,)] * 60, "text string"))
    top = {r["doc_id"] for r in got.where("rank is not null").collect()}
    assert len(top) == 31
    assert len([i for i in top if i >= 1000]) > 5


# Mixing


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, total, full = {s: 1 + k % 3 for k, s in enumerate(order)}, sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        share = {s: (total - sum(full.values())) * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = [s for s in rest if share[s] > 3 * sizes[s]]
        if not above:
            return full | share
        full |= {s: 3 * sizes[s] for s in above}


def sized_rows(docs):
    return [(r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), r["source"]) for r in docs.collect()]


def corpus(spark, odd, copies=0):
    """Sources of very different sizes, one of a third of all rows, one of one document, an empty one, and none."""
    rows = [(5000 + i, prose(3 + i % 40, i), "hot") for i in range(150)] + [(6000, prose(700, 1), "one"), (6001, "", "empty"), (6002, None, "empty")]
    rows += [(7000 + i, prose(20, i), f"s{i % 6}é") for i in range(60)] + [(7100, "same words here", "s0")] * copies
    return odd.select("doc_id", "text", "source").unionByName(spark.createDataFrame(rows, "doc_id long, text string, source string"))


@pytest.mark.parametrize("copies", [0, 40])
def test_mix_meets_targets(spark, odd, copies):
    docs = corpus(spark, odd, copies)
    own = sized_rows(docs)
    sizes = collections.Counter()
    for _, n, s in own:
        sizes[s] += n
    want = plain_targets(dict(sizes))
    got = mixing.taken_words(docs.repartition(6)).collect()
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    left = collections.Counter((i, n, sizes[s], round(want[s], 6)) for i, n, s in own)
    assert left == collections.Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got)
    taken = collections.Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    for (_, target), n in taken.items():
        many = sum(round(want[s], 6) == target for s in sizes)  # sources of equal size and target
        assert abs(n - many * target) <= many


def test_mix_is_the_same_again_and_dealt_exactly(spark, odd):
    docs = corpus(spark, odd, 30)
    rows, mixed = mixing.mix(docs.repartition(5), texts=True, block_words=50, shard_blocks=9)
    one = [tuple(r) for r in mixed.select("shard", "position", "doc_id", "pass", "words", "text").orderBy("shard", "position").collect()]
    again = mixing.mix(docs.coalesce(1), texts=True, block_words=50, shard_blocks=9)[1]
    assert one == [tuple(r) for r in again.select("shard", "position", "doc_id", "pass", "words", "text").orderBy("shard", "position").collect()]
    places = collections.defaultdict(list)
    for shard, position, *_ in one:
        places[shard].append(position)
    assert len(places) > 20
    assert all(x == list(range(1, len(x) + 1)) for x in places.values())
    # A copy of a document is in the mix once, whatever its shard.
    assert mixed.groupBy("row", "pass").count().where("count > 1").count() == 0
    assert one != sorted(one, key=lambda r: (r[0], r[2] or 0))


@pytest.mark.parametrize("shards", [1, 2, 63, 64, 65, 300])
def test_quotas_are_kept_by_source_and_by_shard(spark, shards):
    quotas = {1: 5000, 2: 1, 3: 77, 4: 0, 5: 922}
    total = sum(quotas.values())
    got = mixing.shard_quotas(spark.createDataFrame(list(quotas.items()), "number long, n long"), total, shards).toPandas()
    assert {k: n for k, n in quotas.items() if n} == got.groupby("number")["n"].sum().to_dict()
    assert got.groupby("shard")["n"].sum().to_dict() == {s: (s + 1) * total // shards - s * total // shards for s in range(shards)}
    hot = got[got["number"] == 1].set_index("shard")["n"]
    if shards == 65:  # near the mean, and not all at it
        assert hot.std() < 12
        assert hot.nunique() > 3


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_blocks_are_permuted(n):
    out = mixing.permuted(np.arange(n), n, 5)
    assert sorted(out.tolist()) == list(range(n))
    if n >= 1000:
        assert abs(np.corrcoef(out, np.arange(n))[0, 1]) < 0.1
        assert (out != mixing.permuted(np.arange(n), n, 6)).any()


def test_mix_of_nothing(spark, nothing, odd):
    assert mixing.taken_words(nothing).count() == 0
    empty = odd.select("doc_id", F.lit(None).cast("string").alias("text"), "source")
    assert [tuple(r) for r in mixing.taken_words(empty).select("size", "target", "taken").distinct().collect()] == [(0, 0.0, 0)]
    assert mixing.taken_words(odd).count() == odd.count()


def test_mix_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op13_source_mixing(spark, SF).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t"))
    assert all(abs(r["n"] - r["t"]) <= 1 for r in got.collect())
