import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glimmer.llm import attention, chunks, decontamination, jaccard, lm, packing, quality, queries, repeats, toxicity, url_rules, wrappers
from glimmer.llm.tokens import word_ids
from tests.llm.conftest import prose
from tests.sql import DATA, differences, views

SF = f"{DATA}/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_agrees_with_sql(spark, name):
    _, only, types = differences(views(SF), queries.queries()[name](spark, SF), queries.oracle_sql()[name])
    assert not only
    assert types


# Packing


def packed(rows):
    at = collections.defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    return {s: sorted(x) for s, x in at.items()}


def test_packing_puts_every_id_in_one_piece(spark, odd):
    rows = packing.pack(odd, queries.tokenizer()).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    want = collections.Counter()
    for r in odd.collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        for a in range(0, len(ids), 4096):
            p = ids[a : a + 4096]
            want[r["doc_id"], a, len(p), zlib.crc32(p.tobytes()), len(ids)] += 1
    assert want == collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    for x in packed(rows).values():
        assert [a for a, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))]
        assert sum(n for _, n in x) <= 4096


def test_plan_uses_each_piece_once_with_little_padding():
    rng = np.random.default_rng(4)
    cases = [(rng.integers(1, 4097, 5000), 1.04), (np.minimum(rng.geometric(0.003, 20000), 4096), 1.005), ([700] * 1000, 1.2)]
    for lengths, most in cases:
        h = np.bincount(lengths, minlength=4097)
        used, total, n = np.zeros(4097, int), 0, 0
        for parts, k in packing.plan(h):
            assert sum(a * m for a, m in parts) <= 4096
            for a, m in parts:
                used[a] += m * k
            n += k
        assert (used == h).all()
        total = (np.arange(4097) * h).sum()
        assert n <= math.ceil(total / 4096) * most + 1


def test_least_squares_is_non_negative_and_solves_an_exact_case():
    x = packing.non_negative_least_squares([((3, 1), (1, 1)), ((2, 2),)], np.array([0.0, 5, 8, 5, 0]), 500)
    assert x == pytest.approx([5, 4], abs=0.05)


def test_word_memo_agrees_with_the_tokenizer():
    from tokenizers import Tokenizer

    t, w = Tokenizer.from_file(queries.tokenizer()), word_ids(queries.tokenizer())
    for text in ["It's DON'T don't, x. <|endoftext|>a", "İstanbul ΣΑΣ éa ﬁ Ⅷ 12,5!!", "a\x1cb\x1f c\u0085d", "", "e\u0301. A.B.C we'll've"]:
        assert np.frombuffer(w.of(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


# Decontamination


def levenshtein_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_myers_agrees_with_dynamic_programming():
    rng = np.random.default_rng(0)
    for _ in range(150):
        p, t = ("".join(rng.choice(list("abc"), rng.integers(1, n))) for n in (40, 90))
        masks = collections.defaultdict(int)
        for j, c in enumerate(p):
            masks[c] |= 1 << j
        distance, end = decontamination.best_match(masks, len(p), t)
        assert distance == levenshtein_in(p, t)
        assert distance == levenshtein_in(p, t[:end])


def test_matches_agree_with_brute_force(spark, odd):
    item, rng = prose(30, 50), np.random.default_rng(1)
    k = int(0.08 * len(item))
    texts = []
    for edits in (0, 1, k // 2, k, k + 6, 3 * k):
        t = list(item.upper())
        for _ in range(edits):
            t[rng.integers(len(t))] = "#"
        texts.append(prose(40, edits) + "  " + "".join(t) + "\n" + prose(20, edits + 1))
    docs = spark.createDataFrame([*enumerate(texts), (99, None), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, " ")], "item_id long, text string")
    want = {(i, d) for i, t in [*enumerate(texts), (None, item)] if (d := levenshtein_in(item.lower(), decontamination.normal(t))) <= k}
    for block in (10**6, 10):
        got = decontamination.benchmark_matches(docs, bench, block_chars=block).collect()
        assert {(r["doc_id"], r["distance"]) for r in got} == want
    assert decontamination.without_benchmark(odd, bench).columns == odd.columns
    assert decontamination.without_benchmark(odd, bench).count() == odd.count()
    assert decontamination.benchmark_matches(docs, bench.limit(0)).count() == 0


def test_places_of_matches_and_ties(spark):
    item = prose(20, 9)
    changed = item[:40] + "#" + item[41:]
    docs = spark.createDataFrame([(1, f"xx {item} yy {item}"), (2, f"xx {changed} yy {changed}"), (3, f"xx {item[:30]}{item[31:]} yy"), (4, prose(30_000, 4) + " " + changed)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.benchmark_matches(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    m = len(item)
    assert [(got[i]["distance"], got[i]["first_char"], got[i]["last_char"]) for i in (1, 2, 3)] == [(0, 3, 3 + m), (1, 3, 3 + m), (1, 3, 2 + m)]  # of equal places the first
    assert (got[4]["distance"], got[4]["last_char"] - got[4]["first_char"]) == (1, m)


# Suffix dedup


def brute_removed(rows):
    count = collections.Counter(t[i : i + 200] for _, t in rows for i in range(len(t) - 199))
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def test_suffix_dedup_agrees_with_brute_force(spark, odd, monkeypatch):
    extra = [(100 + i, prose(50 + i, 70) + " " + prose(40, 71) + prose(i, 72 + i)) for i in range(6)] + [(120, "ab" * 700), (121, "x" + "ab" * 300)]
    docs = odd.where("doc_id is null or doc_id <> 9").select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    want = brute_removed([(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()])
    for large in (20_000, 3):  # the second compares every name string by string
        monkeypatch.setattr(repeats, "LARGE", large)
        assert collections.Counter(map(tuple, repeats.suffix_dedup(docs).collect())) == want


def test_sampled_positions_are_chosen_by_content():
    data = prose(400, 12).encode()
    a = repeats.sampled(data)
    b = repeats.sampled(b"some bytes before " + data)
    shifted = {(n, at - 18) for n, at, _, _ in b}
    inner = [(n, at) for n, at, first, _ in a if first > 0]
    assert set(inner) <= shifted
    assert [x for _, _, f, l in a for x in range(f, l + 1)] == list(range(len(data) - 199))


# Chunks


def test_chunks_are_cut_by_content_and_dedup_round_trips(spark, odd):
    data = prose(2000, 13).encode()
    a, b = chunks.cuts(data), chunks.cuts(b"xyz" + data)
    assert len(set(a) & {e - 3 for e in b}) > 0.95 * len(a)
    assert a[-1] == len(data)
    got = chunks.substring_dedup(odd).collect()
    texts = collections.defaultdict(list)
    for r in odd.collect():
        texts[r["doc_id"]].append((r["text"] or "").encode())
    for r in got:
        kept = [chunks.cut_out(t, [(s["start"], s["length"]) for s in r["spans"]]) for t in texts[r["doc_id"]] if len(t) == r["n_bytes"]]
        assert r["kept_sha256"] in [hashlib.sha256(k).hexdigest() for k in kept]
    removed = {r["doc_id"]: r["n_removed"] for r in got}
    assert removed[7] == 0
    assert removed[8] > 300
    assert removed[6] > 300
    assert removed[1] == removed[14] == 0


def test_text_of_one_word_is_cut_at_the_same_points_wherever_it_begins():
    unit = b"the "
    chunks_of = lambda data: [data[a:b] for a, b in zip([0, *chunks.cuts(data)], chunks.cuts(data), strict=False)]
    one, two = chunks_of(b"first " + unit * 3000), chunks_of(b"another beginning " + unit * 3000)
    assert sum(x in set(two) for x in one) >= len(one) - 4  # all but the beginning and the end
    assert len(one) > 10
    assert b"".join(one) == b"first " + unit * 3000


def test_chunk_repeats_agree_with_brute_force(spark):
    docs = table(spark, "documents")
    seen, want = set(), {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        data, last, parts = (r["text"] or "").encode(), 0, []
        for end in chunks.cuts(data):
            if data[last:end] in seen:
                parts.append({"start": last, "length": end - last})
            seen.add(data[last:end])
            last = end
        want[r["doc_id"]] = chunks.runs_of(parts)
    got = {r["doc_id"]: [(s["start"], s["length"]) for s in r["spans"]] for r in chunks.substring_dedup(docs).collect()}
    assert got == want


def test_single_passages_of_51_words_go_nearly_whole():
    whole = gone = missed = 0
    for i in range(300):
        words = prose(51, 10_000 + i)
        one, two = (f"{prose(90, 20_000 + 2 * i + j)} {words} {prose(90, 50_000 + 2 * i + j)}".encode() for j in range(2))
        last, seen = 0, set()
        for end in chunks.cuts(one):
            seen.add(one[last:end])
            last = end
        last, parts = 0, []
        for end in chunks.cuts(two):
            if two[last:end] in seen:
                parts.append({"start": last, "length": end - last})
            last = end
        n = sum(length for _, length in chunks.runs_of(parts))
        whole, gone, missed = whole + len(words), gone + n, missed + (n == 0)
    print("share of bytes", gone / whole, "missed", missed)
    assert missed <= 1
    assert gone > 0.75 * whole


# Jaccard


def test_jaccard_join_agrees_with_brute_force(spark):
    base = [prose(120, i) for i in range(4)]
    rows = []
    for i, t in enumerate(base):
        for j in range(9):
            w = t.split()
            w[7 * j % 120] = f"new{j}"
            rows.append((len(rows) * 3, " ".join(w)))
        rows += [(1000 + i, t), (1001 + i, t)]
    docs = spark.createDataFrame([*rows, (5000, None), (5001, ""), (None, base[0])], "doc_id long, text string")
    hashes = jaccard.WordHashes()
    every = [(r["doc_id"], jaccard.shingles(r["text"] or "", hashes)) for r in docs.collect()]
    near = [[bool(len(a) and len(b)) and i != j and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) for j, (_, b) in enumerate(every)] for i, (_, a) in enumerate(every)]
    label = list(range(len(every)))
    for _ in every:
        label = [min([label[i], *(label[j] for j in range(len(every)) if near[i][j])]) for i in range(len(every))]
    ids = {k: min((every[i][0] for i in range(len(every)) if label[i] == k and every[i][0] is not None), default=None) for k in set(label)}
    want = collections.Counter((d, ids[label[i]] if len(s) else d, sum(near[i])) for i, (d, s) in enumerate(every))
    for block in (1 << 18, 1 << 12):  # the second cuts groups into blocks
        assert collections.Counter(map(tuple, jaccard.jaccard_join(docs, block=block).collect())) == want


def test_bands_reach_the_target_recall():
    b, r = jaccard.choose_bands(0.8, 0.999)
    assert b * r <= 128
    assert 1 - (1 - 0.8**r) ** b >= 0.999


def test_one_document_of_each_group_stays(spark, odd):
    got = jaccard.without_near_duplicates(odd)
    assert got.columns == odd.columns
    ids = collections.Counter(r["doc_id"] for r in got.collect())
    assert ids[5] == 1
    assert ids[6] == 0
    assert ids[12] + ids[13] == 1
    assert ids[2] == ids[3] == ids[4] == 1
    assert ids[14] == 1
    assert ids[15] == 0


# Quality


def test_base_counts_agree_with_brute_force(spark, odd):
    def counts(t):
        w = WORD.findall(t)
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

    docs = odd.select("doc_id", "text", "source").unionByName(table(spark, "documents").select("doc_id", "text", "source"))
    want = collections.Counter((r["doc_id"], *counts(r["text"] or "")) for r in docs.collect())
    got = quality.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert collections.Counter(map(tuple, got)) == want


def test_frequent_lines_go_and_depleted_documents_too(spark):
    menu = prose(60, 500)
    rows = [(i, prose(200, i) + "\n" + menu.upper() + "  ", "a") for i in range(40)] + [(100 + i, menu + "\n" + prose(10, 900 + i), "a") for i in range(3)]
    copy = "\n".join(prose(20, 800 + k) for k in range(15))
    rows += [(200 + i, copy, "a") for i in range(40)] + [(300 + i, menu + "\n" + prose(60, 2000 + i), "b") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, max_documents=30).collect()}
    assert all(got[i]["kept"] and got[i]["n_removed_words"] == 60 for i in range(40))
    assert not any(got[100 + i]["kept"] or got[100 + i]["base_failed"] for i in range(3))
    assert all(got[200 + i]["kept"] and not got[200 + i]["n_removed_words"] for i in range(40))  # copies are one document
    assert all(got[300 + i]["kept"] and not got[300 + i]["n_removed_words"] for i in range(30))  # another host, at the limit
    large = {r["doc_id"]: r for r in quality.quality_rules(docs, max_documents=30, max_share=0.99).collect()}
    assert not large[0]["n_removed_words"]  # the limit grows with the host
    clean = {r["doc_id"]: r["text"] for r in quality.clean_documents(docs, max_documents=30).collect()}
    assert clean[0] == prose(200, 0)
    assert 100 not in clean


def test_lines_that_stand_together_do_not_hide_each_other(spark):
    menu = [prose(8, 700 + j) for j in range(10)]
    rows = [(i, "\n".join([*menu, prose(60, 3000 + i)]), "a") for i in range(300)]
    features = quality.line_features(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = quality.frequent_lines(features).collect()
    assert len(got) == 10
    assert {r["n_documents"] for r in got} == {300}


# URL rules


def test_url_rules_agree_with_brute_force(spark, nothing):
    rules = [*url_rules.RULES, ("block", "b.example.net", None), ("allow", "b.example.net", "/x"), ("block", None, "/"), ("block", "example.com", "/de/"), ("allow", "example.com", "/de/")]
    hosts = ["net", "example.net", "a.example.net", "b.example.net", "c.b.example.net", "xexample.net", "example.com", "org", "w.org", "NET", "fr.example.ORG:80", ""]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/de/x", "/fr/?q#f", "/x/y?z", "?a", "#b")] + [None, "", "no host", "://", "a://b://net/", "http://example.net/en\n/", "http://net/" + "a" * 100_000, "http://" + "b." * 500 + "org/fr/"]
    pages = spark.createDataFrame([(i if i % 7 else None, u) for i, u in enumerate(urls * 2)], "page_id long, url string")

    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
        return "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]

    def judged(i, u):
        h, p = parts(u)
        fit = [(len(x + (y or "/")), v, x + (y or "/")) for v, x, y in rules if x and (h == x or h.endswith("." + x)) and p.startswith(y or "/")]
        return (i, h, p, max(fit)[2], max(fit)[1]) if fit else (i, h, p, None, "allow")

    got = url_rules.judge_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string"))
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(judged(r["page_id"], r["url"]) for r in pages.collect())


# Wrappers

PAGE = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='<p>x</p>'</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></li><li>News</li></ul></nav><div class='cookie-notice'>Cookies</div><article class=post><h1>Title &amp; more</h1>%s</article><aside>Side</aside><div id=comments><article class=comment><p>I say that this comment is very long indeed, longer than all the rest of the page put together, it goes on.</p></article></div><form><p>Search</p></form><footer>Foot</footer></body></html>"


def test_main_text_leaves_out_what_is_not_the_article(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE % "".join(f"<p>Para  {i}\n{j} <b>bold</b>&lt;x&gt;</p><div class=ad>Buy</div>" for j in range(1 + i % 4))) for i in range(12)]
    rows += [(50, None, None), (51, "x", ""), (52, "http://h0.org/z", "<p>bare <b>text<br><p>second"), (53, "http://h0.org/y", "a < b & c"), (None, "http://h1.org/", "<article><p>open")]
    got = {r["page_id"]: r for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i]["text"] == "\n".join(["Title & more", *(f"Para {i} {j} bold<x>" for j in range(1 + i % 4))])
    assert got[50]["text"] == got[51]["text"] == ""
    assert got[52]["text"] == "bare text\nsecond"
    assert got[53]["text"] == "a < b & c"
    assert got[None]["text"] == "open"
    assert len(got) == len(rows)


def outlined(page):
    return wrappers.outline(wrappers.tokens(wrappers.parse(page)))


def test_wrapper_has_slots_options_and_repeats():
    a = outlined("<body><h1>A</h1><ul><li>1</li><li>2</li></ul><p>same</p></body>")
    b = outlined("<body><h1>B</h1><ul><li>3</li></ul><table></table><p>same</p></body>")
    merged = wrappers.merge(a, b)
    assert wrappers.expression(merged) == "<body><h1>#</h1><ul>(<li>#</li>)+</ul>(<table></table>)?<p>=</p></body>"
    assert wrappers.dumped(wrappers.loaded(wrappers.dumped(merged))) == wrappers.dumped(merged)
    long = "".join(f"<h2>{i}</h2><p>a</p><p>b</p><ul></ul><dl></dl><table></table><pre></pre>" for i in range(3))
    assert wrappers.expression(outlined(long)) == "(<h2>=</h2>(<p>=</p>)+<ul></ul><dl></dl><table></table><pre></pre>)+"


def test_deep_wide_and_broken_pages():
    assert wrappers.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    inside = "<div>" * 110 + "<nav>MENU</nav><form>f</form><aside>x</aside><p>text</p>" + "</div>" * 110
    assert wrappers.extract(inside) == "text"
    deep = outlined("<div>" * 5000 + "deep" + "</div>" * 5000)
    assert wrappers.dumped(wrappers.loaded(wrappers.dumped(wrappers.merge(deep, deep))))
    wide = "<body>" + "".join(f"<h{i % 4 + 1}>a</h{i % 4 + 1}><t{i}x>a</t{i}x>" for i in range(900)) + "</body>"
    merged = wrappers.merge(outlined(wide), outlined(wide + "<y>b</y>"))
    assert merged.children[0].key == "body"
    for broken in ("<", "<a href='x", "<script>never", "<!-- never", "</p></p>", "<p a=\"b>c", "&#xZZ; &#99999999999;", "<p>a<table><tr><td>b<p>c"):
        assert isinstance(wrappers.extract(broken, 5), str)


def test_raw_elements_names_and_comments_end_where_html_ends_them():
    page = "<article><h1>T</h1><p>A <svg class='i'/> B</p><p>C <object-view/>D<!-->E<math><mi>x</mi></math></p><style-note>n</style-note><style>p{}</style></article>"
    assert wrappers.extract(page) == "T\nA B\nC\nDEx\nn"
    assert wrappers.extract("<article><section class='share-of-market'>s</section><div class='reply'>r</div><div class='site-comments'>no</div><p>x</p></article>") == "s\nr\nx"
    assert wrappers.extract("<body class='has-sidebar'><div class='content no-sidebar'><p>x y z</p></div><div class=sidebar>side</div></body>") == "x y z"
    assert wrappers.extract("<article class='post comments-open'><p>all of it</p></article>") == "all of it"


def test_what_all_pages_of_a_host_have_is_the_template(spark):
    def page(i):
        body = "".join(f"<p>Body {i} {j} of the page {prose(9, 40 * i + j)}</p>" for j in range(i % 5 + 1))
        return f"<html><body><header><h1>Site</h1></header><div>Our site since 1999</div><div id=post-{i} class='post post-{i}'><h2>Title {i}</h2><h3>Summary</h3>{body}<p>Subscribe to us</p><h3>Read on</h3></div><div>All rights</div></body></html>"

    rows = [(i, f"http://one.org/{i}", page(i)) for i in range(600)] + [(1000 + i, "http://two.org/", page(7)) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(df).collect()}
    for i in range(600):
        assert got[i] == "\n".join([f"Title {i}", "Summary", *(f"Body {i} {j} of the page {prose(9, 40 * i + j)}" for j in range(i % 5 + 1))])
    assert "Body 7 0" in got[1000]  # copies of one page are one page and no template
    copies = [(i, "http://three.org/", page(4).replace("Title 4", f"Title number {i}")) for i in range(5)]
    near = wrappers.main_text(spark.createDataFrame(copies, "page_id long, url string, html string")).collect()
    assert all("Body 4 3" in r["text"] and f"Title number {r['page_id']}" in r["text"] for r in near)  # nor are near copies
    wrapper = {r["host"]: r["wrapper"] for r in wrappers.infer_wrappers(df).collect()}["one.org"]
    assert len(wrapper) < 3000  # it does not grow with the pages
    other = {r["page_id"]: r["text"] for r in wrappers.main_text(df.repartition(7)).collect()}
    assert got == other


def test_main_text_of_the_table_is_the_article(spark):
    got = {r["page_id"]: r["text"] for r in queries.op3_wrappers(spark, SF).collect()}
    import html

    for r in table(spark, "pages").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</h1>|</p>|<p>", article)]
        assert got[r["page_id"]] == "\n".join(x for x in want if x)


# Toxicity


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.toxicity(docs.join(labels, "doc_id", "left_semi"), labels).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.01 * n[0, 0]


def test_scores_agree_with_a_plain_sum_over_words(spark, odd):
    """The same fit, and then each text scored feature by feature in plain Python."""
    rng = np.random.default_rng(3)
    bad, good = ["scum", "idiots", "vermin"], ["garden", "window", "river"]
    texts = [" ".join([*(f"w{x}" for x in rng.integers(0, 60, 12)), str(rng.choice(bad if i % 2 else good)), *(["women"] if i % 3 == 0 else [])]) for i in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "scum river"), (400, None), (401, "idiots " * 3)], "doc_id long, text string").unionByName(odd.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 0
    rows = [(toxicity.document_features(t), None if (w := toxicity.swapped(t)) is None else toxicity.document_features(w), i % 2) for i, t in enumerate(texts) if not held(i)]
    seen = collections.defaultdict(lambda: [0, 0])
    for x, _, y in rows:
        for f in x[0]:
            seen[f][y] += 1
    share, n = sum(y for *_, y in rows) / len(rows), len(rows)
    told = {f for f, (a, b) in seen.items() if a + b >= 4 and abs(b - (a + b) * share) >= 4 * math.sqrt(max((a + b) * share * (1 - share), 1e-9))}
    some = lambda x: None if x is None else (np.array([f for f in x[0] if f in told], int), np.array([c for f, c in zip(*x, strict=True) if f in told], float))
    weights, bias = toxicity.fit([(some(x), some(s), y) for x, s, y in rows])
    assert n and told

    def score(text):
        words = {re.sub(r"\W+", "", w.lower()) for w in (text or "").split()} - {""}
        total = bias + sum(float(weights[zlib.crc32(f.encode()) % toxicity.BUCKETS]) for w in words for f in [f"={w}", *(f"^{w[:k]}" for k in (3, 4, 5, 6) if len(w) >= k)])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))

    got = sorted((str(r["doc_id"]), r["held_out"], round(r["score"], 5), r["predicted"]) for r in toxicity.toxicity(docs, labels).collect())
    want = sorted((str(r["doc_id"]), held(r["doc_id"]), round(score(r["text"]), 5), int(score(r["text"]) >= 0.5)) for r in docs.collect())
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    assert [c for *_, c, _ in got] == pytest.approx([c for *_, c, _ in want], abs=2e-4)


def test_swaps_lower_the_score_change_of_identity_terms():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        toxic = i % 2
        who = "muslim" if rng.random() < (0.9 if toxic else 0.1) else "christian"
        text = f"{prose(8, i)} {who} " + ("idiot scum" if rng.random() < 0.7 and toxic else prose(2, i + 1))
        swap = toxicity.swapped(text)
        rows.append((toxicity.document_features(text), toxicity.document_features(swap), toxic))

    def change(penalty):
        w, b = toxicity.fit(rows, penalty=penalty)
        s = toxicity.WordScores(w)
        p = lambda t: 1 / (1 + math.exp(-b - s.total(t)))
        return abs(p("a muslim neighbour") - p("a christian neighbour"))

    assert change(8.0) < 0.5 * change(0.0)
    assert toxicity.swapped("nobody here") is None


# Language model


def test_attention_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    counts = rng.integers(1, 50, 1200).astype(float)
    of, within = attention.token_classes(counts)
    w = attention.first_weights(1200, of, counts)
    x, y, _ = attention.windows_of([rng.integers(0, 1200, 50), rng.integers(0, 1200, 5)], 299)
    loss = lambda w: -attention.class_log10(w, x, y, of).sum(dtype=float) * math.log(10) / (y >= 0).sum()
    learner = attention.Learner(w)
    got = {}
    learner._step = lambda name, grad, rows=slice(None): got.setdefault(name, (grad, rows))
    learner.learn(x, y, of)
    for name, place in (("q", (1, 2)), ("k", (3, 0)), ("v", (2, 2)), ("o", (0, 4)), ("c", (1, 3)), ("p", (20, 1)), ("b", (2,)), ("c2", (1, 2, 3)), ("e", (int(x.max()), 2))):
        up, down = ({n: v.astype(np.float64) for n, v in w.items()} for _ in range(2))
        up[name][place] += 1e-3
        down[name][place] -= 1e-3
        grad, rows = got[name]
        g = grad[list(rows).index(place[0])][place[1]] if name == "e" else grad[place]
        assert g == pytest.approx((loss(up) - loss(down)) / 2e-3, abs=2e-4)


def test_windows_score_each_token_once_and_causally():
    ids = [np.arange(60), np.arange(3), np.zeros(0, int)]
    x, y, owner = attention.windows_of(ids, 299)
    assert [sorted(y[owner == i][y[owner == i] >= 0].tolist()) for i in range(3)] == [t.tolist() for t in ids]
    counts = np.ones(1200)
    of, _ = attention.token_classes(counts)
    w = attention.first_weights(1200, of, counts)
    a = attention.class_log10(w, x, y, of)
    changed = [ids[0].copy(), ids[1], ids[2]]
    changed[0][40:] = 7
    b = attention.class_log10(w, *attention.windows_of(changed, 299)[:2], of)
    assert a[0] == pytest.approx(b[0])  # tokens before the change
    assert np.isclose(a[1][:16], b[1][:16]).all()


def test_classes_add_up_to_one():
    counts = np.random.default_rng(1).integers(0, 9, 5000).astype(float)
    of, within = attention.token_classes(counts)
    assert np.bincount(of, 10.0**within) == pytest.approx(np.ones(attention.CLASSES))


def plain_score(w, of, within, ids):
    """The log10 probability of a text's ids, one id and one head of attention at a time."""
    total, step, context = 0.0, attention.STEP, attention.CONTEXT
    for start in range(0, len(ids), step):
        for i in range(start, min(start + step, len(ids))):
            first = start - context  # the window's first place
            seen = [(j, lm.BEGIN if j == 0 else ids[j - 1]) for j in range(max(first, 0), i + 1)]
            z = np.array([w["e"][t] + w["p"][j - first] for j, t in seen], float)
            q, k, v = z[-1] @ w["q"], z @ w["k"], z @ w["v"]
            a = np.exp(k @ q / math.sqrt(attention.DIM))
            h = z[-1] + (a @ v / a.sum()) @ w["o"]
            g, m = divmod(int(of[ids[i]]), attention.MEMBERS)
            for logits, chosen in ((h @ w["c"] + w["b"], g), (h @ w["c2"][g] + w["b2"][g], m)):
                total += (logits[chosen] - math.log(np.exp(logits).sum())) / math.log(10)
            total += within[ids[i]]
    return total


def test_scores_agree_with_one_id_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(5 + 23 * i, i)) for i in range(6)] + [(50, None), (51, "a")], "doc_id long, text string")
    kept = {}
    train = lm.train

    def keep(*args):
        kept["model"] = train(*args)
        return kept["model"]

    monkeypatch.setattr(lm, "train", keep)
    got = {r["doc_id"]: r["score"] for r in lm.lm_scores(docs, queries.tokenizer()).collect()}
    w, of, within = kept["model"].value
    ids_of = word_ids(queries.tokenizer())
    for r in docs.collect():
        ids = np.append(np.frombuffer(ids_of.of(r["text"] or ""), "<u4"), lm.END).astype(int)
        assert got[r["doc_id"]] == pytest.approx(plain_score(w, of, within, ids.tolist()), rel=1e-4, abs=1e-3)


def test_scores_do_not_depend_on_how_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(lm, "TASK_WORDS", 4000)
    docs = table(spark, "documents").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(7))
    other = docs.orderBy(F.desc(F.xxhash64("text"))).repartition(3)
    one, two = ({r["doc_id"]: r for r in lm.lm_scores(d, queries.tokenizer()).collect()} for d in (docs, other))
    assert one.keys() == two.keys()
    for k, r in one.items():
        assert two[k]["score"] == pytest.approx(r["score"], rel=1e-5)
        assert two[k]["base_score"] == pytest.approx(r["base_score"])


@pytest.mark.parametrize("n", [3, 200])
def test_weights_are_averaged_level_by_level(spark, n):
    share = np.array([1.0, 2.0], np.float32)
    rows = [("e", 0, k, (np.full((2, 3), k, np.float32) * share[:, None]).tobytes(), share.tobytes()) for k in range(n)]
    got = lm.averaged(spark.createDataFrame(rows, lm._SHARE), n).collect()
    assert len(got) == 1
    total, shares = (np.frombuffer(got[0][c], np.float32) for c in ("total", "share"))
    assert total.reshape(2, 3) / shares[:, None] == pytest.approx(np.full((2, 3), (n - 1) / 2))


@pytest.mark.parametrize("common", [400_000, 5])
def test_base_scores_agree_with_brute_force(spark, odd, common, monkeypatch):
    monkeypatch.setattr(lm, "COMMON_WORDS", common)
    docs = odd.where("doc_id is null or doc_id <> 9").select("doc_id", "text").unionByName(table(spark, "documents").select("doc_id", "text").limit(60))
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in docs.collect()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c, n_docs = collections.Counter(w for d, t in rows if not held(d) for w in t), sum(not held(d) for d, _ in rows)
    n = sum(c.values()) + n_docs
    base = math.log10(n + len(c) + 2)
    got = {(r["doc_id"], r["n_tokens"]): r for r in lm.lm_scores(docs, queries.tokenizer()).collect()}
    assert len(got) <= len(rows)
    for d, t in rows:
        r = got[d, len(t) + 1]
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (held(d), sum(c[w] > 0 for w in t) + 1, n)
        if d != 11 and d is not None:
            assert r["base_score"] == pytest.approx(sum(math.log10(c[w] + 1) for w in t) + math.log10(n_docs + 1) - base * (len(t) + 1))
        assert r["score"] < 0


@pytest.mark.parametrize("n_words", [1000, 64_000_000])
def test_model_learns_from_every_training_text_once(spark, n_words, monkeypatch):
    docs = spark.createDataFrame([(i if i % 50 else None, f"text {i}") for i in range(400)], "doc_id long, text string")
    texts, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(path, model):
        def run(batches):
            for batch in batches:
                texts.add(batch.num_rows)
                total.add(sum(int(t.split()[1]) for t in batch.column(0).to_pylist()))
            yield from ()

        return run

    monkeypatch.setattr(lm, "_train", counted)
    lm.train(docs, queries.tokenizer(), np.ones(lm.TOKENS), n_words)
    assert (texts.value, total.value) == (400, sum(range(400)))


def test_more_partitions_train_no_more_weights(spark, monkeypatch):
    # Each partition that had texts trained and sent weights of its own, up to the cluster's number of partitions.
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
    parts, texts = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(path, model):
        def run(batches):
            n = sum(b.num_rows for b in batches)
            parts.add(n > 0)
            texts.add(n)
            yield from ()

        return run

    monkeypatch.setattr(lm, "_train", counted)
    plain = type(docs).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda self, n, *by: plain(self, max(n, 32), *by))
    lm.train(docs, queries.tokenizer(), np.ones(lm.TOKENS), 3 * lm.ROUNDS * lm.TASK_WORDS)
    assert (parts.value, texts.value) == (3 * lm.ROUNDS, 400)


def test_texts_are_encoded_by_word_as_the_tokenizer_encodes_them_whole(monkeypatch):
    monkeypatch.setattr(lm, "_ENCODE_BYTES", 40)
    texts = ["", "  The Cat\x0bsat,\x1con\x85the mat. ", "\n \n", "İstanbul ΑΣ 日本語 the THE", "the the zzqx Zzqx don't", " ".join(map(str, range(90)))]
    path, known = queries.tokenizer(), [b"the", b"cat"]

    class Common:
        value = (pa.array(known, pa.binary()), np.array([0.5, 2.0]), lm._of_words(known, word_ids(path)))

    n = len(texts)
    columns = [pa.array(range(n)), pa.array(range(n)), pa.array([False] * n), pa.array(range(n)), pa.array([len(t) for t in texts]), pa.array(texts)]
    batch = pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "held_out", "order", "size", "text"])
    got = [r for b in lm._encode(path, Common, 3.0)(iter([batch])) for r in b.to_pylist()]
    assert [r["rid"] for r in got] == list(range(n))
    for r, text in zip(got, texts, strict=True):
        w = lm.words(text)
        assert np.frombuffer(r["ids"], "<u2").tolist() == np.frombuffer(word_ids(path).of(text), "<u4").tolist()
        assert (r["n_tokens"], r["n_known"], r["rare"]) == (len(w) + 1, sum(x in known for x in w), [x for x in w if x not in known])
        assert r["base_score"] == pytest.approx(sum({b"the": -2.5, b"cat": -1.0}.get(x, 0) for x in w))


def test_training_takes_encoded_texts_and_needs_no_tokenizer_for_them(spark, monkeypatch):
    # Each text was encoded again in training and in scoring.
    monkeypatch.setattr(lm, "TASK_WORDS", 300)
    docs = spark.createDataFrame([(i, prose(40, i)) for i in range(20)], "doc_id long, text string")
    path = queries.tokenizer()
    ids = [(r["doc_id"], bytearray(np.frombuffer(word_ids(path).of(r["text"]), "<u4").astype("<u2").tobytes())) for r in docs.collect()]
    encoded = docs.select("doc_id", *lm._by_text()).join(spark.createDataFrame(ids, "doc_id long, ids binary"), "doc_id")
    one, two = (lm.train(d, p, np.ones(lm.TOKENS), 800).value[0] for d, p in ((docs, path), (encoded, "/nowhere")))
    for name in one:
        assert one[name] == pytest.approx(two[name], abs=1e-5), name


def test_products_over_rows_leave_out_no_row():
    rng = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 300):
        a, b = rng.standard_normal((n, 24)), rng.standard_normal((n, 32))
        assert attention._over_rows(a, b) == pytest.approx(a.T @ b)


# Edges


@pytest.mark.parametrize("kind", ["odd", "nothing"])
def test_operators_and_stages_take_any_table(spark, kind, request):
    import corpus_pipeline

    docs = request.getfixturevalue(kind)
    rows = docs.count()
    labels = spark.createDataFrame([(1, None, 1), (None, 0, 1), (7, 1, None), (8, 1, 0)], "doc_id long, quality int, toxic int")
    bench = table(spark, "benchmark")
    for found in (repeats.suffix_dedup(docs), chunks.substring_dedup(docs), jaccard.jaccard_join(docs), quality.quality_rules(docs), toxicity.toxicity(docs, labels), lm.lm_scores(docs, queries.tokenizer())):
        assert found.count() == rows
    assert decontamination.benchmark_matches(docs, bench).count() == 0
    assert packing.pack(docs, queries.tokenizer()).groupBy("doc_id").count().count() == docs.select("doc_id").distinct().count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() <= rows
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.lit(None).cast("string").alias("url"), "path", "host", "rule", "key")
    assert wrappers.main_text(pages).count() == rows
    rules = spark.createDataFrame(list(url_rules.RULES), "verdict string, host string, path string")
    assert url_rules.judge_urls(pages, rules).count() == rows
    assert url_rules.judge_urls(pages, rules.limit(0)).count() == rows


def test_pipeline_agrees_with_brute_force(spark):
    """The whole pipeline over again in plain Python: rules, all pairs, chunks, edit distances, and ids by the tokenizer."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = {r["doc_id"]: r for r in table(spark, "documents").collect()}
    assert len(docs) == table(spark, "documents").count()
    norm = lambda line: " ".join(WORD.findall(line)).lower()
    lines = {d: [norm(x) for x in (r["text"] or "").split("\n") if WORD.search(x)] for d, r in docs.items()}
    often = collections.defaultdict(set)
    for d, x in lines.items():
        for line in x:
            often[docs[d]["source"], line].add(tuple(x))
    texts = {}
    for d, r in docs.items():
        w = WORD.findall(r["text"] or "")
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
        gone = lambda line, r=r: len(often[r["source"], norm(line)]) > 30
        left = sum(len(WORD.findall(x)) for x in (r["text"] or "").split("\n") if not gone(x))
        if len(w) >= 50 and 2 * len(covered) <= len(w) and left >= 0.3 * len(w):
            texts[d] = "\n".join(x for x in r["text"].split("\n") if not gone(x))

    hashes = jaccard.WordHashes()
    sets = {d: jaccard.shingles(t, hashes) for d, t in texts.items()}
    group = {d: d for d in texts}
    for i, a in enumerate(ids := sorted(texts)):
        for b in ids[i + 1 :]:
            if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    texts = {d: texts[d] for d in sorted(set(group.values()))}

    seen = set()
    for d in sorted(texts):
        data, last, parts = texts[d].encode(), 0, []
        for end in chunks.cuts(data):
            if data[last:end] in seen:
                parts.append({"start": last, "length": end - last})
            seen.add(data[last:end])
            last = end
        kept, last = [], 0
        for start, length in chunks.runs_of(parts):
            whole_at = lambda i, data=data: next(j for j in range(i, len(data) + 1) if j == len(data) or data[j] & 0xC0 != 0x80)
            kept.append(data[last : whole_at(start) if start else 0])
            last = whole_at(start + length)
        texts[d] = (b"".join(kept) + data[last:]).decode()

    items = [decontamination.normal(r["text"] or "") for r in table(spark, "benchmark").collect()]
    for d in list(texts):
        t = decontamination.normal(texts[d])
        for item in filter(None, items):
            k = int(0.08 * len(item))
            pieces = [item[j * len(item) // (k + 1) : (j + 1) * len(item) // (k + 1)] for j in range(k + 1)]
            if any(p in t for p in pieces) and levenshtein_in(item, t) <= k:
                del texts[d]
                break

    t = Tokenizer.from_file(queries.tokenizer())
    want = collections.Counter()
    for d, text in texts.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.update((d, a, len(p), zlib.crc32(p.tobytes()), len(ids)) for a in range(0, len(ids), 4096) for p in [ids[a : a + 4096]])
    got = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want


def test_recall_of_the_jaccard_join_against_all_pairs(spark):
    """On the whole table of sf0.01: links between different texts, found by an inverted index over all n-grams."""
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    hashes, sets, copies = jaccard.WordHashes(), {}, collections.Counter()
    for r in docs.select("text").collect():
        copies[r["text"] or ""] += 1
    for text in copies:
        sets[text] = jaccard.shingles(text, hashes)
    places = collections.defaultdict(list)
    for text, s in sets.items():
        for x in s.tolist():
            places[x].append(text)
    shared = collections.Counter()
    for found in places.values():
        for i, a in enumerate(found):
            for b in found[i + 1 :]:
                shared[a, b] += 1
    links = collections.Counter({t: c - 1 for t, c in copies.items() if len(sets[t])})
    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += copies[b]
            links[b] += copies[a]
    want = sum(copies[t] * n for t, n in links.items())
    got = jaccard.jaccard_join(docs).agg(F.sum("n_links")).head()[0]
    print("links", got, "of", want)
    assert 0.98 * want <= got <= want
