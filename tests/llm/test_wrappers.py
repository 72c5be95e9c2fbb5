"""Templates, frames, folding and alignment of wrappers against plain counterparts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from glimmer.llm import wrappers

WIDE = "page_id long, url string, html string"
NOTICE = "We have moved to a new building and answer letters a little later"
LEGAL = " ".join(f"clause{i}" for i in range(120))


def own(seed, n=30):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(n))


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, WIDE)).collect()}


def test_notices_on_most_pages_and_long_legal_texts_go(spark):
    rows, want = [], {}
    for host in range(4):
        off = set(random.Random(host).sample(range(200), 10))
        for i in range(200):
            n = 1000 * host + i
            rows.append((n, f"http://h{host}.org/{i}", f"<body><article><h1>{own(n, 4)}</h1>{'' if i in off else f'<div>{NOTICE}</div>'}<p>{own(n)}</p></article></body>"))
            want[n] = f"{own(n, 4)}\n{own(n)}"
    for i in range(40):
        n = 10_000 + i
        rows.append((n, f"http://legal.org/{i}", f"<body><article><p>{own(n)}</p><div>{LEGAL}</div></article></body>"))
        want[n] = own(n)
    assert texts(spark, rows) == want


def test_near_copies_of_a_page_are_no_template(spark):
    """Each copy has a word of another paragraph changed; nineteen in twenty have each paragraph as it was."""
    first = [own(i) for i in range(20)]
    rows, want = [], {}
    for i in range(40):
        paragraphs = list(first)
        paragraphs[i % 20] = paragraphs[i % 20].replace(" ", f" {'xyz'[i % 3]}{i} ", 1)
        rows.append((i, f"http://copies.org/{i}", "<article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>"))
        want[i] = "\n".join(paragraphs)
    assert texts(spark, rows) == want


def test_forms_count_by_what_they_hold():
    assert wrappers.extract(f"<body><form id='aspnetForm'><nav>menu</nav><div><h1>T</h1><p>{own(1)}</p></div></form></body>") == f"T\n{own(1)}"
    assert wrappers.extract(f"<body><form><div><article><p>{own(1)}</p></article></div></form><div>{own(2, 40)}</div></body>") == own(1)
    assert wrappers.extract("<body><form><label>Name</label></form></body>") == ""
    assert wrappers.extract(f"<body><div><p>{own(1)}</p><form><h1>Join us</h1><p>Your name</p></form></div></body>") == own(1)
    assert wrappers.extract(f"<body><div class=sidebar><form><h1>Join us</h1></form></div><p>{own(1)}</p></body>") == own(1)
    assert wrappers.extract(f"<body><object><p>{own(1)}</p></object></body>") == own(1)


@pytest.mark.parametrize("seed", range(3))
def test_templates_are_those_of_a_plain_count(spark, seed):
    r = random.Random(seed)
    rows = []
    for n in range(300):
        blocks = [f"<div>{t}</div>" for t, share in (("alpha beta", 0.97), ("gamma delta", 0.9), ("eps zeta", 0.8)) if r.random() < share]
        blocks += [f"<p>{own(n)}</p>"] * r.randint(1, 2) + ["<ul><li>rare thing</li></ul>"] * (r.random() < 0.05) + ["<h2>Read on</h2>"]
        r.shuffle(blocks)
        rows.append((n, f"http://h{n % (2 + 3 * seed)}.org/", f"<body>{''.join(blocks)}</body>"))
    rows += rows[:50]  # repeated pages count once
    pages: dict[str, set[str]] = {}
    for _, url, page in rows:
        pages.setdefault(url.split("/")[2], set()).add(page)
    want = {}
    for host, htmls in pages.items():
        had: dict[tuple, set[str]] = {}
        for page in htmls:
            path = ()
            for kind, what, _ in wrappers.tokens(wrappers.parse(page)):
                if kind > 0:
                    path = (*path, what)
                elif kind < 0:
                    path = path[:-1]
                else:
                    had.setdefault((path, what), set()).add(page)
        places: dict[tuple, set[str]] = {}
        for (path, _), having in had.items():
            places.setdefault(path, set()).update(having)
        marks = set()
        for (path, what), having in had.items():
            if len(having) >= 3 and 10 * len(having) >= 9 * len(places[path]) and 100 * len(places[path]) >= len(htmls):
                at = 0
                for key in path:
                    at = wrappers.below(at, key)
                marks.add(wrappers._mark(at, what))
        want[host] = sorted(marks)
    df = spark.createDataFrame(rows, WIDE)
    got = {x["host"]: x["template"] for x in wrappers.infer_wrappers(df).collect()}
    assert got == want
    assert {x["host"]: x["template"] for x in wrappers.infer_wrappers(df.repartition(5, F.rand(seed))).collect()} == want


def test_a_few_pages_and_a_rare_place_have_no_template(spark):
    two = [(i, "http://two.org/", f"<article><p>{own(i)}</p><div>{NOTICE}</div></article>") for i in range(2)]
    assert texts(spark, two) == {i: f"{own(i)}\n{NOTICE}" for i in range(2)}
    rare = [(i, "http://many.org/", f"<article><p>{own(i)}</p>{f'<div>{NOTICE}</div>' if i < 3 else ''}</article>") for i in range(400)]
    got = texts(spark, rare)
    assert got[0] == f"{own(0)}\n{NOTICE}" and got[5] == own(5)


def squares(keys):
    """Whether any stretch of keys follows itself."""
    return any(keys[i : i + w] == keys[i + w : i + 2 * w] for w in range(1, len(keys) // 2 + 1) for i in range(len(keys) - 2 * w + 1))


def unfolded(parts):
    return [k for p in parts for k in (unfolded(p.children) if p.key.startswith("(") else [p.key])]


@pytest.mark.parametrize("seed", range(30))
def test_folded_streams_have_no_repeats_left(seed):
    r = random.Random(seed)
    keys = [r.choice("abcd"[: r.randint(2, 4)]) for _ in range(r.randint(0, 60))]
    folded = wrappers._folded([wrappers.Part(k, mass=1) for k in keys])
    assert not squares([p.key for p in folded])
    rest = iter(keys)
    assert all(k in rest for k in unfolded(folded))  # a unit of each group, in the order of the stream

    def mass(parts):
        return sum(p.mass + mass(p.children) for p in parts)

    assert mass(folded) == len(keys)


@pytest.mark.parametrize("seed", range(30))
def test_repeats_are_those_of_a_plain_search(seed):
    r = random.Random(seed)
    text = "".join(r.choice("ab" if seed % 2 else "abc") for _ in range(50)) + "abcde" * 4 + "x"
    for width in range(1, 20):
        want, i = [], 0
        while i + 2 * width <= len(text):
            n = 1
            while text[i + n * width : i + (n + 1) * width] == text[i : i + width]:
                n += 1
            if n > 1:
                want.append((i, n))
            i += n * width if n > 1 else 1
        assert list(wrappers._repeats(text, text[::-1], width)) == want


@pytest.mark.parametrize("seed", range(20))
def test_matches_rise_and_are_equal(seed):
    r = random.Random(seed)
    a = [r.choice("abcdefgh") for _ in range(r.randint(0, 30))]
    b = [k for k in a if r.random() < 0.8]
    for _ in range(3):
        b.insert(r.randint(0, len(b)), r.choice("abxy"))
    found = wrappers._matched(a, b)
    assert all(a[i] == b[j] for i, j in found)
    assert all(i < x and j < y for (i, j), (x, y) in zip(found, found[1:], strict=False))
    assert wrappers._matched(a, a) == [(i, i) for i in range(len(a))]
    assert wrappers._matched(list("pqr"), list("xpqyr")) == [(0, 1), (1, 2), (2, 4)]


def test_wide_pages_take_little_time():
    r = random.Random(5)
    pages = ["<body>" + "".join(f"<{t}>text {i}</{t}>" for i, t in enumerate(r.choices("p div ul table pre h2 blockquote".split(), k=8000))) + "</body>" for _ in range(2)]
    pairs = "<body>" + "<p>a</p><div>b</div>" * 20_000 + "</body>"
    start = time.process_time()
    a, b = (wrappers.outline(wrappers.tokens(wrappers.parse(p))) for p in pages)
    assert wrappers.merge(a, b).pages == 2
    assert wrappers.expression(wrappers.outline(wrappers.tokens(wrappers.parse(pairs)))) == "<body>(<p>=</p><div>=</div>)+</body>"
    assert time.process_time() - start < 10
    assert len(wrappers.extract(pages[0]).split("\n")) == 8000
