import random

import pytest

CLASHES = ["th", "k", "_k", "row", "gone", "parts", "id", "id1", "rid", "h", "host", "label", "copies", "spans", "words", "w", "lines", "name", "start", "length", "rank", "key", "path", "rule", "x", "score", "c", "n", "bands", "root"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def prose(n, seed):
    r = random.Random(seed)
    syllables = "an be co du el fa gi ho in jo ka le mi no or pu qua re si tu".split()
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(2, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls everywhere, empty and long texts, repeated rows, equal ids, ties and clashing columns."""
    shared = prose(120, 99)
    texts = [(1, prose(200, 1)), (2, None), (3, ""), (4, " \n\t "), (None, prose(90, 2)), (None, None), (5, prose(80, 3)), (5, prose(80, 3)), (6, prose(80, 3)), (7, prose(60, 4) + "\n" + shared), (8, shared + "\n" + prose(70, 5)), (9, prose(60_000, 6)), (10, "é" * 5000), (11, "a" * 9000), (11, prose(70, 7)), (12, "one"), (13, "one"), (14, prose(100, 8)), (15, prose(99, 8)), (16, "Ünï <b> ' \" \\ \x00 \x1f 🙂")]
    rows = [(i, t, None if n % 5 == 0 else "en", None if n % 4 == 0 else f"src{n % 3}", None if t is None else len(t), *["z"] * len(CLASHES)) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
