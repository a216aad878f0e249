"""Author pairs compared inside their blocks, against letter by letter comparisons of all pairs."""

import random
import re
from itertools import combinations

import numpy as np

from tributary.operators import blocks, similarity


def people(n: int) -> list[tuple]:
    r = random.Random(5)
    given, family = ["Ann", "Ána", "Otto", "陳", "Jean-Luc", "x" * 70], ["Berg", "bergh", "O'Hara", "Łuka", "w" * 66, "ann", ""]
    rows = []
    for k in range(n):
        name = r.choice([f"{r.choice(given)}  {r.choice(family)}{r.randrange(9) or ''}", f"{r.choice(family)} {r.choice(given)}", " ", "."])
        rows.append((r.choice(["a", "a", "b"]), k, name, r.choice(["@x", f"{r.choice(given).lower()}{r.randrange(5)}@x.org", " ann@Y ", f"u{k}", ""])))
    return rows + [("b", n, None, "ann@z"), ("b", n + 1, "Ann Berg", None)]


def parts(name: str | None, email: str | None) -> dict:
    n = re.sub(r"\s+", " ", name or "").strip(" ").lower()
    fn, ln, ee = n.split(" ")[0], n.split(" ")[-1], (email or "").strip(" ").lower()
    words = lambda x: " ".join(re.findall(r"[^\W_]+", x))
    return {"n": n, "fn": fn, "ln": ln, "un": ee.split("@")[0], "e": ee, "fw": words(fn), "lw": words(ln)}


def paired(rows: list[tuple]) -> dict:
    got = {}
    for x, y in combinations(rows, 2):
        a, b = parts(*x[2:]), parts(*y[2:])
        if x[0] == y[0] and {a["fn"], a["ln"], a["un"]} & {b["fn"], b["ln"], b["un"]} - {""}:
            got[x[1], y[1]] = a, b
    return got


def test_texts_as_bits_match_letter_by_letter():
    r = random.Random(2)
    texts = np.array(["".join(r.choice("abcé漢") for _ in range(r.choice([0, 1, 2, 4, 7, 9, 20, 33, 64, 65, 80]))) for _ in range(90)], dtype=object)
    for some in (texts, texts[[len(t) <= 32 for t in texts]]):
        x, y = (k.ravel() for k in np.indices((len(some), len(some))))
        for k in (slice(None), slice(0, 40)):  # few texts in many pairs, and the other way round
            assert blocks.Winkler(some, some)(x[k], y[k]).tolist() == [similarity.winkler(some[i], some[j]) for i, j in zip(x[k], y[k])]


def test_features_of_all_pairs_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CELL_PART", 9)
    rows = people(160)
    df = spark.createDataFrame(rows, "project string, k long, author_name string, author_email string")
    got = blocks.pair_features(df, "project", "k", "author_name", "author_email").collect()
    w, want = similarity.winkler, {}
    for k, (a, b) in paired(rows).items():
        s = lambda x, y=None: w(a[x], b[y or x])  # noqa: B023, E731
        want[k] = (s("n"), s("e") if a["e"] and b["e"] else 0.0, s("ln"), s("fn"), s("un"), max(s("fn", "ln"), s("ln", "fn")), s("lw"), s("fw"))
    assert len(got) == len(want) > 1000 and {(r["k1"], r["k2"]): tuple(r[c] for c in blocks.FEATURES) for r in got} == want


def test_pairs_are_neither_joined_nor_shuffled(spark):
    """Of one block of many authors each author is shuffled once, however many pairs there are."""
    df = spark.range(900).selectExpr("'p' AS project", "id AS k", "concat('Ann b', id) AS author_name", "concat('c', id, '@x') AS author_email")
    cells = blocks.block_cells(df, "project", "k", "author_name", "author_email")
    assert cells.count() == 900 and blocks.pair_features(df, "project", "k", "author_name", "author_email").count() == 900 * 899 // 2


def test_message_similarity_of_all_pairs_matches_brute_force(spark, monkeypatch):
    r, rows = random.Random(6), people(150)
    words = {k: r.sample(range(-40, 40), r.randrange(1, 25)) for k in range(150) if k % 7}
    profiles = [(k, ws, [r.choice([1, 2, 5, 9000]) for _ in ws]) for k, ws in words.items()]
    a = spark.createDataFrame(rows, "project string, k long, author_name string, author_email string")
    p = spark.createDataFrame(profiles, "k long, words array<long>, counts array<int>")
    bows, want = {k: dict(zip(w, c)) for k, w, c in profiles}, {}
    for x, y in paired(rows):
        u, v = bows.get(x, {}), bows.get(y, {})
        dot, norm = sum(u[w] * v[w] for w in u if w in v), np.sqrt(sum(c * c for c in u.values())) * np.sqrt(sum(c * c for c in v.values()))
        want[x, y] = dot / norm if dot else 0.0
    monkeypatch.setattr(blocks, "CELL_PART", 9)
    got = blocks.message_similarity(a, p, "project", "k", "author_name", "author_email").collect()
    assert len(got) == len(want) and {(q["k1"], q["k2"]): q["d2vsim"] for q in got} == want


def test_products_in_parts(monkeypatch):
    monkeypatch.setattr(blocks, "ENTRIES", 5)
    r = np.random.default_rng(1)
    table = r.integers(0, 3, (12, 9)) * r.integers(1, 50, (12, 9))
    end = np.array([4] * 4 + [5] + [12] * 7)
    row, word = np.nonzero(table)
    x, y = blocks.partners(end, 0, 12)
    assert blocks.products(end, 0, 12, row, word, table[row, word].astype(float)).tolist() == [float(table[i] @ table[j]) for i, j in zip(x, y)]


def test_rounding_as_sql_does():
    assert blocks.rounded(np.array([0.1234565, 0.12345649, 1.0, 0.0]), 6).tolist() == [0.123457, 0.123456, 1.0, 0.0]
