import random

import pytest

from tributary.llm import leakage as L
from tributary.llm import mixing

rng = random.Random(3)
VOCAB = ["w" + "".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(900)]
SHARED = "read the note and choose one answer for this test now".split()


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(5)
    items = [(i, " ".join((SHARED if i % 3 == 0 else []) + [r.choice(VOCAB) for _ in range(40)])) for i in range(40)]
    items.append((90, "".join(chr(0x4E00 + r.randrange(400)) for _ in range(60))))
    docs = []
    for d in range(400):
        words = [r.choice(VOCAB[:300]) if r.random() < 0.5 else r.choice(SHARED + VOCAB[300:320]) for _ in range(r.randrange(5, 150))]
        if d % 5 == 0:
            t = r.choice(items[:40])[1].split()
            n = r.choice([8, 9, 10, 11, 20])
            a = r.randrange(len(t) - n)
            at = r.randrange(len(words))
            words[at:at] = [w.upper() + "," for w in t[a : a + n]]
        docs.append((d, " ".join(words)))
    zh = items[-1][1]
    docs += [(900, "x。" + "，".join(zh[5:27]) + "。y"), (901, zh[5:24]), (902, ""), (903, None), (904, " ".join(SHARED)), (905, "z " * 30_000 + " ".join(items[1][1].split()[3:20]))]
    return docs, items


def brute(docs, items):
    out = set()
    for k, t in items:
        wide = bool(L._WIDE.search(t))
        u, n = (L.letters(t), 20) if wide else (L.words(t), 10)
        runs = {tuple(u[i : i + n]) for i in range(len(u) - n + 1)}
        for d, x in docs:
            if x:
                v = L.letters(x) if wide else L.words(x)
                if any(tuple(v[i : i + n]) in runs for i in range(len(v) - n + 1)):
                    out.add((d, k))
    return out


def test_leaks_match_brute_force(spark, data):
    docs, items = data
    got = L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in got.where("run_found").collect()}
    want = brute(docs, items)
    assert found == want and len(want) > 20


def test_no_items_no_documents(spark, data):
    docs, items = (spark.createDataFrame(x, f"{k} long, text string") for x, k in zip(data, ("doc_id", "item_id")))
    assert L.leaks(docs.limit(0), items).count() == 0 and L.leaks(docs, items.limit(0)).count() == 0


def test_sequence_measures():
    assert L.common_subsequence(list("abcde"), list("axcye")) == 3 and L.longest_run(list("abcde"), list("zbcdx")) == 3
    assert L.common_subsequence([], list("a")) == 0 and L.longest_run([], []) == 0


def sized(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long")


TARGETS = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)]


def test_shares_are_met_within_a_document(spark):
    r = random.Random(1)
    rows = [(i, "abc"[min(2, int(r.random() ** 2 * 3))], r.randrange(1, 200)) for i in range(3000)] + [(9001, None, 50), (9002, "zzz", 50), (9003, "a", 0)]
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeat int")
    m = mixing.mixture(sized(spark, rows), t)
    got = m.collect()
    assert len({x["doc_id"] for x in got}) == len(got) and all(1 <= x["times"] <= dict((s, k) for s, _, k in TARGETS)[x["source"]] for x in got)
    rep = {x["source"]: x for x in mixing.share_report(m, t).collect()}
    assert all(abs(rep[s]["share"] - w) < 0.005 for s, w, _ in TARGETS)
    have = {s: sum(x[2] for x in rows if x[1] == s) for s, _, _ in TARGETS}
    size = min(have[s] * k / w for s, w, k in TARGETS)
    assert abs(sum(x["tokens"] for x in rep.values()) - size) < 700


def test_missing_source_and_empty_table(spark):
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeat int")
    assert mixing.mixture(sized(spark, [(1, "a", 10)]), t).count() == 0
    assert mixing.mixture(sized(spark, []), t).count() == 0
    assert [r["tokens"] for r in mixing.share_report(mixing.mixture(sized(spark, []), t), t).collect()] == [0, 0, 0]


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "a " * 20_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in mixing.token_counts(df, "doc_id", "text").collect()}
    assert got[1] > 0 and got[2] == got[3] == 0 and got[4] >= 20_000
