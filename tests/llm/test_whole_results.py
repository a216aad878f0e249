"""Whole results where earlier forms of the operators left rows out."""

import random

from tributary.llm import leakage, mojibake


def test_paraphrases_match_brute_force(spark):
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(700)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([12, 20, 45])))) for i in range(30)]
    docs = []
    for k in range(240):
        words = [f"x{r.randrange(10**6)}" for _ in range(r.choice([20, 20, 40, 70]))]
        seq = items[k % 30][1].split()[:20]
        kept = sorted(r.sample(range(len(seq)), min(len(seq), r.choice([5, 7, 8, 9, 10]))))
        at = r.choice(range(0, len(words) - 19, 10))
        for place, i in zip(sorted(r.sample(range(at, at + 20), len(kept))), kept):
            words[place] = seq[i]
        if k % 4 == 0 and len(words) == 70 and at < 40:
            words[60:64] = seq[:4]  # a second passage, of other cosine and shorter subsequence
        docs.append((k, " ".join(words)))
    want = {}
    for d, t in docs:
        u = leakage.words(t)
        for i, x in items:
            q = leakage.words(x)
            lcs = max(leakage.common_subsequence(q, u[a:b]) / min(len(q), b - a) for a, b in leakage.windows(len(u), False))
            if lcs >= 0.4:
                want[d, i] = round(lcs, 6)
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).where("lcs_share >= 0.4").collect()
    assert {(x["doc_id"], x["item_id"]): round(x["lcs_share"], 6) for x in got} == want and len(want) > 60
    assert any(x["cosine"] <= 0.35 for x in got)


def test_margin_is_validated_on_rows_of_all_hashes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(mojibake, "best_origin", lambda x, model: seen.append(x) or (1.0, x, "cp1252<utf-8"))
    monkeypatch.setattr(mojibake, "surely_clean", lambda x: True)
    rows = [(i, f"é{i}" if i % 2 else f"e{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, t string")
    mojibake.validated_margin(df, ["t"], None)
    assert set(seen) == {t for _, t in rows if not t.isascii()}
    seen.clear()
    monkeypatch.setattr(mojibake, "VALIDATION_ROWS", 100)
    mojibake.validated_margin(df, ["t"], None)
    assert 60 < len(seen) < 140


def test_planted_paraphrases_are_found_and_chance_orders_are_not(spark):
    """Items reworded by dropping, replacing and moving words, in documents that are full of the items' frequent words."""
    r = random.Random(23)
    common = [f"the{i}" for i in range(25)]
    rare = [f"term{i}" for i in range(4000)]
    sentence = lambda n: [r.choice(common) if i % 2 else r.choice(rare) for i in range(n)]
    items = [(i, sentence(r.choice([22, 30, 44]))) for i in range(60)]
    docs, planted = [], set()
    for d in range(600):
        words = [r.choice(common) if r.random() < 0.6 else r.choice(rare) for _ in range(r.randrange(30, 160))]
        if d % 4 == 0:
            k, seq = items[d // 4 % 60]
            a = r.randrange(len(seq) - 18)
            part = [r.choice(common) if r.random() < 0.2 else w for w in seq[a : a + 18] if r.random() > 0.15]
            i = r.randrange(len(part) - 1)
            part[i], part[i + 1] = part[i + 1], part[i]
            at = r.randrange(len(words))
            words[at:at] = part
            planted.add((d, k))
        docs.append((d, " ".join(words)))
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(s)) for k, s in items], "item_id long, text string"))
    rows = got.collect()
    found = {(x["doc_id"], x["item_id"]) for x in rows if x["run_found"] or x["lcs_share"] >= leakage.SHARE and x["answer_share"] >= leakage.ANSWER}
    loose = {(x["doc_id"], x["item_id"]) for x in rows if x["lcs_share"] >= leakage.SHARE}
    print("recall", len(found & planted) / len(planted), "precision", len(found & planted) / len(found), "without the answer check", len(loose & planted) / len(planted), len(loose & planted) / len(loose))
    assert len(found & planted) >= 0.9 * len(planted) and len(found & planted) >= 0.9 * len(found)
