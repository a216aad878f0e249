import itertools

from tributary.llm import names as N

GIVEN = "robert anna maria karl ivo noor greta hugo lena omar paula tariq".split()
FAMILY = "kastelruth brondaric wimmerlow tolvanica schurimann gadovesky pelturino marvelokko duskanelli fraimoveri hollunder zibakurt quandorel mitravesk osterlein".split()


def people():
    """Rows of twelve given names in fifteen families, all different people, under shared mail domains."""
    rows, truth, k = [], {}, 0
    for i, (g, f) in enumerate(itertools.product(GIVEN, FAMILY)):
        if (i * 7) % 3:
            continue
        who = f"{g} {f}"
        forms = [(f"{g.title()} {f.title()}", f"{g}.{f}@mail{i % 3}.example"), (f"{f.title()}, {g.title()}", f"{f}_{g}@mail{(i + 1) % 3}.example"), (f"{g.title()} {f.title()}", None)]
        for n, e in forms:
            rows.append((k, "p", n, e))
            truth[k] = who
            k += 1
    return rows, truth, k


def link(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, project string, author_name string, author_email string")
    return {r["row_id"]: r["entity"] for r in N.link_variants(df).collect()}


def test_variants_of_people_are_linked_and_namesakes_are_not(spark):
    rows, truth, k = people()
    extra = [("Bob Kastelruth", None, "robert kastelruth"), ("Robert Kastelrutth", None, "robert kastelruth"), ("Роберт Каstelruth".replace("Каstelruth", "Кастелрутх"), None, "robert kastelruth"), ("R. Kastelruth", "noreply@forge.example", None)]
    for n, e, who in extra[:3]:
        rows.append((k, "q", n, e))
        truth[k] = who
        k += 1
    got = link(spark, rows)
    assert set(got) == set(truth)
    by: dict = {}
    for r, who in truth.items():
        by.setdefault(who, set()).add(got[r])
    assert all(len(v) == 1 for v in by.values()), {w: v for w, v in by.items() if len(v) > 1}
    assert len({next(iter(v)) for v in by.values()}) == len(by)


def test_placeholders_blanks_and_repeats(spark):
    rows, truth, k = people()
    odd = [("unknown", "root@localhost"), (None, None), ("", "none"), ("updatebot[bot]", "noreply@forge.example")]
    rows += [(k + i, "p", *x) for i, x in enumerate(odd)]
    rows += [(k + 10, "p", "Walrus9zq", None), (k + 11, "p", "Walrus9zq", None), (k + 12, "p", "x" * 50_000, None)]
    got = link(spark, rows)
    assert not any(k + i in got for i in range(len(odd)))
    assert got[k + 10] == got[k + 11] == k + 10 and got[k + 12] == k + 12
    assert link(spark, []) == {}


def test_pairs_have_the_smaller_row_first(spark):
    df = spark.createDataFrame([(3, 1, 3), (1, 1, 3), (2, 1, 3), (9, 9, 1)], "row_id long, entity long, entity_rows long")
    assert {tuple(r) for r in N.same_entity_pairs(df).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_banding_follows_the_collision_curve():
    b, r = N.banding(0.5, 0.95, 200)
    assert b * r <= 200 and 1 - (1 - 0.5**r) ** b >= 0.95 and 1 - (1 - 0.5 ** (r + 1)) ** (200 // (r + 1)) < 0.95


def test_star_clusters_match_brute_force(spark):
    edges = [(1, 2, 0.9), (2, 3, 0.95), (3, 4, 0.9), (5, 6, 1.0)]
    v = spark.createDataFrame([(i, 1) for i in range(1, 8)], "v long, size long")
    got = {r["v"]: r["center"] for r in N.star_clusters(v, spark.createDataFrame(edges, "a long, b long, w double")).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 4, 5: 5, 6: 5, 7: 7}


def test_monge_elkan_and_given_names():
    s = N.sound
    assert N.given_fit(s("robert"), s("bob")) > 0.9 and N.given_fit("r", s("robert")) == 0.9 and N.given_fit(s("anna"), s("karl")) == 0
    assert N.agree("anna", "kastelruth", "anna", "kastelrutth") > N.MONGE and N.agree("anna", "kastelruth", "karl", "kastelruth") == 0
    assert N.edits("abcd", "abdc") == 1


def test_buckets_dealt_out_in_parts_give_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(N, "BUCKET_PART", 3)
    rows = [("a", f"x{i}") for i in range(20)] + [("b", "x1"), ("b", "x2"), ("b", "y"), ("c", "z")]
    got = [tuple(r) for r in N.meet(spark.createDataFrame(rows, "k string, v string"), "k", "v").collect()]
    want = {(a, b) for k in "abc" for a in {v for c, v in rows if c == k} for b in {v for c, v in rows if c == k} if a < b}
    assert len(got) == len(set(got)) and set(got) == want
    e = spark.createDataFrame([(i, 0, 11) for i in range(11)] + [(20, 20, 1)], "row_id long, entity long, entity_rows long")
    pairs = [tuple(r) for r in N.same_entity_pairs(e).collect()]
    assert len(pairs) == len(set(pairs)) == 55


def test_lexicon_does_not_depend_on_the_size_of_the_table(spark):
    """Ten times as many people of the same given names: the same words are given names, mistyped ones are not."""
    for people in (20, 200):
        rows = [(g, "fam" + "abcdefghij"[i % 10] * 3 + f"{(k * people + i) // 2}x") for k, g in enumerate(GIVEN) for i in range(people)]
        rows += [("robret", f) for g, f in rows[: people // 20 + 4]]
        both = rows + [(b, a) for a, b in rows]
        assert N.lexicon_words(spark.createDataFrame(both, "one string, other string")) == set(GIVEN)


def test_candidates_of_short_names_swaps_and_first_letters(spark):
    """Pairs the bands alone may miss: swapped letters in short names, a mistyped given name beside a mistyped family name, nicknames and their initials."""
    pairs = [(("anna", "berk"), ("anna", "brek")), (("karl", "lindt"), ("karl", "lidnt")), (("robert", "kastelruth"), ("tobert", "kastelrutth")), (("b", "wimmerlow"), ("william", "wimerlow")), (("bill", "tolvanica"), ("will", "tolvanika"))]
    forms = sorted({x for p in pairs for x in p} | {(g, f) for g in GIVEN for f in FAMILY})
    got = {tuple(r) for r in N.near_families(spark.createDataFrame(forms, "g string, f string")).collect()}
    for (_, a), (_, b) in pairs:
        if N.jaro_winkler(a, b) >= N.NEAR:
            assert (min(a, b), max(a, b)) in got, (a, b)
    assert not {(a, b) for a, b in got if N.edits(a, b) > N.allowed(a, b)}


def test_candidate_recall_over_all_single_edits(spark):
    """Every accepted pair of a family name and itself with one letter changed, dropped or doubled, or two swapped, is a candidate."""
    import random

    r = random.Random(6)
    forms, want = set(), set()
    for f in FAMILY + ["berk", "lindt", "osman", "keller"]:
        forms.add(("anna", f))
        for _ in range(12):
            i, how = r.randrange(len(f) - 1), r.randrange(4)
            x = [f[:i] + r.choice("abcdefgh") + f[i + 1 :], f[:i] + f[i + 1 :], f[:i] + f[i] + f[i:], f[:i] + f[i + 1] + f[i] + f[i + 2 :]][how]
            if x != f and N.jaro_winkler(f, x) >= N.NEAR:
                forms.add(("anna", x))
                want.add((min(f, x), max(f, x)))
    got = {tuple(x) for x in N.near_families(spark.createDataFrame(sorted(forms), "g string, f string")).collect()}
    assert want <= got and len(want) > 100
