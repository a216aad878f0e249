import pytest

from tributary.llm import mojibake as M

CLEAN = ["Größenprüfung für Übersichten ergänzt", "Añade traducción al español", "Исправлена ошибка загрузки", "Güncellenmiş çeviri dosyaları", "naïve café résumé", "use “smart” quotes", "20 °C ± 0.5 °C", "José Núñez", "Zoë Kośtefiř", "修复缓存问题", "Přidána kontrola vstupů", "Corrige validação de endereço"]
CITES = ["Fix ‘Ã©’ shown in place of ‘é’", "Relabel region SÃO VALENTIM", "«Ð» is a valid letter too", "Sort ÄÖÜ before ß"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, CLEAN[i % len(CLEAN)], f"plain words number {i}\n{CLEAN[(i * 5) % len(CLEAN)]}") for i in range(1200)]
    return spark.createDataFrame(rows, "row_id long, author_name string, message string")


def restored(spark, table, values):
    extra = spark.createDataFrame([(10_000 + i, v, None) for i, v in enumerate(values)], "row_id long, author_name string, message string")
    out = M.restore(table.unionByName(extra), "row_id", ["author_name", "message"]).collect()
    return {r["row_id"] - 10_000: r["restored"] for r in out}


def test_round_trips_through_every_encoding(spark, table):
    cases = [(c, M.from_bytes(c.encode(), e)) for c in CLEAN for e in M.VIA_UTF8] + [("Исправлена ошибка загрузки", "Исправлена ошибка загрузки".encode("cp1251").decode("cp1252"))]
    twice = [(c, M.from_bytes(M.from_bytes(c.encode(), "cp1252").encode(), "cp1252")) for c in CLEAN[:4]]
    cases = [(c, g) for c, g in cases + twice if g != c]
    got = restored(spark, table, [g for _, g in cases])
    right = sum(got.get(i) == c for i, (c, _) in enumerate(cases))
    assert right >= 0.95 * len(cases), [(c, g, got.get(i)) for i, (c, g) in enumerate(cases) if got.get(i) != c]


def test_clean_and_citing_texts_are_left_alone(spark, table):
    got = restored(spark, table, CLEAN + CITES + ["plain", "", None])
    assert got == {}


def test_partly_garbled_and_lost(spark, table):
    bad = M.from_bytes(CLEAN[0].encode(), "cp1252")
    got = restored(spark, table, [f"{CLEAN[2]}\n{bad}", "Gr��enpr�fung", bad * 1 + "\n" + "a" * 50_000])
    assert got[0] == f"{CLEAN[2]}\n{CLEAN[0]}" and got[1] == "" and got[2].startswith(CLEAN[0])


def test_empty_table(spark, table):
    assert M.restore(table.limit(0), "row_id", ["author_name", "message"]).count() == 0


def test_encodings_of_other_scripts(spark, table):
    ru, zh = "Исправлена ошибка загрузки", "修复缓存问题"
    cases = [(ru, ru.encode("koi8_r").decode("cp1252")), (ru, ru.encode("cp1251").decode("koi8_r")), (ru, ru.encode("cp866").decode("cp1251")), (zh, zh.encode("gbk").decode("latin-1"))]
    got = restored(spark, table, [g for _, g in cases])
    assert sum(got.get(i) == c for i, (c, _) in enumerate(cases)) >= 3, got


def test_cited_replacement_characters_are_no_loss(spark, table):
    got = restored(spark, table, ["Fix � shown in place of ‘é’", "Print '�' for unknown bytes", "Drop (�) from names", "Ren�", "Gr��en — �ber", "a � b"])
    assert {i for i, v in got.items() if v == ""} == {3, 5}, got
    assert not {0, 1, 2} & set(got)


def test_margins_come_from_all_rows(spark, table, monkeypatch):
    extra = spark.createDataFrame([(20_000 + i, f"naïve café number {i}\nÜbersicht {i % 40}", None) for i in range(300)], "row_id long, author_name string, message string")
    df, fields = table.unionByName(extra), ["author_name", "message"]
    monkeypatch.setattr(M, "VALIDATION_ROWS", 1)
    model = M.fit(df, fields)
    lines = {x for r in df.collect() for f in fields if r[f] for x in r[f].split("\n") if not x.isascii() and M.surely_clean(x)}
    kinds = [{}, {}]
    for x in lines:
        for kind, chain, g in M.gains(x, model):
            kinds[kind].setdefault(chain, []).append(g)
    want = {c: M.parting(kinds[0].get(c, []), g) for c, g in kinds[1].items() if len(g) >= M.LEAST_SAMPLES}
    strict = max([M.parting(*[[g for v in d.values() for g in v] for d in kinds]), *want.values()])
    assert len(lines) > 300 and M.margins(df, fields, model) == {c: want.get(c, strict) for c in M.CHAINS}
    monkeypatch.setattr(M, "validated_margin", None)  # the sample decides nothing
    bad = M.from_bytes(CLEAN[0].encode(), "cp1252")
    assert restored(spark, table, [bad]) == {0: CLEAN[0]}
