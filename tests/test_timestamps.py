from datetime import datetime, timezone

import pytest

from tributary.operators.timestamps import InstantDictionary, normalise_instants
from tributary.session import scratch_path


def micros(*a):
    d = datetime(*a, tzinfo=timezone.utc)
    return int(d.timestamp()) * 1_000_000 + d.microsecond


CASES = [
    ("2020-06-21 09:37:38 +0000", "UTC", micros(2020, 6, 21, 9, 37, 38)),
    (" 2020-06-21 09:37:38 -0530\t", "UTC", micros(2020, 6, 21, 15, 7, 38)),
    ("2019-02-05 06:16:32", "America/New_York", micros(2019, 2, 5, 11, 16, 32)),
    ("2019-02-05 06:16:32", None, None),
    ("02.01.2012 00:57:24", "UTC", micros(2012, 1, 2, 0, 57, 24)),
    ("02/01/2012 12:05 AM", "UTC", micros(2012, 2, 1, 0, 5)),
    ("02/01/2012 12:05 PM", "UTC", micros(2012, 2, 1, 12, 5)),
    ("02/01/2012 13:05 PM", "UTC", None),
    ("11 Apr 2015, 20:28:00", "Asia/Tokyo", micros(2015, 4, 11, 11, 28)),
    ("Wed, 14 Nov 2012 23:53:07 +1100", "UTC", micros(2012, 11, 14, 12, 53, 7)),
    ("Thu Dec 24 12:07:09 2015 +1100", "UTC", micros(2015, 12, 24, 1, 7, 9)),
    ("20160708T110241+0530", "UTC", micros(2016, 7, 8, 5, 32, 41)),
    ("2024-02-08T05:07:05+00:00[Europe/London]", "UTC", micros(2024, 2, 8, 5, 7, 5)),
    ("2024-07-08T05:07:05[Europe/London]", "UTC", micros(2024, 7, 8, 4, 7, 5)),
    ("2024-07-08T05:07:05[No/Where]", "UTC", None),
    ("2019-09-26T06:00:26.596792Z", "UTC", micros(2019, 9, 26, 6, 0, 26, 596792)),
    ("2019-09-26T06:00:26.5", "UTC", micros(2019, 9, 26, 6, 0, 26, 500000)),
    ("2018-04-01 00:11:34 EDT", "UTC", micros(2018, 4, 1, 4, 11, 34)),
    ("2018-04-01 00:11:34 CEST", "UTC", micros(2018, 3, 31, 22, 11, 34)),
    ("2018-04-01 00:11:34 XYZ", "UTC", None),
    ("1477588542", "UTC", 1477588542_000_000),
    ("1435042306 +0530", "UTC", 1435042306_000_000),
    ("1488941741080", "UTC", 1488941741_080_000),
    # a local time that occurs twice: the earlier instant; a skipped one: the offset before the jump
    ("2021-11-07 01:30:00", "America/New_York", micros(2021, 11, 7, 5, 30)),
    ("2021-03-14 02:30:00", "America/New_York", micros(2021, 3, 14, 7, 30)),
    ("2019-02-30 10:00:00", "UTC", None),
    ("2017-13-40 25:61:00 +0000", "UTC", None),
    ("0000-00-00 00:00:00", "UTC", None),
    ("nan", "UTC", None), ("", "UTC", None), ("   ", "UTC", None), (None, "UTC", None), ("n/a", "UTC", None), ("x" * 100_000, "UTC", None),
]


def test_every_notation(spark):
    rows = spark.createDataFrame([(i, t, z) for i, (t, z, _) in enumerate(CASES)], "i int, raw string, zone string")
    got = {r["i"]: r["utc_micros"] for r in normalise_instants(rows, "raw", "zone").collect()}
    assert len(got) == len(CASES)
    for i, (t, z, want) in enumerate(CASES):
        assert got[i] == want, (t, z)


def test_dictionary_is_added_to(spark):
    path = scratch_path(spark, "dict")
    one = spark.createDataFrame([(1, "2020-01-01 00:00:00", "UTC")], "i int, raw string, zone string")
    two = one.unionByName(spark.createDataFrame([(2, "2020-01-02 00:00:00", "UTC")], "i int, raw string, zone string"))
    d = InstantDictionary(spark, path)
    d.update(one, "raw", "zone")
    d.update(two, "raw", "zone")
    d.update(two, "raw", "zone")
    assert d.table().count() == 2


def test_empty_table_and_clashing_columns(spark):
    schema = "raw string, zone string, k int, utc string, __x int"
    assert normalise_instants(spark.createDataFrame([], schema), "raw", "zone").count() == 0
    got = normalise_instants(spark.createDataFrame([("2020-01-01", "UTC", 1, "u", 2)] * 3, schema), "raw", "zone")
    assert got.columns[-1] == "utc_micros" and got.count() == 3


@pytest.mark.parametrize("n", [5000])
def test_one_text_holds_most_rows(spark, n):
    rows = spark.range(n).selectExpr("id", "case when id % 3 = 0 then '2020-01-01 00:00:00' else cast(1400000000 + id as string) end as raw", "'UTC' as zone")
    got = normalise_instants(rows, "raw", "zone")
    assert got.where("utc_micros is null").count() == 0 and got.select("id").distinct().count() == n


def test_text_rare_at_first_and_hot_later(spark):
    """The rows of the last update, not the table's first sight of a text, tell which texts are hot."""
    d = InstantDictionary(spark)
    d.update(spark.createDataFrame([("2020-01-01 00:00:00", "UTC"), ("n/a", "UTC")], "raw string, zone string"), "raw", "zone")
    rows = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then '2020-01-01 00:00:00' when id % 3 = 1 then null else cast(1400000000 + id as string) end as raw", "case when id % 5 = 0 then null else 'UTC' end as zone")
    d.update(rows, "raw", "zone")
    assert d.batch.where("__raw = '2020-01-01 00:00:00'").agg({"__rows": "sum"}).first()[0] == 1000
    got = d.apply(rows, "raw", "zone", "u")
    assert got.count() == 3000 and got.select("id").distinct().count() == 3000
    by = {r["id"]: (r["raw"], r["zone"], r["u"]) for r in got.collect()}
    for raw, zone, u in by.values():
        want = None if raw is None or raw.startswith("2020") and zone is None else 1577836800_000_000 if raw.startswith("2020") else int(raw) * 1_000_000
        assert u == want
    assert d.table().select("__raw", "__zone").distinct().count() == d.table().count()
