import pytest

from tributary.operators.packed import explode_packed, split_packed

CASES = [
    ("a b; c d", 2, ["a b", "c d"]), ("a|b", None, ["a", "b"]), ("a||b", 2, ["a", "b"]), ("a; ; b;", None, ["a", "b"]), (" ; a ;b", None, ["a", "b"]),
    ("x, y", 2, ["x", "y"]), ("Last, First", 1, ["Last, First"]), ("A B; Last, First", 2, ["A B", "Last, First"]), ("A B; c_d, E F", 3, ["A B", "c_d", "E F"]),
    ("['a', 'b, c']", 2, ["a", "b, c"]), ('["x \\"y\\" z", "w"]', 2, ['x "y" z', "w"]), ("'a', 'b; c'", 2, ["a", "b; c"]), ("'solo'", 1, ["solo"]),
    ('"a ""b"" c"', 1, ['a "b" c']), ('"a"; "b; c"', None, ["a", "b; c"]), ('"a"|"b"', None, ["a", "b"]), ('x; "y; z"', 2, ["x", "y; z"]), ('"a b", c d, "e, f"', 3, ["a b", "c d", "e, f"]),
    ("<a@x>, <b@y>", None, ["a@x", "b@y"]), ("<a@x> <b@y>", 2, ["a@x", "b@y"]), ("<a@x>", None, ["a@x"]), ("a@x b@y", None, ["a@x", "b@y"]), ("a@x  none", 2, ["a@x", "none"]),
    ("a\tb", None, ["a", "b"]), ("a\r\nb", None, ["a", "b"]), ("a; b | c", 3, ["a", "b", "c"]), ("Ann O'Hara", 1, ["Ann O'Hara"]), ("Ann (work); Bo [x]", 2, ["Ann (work)", "Bo [x]"]),
    ("Ann @ work; Bo", 2, ["Ann @ work", "Bo"]), ('Ann "Annie" Lee', 1, ['Ann "Annie" Lee']), ("AT&T-like vendor", 1, ["AT&T-like vendor"]), ("", None, []), ("  ", 0, []), (None, None, []), ("[]", 0, []), (";;", None, []),
]


@pytest.mark.parametrize("text,count,want", CASES)
def test_notations(text, count, want):
    assert split_packed(text, count) == want


def test_positions_empty_and_long(spark):
    df = spark.createDataFrame([(1, "a; ; b", None, "x"), (2, None, 3, "x"), (3, ";".join(["v"] * 20_000), None, "x")], "id long, items string, n int, key string")
    got = explode_packed(df, "id", "items", "n").collect()
    assert [(r["key"], r["pos"], r["item_value"]) for r in got if r["key"] == 1] == [(1, 1, "a"), (1, 2, "b")]
    assert sum(r["key"] == 3 for r in got) == 20_000
    assert explode_packed(df.limit(0), "id", "items").count() == 0
