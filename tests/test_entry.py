import inspect

import __spark_entry__ as entry


def test_every_query_has_a_name_and_a_callable():
    q, o = entry.queries(), entry.oracle_sql()
    assert q and set(o) <= set(q)
    assert all(len(inspect.signature(f).parameters) == 2 for f in q.values())


def test_found_queries_are_registered():
    q = entry.queries()
    for n in (2, 4, 5, 7):
        assert f"p{n}_found" in q
