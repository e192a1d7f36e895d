import __spark_entry__ as entry


def test_registered():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "bm25_topk" in sql
