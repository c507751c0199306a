"""Comparison of a registered query with its SQL on the small tables."""

from check import as_bag, connect

SMALL = "/root/testdata/sf0.001"


def agrees(spark, query, sql, where=SMALL):
    df = query(spark, where)
    rows = df.collect()
    result = connect(where).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = result.fetchall()
    assert want and as_bag(df.columns, rows) == as_bag(names, want)
