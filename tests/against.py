"""Comparison with DuckDB."""

import os


def compare(spark, sf, query, sql):
    """A query's rows and columns against DuckDB's."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    df = query(spark, sf)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    show = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    rows = lambda got, cols: sorted(tuple(show(r[cols.index(c)]) for c in sorted(cols)) for r in got)
    assert sorted(df.columns) == sorted(names)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(cur.fetchall(), names)
