"""A query and its SQL form side by side."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def _plain(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def compare(spark, con, query, sql, sf):
    df = query(spark, sf)
    cols = sorted(df.columns)
    mine = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    r = con.execute(sql)
    names, kinds = [d[0] for d in r.description], {d[0]: str(d[1]) for d in r.description}
    at = [names.index(c) for c in sorted(names)]
    theirs = sorted(tuple(_plain(row[i]) for i in at) for row in r.fetchall())
    assert cols == sorted(names)
    assert {f.name: KINDS.get(f.dataType.simpleString()) for f in df.schema} == kinds
    assert mine == theirs
