"""Holding a query against its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(repr(row[i]) for i in order) for row in r.fetchall())


def same(df, sql: str, sf_dir: str) -> None:
    names, want = rows_of(sql, sf_dir)
    assert sorted(df.columns) == names
    got = sorted(tuple(repr(r[c]) for c in names) for r in df.collect())
    assert len(got) == len(want)
    assert got == want
