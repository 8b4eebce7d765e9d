"""Spark rows against DuckDB rows of the same tables."""

import duckdb


def same_as_sql(df, sql, sf_dir, **tables):
    """Rows of ``df`` equal those of ``sql``; ``tables`` (pandas) take the place of files."""
    con = duckdb.connect()
    for name in ("documents", "pages", "conversations", "embeddings"):
        if name in tables:
            con.register(name, tables[name])
        else:
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    want = con.sql(sql)
    assert sorted(want.columns) == sorted(df.columns)
    key = lambda r: tuple(map(str, r))
    got, rows = sorted(map(tuple, df.select(*want.columns).collect()), key=key), sorted(want.fetchall(), key=key)
    assert len(got) == len(rows)
    for g, w in zip(got, rows):
        assert g == w
