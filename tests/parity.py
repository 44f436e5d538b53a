"""Comparison of a query's rows in Spark with its SQL equivalent in DuckDB."""

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


def compare(df, con, sql):
    """Empty text when names, types and rows agree, else what differs."""
    rel = con.sql(sql)
    types = dict(zip(rel.columns, map(str, rel.types)))
    ours = {n: _KINDS.get(t, t) for n, t in df.dtypes}
    if ours != types:
        odd = {n: (ours.get(n), types.get(n)) for n in {*ours, *types} if ours.get(n) != types.get(n)}
        return f"schema {odd}"
    names = sorted(types)
    left = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    right = sorted(rel.select(*[f'"{n}"' for n in names]).fetchall(), key=repr)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    for a, b in zip(left, right):
        if repr(a) != repr(b):
            return f"row {dict(zip(names, a))} != {dict(zip(names, b))}"
    return ""
