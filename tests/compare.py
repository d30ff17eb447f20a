"""Run a query and its SQL side by side and compare whole results."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, folder: str, query) -> tuple[int, str | None]:
    """Row count and a message for the first difference (None when equal)."""
    df = query.run(spark, folder)
    names = sorted(df.columns)
    got = sorted((tuple(row[c] for c in names) for row in df.collect()), key=repr)
    if query.sql is None:
        return len(got), None
    rel = con.execute(query.sql)
    cols = [d[0] for d in rel.description]
    if sorted(cols) != names:
        return len(got), f"columns {names} vs {sorted(cols)}"
    raw = rel.fetchall()
    kinds = dict(zip(cols, [str(d[1]) for d in rel.description]))
    schema = {f.name: f.dataType.simpleString() for f in df.schema}
    for name in names:
        if TYPES.get(schema[name]) != kinds[name]:
            return len(got), f"type of {name}: {schema[name]} vs {kinds[name]}"
    want = sorted((tuple(r[cols.index(c)] for c in names) for r in raw), key=repr)
    if len(got) != len(want):
        return len(got), f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]
    if bad:
        return len(got), f"{len(bad)} rows differ, first {dict(zip(names, bad[0][0]))} vs {dict(zip(names, bad[0][1]))}"
    return len(got), None
