"""Runs a registered query in Spark and its SQL in DuckDB and compares all rows."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(repr(r[i]) for i in order) for r in rows))


_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    got = [tuple(r) for r in spark_df.collect()]
    names = spark_df.columns
    result = con.execute(sql)
    want_names = [d[0] for d in result.description]
    want_types = {d[0]: str(d[1]) for d in result.description}
    want = result.fetchall()
    if sorted(names) != sorted(want_names):
        return f"columns {sorted(names)} != {sorted(want_names)}"
    for name, dtype in spark_df.dtypes:
        if _TYPES.get(dtype) != want_types[name]:
            return f"type of {name}: {dtype} against {want_types[name]}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    a, b = _rows(got, names), _rows(want, want_names)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} rows differ, e.g. {bad[0][0]} against {bad[0][1]}"
    return None
