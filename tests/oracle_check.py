"""Compare a registered query with its DuckDB oracle, value by value."""

from __future__ import annotations

import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


# DuckDB column types as Spark names them.
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def differences(con, df, sql: str) -> list[str]:
    """Empty when both sides agree in names, types, row count and every value."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    ours = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    found = [f"type of {c}: {t} != {types[c]}" for c, t in df.dtypes if TYPES.get(types[c]) != t]
    if len(ours) != len(theirs):
        return [*found, f"rows {len(ours)} != {len(theirs)}"]
    order = sorted(names)
    pick = lambda rows, cols: _sorted([tuple(r[cols.index(c)] for c in order) for r in rows])
    for a, b in zip(pick(ours, df.columns), pick(theirs, names)):
        for name, x, y in zip(order, a, b):
            if x != y and not (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y)):
                found.append(f"{name}: {x!r} != {y!r} in {a}")
                if len(found) > 4:
                    return found
    return found
