"""Compare a query with its SQL, as rows in any order."""

from __future__ import annotations

import math
from datetime import datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, (bool, str, int)):
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, dict):
        return str([(k, plain(x)) for k, x in sorted(v.items())])
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return repr(v)


def sql_rows(sql: str, sf: str) -> tuple[list[str], list[tuple]]:
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    found = db.sql(sql)
    names = sorted(found.columns)
    rows = db.sql("SELECT " + ", ".join(f'"{n}"' for n in names) + f" FROM ({sql})").fetchall()
    return names, sorted(tuple(map(plain, r)) for r in rows)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted(tuple(map(plain, r)) for r in df.select(*names).collect())
