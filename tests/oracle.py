"""Compare a query with its SQL in DuckDB."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    v = float(v)
    return None if math.isnan(v) else round(v, 5)


def differences(spark, query, sql: str, folder: str) -> str:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = query(spark, folder)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall()), key=key)
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=key)
    return "" if got == want else f"{len(got)} and {len(want)} rows; {[x for x in zip(got, want) if x[0] != x[1]][:2]}"
