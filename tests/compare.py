"""A query's rows against its SQL's, both as sorted tuples of plain values."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 4) + 0.0
    if isinstance(value, bool) or value is None or isinstance(value, int | str):
        return value
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return str(value)


def same_rows(df, con, sql: str) -> tuple[list[str], list[str], list, list]:
    """(columns here, columns there, rows only here, rows only there)."""
    found = con.sql(sql)
    names, there = sorted(df.columns), sorted(found.columns)
    if names != there:
        return names, there, [], []
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    at = [found.columns.index(c) for c in names]
    theirs = sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=repr)
    if ours == theirs:
        return names, there, [], []
    from collections import Counter

    a, b = Counter(ours), Counter(theirs)
    return names, there, list((a - b).elements()), list((b - a).elements())
