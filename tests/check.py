"""Side-by-side check of registered queries against their SQL."""

from __future__ import annotations

import glob
import math
import os


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.9g}" if value else "0"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(df, sql: str, folder: str) -> tuple[bool, str]:
    import duckdb
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if ours[0] != theirs[0]:
        return False, f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return False, f"rows {len(ours[1])} != {len(theirs[1])}"
    off = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    if off:
        return False, f"{len(off)} of {len(ours[1])} differ, columns {ours[0]}: spark {off[0][0]} sql {off[0][1]}"
    return True, f"{len(ours[1])} rows"
