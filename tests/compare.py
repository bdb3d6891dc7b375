"""Compare a Spark result with the rows of a DuckDB query on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _rows(rows, order):
    out = []
    for row in rows:
        out.append(tuple("NULL" if row[i] is None else repr(row[i]) if isinstance(row[i], float) else str(row[i]) for i in order))
    return sorted(out)


def compare(df, con, sql: str):
    """Return (number of rows, list of problems)."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    have_names = df.columns
    if sorted(names) != sorted(have_names):
        return len(want), [f"columns {sorted(have_names)} against {sorted(names)}"]
    have = [tuple(r) for r in df.collect()]
    order_w = sorted(range(len(names)), key=lambda i: names[i])
    order_h = sorted(range(len(names)), key=lambda i: have_names[i])
    w, h = _rows(want, order_w), _rows(have, order_h)
    if len(w) != len(h):
        return len(w), [f"{len(h)} rows against {len(w)}", str(h[:2]), str(w[:2])]
    bad = [(a, b) for a, b in zip(h, w) if a != b]
    return len(w), [f"{len(bad)} of {len(w)} rows differ, e.g. {bad[0][0]} against {bad[0][1]}"] if bad else []
