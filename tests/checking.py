"""Runs a registered query and its checking SQL and compares the rows."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    return float(v) if hasattr(v, "as_tuple") else v


def _order(row):
    def one(x):
        if x is None:
            return (2, "", 0)
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return (0, "", round(float(x), 3))
        return (1, str(x), 0)

    return tuple(one(x) for x in row)


def _same(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def compare(df, con, sql):
    """The first difference, or None."""
    names = sorted(df.columns)
    mine = [tuple(_plain(r[c]) for c in names) for r in df.collect()]
    cursor = con.execute(sql)
    theirs_names = [d[0] for d in cursor.description]
    if sorted(theirs_names) != names:
        return f"columns {names} and {sorted(theirs_names)}"
    at = [theirs_names.index(c) for c in names]
    theirs = [tuple(_plain(r[i]) for i in at) for r in cursor.fetchall()]
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    for a, b in zip(sorted(mine, key=_order), sorted(theirs, key=_order), strict=True):
        if not all(map(_same, a, b)):
            return f"{dict(zip(names, a, strict=True))} and {dict(zip(names, b, strict=True))}"
    return None
