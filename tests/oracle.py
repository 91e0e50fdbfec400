"""Side-by-side check of the registered queries: ``python -m tests.oracle [names...]``."""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP WITH TIME ZONE", "date": "DATE", "smallint": "SMALLINT",
}


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return value + 0.0
    return value


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(df, con, sql: str) -> str | None:
    """None when both sides hold the same rows, else what differs."""
    names = sorted(df.columns)
    mine = [tuple(_plain(v) for v in r) for r in df.select(*names).collect()]
    rel = con.execute("SELECT {} FROM ({})".format(", ".join(f'"{n}"' for n in names), sql))
    types = {d[0]: str(d[1]) for d in rel.description}
    other = [tuple(_plain(v) for v in r) for r in rel.fetchall()]
    columns = sorted(d[0] for d in con.execute(f"SELECT * FROM ({sql}) LIMIT 0").description)
    if columns != names:
        return f"columns {names} vs {columns}"
    for name, kind in df.dtypes:
        want = SPARK_TO_DUCK.get(kind, kind)
        if types[name].upper() != want:
            return f"type of {name}: {want} vs {types[name]}"
    if len(mine) != len(other):
        return f"rows {len(mine)} vs {len(other)}"
    mine.sort(key=_key)
    other.sort(key=_key)
    for a, b in zip(mine, other):
        if a != b:
            return f"{names}\n  spark {a}\n  duck  {b}"
    return None


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from __spark_entry__ import oracle_sql, queries
    from mintweave.session import local_session

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf = args.pop(0)
    spark = local_session("oracle", cores=8)
    con = duck(sf)
    all_queries, oracles = queries(), oracle_sql()
    bad = 0
    for name in all_queries if not args else [n for n in all_queries if any(a in n for a in args)]:
        start = time.time()
        try:
            df = all_queries[name](spark, sf)
            if name in oracles:
                t_start = time.time()
                problem = compare(df, con, oracles[name])
                n = ""
            else:
                n = len(df.collect())
                problem = None
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
            n = ""
        state = "ok  " if problem is None else "FAIL"
        bad += problem is not None
        print(f"{state} {name:32s} {time.time() - start:6.1f}s {'oracle' if name in oracles else f'rows={n}'} {problem or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
