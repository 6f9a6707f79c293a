"""Compare a Spark result with a DuckDB result: names, row count and values, order aside."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, (datetime.date, datetime.datetime)):
        return ("time", str(value))
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def differences(spark_df, con, sql: str) -> list[str]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns: spark-only {sorted(set(spark_df.columns) - set(names))} oracle-only {sorted(set(names) - set(spark_df.columns))}"]
    order = sorted(names)
    got = [tuple(_plain(r[n]) for n in order) for r in spark_df.collect()]
    want_at = [names.index(n) for n in order]
    want = [tuple(_plain(r[i]) for i in want_at) for r in expected]
    out = []
    if len(got) != len(want):
        out.append(f"rows: spark {len(got)} oracle {len(want)}")
    for i, n in enumerate(order):
        kinds = ({type(r[i]).__name__ for r in got} - {"NoneType"}, {type(r[i]).__name__ for r in want} - {"NoneType"})
        if kinds[0] and kinds[1] and kinds[0] != kinds[1]:
            out.append(f"type of {n}: spark {kinds[0]} oracle {kinds[1]}")
    key = lambda r: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in r)
    a, b = sorted(got, key=key), sorted(want, key=key)
    if a != b:
        from collections import Counter
        ca, cb = Counter(map(repr, a)), Counter(map(repr, b))
        sa, sb = list((ca - cb).elements()), list((cb - ca).elements())
        if sa or sb:
            out.append(f"values: {len(sa)} spark rows and {len(sb)} oracle rows differ ({len(got)} total)\n    {order}\n    {sa[:2]}\n    {sb[:2]}"[:1500])
    return out
