"""Compare a registered query with its SQL on the same tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, (int,)):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (datetime.date, bytes, bytearray)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value if not hasattr(value, "item") else value.item()


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        where = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(where):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{where}'")
    return con


def differences(df, sql, con, most=3):
    """'' if both give the same columns and rows, else what differs."""
    names = sorted(df.columns)
    got = ordered([tuple(plain(v) for v in row) for row in df.select(*[f"`{n}`" for n in names]).collect()])
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} and {sorted(rel.columns)}"
    want = ordered([tuple(plain(v) for v in row) for row in con.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql})").fetchall()])
    if got == want:
        return ""
    a, b = [r for r in got if r not in set(want)][:most], [r for r in want if r not in set(got)][:most]
    return f"{len(got)} and {len(want)} rows; only here {a}; only there {b}; columns {names}"
