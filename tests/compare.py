"""Query results against DuckDB's."""

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return str(v)
    return v if v is None or isinstance(v, (bool, int)) else str(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(([plain(x) for x in r] for r in df.select(*(f"`{c}`" for c in names)).collect()), key=repr)


def oracle_rows(sql, sf_dir):
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = sorted(([plain(r[i]) for i in order] for r in found.fetchall()), key=repr)
    return [names[i] for i in order], rows
