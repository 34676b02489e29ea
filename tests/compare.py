"""Holds a query against its DuckDB SQL, order apart."""

from decimal import Decimal
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return float(value) if isinstance(value, Decimal) else value


def rows_of_spark(df):
    names = sorted(df.columns)
    return sorted((tuple(plain(x) for x in r) for r in df.select(*[f"`{n}`" for n in names]).toArrow().to_pandas().astype(object).where(lambda d: d.notna(), None).itertuples(index=False, name=None)), key=repr), names


def rows_of_duckdb(sql, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr), sorted(names)
