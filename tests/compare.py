"""Holds a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import duckdb

from veraframe.plans.fixtures import TABLES


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 8) + 0.0)
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return repr(v)


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], list]:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    return cols, sorted(str(plain(r)) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())


def spark_rows(df) -> tuple[list[str], list]:
    cols = sorted(df.columns)
    return cols, sorted(str(plain(tuple(r[c] for c in cols))) for r in df.collect())
