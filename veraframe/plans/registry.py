"""Registers queries over the fixture views together with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veraframe.plans.fixtures import duck, view


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*[F.round(f"`{c}`", digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def registry() -> tuple[dict, dict, object]:
    """(queries, oracles, decorator): the decorator takes a name, the views of the SQL and its body."""
    queries: dict = {}
    oracles: dict = {}

    def query(name: str, views: str = "", sql: str = ""):
        def wrap(fn):
            queries[name] = lambda spark, sf_dir: rounded(fn(lambda v: view(spark, sf_dir, v)))
            if sql:
                oracles[name] = duck(views, sql)
            return fn

        return wrap

    return queries, oracles, query
