"""Small literal fixtures for unit tests."""

from __future__ import annotations

import datetime as dt

from shopcast.sources.tables import SCHEMAS, Tables


def tables(spark, product=(), stock=(), sale=(), sale_detail=(), review=(), users=()) -> Tables:
    def df(name, rows):
        return spark.createDataFrame(list(rows), SCHEMAS[name])
    return Tables(df("product", product), df("stock", stock), df("sale", sale), df("sale_detail", sale_detail),
                  df("review", review), df("users", users))


def ts(y, m, d):
    return dt.datetime(y, m, d)
