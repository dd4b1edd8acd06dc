"""Registry of named queries with their SQL counterparts on the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clausegraph.operators.scale import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table for CPU-heavy text work; see :func:`spread`."""
    return spread(table(spark, folder, name))


def register(name: str, sql: str | None = None):
    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


# Shared SQL fragments (common table expressions).
SQL_SENTENCES = """list_filter(list_transform(
    regexp_split_to_array(coalesce({text}, ''), '（[一二三四五六七八九十]+）|[.。；;\\n]'),
    lambda s: trim(trim(s, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), '（）：。；;')), lambda s: s <> '')"""
SQL_WORDS = "list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def sql_units(table_name: str = "documents", key: str = "doc_id", text: str = "text", extra: str = "") -> str:
    inner = SQL_SENTENCES.format(text=text)
    return f"""units AS (
  SELECT {key} AS item_id{extra}, unnest(ss) AS unit, generate_subscripts(ss, 1) - 1 AS unit_no
  FROM (SELECT *, {inner} AS ss FROM {table_name}) s)"""
