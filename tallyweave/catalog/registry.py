"""Registration of queries and the shared pieces of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

# SQL view of sources.tables.actions
ACTIONS = """actions AS (
  SELECT event_id % 2 AS chain_id, event_type AS action, event_id AS block_number,
         event_id // 3 AS tx_hash, event_id AS log_index, k % 10 AS reserve_address,
         k AS actor_address, user_id AS beneficiary_address,
         CASE WHEN event_type = 'view' THEN (user_id + k) % 100 END AS counterparty_address,
         CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || repeat('0', 16) AS amount_raw,
         CAST(date_diff('day', DATE '2024-01-15', CAST(ts AS DATE)) AS INTEGER) AS event_week, ts
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""

# SQL view of sources.tables.order_actions
ORDER_ACTIONS = """order_actions AS (
  SELECT c_mktsegment AS chain, o_orderpriority AS action, o_custkey AS beneficiary_address,
         o_orderkey AS tx_hash, o_totalprice AS value, o_orderdate AS ts,
         CAST(floor(date_diff('day', DATE '1998-04-20', CAST(o_orderdate AS DATE)) / 7.0) AS INTEGER) AS event_week
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

SUPPLY_EDGES = """supply_edges AS (
  SELECT o_custkey AS customer, l_suppkey AS supplier, l_quantity AS value, o_orderdate AS ts,
         o_orderpriority AS asset
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Comparable output: doubles rounded, integers as bigint."""
    columns: list[Column] = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        column = F.col(field.name)
        if kind in ("double", "float"):
            column = F.round(column.cast("double"), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint") or kind.startswith("decimal(20"):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def r(expression: str, digits: int = 9) -> str:
    """SQL counterpart of :func:`rounded` for one double expression."""
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0"
