"""Registry of queries, and the view of documents that their SQL starts from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END = "2024-01-30"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()):
    """Register a function under its name, with its SQL over the view voc if there is one; ``dates`` become text in both."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf: f(spark, sf).withColumns({d: F.col(d).cast("string") for d in dates}) if dates else f(spark, sf)
        if sql is not None:
            text = "*" if not dates else "* REPLACE (" + ", ".join(f"CAST(CAST({d} AS DATE) AS VARCHAR) AS {d}" for d in dates) + ")"
            SQL[f.__name__] = f"SELECT {text} FROM (WITH {VOC}{sql})"
        return f

    return add


VOC = """e AS (
  SELECT event_id AS item_id, 'P' || lpad(CAST(user_id % 12 + 1 AS VARCHAR), 3, '0') AS product,
    CASE event_id % 3 WHEN 0 THEN 'COUPANG' WHEN 1 THEN 'NAVER' ELSE 'ZIGZAG' END AS channel,
    CASE WHEN event_id % 4 = 3 THEN 'review' ELSE 'cs' END AS source, ts AS occurred_at, CAST(ts AS DATE) AS day, event_type,
    CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events
), h AS (
  SELECT *, source = 'cs' AND day >= DATE '2024-01-24' AND k % 2 = 0 AND product = 'P001' AND channel = 'COUPANG' AS one,
    source = 'cs' AND day >= DATE '2024-01-24' AND k % 2 = 0 AND product = 'P002' AS two FROM e
), voc AS (
  SELECT item_id, product, channel, source, occurred_at, day, k,
    ['색상', '사이즈', '소재', '파손', '오배송', '기타'][CASE WHEN one THEN 0 WHEN two THEN 1 WHEN source = 'review' THEN k % 3 ELSE k % 6 END + 1] AS aspect,
    CASE WHEN event_type = 'error' OR one OR two THEN -1 WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS sentiment FROM h
)
"""
