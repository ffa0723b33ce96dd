"""Named queries, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return run

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Cut the last digits, which depend on the order of floating-point sums."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


IMP = """imp AS (
  SELECT CAST(e.event_id AS VARCHAR) AS ID, e.ts AS datetime,
    CASE WHEN CAST(json_extract_string(e.props, '$.k') AS INT) % 10 = 0 THEN NULL
         ELSE CAST(json_extract_string(e.props, '$.k') AS DOUBLE) END AS siteid,
    p.p_partkey AS offerid, p.p_size AS category,
    CAST(substring(p.p_brand, 7) AS INT) AS merchant,
    n.n_name AS countrycode,
    CASE e.user_id % 6 WHEN 0 THEN 'Firefox' WHEN 1 THEN 'Chrome' WHEN 2 THEN 'Safari'
         WHEN 3 THEN 'Edge' WHEN 4 THEN 'Opera' ELSE NULL END AS browserid,
    CASE ((e.event_id * 104729) % 1013) % 4 WHEN 0 THEN 'Mobile' WHEN 1 THEN 'Desktop'
         WHEN 2 THEN 'Tablet' ELSE NULL END AS devid,
    CASE WHEN e.event_type = 'click' THEN 1 ELSE 0 END AS click,
    CASE WHEN ((e.event_id * 1299709) % 997) % 5 = 0 THEN 'test' ELSE 'train' END AS split
  FROM events e
  JOIN customer c ON e.user_id = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON p.p_partkey = (e.event_id * 7919) % (SELECT count(*) FROM part))"""

PREP = IMP + """, prep AS (
  SELECT ID, datetime, COALESCE(siteid, -999.0) AS siteid, offerid, category, merchant, countrycode,
    COALESCE(browserid, 'None') AS browserid, COALESCE(devid, 'None') AS devid, click, split,
    CAST(isodow(datetime) - 1 AS INT) AS tweekday, CAST(hour(datetime) AS INT) AS thour,
    CAST(minute(datetime) AS INT) AS tminute
  FROM imp)"""

SCORED = IMP + """, scored AS (
  SELECT *, ((category * 7 + offerid) % 101) / CAST(100 AS DOUBLE) AS score_a,
    ((merchant * 13 + minute(datetime)) % 101) / CAST(100 AS DOUBLE) AS score_b
  FROM imp)"""

LONG_SCORES = SCORED + """, long_scores AS (
  SELECT ID, click, 'score_a' AS model, score_a AS score FROM scored
  UNION ALL SELECT ID, click, 'score_b' AS model, score_b AS score FROM scored)"""

SPARSE = """sparse AS (
  SELECT vec_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y,
    CAST(i.idx - 1 AS INT) AS idx, CAST(embedding[i.idx] AS DOUBLE) AS value
  FROM embeddings, (SELECT unnest(range(1, 1 + (SELECT max(len(embedding)) FROM embeddings))) AS idx) i
  WHERE i.idx <= len(embedding))"""

LOGS = """runs AS (
  SELECT 'all' AS run, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS iter, value FROM events
  UNION ALL
  SELECT event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT), value FROM events),
logs AS (SELECT run, iter, round(avg(value) / 100, 6) AS AUC FROM runs GROUP BY run, iter)"""


def hash32_sql(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"
