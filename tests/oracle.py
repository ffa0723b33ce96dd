"""Compare registered queries with their SQL in DuckDB over the same parquet files."""

from __future__ import annotations

import math
from typing import Any

import duckdb
from pyspark.sql import SparkSession

from clickloom.plans.catalog import ORACLE, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


# Operators that no query SQL can express needs: Python rows and all-pairs joins.
NOT_DISTRIBUTED = [
    "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas",
    "CartesianProduct", "BroadcastNestedLoopJoin",
]


# Arrow batches of matrix products and of tree scores, whose results SQL checks.
ARROW = {"corr_matrix": "MapInArrow", "boost_rounds": "ArrowEvalPython"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _kind(v: Any) -> Any:
    if isinstance(v, float) and (math.isnan(v) or v == 0):
        return repr(v)
    return v


def _sorted(rows: list[tuple], order: list[int]) -> list[tuple]:
    return sorted((tuple(_kind(r[i]) for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, sf_dir: str) -> str | None:
    """None if columns, types and all values agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    slow = [w for w in NOT_DISTRIBUTED if w in plan(df) and w != ARROW.get(name)]
    if slow:
        return f"plan uses {slow}"
    mine = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(df.columns)
    a = _sorted(mine, [df.columns.index(c) for c in order])
    b = _sorted(theirs, [names.index(c) for c in order])
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    for x, y in zip(a, b):
        if x != y or [type(v) for v in x] != [type(v) for v in y]:
            return f"{order}: {x} != {y}"
    return None
