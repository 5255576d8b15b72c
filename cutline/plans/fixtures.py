"""Views that give the driver's tables the shape of the admission data.

The SQL text runs unchanged in Spark and in the checking engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents",
    "events",
]

_SEATS = """
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
"""

VIEWS = {
    "fx_allotment": f"""
SELECT r_name AS institute_type, n_name AS institute_short, p_type AS program_name,
  CASE WHEN p_size % 5 = 0 THEN NULL
       ELSE concat('[', p_type, '](http://x/', p_type, ')') END AS degree_short,
  concat(' ', lower(c_mktsegment)) AS category, concat(lower(o_orderstatus), ' ') AS quota,
  CASE WHEN l_returnflag = 'R' THEN 'Female-only (incl. x)' ELSE ' Gender-Neutral' END AS pool,
  CAST(year(o_orderdate) AS int) AS year, l_linenumber AS round_no,
  CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS is_preparatory,
  CAST(floor(l_extendedprice * (1 - l_discount) / 100) AS bigint) AS opening_rank,
  CAST(floor(l_extendedprice / 100) AS bigint) AS closing_rank
{_SEATS}""",
    "fx_ranked": f"""
SELECT n_name AS institute, p_type AS course, c_mktsegment AS category,
  o_orderpriority AS base_category, o_orderstatus AS quota, r_name AS region,
  CAST(year(o_orderdate) AS int) AS year, CAST(floor(l_extendedprice) AS double) AS rank
{_SEATS}""",
    "fx_wide": """
SELECT institute, category, year,
  max(CASE WHEN course = 'ECONOMY' THEN CAST(CAST(rank AS bigint) AS varchar(20)) END) AS c_economy,
  max(CASE WHEN course = 'PROMO' THEN CAST(CAST(rank AS bigint) AS varchar(20)) END) AS c_promo,
  max(CASE WHEN course = 'STANDARD' THEN CAST(CAST(rank AS bigint) AS varchar(20)) END) AS c_standard,
  max(CASE WHEN course = 'MEDIUM' THEN CAST(CAST(rank AS bigint) AS varchar(20)) END) AS c_medium,
  max(CASE WHEN course = 'LARGE' THEN CAST(CAST(rank AS bigint) AS varchar(20)) END) AS c_large,
  max(CASE WHEN course = 'SMALL' THEN CASE WHEN year = 1996 THEN '--'
    ELSE CAST(CAST(rank AS bigint) AS varchar(20)) END END) AS c_small
FROM fx_ranked GROUP BY institute, category, year""",
    "fx_requests": """
SELECT c_custkey AS request_id,
  CAST(greatest(1, floor(c_acctbal * 10)) AS bigint) AS user_rank,
  c_mktsegment AS category,
  CASE WHEN c_custkey % 5 = 0 THEN '1-urgent' WHEN c_custkey % 5 = 1 THEN '2-High'
       WHEN c_custkey % 5 = 2 THEN '3-MEDIUM' ELSE '4-NOT SPECIFIED' END AS base_category,
  lower(r_name) AS region,
  CASE WHEN c_custkey % 2 = 0 THEN 'JEE Advanced' ELSE 'JEE Main' END AS exam_type,
  CASE WHEN c_custkey % 3 = 0 THEN 'F' WHEN c_custkey % 3 = 1 THEN 'O' ELSE 'P' END AS quota,
  CASE WHEN c_custkey % 4 = 0 THEN 'Female-Only' ELSE 'Gender-Neutral' END AS pool
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "fx_asks": """
SELECT event_id AS ask_id, ts AS asked_at, category, quota, pool
FROM events JOIN fx_requests ON user_id = request_id""",
    "fx_scored": """
SELECT institute, course, category, avg(rank) AS pred_closing_rank,
  round(CAST(count(*) % 101 AS double) / 100, 4) AS eligibility_prob
FROM fx_ranked GROUP BY institute, course, category""",
    "fx_eval": """
SELECT l_orderkey, l_linenumber, l_extendedprice AS y_true,
  l_extendedprice * (1 - l_discount) AS y_pred,
  CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS label, l_extendedprice AS score
FROM lineitem""",
}


def _needed(text: str, views: dict[str, str], found: list[str]) -> list[str]:
    for name, body in views.items():
        if name not in found and re.search(rf"\b{name}\b", text):
            _needed(body, views, found)
            found.append(name)
    return found


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the views it names; it may start with its own named parts."""
    views = {**VIEWS, **(extra or {})}
    parts = ", ".join(f"{n} AS ({views[n]})" for n in _needed(body, views, []))
    text = body.strip()
    if not parts:
        return text if text.upper().startswith("SELECT") else f"WITH {text}"
    return f"WITH {parts} {text}" if text.upper().startswith("SELECT") else f"WITH {parts}, {text}"


# Schemas already read from file footers, by path: the next read skips that job.
_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = with_views(f"SELECT * FROM {name}")
    for base in TABLES:
        if re.search(rf"\b{base}\b", sql):
            table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(sql)
