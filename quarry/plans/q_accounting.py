"""Registered usage / cost queries (OP-M1, OP-P9, OP-P10, OP-J4, OP-A2..A6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import accounting as acc
from quarry.plans import fixtures as fx
from quarry.plans.registry import register
from quarry.plans.sql_fragments import USAGE_SQL

RANGE_SQL = "created_at BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-02-01 00:00:00'"
COSTS = ("input_cost_usd", "cached_input_cost_usd", "output_cost_usd", "total_cost_usd")


@register("usage_cost", f"""
SELECT response_id, created_at, operation, model, input_tokens, cached_input_tokens, output_tokens,
       total_tokens, CAST(input_cost_usd AS DOUBLE) AS input_cost_usd,
       CAST(cached_input_cost_usd AS DOUBLE) AS cached_input_cost_usd,
       CAST(output_cost_usd AS DOUBLE) AS output_cost_usd, CAST(total_cost_usd AS DOUBLE) AS total_cost_usd
FROM ({USAGE_SQL})
""")
def q_usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = fx.usage(spark, sf_dir)
    return u.select(*[F.col(c).cast("double").alias(c) if c in COSTS else F.col(c) for c in u.columns])


@register("usage_total_cost", f"""
SELECT CAST(coalesce(sum(total_cost_usd), 0) AS DOUBLE) AS value FROM ({USAGE_SQL}) WHERE {RANGE_SQL}
""")
def q_usage_total_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.usage_total_cost(fx.usage(spark, sf_dir), *fx.USAGE_RANGE)


@register("usage_total_tokens", f"""
SELECT CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS value FROM ({USAGE_SQL}) WHERE {RANGE_SQL}
""")
def q_usage_total_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.usage_total_tokens(fx.usage(spark, sf_dir), *fx.USAGE_RANGE)


@register("usage_cost_hourly", f"""
SELECT date_trunc('hour', created_at) AS time, CAST(sum(total_cost_usd) AS DOUBLE) AS cost_usd
FROM ({USAGE_SQL}) WHERE {RANGE_SQL} GROUP BY 1 ORDER BY 1
""")
def q_usage_cost_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.usage_cost_hourly(fx.usage(spark, sf_dir), *fx.USAGE_RANGE)


@register("usage_tokens_hourly", f"""
SELECT date_trunc('hour', created_at) AS time, sum(input_tokens) AS input_tokens,
       sum(output_tokens) AS output_tokens
FROM ({USAGE_SQL}) WHERE {RANGE_SQL} GROUP BY 1 ORDER BY 1
""")
def q_usage_tokens_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.usage_tokens_hourly(fx.usage(spark, sf_dir), *fx.USAGE_RANGE)


@register("usage_by_operation", f"""
SELECT operation, model, count(*) AS requests, sum(total_tokens) AS total_tokens,
       CAST(sum(total_cost_usd) AS DOUBLE) AS estimated_cost_usd
FROM ({USAGE_SQL}) WHERE {RANGE_SQL} GROUP BY operation, model ORDER BY estimated_cost_usd DESC
""")
def q_usage_by_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.usage_by_operation(fx.usage(spark, sf_dir), *fx.USAGE_RANGE)
