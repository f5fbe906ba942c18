"""Input tables for the registered queries: usage events, limit samples and dimensions, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import deduplicated

#: Fixed input: a synthetic price table, in dollars a token.
PRICES = [
    ("claude-haiku-4-5", 1e-6, 5e-6, 1.25e-6, 1e-7), ("claude-sonnet-4-6", 3e-6, 1.5e-5, 3.75e-6, 3e-7), ("claude-opus-4-5", 5e-6, 2.5e-5, 6.25e-6, None),
    ("claude-fable-5", 1e-5, 5e-5, 1.25e-5, 1e-6),
]
PRICE_SCHEMA = "model_key string, input double, output double, cache_create double, cache_read double"

RAW = """SELECT concat('m-', CAST(event_id - event_id % 2 AS {S})) AS message_id,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat('r-', CAST(event_id - event_id % 2 AS {S})) END AS request_id,
  concat('s-', CAST(user_id AS {S})) AS session_id,
  CASE WHEN user_id % 7 = 0 THEN concat('proj-', CAST(user_id % 5 AS {S}), '--claude-worktrees-wt', CAST(user_id % 3 AS {S}))
       ELSE concat('proj-', CAST(user_id % 5 AS {S})) END AS project_slug,
  concat('mach-', CAST(user_id % 3 AS {S})) AS machine_id,
  CASE event_type WHEN 'view' THEN 'claude-haiku-4-5' WHEN 'click' THEN 'anthropic/claude-sonnet-4-6'
       WHEN 'purchase' THEN 'claude-opus-4-5-20251101' WHEN 'signup' THEN 'claude-fable-5' ELSE 'unpriced-model' END AS model,
  CAST(round(value * 100) AS BIGINT) AS input_tokens, CASE WHEN event_id % 2 = 0 THEN 1 ELSE CAST(round(value * 10) AS BIGINT) END AS output_tokens,
  CAST(event_id % 97 AS BIGINT) * 10 AS cache_creation_tokens, CAST(event_id % 89 AS BIGINT) * 100 AS cache_read_tokens,
  CASE WHEN event_id % 13 = 0 THEN value / 1000 END AS cost_usd, event_id AS ord, ts FROM {events}"""


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = spark.sql(RAW.format(S="string", events="{events}"), events=events)
    return out.withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(raw_events(spark, sf_dir))


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, PRICE_SCHEMA)


def limit_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample every 40th event: its window resets at the next multiple of five hours, with jitter; now and then early."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 40 = 0")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    early = F.when(F.col("event_id") % 400 == 0, 3_600_000).otherwise(0)
    reset = ms - F.pmod(ms, F.lit(18_000_000)) + 18_000_000 + (F.col("event_id") % 7 - 3) * 1000 - early
    return e.select(ms.alias("captured_at"), (F.col("event_id") % 101).cast("double").alias("util"), reset.alias("reset_at"), F.col("event_id").alias("ord"))
