"""Task-store views over the driver's star-schema tables, in Spark and in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_for_search

TODAY = dt.date(1998, 8, 2)
NOW = dt.datetime(1998, 8, 2, 10, 7)
EVENTS_TODAY = dt.date(2024, 1, 30)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as tasks."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    due = F.when(k % 11 != 0, F.to_date("o_orderdate"))
    minute = F.when(k % 3 != 0, (k % 1440).cast("int"))
    at = F.when(due.isNotNull(), due.cast("timestamp_ntz") + F.make_dt_interval(mins=F.coalesce(minute, F.lit(540))))
    done = F.col("o_orderstatus") == "F"
    title = F.concat(F.lit("Ördér "), F.col("o_orderpriority"), F.lit(" "), k.cast("string"))
    return o.select(
        k.alias("id"), title.alias("title"), fold_for_search(title).alias("title_folded"), due.alias("due_date"), minute.alias("due_minute_of_day"), (k % 2 == 0).alias("reminder_enabled"),
        at.alias("reminder_at_local"), k.cast("int").alias("notification_id"), done.alias("completed"), F.when(done, F.col("o_orderdate").cast("timestamp")).alias("completed_at"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), (F.col("o_custkey") % 7).cast("int").alias("sort_order"),
    )


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases in ``events`` as completions of their user."""
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("owner"), F.col("ts").cast("timestamp").alias("completed_at"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as usage deltas of their day."""
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.lit(1).cast("long").alias("capture_count"), (F.col("event_id") % 3).alias("task_count"))


TASKS_SQL = """tasks_v AS (SELECT o_orderkey AS id, 'Ördér ' || o_orderpriority || ' ' || o_orderkey AS title, lower('order ' || o_orderpriority || ' ' || o_orderkey) AS title_folded,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS due_date, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 1440 AS INTEGER) END AS due_minute_of_day,
    o_orderkey % 2 = 0 AS reminder_enabled,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_minutes(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 1440 ELSE 540 END) END AS reminder_at_local,
    CAST(o_orderkey AS INTEGER) AS notification_id, o_orderstatus = 'F' AS completed, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS completed_at,
    o_orderdate AS created_at, o_orderdate AS updated_at, CAST(o_custkey % 7 AS INTEGER) AS sort_order FROM orders)"""
ORDER_SQL = "due_date ASC NULLS LAST, due_minute_of_day ASC NULLS FIRST, sort_order, id"
LABEL_SQL = """CASE WHEN due_date - DATE '1998-08-02' <= 0 THEN 'today' WHEN due_date - DATE '1998-08-02' = 1 THEN 'tomorrow' WHEN due_date - DATE '1998-08-02' <= 6 THEN 'weekday'
    WHEN due_date - DATE '1998-08-02' <= 13 THEN 'nextWeek' ELSE 'later' END"""
BY_DAY_SQL = "by_day AS (SELECT user_id AS owner, CAST(ts AS DATE) AS day, count(*) AS n_done FROM events WHERE event_type = 'purchase' GROUP BY ALL)"
