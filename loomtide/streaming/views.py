"""Views that are kept up to date from a change feed: only what a batch changes is counted, and a batch that comes again changes nothing.

The state of all views is one table of counts by (view, day), in versions of a log of commits whose numbers are those of the batches.  Labels
like "today" and "tomorrow" are made when a view is read, from the day it is read on, so a new day needs no recount.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import commits, groups

#: What a change says of a task, before and after; both are null where there was or is none.
TASK_SIDE = "struct<completed: boolean, due_date: date, completed_at: timestamp>"
CHANGE = f"id string, old {TASK_SIDE}, new {TASK_SIDE}"


def changes_between(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """The change feed between two snapshots: tasks that came, went or differ in what the views count."""
    side = lambda df, name: df.select(key, F.struct("completed", "due_date", F.col("completed_at").cast("timestamp").alias("completed_at")).alias(name))
    both = side(before, "old").join(side(after, "new"), key, "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(F.col(key).cast("string").alias("id"), "old", "new")


def view_deltas(changes: DataFrame, zone: str = "UTC") -> DataFrame:
    """Rows (view, day, n) that the changes add to the counts: "open" and "done" in all, "due" by day of open tasks, "completed" by local day of completion."""

    def counted(side: Column, sign: int) -> Column:
        row = lambda view, day, n: F.struct(F.lit(view).alias("view"), day.cast("date").alias("day"), n.cast("long").alias("n"))
        none = F.lit(None)
        done = F.coalesce(side["completed"], F.lit(False)).cast("int")
        there = side.isNotNull().cast("int")
        ended = F.to_date(F.from_utc_timestamp(side["completed_at"], zone))
        return F.array(
            row("open", none, sign * there * (1 - done)), row("done", none, sign * there * done), row("due", side["due_date"], sign * there * (1 - done) * side["due_date"].isNotNull().cast("int")),
            row("completed", ended, sign * there * done * F.coalesce(ended.isNotNull().cast("int"), F.lit(0))),
        )

    rows = changes.select(F.explode(F.concat(counted(F.col("old"), -1), counted(F.col("new"), 1))).alias("r")).select("r.*").where("n <> 0")
    return rows.groupBy("view", "day").agg(F.sum("n").alias("n"))


def apply_changes(changes: DataFrame, path: str, number: int, zone: str = "UTC") -> bool:
    """Add a batch of changes to the counts in ``path``; the batch of a number that is in already changes nothing and gives False."""
    spark = changes.sparkSession
    last = commits.current_version(spark, path)
    if last >= number + 1:
        return False
    new = view_deltas(changes, zone)
    both = commits.read_version(spark, path, last).union(new).groupBy("view", "day").agg(F.sum("n").alias("n")) if last else new
    return commits.commit_once(both.where("n <> 0").coalesce(1), path, number + 1)


def keep_views(changes: DataFrame, path: str, checkpoint: str, zone: str = "UTC") -> StreamingQuery:
    """Keep the views in ``path`` from a stream of changes (``CHANGE``)."""
    return changes.writeStream.foreachBatch(lambda batch, number: apply_changes(batch, path, number, zone)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_totals(spark: SparkSession, path: str) -> DataFrame:
    """``open_count`` and ``completed_count``, as ``store.totals`` of the snapshot gives them."""
    some = lambda view: F.coalesce(F.sum(F.when(F.col("view") == view, F.col("n"))), F.lit(0))
    return commits.read_version(spark, path).agg(some("open").alias("open_count"), some("done").alias("completed_count"))


def live_headers(spark: SparkSession, path: str, today: dt.date) -> DataFrame:
    """Headers of the open tasks after ``today``, as ``groups.group_headers`` of the snapshot gives them."""
    due = commits.read_version(spark, path).where("view = 'due'").where(F.col("day") > F.lit(today)).withColumn("label", groups.label_for(F.col("day"), F.lit(today)))
    merged = F.when(~F.col("label").isin("today", "nextWeek", "later"), F.col("day"))
    return due.groupBy("label", merged.alias("shown")).agg(F.min("day").alias("first_date"), F.sum("n").alias("n_tasks")).drop("shown")


def live_streak(spark: SparkSession, path: str, today: dt.date) -> DataFrame:
    """``done_last_7`` and ``streak_days`` up to ``today``, as ``groups.owner_stats`` of the completions gives them."""
    by_day = commits.read_version(spark, path).where("view = 'completed'").select(F.lit("all").alias("owner"), "day", F.col("n").alias("n_done"))
    return groups.owner_stats(by_day, today).select("done_last_7", "streak_days")


def day_changes(ticks: DataFrame, zone: str = "UTC") -> DataFrame:
    """One row for each local day that a stream of ticks (``at``, under a watermark) reaches: the trigger by which views are read anew."""
    return ticks.withColumn("day", F.to_date(F.from_utc_timestamp("at", zone))).dropDuplicatesWithinWatermark(["day"]).select("day")
