"""What to schedule and what to cancel."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import commits


def reminder_plan(tasks: DataFrame, held: DataFrame, now: dt.datetime, enabled: bool = True, permitted: bool = True, limit: int = 60, grace_minutes: int = 60) -> DataFrame:
    """Rows ``(action, notification_id, id, at)``.

    The first ``limit`` future reminders of open tasks are scheduled; held alarms that are neither
    wanted nor rang within the grace interval are cancelled.  With the
    switch off or without permission nothing is scheduled and all held ones go.

    The tasks are read twice, once for the top ``limit`` rows and once for those within the grace interval.
    """
    moment = F.lit(now).cast("timestamp_ntz")
    slots = held.select("notification_id").distinct()
    drop = lambda df: df.select(F.lit("cancel").alias("action"), "notification_id", F.lit(None).cast("string").alias("id"), F.lit(None).cast("timestamp_ntz").alias("at"))
    if not (enabled and permitted):
        return drop(slots)
    fit = tasks.where(F.col("reminder_at_local").isNotNull() & F.col("notification_id").isNotNull() & F.col("reminder_enabled") & ~F.col("completed")).select("id", "notification_id", "reminder_at_local")
    wanted = fit.where(F.col("reminder_at_local") > moment).orderBy("reminder_at_local", "id").limit(limit)
    flying = fit.where((F.col("reminder_at_local") <= moment) & (F.col("reminder_at_local") > moment - F.make_dt_interval(mins=F.lit(grace_minutes))))
    # One full join of the few rows that are safe with the held slots gives both actions.
    safe = wanted.withColumn("add", F.lit(True)).union(flying.withColumn("add", F.lit(False)))
    both = safe.withColumnRenamed("notification_id", "slot").join(slots.withColumn("held", F.lit(True)), F.col("slot") == F.col("notification_id"), "full")
    action = F.when(F.col("add"), "schedule").when(F.col("slot").isNull(), "cancel")
    shown = both.select(action.alias("action"), F.coalesce("slot", "notification_id").alias("notification_id"), F.when(F.col("add"), F.col("id").cast("string")).alias("id"), F.when(F.col("add"), F.col("reminder_at_local")).alias("at"))
    return shown.where(F.col("action").isNotNull())


def sweep_outcome(plan: DataFrame, enabled: bool = True, permitted: bool = True) -> DataFrame:
    """One row: how many alarms are scheduled and cancelled, and why none is scheduled where that is so."""
    why = "permission" if not permitted else "disabled" if not enabled else "done"
    return plan.agg(F.count_if(F.col("action") == "schedule").alias("scheduled"), F.count_if(F.col("action") == "cancel").alias("cancelled")).withColumn("outcome", F.lit(why))


def emit_actions(plan: DataFrame, path: str, epoch: int) -> bool:
    """Commit the actions of a sweep for an epoch, once; ``turn`` gives the order in which the owner of the alarms applies them, cancels first.

    An epoch that is there already changes nothing and gives False, so a sweep may be run again after a failure.
    """
    order = Window.orderBy(F.col("action") != "cancel", "at", "notification_id")  # a plan is at most the alarms that are held and the limit
    return commits.commit_once(plan.withColumn("turn", F.row_number().over(order)), path, epoch)
