"""Headers, groups and completion statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_for(due: Column, today: Column) -> Column:
    ahead = F.datediff(due, today)
    return F.when(ahead <= 0, "today").when(ahead == 1, "tomorrow").when(ahead <= 6, "weekday").when(ahead <= 13, "nextWeek").when(due.isNotNull(), "later")


def group_headers(tasks: DataFrame, today: dt.date) -> DataFrame:
    """Label, first date and size of each header; ranges merge, weekdays stay apart; undated tasks have none."""
    dated = tasks.where(F.col("due_date").isNotNull()).withColumn("label", label_for(F.col("due_date"), F.lit(today)))
    merged = F.when(F.col("label").isin("today", "nextWeek", "later"), F.lit(None)).otherwise(F.col("due_date"))
    return dated.groupBy("label", merged.alias("day")).agg(F.min("due_date").alias("first_date"), F.count("*").alias("n_tasks")).drop("day")


def completions_by_day(completions: DataFrame, zone: str = "UTC") -> DataFrame:
    """Tasks by local day of completion; without a time they are skipped."""
    day = F.to_date(F.from_utc_timestamp("completed_at", zone))
    return completions.where(F.col("completed_at").isNotNull()).groupBy("owner", day.alias("day")).agg(F.count("*").alias("n_done"))


def week_histogram(by_day: DataFrame, today: dt.date, days: int = 7) -> DataFrame:
    """One row for each owner and each of the last days, with zeros."""
    window = by_day.select("owner").distinct().withColumn("day", F.explode(F.sequence(F.date_sub(F.lit(today), days - 1), F.lit(today))))
    return window.join(by_day, ["owner", "day"], "left").select("owner", "day", F.coalesce("n_done", F.lit(0)).alias("n_done"))


def streaks(by_day: DataFrame, today: dt.date, cap: int = 400, days_back: int = 401, completions: int = 2000) -> DataFrame:
    """Consecutive days with a completion up to today or yesterday, at most ``cap``.

    Only the newest ``completions`` completions of an owner within ``days_back`` days are looked at.
    """
    return owner_stats(by_day, today, cap=cap, days_back=days_back, completions=completions).select("owner", "streak_days")


def owner_stats(by_day: DataFrame, today: dt.date, totals: DataFrame | None = None, cap: int = 400, days_back: int = 401, completions: int = 2000) -> DataFrame:
    """One row per owner: completions of the last 7 days and the streak, and the open and completed counts of ``totals`` where given.

    The daily counts are read once: islands of days are numbered by a window over the owner, and one
    aggregation makes both figures.
    """
    day, newest = F.col("day"), Window.partitionBy("owner").orderBy(F.desc("day"))
    seen = by_day.where(day <= F.lit(today)).withColumns({"newer": F.sum("n_done").over(newest) - F.col("n_done"), "back": F.row_number().over(newest)})
    # A day of the streak is as many days before the newest day as there are rows before it; the newest is today or yesterday.
    first = F.max("day").over(Window.partitionBy("owner"))
    run = (F.datediff(first, "day") == F.col("back") - 1) & (first >= F.date_sub(F.lit(today), 1)) & (day >= F.date_sub(F.lit(today), days_back - 1)) & (F.col("newer") < completions)
    stats = seen.withColumn("run", run).groupBy("owner").agg(F.coalesce(F.sum(F.when(day >= F.date_sub(F.lit(today), 6), F.col("n_done"))), F.lit(0)).alias("done_last_7"), F.least(F.count_if("run"), F.lit(cap)).cast("int").alias("streak_days"))
    everyone = by_day.groupBy("owner").agg(F.count("*").alias("days")).select("owner") if totals is None else totals
    joined = everyone.join(stats, "owner", "left")
    return joined.select(*everyone.columns, F.coalesce("done_last_7", F.lit(0)).alias("done_last_7"), F.coalesce("streak_days", F.lit(0)).alias("streak_days"))


def nearest_rank(value: str, *shares: float) -> list[Column]:
    """Nearest-rank percentiles p50, p95, ... of a column; 0 where there is no value."""
    return [F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})"), F.lit(0)).alias(f"p{round(p * 100)}") for p in shares]
