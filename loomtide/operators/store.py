"""List, search, statistics and write operators of the task store."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold_for_search
from . import commits


def task_order() -> list[Column]:
    """Undated last, all-day before timed, then spoken order; the id makes it total."""
    return [F.col("due_date").asc_nulls_last(), F.col("due_minute_of_day").asc_nulls_first(), F.col("sort_order").asc(), F.col("id").asc()]


def today_tasks(tasks: DataFrame, today: dt.date) -> DataFrame:
    """Open tasks without a date or due today or before."""
    return tasks.where(~F.col("completed") & (F.col("due_date").isNull() | (F.col("due_date") <= F.lit(today)))).orderBy(*task_order())


def upcoming_tasks(tasks: DataFrame, today: dt.date, limit: int = 500) -> DataFrame:
    return tasks.where(~F.col("completed") & (F.col("due_date") > F.lit(today))).orderBy(*task_order()).limit(limit)


def someday_tasks(tasks: DataFrame, limit: int = 500) -> DataFrame:
    return tasks.where(~F.col("completed") & F.col("due_date").isNull()).orderBy("sort_order", F.desc("created_at"), "id").limit(limit)


def completed_tasks(tasks: DataFrame, limit: int = 200) -> DataFrame:
    return tasks.where("completed").orderBy(F.col("completed_at").desc_nulls_last(), "id").limit(limit)


def search_tasks(tasks: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """Tasks whose folded title contains the folded query; an empty query finds nothing."""
    needle = fold_for_search(F.lit(query))
    return tasks.where((needle != "") & F.contains(F.col("title_folded"), needle)).orderBy("completed", *task_order()).limit(limit)


def schedulable(tasks: DataFrame, start: dt.datetime) -> DataFrame:
    """Open tasks with a reminder at ``start`` or later, in order of time."""
    return tasks.where(~F.col("completed") & F.col("reminder_enabled") & (F.col("reminder_at_local") >= F.lit(start).cast("timestamp_ntz"))).orderBy("reminder_at_local", "id")


def due_reminders(tasks: DataFrame, start: dt.datetime, limit: int = 64) -> DataFrame:
    return schedulable(tasks, start).limit(limit)


def totals(tasks: DataFrame) -> DataFrame:
    return tasks.agg(F.count_if(~F.col("completed")).alias("open_count"), F.count_if("completed").alias("completed_count"))


def recent_completions(tasks: DataFrame, start: dt.datetime, limit: int = 2000) -> DataFrame:
    return tasks.where(F.col("completed") & (F.col("completed_at") >= F.lit(start))).select("id", "completed_at").orderBy(F.desc("completed_at"), "id").limit(limit)


def change_ticker(tasks: DataFrame) -> DataFrame:
    """One row that moves whenever the table does."""
    return tasks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.unix_millis("updated_at")), F.lit(0)).alias("updated_sum"))


def quota(usage: DataFrame, today: dt.date, is_pro: bool, limit: int = 1) -> DataFrame:
    """Whether one more capture is allowed today; a day without a row has none."""
    day = usage.where(F.col("day") == F.lit(today)).agg(F.coalesce(F.sum("capture_count"), F.lit(0)).alias("used"))
    return day.select("used", F.greatest(F.lit(0), F.lit(limit) - F.col("used")).alias("remaining"), (F.lit(is_pro) | (F.col("used") < limit)).alias("allowed"))


def append_tasks(tasks: DataFrame, new: DataFrame) -> DataFrame:
    return tasks.unionByName(new)


def write_snapshot(tasks: DataFrame, path: str) -> int:
    """Write a snapshot as the next version of a table; readers see the old one or the new one whole, also when the job fails.

    ``tasks`` may be read from the table itself.  Raises ``commits.CommitConflict`` when another writer was first.
    """
    return commits.commit(tasks, path, note="snapshot")


def append_rows(tasks: DataFrame, path: str) -> int:
    """Add rows to a table in one job: all or none."""
    return commits.commit(tasks, path, append=True, note="append")


def update_in_place(spark: SparkSession, path: str, changes: DataFrame, key: str = "id", order_by: str | None = None) -> int:
    """``update_tasks`` on the last version of a table; made again when another writer was first."""
    return commits.change(spark, path, lambda rows: update_tasks(rows, changes, key, order_by), note="update")


def update_tasks(tasks: DataFrame, changes: DataFrame, key: str = "id", order_by: str | None = None) -> DataFrame:
    """The snapshot with the columns of ``changes`` put in by key; null is a value like any other.

    Of several changes of one key the last by ``order_by`` counts (without it, the largest row), so no key
    multiplies; unknown keys change nothing, and null keys meet no row.
    """
    columns = [c for c in changes.columns if c not in (key, order_by)]
    row = F.struct(*([F.col(order_by)] if order_by else []), *(F.col(c).alias(f"new_{c}") for c in columns))
    last = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(row).alias("change"))
    joined = tasks.join(last, key, "left")
    return joined.select(*(F.when(F.col("change").isNotNull(), F.col(f"change.new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in tasks.columns))


def delete_all(tasks: DataFrame) -> DataFrame:
    """No task; the settings that hold the slot counter are another table and stay."""
    return tasks.limit(0)


def set_completed(tasks: DataFrame, ids: DataFrame, done: bool, now: dt.datetime) -> DataFrame:
    """Set or clear the completion of the tasks in ``ids`` (a column ``id``, of any size; repeats count once) and mark them as updated in the same write."""
    tasks = tasks.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    hit = F.coalesce("__hit", F.lit(False))
    at = F.lit(now if done else None).cast("timestamp")
    return tasks.withColumns({"completed": F.when(hit, done).otherwise(F.col("completed")), "completed_at": F.when(hit, at).otherwise(F.col("completed_at")), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))}).drop("__hit")


def delete_tasks(tasks: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return tasks.join(gone.select(key), key, "left_anti")


def add_usage(usage: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counts by day; deltas of any number of writers add up."""
    return usage.unionByName(deltas).groupBy("day").agg(F.sum("capture_count").alias("capture_count"), F.sum("task_count").alias("task_count"))


def prune_usage(usage: DataFrame, today: dt.date, days: int = 90) -> DataFrame:
    return usage.where(F.col("day") >= F.date_sub(F.lit(today), days))


def upsert_settings(settings: DataFrame, changes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The last write of each key wins; changes win ties.  ``by`` names columns that tell owners of settings apart."""
    both = settings.withColumn("turn", F.lit(0)).unionByName(changes.withColumn("turn", F.lit(1)))
    newest = F.max(F.struct("updated_at", "turn", "value"))
    return both.groupBy(*by, "key").agg(newest.alias("x")).select(*by, "key", "x.value", "x.updated_at")


def seed_settings(settings: DataFrame, defaults: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Defaults for keys that are not there."""
    return settings.unionByName(defaults.join(settings, [*by, "key"], "left_anti").select(*settings.columns))


def reset_settings(settings: DataFrame, defaults: DataFrame, keep: str = "next_notification_id", by: Sequence[str] = ()) -> DataFrame:
    return seed_settings(settings.where(F.col("key") == keep), defaults, by)


def settings_map(settings: DataFrame) -> DataFrame:
    return settings.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("settings"))


def assign_slots(tasks: DataFrame, counter: int, wrap: int = 0x7FFFFFFF) -> DataFrame:
    """Consecutive slots after ``counter`` in order of id; past ``wrap`` they begin at 1 again.

    Ids are cut into ranges at the quantiles of a sample of fixed size, the ids of least hash, so the ranges are the same whenever they are computed again.  The number
    of a row is the size of the ranges before its own plus its place there, so no task sees all rows.
    """
    parts = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = sorted(r.id for r in tasks.select("id").where("id IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(parts * 64).collect())
    bounds = sample[64::64]
    kind = tasks.schema["id"].dataType
    cuts = F.array(*(F.lit(b).cast(kind) for b in bounds)) if bounds else F.array().cast(f"array<{kind.simpleString()}>")
    marked = tasks.withColumn("__part", F.size(F.filter(cuts, lambda b: b <= F.col("id"))))
    sizes = marked.groupBy("__part").agg(F.count("*").alias("n"))  # one row a range
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy("id"))
    return marked.withColumn("__nth", nth).join(before, "__part").withColumn("notification_id", ((F.lit(counter - 1).cast("long") + F.col("__nth") + F.col("before")) % wrap + 1).cast("int")).drop("__part", "__nth", "before")
